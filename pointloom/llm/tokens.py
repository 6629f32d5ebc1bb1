"""Token ids of whole texts: the tokenizers library's, with pieces encoded once and then looked up.

The word-level vocabulary drops white space, lower-cases and cuts texts into runs of letters, single
digits and runs of other signs; each piece is then merged on its own. Words of ASCII and Latin-1 letters, digits
and signs are cut and lower-cased here with NumPy, and the library merges each new piece; any other word, and those
with an apostrophe or "<", go through the whole library. Pieces are told apart by their bytes.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from pointloom.llm import words as W

END_ID = 2
#: Pieces remembered at once by a worker; the half that was used last stays.
REMEMBER = 600_000
#: Bytes of text encoded at once.
ENCODE_BYTES = 1 << 20

LETTER, DIGIT, SIGN, OTHER = range(4)


def _byte_classes() -> np.ndarray:
    """Class of each byte of a word. Two-byte letters U+00C0-U+00FF begin with 0xC3; other lead bytes are OTHER."""
    out = np.full(256, OTHER, np.uint8)
    out[0x21:0x7F] = SIGN
    out[[ord(c) for c in "'<"]] = OTHER
    out[ord("0") : ord("9") + 1] = DIGIT
    out[ord("A") : ord("Z") + 1] = out[ord("a") : ord("z") + 1] = LETTER
    out[0x80:0xC0] = out[0xC3] = LETTER
    return out


CLASS = _byte_classes()


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _model_only(path: str):
    """The library's tokenizer of this file for pieces that are cut and lower-cased, with a space between them."""
    from tokenizers import Tokenizer, pre_tokenizers

    model = Tokenizer.from_file(path).model
    model._resize_cache(0)  # pieces come once
    bare = Tokenizer(model)
    bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return bare


def _bytes(column: pa.LargeBinaryArray) -> list[bytes]:
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1].tolist()
    raw = data.to_pybytes() if data is not None else b""
    return [raw[a:b] for a, b in zip(at, at[1:])]


class Encoder:
    """Ids of texts by one vocabulary file. Every piece's ids come from the library; those of REMEMBER pieces are kept."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library, self.model = Tokenizer.from_file(path), _model_only(path)
        suffix = json.loads(self.model.to_str())["model"]["end_of_word_suffix"]
        vocabulary = self.model.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a piece
        self.last[[i for x, i in vocabulary.items() if x.endswith(suffix)]] = True
        self.known: dict[bytes, bytes] = {}  # a piece's bytes to its ids'; whole words that the library cuts begin with a space
        self.older: dict[bytes, bytes] = {}

    def _learn(self, new: list[bytes]) -> None:
        plain = [x for x in new if x[:1] != b" "]
        for at in range(0, len(plain), 4096):
            part = plain[at : at + 4096]
            ids = np.array(self.model.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, np.uint16)
            ends = (np.flatnonzero(self.last[ids]) + 1) * 2
            raw, start = ids.tobytes(), 0
            if len(ends) != len(part):
                raise ValueError("a piece without ids")
            for x, end in zip(part, ends.tolist()):
                self.known[x] = raw[start:end]
                start = end
        odd = [x for x in new if x[:1] == b" "]
        if odd:
            for x, e in zip(odd, self.library.encode_batch([x[1:].decode("utf-8", "replace") for x in odd], add_special_tokens=False)):
                self.known[x] = np.array(e.ids, np.uint16).tobytes()

    def _ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces end to end, the number of each one's)."""
        if len(self.known) > REMEMBER // 2:  # the last half is older, and what is still used moves to the new one
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        found = list(map(known.get, pieces))
        if None in found:
            missing = [i for i, x in enumerate(found) if x is None]
            fresh = [pieces[i] for i in missing]
            again = list(map(older.get, fresh))
            self._learn([x for x, ids in zip(fresh, again) if ids is None])
            for i, x, ids in zip(missing, fresh, again):
                if ids is None:
                    ids = known[x]
                else:
                    known[x] = ids
                found[i] = ids
        return np.frombuffer(b"".join(found), np.uint16), np.fromiter(map(len, found), np.int64, len(found)) >> 1

    def chunk(self, t: W.Texts, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, each with end_id behind it, and the texts' bounds among them)."""
        data, kind = t.data, CLASS[t.data]
        lower = W.LOWER[data]
        two = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) else np.zeros(0, np.int64)
        second = data[two]
        kind[two[(second == 0x97) | (second == 0xB7)]] = OTHER
        lower[two[(second >= 0x80) & (second <= 0x9E)]] += 0x20
        # A word with any other byte is one piece; else pieces end where the class changes, and around each digit.
        edge, begins, odd_word = np.zeros(len(data) + 1, np.int8), np.zeros(len(data) + 1, bool), np.zeros(len(t.starts), bool)
        edge[t.starts] += 1
        edge[t.ends] -= 1
        inside = np.cumsum(edge, dtype=np.int8).view(bool)
        odd_word[np.searchsorted(t.starts, np.flatnonzero((kind == OTHER) & inside[:-1]), "right") - 1] = True
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        strange_at = W.flat_ranges(t.starts[odd_word], (t.ends - t.starts)[odd_word])
        cut[strange_at] = False
        cut &= inside
        cut[t.starts] = begins[t.starts] = True
        starts = np.flatnonzero(cut)
        word = np.cumsum(begins[starts]) - 1
        ends = np.minimum(np.append(starts[1:], len(data)), t.ends[word]) if len(starts) else starts
        odd = odd_word[word]
        inside[strange_at] = False
        offsets = np.concatenate([[0], np.cumsum((ends - starts)[~odd])])
        pieces = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(lower[inside[:-1]])]).dictionary_encode()
        listed = _bytes(pieces.dictionary)
        place = np.empty(len(starts), np.int64)
        place[~odd] = pieces.indices.to_numpy()
        if odd.any():  # whole words, told from pieces by a space
            raw = data.tobytes()
            strange_words = [b" " + raw[a:b] for a, b in zip(starts[odd].tolist(), ends[odd].tolist(), strict=True)]
            each = {x: i for i, x in enumerate(dict.fromkeys(strange_words), len(listed))}
            listed += each
            place[odd] = [each[x] for x in strange_words]
        found, sizes = self._ids(listed)
        before = np.searchsorted(starts, t.bounds)  # pieces before each text
        if end_id is not None:  # a piece of its own behind each text
            place = np.insert(place, before[1:], len(sizes))
            found, sizes = np.append(found, np.uint16(end_id)), np.append(sizes, 1)
            before = before + np.arange(len(before))
        n = sizes[place]
        bounds = np.concatenate([[0], np.cumsum(n)])[before]
        return found[W.flat_ranges((np.cumsum(sizes) - sizes)[place], n)], bounds


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for this vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(column: pa.Array, path: str, size: int = ENCODE_BYTES):
    """(first row, row after the last, ids, bounds) for whole texts, about `size` bytes at once."""
    e = encoder(path)
    for a, b, t in W.chunks(column, size=size):
        yield a, b, *e.chunk(t)
