"""Adaptive context-mixing range coder for token ids, in independent checksummed blocks.

Within a block the ids are cut into lanes of equal length, coded in step: at each step every lane codes
one id with a range coder of its own, and all lanes share one model, which starts empty in every block.
The model mixes three predictions of the next id: the id that last followed the two ids before (order 2), the id that
last followed the id before (order 1), and the frequencies of the ids so far (order 0). An id's probability is
their weighted sum,

    P(x) = w2 [x = p2] + w1 [x = p1] + w0 f(x),

and one step of the coder codes it. The weights are learned for every pair of confidences of p2 and p1: each prediction
is credited with its share of the probability that the coded id was given. A block's bytes are

    magic, ids, lanes, vocabulary (u32 each), words of each lane (u32 each), the words (u32), crc32 of the ids
    as little-endian u32, crc32 of all before (u32 each), all little-endian.
"""

from __future__ import annotations

import zlib

import numpy as np

MAGIC = 0x32434D43
LANES = 8192
#: Ids that a lane has at least, so that a small block learns something too.
LEAST_STEPS = 256
#: The weights' sum and that of the frequencies; a lane's range is kept above 2 ** 32, more than their product.
MIX_BITS = 12
FREQ_BITS = 19
ALL_BITS = MIX_BITS + FREQ_BITS
#: Credit that one coded id gives, and what each prediction starts with.
CREDIT = 64
#: Steps from one update of the weights to the next; each step has an id of every lane.
WEIGH_EVERY = 4
HASH_BITS = 18
#: By confidence, and 8 more for a hit: whether the entry is renewed, else the change of its confidence.
_RENEW = np.array([1, 1, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0], bool)
_CHANGE = np.array([0, 0, *((k >> 1) - k for k in range(2, 8)), 0, 1, 1, 1, 1, 1, 1, 0], np.int32)
U = np.uint64
_LOW = U(1 << 32)


class _Model:
    """What both directions know before each step."""

    def __init__(self, vocabulary: int) -> None:
        self.vocabulary = vocabulary
        self.two = np.zeros(1 << HASH_BITS, np.int32)  # id << 3 | confidence
        self.one = np.zeros(1 << 16, np.int32)
        self.credit = np.full((128, 3), CREDIT, np.int64)
        self._weigh()
        self.counts = np.zeros(vocabulary, np.int64)
        self.recent: list[np.ndarray] = []
        self.step, self.due = 0, 1
        self._rebuild()

    def _rebuild(self) -> None:
        if self.recent:
            self.counts += np.bincount(np.concatenate(self.recent), minlength=self.vocabulary)
            self.recent = []
        free, total = (1 << FREQ_BITS) - self.vocabulary, int(self.counts.sum())
        freq = 1 + (self.counts * free // total if total else np.full(self.vocabulary, free // self.vocabulary))
        freq[-1] += (1 << FREQ_BITS) - int(freq.sum())
        self.freq, self.symbols = freq.astype(np.int32), None
        self.cum = (np.cumsum(freq) - freq).astype(np.int32)

    def _weigh(self) -> None:
        both = (self.credit[:, :2] * ((1 << MIX_BITS) - 1) // self.credit.sum(axis=1, keepdims=True)).T
        self.weights = (*np.ascontiguousarray(both << FREQ_BITS), (1 << MIX_BITS) - both.sum(axis=0))

    def symbol(self, v: np.ndarray) -> np.ndarray:
        """The ids whose frequencies' runs have the places v."""
        if self.symbols is None:
            self.symbols = np.repeat(np.arange(self.vocabulary, dtype=np.uint16), self.freq)
        return self.symbols[v].astype(np.int32)

    def predict(self, before: np.ndarray, last: np.ndarray):
        """(p2, p1, and what w2, w1 and w0 add to an id: the first two as parts of 2 ** ALL_BITS)."""
        self.last, self.at = last, (before.view(np.uint32) * np.uint32(0x2545F491) + last.view(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(32 - HASH_BITS)
        self.e2, self.e1 = self.two[self.at], self.one[last]
        self.p2, self.p1 = self.e2 >> 3, self.e1 >> 3
        self.context = (self.e2 & 7) * 8 + (self.e1 & 7) + 64 * (self.p1 == self.p2)
        self.a2, self.a1, self.w0 = (x[self.context] for x in self.weights)
        return self.p2, self.p1, self.a2, self.a1, self.w0

    def span(self, ids: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, size) of each id's part of 2 ** ALL_BITS, the ids standing in the order of their numbers."""
        cum = self.w0 * self.cum[ids] + self.a2 * (self.p2 < ids) + self.a1 * (self.p1 < ids)
        self.size = self.w0 * self.freq[ids] + self.a2 * hit2 + self.a1 * hit1
        return cum.view(U), self.size.view(U)

    def update(self, ids: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        if self.step % WEIGH_EVERY == 0:
            # Parts of the probability that each id had; those that no prediction hit are order 0's alone.
            hit = np.flatnonzero(hit2 | hit1)
            context, whole = self.context[hit], self.size[hit]
            for k, (a, right) in enumerate(((self.a2, hit2), (self.a1, hit1))):  # sums of small whole numbers, exact in doubles
                got = np.bincount(context, CREDIT * (a[hit] * right[hit]) // whole, 128).astype(np.int64)
                self.credit[:, k] += got
                self.credit[:, 2] -= got
            self.credit[:, 2] += CREDIT * np.bincount(self.context, minlength=128)
            self._weigh()
        fresh = ids << 3 | 1
        for table, at, e, hit in ((self.two, self.at, self.e2, hit2), (self.one, self.last, self.e1, hit1)):
            rule = (e & 7) + 8 * hit
            table[at] = np.where(_RENEW[rule], fresh, e + _CHANGE[rule])
        self.recent.append(ids)
        self.step += 1
        if self.step == self.due:
            self.due = min(2 * self.due, self.due + 64)
            self._rebuild()


def _layout(n: int) -> tuple[int, int]:
    """(lanes, steps): lane i has the ids from i * steps on."""
    steps = max(min(n, LEAST_STEPS), -(-n // LANES))
    return -(-n // steps) if n else 0, steps


def encode_block(ids: np.ndarray, vocabulary: int) -> bytes:
    n = len(ids)
    lanes, steps = _layout(n)
    grid = np.zeros(lanes * steps, np.int32)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    short = n - (lanes - 1) * steps  # ids of the last lane
    model = _Model(vocabulary)
    low, rng, made = np.zeros(lanes, U), np.full(lanes, ~U(0), U), np.zeros(lanes, np.int64)
    words = np.zeros((lanes, steps + 4), np.uint32)  # one at most for each id

    before = last = np.zeros(lanes, np.int32)
    for t in range(steps):
        a = lanes if t < short else lanes - 1
        x = grid[t, :a]
        p2, p1, *_ = model.predict(before[:a], last[:a])
        hit2, hit1 = x == p2, x == p1
        cum, size = model.span(x, hit2, hit1)
        r = rng[:a] >> U(ALL_BITS)
        add = r * cum
        now = low[:a] + add
        r *= size
        lane = np.flatnonzero(now < add)  # carries
        place = made[lane] - 1
        while len(lane):
            words[lane, place] += np.uint32(1)
            more = words[lane, place] == 0
            lane, place = lane[more], place[more] - 1
        lane = np.flatnonzero(r < _LOW)
        words[lane, made[lane]] = now[lane] >> U(32)
        made[lane] += 1
        now[lane] <<= U(32)
        r[lane] <<= U(32)
        low[:a], rng[:a] = now, r
        model.update(x, hit2, hit1)
        before, last = last, x
    lane = np.arange(lanes)
    for shift in (U(32), U(0)):
        words[lane, made] = (low >> shift) & U(0xFFFFFFFF)
        made += 1
    head = np.array([MAGIC, n, lanes, vocabulary, *made], "<u4").tobytes()
    body = words[np.arange(words.shape[1]) < made[:, None]].astype("<u4").tobytes()
    out = head + body + np.uint32(zlib.crc32(np.asarray(ids).astype("<u4").tobytes())).tobytes()
    return out + np.uint32(zlib.crc32(out)).tobytes()


def decode_block(block: bytes) -> np.ndarray:
    """The ids of a block; ValueError if its bytes aren't those that were written."""
    if len(block) < 24 or zlib.crc32(block[:-4]) != int(np.frombuffer(block[-4:], "<u4")[0]):
        raise ValueError("block checksum")
    data = np.frombuffer(block, "<u4")
    magic, n, lanes, vocabulary = (int(x) for x in data[:4])
    if magic != MAGIC:
        raise ValueError("not a block")
    made = data[4 : 4 + lanes].astype(np.int64)
    words = np.append(data[4 + lanes : -2], np.zeros(4, np.uint32)).astype(U)
    steps = _layout(n)[1]
    short = n - (lanes - 1) * steps
    next_word = np.cumsum(made) - made
    code = words[next_word] << U(32) | words[next_word + 1] if lanes else np.zeros(0, U)
    next_word += 2
    rng, model = np.full(lanes, ~U(0), U), _Model(vocabulary)
    grid = np.zeros((steps, lanes), np.int32)
    before = last = np.zeros(lanes, np.int32)
    for t in range(steps if lanes else 0):
        a = lanes if t < short else lanes - 1
        p2, p1, a2, a1, w0 = model.predict(before[:a], last[:a])
        r = rng[:a] >> U(ALL_BITS)
        v = np.minimum(code[:a] // r, U((1 << ALL_BITS) - 1)).view(np.int64)
        # The two predicted ids by number: what lies above one of them is w0 f moved up by its addition.
        swap = p2 > p1
        p, q = np.where(swap, p1, p2), np.where(swap, p2, p1)
        ap = np.where(swap, a1, a2)
        aq = a1 + a2 - ap
        at_p, at_q = w0 * model.cum[p], w0 * model.cum[q] + ap
        over_p = v >= at_p + w0 * model.freq[p] + ap
        over_q = v >= at_q + w0 * model.freq[q] + aq
        is_p, is_q = (v >= at_p) & ~over_p, (v >= at_q) & ~over_q
        is_q |= is_p & (p == q)
        x = model.symbol(np.where(is_p | is_q, 0, (v - ap * over_p - aq * over_q) // w0))
        x = np.where(is_q, q, np.where(is_p, p, x))
        hit2, hit1 = x == p2, x == p1
        cum, size = model.span(x, hit2, hit1)
        now = code[:a] - r * cum
        r = r * size
        lane = np.flatnonzero(r < _LOW)
        now[lane] = now[lane] << U(32) | words[next_word[lane]]
        next_word[lane] += 1
        r[lane] <<= U(32)
        code[:a], rng[:a] = now, r
        model.update(x, hit2, hit1)
        grid[t, :a] = x
        before, last = last, x
    ids = grid.T.reshape(-1)[:n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != int(data[-2]):
        raise ValueError("ids checksum")
    return ids
