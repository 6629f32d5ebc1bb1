"""Secret scans: all rules in one minimal deterministic automaton, run over the bytes once."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from pointloom.llm import automaton
from pointloom.llm import words as W
from pointloom.llm.names import hide


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, the least length of a match beyond `head`, and the pattern's form for the scan.

    Matches are leftmost, longest and don't overlap within a kind; those that are too short count as
    nothing but have used up their text.
    """

    kind: str
    pattern: str
    least: int
    head: str = ""
    either_case: bool = False
    scan: str = ""


_KEYS = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
#: Rules of a head and a run of signs share one form in the scan, as the runs of each would multiply its states.
_TOKENS = r"(gh[opsur]_|xox[abeoprs]-|AIza|[rs]k_live_|glpat-)[A-Za-z0-9_.-]+"
# The kinds in their order.
RULES = (
    Rule("assign", _KEYS + r"[A-Za-z0-9+/_.=-]+", 12, head=_KEYS, either_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16, scan=r"[0-9a-f]{16}[0-9a-f]*"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]+", 40, scan=_TOKENS),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 27),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]+", 24, scan=_TOKENS),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39, scan=_TOKENS),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", 24, scan=_TOKENS),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]+", 26, scan=_TOKENS),
)
BASE = ("assign", "access", "hex")


@lru_cache
def scanner() -> automaton.Dfa:
    return automaton.compile_rules(list(_forms()))


@lru_cache
def _forms() -> dict[tuple[str, bool], list[int]]:
    """The forms that are scanned for, in the order of the automaton's bits, and the rules of each."""
    forms: dict[tuple[str, bool], list[int]] = {}
    for i, r in enumerate(RULES):
        forms.setdefault((r.scan or r.pattern, r.either_case), []).append(i)
    return forms


@lru_cache
def _anchored(pattern: str, either_case: bool) -> automaton.Dfa:
    return automaton.compile_rules([(pattern, either_case)], anchored=True)


@lru_cache
def _starts(pattern: str, either_case: bool) -> automaton.Dfa:
    return automaton.compile_rules([(pattern, either_case)], backwards=True)


def _begins(pattern: str, either_case: bool, data: bytes) -> np.ndarray:
    """Where a match of the pattern begins, in order: the places at which the automaton of the turned pattern, read from behind, accepts."""
    dfa = _starts(pattern, either_case)
    states = automaton.run(dfa, np.frombuffer(data, np.uint8)[::-1])
    return (len(data) - 1 - dfa.hits(states))[::-1]


def _matches(rule: Rule, data: bytes) -> list[tuple[int, int]]:
    """The rule's matches in a stretch that no match reaches into or out of."""
    # A run of one class of signs is as long as it is, so runs that are too short can be left out from the start.
    pattern = rule.scan if rule.scan and rule.scan != _TOKENS else rule.pattern
    whole, found, at, begins = _anchored(pattern, rule.either_case), [], 0, None
    while at < len(data):
        end = whole.longest(data, at, len(data))
        if end < 0:
            begins = _begins(pattern, rule.either_case, data) if begins is None else begins
            after = int(np.searchsorted(begins, at, "right"))
            if after == len(begins):
                break
            at = int(begins[after])
            continue
        body = _anchored(rule.head, rule.either_case).longest(data, at, end) if rule.head else at
        if end - body >= rule.least:
            found.append((at, end))
        at = end
    return found


def scan(data: np.ndarray, bounds: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """Text number to its (start, end, rule) in code points, by start and then rule; texts without spans are left out.

    A stretch between two bytes after which the automaton is in its start state holds whole matches only,
    so spans are settled within the stretches in which a rule has accepted.
    """
    dfa, n = scanner(), len(bounds) - 1
    apart = np.full(len(data) + n, 10, np.uint8)  # a line feed, which no rule takes, after every text
    new = bounds + np.arange(n + 1)
    for i in range(n):
        apart[new[i] : new[i + 1] - 1] = data[bounds[i] : bounds[i + 1]]
    states = automaton.run(dfa, apart)
    hits, bits = dfa.marks(states)
    if not len(hits):
        return {}
    small = np.int32 if len(apart) < 1 << 31 else np.int64
    resets = np.flatnonzero(states == 0).astype(small)
    after = np.searchsorted(resets, hits)
    first = np.flatnonzero(np.concatenate([[True], after[1:] != after[:-1]]))  # of each stretch
    masks = np.bitwise_or.reduceat(bits, first)
    ends = resets[after[first]]
    begins = np.where(after[first] > 0, resets[after[first] - 1] + 1, 0)
    del states, resets, hits, after
    found: dict[int, list[tuple[int, int, int]]] = {}
    points = np.cumsum((apart & 0xC0) != 0x80, dtype=small)  # code points up to each byte, counted once
    for a, b, m in zip(begins.tolist(), ends.tolist(), masks.tolist(), strict=True):
        doc = int(np.searchsorted(new, a, "right")) - 1
        stretch, base = apart[a:b].tobytes(), int(points[new[doc]]) - 1
        for r in (r for bit, rules in enumerate(_forms().values()) if m >> bit & 1 for r in rules):
            for s, e in _matches(RULES[r], stretch):
                found.setdefault(doc, []).append((int(points[a + s]) - 1 - base, int(points[a + e - 1]) - base, r))
    for spans in found.values():
        spans.sort(key=lambda x: (x[0], x[2]))
    return found


_FIELDS = [T.StructField(f"n_{r.kind}", T.LongType()) for r in RULES] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]


@arrow_udf(T.StructType(_FIELDS))
def find_secrets(text: pa.Array) -> pa.Array:
    counts = np.zeros((len(RULES), len(text)), np.int64)
    digests, listed = [hashlib.sha256(b"").hexdigest()] * len(text), [""] * len(text)
    for at, _, t in W.chunks(text):
        for doc, spans in scan(t.data, t.bounds).items():
            for *_, r in spans:
                counts[r, at + doc] += 1
            names = [(RULES[r].kind, f"{RULES[r].kind}:{s}:{e}") for s, e, r in spans]
            digests[at + doc] = hashlib.sha256(",".join(x for kind, x in names if kind in BASE).encode()).hexdigest()
            listed[at + doc] = ",".join(x for _, x in names)
    return pa.StructArray.from_arrays([*map(pa.array, counts), pa.array(digests, pa.string()), pa.array(listed, pa.string())], [f.name for f in _FIELDS])


def secret_spans(docs: DataFrame) -> DataFrame:
    """docs with a count per kind (n_assign, n_access, n_hex, ...), base_sha256 and spans.

    spans lists every span as kind:start:end in code points, end exclusive, by start and then kind in RULES'
    order; base_sha256 is the digest of those of the BASE kinds alone. A null or empty text has none. Rows
    are scanned each on its own, so repeated rows and ties give repeated results and an empty table an
    empty one. docs' columns stay, whatever their names, except those named like the added.
    """
    names = [f.name for f in _FIELDS]
    hidden, show = hide(docs, ("text",), names)
    return show(hidden.withColumn("_pl_s", find_secrets(F.col("text"))), *[F.col(f"_pl_s.{n}").alias(n) for n in names])


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return secret_spans(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
