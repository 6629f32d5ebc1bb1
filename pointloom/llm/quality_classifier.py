"""Document quality by a linear-chain conditional random field over lines.

Every line with a word gets features of its own and of its neighbours; a two-state chain (good, bad) with
learned emission and transition weights gives each line's marginal by forward-backward, and a document's quality
is the mean of its lines' marginals of good, weighted by their length, on a scale set by the labels.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from pointloom.llm import words as W
from pointloom.llm.names import hide
from pointloom.llm.quality_rules import SYMBOL, _repeated, _sums

#: The model is fitted on so many labelled documents at most, those with the least hash of their doc_id, and
#: on none with more lines than MAX_LINES.
TRAIN_DOCS = 4000
MAX_LINES = 400
ROUNDS = 3
STEPS = 60
THRESHOLD = 0.7

PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[ord(c) for c in ".,;:?"]] = True
OWN = 11
NEAR = 6


def line_features(t: W.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, text number, bytes) of every line with a word, in order."""
    data, bounds = t.data, t.bounds
    newline = np.flatnonzero(data == 10)
    # A line begins at each text's start and behind each line feed.
    starts = np.unique(np.concatenate([bounds[:-1], newline + 1]))
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))
    w0, w1 = np.searchsorted(t.starts, starts), np.searchsorted(t.starts, ends)
    full = w1 > w0
    starts, ends, w0, w1 = starts[full], ends[full], w0[full], w1[full]
    if not len(starts):
        return np.zeros((0, OWN + 2 * NEAR), np.float32), np.zeros(0, np.int64), np.zeros(0)
    doc = np.searchsorted(bounds, starts, "right") - 1

    def per_line(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[ends] - total[starts]

    size = np.maximum(per_line(~W.SPACE[data]), 1)
    n = (w1 - w0).astype(float)
    h = t.hashes()
    same = np.concatenate([[0, 0], np.cumsum(h[1:] == h[:-1])])
    bar = np.concatenate([[0], np.cumsum((t.ends - t.starts == 1) & (data[t.starts] == ord("|")))])
    _, first = _repeated(W.span_hashes(data, starts, ends), doc)
    own = np.column_stack([
        per_line((data >= 65) & (data <= 90)) / size,
        per_line(SYMBOL[data]) / size,
        per_line(data == ord("!")) / size,
        (bar[w1] - bar[w0]) / n,
        (same[w1] - same[w0 + 1]) / n,
        ~first,
        per_line((data >= 48) & (data <= 57)) / size,
        per_line(PUNCTUATION[data]) / size,
        np.minimum(size / n, 40) / 10,
        np.log1p(n) / 5,
        np.ones(len(n)),
    ])
    near = np.zeros((len(own), 2 * NEAR))
    joined = doc[1:] == doc[:-1]
    near[1:, :NEAR][joined] = own[:-1, :NEAR][joined]
    near[:-1, NEAR:][joined] = own[1:, :NEAR][joined]
    return np.hstack([own, near]).astype(np.float32), doc, size.astype(float)


class Chains:
    """Some lines' chains, longest first, so that step i concerns the first `live[i]` of them."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.lengths = lengths
        begins = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        self.begins = begins[order]
        longest = int(lengths.max()) if len(lengths) else 0
        self.live = np.searchsorted(-lengths[order], -np.arange(1, longest + 1), "right")

    def marginals(self, score: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(bad) of every line and the expected transitions (2, 2), for `score` of bad over good and weights `step`."""
        emit = np.exp(np.column_stack([-score / 2, score / 2]).clip(-30, 30))
        move = np.exp(step)
        forward, backward = np.empty_like(emit), np.empty_like(emit)
        for i, k in enumerate(self.live):
            at = self.begins[:k] + i
            f = emit[at] if i == 0 else (forward[at - 1] @ move) * emit[at]
            forward[at] = f / f.sum(1, keepdims=True)
        ahead = np.ones((len(self.begins), 2))
        pairs = np.zeros((2, 2))
        for i in range(len(self.live) - 1, -1, -1):
            k = self.live[i]
            at = self.begins[:k] + i
            backward[at] = ahead[:k]
            if i:
                right = ahead[:k] * emit[at]
                joint = forward[at - 1][:, :, None] * move * right[:, None, :]
                pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
                b = right @ move.T
                ahead[:k] = b / b.sum(1, keepdims=True)
        both = forward * backward
        return both[:, 1] / both.sum(1), pairs


@dataclass(frozen=True)
class Model:
    """Emission weights, transition weights, and the logistic scale of the documents' mean marginals."""

    weights: np.ndarray
    step: np.ndarray
    slope: float
    middle: float
    prior: float

    def document_means(self, features: np.ndarray, doc: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
        """The length-weighted marginal of good of each of n texts; NaN without lines."""
        if not len(doc):
            return np.full(n, np.nan)
        lengths = np.bincount(doc, minlength=n)
        bad, _ = Chains(lengths[lengths > 0]).marginals(features @ self.weights, self.step)
        total = np.bincount(doc, size, n)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.bincount(doc, size * (1 - bad), n) / total

    def scores(self, features: np.ndarray, doc: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
        mean = self.document_means(features, doc, size, n)
        return np.where(np.isnan(mean), self.prior, 1 / (1 + np.exp(-np.clip(self.slope * (mean - self.middle), -30, 30))))


def _adam(value: np.ndarray, grad: np.ndarray, state: dict, rate: float) -> np.ndarray:
    m, v, t = state.get("m", 0), state.get("v", 0), state.get("t", 0) + 1
    m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
    state.update(m=m, v=v, t=t)
    return value - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)


def fit(features: np.ndarray, doc: np.ndarray, size: np.ndarray, quality: np.ndarray) -> Model:
    """A model from documents' labels. Lines start with their document's label; after each round those lines of bad
    documents that the model calls good are taken as good, unless a document would have no bad line left."""
    n, width = len(quality), OWN + 2 * NEAR
    prior = float(quality.mean()) if n else 0.5
    if not len(doc) or prior in (0.0, 1.0):
        return Model(np.zeros(width), np.zeros((2, 2)), 0.0, 0.0, prior)
    chains = Chains(np.bincount(doc, minlength=n)[np.unique(doc)])
    follows = np.flatnonzero(doc[1:] == doc[:-1])
    x = features.astype(float)
    bad = quality[doc] == 0
    weight = np.zeros(width)
    step = np.zeros((2, 2))
    for _ in range(ROUNDS):
        states = {}, {}
        seen = np.zeros((2, 2))
        np.add.at(seen, (bad[follows].astype(int), bad[follows + 1].astype(int)), 1)
        for _ in range(STEPS):
            p, pairs = chains.marginals(x @ weight, step)
            weight = _adam(weight, x.T @ (p - bad) / len(x) + 1e-4 * weight, states[0], 0.5)
            step = _adam(step, (pairs - seen) / len(x) + 1e-3 * step, states[1], 0.1)
        p, _ = chains.marginals(x @ weight, step)
        worst = np.zeros(n)
        np.maximum.at(worst, doc, p)
        bad = (quality[doc] == 0) & ((p > 0.5) | (p == worst[doc]))
    model = Model(weight, step, 1.0, 0.5, prior)
    mean = model.document_means(features, doc, size, n)
    has = ~np.isnan(mean)
    return Model(weight, step, *_scale(mean[has], quality[has]), prior)


def _scale(mean: np.ndarray, quality: np.ndarray) -> tuple[float, float]:
    """(slope, middle) of the logistic scale that puts THRESHOLD where the fewest labels are missed."""
    order = np.argsort(mean, kind="stable")
    m, q = mean[order], quality[order]
    missed = np.concatenate([[0], np.cumsum(q)]) + np.concatenate([np.cumsum((q == 0)[::-1])[::-1], [0]])
    best = np.flatnonzero(missed == missed.min())
    edges = np.concatenate([[0.0], m, [1.0]])
    gaps = (edges[best + 1] - edges[best])
    i = best[gaps.argmax()]
    cut = (edges[i] + edges[i + 1]) / 2
    slope = 12.0
    return slope, float(cut - np.log(THRESHOLD / (1 - THRESHOLD)) / slope)


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is never learned from: crc32 of its id as text leaves 2 by 4 (null: not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on at most TRAIN_DOCS documents with a label that are not held out; only their lines' features are collected."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS).select(F.col("doc_id").alias("_id"), "quality")
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))  # at most TRAIN_DOCS rows
    texts = texts.filter(F.length(F.regexp_replace("text", "[^\n]", "")) < MAX_LINES).select("doc_id", "quality", "text")

    def lines(batches):
        for batch in batches:
            for a, b, t in W.chunks(batch.column("text")):
                x, doc, size = line_features(t)
                cuts = np.searchsorted(doc, np.arange(b - a + 1))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id")[a:b], "quality": batch.column("quality")[a:b].cast(pa.int32()),
                    "x": [x[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], "size": [size[i:j].tobytes() for i, j in zip(cuts, cuts[1:])],
                })

    # Repeated rows of a document add nothing; sorted, so that the fit doesn't depend on the tasks' order.
    found = texts.mapInArrow(lines, "doc_id long, quality int, x binary, size binary").toPandas()
    found = found.sort_values(["doc_id", "x"]).drop_duplicates(["doc_id"], ignore_index=True) if len(found) else found
    xs = [np.frombuffer(x, np.float32).reshape(-1, OWN + 2 * NEAR) for x in found["x"]]
    if not xs:
        return fit(np.zeros((0, OWN + 2 * NEAR), np.float32), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    doc = np.repeat(np.arange(len(xs)), [len(x) for x in xs])
    return fit(np.concatenate(xs), doc, np.concatenate([np.frombuffer(s) for s in found["size"]]), found["quality"].to_numpy().astype(float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1, higher: better) and predicted (1 from THRESHOLD on).

    Only the text is an input. A text without a word, null or empty, scores the share of good labels in the
    sample. Without labels of both kinds that share (0.5 without any) is every score. Repeated rows score alike;
    an empty table gives an empty result. docs' columns stay, whatever their names, except those named like the added.
    """

    @arrow_udf(T.DoubleType())
    def scored(text: pa.Array) -> pa.Array:
        parts = [model.scores(*line_features(t), b - a) for a, b, t in W.chunks(text)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    hidden, show = hide(docs, ("text",), ("score", "predicted"), scored("text").alias("_pl_score"))
    return show(hidden, F.col("_pl_score").alias("score"), (F.col("_pl_score") >= THRESHOLD).cast("int").alias("predicted"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return score(docs, train(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
