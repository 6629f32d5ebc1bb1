"""Language of texts by nearest centroids: normalised TF-IDF vectors of byte n-grams against clustered centroids of each language."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from pointloom.llm.names import hide
from pointloom.llm.words import utf8

#: Lengths of n-grams in bytes, and slots that they are hashed to.
ORDERS = (1, 2, 3)
SLOT_BITS = 14
SLOTS = 1 << SLOT_BITS
#: The centroids are fitted on about so many texts in all, and at least and at most so many of a language: those whose hashes
#: begin with the most zeros. Document frequencies are those of all texts that may be learned from.
SAMPLE_TEXTS, LEAST, MOST = 4000, 64, 1000
CENTROIDS, ROUNDS = 4, 10
#: Share of a centroid's own texts below whose cosine others count as too far, and how much further they must be.
REJECT, SLACK = 0.005, 0.05
#: Cosines that differ by so much have odds of e to 1.
TEMPERATURE = 0.05
CHUNK_BYTES = 1 << 19
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[np.arange(97, 123)] = True
_LETTER[128:] = True


def _stream(data: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The letters' bytes with one space for each run of others, and the text that each is of."""
    letter = _LETTER[data]
    keep = letter.copy()
    keep[1:] |= letter[:-1] | (doc[1:] != doc[:-1])
    return np.where(letter, data, 32)[keep].astype(np.uint32), doc[keep]


def _add_grams(counts: np.ndarray, stream: np.ndarray, doc: np.ndarray) -> None:
    """Add to counts (texts x SLOTS) the n-grams that begin in the first CHUNK_BYTES, and so on, of the stream."""
    flat = counts.reshape(-1)
    for at in range(0, len(stream), CHUNK_BYTES):
        x, d = stream[at : at + CHUNK_BYTES + ORDERS[-1] - 1], doc[at : at + CHUNK_BYTES + ORDERS[-1] - 1]
        for n in ORDERS:
            size = min(CHUNK_BYTES, len(x) - n + 1)
            if size <= 0:
                continue
            code = np.full(size, n, np.uint32)
            for i in range(n):
                code = (code << np.uint32(8)) ^ x[i : i + size]
            slot = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOT_BITS)
            inside = d[:size] == d[n - 1 : n - 1 + size]
            flat += np.bincount((d[:size].astype(np.int64) * SLOTS + slot)[inside], minlength=len(flat)).astype(np.float32)


def gram_counts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, row after the last, counts of their n-grams): whole texts, about CHUNK_BYTES at once."""
    if not len(column):
        return
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    data, bounds = utf8(pc.utf8_lower(column))
    at = 0
    while at < len(bounds) - 1:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK_BYTES, "right")) - 1)
        to = min(to, at + 512)
        counts = np.zeros((to - at, SLOTS), np.float32)
        _add_grams(counts, *_stream(data[bounds[at] : bounds[to]], np.repeat(np.arange(to - at, dtype=np.int32), np.diff(bounds[at : to + 1]))))
        yield at, to, counts
        at = to


def weighed(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors; roots of counts, so that a text twice over has the same vector. No n-grams: zeros."""
    v = np.sqrt(counts) * idf
    norm = np.sqrt(np.einsum("ij,ij->i", v, v))
    return v / np.where(norm > 0, norm, 1)[:, None]


@dataclass(frozen=True)
class Model:
    """idf (SLOTS), centroids (unit rows), the number in `languages` of each centroid's, and its least cosine."""

    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    language: np.ndarray
    least: np.ndarray

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the language, its share among the languages' best cosines, whether its centroid is too far)."""
        cosines = weighed(counts, self.idf) @ self.centroids.T
        best = np.full((len(counts), len(self.languages)), -1.0)
        for k, n in enumerate(self.language):
            best[:, n] = np.maximum(best[:, n], cosines[:, k])
        found = best.argmax(1)
        odds = np.exp((best - best.max(1, keepdims=True)) / TEMPERATURE)
        return found, odds.max(1) / odds.sum(1), cosines.max(1) < self.least[cosines.argmax(1)]


def cluster(v: np.ndarray, k: int = CENTROIDS) -> tuple[np.ndarray, np.ndarray]:
    """(at most k unit centroids of unit rows, each row's): spherical k-means, begun with the rows farthest apart."""
    first = v.mean(0)
    centres = [v[(v @ first).argmin()]]
    while len(centres) < min(k, len(v)):
        nearest = np.max(v @ np.stack(centres).T, 1)
        if nearest.min() > 1 - 1e-6:
            break
        centres.append(v[nearest.argmin()])
    c = np.stack(centres)
    for _ in range(ROUNDS):
        own = (v @ c.T).argmax(1)
        sums = np.stack([v[own == i].sum(0) if (own == i).any() else c[i] for i in range(len(c))])
        c = sums / np.maximum(np.sqrt((sums**2).sum(1, keepdims=True)), 1e-12)
    own = (v @ c.T).argmax(1)
    used = np.unique(own)
    return c[used], np.searchsorted(used, own)


def fit(counts: Iterable[tuple[str, np.ndarray]], idf: np.ndarray) -> Model:
    """A model from some texts' n-gram counts of every language, which come by name."""
    centroids, languages, language, least = [np.zeros((0, SLOTS), np.float32)], [], [], []
    for n, (lang, rows) in enumerate(counts):
        languages.append(lang)
        v = weighed(rows, idf)
        c, own = cluster(v)
        near = (v * c[own]).sum(1)
        centroids.append(c)
        language += [n] * len(c)
        least += [float(np.quantile(near[own == i], REJECT)) - SLACK for i in range(len(c))]
    return Model(languages, idf, np.concatenate(centroids).astype(np.float32), np.array(language, int), np.array(least))


def held_out(doc_id: Column) -> Column:
    """Whether a document is never learned from: crc32 of its id as text leaves 0 by 5 (null: not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _frequencies(texts: DataFrame) -> np.ndarray:
    """In how many texts each slot's n-grams are, and behind them the number of texts; a row a slot reaches the driver."""

    def counted(batches):
        total = np.zeros(SLOTS + 1, np.int64)
        for b in batches:
            for _, _, counts in gram_counts(b.column(0)):
                total[:SLOTS] += np.count_nonzero(counts, axis=0)
                total[SLOTS] += len(counts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    out = np.zeros(SLOTS + 1)
    for r in texts.mapInArrow(counted, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        out[r["slot"]] = r["n"]
    return out


def _sample(known: DataFrame) -> DataFrame:
    """(lang, hash, text) of about SAMPLE_TEXTS distinct texts, those of each language whose hashes begin with the most zeros.

    How many distinct hashes of a language begin with how many zeros is estimated by sketches; those counts (64 a language at
    most) are what reaches the driver.
    """
    hashed = known.select("lang", "text", F.shiftrightunsigned(F.xxhash64("text"), 1).alias("hash"))
    hashed = hashed.withColumn("zeros", 63 - F.length(F.bin("hash")))
    counts = hashed.groupBy("lang", "zeros").agg(F.approx_count_distinct("hash").alias("n")).toPandas()
    if not len(counts):
        return hashed.limit(0)
    share = min(MOST, max(LEAST, SAMPLE_TEXTS // counts["lang"].nunique()))
    cuts = []
    for lang, rows in counts.sort_values("zeros", ascending=False).groupby("lang"):
        inside = rows["zeros"][rows["n"].cumsum() <= share]
        cuts.append((lang, int(inside.min() if len(inside) else rows["zeros"].max())))
    cut = F.broadcast(hashed.sparkSession.createDataFrame(cuts, "_lang string, _least int"))  # a row a language, from the driver
    few = hashed.join(cut, (F.col("lang") == F.col("_lang")) & (F.col("zeros") >= F.col("_least")))
    return few.groupBy("lang", "hash").agg(F.min("text").alias("text"))


def train(docs: DataFrame) -> Model:
    """The model of docs' texts and their lang, where it isn't null and the document isn't held out.

    Document frequencies count all of these; the centroids are fitted in the driver on the n-gram counts of a bounded sample
    (SAMPLE_TEXTS; a language has LEAST at least, or all of its texts). Without any there is no language, and UNKNOWN is the answer.
    """
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & has_letter(F.col("text")) & ~held_out(F.col("doc_id")))
    total = _frequencies(known.select("text"))
    idf = (np.log((1 + total[SLOTS]) / (1 + total[:SLOTS])) + 1).astype(np.float32)

    def vectors(batches):
        for b in batches:
            for at, to, counts in gram_counts(b.column("text")):
                slots = [np.flatnonzero(c).astype(np.int32) for c in counts]
                yield pa.RecordBatch.from_pydict({
                    "lang": b.column("lang")[at:to], "hash": b.column("hash")[at:to],
                    "slots": [s.tobytes() for s in slots], "counts": [c[s].tobytes() for c, s in zip(counts, slots, strict=True)],
                })

    rows = _sample(known).select("lang", "hash", "text").mapInArrow(vectors, "lang string, hash long, slots binary, counts binary").toPandas()

    def by_language():
        for lang, group in rows.groupby("lang"):
            group = group.sort_values("hash")[:MOST]
            counts = np.zeros((len(group), SLOTS), np.float32)
            for i, (s, c) in enumerate(zip(group["slots"], group["counts"], strict=True)):
                counts[i, np.frombuffer(s, np.int32)] = np.frombuffer(c, np.float32)
            yield lang, counts

    return fit(by_language(), idf)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score (0 to 1: the language's share among the languages' nearest centroids) and rejected.

    Only the whole text is an input. lang_pred is a learned language, `und` (score 0, rejected) for a null text, one without a
    letter, and where the model has no language. rejected says that the nearest centroid is further than nearly all of its
    own texts, so the text is like none of the languages; lang_pred is then the nearest all the same. Repeated rows are
    treated alike; ties go to the language that is first by name. An empty table gives an empty result. docs' columns stay,
    whatever their names, except those named like the added ones.
    """
    languages = np.array([*model.languages, UNKNOWN], object)

    @arrow_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("far", T.BooleanType())]))
    def found(text: pa.Array) -> pa.Array:
        parts = [model.predict(counts) for _, _, counts in gram_counts(text)]
        number, score, far = (np.concatenate(x) if parts else np.zeros(0, kind) for x, kind in zip(zip(*parts, strict=True) if parts else ((), (), ()), (int, float, bool), strict=True))
        return pa.StructArray.from_arrays([pa.array(languages[number].tolist(), pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_())], ["lang", "score", "far"])

    known = has_letter(F.col("text")) if model.languages else F.lit(False)
    none = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(True).alias("far"))
    added = ("lang_pred", "score", "rejected")
    hidden, show = hide(docs, ("text",), added, known.alias("_pl_known"))
    if model.languages:
        hidden = hidden.withColumn("_pl_found", found("text"))
        hidden = hidden.withColumn("_pl_found", F.when(F.col("_pl_known"), F.col("_pl_found")).otherwise(none))
    else:
        hidden = hidden.withColumn("_pl_found", none)
    return show(hidden, *[F.col(f"_pl_found.{x}").alias(a) for x, a in zip(("lang", "score", "far"), added, strict=True)])


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
