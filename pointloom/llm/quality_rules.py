"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source.

Every metric is an integer per mille. A sketch is a log-linear histogram: values under 32 have buckets of
their own, larger ones eight buckets to each power of two, so a quantile is within an eighth of its value.
Sketches merge by adding counts: the partial aggregates of tasks merge into those of (lang, source), these
into those of a language and of the whole corpus. They hold what the base rules pass. A group's limit is the mean of its own and of its language's, weighted
by its size against PRIOR, and a language's likewise of its own and of the corpus's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from pointloom.llm import words as W
from pointloom.llm.names import hide
from pointloom.llm.storage import materialise

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Metric: the least slack. A document fails where its value is over q95 + slack + TAIL * (q95 - q75) of its group, or over
#: q25 + GUARD * slack + LOWER * (q25 - q05), which junk moves only where it is three quarters of the group.
METRICS = {"symbol_pm": 20, "upper_pm": 40, "dup_line_pm": 150, "repeat_pm": 90}
TAIL = 2
GUARD = 2
LOWER = 12
#: A group's limit counts as its documents and its language's as so many, and a language's as its documents and the corpus's
#: as so many, so small groups follow what is around them.
PRIOR = 50

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines")

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeated(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (doc, key): whether it occurs twice or more in the doc, and whether it is the first."""
    mixed = W.mix(keys + docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(mixed, kind="stable")
    s = mixed[order]
    same = s[1:] == s[:-1]
    again, first = np.zeros(len(s), bool), np.ones(len(s), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    first[order[1:]] = ~same
    return again, first


def chunk_features(t: W.Texts) -> list[np.ndarray]:
    """The columns of FEATURES for each text."""
    data, bounds, doc = t.data, t.bounds, t.word_doc()
    points = _sums((data & 0xC0) != 0x80, bounds) - _sums(W.SPACE[data], bounds)
    upper = _sums((data >= 65) & (data <= 90), bounds)
    h = t.hashes()
    # lines
    newline = np.flatnonzero(data == 10)
    starts = np.concatenate([bounds[:-1], newline + 1])
    starts.sort(kind="stable")
    line_doc = np.searchsorted(bounds, starts, "right") - 1
    line_doc = np.minimum(line_doc, len(bounds) - 2)
    ends = np.append(starts[1:], len(data))
    ends = np.where((ends > starts) & np.isin(ends - 1, newline), ends - 1, ends)
    with_word = np.searchsorted(t.starts, ends) > np.searchsorted(t.starts, starts)
    starts, ends, line_doc = starts[with_word], ends[with_word], line_doc[with_word]
    _, first = _repeated(W.span_hashes(data, starts, ends), line_doc)
    n = len(bounds) - 1
    dup_lines = np.bincount(line_doc[~first], minlength=n)
    lines = np.bincount(line_doc, minlength=n)
    # windows
    covered = np.zeros(len(doc) + 1, np.int64)
    ok = np.flatnonzero(W.inside_one_text(t, 5))
    if len(ok):
        again, _ = _repeated(W.window_hashes(h, 5)[ok], doc[ok])
        at = ok[again]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + 5, -1)
    repeat = _sums(np.cumsum(covered)[:-1] > 0, t.first)
    return [t.n_words, points, _sums(SYMBOL[data], bounds), dup_lines, repeat, upper, lines]


@arrow_udf(T.StructType([T.StructField(x, T.LongType()) for x in FEATURES]))
def text_features(text: pa.Array) -> pa.Array:
    parts = [chunk_features(t) for _, _, t in W.chunks(text)]
    return pa.StructArray.from_arrays([pa.array(np.concatenate([p[i] for p in parts]).astype(np.int64) if parts else [], pa.int64()) for i in range(len(FEATURES))], list(FEATURES))


def _per_mille(a: str, b: str) -> Column:
    return F.expr(f"{a} * 1000 div greatest({b}, 1)")


def with_features(docs: DataFrame) -> DataFrame:
    """docs with `_pl_f`, the struct of FEATURES, `_pl_failed` by the base rules, and `_pl_m`, the array of METRICS' values."""
    out = docs.withColumn("_pl_f", text_features("text"))
    failed = (F.col("_pl_f.n_words") < MIN_WORDS) | (100 * F.col("_pl_f.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_pl_f.n_words"))
    metrics = F.array(_per_mille("_pl_f.n_symbols", "_pl_f.word_chars"), _per_mille("_pl_f.n_upper", "_pl_f.word_chars"), _per_mille("_pl_f.n_dup_lines", "_pl_f.n_lines"), _per_mille("_pl_f.n_repeat_words", "_pl_f.n_words"))
    return out.withColumns({"_pl_failed": failed, "_pl_m": metrics})


def bucket(v: Column) -> Column:
    """The sketch's bucket of an integer >= 0."""
    log = F.length(F.bin(v)) - 1
    return F.when(v < 32, v).otherwise(32 + (log - 5) * 8 + F.call_function("shiftright", v, log - 3).bitwiseAND(7)).cast("int")


def bucket_value(b: Column) -> Column:
    """The bucket's least value."""
    return F.when(b < 32, b).otherwise(F.call_function("shiftleft", (8 + (b - 32) % 8).cast("long"), F.floor((b - 32) / 8).cast("int") + 2))


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n): the sketches of all groups."""
    each = measured.select("lang", "source", F.posexplode("_pl_m").alias("metric", "value"))
    return each.groupBy("lang", "source", "metric", bucket(F.col("value")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    """Coarser sketches: the counts of finer ones added up."""
    return sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, *keys: str) -> DataFrame:
    """(keys, metric, size, fence) of each sketch."""
    whole = Window.partitionBy(*keys, "metric")
    run = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    cut = sketch.withColumns({"size": F.sum("n").over(whole), "upto": F.sum("n").over(run)})
    quantiles = [F.min(F.when(F.col("upto") * 100 >= F.col("size") * q, bucket_value(F.col("bucket")))).alias(f"q{q:02}") for q in (5, 25, 75, 95)]
    q = cut.groupBy(*keys, "metric").agg(F.max("size").alias("size"), *quantiles)
    slack = F.element_at(F.array(*[F.lit(x) for x in METRICS.values()]), F.col("metric") + 1)
    upper = F.col("q95") + slack + TAIL * (F.col("q95") - F.col("q75"))
    lower = F.col("q25") + GUARD * slack + LOWER * (F.col("q25") - F.col("q05"))
    return q.select(*keys, "metric", "size", F.least(upper, lower).alias("fence"))


def thresholds(measured: DataFrame) -> DataFrame:
    """(lang, source, fences): for each group an array of limits in METRICS' order."""
    fine = sketches(measured)
    lang = merged(fine, "lang")
    one = fences(fine, "lang", "source")
    two = fences(lang, "lang").select(F.col("lang").alias("_l"), F.col("metric").alias("_m2"), F.col("size").alias("size2"), F.col("fence").alias("fence2"))
    all_ = fences(merged(lang)).select(F.col("metric").alias("_m3"), F.col("fence").alias("fence3"))
    joined = one.join(two, F.col("lang").eqNullSafe(F.col("_l")) & (F.col("metric") == F.col("_m2"))).join(all_, F.col("metric") == F.col("_m3"))
    around = F.expr(f"(size2 * fence2 + {PRIOR} * fence3) div (size2 + {PRIOR})")
    joined = joined.withColumn("around", around)
    best = F.expr(f"(size * fence + {PRIOR} * around) div (size + {PRIOR})")
    listed = F.sort_array(F.collect_list(F.struct("metric", best.alias("fence"))))
    return joined.groupBy("lang", "source").agg(F.transform(listed, lambda x: x["fence"]).alias("_pl_fences"))


def _judged(docs: DataFrame, text: bool) -> DataFrame:
    """docs with with_features' columns and `_pl_kept`. Texts are measured once; the rows are written with what was found."""
    measured = materialise(with_features(docs) if text else with_features(docs).drop("text"), "measured")
    limits = thresholds(measured.filter(~F.col("_pl_failed")).select("lang", "source", "_pl_m")).withColumnsRenamed({"lang": "_pl_lang", "source": "_pl_source"})
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("_pl_lang")) & F.col("source").eqNullSafe(F.col("_pl_source")), "left")
    over = F.coalesce(F.exists(F.arrays_zip("_pl_m", "_pl_fences"), lambda x: x["_pl_m"] > x["_pl_fences"]), F.lit(False))
    return joined.withColumn("_pl_kept", ~F.col("_pl_failed") & ~over)


USED = "text", "lang", "source"


def judge(docs: DataFrame, text: bool = True) -> DataFrame:
    """docs with the columns of FEATURES, base_failed and kept, and without the text if that isn't asked for.

    A null text has no words and fails. Documents with a null lang or source form groups of their own. A
    document is kept if its base rules hold and no metric is over its group's limit. Equal rows get equal
    verdicts. An empty table gives an empty result. docs' columns stay, whatever their names, except those named like
    the added.
    """
    hidden, show = hide(docs, USED, (*FEATURES, "base_failed", "kept"))
    found = _judged(hidden, text)
    return show(found, "_pl_f.*", F.col("_pl_failed").alias("base_failed"), F.col("_pl_kept").alias("kept"), less=[] if text else ["text"])


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with docs' columns as they are."""
    hidden, show = hide(docs, USED)
    return show(_judged(hidden, True).filter("_pl_kept"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return judge(docs, text=False).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
