"""documents to packed training sequences: quality rules, exact dedup, n-gram Jaccard join, mixing, packing.

Each stage works on all that its predecessor kept; between stages the rows are written as Parquet and read
again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from pointloom.llm import exact_dedup, mixing, ngram_join, packing, quality_rules
from pointloom.llm.storage import drop_paths, fresh_path, in_use


def _cleaned(stage):
    """The stage, which first deletes what the stage before wrote on its way, unless docs still read it.

    What the last stage of a run wrote stays for those who read its result: the first stage of the next run forgets it, and it
    goes with the driver.
    """

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles()
        if stage.__name__ != STAGES[0][1].__name__:
            drop_paths(spark, [p for p in _LEFT if not any(f"{p.rpartition('/')[2]}/" in f for f in read)])
        before = set(in_use())
        out = stage(spark, docs, sf_dir)
        _LEFT[:] = [p for p in in_use() if p not in before]
        return out

    return run_stage


#: Paths that the last stage wrote on its way.
_LEFT: list[str] = []


@_cleaned
def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the adaptive quality rules keep."""
    return quality_rules.keep_good(docs)


@_cleaned
def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return exact_dedup.drop_duplicates(docs)


@_cleaned
def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five words, 0.8) the row with the least doc_id; texts without words stay."""
    return ngram_join.drop_near_duplicates(docs)


@_cleaned
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix: the n-th file holds the n-th part of it."""
    return mixing.interleave(docs)


@_cleaned
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per sequence, those of one length in the order of the documents' files."""
    return packing.pack_in_order(docs)


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_join", ngram_join_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Adaptive thresholds, Jaccard components and token ids are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = fresh_path(spark, name)
        out.write.parquet(path)
        drop_paths(spark, last)
        docs, last = spark.read.parquet(path), [path]
