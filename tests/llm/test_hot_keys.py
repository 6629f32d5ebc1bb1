"""Joins of rows with an aggregate by their own key: Spark splits the rows of a hot key."""

import pytest
from pyspark.sql import functions as F

from pointloom.llm import components, exact_dedup, ngram_join

SMALL = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def adaptive(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def rows_with_a_hot_key(spark, tmp_path, hot, other):
    path = str(tmp_path / "rows")
    n = F.col("id")
    spark.range(60000, numPartitions=6).select(n.alias("doc_id"), F.when(n < 50000, hot).otherwise(other(n)).alias("text")).write.parquet(path)
    return spark.read.parquet(path)


def test_exact_duplicates(adaptive, tmp_path):
    docs = rows_with_a_hot_key(adaptive, tmp_path, F.lit("one text"), lambda n: F.concat(F.lit("t"), (n % 5000).cast("string")))
    out = exact_dedup.exact_duplicates(docs)
    assert "skew=true" in plan_of(out)
    assert out.filter("group_size = 50000").count() == 50000


def test_least_of_a_hub(adaptive, tmp_path):
    path = str(tmp_path / "edges")
    n = F.col("id")
    adaptive.range(60000, numPartitions=6).select(F.when(n < 50000, 7).otherwise(n).alias("u"), (n * 3 + 11).alias("v")).write.parquet(path)
    out = components._least(adaptive.read.parquet(path))
    assert "skew=true" in plan_of(out)
    assert out.filter("u = 7").select("m").distinct().collect()[0][0] == 7


def test_ngrams_across_components(adaptive, tmp_path):
    path = str(tmp_path / "grams")
    n = F.col("id")
    adaptive.range(60000, numPartitions=6).select(F.when(n < 50000, 7).otherwise(n % 900 + 100).alias("gram"), (n % 500).alias("label"), n.alias("class")).write.parquet(path)
    out = ngram_join._across(adaptive.read.parquet(path))
    assert "skew=true" in plan_of(out) and out.count() == 60000
