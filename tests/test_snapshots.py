"""A log of versions against a plain dictionary: late rows, marks of deletion, replays, compaction, earlier versions, streams."""

import random

import pytest
from pyspark.sql import functions as F

from pointloom.streaming import snapshots

SCHEMA = "k long, t long, gone boolean, v string"


def plain(batches):
    table = {}
    for rows in batches:
        for k, t, gone, v in rows:
            if k not in table or t >= table[k][1]:
                table[k] = (k, t, gone, v)
    return sorted((r for r in table.values() if not r[2]), key=str)


@pytest.fixture(scope="module")
def batches():
    r, t = random.Random(6), list(range(400))
    r.shuffle(t)
    rows = [(r.choice([None, *range(25)]), x, r.random() < 0.2, f"v{x}") for x in t]
    return [rows[i : i + 80] for i in range(0, 400, 80)]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_versions(spark, tmp_path, batches):
    log = snapshots.SnapshotLog(spark, str(tmp_path / "log"), SCHEMA, "k", ["t"], F.col("gone"), buckets=5)
    assert log.versions() == [] and log.read().count() == 0
    for i, b in enumerate(batches):
        log.commit(spark.createDataFrame(b, SCHEMA), i)
        log.commit(spark.createDataFrame(b, SCHEMA), i)  # a replay
        if i == 2:
            assert log.compact(least=2) and log.compact(least=2) == []
    assert log.versions() == [0, 1, 2, 3, 4]
    for i in range(5):
        assert rows_of(log.read(i)) == plain(batches[: i + 1])
    entries = log.manifest()
    assert sum(e["base"] for e in entries) == 5 and {e["version"] for e in entries if not e["base"]} == {3, 4}
    new = log.restore(1)
    assert new == 5 and rows_of(log.read()) == plain(batches[:2])
    log.commit(spark.createDataFrame(batches[4], SCHEMA), 6)
    assert rows_of(log.read()) == plain([*batches[:2], batches[4]]) and rows_of(log.read(4)) == plain(batches)
    log.commit(spark.createDataFrame([], SCHEMA), 7)
    assert rows_of(log.read()) == rows_of(log.read(6))
    with pytest.raises(ValueError, match="no version 99"):
        log.read(99)


def test_streams(spark, tmp_path, batches):
    log = snapshots.SnapshotLog(spark, str(tmp_path / "log"), SCHEMA, "k", ["t"], F.col("gone"), buckets=3)
    for i, b in enumerate(batches):
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if i in (1, 4):  # two starts on one checkpoint
            updates = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            snapshots.upsert_stream(updates, log, str(tmp_path / "checkpoint"), compact_every=2).start().awaitTermination()
    assert rows_of(log.read()) == plain(batches)
    assert len(log.versions()) == 5
