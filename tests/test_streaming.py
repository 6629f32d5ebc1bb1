from pyspark.sql import functions as F

from pointloom.operators import state
from pointloom.streaming import jobs


def rows(spark):
    data = [(i % 3, i, ("a", "b")[(i // 4) % 2], float(i % 7)) for i in range(40)]
    return spark.createDataFrame(data, "k int, t int, s string, v double")


def drain(spark, stream, name, mode="update"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def source(spark, df, folder):
    """Two files, read one after the other."""
    for lo, hi in ((0, 20), (20, 40)):
        df.filter(F.col("t").between(lo, hi - 1)).coalesce(1).write.mode("append").parquet(folder)
    return jobs.read_events(spark, folder, df.schema, files_per_trigger=2)


def test_streamed_folds_are_the_batch_folds(spark, tmp_path):
    df = rows(spark)
    stream = source(spark, df, f"{tmp_path}/in")
    got = {r["k"]: r["ema"] for r in drain(spark, jobs.ema(stream, "k", ["t"], "v"), "ema").collect()}
    want = {r["k"]: r["ema"] for r in state.ema(df, "k", ["t"], "v").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    got = {r["k"]: r["fired"] for r in drain(spark, jobs.cooldown(stream.withColumn("f", F.col("v") > 3), "k", ["t"], "f", 2), "cool").collect()}
    want = {r["k"]: r["fired"] for r in state.cooldown(df, "k", ["t"], F.col("v") > 3, 2).collect()}
    assert got == want


def test_windows_drop_late_rows(spark, tmp_path):
    df = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP '2024-01-01 00:01:00', 1.0), (1, TIMESTAMP '2024-01-01 00:02:00', 2.0), (1, TIMESTAMP '2024-01-01 02:00:00', 4.0) AS t(k, ts, v)")
    for row in df.orderBy("ts").collect():  # a file each, in the order of time: files are read by age
        spark.createDataFrame([row], df.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/w")
    stream = jobs.read_events(spark, f"{tmp_path}/w", df.schema)
    got = drain(spark, jobs.windowed(stream, "ts", "k", "v"), "win", "append").collect()
    assert [(r["n"], r["total"]) for r in got] == [(2, 3.0)]
