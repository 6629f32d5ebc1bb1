"""The particles' state machine: batch against the plain step, and the stream against the batch."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pointloom.operators import life
from pointloom.streaming import life as stream

SHORT = life.Rules(clone_rest=3, split_rest=4, probation=4)
SCHEMA = "gid long, t long, state string, fresh boolean, clone boolean, split boolean, prune boolean, opacity double, views int"


def refreshes(seed=1, keys=7, most=120):
    r = random.Random(seed)
    rows = []
    for k in range(keys):
        state = None
        for t in range(r.randint(1, most)):
            state = r.choice([*life.LIVES, None]) if r.random() < 0.25 else state
            rows.append((k or None, t, state, r.random() < 0.02, *[r.random() < 0.7 if r.random() < 0.9 else None for _ in range(3)], r.choice([0.001, 0.5, None]), r.choice([0, 1, 5, None])))
    return rows


def plain(rows, rules):
    out, memory = {}, defaultdict(lambda: life.BLANK)
    for k, t, *row in sorted(rows, key=lambda x: (str(x[0]), x[1])):
        memory[k], out[k, t] = life.step(memory[k], tuple(row), rules)
    return out


@pytest.mark.parametrize("rules, block", [(life.Rules(), 512), (SHORT, 512), (SHORT, 9)])
def test_fold_is_the_plain_step(spark, rules, block):
    rows = refreshes()
    got = life.fold(spark.createDataFrame(rows, SCHEMA), "gid", ["t"], rules, block).collect()
    want = plain(rows, rules)
    assert len(got) == len(want)
    for r in got:
        w = want[r["gid"], r["t"]]
        assert (r["life"], r["dwell"], r["action"], r["rest"]) == w[:4] and abs(r["truncation"] - w[4]) < 1e-9
    assert {w[2] for w in want.values()} >= {"prune", "clone"} and {w[0] for w in want.values()} >= {"quarantine", "probation", "repair"}


def test_step_by_step():
    memory, lives = life.BLANK, []
    for _ in range(3):
        memory, out = life.step(memory, ("abstain", False, True, False, True, 0.001, 0), SHORT)
        lives.append(out[0])
    assert lives == ["normal", "normal", "quarantine"]  # committed at the third
    actions = []
    for _ in range(9):
        memory, out = life.step(memory, ("abstain", False, True, False, True, 0.001, 0), SHORT)
        actions.append(out[2])
    assert actions.index("prune") == 7  # five rounds of dwell, then five events in a row


def test_fold_of_nothing(spark):
    assert life.fold(spark.createDataFrame([], SCHEMA), "gid", ["t"]).count() == 0


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, stream.PROVIDER)
    yield spark
    spark.conf.set(name, before) if before else spark.conf.unset(name)


def test_stream_gives_the_rows_of_the_batch(rocks, tmp_path):
    rows = refreshes(3, 5, 60)
    df = rocks.createDataFrame(rows, SCHEMA)
    folder = str(tmp_path / "in")
    for i, (a, b) in enumerate(((0, 10), (10, 35), (35, 60))):
        df.filter((F.col("t") >= a) & (F.col("t") < b)).coalesce(1).write.parquet(f"{folder}/part={i}")
        if i == 1:  # two starts on one checkpoint
            run(rocks, folder, tmp_path)
    run(rocks, folder, tmp_path)
    got = rocks.read.parquet(str(tmp_path / "out")).collect()
    want = plain(rows, SHORT)
    assert len(got) == len(want)
    for r in got:
        w = want[r["gid"], r["t"]]
        assert (r["life"], r["dwell"], r["action"], r["rest"]) == w[:4] and abs(r["truncation"] - w[4]) < 1e-9


def run(spark, folder, tmp_path):
    events = spark.readStream.schema(SCHEMA).option("latestFirst", "false").option("maxFilesPerTrigger", 1).parquet(folder + "/*")
    q = stream.lives(events, "gid", ["t"], SHORT).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
