"""Cases of the third round's findings, on small tables."""

from datetime import datetime

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pointloom.operators import graph, metric, neighbors, visibility


def write(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_unprojected_keeps_depths_without_a_point(spark, tmp_path):
    sf = write(spark, tmp_path, "events", [(33, 25, 0.0), (34, 26, 2.0)], "event_id long, user_id long, value double")
    got = {r["event_id"]: (r["x"], r["y"], r["z"]) for r in entry.queries()["unprojected"](spark, sf).collect()}
    assert got == {33: (None, None, 0.0), 34: (0.008, 0.01, 2.0)}


@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_few_pairs_are_measured_in_full(spark, monkeypatch, offset):
    r = np.random.default_rng(1)
    v = r.normal(size=(600, 8)) + offset
    v[10] = v[11]
    a = {"id": np.arange(600), "v": v}
    measured, plain = [], metric.of_pairs
    monkeypatch.setattr(metric, "of_pairs", lambda f, x, y, i, j: measured.append(len(i)) or plain(f, x, y, i, j))
    i, j, d = metric.k_nearest(dict(a), dict(a), "v", 3, True)
    whole = metric.squared(v, v)
    np.fill_diagonal(whole, np.inf)
    assert [(x, y) for x, y in zip(i, j)] == [(x, int(y)) for x in range(600) for y in np.argsort(whole[x], kind="stable")[:3]]
    assert np.array_equal(d, whole[i, j]) and sum(measured) < 600 * 12


def test_queries_go_to_tiles_instead_of_cells():
    p = np.random.default_rng(2).normal(size=(200, 5))
    sizes = np.full(200, 1000)
    tile = metric.tiles(p, sizes)
    held = np.bincount(tile, weights=sizes)
    assert held.max() <= metric.PIECE_ROWS and 12 < len(held) < 40


def test_nearest_of_a_dense_cloud(spark, monkeypatch):
    def pairs(*_):
        raise AssertionError("pairs of all points within a radius")

    monkeypatch.setattr(neighbors, "radius_pairs", pairs)
    p = np.round(np.random.default_rng(3).uniform(size=(400, 3)) * 0.3, 6)
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "pid long, x double, y double, z double")
    even, odd = df.filter("pid % 2 = 0"), df.filter("pid % 2 = 1")
    near = neighbors.nearest_within(even, odd, 0.5)
    got = {r["a_id"]: r["b_id"] for r in near.collect()}
    d = metric.squared(p[::2], p[1::2])
    assert got == {2 * i: 2 * int(j) + 1 for i, j in enumerate(d.argmin(1))}
    whole = metric.squared(p, p)
    np.fill_diagonal(whole, np.inf)
    got = {(r["a_id"], r["b_id"], r["rank"]) for r in neighbors.knn_grid(df, 4, 0.5).collect()}
    assert got == {(i, int(j), n + 1) for i in range(400) for n, j in enumerate(np.argsort(whole[i], kind="stable")[:4])}


def test_thinning_in_lots(spark, monkeypatch):
    p = np.round(np.random.default_rng(4).normal(size=(300, 3)) * 0.3, 6)
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "pid long, x double, y double, z double")
    monkeypatch.setattr(graph, "THIN_FIRST", 16)
    monkeypatch.setattr(graph, "THIN_PAIRS", 40)
    most, pairs = [], graph.radius_pairs
    monkeypatch.setattr(graph, "radius_pairs", lambda a, b, *x: most.append(max(a.count(), b.count()) if a is b else 0) or pairs(a, b, *x))
    keep = []
    for i in range(300):
        if all(((p[i] - p[j]) ** 2).sum() > 0.09 for j in keep):
            keep.append(i)
    assert sorted(r["pid"] for r in graph.greedy_thin(df, 0.3).collect()) == keep
    assert max(most) < 100


def test_sightings_are_counted_without_rows_of_pairs(spark, monkeypatch):
    r = np.random.default_rng(5)
    turn = [[float(x) for x in (np.cos(a), 0, -np.sin(a), 0, 1, 0, np.sin(a), 0, np.cos(a))] for a in range(12)]
    fixed = [6.0, 6.0, 3.5, 2.5, 8.0, 6.0]
    cameras = spark.createDataFrame([(i, m, [0.0, 0.0, 3.0], *fixed) for i, m in enumerate(turn)], "view long, r array<double>, t array<double>, fx double, fy double, cx double, cy double, width double, height double")
    odd = {0: None, 1: 0.0, 2: float("nan"), 3: float("inf")}
    rows = [(i, x, y, odd.get(int(k), float(k) / 4)) for i in range(12) for x in range(8) for y in range(6) if (k := r.integers(0, 20)) != 19]
    depths = spark.createDataFrame(rows, "view long, x long, y long, depth double")
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(r.uniform(-1, 1, size=(200, 3)))], "pid long, x double, y double, z double")
    want = {x["pid"]: x["n"] for x in visibility.sightings(points, cameras, depths, 0.7).groupBy("pid").count().withColumnRenamed("count", "n").collect()}
    monkeypatch.setattr(visibility, "VIEWS", 5)
    monkeypatch.setattr(visibility, "POINTS", 7)

    def pairs(*_):
        raise AssertionError("a row for each point and view")

    with monkeypatch.context() as m:
        m.setattr(visibility, "sightings", pairs)
        got = {x["pid"]: x["views"] for x in visibility.visible(points, cameras, depths, 0.7).collect()}
    assert got == {i: want.get(i, 0) for i in range(200)} and sum(got.values()) > 200
    monkeypatch.setattr(visibility, "MAP_PIXELS", 1)
    assert got == {x["pid"]: x["views"] for x in visibility.visible(points, cameras, depths, 0.7).collect()}


def test_front_set_adds_fractions_in_order(spark, tmp_path):
    halves = [[3.41, 2.85, 6.42, 8.51, 1.45, 2.72], [6.28, 3.77, 3.7, 3.42, 8.78, 1.55], [1.03, 5.35, 4.14, 2.49, 6.0, 7.01]]
    rows = [(1000 + 10 * k + i, datetime(2024, 1, 1, 0, i), k, v) for k, g in enumerate(halves) for i, v in enumerate(g)]
    sf = write(spark, tmp_path, "events", rows[::-1], "event_id long, ts timestamp, user_id long, value double")
    want = {}
    for k, g in enumerate(halves):
        upto = np.cumsum(g)  # one after the other; added from the last on, a half would be met elsewhere
        assert (upto >= 0.5 * upto[-1]).argmax() != (upto >= 0.5 * np.cumsum(g[::-1])[-1]).argmax()
        want |= {1000 + 10 * k + i: 1001.0 + 10 * k + (upto >= 0.5 * upto[-1]).argmax() for i in range(6)}
    assert {r["event_id"]: r["z_f"] for r in entry.queries()["front_set"](spark, sf).collect()} == want
    by_duckdb = duckdb.sql(f"WITH events AS (FROM '{sf}/events.parquet/*.parquet') " + entry.oracle_sql()["front_set"].strip().replace("WITH ", ", ", 1)).fetchall()
    assert dict(by_duckdb) == want


@pytest.mark.parametrize("hub", [0, 10_000])
def test_rows_of_a_hub_never_meet(spark, monkeypatch, hub):
    monkeypatch.setattr(graph, "TASK_EDGES", 256, raising=False)
    monkeypatch.setattr(graph, "HUB_EDGES", 200, raising=False)
    most, cut = [], graph._cut

    def spied(df):
        if df.columns == ["u", "v"]:
            sizes = [p for p, in df.select(F.spark_partition_id()).collect()]
            most.append((len(sizes), max(np.bincount(sizes), default=0)))
        return cut(df)

    monkeypatch.setattr(graph, "_cut", spied)
    r = np.random.default_rng(6)
    links = [(hub, i) for i in range(1, 2000)] + [(int(a), int(b)) for a, b in r.integers(2000, 4000, (1200, 2))] + [(9000, 9000)]
    want = {x: x for e in links for x in e}
    while True:
        low = dict(want)
        for x, y in links:
            low[x] = low[y] = min(low[x], low[y])
        if low == want:
            break
        want = low
    df = spark.createDataFrame(links, "a long, b long")
    assert {x["node"]: x["component"] for x in graph.connected_components(df, "a", "b").collect()} == want
    assert all(rows < 500 for total, rows in most[1:])  # of some 3000 edges


def test_edges_of_nothing(spark):
    df = spark.createDataFrame([(5, 5), (7, None), (None, None), (5, 5)], "a long, b long")
    got = graph.connected_components(df, "a", "b").collect()
    assert sorted((x["node"] or 0, x["component"] or 0) for x in got) == [(0, 0), (5, 5), (7, 7)]
    assert graph.connected_components(df.limit(0), "a", "b").count() == 0


def test_segments_of_a_common_phrase_are_not_sent(spark, monkeypatch):
    from pointloom.llm import substring_dedup

    r = np.random.default_rng(8)
    word = lambda n: [f"w{x}" for x in r.integers(0, 1 << 40, n)]
    phrase, passage = word(10), word(40)
    texts = [word(60) + phrase + word(60) for _ in range(200)]  # ten words in common make no window of 35
    texts += [word(50) + passage + word(50) for _ in range(2)]
    sent, plain = {}, substring_dedup.materialise
    monkeypatch.setattr(substring_dedup, "materialise", lambda df, name: sent.setdefault(name, plain(df, name)))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {x["doc_id"]: x["n_removed"] for x in substring_dedup.remove_repeats(docs).collect()}
    assert got == {i: 40 * (i >= 200) for i in range(202)}
    assert 0 < sent["segments"].count() < 100  # each text has more than one
