"""All queries over the driver's tables and the SQL that gives the same rows.

The tables hold no scenes, so each query applies an operator to columns that have the shape it needs.
Computed doubles are rounded, as sums are added up in another order by every engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions import camera, harmonics, keys
from pointloom.functions import vectors as V
from pointloom.operators import graph, lifecycle, losses, metrics, neighbors, raster, scan, select, state
from pointloom.plans import geometry, scenes, views  # noqa: F401  register their queries
from pointloom.plans.tables import QUERIES, SQL, Query, query, table


def _cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as points by their first three dimensions."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("pid"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")], "label")


CLOUD = "cloud AS (SELECT vec_id AS pid, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, label FROM embeddings)"


@query(f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
p AS (
  SELECT a.vec_id AS a_id, b.vec_id AS b_id,
    sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.e[i] - b.e[i]) * (a.e[i] - b.e[i])))) AS dist,
    degrees(acos(list_sum(list_transform(range(1, 65), lambda i: a.e[i] * b.e[i]))
      / (sqrt(list_sum(list_transform(a.e, lambda x: x * x))) * sqrt(list_sum(list_transform(b.e, lambda x: x * x)))))) AS angle
  FROM v a, v b WHERE a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY dist, angle, b_id) AS rank FROM p WHERE angle < 85 AND dist > 0.01 AND dist < 100)
SELECT a_id, b_id, round(dist, 6) AS dist, round(angle, 4) AS angle, rank::INT AS rank FROM r WHERE rank <= 8
""")
def gated_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neighbors.gated_neighbors(table(spark, sf_dir, "embeddings"), "embedding", "embedding", "vec_id", far=100.0, degrees=85.0)
    return out.select("a_id", "b_id", F.round("dist", 6).alias("dist"), F.round("angle", 4).alias("angle"), "rank")


flagship = gated_neighbors


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
p AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, list_sum(list_transform(range(1, 65), lambda i: (a.e[i] - b.e[i]) * (a.e[i] - b.e[i]))) AS d2
  FROM v a, v b WHERE a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY d2, b_id) AS k FROM p)
SELECT a_id, round(avg(d2), 6) AS mean_d2 FROM r WHERE k <= 3 GROUP BY a_id
""")
def knn3_mean_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    near = neighbors.knn(e, e, 3, "embedding", "vec_id", "vec_id")
    return neighbors.mean_nearest(near).select("a_id", F.round("mean_d2", 6).alias("mean_d2"))


@query(f"""
WITH {CLOUD}, p AS (SELECT a.pid AS a_id, b.pid AS b_id, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) AS d2 FROM cloud a, cloud b WHERE a.pid <> b.pid),
r AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY d2, b_id) AS k FROM p)
SELECT a_id, round(avg(d2), 6) AS mean_d2 FROM r WHERE k <= 3 GROUP BY a_id
""")
def knn3_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbors.knn_grid(_cloud(spark, sf_dir), 3, 0.15)
    return neighbors.mean_nearest(near).select("a_id", F.round("mean_d2", 6).alias("mean_d2"))


@query(f"""
WITH {CLOUD} SELECT a.pid AS a_id, b.pid AS b_id, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)), 6) AS dist
FROM cloud a, cloud b WHERE sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) <= 0.05
""")
def radius_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _cloud(spark, sf_dir)
    return neighbors.radius_pairs(p, p, 0.05).select("a_id", "b_id", F.round("dist", 6).alias("dist"))


_NN = f"""{CLOUD},
p AS (SELECT a.pid AS a_id, a.label % 2 AS side, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS dist
  FROM cloud a JOIN cloud b ON a.label % 2 <> b.label % 2),
nn AS (SELECT a_id, side, min(dist) AS dist FROM p GROUP BY a_id, side HAVING min(dist) <= 0.5)"""


def _both_ways(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = _cloud(spark, sf_dir)
    a, b = p.filter("label % 2 = 0"), p.filter("label % 2 = 1")
    return neighbors.nearest_within(a, b, 0.5), neighbors.nearest_within(b, a, 0.5)


@query(f"""WITH {_NN} SELECT round(a, 6) AS mean_d2s, round(b, 6) AS mean_s2d, round((a + b) / 2, 6) AS overall
FROM (SELECT avg(dist) FILTER (side = 0) AS a, avg(dist) FILTER (side = 1) AS b FROM nn WHERE dist < 0.1)""")
def nn_chamfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.chamfer(*_both_ways(spark, sf_dir), 0.1)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(f"""WITH {_NN}, s AS (SELECT avg((dist < 0.05)::INT) FILTER (side = 0) AS p, avg((dist < 0.05)::INT) FILTER (side = 1) AS r FROM nn)
SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f_score FROM s""")
def prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.f_score(*_both_ways(spark, sf_dir), 0.05)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("""
WITH b AS (SELECT least(floor(l_discount / (0.05 / 100))::INT, 498) AS bin, count(*) AS n FROM lineitem WHERE l_discount <= 499 * (0.05 / 100) GROUP BY 1)
SELECT g.bin::INT AS bin, coalesce(n, 0) AS n, round(sum(coalesce(n, 0)) OVER (ORDER BY g.bin) / (SELECT count(*) FROM lineitem), 6) AS share
FROM range(499) g(bin) LEFT JOIN b ON b.bin = g.bin
""")
def prf_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.cumulative_histogram(table(spark, sf_dir, "lineitem"), 0.05, dist="l_discount")
    return out.select("bin", "n", F.round("share", 6).alias("share"))


@query("""
WITH q AS (SELECT quantile_cont(l_extendedprice, 0.95) AS hi, quantile_cont(l_extendedprice, 0.10) AS lo FROM lineitem)
SELECT l_orderkey, l_linenumber, l_extendedprice, l_extendedprice > hi OR l_extendedprice < least(2000.0, lo) AS flag FROM lineitem, q
""")
def dual_end_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = select.dual_end_flag(table(spark, sf_dir, "lineitem"), "l_extendedprice", ceiling=2000.0)
    return out.select("l_orderkey", "l_linenumber", "l_extendedprice", "flag")


@query("""
WITH v AS (SELECT *, CASE WHEN o_totalprice >= 100000 THEN o_totalprice ELSE 0.0 END AS v FROM orders),
s AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, (1 - 1000 / count(*) OVER ()) * (count(*) OVER () - 1) AS p FROM v),
q AS (SELECT max(v) FILTER (i = floor(p)) AS a, max(v) FILTER (i = ceil(p)) AS b, any_value(p - floor(p)) AS f FROM s)
SELECT o_orderkey, o_totalprice FROM v, q WHERE v > a + (b - a) * f AND o_totalprice >= 100000
""")
def budget_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.budget_select(table(spark, sf_dir, "orders"), "o_totalprice", 100000.0, cap=1000).select("o_orderkey", "o_totalprice")


@query("""
SELECT c_nationkey, c_custkey, c_acctbal FROM customer
JOIN (SELECT c_nationkey AS k, quantile_cont(c_acctbal, 0.2) AS q FROM customer GROUP BY 1) ON c_nationkey = k WHERE c_acctbal >= q
""")
def confidence_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.at_least_quantile(table(spark, sf_dir, "customer"), "c_acctbal", 0.2, ["c_nationkey"]).select("c_nationkey", "c_custkey", "c_acctbal")


@query("""
WITH q AS (SELECT quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM events)
SELECT event_id, round(least(greatest(value, lo), hi), 6) AS clipped FROM events, q
""")
def percentile_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.clip_to_quantiles(table(spark, sf_dir, "events"), "value", 0.05, 0.95).select("event_id", F.round("clipped", 6).alias("clipped"))


@query("""
WITH r AS (SELECT p_retailprice, row_number() OVER (ORDER BY p_retailprice) - 1 AS i, count(*) OVER () AS n FROM part)
SELECT f AS fraction, p_retailprice FROM r, (VALUES (0.05::DOUBLE), (0.5), (0.95)) t(f) WHERE i = least(floor(f * n), n - 1)
""")
def robust_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.rank_pick(table(spark, sf_dir, "part"), "p_retailprice", [0.05, 0.5, 0.95], "p_partkey").select("fraction", "p_retailprice")


_DISCS = """d AS (SELECT p_partkey AS gid, (p_size * 16)::DOUBLE AS px, (p_retailprice / 4)::DOUBLE AS py, (p_partkey % 24)::INT AS radius, p_retailprice AS depth FROM part),
r AS (SELECT *, least(40, greatest(0, trunc((px - radius) / 16)::INT)) AS x0, least(40, greatest(0, trunc((px + radius + 15) / 16)::INT)) AS x1,
  least(30, greatest(0, trunc((py - radius) / 16)::INT)) AS y0, least(30, greatest(0, trunc((py + radius + 15) / 16)::INT)) AS y1 FROM d),
t AS (SELECT gid, depth, (ty * 40 + tx)::INT AS tile_id FROM (SELECT *, unnest(range(y0, y1)) AS ty FROM r) JOIN LATERAL (SELECT unnest(range(x0, x1)) AS tx) ON true)"""


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    discs = part.select(F.col("p_partkey").alias("gid"), (F.col("p_size") * 16).cast("double").alias("px"), (F.col("p_retailprice") / 4).alias("py"), (F.col("p_partkey") % 24).cast("int").alias("radius"), F.col("p_retailprice").alias("depth"))
    return raster.tile_lists(discs, 40, 30)


@query(f"WITH {_DISCS} SELECT gid, tile_id FROM t")
def tile_binning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiles(spark, sf_dir).select("gid", "tile_id")


@query(f"WITH {_DISCS} SELECT tile_id, count(*) AS n, arg_min(gid, (depth, gid)) AS first_gid, arg_max(gid, (depth, gid)) AS last_gid FROM t GROUP BY tile_id")
def tile_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.tile_ranges(_tiles(spark, sf_dir), ["depth", "gid"]).select("tile_id", "n", F.col("first.gid").alias("first_gid"), F.col("last.gid").alias("last_gid"))


_COMPOSITE = """a AS (SELECT *, least(0.99, value / 500) AS alpha, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events),
k AS (SELECT *, exp(sum(ln(1 - alpha)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS t_after FROM a WHERE alpha >= 1.0 / 255.0),
l AS (SELECT *, t_after / (1 - alpha) AS t_before FROM k WHERE t_after >= 1e-4)"""


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("alpha", F.least(F.lit(0.99), F.col("value") / 500))


@query(f"""WITH {_COMPOSITE} SELECT user_id, round(sum(value * alpha * t_before) + min(t_after) * 10, 4) AS value, round(min(t_after), 6) AS t_final,
max(place)::INT AS n_contrib, least(min(place), 128)::INT AS first_contrib FROM l GROUP BY user_id""")
def composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = raster.composite(_lists(spark, sf_dir), ["user_id"], ["ts", "event_id"], ["value"], background=10.0)
    return out.select("user_id", F.round("value", 4).alias("value"), F.round("t_final", 6).alias("t_final"), "n_contrib", "first_contrib")


@query(f"WITH {_COMPOSITE} SELECT event_type, count(*) AS observed FROM l WHERE t_before > 0.5 GROUP BY event_type")
def observe_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.observations(_lists(spark, sf_dir), ["user_id"], ["ts", "event_id"], "event_type")


@query("""
WITH s AS (SELECT *, sum(value) OVER (PARTITION BY user_id) AS total, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS upto, event_id::DOUBLE + 1 AS depth FROM events),
z AS (SELECT *, min(CASE WHEN upto >= 0.5 * total THEN depth END) OVER (PARTITION BY user_id) AS z_f FROM s)
SELECT event_id, z_f FROM z WHERE value >= 0.01 * total AND abs(depth - z_f) <= 0.2 * z_f
""")
def front_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("depth", F.col("event_id").cast("double") + 1)
    return raster.front_set(rows, ["user_id"], ["ts", "event_id"], "value", "depth", band=0.2).select("event_id", "z_f")


@query("SELECT event_type, value, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id)::INT AS place FROM events")
def sort_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan.ranges(table(spark, sf_dir, "events").select("event_type", "value", "event_id"), ["event_type"], ["value", "event_id"])
    placed = scan.running_sums(rows, ["event_type"], ["value", "event_id"], {"place": F.lit(1)})
    return placed.select("event_type", "value", "event_id", F.col("place").cast("int").alias("place"))


_STEP = """b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount AS g, [l_quantity, l_quantity / 2, 1.0] AS s, 1 - l_tax * 12 AS opacity FROM lineitem),
c AS (SELECT *, 'kept' AS origin FROM b UNION ALL SELECT *, 'clone' FROM b WHERE g >= 0.05 AND s[1] <= 20),
k AS (SELECT *, unnest(CASE WHEN g >= 0.05 AND greatest(s[1], s[2], s[3]) > 20 AND origin <> 'clone' THEN [1, 2] ELSE [0] END) AS child FROM c),
n AS (SELECT l_orderkey, l_linenumber, l_partkey, child::INT AS child, CASE WHEN child > 0 THEN 'split' ELSE origin END AS origin, CASE WHEN child > 0 THEN s[1] / 1.6 ELSE s[1] END AS s1, opacity,
  CASE WHEN child > 0 THEN greatest(s[1], s[2], s[3]) / 1.6 ELSE greatest(s[1], s[2], s[3]) END AS m FROM k)"""


@query(f"WITH {_STEP} SELECT l_orderkey, l_linenumber, l_partkey, child, origin, round(s1, 6) AS scale, 0.0::DOUBLE AS grad FROM n WHERE NOT (opacity < 0.2 OR m > 30)")
def densify_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    rows = li.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_discount").alias("grad"), F.array(F.col("l_quantity"), F.col("l_quantity") / 2, F.lit(1.0)).alias("scales"), (1 - F.col("l_tax") * 12).alias("opacity"))
    out = lifecycle.densify_step(rows, "grad", 0.05, 20.0, 0.2, largest=30.0)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "child", "origin", F.round(F.col("scales")[0], 6).alias("scale"), "grad")


@query("""
SELECT user_id, round(coalesce(sum(sqrt(value * value + 1)) FILTER (event_type <> 'click'), 0), 3) AS grad, count(*) FILTER (event_type <> 'click') AS denom,
  round(coalesce(avg(sqrt(value * value + 1)) FILTER (event_type <> 'click'), 0), 4) AS mean_grad, max(value) FILTER (event_type <> 'click') AS max_radius
FROM events GROUP BY user_id
""")
def densify_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("one", F.lit(1.0))
    out = metrics.densify_stats(rows, "user_id", "value", "one", "value", F.col("event_type") != "click", "value")
    return out.select("user_id", F.round("grad", 3).alias("grad"), "denom", F.round("mean_grad", 4).alias("mean_grad"), "max_radius")


@query("SELECT user_id, count(DISTINCT event_type) AS views FROM events WHERE value > 100 GROUP BY user_id HAVING count(DISTINCT event_type) >= 2")
def multi_view_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.trim_by_views(table(spark, sf_dir, "events"), "user_id", "event_type", F.col("value") > 100)


@query("""
WITH p AS (SELECT l_partkey AS a, l_suppkey AS b, least(l_partkey, l_suppkey) * 2147483647 + greatest(l_partkey, l_suppkey) AS pair_id FROM lineitem)
SELECT DISTINCT a, b, pair_id, (pair_id - pair_id % 2147483647) // 2147483647 AS id1, pair_id % 2147483647 AS id2 FROM p
""")
def pair_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    p = p.withColumn("pair_id", keys.pair_id(F.col("a"), F.col("b")))
    a, b = keys.unpair(F.col("pair_id"))
    return p.select("a", "b", "pair_id", a.alias("id1"), b.alias("id2"))


@query("""
WITH c AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT p_name || ' ' || s_name || ' ' || n AS line FROM c JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
""")
def export_inliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    named = pairs.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return named.select(F.concat_ws(" ", "p_name", "s_name", F.col("n").cast("string")).alias("line"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.missing_rows(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 8 = 0 AS held_out FROM documents")
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.holdout(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", "held_out")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def split_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1")
    return select.present_files(table(spark, sf_dir, "documents").select("doc_id", "source"), good, "doc_id")


@query("""
WITH s AS (SELECT l_returnflag, avg(l_quantity) AS q, avg(l_discount) AS d FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(q, 6) AS l_quantity, round(d, 6) AS l_discount FROM s UNION ALL SELECT 'AVG', round(avg(q), 6), round(avg(d), 6) FROM s
""")
def scene_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.scene_summary(table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_quantity", "l_discount"])
    return out.select("l_returnflag", F.round("l_quantity", 6).alias("l_quantity"), F.round("l_discount", 6).alias("l_discount"))


@query(f"""WITH {CLOUD} SELECT floor(x / 0.1)::BIGINT AS i, floor(y / 0.1)::BIGINT AS j, floor(z / 0.1)::BIGINT AS k, count(*) AS n,
round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM cloud GROUP BY 1, 2, 3""")
def voxel_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.voxel_downsample(_cloud(spark, sf_dir), 0.1, ["x", "y", "z"])
    return out.select("i", "j", "k", "n", *[F.round(c, 6).alias(c) for c in "xyz"])


@query(f"""WITH {CLOUD}, c AS (SELECT avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM cloud)
SELECT round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz, round(1.1 * max(sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz))), 6) AS radius FROM cloud, c GROUP BY cx, cy, cz""")
def bounds_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.extent(_cloud(spark, sf_dir))
    return out.select(*[F.round(F.col("centre")[i], 6).alias(f"c{c}") for i, c in enumerate("xyz")], F.round("radius", 6).alias("radius"))


@query(f"""WITH {CLOUD} SELECT round(avg(x) - 3 * stddev_pop(x), 6) AS lo_x, round(avg(x) + 3 * stddev_pop(x), 6) AS hi_x,
round(2 * greatest(stddev_pop(x), stddev_pop(y), stddev_pop(z)), 6) AS radius FROM cloud""")
def bounds_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.sigma_box(_cloud(spark, sf_dir))
    return out.select(F.round(F.col("lo")[0], 6).alias("lo_x"), F.round(F.col("hi")[0], 6).alias("hi_x"), F.round("radius", 6).alias("radius"))


@query(f"""WITH {CLOUD}, b AS (SELECT min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d, min(z) AS e, max(z) AS f FROM cloud WHERE pid % 100 = 0)
SELECT round((a + b) / 2, 6) AS cx, round(1.01 * sqrt(((b-a)/2)*((b-a)/2) + ((d-c)/2)*((d-c)/2) + ((f-e)/2)*((f-e)/2)), 6) AS radius FROM b""")
def bounds_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.sampled_box(_cloud(spark, sf_dir), "pid")
    return out.select(F.round(F.col("centre")[0], 6).alias("cx"), F.round("radius", 6).alias("radius"))


def _sh_sql(weights: tuple[float, ...]) -> str:
    bands = [f"list_sum(list_transform(embedding[{a}:{b}], lambda x: x::DOUBLE * x::DOUBLE))" for a, b in ((1, 9), (10, 24), (25, 45))]
    return "sqrt(greatest(" + " + ".join(f"{w} * {x}" for w, x in zip(weights, bands, strict=True)) + ", 1e-8))"


@query(f"SELECT vec_id, round({_sh_sql((1, 1, 1))}, 6) AS equal, round({_sh_sql((2, 6, 12))}, 6) AS sobolev, round({_sh_sql((0, 1, 4))}, 6) AS aggressive FROM embeddings")
def sh_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", *[F.round(harmonics.energy(F.col("embedding"), n), 6).alias(n) for n in harmonics.BAND_WEIGHTS])


@query("""
SELECT vec_id, round(embedding[1]::DOUBLE * 0.28209479177387814 + 0.5, 6) AS colour,
  round(1 / (1 + exp(-embedding[2]::DOUBLE)), 6) AS opacity, round(2 * atan(640 / (2 * (500 + embedding[3]::DOUBLE))), 6) AS fov FROM embeddings
""")
def activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = [F.col("embedding")[i].cast("double") for i in range(3)]
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(harmonics.to_colour(e[0]), 6).alias("colour"), F.round(V.sigmoid(e[1]), 6).alias("opacity"), F.round(camera.focal_to_fov(500 + e[2], F.lit(640)), 6).alias("fov"))


@query("""
WITH n AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding[1:4], lambda y: y::DOUBLE * y::DOUBLE)))) AS q FROM embeddings)
SELECT vec_id, round(1 - 2 * (q[3] * q[3] + q[4] * q[4]), 6) AS r00, round(2 * (q[2] * q[3] - q[1] * q[4]), 6) AS r01, round(1 - 2 * (q[2] * q[2] + q[3] * q[3]), 6) AS r22 FROM n
""")
def quaternion_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.functions import pose

    q = table(spark, sf_dir, "embeddings").withColumn("q", F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")))
    q = q.withColumn("r", pose.quaternion_to_rotation(F.col("q"), unit=False))
    return q.select("vec_id", *[F.round(F.col("r")[i], 6).alias(n) for i, n in ((0, "r00"), (1, "r01"), (8, "r22"))])


@query("""
WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE + 2 AS z FROM embeddings),
n AS (SELECT *, x / z AS u, y / z AS v, (x / z) * (x / z) + (y / z) * (y / z) AS r2 FROM p WHERE z > 0.2)
SELECT vec_id, round(500 * (u + u * (0.1 * r2 + 0.01 * r2 * r2)) + 320, 4) AS px, round(500 * (v + v * (0.1 * r2 + 0.01 * r2 * r2)) + 240, 4) AS py FROM n
""")
def project_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "embeddings").withColumn("p", F.array(F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double"), F.col("embedding")[2].cast("double") + 2))
    p = p.filter(select.near_plane(F.col("p")[2]))
    px = camera.project(F.col("p"), F.lit(500.0), F.lit(500.0), F.lit(320.0), F.lit(240.0), F.array(F.lit(0.1), F.lit(0.01)), 2)
    return p.withColumn("px", px).select("vec_id", F.round(F.col("px")[0], 4).alias("px"), F.round(F.col("px")[1], 4).alias("py"))


@query("""
WITH d AS (SELECT l_orderkey AS patch, l_quantity / 500 AS a, l_extendedprice / 1000000 AS b FROM lineitem),
m AS (SELECT patch, sum(a) AS a, sum(b) AS b, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, count(*) AS n FROM d GROUP BY patch),
c AS (SELECT patch, least(greatest(1 - (ab - a * b / n) * (ab - a * b / n) / ((aa - a * a / n) * (bb - b * b / n) + 1e-8), 0), 2) AS ncc FROM m)
SELECT patch, round(ncc, 4) AS ncc, round(ncc, 4) < 0.9 AS ok FROM c
""")
def lncc(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("patch"), (F.col("l_quantity") / 500).alias("a"), (F.col("l_extendedprice") / 1000000).alias("b"))
    return metrics.local_ncc(d, "patch", "a", "b").select("patch", F.round("ncc", 4).alias("ncc"), (F.round("ncc", 4) < 0.9).alias("ok"))


@query("SELECT event_type, round(avg(abs(a - b)), 6) AS l1, round(avg((a - b) * (a - b)), 6) AS l2, round(20 * log10(1 / sqrt(avg((a - b) * (a - b)))), 4) AS psnr FROM (SELECT event_type, value / 500 AS a, (event_id % 100) / 100 AS b FROM events) GROUP BY event_type")
def image_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("value") / 500).alias("a"), (F.col("event_id") % 100 / 100).alias("b"))
    return metrics.image_errors(rows, "event_type", "a", "b").select("event_type", F.round("l1", 6).alias("l1"), F.round("l2", 6).alias("l2"), F.round("psnr", 4).alias("psnr"))


@query("""
WITH e AS (SELECT label AS image, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS y, unnest(embedding) AS f, unnest(range(1, 65)) AS x FROM embeddings),
px AS (SELECT image, x, y, f::DOUBLE AS a, round(f, 1)::DOUBLE AS b FROM e),
w0 AS (SELECT i - 5 AS o, exp(-((i - 5) * (i - 5)) / 4.5) AS w FROM range(11) t(i)), w AS (SELECT o, w / (SELECT sum(w) FROM w0) AS w FROM w0),
h AS (SELECT image, y, x + o AS x, sum(w * a) AS a, sum(w * b) AS b, sum(w * a * a) AS aa, sum(w * b * b) AS bb, sum(w * a * b) AS ab FROM px, w WHERE x + o BETWEEN 1 AND 64 GROUP BY ALL),
size AS (SELECT image, max(y) AS n FROM px GROUP BY image),
v AS (SELECT h.image, h.y + o AS y, x, sum(w * a) AS a, sum(w * b) AS b, sum(w * aa) AS aa, sum(w * bb) AS bb, sum(w * ab) AS ab FROM h, w, size WHERE size.image = h.image AND h.y + o BETWEEN 1 AND n GROUP BY ALL)
SELECT image, round(avg(((2 * a * b + 0.0001) * (2 * (ab - a * b) + 0.0009)) / ((a * a + b * b + 0.0001) * ((aa - a * a) + (bb - b * b) + 0.0009))), 6) AS ssim FROM v GROUP BY image
""")
def ssim(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = scan.ranges(table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding"), ["label"], ["vec_id"])
    lines = scan.running_sums(lines, ["label"], ["vec_id"], {"y": F.lit(1).cast("long")})
    rows = lines.select(F.col("label").alias("image"), "y", F.posexplode("embedding").alias("x", "a")).withColumn("b", F.round("a", 1))
    return metrics.ssim(rows, "image", "x", "y", "a", "b").select("image", F.round("ssim", 6).alias("ssim"))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey * 2 AS a, l_partkey * 2 + 1 AS b FROM lineitem),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
c(node, root) USING KEY (node) AS (SELECT a, min(least(a, b)) FROM u GROUP BY a
  UNION SELECT u.a, min(c.root) FROM c JOIN u ON u.b = c.node JOIN recurring.c AS r ON r.node = u.a WHERE c.root < r.root GROUP BY u.a)
SELECT node, root AS component FROM c
""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b"))
    return graph.connected_components(edges, "a", "b")


@query(f"""
WITH RECURSIVE {CLOUD}, n AS (SELECT pid, x, y, z, row_number() OVER (ORDER BY pid) AS i FROM cloud),
before AS (SELECT b.i, coalesce(list(a.i) FILTER (a.i IS NOT NULL), []) AS near FROM n b LEFT JOIN n a ON a.i < b.i AND sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) <= 0.1 GROUP BY b.i),
pass AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL
  SELECT before.i, CASE WHEN list_has_any(kept, near) THEN kept ELSE list_append(kept, before.i) END FROM pass JOIN before ON before.i = pass.i + 1)
SELECT n.pid FROM n, (SELECT kept FROM pass ORDER BY i DESC LIMIT 1) WHERE list_contains(kept, n.i)
""")
def greedy_thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.greedy_thin(_cloud(spark, sf_dir), 0.1).select("pid")


@query("""
WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS j, ts FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, i - j ORDER BY i) AS k FROM r)
SELECT event_id, last_value(CASE WHEN k >= 2 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS committed FROM k
""")
def hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.hysteresis(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", repeats=2).select("event_id", "committed")


@query("""
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, round(sum(value * CASE WHEN i = 1 THEN pow(0.9, n - 1) ELSE 0.1 * pow(0.9, n - i) END), 4) AS ema FROM r GROUP BY user_id
""")
def ema_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.ema(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value").select("user_id", F.round("ema", 4).alias("ema"))


@query("""
WITH RECURSIVE r AS (SELECT user_id, value > 250 AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT user_id, i, CASE WHEN f THEN 3 ELSE 0 END AS l, f::INT AS n FROM r WHERE i = 1
  UNION ALL SELECT r.user_id, r.i, CASE WHEN f AND l = 0 THEN 3 ELSE greatest(l - 1, 0) END, n + (f AND l = 0)::INT FROM s JOIN r ON r.user_id = s.user_id AND r.i = s.i + 1)
SELECT user_id, max(n)::INT AS fired FROM s GROUP BY user_id
""")
def cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.cooldown(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("value") > 250, 3)


@query("""
WITH s AS (SELECT o_orderkey, (o_orderkey % 97) / 96 AS n, (o_custkey % 89) / 88 AS p, (o_orderkey % 83) / 82 AS g, 1 - abs((o_custkey % 89) / 88 - (o_orderkey % 83) / 82) AS k,
  o_custkey % 5 > 0 AS vp, o_custkey % 7 > 0 AS vg FROM orders),
h AS (SELECT *, vp AND p >= 0.5 AS hp, vg AND g >= 0.5 AS hg FROM s)
SELECT o_orderkey, CASE WHEN n <= 0.5 THEN 'bypass' WHEN hp AND hg THEN CASE WHEN k >= 0.6 THEN 'consensus' WHEN p - g > 0.1 THEN 'prior' WHEN p - g < -0.1 THEN 'geometry' ELSE 'abstain' END
  WHEN hp THEN 'prior' WHEN hg THEN 'geometry' ELSE 'abstain' END AS state FROM h
""")
def five_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumns({"n": F.col("o_orderkey") % 97 / 96, "p": F.col("o_custkey") % 89 / 88, "g": F.col("o_orderkey") % 83 / 82})
    valid = F.col("o_custkey") % 5 > 0, F.col("o_custkey") % 7 > 0
    return o.select("o_orderkey", state.arbitrate(F.col("n"), F.col("p"), F.col("g"), 1 - F.abs(F.col("p") - F.col("g")), *valid).alias("state"))


@query("""
WITH d AS (SELECT user_id, cos(event_id::DOUBLE) AS x, sin(event_id::DOUBLE) AS y FROM events), g AS (SELECT user_id, count(*) AS m, sum(x) AS x, sum(y) AS y FROM d GROUP BY 1),
s AS (SELECT user_id, m, least(1, m / 5) AS c, CASE WHEN m < 2 THEN 0 ELSE least(1, greatest(0, (m * m - (x * x + y * y)) / (2 * m * (m - 1)) / (0.5 * (1 - cos(radians(30)))))) END AS a FROM g)
SELECT user_id, m, round(sqrt(c * a), 6) AS sufficiency FROM s
""")
def observation_sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").select("user_id", F.array(F.cos(F.col("event_id").cast("double")), F.sin(F.col("event_id").cast("double")), F.lit(0.0)).alias("direction"))
    return metrics.observation_sufficiency(d, "user_id", "direction").select("user_id", "m", F.round("sufficiency", 6).alias("sufficiency"))


@query("""
WITH t AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, event_type AS after FROM events)
SELECT before, after, count(*) AS n FROM t WHERE before IS NOT NULL GROUP BY ALL
""")
def transition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.transitions(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("""
WITH s AS (SELECT n_chars AS score, quality AS label FROM documents JOIN labels USING (doc_id)),
g AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q FROM s GROUP BY 1),
c AS (SELECT *, coalesce(sum(q) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT round(sum(p * (below + q / 2)) / (sum(p) * sum(q)), 6) AS auroc FROM c
""")
def score_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return metrics.auroc(rows, "n_chars", "quality").select(F.round("auroc", 6).alias("auroc"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, length(html) - length(replace(html, '<p', '<')) AS paragraphs FROM pages")
def scrape_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), (F.length("html") - F.length(F.replace(F.col("html"), F.lit("<p"), F.lit("<")))).alias("paragraphs"))


@query("SELECT event_id, (props->>'k')::INT AS k FROM events")
def metrics_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("""
WITH q AS (SELECT quantile_cont(value, 0.10) AS lo, quantile_cont(value, 0.95) AS hi FROM events)
SELECT event_id, round(least(1, greatest(0, (value - lo) / (hi - lo + 1e-8))), 6) AS ambiguity FROM events, q
""")
def ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.ambiguity(table(spark, sf_dir, "events"), "value").select("event_id", F.round("ambiguity", 6).alias("ambiguity"))


@query("""
SELECT user_id, round(sum(CASE WHEN event_type <> 'click' THEN value * event_id ELSE 0 END) / (sum(CASE WHEN event_type <> 'click' THEN value ELSE 0 END) + 1e-8), 3) AS event_id,
  count(*) FILTER (event_type <> 'click' AND value > 1e-4) >= 2 AS valid FROM events GROUP BY user_id
""")
def pooled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = state.pooled(table(spark, sf_dir, "events"), "user_id", "value", F.col("event_type") != "click", "event_id")
    return out.select("user_id", F.round("event_id", 3).alias("event_id"), "valid")


@query("""
WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS run FROM events),
n AS (SELECT event_type, count(*) AS n FROM r GROUP BY user_id, event_type, run)
SELECT event_type, count(*) AS runs, round(avg(n), 6) AS mean_rows FROM n GROUP BY event_type
""")
def dwell_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = state.dwell_times(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")
    return out.select("event_type", "runs", F.round("mean_rows", 6).alias("mean_rows"))


@query("""
SELECT l_orderkey, l_linenumber, l_quantity, round((l_extendedprice - min(l_extendedprice) OVER w) / (max(l_extendedprice) OVER w - min(l_extendedprice) OVER w + 1e-20), 6) AS normalized
FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)
""")
def depth_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = losses.normalized(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return out.select("l_orderkey", "l_linenumber", "l_quantity", F.round("normalized", 6).alias("normalized"))


@query("""
WITH q AS (SELECT quantile_cont(l_discount, 0.3) AS q FROM lineitem)
SELECT round(avg(abs(l_quantity - l_extendedprice / 2000) * (l_discount >= q)::INT) / 10, 6) AS loss FROM lineitem, q
""")
def confident_depth_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("prior", F.col("l_extendedprice") / 2000)
    return losses.confident_depth_loss(rows, "l_quantity", "prior", "l_discount", 0.3, 10.0).select(F.round("loss", 6).alias("loss"))


@query("""
SELECT user_id, round(greatest(sum(value * h * h) / sum(value) - pow(sum(value * h) / sum(value), 2), 0), 2) AS variance
FROM (SELECT user_id, value, (event_id % 50)::DOUBLE AS h FROM events) GROUP BY user_id
""")
def weighted_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("h", (F.col("event_id") % 50).cast("double"))
    return losses.weighted_variance(rows, ["user_id"], "value", ["h"]).select("user_id", F.round("variance", 2).alias("variance"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
