"""Queries over cameras, rasters, meshes, summaries and schedules, with the SQL that gives the same rows. registry.py adds them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions import camera, keys, pose
from pointloom.functions import vectors as V
from pointloom.operators import graph, lifecycle, losses, metrics, neighbors, raster, select, state
from pointloom.plans.geometry import VECTORS, _rounded, _sql, _times, _vectors
from pointloom.plans.tables import query, table
from pointloom.sources import formats


def _unit(v: str) -> list[str]:
    return [f"{v}[{i}]/sqrt({v}[1]*{v}[1]+{v}[2]*{v}[2]+{v}[3]*{v}[3])" for i in (1, 2, 3)]


def _list(xs: list[str]) -> str:
    return f"[{', '.join(xs)}]"


def _dot(a: str, b: str) -> str:
    return f"({a}[1]*{b}[1]+{a}[2]*{b}[2]+{a}[3]*{b}[3])"


def _cross(a: str, b: str) -> str:
    return _list([f"{a}[{j}]*{b}[{k}]-{a}[{k}]*{b}[{j}]" for j, k in ((2, 3), (3, 1), (1, 2))])


@query(f"""WITH {VECTORS}, l AS (SELECT vec_id, t AS p1, p AS p2, {_list(_unit('p'))} AS d1, {_list(_unit('d'))} AS d2 FROM v),
g AS (SELECT *, [p2[1]-p1[1], p2[2]-p1[2], p2[3]-p1[3]] AS gap, {_dot('d1', 'd2')} AS b FROM l),
s AS (SELECT *, ({_dot('gap', 'd1')} - b*{_dot('gap', 'd2')})/(1-b*b) AS s, (b*{_dot('gap', 'd1')} - {_dot('gap', 'd2')})/(1-b*b) AS t FROM g)
SELECT vec_id, {_sql('ax ay az', *[f'p1[{i}]+s*d1[{i}]' for i in (1, 2, 3)], digits=4)}, {_sql('bx by bz', *[f'p2[{i}]+t*d2[{i}]' for i in (1, 2, 3)], digits=4)} FROM s""")
def closest_line_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closest points of two lines."""
    a, b = pose.closest_points(F.col("t"), F.col("d1"), F.col("p"), F.col("d2"))
    lines = _vectors(spark, sf_dir).select("vec_id", "t", "p", V.normalize(F.col("p")).alias("d1"), V.normalize(F.col("d")).alias("d2"))
    return lines.select("vec_id", a.alias("a"), b.alias("b")).select("vec_id", *_rounded(F.col("a"), "ax ay az", 4), *_rounded(F.col("b"), "bx by bz", 4))


@query(f"""WITH {VECTORS}, f AS (SELECT vec_id, t, d, {_list(_unit('p'))} AS z FROM v), c AS (SELECT *, {_cross('d', 'z')} AS x0 FROM f),
r AS (SELECT *, {_list(_unit('x0'))} AS x FROM c), u AS (SELECT *, {_cross('z', 'x')} AS y0 FROM r), y AS (SELECT *, {_list(_unit('y0'))} AS y FROM u)
SELECT vec_id, {_sql(' '.join(f'm{i}' for i in range(12)), *[f'{c}[{i}]' for i in (1, 2, 3) for c in 'xyzt'])} FROM y""")
def look_at_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses that look along a direction."""
    m = _vectors(spark, sf_dir).select("vec_id", pose.look_at(F.col("p"), F.col("d"), F.col("t")).alias("m"))
    return m.select("vec_id", *_rounded(F.col("m"), " ".join(f"m{i}" for i in range(12))))


@query(f"""WITH {VECTORS}, s AS (SELECT *, [abs(e[14]), abs(e[15]), abs(e[16])] AS s FROM v), i AS (SELECT *, list_position(s, list_min(s)) AS i FROM s),
n AS (SELECT *, [r[i], r[3+i], r[6+i]] AS n0 FROM i), f AS (SELECT *, n0[1]*(t[1]-p[1])+n0[2]*(t[2]-p[2])+n0[3]*(t[3]-p[3]) < 0 AS away FROM n),
w AS (SELECT *, [CASE WHEN away THEN -n0[1] ELSE n0[1] END, CASE WHEN away THEN -n0[2] ELSE n0[2] END, CASE WHEN away THEN -n0[3] ELSE n0[3] END] AS n1 FROM f),
l AS (SELECT *, {_list(_times('r', 'n1'))} AS ln, [{', '.join(f'{x}+t[{i}]' for i, x in enumerate(_times('r', 'p'), 1))}] AS lp FROM w)
SELECT vec_id, {_sql('nx ny nz', 'n1[1]', 'n1[2]', 'n1[3]')}, {_sql('lx ly lz', 'ln[1]', 'ln[2]', 'ln[3]')}, round(abs({_dot('ln', 'lp')}), 6) AS distance, round(lp[3], 6) + 0.0 AS depth FROM l""")
def plane_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest axis, turned to the camera, and its plane in the view."""
    v = _vectors(spark, sf_dir).withColumn("s", F.transform(F.slice("e", 14, 3), F.abs))
    n = v.withColumn("n", losses.facing(losses.smallest_axis(F.col("r"), F.col("s")), F.col("p"), F.col("t"))).withColumn("view", pose.rigid(F.col("r"), F.col("t")))
    f = n.withColumn("f", losses.plane_features(F.col("n"), F.col("p"), F.col("view")))
    return f.select("vec_id", *_rounded(F.col("n"), "nx ny nz"), *_rounded(F.col("f.normal"), "lx ly lz"), F.round("f.distance", 6).alias("distance"), (F.round("f.depth", 6) + 0.0).alias("depth"))


@query(f"""WITH {VECTORS}, a AS (SELECT {_list(_unit('d'))} AS d, p FROM v),
m AS (SELECT {', '.join(f'avg({1.0 if i == j else 0.0} - d[{i}]*d[{j}]) AS m{i}{j}' for i in (1, 2, 3) for j in (1, 2, 3))},
  {', '.join(f'avg({" + ".join(f"({1.0 if i == j else 0.0} - d[{i}]*d[{j}])*p[{j}]" for j in (1, 2, 3))}) AS b{i}' for i in (1, 2, 3))} FROM a),
q AS (SELECT *, m11*(m22*m33-m23*m32)-m12*(m21*m33-m23*m31)+m13*(m21*m32-m22*m31) AS det FROM m)
SELECT round((b1*(m22*m33-m23*m32)-m12*(b2*m33-m23*b3)+m13*(b2*m32-m22*b3))/det, 6) + 0.0 AS x, round((m11*(b2*m33-m23*b3)-b1*(m21*m33-m23*m31)+m13*(m21*b3-b2*m31))/det, 6) + 0.0 AS y,
  round((m11*(m22*b3-b2*m32)-m12*(m21*b3-b2*m31)+b1*(m21*m32-m22*m31))/det, 6) + 0.0 AS z FROM q""")
def focus_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point nearest to all axes."""
    axes = _vectors(spark, sf_dir).select("p", V.normalize(F.col("d")).alias("d"))
    return metrics.focus_point(axes, "p", "d").select(*_rounded(F.col("focus"), "x y z"))


@query(f"""WITH {VECTORS}, a AS (SELECT p, [0.3*d[1]-p[1], 0.3*d[2]-p[2], 0.3*d[3]-p[3]] AS d FROM v), m AS (SELECT avg(p[1]) AS x, avg(p[2]) AS y, avg(p[3]) AS z FROM a),
g AS (SELECT [x-p[1], y-p[2], z-p[3]] AS c, d FROM a, m), r AS (SELECT acos({_dot('c', 'd')}/sqrt({_dot('c', 'c')})/sqrt({_dot('d', 'd')})) AS angle, sqrt({_dot('c', 'c')}) AS r FROM g),
s AS (SELECT avg((angle < pi()/6 AND abs((SELECT avg(r) FROM r) - r) <= 0.5*r + 1e-8)::INT) AS share FROM r)
SELECT round(share, 6) AS share, share > 0.5 AS concentric FROM s""")
def concentric_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG16: whether cameras stand around their mean and look at it."""
    cameras = _vectors(spark, sf_dir).withColumn("axis", V.sub(V.scale(F.col("d"), 0.3), F.col("p")))
    return losses.concentric(cameras, "p", "axis").select(F.round("share", 6).alias("share"), "concentric")


@query("""WITH g AS (SELECT event_id, [value, event_id % 7, -1.0] AS g, sqrt(value*value + (event_id % 7)*(event_id % 7) + 1) AS n FROM events), m AS (SELECT 2*quantile_cont(n, 0.5) AS m FROM g),
c AS (SELECT event_id, g[1]*least(1, m/n) AS x, g[2]*least(1, m/n) AS y, g[3]*least(1, m/n) AS z FROM g, m), d AS (SELECT *, -x + y + 3*z AS d FROM c)
SELECT event_id, round(x, 6) AS x, round(y, 6) + 0.0 AS y, round(z, 6) AS z, round(CASE WHEN d < 0 THEN x + d/11 ELSE x END, 6) AS free_x, round(CASE WHEN d < 0 THEN z - 3*d/11 ELSE z END, 6) + 0.0 AS free_z FROM d""")
def routed_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP13: gradients no longer than twice the median, and without what opposes another."""
    rows = table(spark, sf_dir, "events").select("event_id", F.array(F.col("value"), (F.col("event_id") % 7).cast("double"), F.lit(-1.0)).alias("g"))
    cut = losses.clip_gradients(rows, "g").withColumn("f", losses.without_conflict(F.col("g"), F.array(F.lit(-1.0), F.lit(1.0), F.lit(3.0))))
    return cut.select("event_id", *_rounded(F.col("g"), "x y z"), (F.round(F.col("f")[0], 6) + 0.0).alias("free_x"), (F.round(F.col("f")[2], 6) + 0.0).alias("free_z"))


@query("""SELECT l_returnflag AS block, min(l_quantity) AS lo_l_quantity, max(l_quantity) AS hi_l_quantity, min(l_discount) AS lo_l_discount, max(l_discount) AS hi_l_discount FROM lineitem GROUP BY 1""")
def block_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG15."""
    return metrics.block_bounds(table(spark, sf_dir, "lineitem"), F.col("l_returnflag"), ("l_quantity", "l_discount"))


@query("SELECT least(min(c_acctbal), 0.0) AS lo, greatest(max(c_acctbal), 0.0) AS hi FROM customer")
def origin_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG14."""
    return metrics.origin_box(table(spark, sf_dir, "customer"), ("c_acctbal",)).select(F.col("lo")[0].alias("lo"), F.col("hi")[0].alias("hi"))


@query("""SELECT event_id, CASE WHEN user_id % 9 = 0 THEN 0 WHEN value >= 200 THEN 0 ELSE 255 END AS red,
  CASE WHEN user_id % 9 = 0 THEN 0 WHEN value >= 200 THEN 255 ELSE floor((1 - value/200)*255)::INT END AS green,
  CASE WHEN user_id % 9 = 0 THEN 255 WHEN value >= 200 THEN 0 ELSE floor((1 - value/200)*255)::INT END AS blue FROM events""")
def error_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK15: colours of distances."""
    return metrics.error_colours(table(spark, sf_dir, "events"), "value", 200.0, F.col("user_id") % 9 == 0).select("event_id", "red", "green", "blue")


@query("""SELECT p_partkey, round(exp((ln(exp(-0.1*ln(10)*p_size)) + ln(sqrt(1 - p_size/60.0)) + ln(p_retailprice/3000))/3), 8) AS error FROM part""")
def geometric_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG21."""
    e = metrics.geometric_error(F.col("p_size"), F.col("p_size") / 60, F.col("p_retailprice") / 3000)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(e, 8).alias("error"))


@query("""WITH w AS (SELECT l_suppkey, (l_quantity - avg(l_quantity) OVER k)/(stddev_samp(l_quantity) OVER k + 0.01) - (l_tax - avg(l_tax) OVER k)/(stddev_samp(l_tax) OVER k + 0.01) AS d FROM lineitem WINDOW k AS (PARTITION BY l_suppkey))
SELECT l_suppkey, count(*) AS n, round(avg(d*d), 6) AS error FROM w WHERE abs(d) > 0.5 GROUP BY 1""")
def patch_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG25 and F25: squared differences of z-scores beyond a margin."""
    e = metrics.normalized_patch_error(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity", "l_tax", 0.5)
    return e.select("l_suppkey", "n", F.round("error", 6).alias("error"))


_RASTER = """px AS (SELECT label AS view, vec_id AS y, unnest(range(64)) AS x, unnest(embedding)::DOUBLE AS a FROM embeddings),
s AS (SELECT *, lag(a) OVER r AS l, lead(a) OVER r AS g, lag(a) OVER c AS t, lead(a) OVER c AS b, lag(y) OVER c AS y0, lead(y) OVER c AS y1 FROM px
  WINDOW r AS (PARTITION BY view, y ORDER BY x), c AS (PARTITION BY view, x ORDER BY y))"""


def _raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("view"), F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "_a")).withColumn("a", F.col("_a").cast("double")).drop("_a")


@query(f"""WITH {_RASTER}, g AS (SELECT view, x, y, CASE WHEN l IS NOT NULL AND g IS NOT NULL AND t IS NOT NULL AND b IS NOT NULL THEN greatest(abs(g - l), abs(b - t)) END AS g FROM s)
SELECT view, x::INT AS x, y, round(coalesce((g - min(g) OVER w)/(max(g) OVER w - min(g) OVER w + 1e-20), 1), 6) AS weight FROM g WINDOW w AS (PARTITION BY view)""")
def gradient_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5 and AG27: weights from central differences."""
    return raster.gradient_weight(_raster(spark, sf_dir), "a").select("view", "x", "y", F.round("weight", 6).alias("weight"))


@query(f"""WITH {_RASTER}, c AS (SELECT view, x, y, -(g - l)*(y1 - y0) AS nx, -2*(b - t) AS ny, 2.0*(y1 - y0) AS nz FROM s), n AS (SELECT *, sqrt(nx*nx+ny*ny+nz*nz) AS n FROM c)
SELECT view, x::INT AS x, y, coalesce(round(nx/n, 6), 0) + 0.0 AS nx, coalesce(round(ny/n, 6), 0) + 0.0 AS ny, coalesce(round(nz/n, 6), 0) + 0.0 AS nz FROM n""")
def depth_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normals of a raster of points."""
    points = _raster(spark, sf_dir).withColumn("point", F.array(F.col("x").cast("double"), F.col("y").cast("double"), F.col("a")))
    return raster.depth_normals(points).select("view", "x", "y", *_rounded(F.col("normal"), "nx ny nz"))


@query("SELECT n_nationkey, x::INT AS x, y::INT AS y FROM nation, range(8) a(x), range(6) b(y)")
def pixel_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pixel of every view."""
    return raster.pixel_grid(table(spark, sf_dir, "nation").select("n_nationkey"), 8, 6)


@query(f"""WITH {VECTORS}, e AS (SELECT vec_id, t AS a, [p[1]-t[1], p[2]-t[2], p[3]-t[3]] AS u, [d[1]-t[1], d[2]-t[2], d[3]-t[3]] AS w FROM v),
c AS (SELECT *, {_cross('u', 'w')} AS c, sqrt({_dot('u', 'u')}) AS lu, sqrt({_dot('w', 'w')}) AS lw FROM e),
s AS (SELECT *, 0.05*sqrt(lu*lw/sqrt({_dot('c', 'c')})) AS step FROM c), n AS (SELECT *, floor(lu/step)::INT AS n1, floor(lw/step)::INT AS n2 FROM s),
g AS (SELECT vec_id, a, u, w, (i + 0.5)/n1 AS s, (j + 0.5)/n2 AS t FROM (SELECT *, unnest(range(n1)) AS i FROM n) q, LATERAL (SELECT unnest(range(q.n2)) AS j))
SELECT vec_id, count(*) AS n, {_sql('x y z', *[f'avg(a[{i}] + u[{i}]*s + w[{i}]*t)' for i in (1, 2, 3)])} FROM g WHERE s + t < 1 - 1e-9 GROUP BY vec_id""")
def triangle_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points over triangles, their number and mean."""
    points = raster.sample_triangles(_vectors(spark, sf_dir).select("vec_id", F.col("t").alias("a"), F.col("p").alias("b"), F.col("d").alias("c")), 0.05)
    return points.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col("point")[i]).alias(c) for i, c in enumerate("xyz")]).select("vec_id", "n", *[(F.round(c, 6) + 0.0).alias(c) for c in "xyz"])


@query("""SELECT event_id, round(value/500 + least(0.1, greatest(-0.1, (user_id % 11)/10.0 - value/500)), 8) AS next, round(least(1, greatest(0, (30000.0 - event_id)/15000)), 8) AS decay,
  round(1 - (user_id % 13)/12.0*(1 - value/500), 8) AS need FROM events""")
def state_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP3, SP19 and SP20."""
    v, u = F.col("value") / 500, F.col("user_id")
    parts = {"next": state.ramp_to(v, u % 11 / 10), "decay": state.decay(F.col("event_id")), "need": state.need(v, u % 13 / 12)}
    return table(spark, sf_dir, "events").select("event_id", *[F.round(c, 8).alias(n) for n, c in parts.items()])


@query("SELECT doc_id FROM documents WHERE doc_id % 7 = 0")
def every_seventh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q8: the operator takes every k-th row."""
    return select.systematic(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 7)


@query("""WITH r AS (SELECT o_totalprice AS value, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS n FROM orders)
SELECT l::INT AS level, value FROM range(256) t(l), r WHERE i = floor(l*(n - 1)/255.0 + 0.5)::BIGINT""")
def codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5: a codebook of evenly spaced quantiles."""
    return select.quantile_codebook(table(spark, sf_dir, "orders"), "o_totalprice", 256)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted names that aren't there."""
    present = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return select.missing_files(table(spark, sf_dir, "customer").select("c_custkey"), present, "c_custkey")


@query("""WITH k AS (SELECT l_quantity AS a, l_extendedprice AS b FROM lineitem WHERE l_discount > 0.02), s AS (SELECT avg(a) AS ma, avg(b) AS mb, stddev_samp(a) AS sa, stddev_samp(b) AS sb FROM k)
SELECT round(avg(abs((a - ma)/(sa + 1e-6) - (b - mb)/(sb + 1e-6))), 6) AS loss FROM k, s""")
def masked_depth_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG26."""
    return losses.masked_depth_loss(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", F.col("l_discount") > 0.02).select(F.round("loss", 6).alias("loss"))


@query("SELECT round(avg(list_min(list_transform(embedding, lambda x: abs(x::DOUBLE)))), 8) AS loss FROM embeddings WHERE label > 3")
def smallest_axis_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG29."""
    p = table(spark, sf_dir, "embeddings").select("label", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("scales"))
    return losses.smallest_axis_loss(p, F.col("label") > 3).select(F.round("loss", 8).alias("loss"))


@query("""WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents), k AS (SELECT greatest(1, ceil((count(*) - 1)/449))::INT AS k FROM n)
SELECT doc_id, floor((i - 1)/449)::INT AS chunk, false AS anchor FROM n WHERE i > 0 UNION ALL SELECT doc_id, c::INT, true FROM n, k, LATERAL (SELECT unnest(range(k.k)) AS c) WHERE i = 0""")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U12 and ST7: chunks of rows in order, the first row in each."""
    return graph.chunk_windows(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", "chunk", "anchor")


@query("""WITH c AS (SELECT vec_id AS pid, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
d AS (SELECT a.pid, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS d FROM c a JOIN c b ON a.pid <> b.pid),
n AS (SELECT pid, avg(d) AS m FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d) AS i FROM d) WHERE i <= 3 GROUP BY pid)
SELECT pid AS a_id, round(m, 8) AS mean_dist, m > (SELECT avg(m) + 2*stddev_samp(m) FROM n) AS outlier FROM n""")
def statistical_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points far from their nearest neighbours."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pid"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])
    return neighbors.statistical_outliers(neighbors.knn_grid(e, 3, 0.1)).select("a_id", F.round("mean_dist", 8).alias("mean_dist"), "outlier")


@query("""SELECT p_partkey AS gid, round(ln(sqrt(greatest(coalesce(p_size/50.0, 0), 1e-7))), 8) AS log_scale, round((p_retailprice/3000 - 0.5)/0.28209479177387814, 8) AS f_dc, round(ln(0.1/0.9), 8) AS opacity, 45 AS n_rest FROM part""")
def initial_particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Particle columns from points."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pid"), *[F.lit(0.0).alias(c) for c in "xyz"], F.array(F.col("p_retailprice") / 3000).alias("rgb"), (F.col("p_size") / 50).alias("mean_d2"))
    made = lifecycle.initial_particles(p)
    return made.select("gid", F.round(F.col("log_scales")[1], 8).alias("log_scale"), F.round(F.col("f_dc")[0], 8).alias("f_dc"), F.round("opacity", 8).alias("opacity"), F.size("f_rest").alias("n_rest"))


@query("""SELECT c_custkey AS image_id, c_acctbal AS x, -1 AS coordinate_system FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def migrated_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: priors of images that have none yet."""
    x = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    images = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("image_id"), x.alias("prior_tx"), F.lit(None).cast("double").alias("prior_ty"), F.lit(float("nan")).alias("prior_tz"))
    new = lifecycle.migrate_priors(images, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("image_id")))
    return new.select("image_id", F.col("position")[0].alias("x"), "coordinate_system")


@query("""SELECT s_suppkey AS gid, 0.0::DOUBLE AS grad, s_acctbal AS opacity FROM supplier UNION ALL SELECT c_custkey, 0.0, NULL FROM customer""")
def appended_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of both tables, with empty accumulators."""
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("gid"), F.lit(2.0).alias("grad"), F.col("s_acctbal").alias("opacity"))
    return lifecycle.append(a, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("gid"), F.col("c_acctbal").alias("grad")))


_BENT = "u*(1 + k1*q + k2*q*q) + 2*k3*u*w + k4*(q + 2*u*u)", "w*(1 + k1*q + k2*q*q) + 2*k4*u*w + k3*(q + 2*w*w)"


@query(f"""WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS u, embedding[2]::DOUBLE AS w, embedding[3]::DOUBLE/10 AS k1, embedding[4]::DOUBLE/10 AS k2, embedding[5]::DOUBLE/10 AS k3, embedding[6]::DOUBLE/10 AS k4 FROM embeddings),
q AS (SELECT *, u*u + w*w AS q FROM p) SELECT vec_id, {_sql('u1 v1', 'u + u*k1*q', 'w + w*k1*q')}, {_sql('u4 v4', *_BENT)}, {_sql('rx ry', '(u - 0.5)/2', '(w - 0.25)/4')} FROM q""")
def distorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distorted image coordinates, and rays of pixels."""
    e = table(spark, sf_dir, "embeddings").withColumn("e", F.transform("embedding", lambda x: x.cast("double")))
    u, w, k = F.col("e")[0], F.col("e")[1], F.transform(F.slice("e", 3, 4), lambda x: x / 10)
    one, four = camera.distort(u, w, k, 1), camera.distort(u, w, k, 4)
    ray = camera.pixel_ray(u, w, F.lit(2.0), F.lit(4.0), F.lit(0.5), F.lit(0.25))
    found = {"u1": one[0], "v1": one[1], "u4": four[0], "v4": four[1], "rx": ray[0], "ry": ray[1]}
    return e.select("vec_id", *[(F.round(c, 6) + 0.0).alias(n) for n, c in found.items()])


@query(f"""WITH c AS (SELECT p_partkey, (p_size/50.0*1023)::DOUBLE AS a, (p_retailprice/4000*1023)::DOUBLE AS b, (p_partkey/65536.0*1023)::DOUBLE AS d FROM part),
k AS (SELECT p_partkey, floor(a)::BIGINT AS a, floor(b)::BIGINT AS b, floor(d)::BIGINT AS d FROM c)
SELECT p_partkey, {' + '.join(f'(((a >> {i}) & 1) << {3 * i}) + (((b >> {i}) & 1) << {3 * i + 1}) + (((d >> {i}) & 1) << {3 * i + 2})' for i in range(10))} AS code FROM k""")
def morton_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST2: Morton codes of points in a box."""
    code = keys.morton3(F.col("p_size").cast("double"), F.col("p_retailprice"), F.col("p_partkey").cast("double"), [F.lit(0.0)] * 3, [F.lit(50.0), F.lit(4000.0), F.lit(65536.0)])
    return table(spark, sf_dir, "part").select("p_partkey", code.alias("code"))


@query("""WITH e AS (SELECT l_orderkey, 's' || l_suppkey AS name, min(l_linenumber) AS rank FROM lineitem GROUP BY ALL)
SELECT '{"ref_name":"o' || o_orderkey || '","nearest_name":[' || coalesce(string_agg('"' || name || '"', ',' ORDER BY rank, name), '') || ']}' AS value FROM orders LEFT JOIN e ON l_orderkey = o_orderkey GROUP BY o_orderkey
UNION ALL SELECT '{"ref_name":"s' || s_suppkey || '","nearest_name":[]}' FROM supplier""")
def neighbour_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK12: the neighbours of each camera as JSON lines."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cid"), F.concat(F.lit("o"), F.col("o_orderkey")).alias("name"))
    suppliers = table(spark, sf_dir, "supplier").select((-F.col("s_suppkey") - 1).alias("cid"), F.concat(F.lit("s"), F.col("s_suppkey")).alias("name"))
    edges = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("a_id"), (-F.col("l_suppkey") - 1).alias("b_id")).agg(F.min("l_linenumber").alias("rank"))
    return formats.neighbours_json(edges, orders.unionByName(suppliers))


@query("""SELECT '{"id":' || n_nationkey || ',"img_name":"' || n_name || '","width":' || n_regionkey * 64 || '}' AS value FROM nation""")
def camera_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK12: cameras as JSON lines."""
    n = table(spark, sf_dir, "nation")
    return formats.cameras_json(n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("img_name"), (F.col("n_regionkey") * 64).alias("width")))


@query("""WITH RECURSIVE f AS (SELECT p_partkey AS fid, p_partkey // 4 AS v0, 1000000000 + p_partkey // 8 AS v1, 2000000000 + p_partkey AS v2 FROM part),
s AS (SELECT fid, unnest([v0, v1, v2]) AS v FROM f), k AS (SELECT v, min(fid) AS first FROM s GROUP BY v),
e AS (SELECT DISTINCT fid AS a, first AS b FROM s JOIN k USING (v)), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
c(node, root) USING KEY (node) AS (SELECT a, min(least(a, b)) FROM u GROUP BY a
  UNION SELECT u.a, min(c.root) FROM c JOIN u ON u.b = c.node JOIN recurring.c AS r ON r.node = u.a WHERE c.root < r.root GROUP BY u.a)
SELECT root AS cluster, count(*) AS n FROM c GROUP BY root""")
def mesh_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG17: sizes of the clusters of triangles that share vertices."""
    p = F.col("p_partkey")
    faces = table(spark, sf_dir, "part").select(p.cast("long").alias("fid"), F.floor(p / 4).alias("v0"), (F.floor(p / 8) + 1000000000).alias("v1"), (p.cast("long") + 2000000000).alias("v2"))
    return graph.triangle_clusters(faces, "vertex").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
