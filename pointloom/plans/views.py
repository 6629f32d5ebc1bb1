"""Queries over rasters of several views and over particles' lives, with the SQL that gives the same rows. registry.py adds them.

The 64 numbers of an embedding are a raster of 8 x 8 pixels, its first ones also the pose of its view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions import camera, pose
from pointloom.functions import vectors as V
from pointloom.operators import epochs, evidence, graph, life, lifecycle, neighbors, raster, reliability, select, state, visibility
from pointloom.operators.checkpoints import fresh_folder
from pointloom.plans.tables import query, table
from pointloom.streaming import snapshots


def _cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = [F.col("embedding")[i].cast("double") for i in range(6)]
    q = V.normalize(F.array(F.lit(8.0), e[0], e[1], e[2]), 4)
    fixed = {"fx": 6.0, "fy": 6.0, "cx": 3.5, "cy": 3.5, "width": 8.0, "height": 8.0}
    c = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("view"), q.alias("q"), F.array(*[0.3 * x for x in e[3:]]).alias("t"))
    return c.select("view", pose.quaternion_to_rotation(F.col("q")).alias("r"), "t", *[F.lit(v).alias(k) for k, v in fixed.items()])


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(view, i, x, y, e, v): pixel i of each view, the number there, and all numbers of the view."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("view"), F.col("embedding").alias("v"), F.posexplode("embedding").alias("i", "e"))
    return rows.select("view", "i", (F.col("i") % 8).cast("long").alias("x"), F.floor(F.col("i") / 8).alias("y"), F.col("e").cast("double").alias("e"), "v")


def _normal(a: int, b: int):
    at = lambda k: F.get(F.col("v"), ((F.col("i") + k) % 64).cast("int")).cast("double")
    return V.normalize(F.array(at(a), at(b), F.lit(2.0)))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each view with the two that follow it."""
    views = table(spark, sf_dir, "embeddings").select("vec_id")
    next_ = views.select(F.col("vec_id").alias("a_id"), F.explode(F.array(F.col("vec_id") + 1, F.col("vec_id") + 2)).alias("b_id"))
    return next_.join(views, F.col("b_id") == F.col("vec_id"), "left_semi")


def _prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pixels(spark, sf_dir)
    return p.select("view", "x", "y", (2 + 0.3 * F.col("e")).alias("depth"), _normal(0, 1).alias("normal"), F.when(F.col("i") % 13 > 0, F.col("e")).alias("confidence"))


def _rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pixels(spark, sf_dir)
    depth = F.when(F.col("i") % 17 == 0, 0.0).otherwise(2 + 0.3 * F.col("e") + 0.02 * (F.col("i") % 5))
    return p.select("view", "x", "y", depth.alias("depth"), _normal(0, 2).alias("normal"), _normal(3, 1).alias("prim_normal"), (F.col("i") % 10 / 10).alias("alpha"))


_RASTERS = """
v0 AS (SELECT vec_id AS view, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
v1 AS (SELECT view, e, sqrt(64 + e[1]*e[1] + e[2]*e[2] + e[3]*e[3]) AS n FROM v0),
v2 AS (SELECT view, e, 8/n AS w, e[1]/n AS a, e[2]/n AS b, e[3]/n AS c, [0.3*e[4], 0.3*e[5], 0.3*e[6]] AS t FROM v1),
cam AS (SELECT view, e, t, [[1-2*(b*b+c*c), 2*(a*b-w*c), 2*(a*c+w*b)], [2*(a*b+w*c), 1-2*(a*a+c*c), 2*(b*c-w*a)], [2*(a*c-w*b), 2*(b*c+w*a), 1-2*(a*a+b*b)]] AS r FROM v2),
pix AS (SELECT view, e AS v, unnest(e) AS e, unnest(range(0, 64)) AS i FROM v0),
unit AS (SELECT *, i % 8 AS x, i // 8 AS y, [v[i+1], v[(i+1) % 64 + 1], 2.0] AS n01, [v[i+1], v[(i+2) % 64 + 1], 2.0] AS n02, [v[(i+3) % 64 + 1], v[(i+1) % 64 + 1], 2.0] AS n31 FROM pix),
prior AS (SELECT view, x, y, 2 + 0.3*e AS depth, list_transform(n01, lambda k: k/sqrt(list_dot_product(n01, n01))) AS normal, CASE WHEN i % 13 > 0 THEN e END AS confidence FROM unit),
rendered AS (SELECT view, x, y, CASE WHEN i % 17 = 0 THEN 0 ELSE 2 + 0.3*e + 0.02*(i % 5) END AS depth, list_transform(n02, lambda k: k/sqrt(list_dot_product(n02, n02))) AS normal,
  list_transform(n31, lambda k: k/sqrt(list_dot_product(n31, n31))) AS prim, (i % 10)/10 AS alpha FROM unit),
pairs AS (SELECT a.view AS a_id, b.view AS b_id FROM v0 a JOIN v0 b ON b.view IN (a.view + 1, a.view + 2))"""


def _cross(raster: str, out: str) -> str:
    """CTEs of the cross-view scores of a raster."""
    return f"""{out}0 AS (SELECT p.view, p.x, p.y, p.normal, k.b_id AS other, o.r AS ro, o.t AS o_t, c.r AS r, [(p.x - 3.5)/6*p.depth - c.t[1], (p.y - 3.5)/6*p.depth - c.t[2], p.depth - c.t[3]] AS d
  FROM {raster} p JOIN cam c ON c.view = p.view JOIN pairs k ON k.a_id = p.view JOIN cam o ON o.view = k.b_id WHERE p.depth > 0),
{out}1 AS (SELECT *, [{', '.join(f'r[1][{i}]*d[1] + r[2][{i}]*d[2] + r[3][{i}]*d[3]' for i in (1, 2, 3))}] AS w FROM {out}0),
{out}2 AS (SELECT *, [{', '.join(f'ro[{i}][1]*w[1] + ro[{i}][2]*w[2] + ro[{i}][3]*w[3] + o_t[{i}]' for i in (1, 2, 3))}] AS q FROM {out}1),
{out}3 AS (SELECT *, q[3] AS z, floor(6*q[1]/q[3] + 3.5 + 0.5)::BIGINT AS ox, floor(6*q[2]/q[3] + 3.5 + 0.5)::BIGINT AS oy FROM {out}2 WHERE q[3] > 0),
{out}4 AS (SELECT s.view, s.x, s.y, other, ox, oy, z, abs(z - t.depth)/(z + t.depth + 1e-8) AS ed, 1 - abs(list_dot_product(s.normal, t.normal)) AS en
  FROM {out}3 s JOIN {raster} t ON t.view = s.other AND t.x = s.ox AND t.y = s.oy WHERE t.depth > 0 AND z <= 1.05*t.depth),
{out} AS (SELECT *, exp(-0.5*(ed/0.05 + en/0.10)) AS k FROM {out}4)"""


@query(f"""WITH {_RASTERS}, {_cross('prior', 's')}
SELECT view, x, y, other, ox, oy, round(z, 5) AS z, round(ed, 5) AS depth_error, round(en, 5) + 0.0 AS normal_error, round(k, 5) AS score FROM s""")
def cross_view_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP4 and F11: pixels projected into the neighbouring views, joined with the pixels there, and scored."""
    s = evidence.cross_view(_prior(spark, sf_dir), _cameras(spark, sf_dir), _pairs(spark, sf_dir))
    return s.select("view", "x", "y", "other", "ox", "oy", *[(F.round(c, 5) + 0.0).alias(c) for c in ("z", "depth_error", "normal_error", "score")])


_GID = "view // 4 * 16 + (y // 2) * 4 + x // 2"


@query(f"""WITH {_RASTERS}, {_cross('prior', 's')}, {_cross('rendered', 'h')},
q AS (SELECT view, quantile_cont(confidence, 0.05) AS lo, quantile_cont(confidence, 0.95) AS hi FROM prior WHERE confidence IS NOT NULL GROUP BY view),
con AS (SELECT p.view, x, y, greatest(0, least(1, (confidence - lo)/(hi - lo + 1e-8))) AS conf, depth, normal FROM prior p JOIN q ON q.view = p.view WHERE confidence IS NOT NULL),
px AS (SELECT r.view, r.x, r.y, c.conf, CASE WHEN r.depth > 0 AND alpha >= 0.5 THEN exp(-(1 - abs(list_dot_product(prim, r.normal)))/0.10) END AS dn,
  CASE WHEN r.depth > 0 AND alpha >= 0.5 THEN abs(c.depth - r.depth)/(c.depth + r.depth + 1e-8) END AS ed, CASE WHEN r.depth > 0 AND alpha >= 0.5 THEN 1 - abs(list_dot_product(c.normal, r.normal)) END AS en,
  (SELECT sum(k) FROM s WHERE s.view = r.view AND s.x = r.x AND s.y = r.y) AS ps, (SELECT count(*) FROM s WHERE s.view = r.view AND s.x = r.x AND s.y = r.y) AS pn,
  (SELECT sum(k) FROM h WHERE h.view = r.view AND h.x = r.x AND h.y = r.y) AS gs, (SELECT count(*) FROM h WHERE h.view = r.view AND h.x = r.x AND h.y = r.y) AS gn
  FROM rendered r LEFT JOIN con c ON c.view = r.view AND c.x = r.x AND c.y = r.y),
con2 AS (SELECT {_GID} AS gid, 0.2 + ((y*8 + x) % 7)/10 AS w, * FROM px),
bv AS (SELECT gid, view, sum(w*pn) > 1e-4 AS pb, sum(w*gn) > 1e-4 AS gb FROM con2 GROUP BY ALL), vs AS (SELECT gid, count_if(pb) AS pv, count_if(gb) AS gv FROM bv GROUP BY gid),
tot AS (SELECT gid, coalesce(sum(w*conf), 0)/(coalesce(sum(w) FILTER (conf IS NOT NULL), 0) + 1e-8) AS econf, coalesce(sum(w*ps), 0)/(sum(w*pn) + 1e-8) AS emv, coalesce(sum(w*gs), 0)/(sum(w*gn) + 1e-8) AS gmv,
  coalesce(sum(w*dn), 0)/(coalesce(sum(w) FILTER (dn IS NOT NULL), 0) + 1e-8) AS edn, coalesce(sum(w*ed), 0)/(coalesce(sum(w) FILTER (ed IS NOT NULL), 0) + 1e-8) AS ded,
  coalesce(sum(w*en), 0)/(coalesce(sum(w) FILTER (en IS NOT NULL), 0) + 1e-8) AS den FROM con2 GROUP BY gid),
f AS (SELECT tot.*, pv, gv, gid % 6 > 0 AS history, CASE WHEN gid % 6 > 0 THEN exp(-(0.01*(gid % 5)*abs(cos(gid::DOUBLE)))/(0.5 + 1e-8)/0.25 - acos(least(1.0, abs(cos(0.02*(gid % 3)))))/pi()/(15.0/180)) ELSE 0 END AS stab FROM tot JOIN vs USING (gid)),
g AS (SELECT *, sqrt(econf*emv) AS pt, cbrt(gmv*edn*stab) AS gt, pv >= 2 AS pval, gv >= 2 AND history AS gval FROM f)
SELECT gid, round(pt, 5) AS prior_trust, pv AS prior_views, pval AS prior_valid, round(gt, 5) AS geometry_trust, gv AS geometry_views, gval AS geometry_valid,
  round(exp(-0.5*(ded/0.05 + den/0.10)), 5) AS agreement, round(CASE WHEN pval THEN pt ELSE 0 END - CASE WHEN gval THEN gt ELSE 0 END, 5) + 0.0 AS difference FROM g""")
def surface_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP5, SP7 and SP8: the trust in the prior and in the surface of each particle, pooled over its pixels, and their agreement."""
    grid = _pixels(spark, sf_dir).select(F.expr("view div 4 * 16 + (y div 2) * 4 + x div 2").alias("gid"), "view", "x", "y", (0.2 + (F.col("y") * 8 + F.col("x")) % 7 / 10).alias("w"))
    g = F.col("gid").cast("double")
    gids = table(spark, sf_dir, "embeddings").select(F.explode(F.expr("sequence(vec_id div 4 * 16, vec_id div 4 * 16 + 15)")).alias("gid")).distinct()
    turn = 0.02 * (F.col("gid") % 3)
    now = gids.select("gid", F.array(F.cos(g), F.sin(g), F.lit(1.0)).alias("centre"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("normal"), F.lit(0.5).alias("scale"))
    step = F.array(F.cos(g) * (1 + 0.01 * (F.col("gid") % 5)), F.sin(g), F.lit(1.0))
    before = gids.filter("gid % 6 > 0").select("gid", step.alias("centre"), F.array(F.cos(turn), F.sin(turn), F.lit(0.0)).alias("normal"))
    e = evidence.evidence(grid, _prior(spark, sf_dir), _rendered(spark, sf_dir), _cameras(spark, sf_dir), _pairs(spark, sf_dir), now, before)
    return e.select(*[(F.round(c, 5) + 0.0).alias(c) if c in ("prior_trust", "geometry_trust", "agreement", "difference") else c for c in e.columns])


def _ring(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Cameras on a ring around the origin, one for each supplier, and their depth maps; some have pixels without depth."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("view"))
    a = F.col("view").cast("double")
    zero, fixed = F.lit(0.0), {"fx": 8.0, "fy": 8.0, "cx": 5.5, "cy": 3.5, "width": 12.0, "height": 8.0}
    r = F.array(F.cos(a), zero, -F.sin(a), zero, F.lit(1.0), zero, F.sin(a), zero, F.cos(a))
    cameras = s.select("view", r.alias("r"), F.array(zero, zero, F.lit(3.0)).alias("t"), *[F.lit(v).alias(k) for k, v in fixed.items()])
    grid = s.select("view", F.explode(F.sequence(F.lit(0), F.lit(95))).alias("i")).select("view", (F.col("i") % 12).cast("long").alias("x"), F.floor(F.col("i") / 12).alias("y"))
    k = (F.col("view") * 7 + F.col("x") * 3 + F.col("y") * 5) % 11
    return cameras, grid.withColumn("depth", F.when((F.col("view") % 3 == 0) & (k == 4), 0.0).otherwise(2 + k / 5))


@query("""WITH p AS (SELECT p_partkey AS pid, p_size/25.0 - 1 AS x, sin(p_partkey::DOUBLE) AS y, 1.2*cos(p_partkey*1.7) AS z FROM part),
c AS (SELECT s_suppkey AS view, cos(s_suppkey::DOUBLE) AS c, sin(s_suppkey::DOUBLE) AS s FROM supplier),
v AS (SELECT pid, view, c*x - s*z AS vx, y AS vy, s*x + c*z + 3 AS vz FROM p, c),
u AS (SELECT *, 8*vx/vz + 5.5 AS u, 8*vy/vz + 3.5 AS w FROM v WHERE vz > 0),
q AS (SELECT *, least(floor(u), 10)::BIGINT AS qx, least(floor(w), 6)::BIGINT AS qy FROM u WHERE u >= 0 AND u <= 11 AND w >= 0 AND w <= 7),
d AS (SELECT *, list_transform([[qx, qy], [qx + 1, qy], [qx, qy + 1], [qx + 1, qy + 1]], lambda g: CASE WHEN view % 3 = 0 AND (view*7 + g[1]*3 + g[2]*5) % 11 = 4 THEN 0 ELSE 2 + ((view*7 + g[1]*3 + g[2]*5) % 11)/5 END) AS g FROM q),
e AS (SELECT *, (g[1]*(1 - (u - qx)) + g[2]*(u - qx))*(1 - (w - qy)) + (g[3]*(1 - (u - qx)) + g[4]*(u - qx))*(w - qy) AS depth FROM d),
n AS (SELECT pid, count(*) AS n FROM e WHERE depth <= 0 OR vz < depth + 0.005 GROUP BY pid)
SELECT pid, coalesce(n, 0) AS views, coalesce(n, 0) >= 20 AS seen FROM p LEFT JOIN n USING (pid)""")
def visible_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that stand before the depth maps of twenty cameras."""
    n = F.col("p_partkey").cast("double")
    points = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pid"), (F.col("p_size") / 25.0 - 1).alias("x"), F.sin(n).alias("y"), (1.2 * F.cos(F.col("p_partkey") * 1.7)).alias("z"))
    return visibility.visible(points, *_ring(spark, sf_dir), width=0.8)


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i,
  ['bypass', 'consensus', 'prior', 'geometry', 'abstain'][(user_id + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END) % 5 + 1] AS s, event_id % 97 = 0 AS fresh, value > 20 AS cl, value > 60 AS sp, value > 10 AS pr, value/10000 AS op, event_id % 3 AS vw FROM events),
r AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::VARCHAR AS cand, 0 AS h, NULL::VARCHAR AS com, NULL::VARCHAR AS life, 0 AS d, 0 AS zc, 0 AS zs, 0 AS zp, 0 AS c, 0 AS lft, 2.0::DOUBLE AS g, NULL::VARCHAR AS act, 0 AS rest, NULL::VARCHAR AS olife, 0 AS od, 2.0::DOUBLE AS og FROM e GROUP BY user_id
  UNION ALL SELECT user_id, i, event_id, CASE WHEN gone THEN NULL ELSE s END, CASE WHEN gone THEN 0 ELSE h END, CASE WHEN gone THEN NULL ELSE com END, CASE WHEN gone THEN NULL ELSE life END, CASE WHEN gone THEN 0 ELSE d END,
    CASE WHEN gone THEN 0 ELSE zc END, CASE WHEN gone THEN 0 ELSE zs END, CASE WHEN gone THEN 0 ELSE zp END, CASE WHEN gone THEN 0 ELSE rest END, CASE WHEN gone THEN 0 ELSE greatest(lft - 1, 0) END, CASE WHEN gone THEN 2.0 ELSE g END, act, rest, life, d, g FROM (
    SELECT *, coalesce(act = 'prune', false) AS gone, CASE WHEN act = 'prune' THEN 0 WHEN act IS NOT NULL THEN 500 ELSE greatest(c - 1, 0) END AS rest FROM (
      SELECT * EXCLUDE (g), CASE WHEN c = 0 THEN CASE WHEN zp = 5 THEN 'prune' WHEN zc = 3 THEN 'clone' WHEN zs = 3 THEN 'split' END END AS act,
        g + greatest(-0.1, least(0.1, CASE life WHEN 'confirmed' THEN 2.2 WHEN 'protected' THEN 2.2 WHEN 'repair' THEN 1.7 WHEN 'quarantine' THEN 1.5 ELSE 2.0 END - g)) AS g FROM (
        SELECT * EXCLUDE (zc, zs, zp), CASE WHEN cl AND life IN ('normal', 'confirmed') THEN least(zc + 1, 3) ELSE 0 END AS zc, CASE WHEN sp AND life IN ('normal', 'confirmed') THEN least(zs + 1, 3) ELSE 0 END AS zs,
          CASE WHEN CASE WHEN life = 'quarantine' THEN d >= 5 AND op < 0.01 AND vw < 2 ELSE pr AND life IN ('normal', 'repair') END THEN least(zp + 1, 5) ELSE 0 END AS zp FROM (
          SELECT * EXCLUDE (life, d), now AS life, CASE WHEN now = life THEN d + 1 ELSE 1 END AS d FROM (
            SELECT *, CASE WHEN lft > 0 THEN 'probation' WHEN com = 'consensus' THEN 'confirmed' WHEN com = 'prior' THEN 'repair' WHEN com = 'geometry' THEN 'protected' WHEN com = 'abstain' THEN 'quarantine' ELSE 'normal' END AS now FROM (
              SELECT * EXCLUDE (h, com), CASE WHEN s = cand THEN h + 1 ELSE 1 END AS h, CASE WHEN (CASE WHEN s = cand THEN h + 1 ELSE 1 END) >= 3 THEN s ELSE com END AS com FROM (
                SELECT e.*, CASE WHEN fresh THEN NULL ELSE r.cand END AS cand, CASE WHEN fresh THEN 0 ELSE r.h END AS h, CASE WHEN fresh THEN NULL ELSE r.com END AS com, CASE WHEN fresh THEN NULL ELSE r.life END AS life, CASE WHEN fresh THEN 0 ELSE r.d END AS d,
                  CASE WHEN fresh THEN 0 ELSE r.zc END AS zc, CASE WHEN fresh THEN 0 ELSE r.zs END AS zs, CASE WHEN fresh THEN 0 ELSE r.zp END AS zp, CASE WHEN fresh THEN 0 ELSE r.c END AS c, CASE WHEN fresh THEN 500 ELSE r.lft END AS lft, CASE WHEN fresh THEN 2.0 ELSE r.g END AS g
                  FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1))))))))
SELECT user_id, event_id, olife AS life, od AS dwell, act AS action, rest, round(og, 6) AS truncation FROM r WHERE i > 0""")
def lifecycle_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP14 to SP16, SP19 and W11: lives, persistence, rest, quarantine, probation and truncation over each particle's refreshes."""
    names = F.array(*[F.lit(s) for s in life.LIVES])
    v, n = F.col("value"), F.col("event_id")
    state = F.get(names, ((F.col("user_id") + F.when(n % 5 == 0, 1).otherwise(0)) % 5).cast("int"))
    columns = {"state": state, "fresh": n % 97 == 0, "clone": v > 20, "split": v > 60, "prune": v > 10, "opacity": v / 10000, "views": (n % 3).cast("int")}
    rows = life.fold(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", *[c.alias(k) for k, c in columns.items()]), "user_id", ["ts", "event_id"])
    return rows.select("user_id", "event_id", "life", "dwell", "action", "rest", F.round("truncation", 6).alias("truncation"))


@query("""WITH w AS (SELECT l_orderkey AS ray, l_linenumber AS n, l_quantity AS w, 200 + round(100*l_discount) AS z FROM lineitem),
s AS (SELECT *, sum(w) OVER (PARTITION BY ray) AS a, sum(w) OVER (PARTITION BY ray ORDER BY n, z, w ROWS UNBOUNDED PRECEDING) AS upto FROM w),
z AS (SELECT *, min(CASE WHEN upto >= 0.5*a THEN z END) OVER (PARTITION BY ray) AS zf FROM s),
f AS (SELECT ray, sum(w) AS wf, sum(w*z)/sum(w) AS m FROM z WHERE w >= 0.01*a AND abs(z - zf) <= 0.02*zf GROUP BY ray),
v AS (SELECT z.ray, sqrt(sum(w*(z - m)*(z - m))/any_value(wf))/(any_value(m) + 1e-8) AS nu FROM z JOIN f ON f.ray = z.ray WHERE w >= 0.01*a AND abs(z - zf) <= 0.02*zf GROUP BY z.ray),
r AS (SELECT ray, sum(w) AS a FROM w GROUP BY ray)
SELECT r.ray, round(a, 5) AS alpha, round(coalesce(wf, 0)/(a + 1e-8), 5) AS share, round(nu, 5) AS spread, round(a, 5) >= 120 AND round(coalesce(wf, 0)/(a + 1e-8), 5) >= 0.6 AND coalesce(round(nu, 5) <= 0.01, false) AS open FROM r LEFT JOIN f USING (ray) LEFT JOIN v USING (ray)""")
def front_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP17: rays with one reliable surface in front."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ray"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("w"), (200 + F.round(100 * F.col("l_discount"))).alias("z"))
    rays = rows.groupBy("ray").agg(F.sum("w").alias("alpha"))
    gates = raster.front_gate(raster.front_set(rows, ["ray"], ["n", "z", "w"], "w", "z"), rays, ["ray"], "w", "z", least_alpha=120.0, least_share=0.6)
    r = gates.select("ray", *[F.round(c, 5).alias(c) for c in ("alpha", "share", "spread")])
    return r.withColumn("open", F.coalesce((F.col("alpha") >= 120) & (F.col("share") >= 0.6) & (F.col("spread") <= 0.01), F.lit(False)))


@query("""WITH RECURSIVE k AS (SELECT unnest(range(48)) AS r, unnest([%s]) AS k), s AS (SELECT count(*) AS n FROM orders),
x AS (SELECT 0 AS r, o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS x FROM orders
  UNION ALL SELECT r + 1, o_orderkey, CASE WHEN ((((m*k[2] + k[3]) %% 2147483647) * ((m*k[4] + k[5]) %% 2147483647) %% 2147483647) >> 7) %% 2 = 1 THEN y ELSE x END FROM (
    SELECT *, greatest(x, y) AS m FROM (SELECT x.*, k.k, (k.k[1] %% n - x + n) %% n AS y FROM x JOIN k ON k.r = x.r, s)))
SELECT o_orderkey, x AS place FROM x WHERE r = 48""" % ", ".join(f"[{', '.join(f'{x}::BIGINT' for x in k)}]" for k in epochs.draws(7, 3)))
def epoch_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q7, Q11 and Q12: the order of an epoch, a keyed permutation of the rows' numbers."""
    return select.shuffled(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], seed=7, epoch=3)


def _vector_sql(source: str, value: str, out: str) -> str:
    """CTEs of the unit eigenvectors for an eigenvalue, their largest number positive, from the rows of the matrix less the value."""
    rows = [[f"a00 - {value}", "a01", "a02"], ["a01", f"a11 - {value}", "a12"], ["a02", "a12", f"a22 - {value}"]]
    cross = lambda a, b: "[" + ", ".join(f"({a[j]})*({b[k]}) - ({a[k]})*({b[j]})" for j, k in ((1, 2), (2, 0), (0, 1))) + "]"
    pairs = [cross(rows[i], rows[j]) for i, j in ((0, 1), (0, 2), (1, 2))]
    return f"""{out}0 AS (SELECT *, list_sort([{', '.join(f"{{'n': list_dot_product({c}, {c}), 'c': {c}}}" for c in pairs)}], 'DESC')[1].c AS c FROM {source}),
{out}1 AS (SELECT *, list_transform(c, lambda x: x/sqrt(list_dot_product(c, c))) AS u FROM {out}0),
{out} AS (SELECT * EXCLUDE (c, u), CASE WHEN u[list_position(list_transform(u, lambda x: abs(x)), list_max(list_transform(u, lambda x: abs(x))))] < 0 THEN list_transform(u, lambda x: -x) ELSE u END AS {out}_v FROM {out}1)"""


#: Eigenvalues l1 >= l2 >= l3 in closed form.
_VALUES = """q0 AS (SELECT *, (a00 + a11 + a22)/3 AS q FROM m), q1 AS (SELECT *, sqrt(((a00-q)*(a00-q) + (a11-q)*(a11-q) + (a22-q)*(a22-q) + 2*(a01*a01 + a02*a02 + a12*a12))/6) AS p FROM q0),
q2 AS (SELECT *, acos(greatest(-1, least(1, ((a00-q)*((a11-q)*(a22-q) - a12*a12) - a01*(a01*(a22-q) - a12*a02) + a02*(a01*a12 - (a11-q)*a02))/(2*p*p*p))))/3 AS phi FROM q1),
q3 AS (SELECT *, q + 2*p*cos(phi) AS l1, q + 2*p*cos(phi + 2*pi()/3) AS l3 FROM q2), ev AS (SELECT *, 3*q - l1 - l3 AS l2 FROM q3)"""


@query(f"""WITH c AS (SELECT vec_id AS pid, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
d AS (SELECT a.pid, b.x, b.y, b.z, row_number() OVER (PARTITION BY a.pid ORDER BY CASE WHEN a.pid = b.pid THEN -1 ELSE (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) END, b.pid) AS k FROM c a, c b),
m AS (SELECT pid, covar_pop(x, x) AS a00, covar_pop(x, y) AS a01, covar_pop(x, z) AS a02, covar_pop(y, y) AS a11, covar_pop(y, z) AS a12, covar_pop(z, z) AS a22 FROM d WHERE k <= 21 GROUP BY pid),
{_VALUES}, {_vector_sql('ev', 'l3', 'v')}
SELECT pid, round(l3, 6) AS least, round(l2, 6) AS middle, round(l1, 6) AS most, round(abs(v_v[1]), 3) AS nx, round(abs(v_v[2]), 3) AS ny, round(abs(v_v[3]), 3) AS nz FROM v""")
def point_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G8 and ST8: normals from 20 neighbours, and the variances around each point in order."""
    e = table(spark, sf_dir, "embeddings")
    cloud = e.select(F.col("vec_id").alias("pid"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])
    n = neighbors.normals_by_neighbours(neighbors.knn_grid(cloud, 20, 0.3), cloud)
    values = [F.round(F.col("values")[i], 6).alias(c) for i, c in enumerate(("least", "middle", "most"))]
    return n.select(F.col("a_id").alias("pid"), *values, *[F.round(F.abs(F.col("normal")[i]), 3).alias(f"n{c}") for i, c in enumerate("xyz")])


@query(f"""WITH e AS (SELECT vec_id, list_transform(embedding[1:12], lambda x: x::DOUBLE) AS p FROM embeddings),
m AS (SELECT covar_pop(p[4], p[4]) AS a00, covar_pop(p[4], p[8]) AS a01, covar_pop(p[4], p[12]) AS a02, covar_pop(p[8], p[8]) AS a11, covar_pop(p[8], p[12]) AS a12, covar_pop(p[12], p[12]) AS a22,
  avg(p[4]) AS m1, avg(p[8]) AS m2, avg(p[12]) AS m3, avg(p[2]) AS y1, avg(p[6]) AS y2, avg(p[10]) AS y3 FROM e),
{_VALUES}, {_vector_sql('ev', 'l1', 'f')}, {_vector_sql('f', 'l2', 'g')}, {_vector_sql('g', 'l3', 'h')},
d AS (SELECT *, f_v[1]*(g_v[2]*h_v[3] - g_v[3]*h_v[2]) - f_v[2]*(g_v[1]*h_v[3] - g_v[3]*h_v[1]) + f_v[3]*(g_v[1]*h_v[2] - g_v[2]*h_v[1]) < 0 AS odd FROM h),
t AS (SELECT *, CASE WHEN odd THEN list_transform(h_v, lambda x: -x) ELSE h_v END AS z FROM d), u AS (SELECT *, CASE WHEN z[1]*y1 + z[2]*y2 + z[3]*y3 < 0 THEN -1 ELSE 1 END AS s FROM t)
SELECT vec_id, round(f_v[1]*(e.p[4]-m1) + f_v[2]*(e.p[8]-m2) + f_v[3]*(e.p[12]-m3), 5) + 0.0 AS x, round(s*(g_v[1]*(e.p[4]-m1) + g_v[2]*(e.p[8]-m2) + g_v[3]*(e.p[12]-m3)), 5) + 0.0 AS y,
  round(s*(z[1]*(e.p[4]-m1) + z[2]*(e.p[8]-m2) + z[3]*(e.p[12]-m3)), 5) + 0.0 AS z FROM e, u""")
def aligned_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P37 and ST8: camera positions in the frame of their principal axes."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 12), lambda x: x.cast("double")).alias("p"))
    placed = e.join(F.broadcast(pose.principal_frame(e, "p")))  # one row
    at = [V.total([F.col("transform")[4 * i + j] * F.col("p")[4 * j + 3] for j in range(3)]) + F.col("transform")[4 * i + 3] for i in range(3)]
    return placed.select("vec_id", *[(F.round(a, 5) + 0.0).alias(c) for a, c in zip(at, "xyz", strict=True)])


@query("""WITH e AS (SELECT list_transform(embedding[1:12], lambda x: x::DOUBLE) AS p FROM embeddings),
m AS (SELECT [avg(p[3]), avg(p[7]), avg(p[11])] AS z, [avg(p[2]), avg(p[6]), avg(p[10])] AS up, [avg(p[4]), avg(p[8]), avg(p[12])] AS t FROM e), a AS (SELECT list_transform(z, lambda x: x/sqrt(list_dot_product(z, z))) AS z, up, t FROM m),
b AS (SELECT z, t, [up[2]*z[3] - up[3]*z[2], up[3]*z[1] - up[1]*z[3], up[1]*z[2] - up[2]*z[1]] AS x0 FROM a), c AS (SELECT z, t, list_transform(x0, lambda v: v/sqrt(list_dot_product(x0, x0))) AS x FROM b)
SELECT round(x[1], 6) AS x0, round(x[2], 6) AS x1, round(x[3], 6) AS x2, round(z[2]*x[3] - z[3]*x[2], 6) AS y0, round(z[3]*x[1] - z[1]*x[3], 6) AS y1, round(z[1]*x[2] - z[2]*x[1], 6) AS y2, round(z[1], 6) AS z0, round(t[1], 6) AS t0 FROM c""")
def average_camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pose at the mean position, with the mean directions."""
    e = table(spark, sf_dir, "embeddings").select(F.transform(F.slice("embedding", 1, 12), lambda x: x.cast("double")).alias("p"))
    m = F.col("pose")
    at = {"x0": 0, "x1": 4, "x2": 8, "y0": 1, "y1": 5, "y2": 9, "z0": 2, "t0": 3}
    return pose.average_pose(e, "p").select(*[F.round(m[i], 6).alias(n) for n, i in at.items()])


@query("""WITH p AS (SELECT p_partkey, [p_size/10.0, sin(p_partkey::DOUBLE), cos(p_partkey*1.7)] AS a FROM part),
d AS (SELECT p_partkey % 5 > 0 AS good, a, [1.5*(0.8*a[1] - 0.6*a[2]) + 1, 1.5*(0.6*a[1] + 0.8*a[2]) - 2, 1.5*a[3] + 0.5] AS b FROM p)
SELECT count(*) AS inliers, round(sqrt((var_pop(b[1]) + var_pop(b[2]) + var_pop(b[3]))/(var_pop(a[1]) + var_pop(a[2]) + var_pop(a[3]))), 5) AS scale, 0.8::DOUBLE AS r0, -0.6::DOUBLE AS r1, 1::DOUBLE AS t0, -2::DOUBLE AS t1, 0.5::DOUBLE AS t2 FROM d WHERE good""")
def robust_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similarity that most matches agree with, found by rounds of random trials."""
    n = F.col("p_partkey")
    a = [F.col("p_size") / 10.0, F.sin(n.cast("double")), F.cos(n * 1.7)]
    b = [1.5 * (0.8 * a[0] - 0.6 * a[1]) + 1, 1.5 * (0.6 * a[0] + 0.8 * a[1]) - 2, 1.5 * a[2] + 0.5]
    off = [F.when(n % 5 == 0, x + 3 + 5 * F.abs(F.sin(n * (i + 2.3)))).otherwise(x) for i, x in enumerate(b)]
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array(*a).alias("a"), F.array(*off).alias("b"))
    best = graph.ransac_similarity(rows, "p_partkey", "a", "b", threshold=0.05)
    r, t = F.col("rotation"), F.col("translation")
    return best.select("inliers", *[(F.round(c, 5) + 0.0).alias(k) for k, c in {"scale": F.col("scale"), "r0": r[0], "r1": r[1], "t0": t[0], "t1": t[1], "t2": t[2]}.items()])


@query("""SELECT event_id, CASE WHEN i < 1000 THEN 'start' WHEN i < 5000 THEN 'warm-up' WHEN i < 7000 THEN 'shadow' WHEN i < 15000 THEN 'repair' ELSE 'refine' END AS phase, i >= 1000 AS evidence, i >= 5000 AS states, i >= 7000 AS routing,
  i >= 7000 AND i < 15000 AS lifecycle, i >= 7000 AS ray_colour, i >= 15000 AS ray_normal, i >= 7000 AND i < 15000 AS truncation, i >= 15000 AS prior_decay, round(CASE WHEN i < 15000 THEN 1 ELSE greatest(0, least(1, (30000 - i)/15000)) END, 8) AS prior_weight
FROM (SELECT event_id, (event_id*7) % 33000 AS i FROM events)""")
def training_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP20: the phase of each iteration, what is on in it, and the prior's weight."""
    e = table(spark, sf_dir, "events").select("event_id", state.phase(F.col("event_id") * 7 % 33000).alias("p"))
    return e.select("event_id", "p.phase", *[F.col(f"p.{s}").alias(s) for s in state.SWITCHES], F.round("p.prior_weight", 8).alias("prior_weight"))


@query("""WITH g AS (SELECT o_orderkey, ['bypass', 'consensus', 'prior', 'geometry', 'abstain'][o_orderkey % 5 + 1] AS s, [o_totalprice/997, o_orderkey % 13 - 6, 1.0]::DOUBLE[] AS b, [o_custkey % 7 - 5, o_orderkey % 11 - 4, -2.0]::DOUBLE[] AS q,
  (o_custkey % 89)/88 >= (o_orderkey % 83)/82 AS ahead FROM orders),
d AS (SELECT *, least(0, list_dot_product(b, q)) AS dot, list_dot_product(b, b) AS bb, list_dot_product(q, q) AS qq FROM g),
f AS (SELECT *, CASE WHEN s = 'prior' OR s = 'consensus' AND ahead THEN list_transform(range(1, 4), lambda i: b[i] - dot*q[i]/qq) ELSE b END AS fb, CASE WHEN s = 'consensus' AND NOT ahead THEN list_transform(range(1, 4), lambda i: q[i] - dot*b[i]/bb) ELSE q END AS fq FROM d),
w AS (SELECT *, CASE s WHEN 'prior' THEN 0.25 WHEN 'abstain' THEN 0 ELSE 1 END AS wb, CASE s WHEN 'consensus' THEN 0.5 WHEN 'prior' THEN 1 ELSE 0 END AS wq FROM f)
SELECT o_orderkey, """ + ", ".join(f"round(wb*b[{i}] + wq*q[{i}], 3) + 0.0 AS c4_{c}, round(wb*fb[{i}] + wq*fq[{i}], 3) + 0.0 AS c5_{c}" for i, c in enumerate("xyz", 1)) + " FROM w")
def routed_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP22: the pose gradients of the nested cases 4 and 5."""
    names = F.array(*[F.lit(s) for s in life.LIVES])
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    base, prior = F.array(F.col("o_totalprice") / 997, (k % 13 - 6).cast("double"), F.lit(1.0)), F.array((c % 7 - 5).cast("double"), (k % 11 - 4).cast("double"), F.lit(-2.0))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.get(names, (k % 5).cast("int")).alias("s"), base.alias("b"), prior.alias("q"), (c % 89 / 88).alias("p"), (k % 83 / 82).alias("g"))
    cases = [reliability.routed_vector(n, F.col("s"), "pose", F.col("b"), F.col("q"), F.col("p"), F.col("g")).alias(f"c{n}") for n in (4, 5)]
    return rows.select("o_orderkey", *cases).select("o_orderkey", *[(F.round(F.col(f"c{n}")[i], 3) + 0.0).alias(f"c{n}_{x}") for i, x in enumerate("xyz") for n in (4, 5)])


@query("""WITH d AS (SELECT vec_id, list_transform(embedding[11:13], lambda x: x::DOUBLE) AS d FROM embeddings),
v AS (SELECT * FROM (VALUES (0, 0.0, 0.0), (1, 0.0, 120.0), (2, 0.0, 240.0), (3, 35.0, 60.0), (4, 35.0, 180.0), (5, 35.0, 300.0), (6, -35.0, 0.0), (7, -35.0, 120.0), (8, -35.0, 240.0)) t(view, pitch, yaw)),
y AS (SELECT vec_id, view, radians(-pitch) AS a, [cos(radians(-yaw))*d[1] + sin(radians(-yaw))*d[3], d[2], cos(radians(-yaw))*d[3] - sin(radians(-yaw))*d[1]] AS e FROM d, v)
SELECT vec_id, view, round(e[1], 6) + 0.0 AS x, round(cos(a)*e[2] - sin(a)*e[3], 6) + 0.0 AS y, round(sin(a)*e[2] + cos(a)*e[3], 6) + 0.0 AS z FROM y""")
def virtual_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rays of a panorama in the axes of virtual cameras around it."""
    turns = F.array(*[F.array(*[F.lit(x) for x in r]) for r in camera.virtual_rotations(3, [0.0, 35.0, -35.0])])
    d = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 11, 3), lambda x: x.cast("double")).alias("d"), F.posexplode(turns).alias("view", "r"))
    return d.select("vec_id", "view", *[(F.round(V.total([F.col("r")[3 * i + j] * F.col("d")[j] for j in range(3)]), 6) + 0.0).alias(c) for i, c in enumerate("xyz")])


def _inverse_sql(m: str) -> str:
    """A DuckDB list of 12: the inverse of a rigid-like 3x4 in a list of 12."""
    a = [[f"{m}[{4 * i + j + 1}]" for j in range(3)] for i in range(3)]
    co = lambda i, j: f"({a[(j + 1) % 3][(i + 1) % 3]}*{a[(j + 2) % 3][(i + 2) % 3]} - {a[(j + 1) % 3][(i + 2) % 3]}*{a[(j + 2) % 3][(i + 1) % 3]})"
    det = "(" + " + ".join(f"{a[0][j]}*{co(j, 0)}" for j in range(3)) + ")"
    r = [[f"{co(i, j)}/{det}" for j in range(3)] for i in range(3)]
    return "[" + ", ".join(x for i in range(3) for x in (*r[i], "-(" + " + ".join(f"{r[i][j]}*{m}[{4 * j + 4}]" for j in range(3)) + ")")) + "]"


@query(f"""WITH e AS (SELECT vec_id, list_transform(range(1, 13), lambda i: embedding[i]::DOUBLE*0.1 + CASE WHEN i IN (1, 6, 11) THEN 1 ELSE 0 END) AS a, list_transform(range(1, 13), lambda i: embedding[i + 12]::DOUBLE*0.1 + CASE WHEN i IN (1, 6, 11) THEN 1 ELSE 0 END) AS b, (vec_id % 11)/10 AS w FROM embeddings),
i AS (SELECT vec_id, w, {_inverse_sql('a')} AS a, {_inverse_sql('b')} AS b FROM e), m AS (SELECT vec_id, list_transform(range(1, 13), lambda i: w*a[i] + (1 - w)*b[i]) AS m FROM i), o AS (SELECT vec_id, {_inverse_sql('m')} AS o FROM m)
SELECT vec_id, {', '.join(f'round(o[{i + 1}], 6) + 0.0 AS o{i}' for i in range(12))} FROM o""")
def blended_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cameras between two others."""
    part = lambda a: F.transform(F.slice("embedding", a, 12), lambda x, i: x.cast("double") * 0.1 + F.when(i.isin(0, 5, 10), 1.0).otherwise(0.0))
    o = table(spark, sf_dir, "embeddings").select("vec_id", part(1).alias("a"), part(13).alias("b")).select("vec_id", pose.blended(F.col("a"), F.col("b"), F.col("vec_id") % 11 / 10).alias("o"))
    return o.select("vec_id", *[(F.round(F.col("o")[i], 6) + 0.0).alias(f"o{i}") for i in range(12)])


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY seq DESC NULLS LAST, change_id DESC NULLS LAST, valid_at DESC NULLS LAST, op DESC NULLS LAST, source DESC NULLS LAST, segment DESC NULLS LAST, city DESC NULLS LAST, balance DESC NULLS LAST) AS k FROM client_changes)
SELECT client_id, change_id, seq, segment, city, balance FROM r WHERE k = 1 AND op IS DISTINCT FROM 'D'""")
def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK17, U1 and U2: changes committed as versions of a log, late ones after newer, compacted on the way, and read as a table."""
    changes = table(spark, sf_dir, "client_changes")
    order = ["seq", "change_id", "valid_at", "op", "source", "segment", "city", "balance"]
    log = snapshots.SnapshotLog(spark, fresh_folder(spark, "log"), changes.schema, "client_id", order, F.col("op") == "D", buckets=8)
    for version, part in enumerate((3, 0, 2, 1)):
        log.commit(changes.filter(F.pmod(F.coalesce("change_id", F.lit(0)), F.lit(4)) == part), version)
        if version == 2:
            log.compact(least=3)
    return log.read().select("client_id", "change_id", "seq", "segment", "city", "balance")


def _quantile_sql(values: str, fraction: str) -> str:
    """The interpolated quantile of a sorted list."""
    at = f"((len({values}) - 1)*({fraction}))"
    return f"({values}[floor{at}::BIGINT + 1] + ({at} - floor{at})*({values}[ceil{at}::BIGINT + 1] - {values}[floor{at}::BIGINT + 1]))"


def _budgeted_sql(tenths: int, absolute_cap: int) -> str:
    return f"""b AS (SELECT p_partkey AS id, abs(sin(p_partkey::DOUBLE)) AS g, abs(cos(p_partkey*1.3)) AS a, p_size/50.0 AS s, p_partkey % 40 AS r, (p_partkey % 23)/22 AS o FROM part),
c AS (SELECT *, s > 0.5 AS big, (SELECT count(*) FROM b) AS n, (SELECT count(*)*{tenths}//10 FROM b) AS cap FROM b), d AS (SELECT *, g >= 0.8 AND NOT big AS c0, g >= 0.8 AND big AS s0 FROM c),
l AS (SELECT list_sort(list(CASE WHEN c0 THEN g ELSE 0 END)) AS l, any_value(n) AS ln, any_value(cap) AS lc, count_if(c0) AS k FROM d), lq AS (SELECT k, {_quantile_sql('l', 'greatest(0, 1 - (lc - ln)::DOUBLE/ln)')} AS qc FROM l),
f AS (SELECT d.*, c0 AND (k + n <= cap OR g > qc) AS cl FROM d, lq), h AS (SELECT *, n + (SELECT count_if(cl) FROM f) AS m, (SELECT count_if(s0) FROM f) AS ks FROM f),
x AS (SELECT CASE WHEN s0 THEN g ELSE 0 END AS v, CASE WHEN NOT s0 AND big AND r > 20 THEN a ELSE 0 END AS w, cap - m AS room, m, least(cap - m - ks, {absolute_cap}) AS aroom FROM h UNION ALL SELECT 0, 0, cap - m, m, least(cap - m - ks, {absolute_cap}) FROM h WHERE cl),
xl AS (SELECT list_sort(list(v)) AS lv, list_sort(list(w)) AS lw, any_value(room) AS room, any_value(m) AS xm, any_value(aroom) AS aroom, count_if(w >= 0.6) AS ka FROM x),
q AS (SELECT ka, aroom, {_quantile_sql('lv', 'greatest(0, 1 - room::DOUBLE/xm)')} AS qs, {_quantile_sql('lw', 'greatest(0, least(1, 1 - aroom::DOUBLE/xm))')} AS qa FROM xl),
y AS (SELECT h.*, CASE WHEN ks + m > cap THEN s0 AND g > qs ELSE s0 OR CASE WHEN ka > aroom THEN CASE WHEN NOT s0 AND big AND r > 20 THEN a ELSE 0 END > qa ELSE NOT s0 AND big AND r > 20 AND a >= 0.6 END END AS sp FROM h, q),
z AS (SELECT id, o, s, 'clone' AS origin, 0 AS child FROM y WHERE cl UNION ALL SELECT id, o, CASE WHEN sp THEN s/1.6 ELSE s END, CASE WHEN sp THEN 'split' ELSE 'kept' END, unnest(CASE WHEN sp THEN [1, 2] ELSE [0] END) FROM y)
SELECT id, origin, child, round(s, 6) AS scale FROM z WHERE NOT (o < 0.1 OR s > 0.95)"""


def _budgeted(spark: SparkSession, sf_dir: str, tenths: int, absolute_cap: int) -> DataFrame:
    k = F.col("p_partkey")
    columns = {"id": k, "grad": F.abs(F.sin(k.cast("double"))), "grad_abs": F.abs(F.cos(k * 1.3)), "scales": F.array(F.col("p_size") / 50.0, F.lit(0.01), F.lit(0.01)), "max_radius": (k % 40).cast("double"), "opacity": k % 23 / 22}
    rows = table(spark, sf_dir, "part").select(*[c.alias(n) for n, c in columns.items()])
    out = lifecycle.budgeted_step(rows, "grad", 0.8, "grad_abs", 0.6, 0.5, 0.1, rows.count() * tenths // 10, absolute_cap, largest=0.95)
    return out.select("id", "origin", "child", F.round(F.col("scales")[0], 6).alias("scale"))


@query("WITH " + _budgeted_sql(11, 50_000))
def tight_densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A densify step with room for a tenth more rows."""
    return _budgeted(spark, sf_dir, 11, 50_000)


@query("WITH " + _budgeted_sql(30, 20))
def roomy_densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A densify step with splits by absolute gradients, 20 of them at most."""
    return _budgeted(spark, sf_dir, 30, 20)
