"""Extension: scores of reliability, their diagnostics, and the states and actions that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.functions.vectors import let
from pointloom.operators.losses import without_conflict
from pointloom.operators.order import prefix_sum


def _by_score(df: DataFrame, score: str, good: str) -> DataFrame:
    """(threshold, p, n, tp, k, pos, total): rows and good rows at each distinct score, and at it or above."""
    counts = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(F.count_if(F.col(good)).alias("p"), F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("_down", -F.col("threshold"))
    whole = counts.agg(F.sum("p").alias("pos"), F.sum("n").alias("total"))
    run = prefix_sum(prefix_sum(counts, "_down", "p", "tp"), "_down", "n", "k")
    return run.join(F.broadcast(whole)).drop("_down")  # one row


def auprc(df: DataFrame, score: str, good: str) -> DataFrame:
    """(auprc): the average precision over the good rows, those of one score taken together; null without any."""
    return _by_score(df, score, good).agg(F.sum(F.col("p") / F.nullif(F.col("pos"), F.lit(0)) * F.col("tp") / F.col("k")).alias("auprc"))


def coverage_risk(df: DataFrame, score: str, good: str) -> DataFrame:
    """(threshold, coverage, risk): of the rows with at least each score, their share of all and the share of them not good."""
    return _by_score(df, score, good).select("threshold", (F.col("k") / F.col("total")).alias("coverage"), (1 - F.col("tp") / F.col("k")).alias("risk"))


def consistency(depth_error: Column, normal_error: Column, depth_tolerance: float = 0.05, normal_tolerance: float = 0.10) -> Column:
    """1 without error, falling with the mean of both errors in units of their tolerances."""
    return F.exp(-(depth_error / depth_tolerance + normal_error / normal_tolerance) / 2)


# Weights of the base and the prior gradient by state and group of parameters.
ROUTES = {
    "bypass": {"pose": (1.0, 0.0), "scale": (1.0, 0.0), "opacity": (1.0, 0.0), "colour": (1.0, 0.0)},
    "consensus": {"pose": (1.0, 0.5), "scale": (1.0, 0.1), "opacity": (1.0, 0.0), "colour": (1.0, 0.0)},
    "prior": {"pose": (0.25, 1.0), "scale": (0.10, 0.25), "opacity": (0.0, 0.0), "colour": (1.0, 0.0)},
    "geometry": {"pose": (1.0, 0.0), "scale": (1.0, 0.0), "opacity": (1.0, 0.0), "colour": (1.0, 0.0)},
    "abstain": {"pose": (0.0, 0.0), "scale": (0.0, 0.0), "opacity": (0.0, 0.0), "colour": (1.0, 0.0)},
}


def routed(state: Column, group: str, base: Column, prior: Column) -> Column:
    """A gradient of one group of parameters by the state's weights; null for a state that isn't known."""
    out = F.lit(None).cast("double")
    for name, weights in ROUTES.items():
        b, p = weights[group]
        out = F.when(state == name, base * b + prior * p).otherwise(out)
    return out


def routed_vector(case: int, state: Column, group: str, base: Column, prior: Column, p: Column, g: Column, n: int = 3) -> Column:
    """The gradient of one group of parameters in the nested cases 4 to 6: routed by the state; from 5 on, where both gradients are mixed and oppose
    each other, the lesser one first loses what opposes the leading one (the prior, but for a consensus with g over p). Case 6 adds the lifecycle's actions, not to gradients."""
    if case not in (4, 5, 6):
        raise ValueError(f"no routed case {case}")
    if case > 4:
        leads = (state == "prior") | ((state == "consensus") & (p >= g))
        mixed = F.lit(False)
        for name, weights in ROUTES.items():
            if all(weights[group]):
                mixed = mixed | (state == name)
        base, prior = F.when(mixed & leads, without_conflict(base, prior, n)).otherwise(base), F.when(mixed & ~leads, without_conflict(prior, base, n)).otherwise(prior)
    return let(base, lambda b: let(prior, lambda q: F.array(*[routed(state, group, b[i], q[i]) for i in range(n)])))


def stability(move: Column, scale: Column, cosine: Column, t_move: float = 0.25, t_turn: float = 15 / 180, eps: float = 1e-8) -> Column:
    """1 for a particle that stays, falling with the way it moved (in its largest scale) and the angle its normal turned (in half turns)."""
    turn = F.acos(F.least(F.lit(1.0), F.abs(cosine))) / F.pi()
    return F.exp(-(move / (scale + eps)) / t_move - turn / t_turn)


def normal_agreement(cosine: Column, t: float = 0.10) -> Column:
    """1 where the particle's normal and the depth's are parallel, in either direction."""
    return F.exp(-(1 - F.abs(cosine)) / t)


def internal_reliability(views: Column, depth: Column, stable: Column, support: Column, has_history: Column, least: int = 2) -> Column:
    """The cube root of the three scores; 0 with fewer than `least` supporting views or without an earlier refresh."""
    valid = (support >= least) & F.coalesce(has_history, F.lit(False))
    return F.when(valid, F.cbrt(views * depth * stable)).otherwise(0.0)


def oracle_regret(df: DataFrame, state: str, prior: str, geometry: str) -> DataFrame:
    """(n, abstained, right, regret) of rows with both errors: the share left undecided and, over the rows decided for 'prior'
    or 'geometry', the share that took the smaller error and the mean error beyond the smaller one; null without such rows."""
    p, g = F.col(prior), F.col(geometry)
    taken = F.when(F.col(state) == "prior", p).when(F.col(state) == "geometry", g)
    best = F.least(p, g)
    rows = df.filter(p.isNotNull() & g.isNotNull())
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.coalesce((F.col(state) == "abstain").cast("double"), F.lit(0.0))).alias("abstained"),
        F.avg((taken <= best).cast("double")).alias("right"),
        F.avg(taken - best).alias("regret"),
    )


def ablated_gradient(case: int, base: Column, prior: Column, need: Column, p: Column, g: Column, agreement: Column, prior_weight: float = 1.0,
                     t_need: float = 0.5, t_prior: float = 0.5, t_geometry: float = 0.5, t_agree: float = 0.6, margin: float = 0.1) -> Column:
    """The geometry gradient of the nested cases 0 to 3: both terms at fixed weight, the prior weighted by need, a forced choice
    by the reliabilities p and g, and a choice that may abstain (0). Routing, projection and lifecycle (4 to 6) are routed_vector's."""
    if case == 0:
        return base + prior_weight * prior
    if case == 1:
        return base + prior_weight * need * prior
    if case not in (2, 3):
        raise ValueError(f"no gradient case {case}")
    sure_p, sure_g = p >= t_prior, g >= t_geometry
    split, ahead = sure_p & sure_g, margin if case == 3 else 0.0
    out = F.when(need <= t_need, base).when(split & (agreement >= t_agree), base + 0.5 * prior)
    out = out.when(sure_p & ~sure_g, prior).when(~sure_p & sure_g, base).when(split & (p - g > ahead), prior)
    return out.otherwise(base) if case == 2 else out.when(split & (g - p > ahead), base).otherwise(0.0)
