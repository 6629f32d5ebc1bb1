"""Extension: the life of particles as a state machine over their refreshes: states, gates, persistence, cooldown, quarantine, probation.

`fold` runs it over a table; pointloom.streaming.life runs the same steps over a stream with `step`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.vectors import let
from pointloom.operators.checkpoints import cut
from pointloom.operators.order import numbered

# The life of each arbitrated state, and the truncation that each life tends to.
LIVES = {"bypass": "normal", "consensus": "confirmed", "prior": "repair", "geometry": "protected", "abstain": "quarantine"}
TARGETS = {"confirmed": 2.2, "protected": 2.2, "normal": 2.0, "probation": 2.0, "repair": 1.7, "quarantine": 1.5}


@dataclass(frozen=True)
class Rules:
    """How often in a row a state must come to be committed, and an event to be acted on; rounds of rest behind an action and of
    probation; what lets a particle in quarantine be pruned; the most that truncation moves in a round."""

    enter: int = 3
    clone: int = 3
    split: int = 3
    prune: int = 5
    clone_rest: int = 500
    split_rest: int = 500
    probation: int = 500
    dwell: int = 5
    least_opacity: float = 0.01
    least_views: int = 2
    pace: float = 0.1


INPUT = ["state", "fresh", "clone", "split", "prune", "opacity", "views"]
OUTPUT = {"life": "string", "dwell": "int", "action": "string", "rest": "int", "truncation": "double"}
#: candidate, times in a row, committed, life, rounds in it, rounds of clone, split and prune events, rest, probation left, truncation.
MEMORY = {"candidate": "string", "times": "int", "committed": "string", "life": "string", "dwell": "int", "clones": "int", "splits": "int", "prunes": "int", "rest": "int", "left": "int", "truncation": "double"}
BLANK = (None, 0, None, None, 0, 0, 0, 0, 0, 0, 2.0)


def step(memory: tuple, row: tuple, rules: Rules) -> tuple[tuple, tuple]:
    """(memory, output) after one refresh; row in the order of INPUT, flags that are null count as false."""
    state, fresh, clone, split, prune, opacity, views = row
    if fresh:
        memory = (*BLANK[:9], rules.probation, BLANK[10])
    candidate, times, committed, life, dwell, clones, splits, prunes, rest, left, truncation = memory
    times = times + 1 if state == candidate else 1
    committed = state if times >= rules.enter else committed
    now = "probation" if left > 0 else LIVES.get(committed, "normal")
    dwell = dwell + 1 if now == life else 1
    grows = now in ("normal", "confirmed")
    faint = dwell >= rules.dwell and opacity is not None and opacity < rules.least_opacity and views is not None and views < rules.least_views
    goes = faint if now == "quarantine" else bool(prune) and now in ("normal", "repair")
    clones = min(clones + 1, rules.clone) if clone and grows else 0
    splits = min(splits + 1, rules.split) if split and grows else 0
    prunes = min(prunes + 1, rules.prune) if goes else 0
    action = None
    if rest == 0:
        action = "prune" if prunes == rules.prune else "clone" if clones == rules.clone else "split" if splits == rules.split else None
    rest = {"prune": 0, "clone": rules.clone_rest, "split": rules.split_rest}.get(action, max(rest - 1, 0))
    truncation += min(rules.pace, max(-rules.pace, TARGETS[now] - truncation))
    out = (now, dwell, action, rest, truncation)
    return (BLANK if action == "prune" else (state, times, committed, now, dwell, clones, splits, prunes, rest, max(left - 1, 0), truncation)), out


def _struct(kinds: dict[str, str], values: list) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast(kind).alias(name) for v, (name, kind) in zip(values, kinds.items(), strict=True)])


def _kind(kinds: dict[str, str]) -> str:
    return f"struct<{','.join(f'{k}:{v}' for k, v in kinds.items())}>"


def _choice(value: Column, table: dict, other) -> Column:
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def _stepped(rules: Rules):
    """The same as step, in expressions: (struct of memory and the outputs so far, row) to the next such struct."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    blank = _struct(MEMORY, list(BLANK))
    new = _struct(MEMORY, [*BLANK[:9], rules.probation, BLANK[10]])

    def run(so_far: Column, x: Column) -> Column:
        def counted(m: Column) -> Column:
            times = F.when(x["state"].eqNullSafe(m["candidate"]), m["times"] + 1).otherwise(1)
            return F.struct(m.alias("m"), times.alias("times"), F.when(times >= rules.enter, x["state"]).otherwise(m["committed"]).alias("committed"))

        def lived(a: Column) -> Column:
            now = F.when(a["m"]["left"] > 0, F.lit("probation")).otherwise(F.coalesce(_choice(a["committed"], LIVES, "normal"), F.lit("normal")))
            return let(now, lambda n: F.struct(a.alias("a"), n.alias("now"), F.when(n == a["m"]["life"], a["m"]["dwell"] + 1).otherwise(1).alias("dwell")))

        def events(b: Column) -> Column:
            m, now = b["a"]["m"], b["now"]
            grows = now.isin("normal", "confirmed")
            faint = (b["dwell"] >= rules.dwell) & yes(x["opacity"] < rules.least_opacity) & yes(x["views"] < rules.least_views)
            goes = F.when(now == "quarantine", faint).otherwise(yes(x["prune"]) & now.isin("normal", "repair"))
            up = lambda event, before, most: F.when(event, F.least(before + 1, F.lit(most))).otherwise(0)
            return F.struct(b.alias("b"), up(yes(x["clone"]) & grows, m["clones"], rules.clone).alias("clones"), up(yes(x["split"]) & grows, m["splits"], rules.split).alias("splits"), up(goes, m["prunes"], rules.prune).alias("prunes"))

        def acted(c: Column) -> Column:
            m = c["b"]["a"]["m"]
            action = F.when(m["rest"] == 0, F.when(c["prunes"] == rules.prune, "prune").when(c["clones"] == rules.clone, "clone").when(c["splits"] == rules.split, "split"))
            move = F.least(F.lit(rules.pace), F.greatest(F.lit(-rules.pace), _choice(c["b"]["now"], TARGETS, None) - m["truncation"]))
            return F.struct(c.alias("c"), action.alias("action"), (m["truncation"] + move).alias("truncation"))

        def closed(d: Column) -> Column:
            b, c = d["c"]["b"], d["c"]
            m = b["a"]["m"]
            rest = F.when(d["action"] == "prune", 0).when(d["action"] == "clone", rules.clone_rest).when(d["action"] == "split", rules.split_rest).otherwise(F.greatest(m["rest"] - 1, F.lit(0)))
            after = _struct(MEMORY, [x["state"], b["a"]["times"], b["a"]["committed"], b["now"], b["dwell"], c["clones"], c["splits"], c["prunes"], rest, F.greatest(m["left"] - 1, F.lit(0)), d["truncation"]])
            out = _struct(OUTPUT, [b["now"], b["dwell"], d["action"], rest, d["truncation"]])
            return F.struct(F.when(F.coalesce(d["action"] == "prune", F.lit(False)), blank).otherwise(after).alias("memory"), F.concat(so_far["outs"], F.array(out)).alias("outs"))

        memory = F.when(yes(x["fresh"]), new).otherwise(so_far["memory"])
        return let(let(let(let(let(memory, counted), lived), events), acted), closed)

    return run


def fold(refreshes: DataFrame, key: str, order: list[str], rules: Rules = Rules(), block: int = 512) -> DataFrame:
    """refreshes (key, order..., the columns of INPUT) with the columns of OUTPUT after each row, in the order of `order` within a key.

    State: the life follows the arbitrated state that came `enter` times in a row (none yet: normal), a fresh particle is on probation.
    Clones and splits need a normal or confirmed life, prunes one that isn't confirmed, protected or on probation, and in
    quarantine a long stay, little opacity and few views instead of the event. An event that came often enough in a row is acted
    on, unless an earlier action still rests; of several, prune goes first, then clone. A pruned particle's next row begins anew.

    A key's rows are cut into blocks, which are folded one after the other with what the block before left; blocks of
    different keys go side by side, so the rounds are those of the key with the most blocks, and no task holds a key.
    """
    rows = refreshes.select(key, *order, *INPUT)
    placed = numbered(rows, [key, *order], "_place").withColumn("_block", F.floor(F.col("_place") / block))
    blocks = placed.groupBy(key, "_block").agg(F.count(F.lit(1)).alias("_n")).withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy("_block")))
    named = blocks.select(F.col(key).alias("_key"), F.col("_block").alias("_of"), "_nth")
    fields = [c for c in placed.columns if c not in (key, "_block", "_place")]
    arrays = placed.groupBy(key, "_block").agg(F.sort_array(F.collect_list(F.struct("_place", *fields))).alias("_rows"))
    arrays = cut(arrays.join(named, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_of"))).select(key, "_nth", "_rows"))
    most = arrays.agg(F.max("_nth")).first()[0] or 0
    start, run = _struct(MEMORY, list(BLANK)), _stepped(rules)
    empty = F.array().cast(f"array<{_kind(OUTPUT)}>")
    memory, done = None, []
    for nth in range(1, most + 1):
        now = arrays.filter(F.col("_nth") == nth)
        if memory is None:
            now = now.withColumn("_memory", start)
        else:
            now = now.join(memory, F.col(key).eqNullSafe(F.col("_last")), "left")
        folded = cut(now.select(key, "_rows", F.aggregate("_rows", F.struct(F.coalesce("_memory", start).alias("memory"), empty.alias("outs")), run).alias("_f")))
        memory = folded.select(F.col(key).alias("_last"), F.col("_f.memory").alias("_memory"))
        done.append(folded.select(key, F.explode(F.arrays_zip("_rows", F.col("_f.outs").alias("_outs"))).alias("_x")))
    if not done:
        return rows.select("*", *[F.lit(None).cast(v).alias(k) for k, v in OUTPUT.items()])
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(key, *[F.col(f"_x._rows.{c}").alias(c) for c in fields], *[F.col(f"_x._outs.{c}").alias(c) for c in OUTPUT])
