"""Quarantine and cascading release: turns of conversations are delivered, retried, given up or held back behind their parents.

All in JVM expressions: a piece of a conversation becomes one sorted array of structs, which a higher-order aggregate folds into
an array of outcomes, each found from its parent's place in the array so far. Exploded outcomes are ranked by their
release, and a windowed sum gives the state after each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.llm.names import hide
from pointloom.llm.storage import discard, materialise, number_gapless

#: Seconds between arrivals, the farthest parent, seconds before the first retry (which double), attempts at most.
EVERY, BACK, RETRY, ATTEMPTS = 7, 6, 20, 4
#: Turns of a conversation that are folded in one array, and turns before them that are folded along.
PIECE, LEAD = 1024, 1024

DELIVERED, DEAD, BLOCKED, UNKNOWN = range(4)
ADDED = ["status", "attempts", "first_at", "last_at", "release_no", "state", "blocked_by"]
_OUTCOME = {"st": "int", "n": "int", "t0": "long", "t1": "long", "dead": "long"}
_KIND = f"struct<{','.join(f'{k}:{v}' for k, v in _OUTCOME.items())}>"


def drawn(k: int) -> Column:
    """h(k): crc32 of the decimal text `k:conv_id:turn`; a null is the empty text there."""
    return F.crc32(F.concat_ws(":", F.lit(str(k)), F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.coalesce(F.col("turn").cast("string"), F.lit(""))).cast("binary"))


def rules() -> dict[str, Column]:
    """What the fold needs of a turn: distance of the parent (0: none, BACK at most), whether it is faulty, seconds from arrival to
    its repair, and whether each attempt of a faulty turn fails by itself."""
    return {
        "back": (drawn(0) % 7).cast("int"),
        "faulty": drawn(1) % 101 < 20,
        "repair": drawn(2) % 101,
        "fails": F.array(*[drawn(a + 2) % 3 == 0 for a in range(1, ATTEMPTS + 1)]),
    }


def _outcome(st: int | Column, n: int | Column, t0: Column | None, t1: Column | None, dead: Column | None) -> Column:
    cols = [F.lit(st), F.lit(n), *[F.lit(None) if c is None else c for c in (t0, t1, dead)]]
    return F.struct(*[c.cast(kind).alias(name) for c, (name, kind) in zip(cols, _OUTCOME.items(), strict=True)])


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _attempts(x: Column, first: Column) -> Column:
    """The outcome of a turn whose first attempt is at `first`."""
    arrived = x["p"] * EVERY
    times = [RETRY * (2**a - 1) for a in range(ATTEMPTS)]

    def result(t: Column) -> Column:
        out = _outcome(DEAD, ATTEMPTS, t, t + times[-1], x["turn"])
        for a in reversed(range(ATTEMPTS)):
            fails = x["faulty"] & ((t + times[a] < arrived + x["repair"]) | F.get(x["fails"], F.lit(a)))
            out = F.when(~fails, _outcome(DELIVERED, a + 1, t, t + times[a], None)).otherwise(out)
        return out

    return _let(first, result)


def _step(done: Column, x: Column) -> Column:
    """The outcomes so far and the one of turn x, whose parent is `back` places before the end of them."""
    parent = F.when(F.size(done) >= x["back"], F.get(done, F.size(done) - x["back"]))

    def after(p: Column) -> Column:
        unknown = p.isNull() | (p["st"] == UNKNOWN)
        held = F.when(unknown, _outcome(UNKNOWN, 0, None, None, None)).when(p["st"] != DELIVERED, _outcome(BLOCKED, 0, None, None, p["dead"]))
        return held.otherwise(_attempts(x, F.greatest(x["p"] * EVERY, p["t1"])))

    free = (x["back"] == 0) | (x["p"] < x["back"])
    found = F.when(x["known"].isNotNull(), x["known"]).when(free, _attempts(x, x["p"] * EVERY)).otherwise(_let(parent, after))
    return F.concat(done, F.array(found))


def _folded(rows: DataFrame) -> DataFrame:
    """The rows with `own`, with their outcome as `known`. rows: conv_id, piece, own and the fields of a turn."""
    fields = [c for c in rows.columns if c not in ("conv_id", "piece")]
    arrays = rows.groupBy("conv_id", "piece").agg(F.array_sort(F.collect_list(F.struct(*fields)), lambda a, b: F.signum(a["p"] - b["p"]).cast("int")).alias("turns"))
    arrays = arrays.withColumn("known", F.aggregate("turns", F.array().cast(f"array<{_KIND}>"), _step))
    each = arrays.select("conv_id", "piece", F.explode(F.arrays_zip("turns", "known")).alias("x")).filter("x.turns.own")
    return each.select("conv_id", "piece", *[F.col(f"x.turns.{c}").alias(c) for c in fields if c != "known"], F.col("x.known").alias("known"))


def _settled(numbered: DataFrame, piece: int, lead: int) -> DataFrame:
    """Every turn with its outcome. Pieces are folded side by side, each behind a lead of the turns before it.

    Where a chain of parents reaches back beyond a lead, the piece is folded again behind the last BACK outcomes of the
    piece before it, until no outcome is open; each round settles at least one piece of every conversation concerned.
    """
    if piece < BACK or lead < 0:
        raise ValueError(f"a piece has {BACK} turns at least")
    none = F.lit(None).cast(_KIND).alias("known")
    fields = [c for c in numbered.columns if c not in ("conv_id", "p")]
    home = F.floor(F.col("p") / piece).cast("long")
    # A turn leads those of the pieces behind its own that begin within `lead` turns of it.
    pieces = F.explode(F.sequence(home, F.greatest(home, F.floor((F.col("p") + lead) / piece).cast("long"))))
    rows = numbered.select("conv_id", "p", *fields, home.alias("home"), pieces.alias("piece"))
    rows = rows.select("conv_id", "piece", "p", (F.col("home") == F.col("piece")).alias("own"), none, *fields)
    table = materialise(_folded(rows), "outcomes")
    while not (open_ := table.filter(F.col("known.st") == UNKNOWN)).isEmpty():
        todo = open_.select(F.col("conv_id").alias("_c"), F.col("piece").alias("_i")).distinct()

        def of_todo(df: DataFrame, how: str) -> DataFrame:
            return df.join(todo, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("piece") == F.col("_i")), how)

        again = of_todo(table, "left_semi").withColumn("known", F.when(F.col("known.st") != UNKNOWN, F.col("known")))
        ahead = table.filter(F.col("p") % piece >= piece - BACK).withColumn("piece", F.col("piece") + 1).withColumn("own", F.lit(False))
        later = _folded(again.unionByName(of_todo(ahead, "left_semi")).select(table.columns))
        table, last = materialise(of_todo(table, "left_anti").unionByName(later), "outcomes"), table
        discard(last)
    return table


def _released(table: DataFrame, piece: int) -> DataFrame:
    """Add release_no and state: places and running sums over lots of time, so that no conversation is ranked in one task."""
    lot = F.floor(F.col("known.t1") / (EVERY * piece))
    rows = table.withColumn("lot", F.when(F.col("known.st") == DELIVERED, lot).otherwise(-1 - F.floor(F.col("p") / piece)))
    order = Window.partitionBy("conv_id", "lot").orderBy("known.t1", "turn", "p")
    rows = rows.withColumn("i", F.row_number().over(order).cast("long"))
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("crcs", F.sum("crc").over(run)).withColumn("parts", F.sum(F.col("i") * F.col("crc")).over(run))
    lots = rows.filter("lot >= 0").groupBy("conv_id", "lot").agg(F.max("i").alias("size"), F.max("crcs").alias("crcs"), F.max("parts").alias("parts"))
    before = Window.partitionBy("_c").orderBy("_lot").rowsBetween(Window.unboundedPreceding, -1)
    lots = lots.select(F.col("conv_id").alias("_c"), F.col("lot").alias("_lot"), F.col("crcs").alias("_crcs"), F.col("parts").alias("_parts"), F.coalesce(F.sum("size").over(Window.partitionBy("conv_id").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    lots = lots.withColumn("_state", F.coalesce(F.sum(F.col("_base") * F.col("_crcs") + F.col("_parts")).over(before), F.lit(0)))
    rows = rows.join(lots, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("lot") == F.col("_lot")), "left")
    return rows.withColumn("release_no", F.col("_base") + F.col("i")).withColumn("state", F.col("_state") + F.col("_base") * F.col("crcs") + F.col("parts"))


def replay(turns: DataFrame, given: dict[str, Column] | None = None, piece: int = PIECE, lead: int = LEAD) -> DataFrame:
    """turns with status (delivered, dead, blocked), attempts, first_at, last_at, release_no, state and blocked_by.

    A conversation's turns arrive EVERY seconds apart, in the order of turn, and are tried when their parent is delivered; a
    failed attempt is repeated after RETRY seconds, twice that, and so on, ATTEMPTS times. Turns behind one that is given up are blocked, and
    blocked_by says which turn that is (a dead turn's is its own). release_no counts a conversation's delivered turns by
    last_at and turn; state sums release_no * crc32(text) through each (beyond 2^63 Spark raises an error, in conversations of some
    90,000 turns or more). What doesn't apply is null. `given` replaces columns of rules().

    turns needs conv_id, turn and text, and must read the same on every pass, as a table does. Null conv_ids are one
    conversation; a null turn comes first; turns of one number go by their text's crc32 and hold, being drawn by number, one
    fate each for itself; repeated rows stay. A null text counts as empty. An empty table gives an empty result. Other columns
    stay, whatever their names; those named like the added ones are replaced. Rows are put in ranges of (conv_id, turn), and
    arrays hold `piece` + `lead` turns at most, so a conversation of any length is split.
    """
    hidden, show = hide(turns, ("conv_id", "turn", "text"), ADDED)
    others = [c for c in hidden.columns if c not in ("conv_id", "turn")]
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("crc")
    columns = rules() | (given or {})
    rows = hidden.select("conv_id", "turn", crc, *[c.alias(k) for k, c in columns.items()], F.struct(*others).alias("rest"), F.monotonically_increasing_id().alias("row"))
    order = ["conv_id", "turn", "crc", "row"]
    ranges = materialise(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "turns")
    numbered = number_gapless(ranges, "p", ["conv_id"], F.col("part"), [F.col(c) for c in order[1:]]).drop("part", "row")
    out = _released(_settled(numbered, piece, lead), piece)
    delivered, tried = F.col("known.st") == DELIVERED, F.col("known.st") != BLOCKED
    out = out.select("conv_id", "turn", *[F.col(f"rest.{c}").alias(c) for c in others], *[
        F.element_at(F.array(*map(F.lit, ("delivered", "dead", "blocked"))), F.col("known.st") + 1).alias("_pl_status"), F.col("known.n").alias("_pl_n"), F.when(tried, F.col("known.t0")).alias("_pl_t0"), F.when(tried, F.col("known.t1")).alias("_pl_t1"),
        F.when(delivered, F.col("release_no")).alias("_pl_no"), F.when(delivered, F.col("state")).alias("_pl_state"), F.col("known.dead").alias("_pl_dead"),
    ])
    return show(out, *[F.col(c).alias(a) for c, a in zip(["_pl_status", "_pl_n", "_pl_t0", "_pl_t1", "_pl_no", "_pl_state", "_pl_dead"], ADDED, strict=True)])


def op12_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    return replay(turns).select("conv_id", "turn", *ADDED[:-1])


def _bytes(text: str) -> str:
    return f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: ('0x' || b)::BIGINT)"


def crc32_sql(text: str) -> str:
    """DuckDB's crc32 of a text: the polynomial's table is linear, so an entry is the sum of those of its bits."""
    ones = []
    for i in range(8):
        c = 1 << i
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 * (c & 1))
        ones.append(c)
    entry = "0"
    for i, one in enumerate(ones):
        entry = f"xor({entry}, ((xor(c, b) >> {i}) & 1) * {one})"
    return f"xor(list_reduce({_bytes(text)}, lambda c, b: xor(c >> 8, {entry}), 4294967295), 4294967295)"


def _h(k: int) -> str:
    return crc32_sql(f"'{k}:' || conv_id || ':' || turn")


#: Each round of the recursion adds one turn to every conversation and keeps the last six outcomes, newest first.
OP12_SQL = f"""
WITH RECURSIVE c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p, {_h(0)} % 7 AS back, {_h(1)} % 101 < 20 AS faulty, {_h(2)} % 101 AS repair,
    [{', '.join(f'{_h(a + 2)} % 3 = 0' for a in range(1, 5))}] AS fails, {crc32_sql("coalesce(text, '')")} AS crc FROM conversations),
r AS (SELECT conv_id, -1::BIGINT AS p, '' AS status, 0 AS attempts, NULL::BIGINT AS t0, NULL::BIGINT AS t1, []::STRUCT(s VARCHAR, t BIGINT)[] AS was FROM c GROUP BY conv_id
  UNION ALL SELECT conv_id, p, status, attempts, t0, t1, list_prepend({{'s': status, 't': t1}}, was)[1:6] FROM (
    SELECT *, CASE WHEN NOT held AND attempts <= 4 THEN 'delivered' WHEN NOT held THEN 'dead' ELSE 'blocked' END AS status FROM (
      SELECT conv_id, p, was, held, CASE WHEN held THEN 0 ELSE a END AS attempts, CASE WHEN NOT held THEN t0 END AS t0, CASE WHEN NOT held THEN t0 + 20 * ((1 << (least(a, 4) - 1)) - 1) END AS t1 FROM (
        SELECT *, CASE WHEN NOT (faulty AND (t0 < ready OR fails[1])) THEN 1 WHEN NOT (t0 + 20 < ready OR fails[2]) THEN 2 WHEN NOT (t0 + 60 < ready OR fails[3]) THEN 3 WHEN NOT (t0 + 140 < ready OR fails[4]) THEN 4 ELSE 5 END AS a FROM (
          SELECT c.*, r.was, coalesce(c.back > 0 AND c.p >= c.back AND r.was[c.back].s <> 'delivered', false) AS held, 7 * c.p + c.repair AS ready,
            CASE WHEN c.back > 0 AND c.p >= c.back THEN greatest(7 * c.p, r.was[c.back].t) ELSE 7 * c.p END AS t0 FROM r JOIN c ON c.conv_id = r.conv_id AND c.p = r.p + 1))))),
d AS (SELECT c.conv_id, c.turn, r.status, least(r.attempts, 4) AS attempts, r.t0 AS first_at, r.t1 AS last_at, c.crc FROM c JOIN r ON r.conv_id = c.conv_id AND r.p = c.p),
n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY last_at, turn) AS release_no, crc FROM d WHERE status = 'delivered')
SELECT d.conv_id, d.turn, status, attempts::INTEGER AS attempts, first_at, last_at, release_no, CASE WHEN release_no IS NOT NULL THEN (sum(release_no * n.crc) OVER (PARTITION BY d.conv_id ORDER BY release_no))::BIGINT END AS state
FROM d LEFT JOIN n ON n.conv_id = d.conv_id AND n.turn = d.turn
"""
