"""A Merkle manifest of a dataset: a tree of digests over each language's documents, and one over the languages' roots.

Pregel-style supersteps over RDDs. A vertex holds up to 2^BITS children, which is a subtree of BITS levels; children send their
digests to it, and a vertex that has all of them hashes its levels and sends the top on. In reverse
supersteps every vertex sends each child the siblings on the way up, down to the leaves, which fold them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.llm.names import hide
from pointloom.llm.release import crc32_sql
from pointloom.llm.storage import fresh_path, materialise

#: Levels of the tree in one vertex, and leaves that a task has on average at most.
BITS = 10
TASK_LEAVES = 200_000
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_LEAF = "doc_id long, lang string, position long, leaf string, subroot string, root string, path array<string>, path_lefts array<boolean>, proof_sha256 string, folded_root string, verified boolean"

#: (tree, step, block): tree -1 stands over the languages' trees; step 0 has leaves or languages as its children.
Key = tuple[int, int, int]


def digest(columns: dict[str, Column]) -> Column:
    """The leaf of a document: sha256 of its fields, each `-` if null, else its UTF-8 bytes' number, `:` and the value."""

    def field(c: Column) -> Column:
        value = c.cast("string")
        return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value), F.lit(":"), value))

    return F.sha2(F.concat(*[field(columns[f]) for f in FIELDS]), 256)


def _hashed(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def levels_of(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes and so many levels over them; of a run of two, or the last one alone, each."""
    out = [nodes]
    for _ in range(levels):
        last = out[-1]
        out.append([_hashed(last[i : i + 2]) for i in range(0, len(last), 2)])
    return out


def siblings(levels: list[list[str]], place: int) -> list[str | None]:
    """The other node of the run, or None, on each level but the top, from child `place` up."""
    return [x[i ^ 1] if (i := place >> n) ^ 1 < len(x) else None for n, x in enumerate(levels[:-1])]


def folded(node: str, path: list[str | None], places: list[int]) -> str:
    """The root over a node; places says on each level whether it is the right one of its run (odd)."""
    for other, at in zip(path, places, strict=True):
        node = _hashed([node] if other is None else [other, node] if at & 1 else [node, other])
    return node


def _shape(key: Key, n: int, bits: int) -> tuple[int, int, bool]:
    """(children of the vertex, its levels, whether it is its tree's top) in a tree of n leaves."""
    _, step, block = key
    nodes = -(-n // (1 << bits * step))
    return min(1 << bits, nodes - (block << bits)), min(bits, (n - 1).bit_length() - bits * step), nodes <= 1 << bits


def _climb(trees: int, bits: int):
    """The vertex program of the way up: (key, messages) to (key, children or None, messages to send).

    A message is (place, digest, leaves of the tree, who sent it). A vertex that lacks children keeps what it has.
    """

    def program(item: tuple[Key, Iterator]) -> tuple:
        key, inbox = item
        inbox = sorted(inbox, key=lambda m: m[0])
        n = inbox[0][2]
        children, levels, top = _shape(key, n, bits)
        if len(inbox) < children:
            return key, None, [(key, m) for m in inbox]
        node = levels_of([m[1] for m in inbox], levels)[-1][0]
        tree, step, block = key
        if not top:
            sent = [((tree, step + 1, block >> bits), (block & (1 << bits) - 1, node, n, key))]
        else:
            sent = [] if tree < 0 else [((-1, 0, tree >> bits), (tree & (1 << bits) - 1, node, trees, key))]
        return key, inbox, sent

    return program


def _descend(bits: int):
    """The vertex program of the way down: a vertex and what its parent sent, to what each child gets.

    What is sent is (siblings above, their places, subroot, root). Leaves get it as (None, (leaf, all of it)).
    """

    def program(item: tuple[Key, tuple]) -> Iterator[tuple]:
        key, (inbox, (above, places, subroot, root)) = item
        tree, _, block = key
        _, height, top = _shape(key, inbox[0][2], bits)
        levels = levels_of([m[1] for m in inbox], height)
        if top and tree < 0:
            root = levels[-1][0]
        elif top:
            subroot = levels[-1][0]
        for place, m in enumerate(inbox):
            sent = (siblings(levels, place) + above, [place >> i & 1 for i in range(height)] + places, subroot, root)
            if isinstance(m[3], tuple):
                yield m[3], sent
            else:
                yield None, ((block << bits) + place, m[1], m[3], sent)

    return program


def _supersteps(leaves: RDD, n: int, longest: int, trees: int, bits: int, save) -> RDD:
    """The leaves, each with the siblings on its way to the root. leaves: (key, message) of their vertices; n of them in all."""
    tasks = max(leaves.context.defaultParallelism, -(-n // TASK_LEAVES))
    rounds = [max(1, math.ceil((x - 1).bit_length() / bits)) for x in (longest, trees)]
    sent, steps = leaves, []
    for step in range(sum(rounds)):
        at = max(leaves.context.defaultParallelism, tasks >> bits * step)
        steps.append(save(sent.groupByKey(at).map(_climb(trees, bits)), f"up{step}"))
        sent = steps[-1].flatMap(lambda v: v[2])
    down, found = None, []
    for step in reversed(range(sum(rounds))):
        at = max(leaves.context.defaultParallelism, tasks >> bits * step)
        vertices = steps[step].filter(lambda v: v[1] is not None).map(lambda v: (v[0], v[1]))
        start = vertices.filter(lambda v: v[0][0] < 0 and _shape(v[0], trees, bits)[2]).mapValues(lambda _: ([], [], None, None))
        inbox = start if down is None else down.union(start)
        # A child's vertex was completed in this step or in one before; what it gets waits until its step comes.
        met = inbox.leftOuterJoin(vertices, at)
        now = save(met.flatMap(_deliver(bits)), f"down{step}")
        found.append(now.filter(lambda x: x[0] is None).values())
        down = now.filter(lambda x: x[0] is not None)
    return leaves.context.union(found)


def _deliver(bits: int):
    program = _descend(bits)

    def each(item: tuple[Key, tuple]) -> Iterator[tuple]:
        key, (message, inbox) = item
        return iter([(key, message)]) if inbox is None else program((key, (inbox, message)))

    return each


def _ordered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with tree, position and size of their tree, a row per tree), trees and rows in order, none gathered in a task."""
    ranges = materialise(rows.repartitionByRange("lang", "doc_id", "leaf", "row").withColumn("part", F.spark_partition_id()), "leaves")
    counts = ranges.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("n"))
    by_lang = Window.partitionBy("lang")
    before = by_lang.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = materialise(counts.select("lang", "part", F.sum("n").over(by_lang).alias("size"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "spans")
    # A language's rows begin in one range, in which it is ordered among those that begin there.
    langs = spans.filter("base = 0").groupBy("lang", "size").agg(F.min("part").alias("part"))
    inside = langs.withColumn("i", F.row_number().over(Window.partitionBy("part").orderBy("lang")))
    begun = langs.groupBy("part").agg(F.count(F.lit(1)).alias("k"))
    begun = begun.select(F.col("part").alias("_p"), F.coalesce(F.sum("k").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))  # a row per range
    trees = materialise(inside.join(begun, F.col("part") == F.col("_p")).select("lang", "size", (F.col("first") + F.col("i") - 1).alias("tree")), "trees")
    named = spans.join(trees.select(F.col("lang").alias("_l"), "tree"), F.col("lang").eqNullSafe(F.col("_l"))).select(F.col("lang").alias("_l"), F.col("part").alias("_p"), "size", "base", "tree")
    named = materialise(named, "spans")
    ranked = ranges.withColumn("i", F.row_number().over(Window.partitionBy("lang", "part").orderBy("doc_id", "leaf", "row")))
    return ranked.join(named, F.col("lang").eqNullSafe(F.col("_l")) & (F.col("part") == F.col("_p"))).withColumn("position", F.col("base") + F.col("i") - 1), trees


def manifest(docs: DataFrame, found: dict[str, Column] | None = None, bits: int = BITS) -> DataFrame:
    """A row per document: doc_id, lang, position, leaf, subroot, root, path, path_lefts, proof_sha256, folded_root, verified.

    A language's leaves ascend by doc_id (null first; equal ids by leaf, so repeated rows are interchangeable), positions
    beginning with 0; on each level two in a row become the sha256 of both, an odd last one that of itself, until one is
    left: subroot. Subroots by language (null first, bytewise) become root alike. path has the siblings from the leaf up
    ('' where there is none), path_lefts whether the sibling stands left; proof_sha256 is their digest. folded_root is
    computed from the document as `found` has it (columns that replace those of docs; none: as it is) and its path.

    Nulls in any field are told from empty values. Texts are hashed whole. docs must read the same on every pass, as a
    table does. An empty table gives an empty result. Columns other than FIELDS are not part of a leaf and are left out,
    whatever their names.
    """
    spark = docs.sparkSession
    hidden, _ = hide(docs, FIELDS)
    own = {f: F.col(f) for f in FIELDS}
    rows = hidden.select("doc_id", "lang", digest(own).alias("leaf"), digest(own | (found or {})).alias("found"), F.monotonically_increasing_id().alias("row"))
    rows, trees = _ordered(rows)
    n, longest, count = trees.agg(F.sum("size"), F.max("size"), F.count(F.lit(1))).first()
    if not n:
        return spark.createDataFrame([], _LEAF)
    mask = (1 << bits) - 1

    def save(rdd: RDD, name: str) -> RDD:
        path = fresh_path(spark, name)
        rdd.saveAsPickleFile(path, 100)
        return spark.sparkContext.pickleFile(path)

    def message(r) -> tuple[Key, tuple]:
        return (r["tree"], 0, r["position"] >> bits), (r["position"] & mask, r["leaf"], r["size"], [r["doc_id"], r["lang"], r["found"]])

    def row(x) -> tuple:
        position, leaf, (doc_id, lang, seen), (path, places, subroot, root) = x
        top = folded(seen, path, places)
        proof = _hashed([p for p in path if p])
        return doc_id, lang, position, leaf, subroot, root, [p or "" for p in path], [at == 1 for at in places], proof, top, top == root

    leaves = rows.select("tree", "position", "leaf", "size", "doc_id", "lang", "found").rdd.map(message)
    return spark.createDataFrame(_supersteps(leaves, n, longest, count, bits, save).map(row), _LEAF)


def verify(docs: DataFrame, stored: DataFrame) -> DataFrame:
    """docs' doc_id and lang with leaf, root (null without a row in the stored manifest) and verified: whether the document as it is
    now leads to the stored root over the stored path. Only leaves and paths meet, by doc_id and leaf's language."""
    hidden, _ = hide(docs, FIELDS)
    now = hidden.select("doc_id", "lang", digest({f: F.col(f) for f in FIELDS}).alias("leaf"))
    kept = stored.select(F.col("doc_id").alias("_d"), F.col("lang").alias("_l"), "root", F.arrays_zip("path", "path_lefts").alias("_path"))
    joined = now.join(kept, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("lang").eqNullSafe(F.col("_l")), "left")

    def up(node: Column, step: Column) -> Column:
        return F.sha2(F.when(step["path_lefts"], F.concat(step["path"], node)).otherwise(F.concat(node, step["path"])), 256)

    return joined.select("doc_id", "lang", "leaf", "root", F.coalesce(F.aggregate("_path", F.col("leaf"), up) == F.col("root"), F.lit(False)).alias("verified"))


def tampered(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, F.lit(False))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    seen = {"n_chars": F.col("n_chars") + F.when(tampered(F.col("doc_id")), 1).otherwise(0)}
    return manifest(docs, seen).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE octet_length(encode({value}::VARCHAR)) || ':' || {value}::VARCHAR END"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(_field(n_chars if f == 'n_chars' else f) for f in FIELDS)})"


#: Levels are rounds of a recursion; then each leaf meets its run on every level, and folds them in another.
OP13_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, {_leaf('n_chars')} AS leaf,
    {_leaf(f"(n_chars + CASE WHEN {crc32_sql('doc_id::VARCHAR')} % 7 = 0 THEN 1 ELSE 0 END)")} AS seen FROM documents),
t AS (SELECT 0 AS l, lang, i, n, leaf AS h FROM d
  UNION ALL SELECT l + 1, lang, i // 2, (n + 1) // 2, sha256(h || o) FROM (SELECT *, coalesce(lead(h) OVER (PARTITION BY lang ORDER BY i), '') AS o FROM t WHERE n > 1) WHERE i % 2 = 0),
s AS (SELECT lang, h AS subroot, l AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS l, i, n, subroot AS h FROM s
  UNION ALL SELECT l + 1, i // 2, (n + 1) // 2, sha256(h || o) FROM (SELECT *, coalesce(lead(h) OVER (ORDER BY i), '') AS o FROM u WHERE n > 1) WHERE i % 2 = 0),
p AS (SELECT d.doc_id, d.leaf, d.seen, d.i AS at, s.i AS lang_at, s.subroot, s.height, s.lang, (SELECT h FROM u WHERE n = 1) AS root FROM d JOIN s ON s.lang IS NOT DISTINCT FROM d.lang),
w AS (SELECT p.doc_id, t.l, t.h, t.i % 2 = 0 AS lefts FROM p JOIN t ON t.lang IS NOT DISTINCT FROM p.lang AND t.l < p.height AND t.i = xor(p.at >> t.l, 1)
  UNION ALL SELECT p.doc_id, p.height + u.l, u.h, u.i % 2 = 0 FROM p JOIN u ON u.n > 1 AND u.i = xor(p.lang_at >> u.l, 1)),
k AS (SELECT doc_id, sha256(string_agg(h, '' ORDER BY l)) AS proof FROM w GROUP BY doc_id),
f AS (SELECT doc_id, 0 AS l, seen AS h, height + (SELECT max(l) FROM u) AS top FROM p
  UNION ALL SELECT f.doc_id, f.l + 1, sha256(CASE WHEN w.lefts THEN w.h || f.h ELSE f.h || coalesce(w.h, '') END), f.top FROM f LEFT JOIN w ON w.doc_id = f.doc_id AND w.l = f.l WHERE f.l < f.top)
SELECT p.doc_id, p.leaf, p.subroot, p.root, coalesce(k.proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = p.root AS verified
FROM p LEFT JOIN k ON k.doc_id = p.doc_id JOIN f ON f.doc_id = p.doc_id AND f.l = f.top
"""
