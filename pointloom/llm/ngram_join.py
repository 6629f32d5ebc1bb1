"""N-gram Jaccard join by vertical partitioning: the global order of n-grams is cut into fragments, what two documents
share is counted in each fragment separately, and the partial overlaps are summed per pair.

Documents with equal sets are one class. Classes go through filters that lose no link:

1. A filter of the places that two or more n-grams fall on, over one fragment (a quarter of the order) of the whole
   corpus: a class with too few of its n-grams in it can't reach the threshold.
2. Rounds over all fragments: an n-gram counts for a class only if another class of a size that may link with it
   has it too; sums per class over the fragments bound the size of its partners. Classes without any drop out.
3. Candidates by a prefix filter: with the useful n-grams in a common order, rare ones first, classes that link share
   one of the first (useful - least overlap + 1), and at the first that they share enough n-grams are left in both.

Candidates meet in cells, cut into fragments: a task has one cell's sets in one fragment, counts the partial overlaps of
its pairs there, and the sums per pair decide. Near copies in large numbers aren't paired with each other: first every
class is paired with leaders only, components are formed, and then only candidates in different components are verified.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions.keys import unknown_key
from pointloom.llm import words as W
from pointloom.llm.components import components
from pointloom.llm.exact_dedup import _filter_size, _two_places, repeated_places
from pointloom.llm.names import hide
from pointloom.llm.storage import discard, materialise

#: N-grams of one fragment at most, about; and the least number of fragments.
FRAGMENT_GRAMS = 1_000_000
FRAGMENTS = 16
#: Fragments that candidates' overlaps are counted in.
PARTS = 8
#: Pairs and n-grams of one cell, about; a cell's sets are cut into PARTS.
CELL_PAIRS, CELL_GRAMS = 50_000, 2_000_000
#: N-grams of a prefix that go along with each of its rows.
HEAD = 8
#: N-grams that a task cuts or looks up at once, about.
AT_ONCE = 1 << 18
ROUNDS = 2


def least_share(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of a set of n with any set that links: percent / 100 of n, rounded up."""
    return -(-percent * n // 100)


def largest_partner(overlap: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """The most members of a set that links with one of n members by at most `overlap` common ones."""
    return (100 + percent) * overlap // percent - n


def gram_sets(t: W.Texts, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct n-gram hashes of each text in ascending order, end to end; the texts' bounds among them).

    A text with fewer words has its whole sequence as its one n-gram; a text without words has none.
    """
    h = t.hashes()
    grams, inside = W.window_hashes(h, words), W.inside_one_text(t, words)
    doc = t.word_doc()[: len(grams)]
    grams, doc = grams[inside], doc[inside]
    short = np.flatnonzero((t.n_words > 0) & (t.n_words < words))
    if len(short):
        whole = W.mix(W.span_hashes(h, t.first[short], t.first[short + 1]) + np.uint64(words))
        grams, doc = np.concatenate([grams, whole]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        grams, doc = grams[order], doc[order]
    cuts = np.searchsorted(doc, np.arange(len(t.bounds)))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        grams[a:b].sort()
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[new], doc[new]
    return grams, np.searchsorted(doc, np.arange(len(t.bounds)))


def _classes(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set."""
    return W.span_hashes(grams, bounds[:-1], bounds[1:]).view(np.int64)


def class_sizes(docs: DataFrame, words: int) -> DataFrame:
    """docs' columns but text, with class (a digest of the set) and n_shingles."""
    own = [c for c in docs.columns if c != "text"]
    docs = docs.select(*own, "text")
    schema = docs.select(own).schema.add("class", "long").add("n_shingles", "long")

    def measure(batches):
        for batch in batches:
            for a, b, t in W.chunks(batch.column("text"), lower=True):
                grams, bounds = gram_sets(t, words)
                yield pa.RecordBatch.from_arrays([*batch.select(own).slice(a, b - a).columns, pa.array(_classes(grams, bounds)), pa.array(np.diff(bounds))], [*own, "class", "n_shingles"])

    return docs.mapInArrow(measure, schema)


QUARTER = np.uint64(1 << 62)


def possible_classes(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(class, n, grams) of the classes that filter 1 leaves, one row each."""
    spark = docs.sparkSession

    def first_quarter(batch):
        for _, _, t in W.chunks(batch.column("text"), lower=True):
            grams, _ = gram_sets(t, words)
            yield grams[grams < QUARTER]

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = _filter_size(size // 64)  # a quarter of the words, of about six bytes each: five bits for each
    maps = spark.sparkContext.broadcast(repeated_places(docs.select("text"), bits, first_quarter))

    def pick(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, _, t in W.chunks(batch.column("text"), lower=True):
                grams, bounds = gram_sets(t, words)
                n = np.diff(bounds)
                early = grams < QUARTER
                hit = early.copy()
                for bitmap, p in zip(maps.value, _two_places(grams.view(np.int64), bits), strict=True):
                    hit &= (bitmap[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
                missing = np.concatenate([[0], np.cumsum(early & ~hit)])
                stays = (missing[bounds[1:]] - missing[bounds[:-1]] <= n - least_share(n, percent)) & (n > 0)
                out = []
                for i, c in enumerate(_classes(grams, bounds).tolist()):
                    if stays[i] and c not in seen:
                        seen.add(c)
                        out.append((c, int(n[i]), grams[bounds[i] : bounds[i + 1]].tobytes()))
                if out:
                    c, m, g = zip(*out, strict=True)
                    yield pa.RecordBatch.from_pydict({"class": pa.array(c, pa.int64()), "n": pa.array(m, pa.int64()), "grams": pa.array(g, pa.binary())})

    found = docs.select("text").mapInArrow(pick, "class long, n long, grams binary")
    classes = materialise(found.dropDuplicates(["class"]), "classes")
    maps.destroy()  # or workers keep it for later stages
    return classes


def _fragments(alive: DataFrame, count: int) -> DataFrame:
    """The n-grams by fragment: (fragment, grams, owner, class, n, lo, hi), arrays as bytes, some rows of `alive` each."""

    def cut(batches):
        for whole in batches:
            sizes = np.cumsum(whole.column("n").to_numpy())
            bounds = [0, *(np.flatnonzero(np.diff(sizes // AT_ONCE)) + 1).tolist(), len(whole)]
            for a, b in zip(bounds, bounds[1:]):
                yield from cut_rows(whole.slice(a, b - a))

    def cut_rows(batch):
        raw = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("grams")]
        if not raw:
            return
        grams, owner = np.concatenate(raw), np.repeat(np.arange(len(raw), dtype=np.uint32), [len(x) for x in raw])
        fragment = (grams >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)
        order = np.argsort(fragment, kind="stable")
        cuts = np.searchsorted(fragment[order], np.arange(count + 1))
        table = {c: batch.column(c).to_numpy() for c in ("class", "n", "lo", "hi")}
        for f in np.flatnonzero(np.diff(cuts)).tolist():
            at = order[cuts[f] : cuts[f + 1]]
            used, local = np.unique(owner[at], return_inverse=True)
            columns = {"fragment": pa.array([f], pa.int32()), "grams": [grams[at].tobytes()], "owner": [local.astype(np.uint32).tobytes()]}
            yield pa.RecordBatch.from_pydict(columns | {c: [x[used].tobytes()] for c, x in table.items()})

    return alive.mapInArrow(cut, "fragment int, grams binary, owner binary, class binary, n binary, lo binary, hi binary")


def _useful(pdf: pd.DataFrame) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Of one fragment: (the classes' columns, n-grams, their owners, whether another class of a fitting size has it)."""
    table = {c: np.concatenate([np.frombuffer(x, np.int64) for x in pdf[c]]) for c in ("class", "n", "lo", "hi")}
    grams = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["grams"]])
    sizes = [len(x) // 8 for x in pdf["class"]]
    before = np.cumsum(sizes) - sizes
    owner = np.concatenate([np.frombuffer(x, np.uint32).astype(np.int64) + b for x, b in zip(pdf["owner"], before, strict=True)])
    rank = np.unique(grams, return_inverse=True)[1].astype(np.int64)
    by_size, place = np.unique(np.concatenate([table["n"], table["lo"], table["hi"] + 1]), return_inverse=True)
    n, lo, above = np.split(place, 3)
    wide = len(by_size) + 1
    key = rank * wide
    held = np.sort(key + n[owner])
    others = np.searchsorted(held, key + above[owner]) - np.searchsorted(held, key + lo[owner])
    others -= (table["n"] <= table["hi"])[owner]
    return table, grams, owner, others > 0


def order_keys(grams: np.ndarray) -> np.ndarray:
    """The place of each n-gram in the common order: by how many have it (in powers of four), then by its hash."""
    _, inverse, counts = np.unique(grams, return_inverse=True, return_counts=True)
    often = np.frexp(counts.astype(float))[1].astype(np.uint64) >> np.uint64(1)
    return (often[inverse] << np.uint64(58) | grams >> np.uint64(6)).view(np.int64)


def prune(classes: DataFrame, percent: int) -> tuple[DataFrame, int]:
    """Filter 2: (class, n, grams, lo, hi, useful) of the classes that may have partners, and the fragments' number."""

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        table, _, owner, good = _useful(pdf)
        shared = pd.DataFrame({"_c": table["class"], "part": np.bincount(owner, good, len(table["class"])).astype(np.int64)})
        return shared.groupby("_c", as_index=False).sum()

    alive = classes.withColumns({"lo": F.expr(f"(n * {percent} + 99) div 100"), "hi": F.expr(f"n * 100 div {percent}")})
    total = classes.agg(F.sum("n")).first()[0] or 0
    fragments = max(FRAGMENTS, total // FRAGMENT_GRAMS)
    rows, held = None, classes
    for _ in range(ROUNDS):
        parts = _fragments(alive, fragments).groupBy("fragment").applyInPandas(count, "_c long, part long")
        sums = parts.groupBy("_c").agg(F.sum("part").alias("useful"))
        joined = alive.drop("useful").join(sums.hint("merge"), F.col("class") == F.col("_c")).drop("_c")
        bounded = joined.withColumn("hi", F.least("hi", F.expr(f"useful * {100 + percent} div {percent} - n")))
        alive = materialise(bounded.filter("hi >= lo AND useful >= lo"), "alive")
        discard(held)
        held = alive
        left = alive.count()
        if left in (rows, 0):
            break
        rows = left
    return alive, fragments


def prefixes(alive: DataFrame, fragments: int) -> DataFrame:
    """Filter 3: (class, n, lo, hi, rare, useful, prefix), prefix being an array of n-grams' places in the common order; rare
    counts the n-grams that are not useful."""

    def list_useful(pdf: pd.DataFrame) -> pd.DataFrame:
        table, grams, owner, good = _useful(pdf)
        keys = order_keys(grams)
        own, g = table["class"][owner[good]], keys[good]
        order = np.argsort(own, kind="stable")
        own, g = own[order], g[order]
        cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
        return pd.DataFrame({"_c": own[cuts], "part": [x.tolist() for x in np.split(g, cuts[1:])] if len(own) else []})

    parts = _fragments(alive, fragments).groupBy("fragment").applyInPandas(list_useful, "_c long, part array<long>")
    whole = parts.groupBy("_c").agg(F.sort_array(F.flatten(F.collect_list("part"))).alias("grams"))
    joined = alive.select("class", "n", "lo", "hi").join(whole, F.col("class") == F.col("_c")).withColumn("useful", F.size("grams").cast("long"))
    out = joined.filter("useful >= lo").select("class", "n", "lo", "hi", (F.col("n") - F.col("useful")).alias("rare"), "useful", F.expr("slice(grams, 1, cast(useful - lo + 1 AS int))").alias("prefix"))
    return materialise(out, "prefixes")


def _fit(a: str, b: str, percent: int) -> Column:
    """Whether sizes allow two classes a link, and enough useful n-grams are left from their common one on."""
    sizes = F.expr(f"{a}.n BETWEEN {b}.lo AND {b}.hi AND {b}.n BETWEEN {a}.lo AND {a}.hi")
    left = F.expr(f"least({a}.useful - {a}.pos, {b}.useful - {b}.pos) * {100 + percent} >= {percent} * ({a}.n + {b}.n)")
    return sizes & left


def _counted(links: pd.DataFrame, sets: pd.DataFrame, percent: int) -> pd.DataFrame:
    """(u, v, nu, nv, common): one cell's partial overlaps in one fragment.

    Pairs whose members differ more here than linked ones do in all are left out: their sums fall short anyway.
    """
    place = {c: i for i, c in enumerate(sets["class"].tolist())}
    grams = [np.frombuffer(g, np.uint64) for g in sets["grams"]]
    size = np.array([len(g) for g in grams])
    flat = np.concatenate(grams)
    # Numbers of the n-grams and, as one sorted list, (member, number) of all sets.
    number = np.unique(flat, return_inverse=True)[1].astype(np.int64)
    wide = int(number.max()) + 1
    held = np.repeat(np.arange(len(grams)), size) * wide + number
    first = np.cumsum(size) - size
    u, v = (np.array([place[x] for x in links[c].tolist()]) for c in ("u", "v"))
    small, large = np.where(size[u] <= size[v], u, v), np.where(size[u] <= size[v], v, u)
    common = np.zeros(len(links), np.int64)
    step = max(1, AT_ONCE // max(1, int(size.max())))
    for at in range(0, len(links), step):
        s, t = small[at : at + step], large[at : at + step]
        asked = number[W.flat_ranges(first[s], size[s])] + np.repeat(t, size[s]) * wide
        found = np.searchsorted(held, asked)
        hit = held[np.minimum(found, len(held) - 1)] == asked
        common[at : at + step] = np.bincount(np.repeat(np.arange(len(s)), size[s]), hit, len(s))
    total = (links["nu"] + links["nv"]).to_numpy()
    allowed = total - 2 * -(-percent * total // (100 + percent))
    out = links.assign(common=common)[["u", "v", "nu", "nv", "common"]]
    return out[(common > 0) & (size[u] + size[v] - 2 * common <= allowed)]


def verified(pairs: DataFrame, alive: DataFrame, percent: int) -> DataFrame | None:
    """Of pairs (u, v, nu, nv, near) those (u, v) whose overlaps, summed over the fragments, reach the threshold; None without pairs.

    Pairs with one `near` have members in common, so they go to one cell, and a class is sent once to each cell that
    has pairs of it, not once for each of its pairs. A `near` of more than CELL_PAIRS pairs is split by a hash of u.
    """
    sizes = pairs.groupBy(F.col("near").alias("_near")).agg(F.ceil(F.count(F.lit(1)) / CELL_PAIRS).alias("_split"))
    split = pairs.join(sizes, F.col("near") == F.col("_near")).select("u", "v", "nu", "nv", F.xxhash64("near", F.pmod(F.xxhash64("u"), F.col("_split"))).alias("near"))
    split = materialise(split, "split")
    discard(pairs)
    found = split.agg(F.count(F.lit(1)), F.sum(F.col("nu") + F.col("nv"))).first()
    if not found[0]:
        return None
    cells = max(1, found[0] // CELL_PAIRS, min(found[1], alive.agg(F.sum("n")).first()[0]) // CELL_GRAMS)
    celled = split.withColumn("cell", F.pmod("near", F.lit(cells)))
    wanted = celled.select("cell", F.col("u").alias("_w")).unionAll(celled.select("cell", F.col("v").alias("_w"))).distinct()
    members = wanted.join(alive.select("class", "grams").hint("merge"), F.col("_w") == F.col("class")).select(F.col("cell").alias("at"), "class", "grams")
    edges = np.arange(1, PARTS, dtype=np.uint64) * np.uint64((1 << 64) // PARTS)

    def cut(batches):
        for batch in batches:
            rows, parts, grams = [], [], []
            for i, x in enumerate(batch.column("grams")):
                own = np.frombuffer(x.as_buffer(), np.uint64)
                bounds = [0, *np.searchsorted(own, edges).tolist(), len(own)]
                rows += [i] * PARTS
                parts += range(PARTS)
                grams += [own[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
            taken = batch.select(["at", "class"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(parts, pa.int32()), pa.array(grams, pa.binary())], ["at", "class", "part", "grams"])

    fragments = members.mapInArrow(cut, "at long, class long, part int, grams binary").filter(F.octet_length("grams") > 0)
    links = celled.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))

    def count(links: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        here = set(sets["class"].tolist())
        links = links[links["u"].isin(here) & links["v"].isin(here)]
        if not len(links):
            return pd.DataFrame({"u": [], "v": [], "nu": [], "nv": [], "common": []}, dtype=np.int64)
        return _counted(links, sets, percent)

    partial = links.groupBy("cell", "fragment").cogroup(fragments.groupBy("at", "part")).applyInPandas(count, "u long, v long, nu long, nv long, common long")
    sums = partial.groupBy("u", "v", "nu", "nv").agg(F.sum("common").alias("common"))
    out = materialise(sums.filter(f"100 * common >= {percent} * (nu + nv - common)").select("u", "v"), "links")
    discard(split)
    return out


def _labelled(prefix: DataFrame, groups: DataFrame) -> DataFrame:
    """prefix with `label`, the least class of its component so far."""
    g = groups.select(F.col("u").alias("_u"), F.col("v").alias("_v"))
    return prefix.join(g, F.col("class") == F.col("_u"), "left").withColumn("label", F.coalesce("_v", "class")).drop("_u", "_v")


def _across(rows: DataFrame) -> DataFrame:
    """rows (gram, label, ...) of the n-grams that classes of different components have."""
    mixed = rows.groupBy(F.col("gram").alias("_g")).agg(F.min("label").alias("_least"), F.max("label").alias("_most")).filter("_least <> _most")
    return rows.join(mixed.select("_g"), F.col("gram") == unknown_key(F.col("_g"))).drop("_g")


def _listed(prefix: DataFrame, groups: DataFrame, first: int | None = None) -> DataFrame:
    """A row for each of the first n-grams of every prefix (all of them by default), with its place `pos` among the useful."""
    taken = F.slice("prefix", 1, first) if first else F.col("prefix")
    return _labelled(prefix, groups).select("class", "n", "lo", "hi", "rare", "useful", "label", F.slice("prefix", 1, HEAD).alias("head"), F.posexplode(taken).alias("pos", "gram"))


def _joined(groups: DataFrame, links: DataFrame | None) -> DataFrame:
    """The groups that further links make of groups; both are then discarded."""
    if links is None:
        return groups
    out = components(groups.unionByName(links))
    discard(groups, links)
    return out


def link_classes(alive: DataFrame, prefix: DataFrame, percent: int) -> DataFrame:
    """(u, v): each class u that isn't the least of its component, and the least, v."""
    spark = alive.sparkSession
    groups = spark.createDataFrame([], "u long, v long")
    fields = "class", "n", "lo", "hi", "useful", "pos"
    best = F.min(F.struct("rare", *fields))
    u, v = F.greatest("x.class", "y.class").alias("u"), F.least("x.class", "y.class").alias("v")
    nu = F.expr("if(x.class > y.class, x.n, y.n)").alias("nu")
    nv = F.expr("if(x.class > y.class, y.n, x.n)").alias("nv")
    for first in (4, None):
        # Leaders: of each n-gram, the class with the fewest n-grams of its own; others of the n-gram are paired with it.
        rows = _across(_listed(prefix, groups, first).drop("head"))
        leads = rows.groupBy(F.col("gram").alias("_g")).agg(best.alias("y"))
        if first is None:  # one class for each component of an n-gram
            rows = rows.groupBy("gram", "label").agg(best.alias("x")).select("gram", "label", "x.*")
        pairs = rows.alias("x").join(leads, F.col("gram") == unknown_key(F.col("_g"))).filter(F.col("x.class") != F.col("y.class")).filter(_fit("x", "y", percent))
        pairs = pairs.select(u, v, nu, nv, F.col("y.class").alias("near")).groupBy("u", "v", "nu", "nv").agg(F.min("near").alias("near"))
        groups = _joined(groups, verified(materialise(pairs, "pairs"), alive, percent))
    rows = materialise(_across(_listed(prefix, groups)), "across")
    x, y = rows.alias("x"), rows.alias("y")
    # A pair with a common n-gram among both heads is made at the first of these only, another at each common one.
    on = (F.col("x.gram") == F.col("y.gram")) & (F.col("x.label") < F.col("y.label")) & _fit("x", "y", percent)
    on = on & (F.coalesce(F.get(F.array_intersect("x.head", "y.head"), 0), F.col("x.gram")) == F.col("x.gram"))
    pairs = x.join(y, on).select(u, v, nu, nv, F.col("x.gram").alias("near")).groupBy("u", "v", "nu", "nv").agg(F.min("near").alias("near"))
    pairs = materialise(pairs, "pairs")
    discard(rows)
    return _joined(groups, verified(pairs, alive, percent))


def _labels(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """docs' columns but text, with n_shingles and label, the least class of the document's component."""
    measured = materialise(class_sizes(docs, words), "sets")
    alive, fragments = prune(possible_classes(docs, words, percent), percent)
    if alive.isEmpty():
        groups = docs.sparkSession.createDataFrame([], "u long, v long")
    else:
        prefix = prefixes(alive, fragments)
        groups = link_classes(alive, prefix, percent)
        discard(prefix)
    discard(alive)
    groups = groups.select(F.col("u").alias("_u"), F.col("v").alias("_v"))
    return measured.join(groups, F.col("class") == F.col("_u"), "left").withColumn("label", F.coalesce("_v", "class")).drop("_u", "_v", "class")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs' columns but text, with n_shingles and component_id.

    A-Z are lower-cased. A document's set holds its distinct n-grams of `words` words; a shorter text has its whole
    sequence as the one n-gram; a null text or one without words has none and links with nothing. Two documents
    link when 100 * intersection >= percent * union. component_id is the least doc_id that links reach, null
    doc_ids not counted (null if there is no other). A document without words has its own doc_id. Repeated rows
    link with each other. An empty table gives an empty result. Other columns stay, whatever their names; those named
    like the added are replaced.
    """
    hidden, show = hide(docs, ("doc_id", "text"), ("n_shingles", "component_id"))
    labelled = _labels(hidden, words, percent)
    least = labelled.filter("n_shingles > 0").groupBy(F.col("label").alias("_l")).agg(F.min("doc_id").alias("_d"))
    out = labelled.join(least, (F.col("label") == unknown_key(F.col("_l"))) & (F.col("n_shingles") > 0), "left")
    return show(out, "n_shingles", F.when(F.col("n_shingles") > 0, F.col("_d")).otherwise(F.col("doc_id")).alias("component_id"), less=["text"])


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs without all but one row of each component: the one with the least doc_id (a null one only if all are).

    Texts without words stay, each of them. docs must read the same on every pass, as a table does.
    """
    numbered, show = hide(docs, ("doc_id", "text"), (), F.monotonically_increasing_id().alias("_pl_row"))
    labelled = _labels(numbered.select("_pl_row", "doc_id", "text"), words, percent).filter("n_shingles > 0")
    first = labelled.groupBy(F.col("label").alias("_l")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_pl_row")).alias("_first"), F.count(F.lit(1)).alias("_n"))
    gone = labelled.join(first.filter("_n > 1"), F.col("label") == unknown_key(F.col("_l"))).filter("_pl_row <> _first._pl_row").select(F.col("_pl_row").alias("_gone"))
    return show(numbered.join(gone, F.col("_pl_row") == F.col("_gone"), "left_anti"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, words=4, percent=85).select("doc_id", "n_shingles", "component_id")
