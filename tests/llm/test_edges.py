"""Every operator on tables that are odd: clashing names, texts without words, patterned words, whole queries."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import brute
import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pointloom.llm import exact_dedup, language_id, mixing, mixing_coder, ngram_join, packing, quality_classifier, quality_rules, registry, release, secrets, sharding, storage, substring_dedup, token_output, tokens
from pointloom.llm import words as W

SCORER = quality_classifier.Model(np.zeros(quality_classifier.OWN + 2 * quality_classifier.NEAR), np.zeros((2, 2)), 1.0, 0.5, 0.5)

SPEAKER = language_id.fit([("en", np.ones((1, language_id.SLOTS), np.float32))], np.ones(language_id.SLOTS, np.float32))

#: Operator: (call, columns added, whether every row stays once).
OPERATORS = {
    "near_duplicates": (ngram_join.near_duplicates, {"n_shingles", "component_id"}, True),
    "drop_near_duplicates": (ngram_join.drop_near_duplicates, set(), False),
    "judge": (quality_rules.judge, {*quality_rules.FEATURES, "base_failed", "kept"}, True),
    "keep_good": (quality_rules.keep_good, set(), False),
    "secret_spans": (secrets.secret_spans, {f.name for f in secrets._FIELDS}, True),
    "shard_documents": (sharding.shard_documents, set(sharding.ADDED), True),
    "pack_documents": (packing.pack_documents, {*packing.ADDED, "sequence_id", "offset"}, False),
    "pack_in_order": (packing.pack_in_order, {*packing.ADDED, "sequence_id", "offset"}, False),
    "cut_documents": (packing.cut_documents, set(packing.ADDED), False),
    "remove_repeats": (substring_dedup.remove_repeats, {"n_words", "n_removed", "kept_text", "removed"}, True),
    "exact_duplicates": (exact_dedup.exact_duplicates, {"keep_id", "group_size", "kept", "text_sha256"}, True),
    "drop_duplicates": (exact_dedup.drop_duplicates, set(), False),
    "score": (lambda docs: quality_classifier.score(docs, SCORER), {"score", "predicted"}, True),
    "identify": (lambda docs: language_id.identify(docs, SPEAKER), {"lang_pred", "score", "rejected"}, True),
    "replay": (lambda docs: release.replay(docs.withColumn("conv_id", F.lit(1)).withColumn("turn", F.col("doc_id"))), {"conv_id", "turn", *release.ADDED}, True),
    "mix": (mixing.mix, set(mixing.ADDED), True),
    "positions": (lambda docs: mixing.positions(mixing.mix(docs)), {*mixing.ADDED, "mix_pos"}, True),
    "interleave": (mixing.interleave, set(), True),
}


def internal_names():
    """All names in the package's strings, which are those of its own columns and more."""
    found = {}
    for path in Path(ngram_join.__file__).parent.glob("*.py"):
        for x in re.findall(r"[\"']([A-Za-z_]\w*)[\"']", path.read_text()):
            found.setdefault(x.lower(), x)
    return [x for k, x in sorted(found.items()) if k not in ("doc_id", "text", "lang", "source")] + ["a b", "dotted.name", "tick`ed", "_own0", "_own7"]


@pytest.fixture(scope="module")
def clashing(spark, tmp_path_factory):
    texts = [" ".join(f"w{(i // 2) * 7 + j}" for j in range(50)) + (" end" if i % 2 else "") for i in range(6)] + ["", None, "short"]
    extra = internal_names()
    rows = [(i, t, "en", f"s{i % 2}") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    path = str(tmp_path_factory.mktemp("clash") / "documents.parquet")
    df.select("*", *[(F.col("doc_id") * 1000 + i).alias(c) for i, c in enumerate(extra)]).write.parquet(path)
    return spark.read.parquet(path), extra


@pytest.mark.parametrize("name", OPERATORS)
def test_every_internal_name_may_be_a_column(clashing, name):
    docs, extra = clashing
    call, added, all_rows = OPERATORS[name]
    out = call(docs)
    stays = [(i, c) for i, c in enumerate(extra) if c.lower() not in {a.lower() for a in added}]
    assert [c for c in out.columns if c not in added] == [c for c in docs.columns if c not in added and (c != "text" or c in out.columns)]
    rows = out.collect()
    assert rows and (not all_rows or len(rows) == 9)
    for r in rows:
        assert all(r[c] == r["doc_id"] * 1000 + i for i, c in stays)


@pytest.mark.parametrize("name", OPERATORS)
def test_nothing_in_nothing_out(nothing, name):
    assert OPERATORS[name][0](nothing).count() == 0


TABLES = {
    "blank": [(1, ""), (2, None), (3, " \n\t "), (4, "")],
    "null": [(1, None), (2, None), (None, None)],
    "short": [(i, " ".join(f"{i}x{j}" for j in range(12))) for i in range(12)],
    "mixed": [(1, ""), (2, " ".join(f"a{i}" for i in range(60))), (3, None), (4, " ".join(f"a{i}" for i in range(60))), (5, "one"), (6, "one")],
}


@pytest.mark.parametrize("table", TABLES)
def test_partitions_without_words(spark, tmp_path, table):
    """One file a row, each a partition of its own: tasks without a word, an n-gram or a window."""
    rows = TABLES[table]
    for i, (d, t) in enumerate(rows):
        spark.createDataFrame([(d, t, "en", "s", len(t or ""))], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    held = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "256m")
    try:
        docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
        assert docs.rdd.getNumPartitions() == len(rows)
        near = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs).collect())
        assert near == Counter((d, *x) for (d, _), x in zip(rows, brute.jaccard_components(rows, 5, 80)))
        cut = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(docs).collect())
        assert cut == Counter((d, *x[:2]) for (d, _), x in zip(rows, brute.without_repeats([t for _, t in rows], 35)))
        best = brute.keepers(rows)
        assert Counter((r["doc_id"], r["keep_id"]) for r in exact_dedup.exact_duplicates(docs).collect()) == Counter((d, best[t or ""][0]) for d, t in rows)
        for name in ("judge", "secret_spans", "shard_documents", "mix", "score"):
            assert OPERATORS[name][0](docs).count() == len(rows)
        assert corpus_pipeline.run(spark, str(tmp_path)).count() == {"short": 24, "mixed": 0}.get(table, 0) or table in ("short", "mixed")
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", held)


def patterned(n):
    """Two Thue-Morse words: they differ, and any polynomial modulo a power of two confuses them once they are long."""
    x, y = "a", "b"
    while len(x) < n:
        x, y = x + y, y + x
    return x, y


def test_patterned_words_are_told_apart(spark, tmp_path):
    x, y = patterned(1024)
    base = [f"k{i}" for i in range(30)]
    lines = "\n".join([x, y, x])
    sequence = [" ".join(w) for w in patterned(4096)]
    rows = list(enumerate([" ".join([*base, x]), " ".join([*base, y]), x, y, lines, *sequence, x + " " + y, y + " " + x]))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    for words, percent in ((4, 85), (2, 50)):
        got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs, words, percent).collect())
        assert got == Counter((d, *z) for (d, _), z in zip(rows, brute.jaccard_components(rows, words, percent)))
    texts = pa.array([t for _, t in rows])
    found = quality_rules.text_features.func(texts).to_pylist()
    for (_, t), f in zip(rows, found):
        assert (f["n_words"], f["word_chars"], f["n_symbols"], f["n_dup_lines"], f["n_repeat_words"]) == brute.quality(t)[:5]
    library = tokens.encoder(tokens.vocabulary_path()).library
    for a, b, flat, bounds in tokens.encode(texts, tokens.vocabulary_path()):
        for i in range(a, b):
            assert flat[bounds[i - a] : bounds[i - a + 1]].tolist() == [*library.encode(rows[i][1], add_special_tokens=False).ids, 2]
    cut = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(docs).collect())
    assert cut == Counter((d, *z[:2]) for (d, _), z in zip(rows, brute.without_repeats([t for _, t in rows], 35)))


def test_hash_is_of_the_bytes_alone():
    """The same at every offset, for every length around the blocks and groups; no two of many texts collide."""
    r = np.random.default_rng(1)
    base = r.integers(0, 256, 5000).astype(np.uint8)
    for n in (0, 1, 7, 8, 9, 255, 256, 257, 513, 5000):
        seen = set()
        for off in range(9):
            data = np.concatenate([r.integers(0, 256, off).astype(np.uint8), base[:n], r.integers(0, 256, 3).astype(np.uint8)])
            seen.add(int(W.span_hashes(data, np.array([off]), np.array([off + n]))[0]))
        assert len(seen) == 1
    bits = np.unpackbits(np.arange(1 << 16, dtype=">u2").view(np.uint8)).reshape(-1, 16) + 97
    starts = np.arange(len(bits)) * 16
    assert len(np.unique(W.span_hashes(bits.astype(np.uint8).ravel(), starts, starts + 16))) == len(bits)


def test_secrets_of_a_text_full_of_them_take_linear_time():
    import time

    def seconds(n):
        text = pa.array(["é deadbeef00112233 " * n])
        began = time.process_time()
        out = secrets.find_secrets.func(text).to_pylist()[0]
        assert out["n_hex"] == n and out["spans"].endswith(f":{19 * n - 1 - 16}:{19 * n - 1}")
        return time.process_time() - began

    seconds(100)
    assert seconds(40_000) < 8 * max(seconds(10_000), 0.05)


def test_added_rules_find_their_kinds():
    texts = ["x xoxb-123456789012-abcdefghijkl y", "AIza" + "a1B2_" * 8, "sk_live_" + "a1" * 12, "glpat-" + "x_" * 12, "ghp_" + "A1" * 20, "AIza short", "glpat-x"]
    got = [x["spans"] for x in secrets.find_secrets.func(pa.array(texts)).to_pylist()]
    assert [k in g for k, g in zip(("slack", "google", "stripe", "gitlab", "github"), got)] == [True] * 5
    assert "google" not in got[5] and "gitlab" not in got[6]
    assert len(secrets.scanner().accept) < 1000  # states; runs of many rules would multiply them


def test_blend_beats_order_0():
    """The three predictions together need fewer bits an id than the frequencies alone can."""
    r = np.random.default_rng(2)
    words = [r.integers(0, 3000, 3) for _ in range(800)]
    ids = np.concatenate([words[min(int(z), 799)] for z in r.zipf(1.2, 60_000)])
    p = np.bincount(ids) / len(ids)
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum()
    assert len(mixing_coder.encode_block(ids, 49408)) * 8 / len(ids) < 0.8 * entropy


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="checkpoint"):
        storage.shared_dir(Session())


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    own = [(d, t, ("en", "de")[i % 2], f"s{i % 5 and 1}", len(t or "")) for i, (d, t) in enumerate({d: t for d, t in rows if d is not None}.items())]
    spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{path}/documents.parquet")
    bad = lambda t: bool(t and ("***" in t or " | " in t or "!!" in t or t.startswith("line one")))
    spark.createDataFrame([(d, int(not bad(t)), 0) for d, t, *_ in own], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), own


def sequences_are_sound(got):
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in by.values():
        assert len(x) == 1 and x[0][0] == 0 and x[0][1] <= 4096 and x[0][1] & (x[0][1] - 1) == 0


@pytest.mark.parametrize("name", [q for q in registry.queries() if not q.startswith(("op11_", "op12_", "op13_"))])  # tested beside their operators
def test_query_is_the_brute_force(spark, folder, name):
    """Every registered query over its whole tables, against plain code."""
    path, own = folder
    pairs = [(d, t) for d, t, *_ in own]
    df = registry.queries()[name](spark, path)
    got = df.collect()
    by = {r["doc_id"]: r for r in got}
    if name != "op5_packing":
        assert len(got) == len(own) == len(by)
    library = tokens.encoder(tokens.vocabulary_path()).library
    if name.startswith("op1_"):
        assert [(by[d]["n_shingles"], by[d]["component_id"]) for d, _ in pairs] == brute.jaccard_components(pairs, 4, 85)
    elif name.startswith("op2_"):
        kept = brute.kept_by_quality(own)
        for d, t in pairs:
            r = by[d]
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute.quality(t)
            assert r["kept"] == kept[d]
    elif name.startswith("op3_"):
        for d, t in pairs:
            found = brute.secrets(t)
            assert by[d]["base_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest() and (by[d]["n_assign"], by[d]["n_access"], by[d]["n_hex"]) == tuple(sum(x.startswith(k) for x in found) for k in ("assign", "access", "hex"))
    elif name.startswith("op4_"):
        load, slots = Counter(), defaultdict(list)
        for d, t in pairs:
            r = by[d]
            assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "bytes", None)
            load[r["shard"]] += r["size"]
            slots[r["shard"]].append(r["slot"])
        assert set(load) <= set(range(16)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
        assert max(load.values()) <= max(1.1 * sum(load.values()) / 16, max(r["size"] for r in got) + 200)
    elif name.startswith("op5_"):
        want = Counter()
        for d, t in pairs:
            ids, at = [*library.encode(t or "", add_special_tokens=False).ids, 2], 0
            for n in packing.binary_lengths(len(ids)):
                want[d, at, n, brute.crc(ids[at : at + n]), len(ids)] += 1
                at += n
        assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
        assert sorted(r["sequence_id"] for r in got) == list(range(len(got)))
        sequences_are_sound(got)
    elif name.startswith("op6_"):
        assert [(by[d]["n_words"], by[d]["n_removed"], by[d]["kept_sha256"]) for d, _ in pairs] == brute.without_repeats([t for _, t in pairs], 35)
    elif name.startswith("op7_"):
        best = brute.keepers(pairs)
        for d, t in pairs:
            assert (by[d]["keep_id"], by[d]["group_size"], by[d]["kept"], by[d]["text_sha256"]) == (*best[t or ""], best[t or ""][0] == d, hashlib.sha256((t or "").encode()).hexdigest())
    elif name.startswith("op8_"):
        for d, _ in pairs:
            r = by[d]
            assert r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    elif name.startswith("op9_"):
        at = 0
        for d, t in sorted(pairs):
            ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
            assert (by[d]["start"], by[d]["n_tokens"], by[d]["ids_crc32"]) == (at, len(ids), brute.crc(ids))
            at += len(ids)
    else:
        place = brute.mixed([(s, len(list(g))) for s, g in brute.grouped(own)], mixing.BLOCK_ROWS, mixing.TEMPERATURE)
        sources = {d: s for d, _, _, s, _ in own}
        assert sorted(r["mix_pos"] for r in got) == list(range(len(got)))
        blocks = defaultdict(list)
        for r in sorted(got, key=lambda r: r["mix_pos"]):
            assert r["source"] == sources[r["doc_id"]] and r["mix_release"] <= r["mix_slot"] < r["mix_deadline"]
            blocks[r["mix_slot"], r["source"], r["mix_block"]].append(r["mix_pos"])
        assert [(s, b, len(x)) for (_, s, b), x in sorted(blocks.items(), key=lambda x: x[1])] == place
