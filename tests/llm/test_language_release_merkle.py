"""Language, release and manifest operators against plain versions."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pointloom.llm import language_id, merkle, release

DATA = "/root/testdata/sf0.01"


# 11
def test_gram_counts_are_those_of_a_plain_count():
    texts = ["Ab c", "", None, "ÉÉ!!x", "a" * 5000 + " b" * 3000, "1 2", "ſtreet K"]

    def plain(text):
        data = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").lower().encode())
        data = b"".join(bytes([b]) for i, b in enumerate(data) if b != 32 or i == 0 or data[i - 1] != 32)
        counts = np.zeros(language_id.SLOTS)
        for n in language_id.ORDERS:
            for i in range(len(data) - n + 1):
                code = n
                for b in data[i : i + n]:
                    code = (code << 8 ^ b) & 0xFFFFFFFF
                counts[(code * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - language_id.SLOT_BITS)] += 1
        return counts

    got = np.concatenate([c for _, _, c in language_id.gram_counts(pa.array(texts))])
    assert np.array_equal(got, [plain(t) for t in texts])


def test_a_very_long_text_counts_as_its_parts():
    word = "lorem ipsum dolor "
    n = 3 * language_id.CHUNK_BYTES // len(word)
    (_, _, once), (_, _, many) = next(language_id.gram_counts(pa.array([word * 200]))), next(language_id.gram_counts(pa.array([word * n])))
    idf = np.ones(language_id.SLOTS, np.float32)
    assert abs(float(language_id.weighed(once, idf)[0] @ language_id.weighed(many, idf)[0]) - 1) < 1e-3
    assert many.sum() == sum(len(word) * n - k + 1 for k in language_id.ORDERS)


def test_predictions_are_those_of_the_nearest_centroid():
    r = np.random.default_rng(1)
    counts = {lang: r.poisson(lam, (30, language_id.SLOTS)).astype(np.float32) for lang, lam in (("x", np.r_[np.full(200, 3.0), np.zeros(language_id.SLOTS - 200)]), ("y", np.r_[np.zeros(150), np.full(200, 3.0), np.zeros(language_id.SLOTS - 350)]))}
    model = language_id.fit(counts.items(), np.ones(language_id.SLOTS, np.float32))
    assert set(np.bincount(model.language)) <= {1, 2, 3, 4} and np.allclose((model.centroids**2).sum(1), 1, atol=1e-5)
    rows = np.concatenate([*counts.values(), np.eye(language_id.SLOTS, dtype=np.float32)[-1:]])
    found, score, far = model.predict(rows)
    for v, n, s, f in zip(language_id.weighed(rows, model.idf), found, score, far):
        cosines = model.centroids @ v
        best = [max(cosines[model.language == k]) for k in (0, 1)]
        assert best[n] == max(best) and f == (max(cosines) < model.least[cosines.argmax()])
        odds = np.exp(np.array(best) / language_id.TEMPERATURE)
        assert abs(s - odds.max() / odds.sum()) < 1e-6
    assert far[-1] and not far[:-1].all()


def test_language_of_held_out_documents(spark):
    out = language_id.op11_language_id(spark, DATA)
    assert out.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    rows = out.collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert held and np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97


def test_held_out_documents_teach_nothing(spark):
    rows = [(i, t, "fr" if i % 2 else "en") for i, t in enumerate(["the cat and the dog", "le chat et la souris"] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    model = language_id.train(docs)
    assert model.languages == ["en", "fr"]
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !? \n"), (4, "LE CHAT ET"), (5, "the the dog"), (None, "9 the"), (5, "the the dog")], "doc_id long, text string")
    got = Counter((r["doc_id"], r["lang_pred"], r["score"] > 0) for r in language_id.identify(odd, model).collect())
    assert got == Counter({(1, "und", False): 1, (2, "und", False): 1, (3, "und", False): 1, (4, "fr", True): 1, (5, "en", True): 2, (None, "en", True): 1})


def test_nothing_learned_is_unknown(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, "en"), (3, "12", "en")], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert model.languages == []
    assert {(r["doc_id"], r["lang_pred"], r["score"], r["rejected"]) for r in language_id.identify(docs, model).collect()} == {(i, "und", 0.0, True) for i in (1, 2, 3)}


# 12
def plain_replay(rows):
    """{row number: (status, attempts, first_at, last_at, release_no, state)} of (conv_id, turn, text) rows."""
    out, conversations = {}, {}
    for i, (c, t, x) in enumerate(rows):
        conversations.setdefault(c, []).append((t is not None, t, zlib.crc32((x or "").encode()), i))
    for c, turns in conversations.items():
        turns.sort()
        done = []
        for p, (_, t, _, _) in enumerate(turns):
            h = [zlib.crc32(f"{k}:{'' if c is None else c}:{'' if t is None else t}".encode()) for k in range(7)]
            back = h[0] % 7
            parent = done[p - back] if back and p >= back else None
            if parent and parent[0] != "delivered":
                done.append(("blocked", 0, None, None))
                continue
            at = first = max(7 * p, parent[3]) if parent else 7 * p
            for a in range(1, 5):
                if not (h[1] % 101 < 20 and (at < 7 * p + h[2] % 101 or h[a + 2] % 3 == 0)):
                    done.append(("delivered", a, first, at))
                    break
                if a == 4:
                    done.append(("dead", 4, first, at))
                at += 20 * 2 ** (a - 1)
        state = 0
        order = sorted((d[3], x[0], x[1], p) for p, (d, x) in enumerate(zip(done, turns)) if d[0] == "delivered")
        numbers = {}
        for n, (*_, p) in enumerate(order, 1):
            state += n * turns[p][2]
            numbers[p] = (n, state)
        for p, d in enumerate(done):
            out[turns[p][3]] = (*d, *numbers.get(p, (None, None)))
    return out


@pytest.fixture(scope="module")
def turns(spark, tmp_path_factory):
    r = random.Random(11)
    rows = [(c, t, r.choice(["a", "bb", None, "", "é" * 50])) for c in range(30) for t in range(r.randint(1, 12))]
    rows += [(77, t * 3 - 50, f"x{t}") for t in range(150)] + [(None, t, "n") for t in range(9)] + [(78, None, "first"), (78, 1, "q"), (78, 1, "q"), (78, 1, None), (78, -2, "z")]
    r.shuffle(rows)
    path = str(tmp_path_factory.mktemp("turns") / "conversations.parquet")
    df = spark.createDataFrame([(*x, i, i, {"k": i}) for i, x in enumerate(rows)], "conv_id long, turn long, text string, p long, known long, state map<string,long>")
    df.repartition(3).write.parquet(path)
    return rows, spark.read.parquet(path)


@pytest.mark.parametrize("piece, lead", [(release.PIECE, release.LEAD), (6, 0), (10, 4), (16, 64)])
def test_replay(turns, piece, lead):
    rows, df = turns
    out = release.replay(df, piece=piece, lead=lead)
    assert out.columns == ["conv_id", "turn", "text", "p", "known", *release.ADDED]
    got = {r["p"]: r for r in out.collect()}
    want = plain_replay(rows)
    assert len(got) == len(want) == out.count()
    # Rows of one turn have one fate each by place, which identical rows may exchange.
    key = lambda i: rows[i]
    a = Counter((key(i), *[got[i][c] for c in release.ADDED[:-1]]) for i in got)
    assert a == Counter((key(i), *want[i]) for i in want)
    assert all(got[i]["known"] == i for i in got)
    for r in got.values():
        assert (r["blocked_by"] is None) == (r["status"] == "delivered") and (r["status"] != "dead" or r["blocked_by"] == r["turn"])


def test_replay_with_given_rules(turns, spark):
    """A chain without end: each piece waits for the one before it, round by round."""
    df = spark.range(60).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("x").alias("text"))
    path_free = {"back": F.lit(1), "faulty": F.col("turn") == 25, "fails": F.array(*[F.lit(True)] * 4)}
    rows = {r["turn"]: r for r in release.replay(df, path_free, piece=7, lead=3).collect()}
    assert [rows[i]["status"] for i in range(60)] == ["delivered"] * 25 + ["dead"] + ["blocked"] * 34
    assert all(rows[i]["blocked_by"] == 25 for i in range(25, 60)) and rows[24]["release_no"] == 25


def test_replay_of_nothing(turns):
    assert release.replay(turns[1].limit(0)).count() == 0


# 13
def plain_manifest(rows, seen=lambda r: r):
    """[(doc_id, lang, leaf, subroot, root, proof, folded)] of (doc_id, source, lang, n_chars, text) rows."""
    h = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    leaf = lambda r: h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r])

    def tree(nodes):
        """(root, the siblings of each node from below, as (digest or None, stands left))."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, a in enumerate(at):
                other = a ^ 1
                paths[i].append((nodes[other] if other < len(nodes) else None, other < a))
            nodes, at = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)], [a // 2 for a in at]
        return nodes[0], paths

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs]
    trees = [tree([leaf(r) for r in g]) for g in groups]
    root, over = tree([t[0] for t in trees])
    out = []
    for g, (sub, paths), up in zip(groups, trees, over):
        for r, path in zip(g, paths):
            node = leaf(seen(r))
            for other, left in path + up:
                node = h(node) if other is None else h(other, node) if left else h(node, other)
            out.append((r[0], r[2], leaf(r), sub, root, h(*[p for p, _ in path + up if p]), node))
    return out


def changed(r):
    bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
    return (*r[:3], r[3] + 1, r[4]) if bad else r


@pytest.fixture(scope="module")
def leaves(spark, tmp_path_factory):
    r = random.Random(2)
    rows = [(i * 5 - 90, r.choice(["s", None, "ü"]), r.choice(["en"] * 6 + ["fr", None, "ßx", "a", "zz", "e"]), r.choice([None, 0, 7, -3]), r.choice(["", None, "text é", "-"])) for i in range(120)]
    rows += [rows[4], rows[4], (None, "s", "en", 1, "t"), (rows[9][0], "other", rows[9][2], 5, "z"), (10**15, "s", "only", 5, "long " * 50000)]
    path = str(tmp_path_factory.mktemp("leaves") / "documents.parquet")
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf long, tree long")
    df.repartition(4).write.parquet(path)
    return rows, spark.read.parquet(path)


@pytest.mark.parametrize("bits", [1, 2, 3, merkle.BITS])
def test_manifest(leaves, bits):
    rows, df = leaves
    seen = {"n_chars": F.col("n_chars") + F.when(merkle.tampered(F.col("doc_id")), 1).otherwise(0)}
    out = merkle.manifest(df, seen, bits)
    names = ["doc_id", "lang", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
    got = out.collect()
    assert Counter(tuple(r[n] for n in names) for r in got) == Counter(plain_manifest(rows, changed))
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in got) and {r["verified"] for r in got} == {True, False}


def test_one_language_and_one_document(spark, tmp_path):
    for n in (1, 2, 5):
        rows = [(i, "s", "en", 1, "t") for i in range(n)]
        path = str(tmp_path / str(n))
        spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(path)
        got = merkle.manifest(spark.read.parquet(path), bits=1).collect()
        assert Counter((r["leaf"], r["root"], r["proof_sha256"]) for r in got) == Counter((x[2], x[4], x[5]) for x in plain_manifest(rows))
        assert all(r["verified"] for r in got)


def test_stored_manifest_finds_changes(leaves, spark):
    rows, df = leaves
    stored = merkle.manifest(df.filter("doc_id > 0"))
    now = df.filter("doc_id > 0").withColumn("source", F.when(F.col("doc_id") % 2 == 0, "changed").otherwise(F.col("source")))
    once = {k for k, n in Counter(r[0] for r in rows if r[0] and r[0] > 0).items() if n == 1}
    for r in merkle.verify(now, stored).collect():
        if r["doc_id"] in once:
            assert r["verified"] == (r["doc_id"] % 2 != 0 or next(x for x in rows if x[0] == r["doc_id"])[1] == "changed")
    new = spark.createDataFrame([(-1, "s", "en", 1, "t")], "doc_id long, source string, lang string, n_chars long, text string")
    assert [(r["root"], r["verified"]) for r in merkle.verify(new, stored).collect()] == [(None, False)]


def test_manifest_of_nothing(leaves):
    assert merkle.manifest(leaves[1].limit(0)).count() == 0


def test_whole_queries(spark):
    tables = {t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("conversations", "documents")}
    rows = [tuple(r) for r in tables["conversations"].select("conv_id", "turn", "text").collect()]
    want = plain_replay(rows)
    got = release.op12_release(spark, "/root/testdata/sf0.001").collect()
    assert Counter(map(tuple, got)) == Counter((*rows[i][:2], *x) for i, x in want.items())
    docs = [tuple(r) for r in tables["documents"].select(*merkle.FIELDS).collect()]
    got = merkle.op13_merkle(spark, "/root/testdata/sf0.001").collect()
    assert Counter(map(tuple, got)) == Counter((x[0], *x[2:], x[6] == x[4]) for x in plain_manifest(docs, changed))
