from collections import Counter

import brute
import corpus_pipeline
import pytest

from pointloom.llm import packing, tokens


@pytest.fixture(scope="module")
def plain(spark, rows, tmp_path_factory):
    """documents as the driver has them: five columns, no clashes."""
    data = [(d, t, "en", f"s{i % 3}", len(t or "")) for i, (d, t) in enumerate(rows) if d is not None]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_stages_and_run(spark, plain, tmp_path):
    first = spark.read.parquet(f"{plain}/documents.parquet")
    docs, before = first, first.collect()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, plain).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "packing":
            break
        assert docs.columns == first.columns
        now = docs.collect()
        if name == "quality_rules":
            assert all(not brute.quality(r["text"])[-1] for r in now)
        if name == "exact_dedup":
            best = brute.keepers([(r["doc_id"], r["text"]) for r in before])
            assert Counter(r["doc_id"] for r in now) == Counter(k for k, _ in best.values())
        if name == "ngram_join":
            pairs = [(r["doc_id"], r["text"]) for r in before]
            assert Counter(r["doc_id"] for r in now) == Counter({c for _, c in brute.jaccard_components(pairs, 5, 80)})
        if name == "mixing":
            assert Counter(map(tuple, now)) == Counter(map(tuple, before))
        before = now
    library = tokens.encoder(tokens.vocabulary_path()).library
    want = Counter()
    for r in before:
        ids, at = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2], 0
        for n in packing.binary_lengths(len(ids)):
            want[r["doc_id"], at, n, brute.crc(ids[at : at + n])] += 1
            at += n
    columns = ["doc_id", "start", "length", "ids_crc32"]
    assert Counter(tuple(r[c] for c in columns) for r in docs.collect()) == want
    earlier, later = corpus_pipeline.run(spark, plain), corpus_pipeline.run(spark, plain)  # neither deletes what the other reads
    assert Counter(tuple(r[c] for c in columns) for r in earlier.collect()) == want
    whole = later.collect()
    assert Counter(tuple(r[c] for c in columns) for r in whole) == want
    assert sorted(r["sequence_id"] for r in whole) == list(range(len(whole)))
