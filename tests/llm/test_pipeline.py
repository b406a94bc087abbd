import os

import pytest

def shingles(text, words=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


def test_stages(spark):
    import corpus_pipeline as p

    from hedgerow.llm import lines, toxicity
    from hedgerow.llm.common import table, written

    docs = table(spark, DATA, "documents")
    kept = {}
    for i, (name, stage) in enumerate(p.STAGES):
        out = written(stage(spark, docs, DATA), f"test-{i}")
        kept[name] = (docs, out)
        if i < len(p.STAGES) - 1:
            assert out.columns == table(spark, DATA, "documents").columns and out.dtypes == table(spark, DATA, "documents").dtypes
        docs = out
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    before, after = kept["toxicity"]
    scores = toxicity.scored(before, toxicity.learn(before, table(spark, DATA, "labels")))
    assert ids(after) == ids(scores.filter("score < 0.5")) and 0 < after.count() < before.count()
    before, after = kept["line dedup"]
    texts = {r.doc_id: r.kept for r in lines.dedup_lines(before).collect()}
    assert {r.doc_id: r.text for r in after.collect()} == texts
    before, after = kept["near-duplicates"]
    # similar texts linked by plain sets, every pair
    sets = {r.doc_id: shingles(r.text) for r in before.collect()}
    root = {d: d for d in sets}
    by_shingle = {}
    for d, s in sets.items():
        for x in s or {None}:
            by_shingle.setdefault(x, []).append(d)
    for d, s in sets.items():
        for e in {e for x in s or {None} for e in by_shingle[x] if e < d}:
            if root[d] != root[e] and 5 * len(s & sets[e]) >= 4 * len(s | sets[e]):
                low, high = sorted((root[d], root[e]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert ids(after) == sorted({r for r in root.values()}) and len(ids(after)) < len(ids(before))
    before, after = kept["mixing"]
    assert set(ids(after)) <= set(ids(before)) and abs(after.count() - 1.5 * before.count()) < before.count()
    before, after = kept["encoding"]
    assert ids(before) == ids(after)
    assert [r.ids_sha256 for r in p.run(spark, DATA).orderBy("doc_id", "ids_sha256").collect()] == [r.ids_sha256 for r in after.orderBy("doc_id", "ids_sha256").collect()]


def test_nulls_repeats_and_empty(spark):
    import corpus_pipeline as p

    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "a", 0, "x"), (3, "some words here", "en", "a", 15, "x"), (3, "some words here", "en", "a", 15, "x"), (None, "no id", "en", None, 5, "x"), (4, "w " * 20000, "en", "b", 40000, "x")]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in p.STAGES:
            docs = stage(spark, docs, DATA)
        assert len(docs.collect()) <= 2 * len(data)


def test_clean_documents_stay(spark):
    import corpus_pipeline as p

    docs = spark.createDataFrame([(None, "no id a b c", "en", None, 11), (1, "one two three four five", "en", "a", 23), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in p.STAGES[:3]:
        docs = stage(spark, docs, DATA)
        assert docs.count() == 3
