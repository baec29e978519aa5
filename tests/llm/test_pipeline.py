import collections

import corpus_pipeline
from lumengrid.llm import jaccard, mixing, queries
from lumengrid.llm.common import materialise, table


def test_stages_keep_what_they_should(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, states = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        states.append(materialise(stage(spark, states[-1], sf_dir)))
    assert all(s.columns == columns for s in states[:-1])
    ids = [collections.Counter(r.doc_id for r in s.select("doc_id").collect()) for s in states]
    scores = {r.doc_id: r.predicted for r in queries.op10_quality(spark, sf_dir).collect()}
    assert set(ids[1]) == {i for i, p in scores.items() if p}
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in ids[1] for i in good) >= 0.97 * len(good)
    assert set(ids[2]) <= set(ids[1]) and len(ids[2]) >= 0.98 * len(ids[1])
    near = {r.id: r.group_id for r in jaccard.join(states[2]).collect()}
    assert set(ids[3]) == set(near.values()) and set(ids[3].values()) == {1}
    assert ids[4] == {r.id: r.copies for r in mixing.mix(states[3]).collect() if r.copies}
    assert ids[5] == ids[4]
    encoded = {r.doc_id: r.ids_sha256 for r in queries.op9_sentencepiece(spark, sf_dir).collect()}
    assert all(encoded[r.doc_id] == r.ids_sha256 for r in states[5].collect())


def test_run_is_the_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "language", "near duplicates", "source mix", "sentence pieces"]


EXTRA = ["score", "id", "lang_pred", "__score", "__id", "__copy", "__copies", "kept", "stats", "digest", "quality"]


def test_stages_of_odd_documents(spark, sf_dir):
    rows = [(None, None, None, None, None), (5, "", "en", "a", 0), (6, "x y z", None, "a", 5), (6, "x y z", None, "a", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *[f"'own' AS {c}" for c in EXTRA])
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
        if name != "sentence pieces":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *EXTRA]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
