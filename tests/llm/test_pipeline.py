from __future__ import annotations

import corpus_pipeline
from hustings.llm import classifier, mixing, ngram_join, secrets, wfst

from .helpers import documents

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert [s[1] for s in corpus_pipeline.STAGES] == [corpus_pipeline.quality, corpus_pipeline.near_duplicates, corpus_pipeline.redact_secrets, corpus_pipeline.mix_sources, corpus_pipeline.tokenise]
    step = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        step.append(docs)
    assert all(s.columns == columns for s in step[:-1])
    # 1: exactly the documents that the classifier accepts.
    first = spark.read.parquet(f"{SF}/documents.parquet")
    model = classifier.train(first, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in step[0].collect()} == {r.doc_id for r in classifier.score(first, model).where("predicted = 1").collect()}
    # 2: one document of each class of what was kept.
    classes = ngram_join.link(step[0]).collect()
    assert sorted(r.doc_id for r in step[1].collect()) == sorted({r.class_id for r in classes})
    # 3: no secret is left, other texts are as they were.
    for r in step[2].collect():
        assert r.text == secrets.redact_text(texts[r.doc_id] or "") and r.n_chars == len(r.text)
    # 4: the mix's copies. 5: ids that decode to the texts.
    assert step[3].count() == sum(min(3, n) for n in [r["count"] for r in step[3].groupBy("doc_id").count().collect()]) and mixing.CAP == 3
    assert step[4].count() == step[3].count() and step[4].where("not round_trip").count() == 0
    assert wfst.decode(step[4]).count() == step[4].count()


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "ids", "n_tokens", "round_trip"] and out.count() > 0


def test_stages_take_odd_rows(spark):
    """Nulls in any column, empty and very long texts, repeated rows, clashing further columns, empty tables."""
    rows = [(1, None, None), (2, "", "a"), (3, "the cat sat on the mat. " * 9000, "a"), (4, "password=abcdefgh12345", "b"), (4, "password=abcdefgh12345", "b"), (None, "a row without an id", "b"), (6, "tie tie tie", None), (7, "tie tie tie", None)]
    for data in (rows, []):
        for extra in (False, True):
            docs = documents(spark, data, extra=extra)
            kept = corpus_pipeline.near_duplicates(spark, docs, SF)
            assert sorted(kept.select("doc_id").collect(), key=str) == sorted([(d,) for d in ([1, 2, 3, 4, None, 6] if data else [])], key=str)
            clean = corpus_pipeline.redact_secrets(spark, docs, SF)
            assert clean.count() == len(data) and clean.where("text like '%abcdefgh%'").count() == 0
            mixed = corpus_pipeline.mix_sources(spark, docs, SF)
            assert mixed.columns == kept.columns == clean.columns == docs.columns
            assert all(r["count"] <= 3 * sum(d == r.doc_id for d, *_ in data) for r in mixed.groupBy("doc_id").count().collect())
            assert corpus_pipeline.tokenise(spark, docs, SF).count() == len(data)
            good = corpus_pipeline.quality(spark, docs, SF)
            assert good.columns == docs.columns and set(r.doc_id for r in good.collect()) <= {d for d, *_ in data}
