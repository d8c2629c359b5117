from __future__ import annotations

import corpus_pipeline
from pixelmill.llm import mixing, quality_cnn
from pixelmill.session import work_table
from tests.llm.fixtures import awkward, documents
from tests.llm.test_dedup import LOWER, brute_components
from tests.llm.test_filters import brute_forms, many_texts
from tests.llm.test_tokens import LIBRARY

SF = "/root/testdata/sf0.001"


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "exact_dedup", "near_dedup", "mixing", "tokens"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        result = work_table(stage(spark, docs, SF), name)
        after = {r.doc_id for r in result.collect()}
        if name == "quality_classifier":
            network = quality_cnn.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            assert after == {r.doc_id for r in quality_cnn.score(docs, network).where("score >= 0.7").collect()}
        elif name == "exact_dedup":
            assert after == {max(j for j, u in before.items() if u.translate(LOWER) == t.translate(LOWER)) for t in set(before.values())}
        elif name == "near_dedup":
            assert after == set(brute_components(list(before.items()), 80).values())
        elif name == "mixing":
            mixed = mixing.mixture(docs).where("sampled")
            assert after == {r.row.doc_id for r in mixed.collect()}
        else:
            assert {r.doc_id: r.n_tokens for r in result.collect()} == {i: len(LIBRARY.encode(t, add_special_tokens=False).ids) for i, t in before.items()}
        assert name == "tokens" or result.columns == columns
        docs = result
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, docs.collect()))


def test_mixing_stage_learns_from_all_rows(spark):
    """The stage draws what a mixture by the forms of k-means over every row draws."""
    docs = many_texts(spark)
    named = brute_forms(docs)[-1]
    forms = spark.createDataFrame([*named.items()], "doc_id long, form string")
    wanted = mixing.mixture(docs.join(forms, "doc_id"), topics="form").where("sampled")
    drawn = [r.doc_id for r in corpus_pipeline.mixing(spark, docs, SF).collect()]
    assert sorted(drawn) == sorted(r.row.doc_id for r in wanted.collect()) and 0 < len(drawn) < docs.count()


def test_stages_of_awkward_rows(spark):
    docs = documents(spark, awkward())
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        assert stage(spark, docs, SF).count() >= 0
