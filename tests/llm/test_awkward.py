"""Every operator and stage over nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import cases
import pytest

import corpus_pipeline
from tracegraph.llm import embedding_join, html_consensus, language_id, ngram_join, packing, pii, quality, sentencepiece_bpe, sharding, token_counts

OPERATORS = {
    "language_id": language_id.identify,
    "quality": quality.judge,
    "pii": pii.redact,
    "ngram_join": ngram_join.ngram_jaccard_join,
    "sharding": sharding.assign,
    "packing": packing.pack,
    "sentencepiece": sentencepiece_bpe.encode_documents,
    "token_counts": token_counts.count_tokens,
}
ONE_ROW_EACH = {"language_id", "quality", "pii", "sharding", "sentencepiece", "token_counts"}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_awkward(spark, name):
    rows = cases.awkward()
    plain = OPERATORS[name](cases.documents(spark, rows))
    extra = OPERATORS[name](cases.documents(spark, rows, extra=True))
    assert plain.columns == extra.columns
    one, two = (sorted(map(repr, df.collect())) for df in (plain, extra))
    assert one == two
    if name in ONE_ROW_EACH:
        assert len(one) == len(rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_empty_table(spark, name):
    assert OPERATORS[name](cases.documents(spark, [])).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_only_nulls(spark, name):
    found = OPERATORS[name](cases.documents(spark, [(None,) * 5, (None,) * 5])).collect()
    assert len(found) == (2 if name in ONE_ROW_EACH else 0)


def test_classes_awkward(spark):
    rows = [(None, "a b c d"), (1, None), (2, ""), (3, "--- !"), (4, "a b c d"), (5, "A b, c d"), (4, "b b c d"), (6, "one"), (7, "ONE"), (8, "x y z " * 200_000)]
    found = ngram_join.ngram_jaccard_join(cases.documents(spark, [cases.row(*r) for r in rows])).collect()
    assert sorted(map(tuple, found)) == [(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 1), (5, 4, 1), (6, 6, 1), (7, 6, 1), (8, 8, 0)]


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES) - 1))
def test_stage_awkward(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    for extra in (False, True):
        docs = cases.documents(spark, cases.awkward(), extra)
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        kept = {r["doc_id"] for r in out.collect()}
        assert {4, 11, -5, 2**60} <= kept, name


def test_packing_stage_awkward(spark):
    rows = cases.awkward()
    for extra in (False, True):
        out = corpus_pipeline.STAGES[-1][1](spark, cases.documents(spark, rows, extra), "").collect()
        assert {r["doc_id"] for r in out} == {r[0] for r in rows if r[1]}


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stage_empty_table(spark, k):
    assert corpus_pipeline.STAGES[k][1](spark, cases.documents(spark, []), "").collect() == []


def test_stage_only_nulls(spark):
    counts = [stage(spark, cases.documents(spark, [(None,) * 5]), "").count() for _, stage in corpus_pipeline.STAGES]
    assert counts == [1, 1, 1, 1, 0]  # without a labelled text there is no language model, so nothing is rejected


def test_pages_awkward(spark):
    schema = "page_id long, url string, html string"
    rows = [(1, "http://a.x/1", "<div class=m><p>some text here</p></div>"), (1, "http://a.x/1", "<div class=m><p>some text here</p></div>"), (None, None, None), (2**60 + 1, "http://a.x/7", None), (2, "nonsense", "<p>alone</p>"), (3, "http://a.x/2", ""), (4, "http://A.x/3", "<div><<p>>" * 2000), (5, "http://a.x/4", "no tags at all"), (6, "http://a.x/9", "<div class=m><p>" + "very long " * 60000)]
    out = html_consensus.extract(spark.createDataFrame(rows, schema)).collect()
    assert len(out) == len(rows)
    by = {r["page_id"]: r for r in out}
    assert by[1]["text"] == "some text here" and by[1]["by_host"] and by[1]["host"] == "a.x"
    assert by[None]["text"] == "" and by[None]["path"] is None and by[3]["text"] == "" and by[4]["host"] == "a.x"
    assert len(by[6]["text"]) > 500_000 and 2**60 + 1 in by
    clash = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], schema + ", host string, path string, votes string")
    assert sorted(map(repr, html_consensus.extract(clash).collect())) == sorted(map(repr, out))
    assert html_consensus.extract(spark.createDataFrame([], schema)).collect() == []


def test_embeddings_awkward(spark):
    schema = "vec_id long, embedding array<float>, label int"
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0, 0.0], 0), (2, [2.0, 0.0, 0.0], None), (2, [2.0, 0.0, 0.0], 0), (None, [1.0, 0.0, 0.0], 0), (3, None, 0), (4, [], 0), (5, [nan, 1.0, 0.0], 0), (6, [inf, 0.0, 0.0], 0), (7, [0.0, 0.0, 0.0], 0), (8, [1.0, 0.0], 0), (9, [0.0, 1.0, 0.0], 0), (10, [1.0, None, 0.0], 0)]
    expected = [(1, 1, 1), (2, 1, 1), *((k, k, 0) for k in range(3, 11))]
    assert sorted(map(tuple, embedding_join.near_duplicates(spark.createDataFrame(rows, schema)).collect())) == expected
    clash = spark.createDataFrame([(*r, "x", "y") for r in rows], schema + ", block string, ids string")
    assert sorted(map(tuple, embedding_join.near_duplicates(clash).collect())) == expected
    assert embedding_join.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    unusable = spark.createDataFrame([(1, None, 0), (2, [0.0], 0)], schema)
    assert sorted(map(tuple, embedding_join.near_duplicates(unusable).collect())) == [(1, 1, 0), (2, 2, 0)]


def test_missing_rejections_are_not_swallowed(spark):
    with pytest.raises(ValueError):
        sharding.fill(["a", "b"], 10)
