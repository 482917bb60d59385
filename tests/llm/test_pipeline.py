"""The pipeline's stages against brute force, and the corpus queries against their SQL."""

import os

import pytest

import corpus_pipeline
from barloom.llm.queries import ORACLES, QUERIES
from tools.compare import clean, connect, rows_match

from .helpers import covered, cut, documents, jaccard
from .test_texts import _hit_words

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(clean(v) for v in r) for r in df.select(*cols).collect()]
    rel = connect(SF).execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    ok, note = rows_match(got, [tuple(clean(r[names.index(c)]) for c in cols) for r in rel.fetchall()])
    assert ok, note


@needs_data
def test_stages_on_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        out = stage(spark, docs, SF)
        rows = out.collect()
        docs = spark.createDataFrame(rows, out.schema)
        kept[name] = (before, [r.asDict() for r in rows])
        if name != "byte_bpe":
            assert docs.columns == columns
    before, after = kept["language_id"]
    assert [r["doc_id"] for r in after] == [r["doc_id"] for r in before if any(c.isalpha() for c in r["text"] or "")]
    before, after = kept["jaccard_join"]
    want = {i for i, n, c in jaccard([(r["doc_id"], r["text"]) for r in before]) if c == i}
    assert sorted(r["doc_id"] for r in after) == sorted(want)
    before, after = kept["suffix_dedup"]
    data = [r["text"].encode() for r in before]
    texts = {r["doc_id"]: cut(b, m).decode(errors="ignore") for r, b, m in zip(before, data, covered(data, corpus_pipeline.PASSAGE), strict=True)}
    assert {r["doc_id"]: r["text"] for r in after} == texts and all(r["n_chars"] == len(r["text"]) for r in after)
    before, after = kept["decontamination"]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if not _hit_words(r["text"], items)[-1]}
    before, after = kept["byte_bpe"]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in whole) == sorted((r["doc_id"], r["ids_sha256"]) for r in after)


def test_stages_on_hard_rows(spark):
    text = " ".join(f"word{k}" for k in range(40))
    rows = [(1, text, "en"), (1, text, "en"), (2, None, None), (None, text + " x", "en"), (3, "", "en"), (4, "123", None), (5, "hello there " * 3000, "en")]
    docs = documents(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        got = sorted((r.doc_id or 0) for r in out.collect())
        assert got == {"language_id": [0, 1, 1, 5], "jaccard_join": [1, 2, 3, 4, 5]}.get(name, [0, 1, 1, 2, 3, 4, 5])
        if name != "byte_bpe":
            assert out.columns == docs.columns


def test_stages_on_an_empty_table(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents(spark, []), SF).count() == 0
