"""The registered queries on the smallest tables, and the stages of the pipeline against plain checks."""

import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from chronotext.llm.queries import ORACLE_SQL, QUERIES
from chronotext.registry.base import table

KEPT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLE_SQL:
        assert compare(df, connect(sf_dir), ORACLE_SQL[name]) == ""
    else:
        of = "embeddings" if name.startswith("op4_") else "documents"
        assert df.count() >= table(spark, sf_dir, of).count()


def test_one_query_per_operator():
    assert sorted(int(q.split("_")[0][2:]) for q in QUERIES) == list(range(1, 14))


def test_pipeline(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    path = corpus_pipeline.Scratch(spark, "t")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = path.write(stage(spark, docs, sf_dir), name)
        assert out.columns == KEPT_COLUMNS == docs.columns
        assert 0 < out.count() <= docs.count()
        assert out.join(docs, "doc_id", "left_anti").count() == 0
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert {tuple(r) for r in corpus_pipeline.run(spark, sf_dir).select("doc_id", "start", "length").collect()} == {
        tuple(r) for r in packed.select("doc_id", "start", "length").collect()}


def test_stages_on_odd_rows(spark, sf_dir):
    long = " ".join(f"word{i}" for i in range(300))
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, long, "en", "s", 5), (2, long, "en", "s", 5),
            (3, long, "de", None, None), (None, long + " more", "en", "s", 1), (4, "a\nb\nc\n" * 40, "en", "s", 1)]
    df = spark.createDataFrame([(*r, "z") for r in rows],
                               "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for table_ in (df, df.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, table_, sf_dir)
            assert out.count() >= 0
            assert table_.count() or not out.count()
    near = corpus_pipeline.near_duplicates(spark, df, sf_dir).where(F.col("text").startswith("word0 word1"))
    assert [r["doc_id"] for r in near.collect()] == [2]
