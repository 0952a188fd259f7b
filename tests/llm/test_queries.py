"""The registered queries against their SQL, and the pipeline end to end."""

import duckdb
import pytest

import corpus_pipeline
from tidemark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    df = queries.queries()[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == sorted(found.fetchall(), key=repr)


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 14)}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        assert docs.count() <= n
        n = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == n > 0.5 * 200
    assert last.where("NOT lossless").count() == 0
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()) == sorted(r.doc_id for r in last.select("doc_id").collect())


def test_pipeline_survives_odd_documents(spark, docs, corpus):
    df = docs(corpus)
    for name, stage in corpus_pipeline.STAGES:
        if name != "quality classifier":
            df = stage(spark, df, SF)
    assert df.count() > 10


def test_stages_keep_columns_named_like_their_own(spark, docs):
    """Columns of the user's with the names that stages work with stay what they were."""
    names = ["score", "__score", "n_lines", "n_removed", "__lines", "kept", "kept_of", "__kept", "digest", "__digest", "kept_digest", "tag", "__tag", "of", "known", "ids", "_score", "_kept"]
    texts = [f"document {i} tells of {' '.join(f'thing{(i * k) % 41}' for k in range(1, 30))} and ends here" for i in range(12)]
    df = docs([*enumerate(texts), (20, texts[3]), (21, texts[4] + " again")], names)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, df, SF)
        assert got.columns == df.columns, name
        assert {tuple(r[n] for n in names) for r in got.collect()} <= {("mine",) * len(names)}, name
    assert corpus_pipeline.STAGES[-1][1](spark, df, SF).count() == df.count()
