import duckdb
import pytest

from loomspan.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "labels", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    mine = QUERIES[name](spark, SF)
    columns = sorted(mine.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, mine.select(columns).collect()))) == sorted(map(str, want))


def test_spans_sql_on_odd_texts(spark, documents):
    own = documents.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text")
    odd = ["a.  b!\n\nc? D.E.F", " . . one. two. three. one. two. three.", "一二。三四。五六。一二。三四。五六。", "x " * 60 + ". " + "x " * 60 + ".", "Á. b. ç. á. b. ç.", "A. B. C. a. b. c. A. B."]
    docs = own.union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], own.schema)).toPandas()
    con = duckdb.connect()
    con.register("documents", docs)
    columns = ["doc_id", "n_sentences", "n_removed", "words_removed", "text"]
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES['op10_sentence_spans']})").fetchall()
    from loomspan.llm.sentence_spans import op10_sentence_spans

    got = op10_sentence_spans(spark.createDataFrame(docs.astype(object).where(docs.notna(), None), own.schema)).select(columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
