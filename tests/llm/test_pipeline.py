"""The pipeline's stages act on what the one before kept, and every llm query with SQL equals it."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_edges import BASE, DOCS, prose
from tidegauge.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
            assert docs.count() <= before
            before = docs.count()
    assert docs.select("doc_id").distinct().count() == before
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


TAKEN = "kept_id kept_cls kept_sha256 pii_id pii_fp pii_spans _id _kept_id _predicted _pii_id toxic id2 cls fp bucket first root".split()


def test_stages_on_nulls_ties_repeats_long_texts_and_clashing_columns(spark, tmp_path):
    rows = [(i, t, None if i == 3 else "en", None, None) for i, t in DOCS] + [(500 + i, prose(60, 700 + i), "en", "s", 1) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.lit(7).alias(c) for c in TAKEN]).repartition(3)
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns and docs.where(" or ".join(f"{c} <> 7" for c in TAKEN)).count() == 0
            sizes.append(docs.count())
        if name == "exact_dedup":  # null, empty and blank apart; the row without an id loses to one with it
            texts = [r["text"] for r in docs.collect()]
            assert sum(t == BASE or t == BASE.upper() for t in texts) == 1 and sum(not t for t in texts) == 1
        if name == "ngram_jaccard":
            assert {r["doc_id"] for r in docs.collect()}.isdisjoint({8})
    assert sizes[0] == sizes[1] == len(rows)  # nothing here is toxic
    assert docs.select("doc_id").distinct().count() <= sizes[-1]


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).df()
    plain = lambda df: sorted(map(str, df[sorted(df.columns)].itertuples(index=False, name=None)))
    assert plain(got) == plain(want)
