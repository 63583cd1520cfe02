"""The pipeline's stages: columns, what they keep, and the queries that use them."""

import duckdb
import pytest

import corpus_pipeline
from factlake.llm import queries, simhash_dedup

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_drop_what_they_reject(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SMALL).cache()
        assert after.columns == docs.columns, name
        ids, kept = {r["doc_id"] for r in before.collect()}, {r["doc_id"] for r in after.collect()}
        assert kept and kept <= ids, name
        if name == "near_duplicates":
            classes = {r["doc_id"]: r["component_id"] for r in simhash_dedup.find_near_duplicates(before).collect()}
            assert kept == set(classes.values()) and after.count() == len(kept)
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, SMALL)
    assert last.count() == before.count()


def test_an_empty_table_passes_through(spark, tmp_path):
    spark.read.parquet(f"{SMALL}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_twins(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "pages", "conversations", "labels", "benchmark"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    got = queries.QUERIES[name](spark, SMALL)
    want = connection.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))
