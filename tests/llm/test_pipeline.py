"""The pipeline, and the registered SQL of this package."""

from __future__ import annotations

import collections

import duckdb
import pytest

import corpus_pipeline
from kgspark.llm import mixing, ngram_join, pii, quality_qda
from kgspark.llm import queries as llm


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / str(k))
        stage(spark, docs, small).write.parquet(out)
        found = spark.read.parquet(out)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert found.columns == columns, name
        kept[name] = (docs, found)
        docs = found
    before, after = kept["quality"]
    labels = spark.read.parquet(f"{small}/labels.parquet")
    scores = quality_qda.quality(before, labels)
    assert after.count() == scores.where("predicted = 1").count()
    before, after = kept["near duplicates"]
    classes = ngram_join.near_duplicates(before)
    assert after.count() == classes.select("class_id").distinct().count()
    assert ngram_join.near_duplicates(after).where("n_links > 0").count() == 0
    before, after = kept["personal data"]
    assert before.count() == after.count()
    assert pii.personal_data(after).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
    before, after = kept["mixing"]
    copies = collections.Counter({r["doc_id"]: r["copies"] for r in mixing.mix(before).collect()})
    assert collections.Counter(r["doc_id"] for r in after.collect()) == +copies
    before, after = kept["tokens"]
    assert after.count() == before.count()


def test_run_is_the_stages(spark, small):
    assert corpus_pipeline.run(spark, small).columns == ["doc_id", "source", "ids", "n_pieces", "scores", "changes"]


def test_run_on_odd_rows_and_empty_tables(spark, odd, labels, tmp_path):
    for name, docs, known in (("empty", odd.limit(0), labels), ("unlabelled", odd, labels.limit(0))):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        known.write.parquet(f"{folder}/labels.parquet")
        found = corpus_pipeline.run(spark, folder)
        assert found.columns == ["doc_id", "source", "ids", "n_pieces", "scores", "changes"]
        rows = found.collect()
        if name == "empty":
            assert rows == []
        if name == "unlabelled":  # the neutral model accepts all; texts without words are never mixed in, copies once
            assert {r["doc_id"] for r in rows} <= {4, 8, 9, 10, 11, 12, None} and all(r["n_pieces"] > 0 for r in rows)
            assert collections.Counter(r["doc_id"] for r in rows)[11] >= 1


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_sql(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    expected = con.execute(llm.oracle_sql()[name]).fetchall()
    columns = [c[0] for c in con.description]
    found = llm.queries()[name](spark, sf_dir).select(columns).collect()
    assert sorted(map(tuple, found)) == sorted(expected)
