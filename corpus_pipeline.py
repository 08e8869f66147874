"""Corpus pipeline over ``documents``: filter, deduplicate, redact, mix, tokenise.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor
kept. All but the last return the columns of ``documents``; the last returns the
token ids of every text.

Defined results: without labels of both classes the classifier is neutral and
keeps every document. Null, empty and blank texts are no near duplicates of
anything, hold no personal data, have size 0 and so are never mixed in. Of
copies and repeated rows one stays, that with the least doc_id, null last. A
null source is a source of its own. Extra columns are carried along, whatever
their names, up to the last stage. An empty table gives an empty result.

The mix deals out words in blocks; a document that a block run cuts is rounded
to whole copies, so the mixed rows are whole documents, repeated up to three
times. No stage of this pipeline can be expressed in SQL as a whole (the
classifier, the signatures and the lattice are not), so there is no oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kgspark.llm import mixing, ngram_join, piece_nbest, pii, quality_qda


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quadratic discriminant accepts."""
    return quality_qda.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the n-gram Jaccard join."""
    return ngram_join.deduplicated(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by marks."""
    return pii.redacted(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the N best segmentations of every text."""
    return piece_nbest.encoded(docs, keep=("doc_id", "source"))


STAGES = [
    ("quality", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("personal data", pii_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
