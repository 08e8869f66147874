"""Documents to segments and overlapping token windows, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.text import tokens


def windows(words: Column, size: int, overlap: int) -> Column:
    """array<struct<order, start, end, overlap_tokens, text, token_count>> of token windows."""
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("size must be positive and overlap in 0 .. size - 1")
    step = size - overlap

    def cut(w: Column) -> Column:
        count = F.when(F.size(w) <= size, F.lit(1)).otherwise(F.ceil((F.size(w) - size) / step).cast("int") + 1)
        each = F.transform(
            F.sequence(F.lit(0), count - 1),
            lambda k: F.struct(
                k.cast("long").alias("order"),
                (k * step).cast("long").alias("start"),
                F.least(k * step + size, F.size(w)).cast("long").alias("end"),
                F.when(k == 0, F.lit(0)).otherwise(F.lit(overlap)).cast("long").alias("overlap_tokens"),
                F.array_join(F.slice(w, k * step + 1, size), " ").alias("text"),
                F.least(F.lit(size), F.size(w) - k * step).cast("long").alias("token_count"),
            ),
        )
        return F.when(F.size(w) > 0, each).otherwise(F.filter(each, lambda x: F.lit(False)))

    return F.transform(F.array(words), cut)[0]


def chunks(docs: DataFrame, size: int = 200, overlap: int = 40, document: str = "document_id", text: str = "text") -> DataFrame:
    """A row for each chunk of every document, with its id."""
    rows = docs.select(F.col(document).alias("document_id"), F.explode(windows(tokens(F.coalesce(F.col(text), F.lit(""))), size, overlap)).alias("c")).select("document_id", "c.*")
    return rows.select("document_id", "order", "start", "end", "overlap_tokens", "token_count", ids.chunk_id(F.col("document_id"), F.col("order"), F.col("text")).alias("chunk_id"), "text")


def segments(docs: DataFrame, document: str = "document_id", text: str = "text") -> DataFrame:
    """Paragraphs (between blank lines) with their order and id."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\n[ \t]*\n"), lambda p: F.trim(p)), lambda p: p != "")
    rows = docs.select(F.col(document).alias("document_id"), F.posexplode(parts).alias("pos", "text"))
    rows = rows.select("document_id", F.col("pos").cast("long").alias("order"), F.lit("paragraph").alias("type"), "text")
    return rows.withColumn("segment_id", ids.segment_id(F.col("document_id"), F.col("type"), F.col("order"), F.col("text")))


def with_ranges(chunk_rows: DataFrame, segment_rows: DataFrame) -> DataFrame:
    """Chunks with the page and paragraph ranges and the segment ids of their whole document; pages count from 1."""
    page = F.when(F.col("type") == "page", F.col("order") + 1)
    paragraph = F.when(F.col("type") == "paragraph", F.col("order"))
    ranges = (F.min(page).alias("page_start"), F.max(page).alias("page_end"), F.min(paragraph).alias("paragraph_start"), F.max(paragraph).alias("paragraph_end"))
    spans = segment_rows.groupBy("document_id").agg(*ranges, F.transform(F.array_sort(F.collect_list(F.struct("order", "segment_id"))), lambda s: s["segment_id"]).alias("segment_ids"))
    return chunk_rows.join(spans, "document_id", "left")


def substring_hits(chunk_rows: DataFrame, query: str) -> DataFrame:
    """Chunks whose text holds the query, ignoring case and outer white space."""
    return chunk_rows.where(F.contains(F.lower("text"), F.lit(query.strip().lower())))


def upserted(old: DataFrame, new: DataFrame, key: str = "document_id", value: str = "source_hash") -> DataFrame:
    """Documents after an ingest: new rows win, ``hash_history`` is the sorted union of all hashes seen."""
    o = old.select(F.col(key), F.col(value).alias("old_"), F.col("hash_history").alias("history_"))
    n = new.select(F.col(key), F.col(value).alias("new_"))
    empty = F.array().cast("array<string>")
    merged = F.array_union(F.coalesce("history_", empty), F.array_compact(F.array("old_", "new_")))
    return o.join(n, key, "full").select(key, F.coalesce("new_", "old_").alias(value), F.array_sort(F.array_distinct(merged)).alias("hash_history"))
