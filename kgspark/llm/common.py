"""Shared helpers: tables, joins without hot keys and Arrow plumbing.

Intermediate tables (``written``) go to the folder that the session names in
``spark.checkpoint.dir``, which every executor sees.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import written as written

#: A word, everywhere in this package: no ASCII white space inside.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


HEAVY = 4096


def heavy_join(left: DataFrame, right: DataFrame, keys: list[str], heavy: Column, spread: Column) -> DataFrame:
    """``left`` left-joined with ``right``, which has each key once, without a hot key in the shuffle.

    ``heavy`` marks the rows of ``right`` whose key more than 1 / ``HEAVY`` of
    the rows of ``left`` have: there are at most ``HEAVY``, and they are
    broadcast. Rows that met one of them are dealt out by ``spread``, a 64-bit
    hash, in the join with the others. Key columns are whole numbers, not null.
    """
    values = [c for c in right.columns if c not in keys]
    own = right.select(*(F.col(k).alias(f"{k}_r") for k in keys), F.struct(*values).alias("v_"), heavy.alias("heavy_"))
    first = own.where("heavy_").select(*(F.col(f"{k}_r").alias(f"{k}_h") for k in keys), F.col("v_").alias("known_"))
    met = left.join(F.broadcast(first), [F.col(k) == F.col(f"{k}_h") for k in keys], "left")
    met = met.withColumn("j_", F.when(F.col("known_").isNull(), F.col(keys[0])).otherwise(spread))
    out = met.join(own.where("not heavy_"), [F.col("j_" if k == keys[0] else k) == F.col(f"{k}_r") for k in keys], "left")
    found = F.coalesce("known_", "v_")
    return out.select(*left.columns, *(found[c].alias(c) for c in values))


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def native_words(column: Column) -> Column:
    """array<string> of the words of a non-null string column."""
    return F.filter(F.split(column, SPACE), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for a row.

    Catalyst may copy an expression into a lambda that runs for every element;
    a lambda variable cannot be copied.
    """
    return F.transform(F.array(value), body)[0]


def record_batches(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Smaller slices of Arrow batches: at most ``rows`` rows and about ``size`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, min(rows, int(batch.num_rows * size / max(1, batch.nbytes))))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def packed(docs: DataFrame, *extra: Column) -> DataFrame:
    """``docs`` as one struct column ``row`` and extra columns, so that no column name can clash."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *extra)


def unpacked(rows: DataFrame, names: list[str], **changed: Column) -> DataFrame:
    """The columns of ``packed`` rows again, some of them replaced."""
    return rows.select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in names))
