"""Streaming forms of incremental ingest, change reports and document histories."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..storage import shared_dir

HISTORY = "document_id string, source_hash string, hash_history array<string>"


def new_sources(stream: DataFrame, at: str = "ts", delay: str = "1 hour", key: str = "source_hash") -> DataFrame:
    """Each content hash once within the watermark."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def changes_by_hour(stream: DataFrame, at: str = "ts", delay: str = "1 hour", window: str = "1 hour", key: str = "event_type") -> DataFrame:
    """Tumbling counts by key; also works on a batch table."""
    w = F.window(at, window)
    return stream.withWatermark(at, delay).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def sessions(stream: DataFrame, at: str = "ts", user: str = "user_id", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Session windows of each user."""
    return stream.withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("w"), user).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def hash_histories(stream: DataFrame) -> DataFrame:
    """The sorted hashes seen of every document, kept in state; a row for each change."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = set(state.get[0]) if state.exists else set()
        last = None
        for frame in frames:
            seen.update(frame["source_hash"])
            last = frame["source_hash"].iloc[-1] if len(frame) else last
        state.update((sorted(seen),))
        yield pd.DataFrame({"document_id": [key[0]], "source_hash": [last], "hash_history": [sorted(seen)]})

    return stream.groupBy("document_id").applyInPandasWithState(update, HISTORY, "hashes array<string>", "update", GroupStateTimeout.NoTimeout)


def stream_of(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stream over the files at a path, which may be one file or a folder."""
    folder, name = path.rstrip("/").rsplit("/", 1)
    # A file source reads folders and patterns; the pattern names the one file, or the folder's files.
    single = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    single = single.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(single).isFile()
    return spark.readStream.schema(schema).parquet(f"{folder}/{name[:-1]}[{name[-1]}]" if single else path)


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives for what is there now, as a table in the shared folder."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def append(batch: DataFrame, number: int) -> None:
        # The batch's number names its folder, so a retried batch replaces itself.
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(append).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{path}/rows")


def ingest(stream: DataFrame, upsert: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts an incremental ingest: every micro-batch goes to ``upsert`` with its number, which makes retries harmless."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(upsert).trigger(availableNow=True).start()
