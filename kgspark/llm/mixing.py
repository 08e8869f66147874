"""Mixing sources to target weights by Sainte-Laguë apportionment.

Every source gets a target number of words from its weight. Targets are dealt
out as blocks of equal size, by highest quotients w / (2k + 1): first to the
sources, then from a source to groups of shards and down to shards, so that every
(source, shard) cell has an integer quota and no apportionment inside a source
has more than ``FAN`` parties.
Inside a cell the documents stand in a seeded order on a ring of words; the
cell's quota is the run of blocks that starts at a seeded block, going round
again where the mix repeats a source.

Defined results: null and empty texts have size 0 and are never taken; a null
source is a source of its own and comes last; repeated rows count as often as
they occur; an empty table gives an empty result. No document is taken more
than ``MAX_EPOCHS`` times. Reruns and other partitionings agree, because every
choice hangs on hashes of the rows alone. Rows that agree in every column, doc_id
included, share a cell; a cell's ring is numbered by one task from a few numbers
of each row.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, packed, text_or_empty, unpacked, written

BLOCK_WORDS = 32
SHARD_WORDS = 32_768
FAN = 1024
MAX_EPOCHS = 3
MAX_SOURCES = 1_000_000


def sainte_lague(weights: Sequence[float], seats: int, caps: Sequence[int]) -> list[int]:
    """Seats by highest quotient w / (2k + 1), never above a party's cap.

    Equal quotients go to the earlier party. The divisor is found by bisection,
    so the cost does not grow with the number of seats.
    """
    w, top = np.asarray(weights, np.float64), np.asarray(caps, np.int64)
    top = np.where(w > 0, top, 0)
    seats = int(min(seats, top.sum()))
    if seats <= 0:
        return [0] * len(w)
    if seats == top.sum():
        return top.tolist()

    def given(per_weight: float) -> np.ndarray:
        return np.minimum(top, np.floor(w * per_weight + 0.5).astype(np.int64))

    low, high = 0.0, (seats + 1) / w[w > 0].min()
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (middle, high) if given(middle).sum() <= seats else (low, middle)
    out = given(low)
    queue = [(-w[k] / (2 * out[k] + 1), k) for k in np.flatnonzero(out < top)]
    heapq.heapify(queue)
    for _ in range(seats - int(out.sum())):
        _, k = heapq.heappop(queue)
        out[k] += 1
        if out[k] < top[k]:
            heapq.heappush(queue, (-w[k] / (2 * out[k] + 1), k))
    return out.tolist()


def targets(sizes: Sequence[int], weights: Sequence[float], epochs: int = MAX_EPOCHS) -> list[float]:
    """The share of each source in the sum of all sizes, at most ``epochs`` times its own size.

    What a source cannot take is dealt again by weight among those below their limit.
    """
    limit = [float(epochs * s) for s in sizes]
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(sum(sizes))
    while open_:
        total = sum(weights[k] for k in sorted(open_))
        if total <= 0:
            break
        share = {k: left * weights[k] / total for k in open_}
        over = {k for k in open_ if share[k] > limit[k]}
        if not over:
            for k in open_:
                out[k] = share[k]
            break
        for k in over:
            out[k] = limit[k]
        left -= sum(limit[k] for k in sorted(over))
        open_ -= over
    return out


def source_quotas(sizes: Sequence[int], want: Sequence[float], epochs: int = MAX_EPOCHS, block_words: int = BLOCK_WORDS) -> list[int]:
    """Blocks of each source: those below their limit share the blocks of all their targets by highest quotients.

    A source at its limit is taken whole, ``epochs`` times; its cells' caps bound it.
    """
    out = [1 << 60] * len(sizes)
    below = [k for k, (s, t) in enumerate(zip(sizes, want, strict=True)) if t < epochs * s]
    seats = round(sum(want[k] for k in below) / block_words)
    for k, q in zip(below, sainte_lague([want[k] for k in below], seats, [-(-epochs * sizes[k] // block_words) for k in below]), strict=True):
        out[k] = q
    return out


def cycled_weights(n: int) -> list[float]:
    """1, 2, 3, repeating."""
    return [float(1 + k % 3) for k in range(n)]


def _dealt(children: DataFrame, quotas: DataFrame, parent: Column) -> DataFrame:
    """Quotas of children (sx, shard, size, cap) from those of their parents (sx, parent, quota)."""

    def deal(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("shard")
        seats = sainte_lague(group["size"].tolist(), int(group["quota"].iloc[0]), group["cap"].tolist())
        return group[["sx", "shard", "size"]].assign(quota=seats)

    joined = children.withColumn("parent", parent).join(quotas, ["sx", "parent"])
    return joined.groupBy("sx", "parent").applyInPandas(deal, "sx int, shard long, size long, quota long")


def row_key(docs: DataFrame) -> Column:
    """A hash of a whole row; rows that agree in every column have the same."""
    return F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))))


def mix(docs: DataFrame, weights=cycled_weights, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, epochs: int = MAX_EPOCHS, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) and copies of every row.

    ``copies`` is ``taken`` in whole documents: a document that a cell's run of
    blocks cuts is rounded. ``weights`` maps the number of sources to weights in
    code-point order of the sources. The list of sources (at most
    ``MAX_SOURCES``, more is an error) is the only thing the driver holds.
    """
    rows = docs.select("doc_id", "source", F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"), F.xxhash64(F.lit(seed), "doc_id").alias("h"), row_key(docs).alias("t"))
    rows = written(rows)
    spark = rows.sparkSession
    found = rows.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in found]
    want = targets(sizes, weights(len(found)), epochs)
    quota = source_quotas(sizes, want, epochs, block_words)
    table = [(k, r["source"], s, t, q, max(1, -(-s // shard_words))) for k, (r, s, t, q) in enumerate(zip(found, sizes, want, quota, strict=True))]
    sources = spark.createDataFrame(table, f"sx int, source {docs.schema['source'].dataType.simpleString()}, source_size long, target double, quota long, shards long")
    renamed = sources.withColumnRenamed("source", "source_")
    placed = rows.join(F.broadcast(renamed.drop("quota")), F.col("source").eqNullSafe(F.col("source_")))
    placed = placed.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "t"), F.col("shards"))).drop("source", "source_", "shards")

    cell_cap = F.ceil(F.col("size") * epochs / block_words).cast("long")
    levels = [written(placed.groupBy("sx", "shard").agg(F.sum("size").alias("size")).withColumn("cap", cell_cap))]
    width = max((row[-1] for row in table), default=1)
    while width > FAN:
        width = -(-width // FAN)
        levels.append(levels[-1].groupBy("sx", F.floor(F.col("shard") / FAN).alias("shard")).agg(F.sum("size").alias("size"), F.sum("cap").alias("cap")))
    quotas = sources.select("sx", F.lit(0).cast("long").alias("parent"), "quota")
    for depth, level in enumerate(reversed(levels)):
        parent = F.lit(0).cast("long") if depth == 0 else F.floor(F.col("shard") / FAN)
        dealt = _dealt(level, quotas, parent)
        quotas = dealt.select("sx", F.col("shard").alias("parent"), "quota")
    cells = dealt.select("sx", "shard", F.col("size").alias("cell"), "quota")

    ring = Window.partitionBy("sx", "shard").orderBy("h", "doc_id", "size", "t")
    running = F.sum("size").over(ring.rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("at", running - F.col("size")).join(cells, ["sx", "shard"])
    words = F.least(F.col("quota") * block_words, F.col("cell") * epochs)
    start = F.pmod(F.xxhash64(F.lit(seed + 2), "sx", "shard"), F.greatest(F.lit(1), F.ceil(F.col("cell") / block_words))) * block_words
    placed = placed.withColumn("loops", F.when(F.col("cell") > 0, F.floor(words / F.greatest("cell", F.lit(1)))).otherwise(0))
    placed = placed.withColumn("run", words - F.col("loops") * F.col("cell")).withColumn("start", start)

    def overlap(low: Column, high: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("at") + F.col("size"), high) - F.greatest(F.col("at"), low))

    end = F.col("start") + F.col("run")
    part = overlap(F.col("start"), F.least(end, F.col("cell"))) + overlap(F.lit(0), end - F.col("cell"))
    taken = F.col("loops") * F.col("size") + part
    copies = F.when(F.col("size") > 0, F.floor(taken / F.greatest("size", F.lit(1)) + 0.5)).otherwise(0)
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), copies.cast("int").alias("copies"), "t")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix: each row of ``docs`` as often as the mix takes it, columns unchanged.

    Rows that agree in every column share their copies evenly, rounded.
    """
    plan = mix(docs, **options).groupBy("t").agg(F.floor(F.avg("copies") + F.lit(0.5)).cast("int").alias("copies")).where("copies > 0")
    rows = packed(docs, row_key(docs).alias("t")).join(plan, "t")
    return unpacked(rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))), docs.columns)
