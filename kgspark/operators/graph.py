"""Bounded traversal, direct connections and co-occurrence links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..storage import written

# Entity types that never take part in source co-occurrence.
NO_COOCCURRENCE = ("ag:section", "ag:technology", "ag:reference")


def allowed_edges(links: DataFrame, edge_types: list[str] | None = None, min_confidence: float | None = None) -> DataFrame:
    """Edges that a traversal may use; a missing confidence counts as 1."""
    edges = links.select("from_id", "to_id", "type", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), "rule_id")
    if edge_types:
        edges = edges.where(F.col("type").isin(*edge_types))
    if min_confidence is not None:
        edges = edges.where(F.col("confidence") >= min_confidence)
    return edges


def clustered(links: DataFrame, partitions: int | None = None) -> DataFrame:
    """The edges written once, in order of ``from_id``: what a traversal of several hops should read."""
    edges = allowed_edges(links)
    ranged = edges.repartitionByRange(partitions, "from_id") if partitions else edges.repartitionByRange("from_id")
    return written(ranged.sortWithinPartitions("from_id"))


def neighbors(links: DataFrame, start: str, depth: int = 1, edge_types: list[str] | None = None, min_confidence: float | None = None) -> DataFrame:
    """hop, from_id, to_id, type, confidence, rule_id of all out-edges within ``depth`` hops.

    A node is expanded once, at its least hop; edges back to seen nodes are kept.
    Each hop is a semi join of the edges with the frontier; ``clustered`` edges
    are computed once and let a hop skip the row groups without its nodes.
    """
    edges = allowed_edges(links, edge_types, min_confidence)
    frontier = links.sparkSession.createDataFrame([(start,)], "from_id string")
    seen, found = frontier, []
    for hop in range(1, depth + 1):
        step = written(edges.join(frontier, "from_id", "left_semi").select(F.lit(hop).cast("long").alias("hop"), *edges.columns))
        found.append(step)
        if hop == depth:
            break
        frontier = written(step.select(F.col("to_id").alias("from_id")).distinct().join(seen, "from_id", "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    if not found:
        return edges.select(F.lit(0).cast("long").alias("hop"), *edges.columns).limit(0)
    out = found[0]
    for step in found[1:]:
        out = out.unionByName(step)
    return out


def why_connected(links: DataFrame, source: str, target: str) -> DataFrame:
    """The first direct edge by (type, to_id, rule), or no row."""
    own = allowed_edges(links).where((F.col("from_id") == source) & (F.col("to_id") == target))
    return own.orderBy("type", "to_id", "rule_id").limit(1)


def shortest_path(links: DataFrame, source: str, target: str, depth: int = 4) -> DataFrame:
    """An extension: (hop, from_id, to_id, type) of one shortest path within ``depth`` hops, or no rows."""
    reached = neighbors(links, source, depth)
    hops = reached.where(F.col("to_id") == target).agg(F.min("hop")).first()[0]
    at, rows = target, []
    while hops:
        edge = reached.where((F.col("hop") == hops) & (F.col("to_id") == at)).orderBy("from_id", "type").first()
        rows.append((hops, edge["from_id"], edge["to_id"], edge["type"]))
        at, hops = edge["from_id"], hops - 1
    return links.sparkSession.createDataFrame(rows[::-1], "hop long, from_id string, to_id string, type string")


def cooccurrence(members: DataFrame, rule: str = ids.RULE_COOCCURRENCE, named: Callable[[Column], Column] = lambda key: key) -> DataFrame:
    """Links between every two entities of a source, in both directions, each id once.

    ``members`` has id, type, source_path and source_hash. The evidence of a pair
    with several sources is the smallest path. The result has one row for each
    linked pair, so sources with many entities make many rows by definition;
    adaptive skew handling splits the join. A pair is gathered once and turned
    into its two links at the end; there ``named`` gives an entity's id where
    ``id`` is a shorter key.
    """
    own = members.where(~F.col("type").startswith("ner:") & ~F.col("type").isin(*NO_COOCCURRENCE)).select("id", "source_path", "source_hash").groupBy("source_path", "id").agg(F.min("source_hash").alias("source_hash"))
    pairs = own.alias("a").join(own.alias("b"), F.expr("a.source_path = b.source_path and a.id < b.id"))
    evidence = F.min(F.struct(F.col("a.source_path"), F.col("a.source_hash").alias("a_hash"), F.col("b.source_hash").alias("b_hash")))
    found = pairs.groupBy(F.col("a.id").alias("a"), F.col("b.id").alias("b")).agg(evidence.alias("e")).select(named(F.col("a")).alias("a"), named(F.col("b")).alias("b"), "e")
    # The hash is that of the smaller id.
    source_hash = F.when(F.col("a") < F.col("b"), F.col("e.a_hash")).otherwise(F.col("e.b_hash"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("from_id"), F.col("b").alias("to_id")), F.struct(F.col("b").alias("from_id"), F.col("a").alias("to_id")))).alias("l")
    links = found.select(ends, F.col("e.source_path").alias("source_path"), source_hash.alias("source_hash")).select("l.from_id", "l.to_id", "source_path", "source_hash")
    return links.select(ids.link_id(rule, F.col("from_id"), F.col("to_id")).alias("id"), "from_id", "to_id", F.lit("relates_to").alias("type"), F.lit(rule).alias("rule_id"), F.lit(1.0).alias("confidence"), F.lit("authoritative").alias("authority"), "source_path", "source_hash")


def intact(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links whose both ends are nodes (``id``)."""
    return links.join(nodes.select(F.col("id").alias("from_id")).distinct(), "from_id", "left_semi").join(nodes.select(F.col("id").alias("to_id")).distinct(), "to_id", "left_semi")
