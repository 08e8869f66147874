"""Runs: manifests, hashes, diffs, caches, budgets, compatibility and migration."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ids

# Fixed values of the footprint budget.
LEAST_SOURCE_BYTES = 1 << 20
BUDGET_FACTOR = 3.0
WARN_AT, BLOCK_AT = 0.8, 1.0


def canonical_json(value: object) -> str:
    """Sorted keys, ``", "`` and ``": "``, ASCII only."""
    return json.dumps(value, sort_keys=True)


def ingest_counts(records: DataFrame) -> DataFrame:
    """n_ok, n_skipped and n_failed."""
    return records.agg(*(F.count_if(F.col("parse_status") == s).alias(f"n_{s}") for s in ("ok", "skipped", "failed")))


def inputs_hash(records: DataFrame, column: str = "source_hash") -> DataFrame:
    """One digest of all source hashes, whatever their order.

    The digest is defined over the whole sorted list, so one task holds one hash
    for each source; sources of one run are files, not rows.
    """
    return records.agg(ids.set_digest(F.col(column)).alias("inputs_hash"))


def json_text(columns: list[str], schema) -> Column:
    """A row as canonical JSON (sorted keys, ``", "`` and ``": "``), as ``canonical_json`` writes it for ASCII values."""
    parts = []
    for c in sorted(columns):
        value = F.col(f"`{c}`")
        text = F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1) if isinstance(schema[c].dataType, T.StringType) else value.cast("string")
        parts.append(F.concat(F.lit(f"{json.dumps(c)}: "), F.when(value.isNull(), F.lit("null")).otherwise(text)))
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def outputs_hash(records: DataFrame, key: str | None = None) -> DataFrame:
    """One digest of the canonical JSON of all records in the order of ``key`` (else of their JSON).

    Like ``inputs_hash`` it is defined over the whole list, so one task holds the JSON of a run's records.
    """
    line = json_text(records.columns, records.schema)
    order = F.col(key).cast("string") if key else line
    sorted_lines = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("k"), line.alias("v")))), lambda x: x["v"])
    return records.agg(ids.digest(F.concat(F.lit("["), F.array_join(sorted_lines, ", "), F.lit("]"))).alias("outputs_hash"))


def run_diff(old: DataFrame, new: DataFrame, key: str = "path", value: str = "source_hash") -> DataFrame:
    """(path, change) of added, removed and changed paths between two runs."""
    a, b = old.select(F.col(key).alias("a_"), F.col(value).alias("old_")), new.select(F.col(key).alias("b_"), F.col(value).alias("new_"))
    joined = a.join(b, F.col("a_") == F.col("b_"), "full")
    change = F.when(F.col("a_").isNull(), F.lit("added")).when(F.col("b_").isNull(), F.lit("removed")).when(~F.col("old_").eqNullSafe(F.col("new_")), F.lit("changed"))
    return joined.select(F.coalesce("a_", "b_").alias(key), change.alias("change")).where("change is not null")


def normalised_legacy(records: DataFrame) -> DataFrame:
    """Old records of unchanged sources (skipped) become ok and cached."""
    old = (F.col("parse_status") == "skipped") & (F.col("skip_reason") == "unchanged_source")
    changed = {
        "source_origin": F.when(old, F.lit("cached")).otherwise(F.lit("fresh")),
        "parse_status": F.when(old, F.lit("ok")).otherwise(F.col("parse_status")),
        "skip_reason": F.when(F.coalesce(~old, F.lit(True)), F.col("skip_reason")),
    }
    return records.withColumns(changed)


STATUSES, ORIGINS = ("ok", "failed", "skipped"), ("fresh", "cached")


def checked_records(records: DataFrame) -> DataFrame:
    """``records``, failing at the first row with an unknown status or origin, or one that is cached but not ok."""
    status, origin = F.col("parse_status"), F.col("source_origin")
    good = F.coalesce(status.isin(*STATUSES) & origin.isin(*ORIGINS) & ((origin != "cached") | (status == "ok")), F.lit(False))
    return records.withColumn("parse_status", F.when(good, status).otherwise(F.raise_error(F.concat(F.lit("bad source record: "), F.concat_ws(", ", status, origin))).cast("string")))


def with_cache(records: DataFrame, previous: DataFrame) -> DataFrame:
    """``cached`` where the previous run has the same path and hash.

    Of previous records with a ``complete`` column only complete ones count.
    """
    if "complete" in previous.columns:
        previous = previous.where("complete")
    old = previous.select(F.col("path").alias("p_"), F.col("source_hash").alias("h_")).distinct()
    joined = records.join(old, (F.col("path") == F.col("p_")) & (F.col("source_hash") == F.col("h_")), "left")
    return joined.withColumn("source_origin", F.when(F.col("p_").isNotNull(), F.lit("cached")).otherwise(F.lit("fresh"))).drop("p_", "h_")


def merged_metadata(new: DataFrame, old: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """New values, or the old ones where the new ones are missing."""
    o = old.select(key, *(F.col(c).alias(f"old_{c}") for c in columns))
    return new.join(o, key, "left").select(key, *(F.coalesce(F.col(c), F.col(f"old_{c}")).alias(c) for c in columns))


def latest_run(runs: DataFrame) -> DataFrame:
    """The run that started last by the clock, ties by id."""
    return runs.orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(1)


def changed_since(runs: DataFrame, hours: float, now: Column | None = None, at: str = "started_at") -> DataFrame:
    """Runs of the last ``hours``."""
    moment = now if now is not None else F.current_timestamp()
    return runs.where(F.col(at) >= moment - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(hours) * 3600).cast("decimal(18,6)")))


def budget_status(source_bytes: DataFrame, store_bytes: DataFrame, factor: float = BUDGET_FACTOR) -> DataFrame:
    """limit, used, ratio and status (ok, warn, block) from tables with a ``size`` column."""
    limit = F.greatest(F.col("source"), F.lit(LEAST_SOURCE_BYTES).cast("long")) * factor
    sums = source_bytes.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source")).crossJoin(store_bytes.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("used")))  # one row each
    rows = sums.select("source", "used", limit.cast("double").alias("limit"))
    ratio = F.col("used") / F.col("limit")
    return rows.withColumn("ratio", F.round(ratio, 6)).withColumn("status", F.when(ratio >= BLOCK_AT, F.lit("block")).when(ratio >= WARN_AT, F.lit("warn")).otherwise(F.lit("ok")))


class BudgetExceeded(RuntimeError):
    """The store has outgrown its budget."""


def enforce_budget(status: DataFrame) -> dict[str, object]:
    """The one row of ``budget_status`` as a mapping; raises where it says block."""
    found = status.first().asDict()
    if found["status"] == "block":
        raise BudgetExceeded(f"store of {found['used']} bytes is over its limit of {found['limit']:.0f}")
    return found


def throughput_warnings(counts: dict[str, int]) -> list[dict[str, str]]:
    """Warnings for stages that produced nothing from something."""
    rules = (("no_entities", "entities", "documents"), ("no_links", "links", "entities"), ("empty_index", "index_terms", "entities"))
    return [{"code": code, "message": f"{counts.get(source, 0)} {source} gave no {made}", "hint": f"check the stage that makes {made}"} for code, made, source in rules if counts.get(source, 0) > 0 and counts.get(made, 0) == 0]


@dataclass(frozen=True)
class StageManifest:
    """A row of the table of runs."""

    stage: str
    run_id: str
    inputs_hash: str
    config_hash: str
    outputs_hash: str
    status: str = "ok"
    artifacts: tuple[str, ...] = ()
    warnings: tuple[str, ...] = ()
    schema_version: str = "v1"


class IncompatibleStore(RuntimeError):
    pass


def check_compatible(stored: str | None, expected: str = "v1") -> None:
    """A store written by another schema version is refused; an empty one passes."""
    if stored is not None and stored != expected:
        raise IncompatibleStore(f"store has schema {stored}, expected {expected}")


@dataclass
class Migrations:
    """Ordered steps from one schema version to the next."""

    steps: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = field(default_factory=dict)

    def register(self, source: str, target: str, step: Callable[[DataFrame], DataFrame]) -> None:
        self.steps[source] = (target, step)

    def migrate(self, df: DataFrame, source: str, target: str) -> DataFrame:
        while source != target:
            if source not in self.steps:
                raise IncompatibleStore(f"no step from {source} to {target}")
            source, step = self.steps[source]
            df = df.transform(step)
        return df


def gate_matrix(rows: DataFrame) -> DataFrame:
    """``passed`` of rows with measured, target and allowance: a missing measurement fails."""
    return rows.withColumn("passed", F.coalesce(F.col("measured") <= F.col("target") * (1 + F.col("allowance")), F.lit(False)))


def quality_gate(measured: float, target: float, allowance: float = 0.0) -> bool:
    """Whether a measurement stays within a target and its relative allowance."""
    return measured <= target * (1 + allowance)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Determinism gate: equal multisets of rows."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def keyed_latest(records: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One record for each key: the last in the given order."""
    row = F.max_by(F.struct(*records.columns), F.struct(*order)).alias("r")
    return records.groupBy(F.col(key).alias("key_")).agg(row).select("r.*")


def current_documents(documents: DataFrame, records: DataFrame) -> DataFrame:
    """Documents whose path and hash are among the run's readable records."""
    good = records.where("parse_status = 'ok'").select(F.col("path").alias("source_path"), "source_hash").distinct()
    return documents.join(good, ["source_path", "source_hash"], "left_semi")


def provenance_rows(artifacts: DataFrame, rule: str, run: str) -> DataFrame:
    """(artifact_id, source_path, source_hash, rule_id, input_hash, run_id); a run's rows replace its earlier ones."""
    return artifacts.select(F.col("id").alias("artifact_id"), "source_path", "source_hash", F.lit(rule).alias("rule_id"), F.col("source_hash").alias("input_hash"), F.lit(run).alias("run_id"))


def incomplete(records: DataFrame, required: tuple[str, ...] = ("id", "type", "name", "canonical_key")) -> DataFrame:
    """(id, missing): records that lack required fields, and which."""
    fields = F.array_compact(F.array(*(F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(c)) if c in records.columns else F.lit(c) for c in required)))
    return records.select("id", F.array_join(fields, ",").alias("missing")).where("missing <> ''")


def with_rule_confidence(claims: DataFrame, rules: dict[str, float], default: float = 1.0) -> DataFrame:
    """``confidence`` from the rule that made a claim."""
    if not rules:
        return claims.withColumn("confidence", F.lit(default))
    table = F.create_map(*(x for k, v in sorted(rules.items()) for x in (F.lit(k), F.lit(float(v)))))
    return claims.withColumn("confidence", F.coalesce(F.try_element_at(table, F.col("rule_id")), F.lit(default)))
