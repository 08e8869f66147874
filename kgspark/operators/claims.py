"""Notes, decision claims and log claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..storage import written


def frontmatter(text: Column) -> Column:
    """map<string,string> of title, tags, project and status in a leading ``---`` block; empty without one."""
    lines = F.split(text, "\n")

    def found(x: Column) -> Column:
        end = F.array_position(F.transform(F.slice(x, 2, F.size(x)), lambda v: F.trim(v)), "---")
        body = F.filter(F.slice(x, 2, F.greatest(end - 1, F.lit(0)).cast("int")), lambda v: F.contains(v, F.lit(":")))
        pairs = F.filter(F.transform(body, lambda v: F.struct(F.lower(F.trim(F.substring_index(v, ":", 1))).alias("k"), F.trim(F.substr(v, F.instr(v, ":") + 1)).alias("v"))), lambda p: p["k"].isin("title", "tags", "project", "status"))
        last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
        empty = F.map_from_entries(F.filter(pairs, lambda p: F.lit(False)))
        return F.when((F.trim(x[0]) == "---") & (end > 0), F.map_from_entries(last)).otherwise(empty)

    return F.transform(F.array(lines), found)[0]


def tag_list(value: Column) -> Column:
    """Comma-separated tags, trimmed, blank ones left out; quotes stay."""
    return F.filter(F.transform(F.split(value, ","), lambda t: F.trim(t)), lambda t: t != "")


def _title() -> Column:
    return F.coalesce(F.try_element_at(frontmatter(F.col("text")), F.lit("title")), F.regexp_extract("source_path", r"([^/]*?)(?:\.[^./]*)?$", 1))


def with_note_ids(docs: DataFrame) -> DataFrame:
    """Adds ``note_id``: the id of a document's note in ``notes``, null where another path has the title.

    Only the titles of several paths are joined, so texts stay where they are while those are few.
    """
    rows = docs.withColumn("key_", ids.canonical_key(_title()))
    many = written(rows.groupBy("key_").agg(F.min("source_path").alias("first_"), F.max("source_path").alias("last_")).where("first_ <> last_").select("key_", "last_"))
    own = F.when(F.col("last_").isNull() | (F.col("last_") == F.col("source_path")), ids.entity_id(F.col("key_")))
    return rows.join(many, "key_", "left").withColumn("note_id", own).drop("key_", "last_")


def notes(docs: DataFrame) -> DataFrame:
    """One note for each title (front matter, else the file's stem); of equal titles the last path wins."""
    title = _title()
    rows = docs.select(title.alias("name"), "source_path", "source_hash").withColumn("canonical_key", ids.canonical_key(F.col("name")))
    last = rows.groupBy("canonical_key").agg(F.max_by(F.struct("name", "source_path", "source_hash"), F.col("source_path")).alias("r"))
    return last.select(ids.entity_id(F.col("canonical_key")).alias("id"), F.lit("ag:note").alias("type"), "r.name", "canonical_key", "r.source_path", "r.source_hash")


def decision_claims(docs: DataFrame) -> DataFrame:
    """Files named like ``adr``: the first line is the decision."""
    name = F.lower(F.regexp_extract("source_path", "([^/]*)$", 1))
    title = F.regexp_replace(F.split("text", "\n")[0], "^[# ]+|[# ]+$", "")
    rows = docs.where(F.contains(name, F.lit("adr"))).select(title.alias("title"), "source_path").where("title <> ''")
    return rows.select(ids.claim_id(F.concat(F.lit("decision:"), F.col("title"))).alias("id"), F.lit("decision").alias("type"), F.lit("decided").alias("predicate"), F.col("title").alias("object"), "source_path")


def decision_index(claims: DataFrame) -> DataFrame:
    """(id, title, source_path) of the decisions among claims."""
    return claims.where("type = 'decision'").select("id", F.col("object").alias("title"), "source_path")


def log_claims(docs: DataFrame) -> DataFrame:
    """Lines of .log and .txt files that name an error, each claim once."""
    lines = docs.where(F.lower("source_path").rlike(r"\.(log|txt)$")).select(F.explode(F.split("text", "\n")).alias("line"), "source_path")
    rows = lines.select(F.trim("line").alias("line"), "source_path").where(F.contains(F.lower("line"), F.lit("error")))
    return rows.groupBy("line").agg(F.min("source_path").alias("source_path")).select(ids.claim_id(F.col("line")).alias("id"), F.lit("log").alias("type"), F.lit("observed").alias("predicate"), F.col("line").alias("object"), "source_path")


def with_contradictions(claims: DataFrame) -> DataFrame:
    """Flags claims whose (subject, predicate) has more than one object."""
    many = claims.groupBy("subject_id", "predicate").agg((F.count_distinct("object") > 1).alias("contradiction"))
    return claims.join(many, ["subject_id", "predicate"])


def pruned(records: DataFrame, stale_ids: DataFrame) -> DataFrame:
    """Records without the stale ids."""
    return records.join(stale_ids.select("id").distinct(), "id", "left_anti")


def pruned_links(links: DataFrame, stale_ids: DataFrame) -> DataFrame:
    """Links with neither end stale."""
    gone = stale_ids.select("id").distinct()
    return links.join(gone.withColumnRenamed("id", "from_id"), "from_id", "left_anti").join(gone.withColumnRenamed("id", "to_id"), "to_id", "left_anti")
