"""Commit selection, graph records of a history, and the questions asked of it.

Inputs: commits (sha, subject, author_name, author_email, authored_at,
committer_name, committer_email, committed_at, parent_shas, is_merge),
commit_files (sha, path, lines_changed), tags (name, tag_type, target_sha,
tagger_name, tagger_email, tagged_at), branches (name, head_sha).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.text import matches_any

# Rule names of the link kinds.
RULES = {
    "modifies": "link.git_modifies.v1",
    "parent_of": "link.git_parent.v1",
    "authored_by": "link.git_authored_by.v1",
    "contains": "link.git_contains.v1",
    "tags": "link.git_tags.v1",
    "on_branch": "link.git_branch.v1",
    "succeeded_from": "link.git_lineage.v1",
}
LINES_PER_FILE = 400.0


def importance(commit_files: DataFrame, cold_paths: list[str] | None = None) -> DataFrame:
    """sha, score: files and a four-hundredth of the lines; cold files do not count as files, all cold gives 0."""
    cold = F.coalesce(matches_any(F.col("path"), cold_paths or []), F.lit(False))
    sums = commit_files.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.count_if(~cold).alias("warm"), F.sum("lines_changed").alias("lines"))
    score = F.when(F.col("warm") == 0, F.lit(0.0)).otherwise(F.col("warm").cast("double") + F.col("lines").cast("double") / LINES_PER_FILE)
    return sums.select("sha", score.alias("score"))


def select_commits(commits: DataFrame, commit_files: DataFrame, tags: DataFrame, branches: DataFrame, budget: int = 1000, hot_paths: list[str] | None = None, cold_paths: list[str] | None = None) -> DataFrame:
    """sha, tier and importance_score of the commits to keep.

    Structural: roots, merges, tagged, branch heads, hot paths; score -1. The
    rest compete by score, then sha; the latest and earliest of them are always
    kept and count against the budget. The ranking is a top-k, not a window.
    """
    marks = tags.select(F.col("target_sha").alias("sha")).unionByName(branches.select(F.col("head_sha").alias("sha")))
    if hot_paths:
        marks = marks.unionByName(commit_files.where(matches_any(F.col("path"), hot_paths)).select("sha"))
    marks = marks.where("sha is not null").distinct().withColumn("marked", F.lit(True))
    rows = commits.select("sha", "authored_at", ((F.size("parent_shas") == 0) | F.col("is_merge")).alias("shape")).join(marks, "sha", "left")
    rows = rows.withColumn("structural", F.col("shape") | F.coalesce("marked", F.lit(False)))
    first = rows.where("structural").select("sha", F.lit("structural").alias("tier"), F.lit(-1.0).alias("importance_score"))
    rest = rows.where("not structural").select("sha", "authored_at").join(importance(commit_files, cold_paths), "sha", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    ends = rest.agg(F.max_by("sha", F.struct("authored_at", "sha")).alias("late"), F.min_by("sha", F.struct("authored_at", "sha")).alias("early")).first()
    forced = [s for s in {ends["late"], ends["early"]} if s is not None]
    must = F.col("sha").isin(*forced) if forced else F.lit(False)
    kept = rest.where(must).unionByName(rest.where(~must).orderBy(F.col("score").desc(), "sha").limit(max(0, budget - len(forced))))
    return first.unionByName(kept.select("sha", F.lit("scored").alias("tier"), F.col("score").alias("importance_score")))


def commit_nodes(commits: DataFrame, selected: DataFrame, repo: str) -> DataFrame:
    """Commit entities; the committer is null where it repeats the author."""
    same = (F.col("committer_name") == F.col("author_name")) & (F.col("committer_email") == F.col("author_email")) & (F.col("committed_at") == F.col("authored_at"))
    subject = F.split("subject", "\n")[0]
    return commits.join(selected, "sha").select(
        ids.git_id("commit", repo, F.col("sha")).alias("id"),
        F.lit("commit").alias("type"),
        subject.alias("name"),
        "sha",
        subject.alias("subject"),
        "author_name",
        "author_email",
        "authored_at",
        "is_merge",
        "parent_shas",
        "tier",
        "importance_score",
        *(F.when(same, F.lit(None)).otherwise(F.col(c)).alias(c) for c in ("committer_name", "committer_email", "committed_at")),
    )


def author_nodes(commits: DataFrame, repo: str) -> DataFrame:
    """One identity for each e-mail: sorted names, the first non-empty one as its name."""
    grouped = commits.groupBy(F.col("author_email").alias("email")).agg(F.array_sort(F.collect_set("author_name")).alias("name_aliases"))
    name = F.coalesce(F.get(F.filter("name_aliases", lambda n: n != ""), F.lit(0)), F.col("email"))
    return grouped.select(ids.git_id("author", repo, F.col("email")).alias("id"), F.lit("author_identity").alias("type"), name.alias("name"), "email", "name_aliases")


def tag_nodes(tags: DataFrame, repo: str) -> DataFrame:
    return tags.select(ids.git_id("tag", repo, F.col("name")).alias("id"), F.lit("tag").alias("type"), "name", "tag_type", "target_sha", "tagger_name", "tagger_email", "tagged_at")


def ref_nodes(branches: DataFrame, repo: str) -> DataFrame:
    return branches.select(ids.git_id("ref", repo, F.col("name")).alias("id"), F.lit("ref").alias("type"), "name", F.lit("branch").alias("ref_type"), "head_sha")


def repo_node(spark, repo: str) -> DataFrame:
    return spark.range(1).select(ids.git_id("repo", repo).alias("id"), F.lit("repository").alias("type"), F.lit(repo).alias("path"), F.lit(repo.rstrip("/").rsplit("/", 1)[-1]).alias("name"))


def file_nodes(commit_files: DataFrame) -> DataFrame:
    """One file entity for each path."""
    key = F.concat(F.lit("file:"), F.col("path"))
    return commit_files.select("path").distinct().select(ids.entity_id(key).alias("id"), F.lit("file").alias("type"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), key.alias("canonical_key"), F.col("path").alias("source_path"))


def git_links(commits: DataFrame, commit_files: DataFrame, tags: DataFrame, branches: DataFrame, repo: str, sha: Callable[[Column], Column] = lambda key: key) -> DataFrame:
    """The six kinds of links between commits, files, authors, tags, refs and the repository.

    ``sha`` gives a commit's sha where the tables have a shorter key of it, after all joins.
    """
    commit = lambda c: ids.git_id("commit", repo, sha(F.col(c)))
    known = commits.select("sha")

    def made(df: DataFrame, kind: str, source, target) -> DataFrame:
        df = df.select(source.alias("from_id"), target.alias("to_id"))
        return df.select(ids.link_id(RULES[kind], F.col("from_id"), F.col("to_id")).alias("id"), "from_id", "to_id", F.lit(kind).alias("type"), F.lit(RULES[kind]).alias("rule_id"), F.lit(1.0).alias("confidence"), F.lit("authoritative").alias("authority"))

    touched = commit_files.select("sha", "path").distinct().join(known, "sha", "left_semi")
    parents = commits.select("sha", F.explode("parent_shas").alias("parent")).join(known.withColumnRenamed("sha", "parent"), "parent", "left_semi")
    out = made(touched, "modifies", commit("sha"), ids.entity_id(F.concat(F.lit("file:"), F.col("path"))))
    for part in (
        made(parents, "parent_of", commit("sha"), commit("parent")),
        made(commits, "authored_by", commit("sha"), ids.git_id("author", repo, F.col("author_email"))),
        made(commits, "contains", ids.git_id("repo", repo), commit("sha")),
        made(tags.join(known.withColumnRenamed("sha", "target_sha"), "target_sha", "left_semi"), "tags", ids.git_id("tag", repo, F.col("name")), commit("target_sha")),
        made(branches.join(known.withColumnRenamed("sha", "head_sha"), "head_sha", "left_semi"), "on_branch", commit("head_sha"), ids.git_id("ref", repo, F.col("name"))),
    ):
        out = out.unionByName(part)
    return out


def lineage_links(renames: DataFrame) -> DataFrame:
    """``succeeded_from`` links of renames (commit_sha, old_path, new_path, detection_method, confidence)."""
    entity = lambda c: ids.entity_id(F.concat(F.lit("file:"), F.col(c)))
    rows = renames.select(entity("new_path").alias("from_id"), entity("old_path").alias("to_id"), "confidence", "detection_method", "commit_sha", "old_path", "new_path")
    return rows.select(ids.link_id(RULES["succeeded_from"], F.col("from_id"), F.col("to_id")).alias("id"), "from_id", "to_id", F.lit("succeeded_from").alias("type"), F.lit(RULES["succeeded_from"]).alias("rule_id"), "confidence", F.lit("heuristic").alias("authority"), "detection_method", "commit_sha", "old_path", "new_path")


def detect_renames(adds: DataFrame, deletes: DataFrame, similar: DataFrame | None = None) -> DataFrame:
    """Pairs of an added and a deleted file of one commit: same blob 1.0, similar 0.8, same base name elsewhere 0.6.

    ``adds`` and ``deletes`` have commit_sha, path and blob_sha; ``similar`` has
    the pairs (commit_sha, old_path, new_path, score) that a comparison of
    contents found, of which scores of 70 and more count. Each added file gets
    its best pair, the first old path among equals. An added file meets only the
    two first old paths of its blob or name, one of which is not its own, so no
    commit is paired all with all.
    """
    base = lambda c: F.regexp_extract(c, "([^/]*)$", 1)
    a = adds.select("commit_sha", F.col("path").alias("new_path"), F.col("blob_sha").alias("blob"), base("path").alias("name"))
    d = deletes.select("commit_sha", F.col("path").alias("old_path"), F.col("blob_sha").alias("blob"), base("path").alias("name"))

    def paired(key: str, method: str, confidence: float) -> DataFrame:
        order = Window.partitionBy("commit_sha", key).orderBy("old_path")
        first = d.select("commit_sha", key, "old_path").distinct().withColumn("k", F.row_number().over(order)).where("k <= 2")
        met = a.select("commit_sha", key, "new_path").distinct().join(first, ["commit_sha", key]).where("old_path <> new_path")
        return met.groupBy("commit_sha", "new_path").agg(F.min("old_path").alias("old_path")).select("commit_sha", "old_path", "new_path", F.lit(method).alias("detection_method"), F.lit(confidence).alias("confidence"))

    rows = paired("blob", "exact", 1.0).unionByName(paired("name", "basename", 0.6))
    if similar is not None:
        rows = rows.unionByName(similar.where("score >= 70 and old_path <> new_path").select("commit_sha", "old_path", "new_path", F.lit("similarity").alias("detection_method"), F.lit(0.8).alias("confidence")))
    best = F.min(F.struct((-F.col("confidence")).alias("c"), "old_path", "detection_method")).alias("b")
    return rows.groupBy("commit_sha", "new_path").agg(best).select("commit_sha", F.col("b.old_path").alias("old_path"), "new_path", F.col("b.detection_method").alias("detection_method"), (-F.col("b.c")).alias("confidence"))


def touching(commits: DataFrame, commit_files: DataFrame, path: str) -> DataFrame:
    """The commits that touch a path."""
    return commits.join(commit_files.where(F.col("path") == path).select("sha").distinct(), "sha", "left_semi")


def with_tags(commits: DataFrame, tags: DataFrame) -> DataFrame:
    names = tags.groupBy(F.col("target_sha").alias("sha")).agg(F.array_sort(F.collect_list("name")).alias("tags"))
    return commits.join(names, "sha", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def git_who(commits: DataFrame, commit_files: DataFrame, path: str) -> DataFrame:
    """Authors of a file: commit count, first and last date, names."""
    own = touching(commits, commit_files, path)
    return own.groupBy("author_email").agg(F.count(F.lit(1)).alias("commit_count"), F.min("authored_at").alias("earliest_date"), F.max("authored_at").alias("latest_date"), F.array_sort(F.collect_set("author_name")).alias("names"))


def git_log(commits: DataFrame, commit_files: DataFrame, tags: DataFrame, path: str) -> DataFrame:
    """Commits of a file, latest first."""
    own = with_tags(touching(commits, commit_files, path), tags)
    return own.select("sha", "subject", "author_name", "author_email", "authored_at", "is_merge", "tags").orderBy(F.col("authored_at").desc(), "sha")


def git_introduced(commits: DataFrame, commit_files: DataFrame, tags: DataFrame, path: str) -> DataFrame:
    """The earliest commit of a file, ties by sha."""
    own = touching(commits, commit_files, path).orderBy("authored_at", "sha").limit(1)
    return with_tags(own, tags).select("sha", "subject", "author_name", "author_email", "authored_at", "tags")


def git_history(commits: DataFrame, commit_files: DataFrame, tags: DataFrame, path: str) -> dict[str, DataFrame]:
    """The three answers together."""
    return {"who": git_who(commits, commit_files, path), "log": git_log(commits, commit_files, tags, path), "introduced": git_introduced(commits, commit_files, tags, path)}


def reverse_index(links: DataFrame, named: Callable[[Column], Column] = lambda key: key) -> DataFrame:
    """file id, commit ids: the commits of every file, sorted.

    ``named`` gives an id where the links have shorter keys, when they are gathered.
    """
    sets = links.where("type = 'modifies'").groupBy("to_id").agg(F.collect_set("from_id").alias("from_ids"))
    return sets.select(named(F.col("to_id")).alias("to_id"), F.array_sort(F.transform("from_ids", named)).alias("from_ids"))


def lineage_of(links: DataFrame, path: str) -> DataFrame:
    """The ``succeeded_from`` links that start at a path's file entity."""
    return links.where("type = 'succeeded_from'").where(F.col("from_id") == ids.entity_id(F.concat(F.lit("file:"), F.lit(path))))


def author_parts(raw) -> tuple:
    """(name, email) columns of ``Name <email>``; without brackets all of it is the name."""
    found = F.regexp_extract(raw, r"^\s*(.*?)\s*<([^<>]*)>\s*$", 1)
    mail = F.regexp_extract(raw, r"^\s*(.*?)\s*<([^<>]*)>\s*$", 2)
    bracketed = raw.rlike(r"^\s*.*?\s*<[^<>]*>\s*$")
    return F.when(bracketed, found).otherwise(F.trim(raw)), F.when(bracketed, mail).otherwise(F.lit(""))
