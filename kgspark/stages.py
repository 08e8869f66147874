"""The stages of a run over a store: ingest, extract, link, index, history, audit and export."""

from __future__ import annotations

import hashlib
import os
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as configuration
from .functions import ids
from .operators import chunking, claims, exports, graph, indexes, lifecycle, markdown, ner, provenance, redaction
from .sources import files, history

SCHEMA_VERSION = "v1"
FRONT = ("title", "tags", "project", "status")
ENTITY = ("id", "type", "name", "canonical_key", "source_path", "source_hash")
LINK = ("id", "from_id", "to_id", "type", "rule_id", "confidence", "authority")
RUNS = "run_id string, stage string, inputs_hash string, config_hash string, outputs_hash string, status string, config string, schema_version string, warnings string"
#: Tables that an audit reads, and the column that names their rows.
AUDITED = {"documents": "document_id", "segments": "segment_id", "chunks": "chunk_id", "entities": "id", "claims": "id", "git_entities": "id", "sources": "source_path"}


class Store:
    """Record tables below a folder, one Parquet table for each kind."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self):
        return self._path("x").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def has(self, name: str) -> bool:
        return self._files().exists(self._path(name))

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Replaces a table; ``df`` may read it. The new files take its place when they are all there."""
        fresh = f".{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{fresh}")
        self._files().delete(self._path(name), True)
        self._files().rename(self._path(fresh), self._path(name))
        return self.table(name)

    def append(self, name: str, df: DataFrame) -> None:
        df.write.mode("append").parquet(f"{self.root}/{name}")

    def size(self) -> int:
        """Bytes of all tables."""
        path = self._path("")
        return self._files().getContentSummary(path).getLength() if self._files().exists(path) else 0


def profile_store(spark: SparkSession, root: str, conf: configuration.Config) -> Store:
    """The store of the configuration's profile; the default one is the root itself."""
    name = configuration.profile_name(conf.raw.get("active_profile", "default"))
    return Store(spark, root if name == "default" else f"{root.rstrip('/')}/profiles/{name}")


def _detectors(conf: configuration.Config) -> list[str]:
    own = conf.section("redaction")
    for name, raw in (own.get("custom") or {}).items():
        redaction.register(redaction.Detector(name, raw.get("category", "custom"), raw["pattern"], int(raw.get("group", 0))))
    return [*own["detectors"], *(own.get("custom") or {})] if own.get("enabled", True) else []


# ------------------------------------------------------------------ ingest


def source_records(found: DataFrame, refused: DataFrame, previous: DataFrame | None) -> DataFrame:
    """A row for each source: path, hash, size, status, reasons and whether the last run has it already."""
    rows = found.select("source_path", F.sha2("content", 256).alias("source_hash"), F.col("length").alias("size"), "parse_status", "status_reason", "skip_reason")
    rows = rows.unionByName(refused, allowMissingColumns=True).withColumn("path", F.col("source_path"))
    if previous is None:
        rows = rows.withColumn("source_origin", F.lit("fresh"))
    else:
        rows = lifecycle.with_cache(rows, previous)
        rows = rows.withColumn("source_origin", F.when(F.col("parse_status") == "ok", F.col("source_origin")).otherwise(F.lit("fresh")))
    return lifecycle.checked_records(rows)


def ingest(store: Store, source: str, conf: configuration.Config, key: bytes, include: list[str] | None = None) -> dict:
    """Files to documents, segments and chunks.

    A source with the path and hash of a readable one of the last run is not
    read again. Links out of the source folder are recorded and not read. Secrets
    are replaced before anything is written. Documents keep the hashes they had.
    """
    if store.has("runs"):
        last = lifecycle.latest_run(store.table("runs")).first()
        lifecycle.check_compatible(last["schema_version"] if last else None, SCHEMA_VERSION)
    options = conf.profile.get("ingestion") or {}
    found = files.with_parse_status(files.scan(store.spark, source, conf.profile.get("exclude_globs"), include or conf.profile.get("include_paths")))
    old = store.table("documents") if store.has("documents") else None
    previous = None
    if old is not None and store.has("ingest_records"):
        complete = old.where("text is not null").select("source_path", "source_hash").distinct()
        previous = store.table("ingest_records").where("parse_status = 'ok'").join(complete, ["source_path", "source_hash"], "left_semi").select("path", "source_hash")
    records = store.write("new_records", source_records(found, files.refusals(store.spark, source), previous))
    sizes = records.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("size"))
    source_bytes = sizes.first()["size"]
    used = store.spark.createDataFrame([(store.size() + source_bytes,)], "size long")
    budget = lifecycle.enforce_budget(lifecycle.budget_status(sizes, used, float(conf.section("footprint_budget").get("factor", lifecycle.BUDGET_FACTOR))))

    fresh = found.join(records.where("source_origin = 'fresh' and parse_status = 'ok'").select("source_path"), "source_path", "left_semi")
    docs, pieces = files.parsed(fresh, max_bytes=int(options.get("max_file_size_bytes", 200 << 20)))
    names = _detectors(conf)
    # Whole texts are redacted, before they are cut, so a secret of several lines is seen whole.
    docs = store.write("new_documents", redaction.redacted(docs.where("text <> '' or status_reason is not null"), key, names))
    pieces = store.write("new_parts", redaction.redacted(pieces, key, names))
    read = docs.where("status_reason is null")
    merged = read.drop("status_reason").withColumn("hash_history", F.array("source_hash"))
    if old is not None:
        kept = old.join(read.select("document_id"), "document_id", "left_anti")
        histories = chunking.upserted(old.select("document_id", "source_hash", "hash_history"), read.select("document_id", "source_hash")).select("document_id", "hash_history")
        merged = kept.drop("hash_history").unionByName(merged.drop("hash_history")).join(histories, "document_id")
    docs = store.write("documents", merged)

    segments = chunking.segments(read.join(pieces.select("document_id").distinct(), "document_id", "left_anti"))
    own = pieces.select("document_id", "order", "type", F.trim("text").alias("text")).where("text <> ''")
    segments = segments.unionByName(own.withColumn("segment_id", ids.segment_id(F.col("document_id"), F.col("type"), F.col("order"), F.col("text"))))
    chunks = chunking.with_ranges(chunking.chunks(read, int(options.get("chunk_tokens", conf.section("chunking")["tokens"])), int(options.get("chunk_overlap_tokens", conf.section("chunking")["overlap"]))), segments)
    for name, rows in (("segments", segments), ("chunks", chunks)):
        if store.has(name):
            rows = store.table(name).join(read.select("document_id"), "document_id", "left_anti").unionByName(rows)
        store.write(name, rows)

    failed = store.table("new_documents").where("status_reason is not null").select("source_path", F.col("status_reason").alias("failure"))
    records = records.join(failed, "source_path", "left").withColumn("parse_status", F.when(F.col("failure").isNotNull(), F.lit("failed")).otherwise(F.col("parse_status")))
    records = store.write("ingest_records", records.withColumn("status_reason", F.coalesce("failure", "status_reason")).drop("failure"))
    front = claims.frontmatter(F.col("text"))
    fields = read.select("source_path", *(F.try_element_at(front, F.lit(c)).alias(c) for c in FRONT))
    sources = records.select("source_path", "source_hash", "size", "parse_status", "source_origin").join(fields, "source_path", "left")
    if store.has("sources"):
        # A cached source keeps the front matter that was read when it was fresh.
        sources = sources.drop(*FRONT).join(lifecycle.merged_metadata(sources, store.table("sources"), "source_path", list(FRONT)), "source_path")
    store.write("sources", sources)
    counts = lifecycle.ingest_counts(records).first().asDict()
    counts |= {"n_cached": records.where("source_origin = 'cached'").count(), "n_refused": records.where("skip_reason = 'symlink_refused'").count()}
    return counts | ({"budget": budget} if budget["status"] == "warn" else {})


def current(store: Store) -> DataFrame:
    """The documents of the last ingest."""
    return lifecycle.current_documents(store.table("documents"), store.table("ingest_records"))


def normalize(store: Store) -> dict:
    """The stage between ingest and extract: texts are normalised when they are read, so it only names its input."""
    if not store.has("ingest_records"):
        return {"status": "missing_manifest"}
    return {"status": "ok", "outputs_hash": _records_hash(store.table("ingest_records"))}


# ------------------------------------------------------------------ extract, link, index


def extract(store: Store, conf: configuration.Config | None = None) -> dict:
    """Notes, markdown records, claims and, where the profile asks for them, entity mentions."""
    conf = conf or configuration.Config()
    docs = current(store)
    prose = docs.where(F.lower("source_path").rlike(r"\.(md|markdown)$"))
    notes, tokens = claims.notes(prose), markdown.token_rows(prose)
    sections, techs = markdown.sections(tokens), markdown.technologies(tokens)
    refs = markdown.references(tokens, docs.select("source_path", "document_id"))
    every = notes.select(*ENTITY)
    for part in (sections.withColumnRenamed("slug_path", "canonical_key"), techs, refs.withColumnRenamed("target", "canonical_key")):
        every = every.unionByName(part.select(*ENTITY))
    links = markdown.markdown_links(sections, techs, refs, markdown.owners(tokens, sections, notes), notes, tokens)
    links = links.select("id", "from_id", "to_id", "type", "rule_id", F.lit(1.0).alias("confidence"), F.lit("authoritative").alias("authority"))
    wanted = (conf.profile.get("extraction") or {}).get("ner") or {}
    found = 0
    if wanted.get("enabled"):
        entities, mentioned = mentions(store, docs, wanted)
        found = entities.count()
        every = every.unionByName(entities.select("id", "type", "name", "canonical_key", F.lit(None).cast("string").alias("source_path"), F.lit(None).cast("string").alias("source_hash")))
        links = links.unionByName(mentioned)
    store.write("entities", every)
    store.write("extracted_links", links)
    store.write("claims", claims.decision_claims(docs).unionByName(claims.log_claims(docs)))
    return {"entities": store.table("entities").count(), "claims": store.table("claims").count(), "mentioned": found}


def mentions(store: Store, docs: DataFrame, wanted: dict) -> tuple[DataFrame, DataFrame]:
    """Entities named in the chunks of documents, and their links to chunks and to each other."""
    chunks = store.table("chunks").join(docs.select("document_id", "source_path"), "document_id")
    readable = ner.readable(chunks, float(wanted.get("quality_threshold", 0.3)))
    found = ner.mentions(readable)
    numbers = ner.case_numbers(readable)
    # The offset of a case number is that of its first place in the chunk.
    numbers = numbers.distinct().join(readable.select("chunk_id", "text"), "chunk_id").select("chunk_id", "type", "surface", F.expr("locate(surface, text)").cast("long").alias("start"))
    numbers = numbers.select("chunk_id", "type", "surface", (F.col("start") - 1).alias("start"), (F.col("start") - 1 + F.length("surface")).alias("end"))
    found = store.write("mentions", found.unionByName(numbers))
    entities = ner.filtered(ner.rolled_up(found))
    links = ner.mention_links(found, entities)
    shared = ner.cooccurrence_links(links.select(F.col("from_id").alias("id"), F.col("to_id").alias("chunk_id")))
    made = lambda df, rule, confidence: df.select("id", "from_id", "to_id", "type", F.lit(rule).alias("rule_id"), confidence.alias("confidence"), F.lit("heuristic").alias("authority"))
    return entities, made(links, "ner.mention.v1", F.lit(1.0)).unionByName(made(shared, "ner.cooccurrence.v1", F.col("confidence")))


def link(store: Store) -> dict:
    """Extracted and co-occurrence links in one table."""
    rows = graph.cooccurrence(store.table("entities").where("source_path is not null")).select(*LINK)
    store.write("links", rows.unionByName(store.table("extracted_links").select(*LINK)))
    return {"links": store.table("links").count()}


def index(store: Store) -> dict:
    """Keyword, type, adjacency and decision indexes; the keyword index is clustered by term."""
    entities, links = all_entities(store), all_links(store)
    terms = indexes.keyword_index(entities)
    store.write("keyword_index", terms.repartitionByRange("term").sortWithinPartitions("term"))
    store.write("type_index", indexes.type_index(entities).repartitionByRange("type", "id").sortWithinPartitions("type", "id"))
    store.write("adjacency", indexes.adjacency(links).repartitionByRange("from_id").sortWithinPartitions("from_id"))
    store.write("decisions", claims.decision_index(store.table("claims")))
    return {"terms": store.table("keyword_index").select("term").distinct().count()}


def all_entities(store: Store) -> DataFrame:
    """Extracted and history entities together."""
    rows = store.table("entities")
    return rows.unionByName(store.table("git_entities"), allowMissingColumns=True) if store.has("git_entities") else rows


def all_links(store: Store) -> DataFrame:
    rows = store.table("links").select(*LINK)
    for name in ("git_links", "git_lineage"):
        if store.has(name):
            rows = rows.unionByName(store.table(name).select(*LINK))
    return rows


def graph_records(store: Store) -> tuple[DataFrame, DataFrame]:
    """All nodes (entities, documents, chunks) as rows of one shape, and the links between them."""
    docs = current(store)
    parts = store.table("chunks").join(docs.select("document_id", "source_path", "source_hash"), "document_id")
    nodes = exports.graph_nodes(all_entities(store), docs, parts)
    return nodes, graph.intact(all_links(store), nodes)


# ------------------------------------------------------------------ history


def git(store: Store, repo: str, conf: configuration.Config) -> dict:
    """A repository's history: its tables, entities of all kinds, links between them, renames and the file index."""
    repo = os.path.realpath(repo)
    store.spark.dataSource.register(history.GitHistory)
    for name in history.SCHEMAS:
        store.write(f"git_{name}", store.spark.read.format("git_history").option("repo", repo).option("table", name).load())
    c, f, t, b = (store.table(f"git_{n}") for n in ("commits", "commit_files", "tags", "branches"))
    own = conf.profile.get("git_provenance") or {}
    kept = store.write("git_selected", provenance.select_commits(c, f, t, b, own.get("max_tier2_commits", 1000), own.get("hot_paths"), own.get("cold_paths")))
    chosen = c.join(kept.select("sha"), "sha", "left_semi")
    touched = f.join(kept.select("sha"), "sha", "left_semi")
    changes = store.table("git_changes").join(kept.select(F.col("sha").alias("commit_sha")), "commit_sha", "left_semi")
    renames = provenance.detect_renames(changes.where("change = 'add'"), changes.where("change = 'delete'"), store.table("git_similar").join(kept.select(F.col("sha").alias("commit_sha")), "commit_sha", "left_semi"))
    lineage = store.write("git_lineage", provenance.lineage_links(renames))
    paths = touched.select("path").unionByName(lineage.select(F.col("old_path").alias("path"))).unionByName(lineage.select(F.col("new_path").alias("path")))
    parts = [provenance.commit_nodes(c, kept, repo), provenance.author_nodes(chosen, repo), provenance.tag_nodes(t, repo), provenance.ref_nodes(b, repo), provenance.repo_node(store.spark, repo), provenance.file_nodes(paths)]
    nodes = parts[0]
    for part in parts[1:]:
        nodes = nodes.unionByName(part, allowMissingColumns=True)
    nodes = store.write("git_entities", nodes)
    links = store.write("git_links", provenance.git_links(chosen, f, t, b, repo))
    store.write("git_file_commits", provenance.reverse_index(links))
    counts = {r["type"]: r["count"] for r in nodes.groupBy("type").count().collect()}
    return {"commits": counts.get("commit", 0), "nodes": counts, "links": links.count(), "renames": lineage.count()}


# ------------------------------------------------------------------ runs


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _records_hash(records: DataFrame) -> str:
    """The digest of a run's source records in canonical JSON, by path."""
    rows = records.select("path", "source_hash", "parse_status", "status_reason", "skip_reason")
    return lifecycle.outputs_hash(rows, "path").first()[0]


def _ids_hash(*tables: DataFrame) -> str:
    """A digest of the ids of some tables, whatever their order, from sums of their hashes."""
    sums = [df.agg(F.count(F.lit(1)), F.sum(F.conv(F.left(F.sha2("id", 256), F.lit(15)), 16, 10).cast("decimal(38,0)"))).first() for df in tables]
    return _sha(lifecycle.canonical_json([[str(x) for x in s] for s in sums]))


def record_run(store: Store, conf: configuration.Config, warnings: list[dict]) -> str:
    """Appends a row for each stage to the table of runs, each stage's input being the one before; the run's id."""
    records = store.table("ingest_records")
    inputs = lifecycle.inputs_hash(records).first()[0]
    config_hash = _sha(conf.snapshot())
    run_id, rows = "run_" + _sha(inputs + config_hash), []
    outputs = _records_hash(records)
    made = {"ingest": outputs, "normalize": outputs, "extract": _ids_hash(store.table("entities"), store.table("claims")), "link": _ids_hash(store.table("links")), "index": _ids_hash(store.table("keyword_index"), store.table("type_index"))}
    for stage, outputs in made.items():
        told = lifecycle.canonical_json(warnings if stage == "index" else [])
        rows.append((run_id, stage, inputs, config_hash, outputs, "ok", conf.snapshot(), SCHEMA_VERSION, told))
        inputs = outputs
    store.append("runs", store.spark.createDataFrame(rows, RUNS).withColumn("started_at", F.current_timestamp()))
    docs = current(store).withColumnRenamed("document_id", "id")
    store.append("provenance", lifecycle.provenance_rows(docs, "ingest.source.v1", run_id))
    return run_id


def rebuild(store: Store, source: str, conf: configuration.Config, key: bytes) -> dict:
    """All stages, the audit, and a row for each stage."""
    configuration.check_rule_packs(conf)
    out = {"ingest": ingest(store, source, conf, key), "normalize": normalize(store)}
    if (conf.profile.get("git_provenance") or {}).get("enabled"):
        out["git"] = git(store, source, conf)
    out |= {"extract": extract(store, conf), "link": link(store), "index": index(store)}
    counts = {"documents": out["ingest"]["n_ok"], "entities": out["extract"]["entities"], "links": out["link"]["links"], "index_terms": out["index"]["terms"]}
    out["warnings"] = lifecycle.throughput_warnings(counts)
    return out | {"run_id": record_run(store, conf, out["warnings"]), "postcondition": validate(store, conf)}


def validate(store: Store, conf: configuration.Config) -> dict:
    """Secrets left in any table of the store; raises where there are some."""
    names, found = _detectors(conf), {}
    for name, key in AUDITED.items():
        if store.has(name):
            n = redaction.misses(store.table(name), key, names).count()
            if n:
                found[name] = n
    if found:
        raise redaction.PostconditionFailed(f"{sum(found.values())} unredacted fields in {', '.join(found)}")
    return {"status": "pass", "misses": 0}


def validate_profiles(spark: SparkSession, root: str, conf: configuration.Config) -> dict:
    """The audit of every profile's store; pass only where all pass."""
    out = {}
    for name in sorted(conf.raw.get("profiles") or {"default": {}}):
        own = configuration.Config({**conf.raw, "active_profile": name})
        store = profile_store(spark, root, own)
        if store.has("documents"):
            try:
                out[name] = validate(store, own)
            except redaction.PostconditionFailed as error:
                out[name] = {"status": "fail", "message": str(error)}
    return {"status": "fail" if any(v["status"] == "fail" for v in out.values()) else "pass", "profiles": out}


# ------------------------------------------------------------------ export


def export(store: Store, kind: str, path: str, conf: configuration.Config, key: bytes) -> dict:
    """A whole document of the store in a format, redacted once more on its way out, with the counts in it."""
    names = _detectors(conf)
    if kind == "json":
        lifecycle.enforce_budget(lifecycle.budget_status(store.table("ingest_records").select("size"), store.spark.createDataFrame([(store.size(),)], "size long"), float(conf.section("footprint_budget").get("factor", lifecycle.BUDGET_FACTOR))))
        records = {"entities": all_entities(store), "documents": current(store), "chunks": store.table("chunks")}
        keys = {"entities": "id", "documents": "document_id", "chunks": "chunk_id"}
        left = sum(redaction.misses(df, keys[k], names).count() for k, df in records.items())
        metadata = {
            "created_at": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"),
            "profile": conf.raw.get("active_profile", "default"),
            "root_id": _sha(os.path.realpath(store.root)),
            "redaction_detectors": names,
            "redaction_summary": {"redacted_on_export": left},
            "clean_room": bool(names),
        }
        return exports.export_json({k: redaction.redacted(df, key, names) for k, df in records.items()}, keys, metadata, path)
    if kind == "neo4j":
        nodes, links = graph_records(store)
        return exports.export_cypher(redaction.redacted(nodes, key, names), links, path)
    return exports.export_graph(redaction.redacted(exports.graph_nodes(all_entities(store)), key, names), kind, path)
