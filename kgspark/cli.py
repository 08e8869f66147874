"""Command line over a folder of Parquet record tables; every command prints one JSON object.

Exit codes: 1 general, 3 secrets left, 4 encryption required, 5 rule pack.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import config as configuration
from . import jobs, stages
from .operators import chunking, exports, graph, indexes, lifecycle, provenance, redaction
from .plans import predicates
from .session import session
from .sources import connection
from .stages import Store

#: Rows that a command prints; more is told, and left to exports.
MOST = 10_000


def _rows(df: DataFrame, most: int = MOST) -> list[dict]:
    """At most ``most`` rows, each as a mapping."""
    return [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"))).limit(most).collect()]


def _told(name: str, df: DataFrame) -> dict:
    """Rows under a name, and whether there are more of them."""
    rows = _rows(df, MOST + 1)
    return {name: rows[:MOST]} | ({"truncated": True} if len(rows) > MOST else {})


def list_entities(store: Store, a: argparse.Namespace) -> dict:
    rows = predicates.filtered(stages.all_entities(store), a.type or [], a.where or [])
    if a.group_by:
        groups = _told("groups", predicates.grouped(rows, a.group_by).orderBy(F.col("n").desc(), "group"))
        return groups | {"groups": {r["group"]: r["n"] for r in groups["groups"]}, "total": rows.count()}
    total = rows.count()
    if a.count_only:
        return {"count": total}
    limit = min(a.limit if a.limit is not None else MOST, MOST)
    page = predicates.ranked(rows, predicates.sort_keys(rows, a.sort, a.desc), limit, a.offset)
    return {"results": _rows(page.drop("rank")), "total": total, "truncated": predicates.truncated(total, limit, a.offset)}


def search(store: Store, text: str, where: list[str], chunks: bool) -> dict:
    hits = indexes.keyword_lookup(store.table("keyword_index"), text).join(predicates.filtered(stages.all_entities(store), where=where), "id")
    out = _told("results", indexes.ranked_hits(hits))
    if chunks and not where:
        out |= _told("chunks", chunking.substring_hits(store.table("chunks"), text).orderBy("document_id", F.col("order").cast("string")))
    return out


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kgspark")
    top.add_argument("--store", default=".kg")
    top.add_argument("--config")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("version", "init", "normalize", "extract", "link", "index"):
        sub.add_parser(name)
    for name in ("ingest", "rebuild", "run", "git-provenance"):
        sub.add_parser(name).add_argument("source")
    i = sub.add_parser("import")
    i.add_argument("source")
    i.add_argument("--path", action="append", required=True, help="a file or folder below the source; may be repeated")
    v = sub.add_parser("validate-store")
    v.add_argument("--profile")
    v.add_argument("--all-profiles", action="store_true")
    v.add_argument("--format", choices=("json", "text"), default="json")
    again = sub.add_parser("replay")
    again.add_argument("run_id")
    again.add_argument("source")
    for name in ("git-who", "git-log", "git-introduced", "git-history"):
        sub.add_parser(name).add_argument("path")
    q = sub.add_parser("query")
    q.add_argument("--q", required=True)
    q.add_argument("--where", action="append")
    q.add_argument("--chunks", action="store_true")
    ls = sub.add_parser("list")
    for name in ("--type", "--where"):
        ls.add_argument(name, action="append")
    ls.add_argument("--sort")
    ls.add_argument("--desc", action="store_true")
    ls.add_argument("--limit", type=int)
    ls.add_argument("--offset", type=int, default=0)
    ls.add_argument("--count-only", action="store_true")
    ls.add_argument("--group-by")
    sub.add_parser("node").add_argument("id")
    n = sub.add_parser("neighbors")
    n.add_argument("id")
    n.add_argument("--depth", type=int, default=1)
    n.add_argument("--edge-type", action="append")
    n.add_argument("--min-confidence", type=float)
    w = sub.add_parser("why-connected")
    w.add_argument("source")
    w.add_argument("target")
    d = sub.add_parser("diff")
    d.add_argument("old")
    d.add_argument("new")
    e = sub.add_parser("export")
    e.add_argument("--format", choices=("json", "dot", "graphml", "neo4j"), default="json")
    e.add_argument("--output", required=True)
    s = sub.add_parser("sync-neo4j")
    s.add_argument("--dry-run", action="store_true")
    s.add_argument("--require-tls", action="store_true")
    j = sub.add_parser("jobs")
    j.add_argument("verb", choices=("list", "run"))
    j.add_argument("name", nargs="?")
    j.add_argument("--file", required=True)
    return top


def run(a: argparse.Namespace) -> dict:
    if a.command == "version":
        return {"version": "0.1.0"}
    if a.command == "init":
        return {"created": configuration.scaffold(a.store)}
    conf = configuration.load(a.config)
    if getattr(a, "profile", None):
        conf = configuration.Config({**conf.raw, "active_profile": configuration.profile_name(a.profile)})
    if a.command == "jobs" and a.verb == "list":
        return {"jobs": [x.name for x in jobs.load(a.file)]}
    if a.command == "sync-neo4j":
        made = connection.connection(require_tls=a.require_tls)
    store = stages.profile_store(session(), a.store, conf)
    key = bytes.fromhex(_key(store.root))
    if a.command in ("ingest", "import"):
        return stages.ingest(store, a.source, conf, key, getattr(a, "path", None))
    if a.command in ("rebuild", "run"):
        return stages.rebuild(store, a.source, conf, key)
    if a.command == "replay":
        stored = store.table("runs").where(F.col("run_id") == a.run_id).orderBy(F.col("started_at").desc()).first()
        if stored is None:
            return {"status": "not_found", "run_id": a.run_id}
        again = stages.rebuild(store, a.source, configuration.Config(json.loads(stored["config"])), key)
        return again | {"same_run": again["run_id"] == a.run_id}
    if a.command == "extract":
        return stages.extract(store, conf)
    if a.command in ("normalize", "link", "index"):
        return {"normalize": stages.normalize, "link": stages.link, "index": stages.index}[a.command](store)
    if a.command == "validate-store":
        return stages.validate_profiles(store.spark, a.store, conf) if a.all_profiles else stages.validate(store, conf)
    if a.command == "git-provenance":
        return stages.git(store, a.source, conf)
    if a.command.startswith("git-"):
        c, f, t = (store.table(f"git_{n}") for n in ("commits", "commit_files", "tags"))
        answers = provenance.git_history(c, f, t, a.path)
        wanted = answers if a.command == "git-history" else {a.command[4:]: answers[a.command[4:]]}
        return {k: _rows(v) for k, v in wanted.items()}
    if a.command == "query":
        return search(store, a.q, a.where or [], a.chunks)
    if a.command == "list":
        return list_entities(store, a)
    if a.command == "node":
        found = _rows(exports.node_view(stages.all_entities(store), store.table("documents"), store.table("chunks"), a.id))
        return found[0] if found else {"status": "not_found", "id": a.id}
    if a.command in ("neighbors", "why-connected"):
        # The stored adjacency is clustered by from_id; without it the links are read.
        edges = store.table("adjacency") if store.has("adjacency") else indexes.adjacency(stages.all_links(store))
        if a.command == "neighbors":
            return _told("neighbors", graph.neighbors(edges, a.id, a.depth, a.edge_type, a.min_confidence))
        return {"path": _rows(graph.why_connected(edges, a.source, a.target))}
    if a.command == "diff":
        old, new = (store.spark.read.parquet(f"{x}/ingest_records") for x in (a.old, a.new))
        return _told("changes", lifecycle.run_diff(old, new, "source_path"))
    if a.command == "sync-neo4j":
        nodes, links = stages.graph_records(store)
        connect = None if a.dry_run else connection.driver(made)
        return exports.sync(redaction.redacted(nodes, key), links, connect, a.dry_run) | {"uri": made.uri} | ({"warning": made.warning} if made.warning else {})
    if a.command == "export":
        return stages.export(store, a.format, a.output, conf, key)
    job = {x.name: x for x in jobs.load(a.file)}[a.name]
    return jobs.report(job, store.table("runs"), os.path.join(a.store, "exports"), lambda text: redaction.redact_value(text, key, redaction.chosen())[0])


def _key(store: str) -> str:
    """The store's redaction key, made on first use; it stays on the driver."""
    import secrets

    path = Path(store) / "redaction.key"
    if not path.exists():
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(secrets.token_hex(32))
        path.chmod(0o600)
    return path.read_text().strip()


def main(argv: list[str] | None = None) -> int:
    codes = ((redaction.PostconditionFailed, 3), (connection.TlsRequired, 4), (configuration.RulePackError, 5))
    try:
        a = parser().parse_args(argv)
        out = run(a)
        if getattr(a, "format", None) == "text":
            print("No secrets left." if out["status"] == "pass" else "SECRETS LEFT: " + ", ".join(k for k, v in out["profiles"].items() if v["status"] == "fail"))
        else:
            print(json.dumps(out, ensure_ascii=False))
        return 3 if out.get("status") == "fail" else 0
    except Exception as error:  # the command line reports every failure as one object
        print(json.dumps({"status": "error", "message": str(error)[:500]}))
        return next((code for kind, code in codes if isinstance(error, kind)), 1)


if __name__ == "__main__":
    sys.exit(main())
