"""The stages of a run over a store, end to end."""

from __future__ import annotations

import json
import subprocess
import xml.etree.ElementTree as ET
import zipfile
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kgspark import cli, config, jobs, stages
from kgspark.operators import claims, exports, lifecycle, markdown, provenance, redaction
from kgspark.sources import files

KEY = b"k" * 32


def joined(folder) -> str:
    """A written document: the files of its folder in order of their names."""
    return "\n".join(p.read_text().rstrip("\n") for p in sorted(Path(folder).glob("part-*")))


@pytest.fixture
def source(tmp_path):
    src = tmp_path / "src"
    (src / "sub").mkdir(parents=True)
    (src / "a.md").write_text("---\ntitle: Alpha\n---\n# Alpha\nUses `spark`, see [b](sub/b.md). Dr. Jane Doe met John Smith at UNESCO. Case 12-AB-1234.\n")
    (src / "sub/b.md").write_text("# Beta\npassword = hunter2 and Jane Doe\n")
    (src / "p.pdf").write_bytes(b"%PDF-1\n1 0 obj <</Filter /FlateDecode>> stream\n" + zlib.compress(b"(first page) Tj") + b"\nendstream endobj 2 0 obj <<>> stream\n(token=abc123 second) Tj\nendstream")
    with zipfile.ZipFile(src / "w.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p></w:body></w:document>')
    (src / "bad.docx").write_bytes(b"zip?")
    (src / "x.py").write_text("print(1)")
    (tmp_path / "secret.md").write_text("outside")
    (src / "out.md").symlink_to(tmp_path / "secret.md")
    (src / "in.md").symlink_to(src / "a.md")
    return src


def test_ingest_reads_caches_and_refuses(spark, source, tmp_path):
    store = stages.Store(spark, str(tmp_path / "store"))
    conf = config.Config()
    out = stages.ingest(store, str(source), conf, KEY)
    assert out == {"n_ok": 5, "n_skipped": 2, "n_failed": 1, "n_cached": 0, "n_refused": 1}
    docs = {r["source_path"]: r for r in store.table("documents").collect()}
    assert set(docs) == {"a.md", "in.md", "sub/b.md", "p.pdf", "w.docx"}
    assert docs["p.pdf"]["text"].startswith("first page\n\ntoken=<<redacted:") and "hunter2" not in docs["sub/b.md"]["text"]
    records = {r["source_path"]: r for r in store.table("ingest_records").collect()}
    assert records["out.md"]["skip_reason"] == "symlink_refused" and records["out.md"]["source_hash"] is None
    assert records["bad.docx"]["status_reason"] == "corrupt" and records["x.py"]["skip_reason"] == "unsupported_extension"
    segments = [(r["type"], r["order"]) for r in store.table("segments").where(F.col("document_id") == docs["p.pdf"]["document_id"]).collect()]
    assert sorted(segments) == [("page", 0), ("page", 1)]
    chunk = store.table("chunks").where(F.col("document_id") == docs["p.pdf"]["document_id"]).first()
    assert (chunk["page_start"], chunk["page_end"], chunk["paragraph_start"]) == (1, 2, None)

    old = docs["a.md"]["source_hash"]
    (source / "sub/b.md").write_text("# Beta\nchanged\n")
    (source / "new.md").write_text("# New\n")
    (source / "w.docx").unlink()
    again = stages.ingest(store, str(source), conf, KEY)
    assert again == {"n_ok": 5, "n_skipped": 2, "n_failed": 1, "n_cached": 3, "n_refused": 1}
    docs2 = {r["source_path"]: r for r in store.table("documents").collect()}
    assert docs2["a.md"]["source_hash"] == old and len(docs2["sub/b.md"]["hash_history"]) == 2 and "changed" in docs2["sub/b.md"]["text"]
    assert {r["source_path"] for r in stages.current(store).collect()} == {"a.md", "in.md", "sub/b.md", "p.pdf", "new.md"}
    assert store.table("chunks").select("document_id").distinct().count() == 6
    assert {r["source_path"]: r["title"] for r in store.table("sources").collect()}["a.md"] == "Alpha"
    assert stages.ingest(store, str(source), conf, KEY, ["sub", "new.md"])["n_ok"] == 2
    with pytest.raises(ValueError):
        files.scan(spark, str(source), include=["../secret.md"])


def test_ingest_keeps_to_budget_and_version(spark, source, tmp_path):
    store = stages.Store(spark, str(tmp_path / "store"))
    with pytest.raises(lifecycle.BudgetExceeded):
        stages.ingest(store, str(source), config.Config({"footprint_budget": {"factor": 1e-6}}), KEY)
    stages.rebuild(store, str(source), config.Config(), KEY)
    rows = store.table("runs").withColumns({"schema_version": F.lit("v0"), "started_at": F.current_timestamp()})
    store.append("runs", rows)
    with pytest.raises(lifecycle.IncompatibleStore):
        stages.ingest(store, str(source), config.Config(), KEY)


def test_source_records_hold_their_invariant(spark):
    rows = lambda *r: spark.createDataFrame([r], "parse_status string, source_origin string")
    assert lifecycle.checked_records(rows("ok", "cached")).count() == 1
    for bad in (("failed", "cached"), ("odd", "fresh"), ("ok", "stale"), (None, "fresh")):
        with pytest.raises(Exception, match="bad source record"):
            lifecycle.checked_records(rows(*bad)).collect()


def test_rebuild_with_mentions_links_and_exports(spark, source, tmp_path):
    store = stages.Store(spark, str(tmp_path / "store"))
    conf = config.Config({"profiles": {"default": {"extraction": {"ner": {"enabled": True}}}}, "redaction": {"custom": {"case": {"pattern": r"hidden-\d+", "category": "case"}}}})
    (source / "c.txt").write_text("hidden-42 with Jane Doe")
    out = stages.rebuild(store, str(source), conf, KEY)
    assert out["postcondition"] == {"status": "pass", "misses": 0} and out["extract"]["mentioned"] >= 4
    names = {r["name"] for r in store.table("entities").collect()}
    assert {"Dr. Jane Doe", "John Smith", "UNESCO", "12-AB-1234", "Alpha", "spark"} <= names
    kinds = {r["type"] for r in store.table("links").collect()}
    assert {"MENTIONED_IN", "CO_OCCURS_WITH", "contains_section", "mentions_technology", "references", "resolves_to_document"} <= kinds
    assert "hidden-42" not in "".join(r["text"] for r in store.table("documents").collect())
    nodes, links = stages.graph_records(store)
    ids = {r["id"] for r in nodes.collect()}
    assert all(r["from_id"] in ids and r["to_id"] in ids for r in links.collect()) and links.where("type = 'MENTIONED_IN'").count() > 0

    path = str(tmp_path / "json")
    counts = stages.export(store, "json", path, conf, KEY)
    found = json.loads(joined(path))
    assert {k: len(v) for k, v in found.items() if k in counts} == counts and set(found) == {*counts, "export_metadata"}
    assert [e["id"] for e in found["entities"]] == sorted(e["id"] for e in found["entities"])
    assert found["export_metadata"]["profile"] == "default" and found["export_metadata"]["clean_room"] is True
    stages.export(store, "graphml", str(tmp_path / "graphml"), conf, KEY)
    tree = ET.fromstring(joined(tmp_path / "graphml"))
    assert len(list(tree.iter("{http://graphml.graphdrawing.org/xmlns}node"))) == stages.all_entities(store).where("name <> ''").count()
    stages.export(store, "dot", str(tmp_path / "dot"), conf, KEY)
    lines = joined(tmp_path / "dot").splitlines()
    assert lines[0] == "digraph kg {" and lines[-1] == "}" and lines[1:-1] == sorted(lines[1:-1])
    assert stages.export(store, "neo4j", str(tmp_path / "cypher"), conf, KEY)["relationships"] == links.count()

    store.write("claims", store.table("claims").limit(0).unionByName(spark.createDataFrame([("c", "password=open", "x.md")], "id string, object string, source_path string"), allowMissingColumns=True))
    with pytest.raises(redaction.PostconditionFailed):
        stages.validate(store, conf)
    assert stages.validate_profiles(spark, store.root, conf)["status"] == "fail"


def test_empty_exports_are_whole(spark, tmp_path):
    none = spark.createDataFrame([], "id string, name string")
    exports.export_json({"entities": none, "chunks": none}, {"entities": "id", "chunks": "id"}, {"a": 1}, str(tmp_path / "j"))
    assert json.loads(joined(tmp_path / "j")) == {"entities": [], "chunks": [], "export_metadata": {"a": 1}}
    exports.export_graph(none, "graphml", str(tmp_path / "g"))
    assert ET.fromstring(joined(tmp_path / "g")).tag.endswith("graphml")


@pytest.fixture
def repository(tmp_path):
    repo = tmp_path / "repo"
    repo.mkdir()
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=N", "-c", "user.email=n@x", *a], check=True, capture_output=True)
    git("init", "-q")
    (repo / "a.txt").write_text("".join(f"line {k}\n" for k in range(40)))
    (repo / "b.md").write_text("short\n")
    git("add", "."), git("commit", "-qm", "first")
    (repo / "d").mkdir()
    git("mv", "a.txt", "ä moved.txt"), git("commit", "-qam", "exact")
    git("mv", "ä moved.txt", "similar.txt")
    (repo / "similar.txt").write_text("".join(f"line {k}\n" for k in range(36)) + "new\n")
    git("add", "-A"), git("commit", "-qm", "similar")
    git("rm", "-q", "b.md")
    (repo / "d" / "b.md").write_text("quite another text of other words\n" * 3)
    git("add", "-A"), git("commit", "-qm", "basename")
    git("tag", "v1")
    return repo


def test_git_stage_leaves_no_dangling_link(spark, repository, tmp_path):
    store = stages.Store(spark, str(tmp_path / "store"))
    out = stages.git(store, str(repository), config.Config())
    assert out["commits"] == 4 and out["renames"] == 3
    assert out["nodes"] == {"commit": 4, "author_identity": 1, "tag": 1, "ref": 1, "repository": 1, "file": 5}
    ids = {r["id"] for r in store.table("git_entities").collect()}
    for name in ("git_links", "git_lineage"):
        assert all(r["from_id"] in ids and r["to_id"] in ids for r in store.table(name).collect())
    found = {(r["old_path"], r["new_path"]): (r["detection_method"], r["confidence"]) for r in store.table("git_lineage").collect()}
    assert found == {("a.txt", "ä moved.txt"): ("exact", 1.0), ("ä moved.txt", "similar.txt"): ("similarity", 0.8), ("b.md", "d/b.md"): ("basename", 0.6)}
    assert store.table("git_file_commits").count() == 5


def plain_renames(adds, deletes, similar):
    out = {}
    for sha, new, blob in adds:
        best = []
        for other, old, gone in deletes:
            if other != sha or old == new:
                continue
            if blob == gone:
                best.append((-1.0, old, "exact"))
            elif (sha, old, new) in similar:
                best.append((-0.8, old, "similarity"))
            elif new.rsplit("/", 1)[-1] == old.rsplit("/", 1)[-1]:
                best.append((-0.6, old, "basename"))
        if best:
            out[sha, new] = min(best)
    return out


def test_renames_match_all_pairs(spark):
    import random

    rng = random.Random(3)
    path = lambda: f"{rng.choice('abc')}/{rng.randrange(6)}.txt"
    adds, deletes = ([*{(f"c{rng.randrange(3)}", path()): None}] for _ in range(2))
    adds = [(f"c{k % 3}", p, f"b{rng.randrange(4)}") for k in range(3) for p in {path() for _ in range(9)}]
    deletes = [(f"c{k % 3}", p, f"b{rng.randrange(4)}") for k in range(3) for p in {path() for _ in range(9)}]
    similar = {(s, d[1], p) for s, p, _ in adds for d in deletes if d[0] == s and d[1] != p and rng.random() < 0.1}
    shape = "commit_sha string, path string, blob_sha string"
    pairs = spark.createDataFrame([(*x, 75) for x in sorted(similar)] + [("c0", "a/0.txt", "zz", 60)], "commit_sha string, old_path string, new_path string, score long")
    found = provenance.detect_renames(spark.createDataFrame(adds, shape), spark.createDataFrame(deletes, shape), pairs).collect()
    assert {(r["commit_sha"], r["new_path"]): (-r["confidence"], r["old_path"], r["detection_method"]) for r in found} == plain_renames(adds, deletes, similar)


def test_content_entities(spark):
    docs = spark.createDataFrame([("a.md", "# One\ntext React and reacts\n## One\n[x](u.md) [y](#frag)\nPostgres, postgresql; C++ [z](u.md)")], "source_path string, text string")
    found = {(r["type"], r["name"], r["line"]) for r in markdown.content_entities(docs).collect()}
    assert found == {("ag:section", "One", 1), ("ag:technology", "React", 2), ("ag:technology", "PostgreSQL", 5), ("ag:technology", "C++", 5), ("ag:reference", "x", 4)}


def test_nested_values_are_redacted(spark):
    df = spark.sql("select 1 as id, named_struct('a', 'token=x1', 'n', 2, 'b', array(named_struct('c', 'pwd=y2'))) as s, map('token=k', array('secret=z3', null)) as m, array(1, 2) as numbers, cast(null as struct<q: string>) as none")
    out = redaction.redacted(df, KEY)
    assert out.schema == df.schema
    row = out.first().asDict(recursive=True)
    mark = lambda v: redaction.marker("credential", v, KEY)
    assert row["s"] == {"a": "token=" + mark("x1"), "n": 2, "b": [{"c": "pwd=" + mark("y2")}]}
    assert row["m"] == {"token=k": ["secret=" + mark("z3"), None]} and row["numbers"] == [1, 2] and row["none"] is None
    with pytest.raises(ValueError):
        redaction.register(redaction.Detector("n", "Bad Category", "x"))


def test_command_line_of_new_commands(spark, source, tmp_path, capsys):
    def call(*args):
        code = cli.main(["--store", str(tmp_path / "w"), *args])
        text = capsys.readouterr().out.strip().splitlines()[-1]
        return code, json.loads(text) if text.startswith("{") else text

    assert "config.json" in call("init")[1]["created"] and call("init")[1]["created"] == []
    assert call("run", str(source))[0] == 0
    assert call("normalize")[1]["status"] == "ok"
    assert call("import", str(source), "--path", "sub")[1]["n_ok"] == 1
    assert call("validate-store", "--all-profiles", "--format", "text") == (0, "No secrets left.")
    (tmp_path / "jobs.json").write_text(json.dumps({"jobs": {"r": {"action": {"type": "report.changed_since"}}, "bad": {"action": {"type": "report.changed_since"}, "output": {"path": "../../x.md"}}}}))
    out = call("jobs", "run", "r", "--file", str(tmp_path / "jobs.json"))[1]
    assert out["runs"] == 1 and Path(out["output"]).read_text().startswith("# Changes since 24h\n\n- run_")
    assert call("jobs", "run", "bad", "--file", str(tmp_path / "jobs.json"))[0] == 1
    assert jobs.output_path(jobs.Job("n", "a", {}), str(tmp_path)).endswith("reports/n.md")
    code, out = call("sync-neo4j", "--dry-run")
    assert code == 0 and out["dry_run"] == 1 and out["nodes"] > 5
    assert claims.decision_index(spark.createDataFrame([("1", "decision", "x", "p"), ("2", "log", "y", "q")], "id string, type string, object string, source_path string")).count() == 1
