from __future__ import annotations

import hashlib
import hmac
import random
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from kgspark import cli, config, jobs, plugins, tools
from kgspark.functions import ids, text
from kgspark.operators import chunking, claims, exports, graph, indexes, lifecycle, markdown, ner, provenance, redaction
from kgspark.sources import connection, files, history
from kgspark.streaming import incremental


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("v")).first()["v"]


def test_ids(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert one(spark, ids.entity_id(ids.canonical_key(F.col("a"))), a=" My Note ") == "ent_" + sha("my_note")
    assert one(spark, ids.document_id(F.col("a")), a="x/y.md") == "doc_" + sha("x/y.md")[:24]
    assert one(spark, ids.chunk_id(F.col("a"), F.lit(3), F.col("b")), a="doc_1", b="t") == "chk_" + sha("doc_1:3:t")[:24]
    assert one(spark, ids.link_id("r", F.col("a"), F.col("b")), a="x", b="y") == "lnk_" + sha("r:x:y")
    seconds = int(sha("seed")[:8], 16) % 1_000_000_000
    from datetime import UTC, datetime

    assert one(spark, ids.deterministic_timestamp(F.col("a")), a="seed") == datetime.fromtimestamp(seconds, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def test_text(spark):
    assert one(spark, text.normalised(F.col("a")), a="e\u0301\r\n[[page: x::citation]]") == "\u00e9\n[ x]"
    assert one(spark, text.tidy_lines(F.col("a")), a=" a \u00a0\n\n\n\nb\t\n") == "a\n\nb"
    assert one(spark, text.tokens(F.col("a")), a=" a\u00a0b  c\n") == ["a", "b", "c"]
    assert one(spark, text.index_tokens(F.col("a")), a="A_b-c.d/e f") == ["a", "b", "c", "d", "e", "f"]
    assert one(spark, text.slug(F.col("a")), a="  Hello, Wörld_1 & co! ") == "hello-wörld_1-co"
    assert one(spark, text.graph_label(F.col("a")), a="ag:note_type") == ":KgAgNoteType"
    assert one(spark, text.graph_label(F.col("a")), a="::") == ":KgEntity"
    assert one(spark, text.person_name(F.col("a")), a=" Hon. Judge  Jane   Doe., ") == "jane doe"
    assert one(spark, text.without_markdown(F.col("a")), a="# T\n```py\nx\n```\n**b** `c` [l](u) ![i](v) *e* citeturn1search2X") == "T\n\nb c l i e X"
    assert one(spark, text.cypher_literal(F.col("a")), a='q"\n') == '"q\\"\\n"'
    for path, good in (("", True), ("a/Makefile", False), ("a/b.MD", True), ("a.b/c", False), ("x.py", False)):
        assert one(spark, text.natural_language_source(F.col("a")), a=path) is good
    assert one(spark, text.matches_any(F.col("a"), ["*.log", "tmp/[!a]*"]), a="x/y.log")
    assert not one(spark, text.matches_any(F.col("a"), ["*.log", "tmp/[!a]*"]), a="tmp/abc")


def plain_windows(words, size, overlap):
    out, at = [], 0
    while at < len(words):
        out.append((at, min(at + size, len(words)), " ".join(words[at : at + size])))
        if at + size >= len(words):
            break
        at += size - overlap
    return out


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6, 9, 10, 23])
def test_windows(spark, n):
    words = [f"w{k}" for k in range(n)]
    docs = spark.createDataFrame([("d", " ".join(words))], "document_id string, text string")
    found = [(r["start"], r["end"], r["text"]) for r in chunking.chunks(docs, 5, 2).orderBy("order").collect()]
    assert found == plain_windows(words, 5, 2)
    with pytest.raises(ValueError):
        chunking.windows(F.col("a"), 5, 5)


def test_indexes(spark):
    e = spark.createDataFrame([("1", "note", "My Note-x", ["Alias one"]), ("2", "note", "", None), ("3", "", "z", [])], "id string, type string, name string, aliases array<string>")
    terms = {(r["term"], r["id"]) for r in indexes.keyword_index(e).collect()}
    assert terms == {("my note-x", "1"), ("my", "1"), ("note", "1"), ("x", "1"), ("alias one", "1"), ("alias", "1"), ("one", "1"), ("z", "3")}
    assert {r["id"] for r in indexes.type_index(e).collect()} == {"1", "2"}
    hits = spark.createDataFrame([("10", 0.26), ("2", 0.24), ("3", 0.9)], "id string, score double")
    assert [r["id"] for r in indexes.ranked_hits(hits, 0.25).collect()] == ["3", "10", "2"]


@pytest.fixture(scope="module")
def links(spark):
    edges = [("a", "b", "t", 1.0), ("a", "c", "u", 0.5), ("b", "a", "t", None), ("b", "d", "t", 0.9), ("c", "d", "u", 1.0), ("d", "e", "t", 1.0), ("a", "b", "s", 0.2)]
    return spark.createDataFrame([(*e, "r") for e in edges], "from_id string, to_id string, type string, confidence double, rule_id string")


def plain_neighbors(edges, start, depth, types=None, least=None):
    out, seen, frontier = [], {start}, [start]
    for hop in range(1, depth + 1):
        found = [e for e in edges if e[0] in frontier and (not types or e[2] in types) and (least is None or (1.0 if e[3] is None else e[3]) >= least)]
        out += [(hop, *e[:3]) for e in found]
        frontier = sorted({e[1] for e in found} - seen)
        seen |= set(frontier)
    return sorted(out)


@pytest.mark.parametrize(("depth", "types", "least"), [(0, None, None), (1, None, None), (2, ["t"], None), (3, None, 0.6), (5, None, None)])
def test_neighbors(links, depth, types, least):
    edges = [tuple(r)[:4] for r in links.collect()]
    found = sorted((r["hop"], r["from_id"], r["to_id"], r["type"]) for r in graph.neighbors(links, "a", depth, types, least).collect())
    assert found == plain_neighbors(edges, "a", depth, types, least)


def test_connections(spark, links):
    assert graph.why_connected(links, "a", "b").first()["type"] == "s"
    assert graph.why_connected(links, "a", "e").count() == 0
    assert [r["to_id"] for r in graph.shortest_path(links, "a", "e").orderBy("hop").collect()][-1] == "e"
    assert graph.neighbors(links, "nobody", 3).count() == 0
    m = spark.createDataFrame([("1", "ag:note", "s", "h"), ("1", "ag:note", "s", "h"), ("2", "ag:note", "s", "h"), ("3", "ag:section", "s", "h"), ("1", "ag:note", "r", "h"), ("2", "ag:note", "r", "h")], "id string, type string, source_path string, source_hash string")
    found = graph.cooccurrence(m).collect()
    assert {(r["from_id"], r["to_id"], r["source_path"]) for r in found} == {("1", "2", "r"), ("2", "1", "r")} and len(found) == 2


def test_commit_selection(spark):
    rng = random.Random(5)
    commits = [(f"{k:03d}", f"2020-01-{1 + k % 28:02d}T00:00:{k % 60:02d}Z", [] if k == 0 else [f"{k - 1:03d}"], k % 17 == 5) for k in range(200)]
    touched = [(c[0], f"src/f{rng.randrange(9)}_{j}", rng.randrange(900)) for c in commits for j in range(rng.randrange(4))]
    c = spark.createDataFrame(commits, "sha string, authored_at string, parent_shas array<string>, is_merge boolean")
    f = spark.createDataFrame(touched, "sha string, path string, lines_changed long")
    t = spark.createDataFrame([("v1", "010"), ("v2", "gone")], "name string, target_sha string")
    b = spark.createDataFrame([("main", "199")], "name string, head_sha string")
    found = {r["sha"]: (r["tier"], r["importance_score"]) for r in provenance.select_commits(c, f, t, b, 20, ["src/f0*"], ["src/f1*"]).collect()}
    files = {x[0]: [y for y in touched if y[0] == x[0]] for x in commits}
    first = {x[0] for x in commits if not x[2] or x[3] or x[0] in ("010", "199") or any(p[1].startswith("src/f0") for p in files[x[0]])}

    def score(s):
        warm = [p for p in files[s] if not p[1].startswith("src/f1")]
        return 0.0 if not warm else len(warm) + sum(p[2] for p in files[s]) / 400

    rest = [x for x in commits if x[0] not in first]
    forced = {max(rest, key=lambda x: (x[1], x[0]))[0], min(rest, key=lambda x: (x[1], x[0]))[0]}
    ranked = sorted((x[0] for x in rest), key=lambda s: (s not in forced, -score(s), s))[:20]
    assert {s for s, v in found.items() if v[0] == "structural"} == first
    assert {s: v[1] for s, v in found.items() if v[0] == "scored"} == pytest.approx({s: score(s) for s in ranked})


def test_redaction(spark):
    key, pat = b"k" * 32, "ghp_" + "a" * 20
    pem = "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----"
    body = f"x {pem}\npassword = hunter2, {pat} and https://u:pw1@h/ Authorization: Bearer abc.def v0.1.0"
    df = spark.createDataFrame([("1", body, ["api_key=zz", None], 7), ("2", None, None, 8)], "id string, text string, parts array<string>, n int")
    out = redaction.redacted(df, key).orderBy("n").collect()
    mark = lambda c, s: f"<<redacted:{c}:{hmac.new(key, s.encode(), hashlib.sha256).hexdigest()[:12]}>>"
    for part in (mark("private_key", pem), "password = " + mark("credential", "hunter2,"), mark("vendor_token", pat), "u:" + mark("url_credential", "pw1") + "@h", "v0.1.0"):
        assert part in out[0]["text"]
    assert out[0]["parts"] == ["api_key=" + mark("credential", "zz"), None] and out[1]["text"] is None and out[1]["parts"] is None
    assert redaction.misses(redaction.redacted(df, key), "id").count() == 0
    assert {(r["path"], r["category"]) for r in redaction.misses(df, "id").collect()} >= {("1", "private_key"), ("1", "credential"), ("1", "vendor_token")}
    again = redaction.redacted(redaction.redacted(df, key), key).orderBy("n").collect()
    assert again[0]["text"] == out[0]["text"]
    digest = df.where("id = '1'").select(redaction.keyed_digest(F.col("id"), key)).first()[0]
    assert digest == hmac.new(key, b"1", hashlib.sha256).hexdigest()
    with pytest.raises(redaction.PostconditionFailed):
        redaction.postcondition(redaction.misses(df, "id"))
    assert redaction.postcondition(redaction.misses(df, "id"), True)["status"] == "tolerated"
    status = {r["profile"]: r["status"] for r in redaction.validated(df.where("id = '1'").withColumn("profile", F.lit("p")), df.withColumn("profile", F.when(F.col("id") == "1", "p").otherwise("q"))).collect()}
    assert status == {"p": "fail", "q": "pass", "_total": "fail"}


MD = """---
title: "T"
---
# One `Code`
Intro [doc](b.md#x) and [no](missing.md) and ![pic](p.png).

## Two
Uses `code` and [ref][r] plus <https://auto.example/>. Bare https://bare.example/a.

```python
# not a heading
```

Three
-----
text [ext](mailto:a@b.c) [up](../c/b.md) [frag](#z)

# Four
[r]: https://ref.example
"""


def test_markdown(spark):
    docs = spark.createDataFrame([("a/a.md", "h1", MD), ("a/b.md", "h2", "plain"), ("a/e.md", "h3", None)], "source_path string, source_hash string, text string")
    tokens = markdown.token_rows(docs)
    s = {r["name"]: r for r in markdown.sections(tokens).collect()}
    assert [(n, s[n]["level"], s[n]["slug_path"]) for n in ("One Code", "Two", "Three", "Four")] == [("One Code", 1, "one-code"), ("Two", 2, "one-code/two"), ("Three", 2, "one-code/three"), ("Four", 1, "four")]
    assert s["Two"]["parent_section_id"] == s["One Code"]["id"] and s["Four"]["parent_section_id"] is None
    assert s["Two"]["body_snippet"].startswith("Uses code") and "text ext" in s["One Code"]["body_snippet"]
    t = [(r["name"], r["canonical_key"], r["origin"]) for r in markdown.technologies(tokens).orderBy("first_seen_order").collect()]
    assert t == [("Code", "code", "code_inline"), ("python", "python", "fence")]
    index = spark.createDataFrame([("a/b.md", "doc_b"), ("c/b.md", "doc_c")], "source_path string, document_id string")
    refs = {r["target"]: (r["resolution"], r["target_document_id"]) for r in markdown.references(tokens, index).collect()}
    assert refs == {
        "b.md#x": ("internal", "doc_b"),
        "missing.md": ("unresolved", None),
        "https://ref.example": ("external", None),
        "https://auto.example/": ("external", None),
        "https://bare.example/a": ("external", None),
        "mailto:a@b.c": ("external", None),
        "../c/b.md": ("internal", "doc_c"),
        "#z": ("unresolved", None),
    }
    notes = claims.notes(docs.where("text is not null"))
    assert {r["name"] for r in notes.collect()} == {'"T"', "b"}
    found = markdown.markdown_links(markdown.sections(tokens), markdown.technologies(tokens), markdown.references(tokens, index), markdown.owners(tokens, markdown.sections(tokens), notes), notes, tokens)
    counts = {r["type"]: r["count"] for r in found.groupBy("type").count().collect()}
    assert counts == {"contains_section": 4, "mentions_technology": 3, "references": 8, "resolves_to_document": 2}


def test_mentions(spark):
    chunks = spark.createDataFrame([("c1", "a.md", "Dr. Jane Doe met **John Smith** at GPU on 2020-01-02 for $ 5. Case 12-AB-1234."), ("c2", "a.py", "Jane Doe"), ("c3", "b.txt", "Jane Doe and UNESCO"), ("c4", "c.md", "### --- ***")], "chunk_id string, source_path string, text string")
    own = ner.readable(chunks)
    assert {r["chunk_id"] for r in own.collect()} == {"c1", "c3"}
    m = ner.mentions(own)
    e = ner.filtered(ner.rolled_up(m))
    assert {(r["type"], r["canonical_key"], r["mention_count"]) for r in e.collect()} == {("ner:person", "jane doe", 2), ("ner:person", "john smith", 1), ("ner:org", "unesco", 1), ("ner:date", "2020-01-02", 1), ("ner:money", "$ 5", 1)}
    assert ner.mention_links(m, e).count() == 6
    assert [r["surface"] for r in ner.case_numbers(chunks).collect()] == ["12-AB-1234"]


def test_claims(spark):
    docs = spark.createDataFrame([("d/ADR-1.md", "h", "# Use Spark #\nbody"), ("x.log", "h", "ok\n Error: a\nERROR b"), ("y.log", "h", "Error: a"), ("n.md", "h", "---\nTags: a, 'b'\nother: x\ntitle: q: r\n---\n")], "source_path string, source_hash string, text string")
    assert [r["object"] for r in claims.decision_claims(docs).collect()] == ["Use Spark"]
    assert {(r["object"], r["source_path"]) for r in claims.log_claims(docs).collect()} == {("Error: a", "x.log"), ("ERROR b", "x.log")}
    front = docs.where("source_path = 'n.md'").select(claims.frontmatter(F.col("text")).alias("f"), claims.tag_list(claims.frontmatter(F.col("text"))["tags"]).alias("t")).first()
    assert front["f"] == {"tags": "a, 'b'", "title": "q: r"} and front["t"] == ["a", "'b'"]


def test_lifecycle(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, source_hash string")
    new = spark.createDataFrame([("b", "2"), ("c", "4"), ("d", "5")], "path string, source_hash string")
    assert {tuple(r) for r in lifecycle.run_diff(old, new).collect()} == {("a", "removed"), ("c", "changed"), ("d", "added")}
    assert {(r["path"], r["source_origin"]) for r in lifecycle.with_cache(new, old).collect()} == {("b", "cached"), ("c", "fresh"), ("d", "fresh")}
    assert lifecycle.inputs_hash(old).first()[0] == hashlib.sha256(b"1:2:3").hexdigest()
    small = spark.createDataFrame([(10,)], "size long")
    for used, status in ((1 << 20, "ok"), (int(2.5 * (1 << 20)), "warn"), (3 << 20, "block")):
        assert lifecycle.budget_status(small, spark.createDataFrame([(used,)], "size long")).first()["status"] == status
    steps = lifecycle.Migrations()
    steps.register("v1", "v2", lambda df: df.withColumn("x", F.lit(1)))
    assert steps.migrate(small, "v1", "v2").columns == ["size", "x"]
    with pytest.raises(lifecycle.IncompatibleStore):
        steps.migrate(small, "v0", "v2")
    with pytest.raises(lifecycle.IncompatibleStore):
        lifecycle.check_compatible("v0")
    assert [w["code"] for w in lifecycle.throughput_warnings({"documents": 2, "entities": 1, "links": 0, "index_terms": 3})] == ["no_links"]
    assert lifecycle.quality_gate(0.054, 0.05, 0.1) and not lifecycle.quality_gate(0.06, 0.05, 0.1)
    assert lifecycle.same_rows(old, old.orderBy(F.col("path").desc())) and not lifecycle.same_rows(old, new)
    assert lifecycle.canonical_json({"b": 1, "a": "é"}) == '{"a": "\\u00e9", "b": 1}'


def test_exports(spark, links, tmp_path):
    e = spark.createDataFrame([("e1", "ag:note", 'A "q" <b>', "k", "p", None), ("e2", "x", "", "k", None, None)], "id string, type string, name string, canonical_key string, source_path string, source_hash string")
    nodes = exports.graph_nodes(e)
    line = lambda c: nodes.select(c).first()[0]
    assert nodes.count() == 1
    assert line(exports.dot_line()) == '  "e1" [label="A \\"q\\" <b>"];'
    assert "A &quot;q&quot; &lt;b&gt;" in line(exports.graphml_line())
    assert line(exports.cypher_node()) == 'MERGE (n:KgAgNote {id: "e1"}) SET n.name = "A \\"q\\" <b>", n.type = "ag:note", n.canonical_key = "k", n.source_path = "p";'
    rows = exports.numbered(spark.range(2500).select(F.format_string("id_%05d", "id").alias("id"))).collect()
    assert all(r["batch"] == int(r["id"][3:]) // 1000 for r in rows)
    edges = links.withColumn("id", F.concat("from_id", "to_id", "type")).withColumn("authority", F.lit("a"))
    assert exports.export_cypher(nodes, edges, str(tmp_path / "x")) == {"nodes": 1, "relationships": 7}
    assert exports.sync(nodes, edges)["dry_run"] == 1
    assert nodes.select(exports.properties(["id", "source_hash"]).alias("p")).first()["p"] == {"id": "e1"}


def test_connection_policy():
    assert connection.connection({"NEO4J_URI": "bolt://localhost:1"}).warning is None
    assert connection.connection({"NEO4J_URI": "bolt://far:1"}).warning
    assert connection.connection({"NEO4J_URI": "neo4j+s://far:1"}, True).warning is None
    with pytest.raises(connection.TlsRequired):
        connection.connection({"NEO4J_URI": "neo4j://far:1"}, True)
    with pytest.raises(ValueError):
        connection.connection({"NEO4J_URI": "http://far"})


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/n.md").write_bytes(b"# T\r\n\xff x \n")
    (tmp_path / "a/skip.py").write_text("x")
    (tmp_path / "old.doc").write_text("x")
    (tmp_path / "p.pdf").write_bytes(b"%PDF-1\n1 0 obj <</Length 9>> stream\n(He\\)llo) Tj\nendstream endobj 2 0 obj <</Filter /FlateDecode>> stream\n" + zlib.compress(b"BT [(sec) -20 (ond)] TJ (page) Tj ET") + b"\nendstream endobj")
    (tmp_path / "s.pdf").write_bytes(b"%PDF-1 no text")
    (tmp_path / "bad.docx").write_bytes(b"zip?")
    with zipfile.ZipFile(tmp_path / "w.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>')
    found = files.scan(spark, str(tmp_path), ["*.log"])
    status = {r["source_path"]: r["parse_status"] for r in files.with_parse_status(found).collect()}
    assert status["a/n.md"] == "ok" and status["a/skip.py"] == "skipped" and status["old.doc"] == "failed"
    assert files.texts(found).select("source_path", "text").first() == ("a/n.md", "# T\n\ufffd x")
    parts = {(r["source_path"], r["order"]): (r["text"], r["status_reason"]) for r in files.parts(found).collect()}
    assert parts == {("p.pdf", 0): ("He)llo", None), ("p.pdf", 1): ("second page", None), ("s.pdf", 0): (None, "ocr_required"), ("bad.docx", 0): (None, "corrupt"), ("w.docx", 0): ("one", None), ("w.docx", 1): ("two", None)}
    assert not files.contained(str(tmp_path), "../x") and files.contained(str(tmp_path), "a/n.md")


def test_git_history(spark, tmp_path):
    import subprocess

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=N", "-c", "user.email=n@x", *a], check=True, capture_output=True)
    git("init", "-q")
    for k in range(3):
        (tmp_path / "f.txt").write_text("l\n" * (k + 1))
        git("add", "."), git("commit", "-qm", f"c{k}")
    git("tag", "v1")
    spark.dataSource.register(history.GitHistory)
    read = lambda t: spark.read.format("git_history").option("repo", str(tmp_path)).option("table", t).load()
    c, f, t = (read(x) for x in ("commits", "commit_files", "tags"))
    assert sorted(r["subject"] for r in provenance.git_log(c, f, t, "f.txt").collect()) == ["c0", "c1", "c2"]
    assert provenance.git_introduced(c, f, t, "f.txt").count() == 1
    assert t.first()["target_sha"] in {r["sha"] for r in c.collect()} and read("branches").count() == 1
    assert provenance.git_links(c, f, t, read("branches"), "r").groupBy("type").count().count() == 6


def test_streaming(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("d1", "h1"), ("d1", "h2"), ("d2", "h1"), ("d1", "h1")]
    spark.createDataFrame(rows, "document_id string, source_hash string").write.parquet(src)
    stream = spark.readStream.schema("document_id string, source_hash string").parquet(src)
    q = incremental.hash_histories(stream).writeStream.format("memory").queryName("hist").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert {r["document_id"]: r["hash_history"] for r in spark.table("hist").collect()} == {"d1": ["h1", "h2"], "d2": ["h1"]}
    seen = []
    incremental.ingest(stream, lambda df, k: seen.append(df.count()), str(tmp_path / "cp")).awaitTermination()
    assert sum(seen) == 4


def test_config_and_jobs(spark, tmp_path):
    assert config.load().section("chunking") == {"tokens": 200, "overlap": 40}
    (tmp_path / "c.json").write_text('{"redaction": {"enabled": false}, "neo4j": {"password": "x"}, "profiles": {"default": {"extractors": ["gone.yaml"]}}}')
    own = config.load(tmp_path / "c.json")
    assert own.section("redaction")["enabled"] is False and own.section("redaction")["detectors"]
    assert "password" not in own.snapshot()
    with pytest.raises(config.RulePackError):
        config.check_rule_packs(own, tmp_path)
    for bad in ("", "a/b", ".."):
        with pytest.raises(config.ConfigError):
            config.profile_name(bad)
    raw = {"jobs": {"j": {"action": {"type": "report.changed_since", "args": {"since": "2h"}}}}}
    runs = spark.sql("select 1 as run_id, current_timestamp() as started_at union all select 2, current_timestamp() - interval 3 hours")
    assert [r["run_id"] for r in jobs.run(jobs.parse(raw)[0], runs).collect()] == [1]
    with pytest.raises(config.ConfigError):
        jobs.parse({"jobs": [{"name": "a", "action": {"type": "x"}}]})
    plugins.register_functions(spark, b"k" * 32)
    assert spark.sql("select kg_nfc('e\u0301') as v").first()["v"] == "\u00e9"
    assert spark.sql("select count(*) as n from kg_markdown('# a\n\nb')").first()["n"] == 2
    assert plugins.completed(spark.range(2).selectExpr("'p' as p"), "p").where("completion is null").count() == 2


def test_command_line(spark, tmp_path, capsys):
    import json

    src, store = tmp_path / "src", str(tmp_path / "store")
    src.mkdir()
    (src / "a.md").write_text("# Alpha\nUses `spark`, see [b](b.md). password=hunter2\n")
    (src / "b.md").write_text("# Beta\n")
    (src / "adr-1.md").write_text("# Decide\n")

    def call(*args):
        code = cli.main(["--store", store, *args])
        return code, json.loads(capsys.readouterr().out.strip().splitlines()[-1])

    code, out = call("rebuild", str(src))
    assert code == 0 and out["ingest"] == {"n_ok": 3, "n_skipped": 0, "n_failed": 0, "n_cached": 0, "n_refused": 0} and out["postcondition"]["status"] == "pass"
    again = call("replay", out["run_id"], str(src))[1]
    assert again["same_run"] and again["extract"] == out["extract"]
    assert tools.call("list", {"type": ["ag:note"], "count_only": True}, store) == {"count": 3}
    assert tools.call("list", {"limit": "x"}, store)["error"]["code"] == "invalid_input"
    assert tools.call("node", {"id": "y" * 5000}, store)["error"]["code"] == "invalid_input"
    assert tools.call("nothing", {}, store)["error"]["code"] == "not_found"
    assert tools.call("jobs", {"verb": "run", "name": "n", "file": "/gone"}, store)["error"]["code"] == "internal"
    assert len(tools.manifest()) >= 24
    code, out = call("list", "--type", "ag:note", "--sort", "name", "--limit", "2")
    assert [r["name"] for r in out["results"]] == ["a", "adr-1"] and out["total"] == 3 and out["truncated"]
    assert call("list", "--group-by", "type")[1]["groups"]["ag:technology"] == 1
    assert call("list", "--count-only", "--where", "name=Alpha")[1] == {"count": 1}
    code, out = call("query", "--q", "alpha", "--chunks")
    assert out["results"][0]["name"] == "Alpha" and len(out["chunks"]) == 1
    note = call("list", "--where", "name=a")[1]["results"][0]["id"]
    hops = call("neighbors", note, "--depth", "2")[1]["neighbors"]
    assert {h["type"] for h in hops} >= {"contains_section"}
    assert call("node", note)[1]["kind"] == "entity" and call("node", "nope")[1]["status"] == "not_found"
    assert call("why-connected", note, hops[0]["to_id"])[1]["path"]
    assert call("export", "--format", "dot", "--output", str(tmp_path / "dot"))[1]["nodes"] > 3
    assert call("sync-neo4j", "--dry-run")[1]["dry_run"] == 1
    assert call("diff", store, store)[1] == {"changes": []}
    assert call("version")[1] == {"version": "0.1.0"}
