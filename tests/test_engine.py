"""A small repository from files to answers; storage and streams."""

import subprocess

import pytest
from pyspark.sql import functions as F

from loomgraph.api import Engine
from loomgraph.operators import coupling, cypher, extract, resolve
from loomgraph.plans import ingest
from loomgraph.sources import files as sources
from loomgraph.streaming import watch

CLONE = '''

def {0}(rows):
    total = 0
    for row in rows:
        if row.value > 10:
            total = total + row.value * 2
        else:
            total = total - row.value
    while total > 100:
        total = total / 2
    return total if total else None
'''
FILES = {
    "app/util.py": "LIMIT = 3\n\n\ndef helper(x):\n    return x\n" + CLONE.format("sum_rows"),
    "app/main.py": "import requests\nfrom app.util import helper\n\n\ndef run():\n    helper(1)\n    requests.get('/api/users')\n\n\ndef emit():\n    celery.send_task('mail.sent')\n" + CLONE.format("add_rows"),
    "app/server.py": "from flask import app\n\n\n@app.get('/api/users')\ndef users():\n    return []\n",
    "app/test_util.py": "from app.util import helper\n\n\ndef test_helper():\n    helper(2)\n",
    "web/app.js": "class AppError {}\nfunction load() {\n  throw new AppError('x');\n}\n",
    "settings.yaml": "api-base-url: x\n",
    "web/config.js": "const apiBaseUrl = 'y';\n",
    "notes.md": "# Title\ntext\n## Part\n",
    "skip.png": "no",
    ".gitignore": "ignored\n",
    "ignored/x.py": "def hidden(): pass\n",
}


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    git = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=a", "-c", "user.email=a@example.org", *a], check=True, capture_output=True)
    git("init", "-b", "main")
    for k in range(3):
        for path, text in FILES.items():
            (root / path).parent.mkdir(parents=True, exist_ok=True)
            (root / path).write_text(text + ("#\n" * k if path in ("app/util.py", "app/main.py") else ""))
        git("add", "-A")
        git("commit", "-m", str(k))
    return root


@pytest.fixture(scope="module")
def engine(spark, repo, tmp_path_factory):
    made = Engine(spark, str(tmp_path_factory.mktemp("store")))
    row = made.index_repository(str(repo), "p").first()
    assert row.nodes > 20 and row.edges > 20 and row.status == "ready"
    return made


def edges(engine, kind):
    rows = engine.query_graph(f"MATCH (a)-[r:{kind}]->(b) RETURN a.name AS a, b.name AS b", "p", 1000).collect()
    return {(r.a, r.b) for r in rows}


def test_edges(engine):
    assert ("run", "helper") in edges(engine, "CALLS") and ("test_helper", "helper") in edges(engine, "CALLS")
    assert ("main", "util") in edges(engine, "IMPORTS")
    assert ("test_helper", "helper") in edges(engine, "TESTS")
    assert ("test_util.py", "util.py") in edges(engine, "TESTS_FILE")
    assert ("run", "/api/users") in edges(engine, "HTTP_CALLS")
    assert any(b == "/api/users" for _, b in edges(engine, "HANDLES"))
    assert any(a == "run" for a, _ in edges(engine, "DATA_FLOWS"))
    assert edges(engine, "EMITS") == {("emit", "__event__celery__mail.sent")}
    assert ("load", "AppError") in edges(engine, "RAISES")
    assert ("apiBaseUrl", "api-base-url") in edges(engine, "CONFIGURES")
    assert edges(engine, "FILE_CHANGES_WITH") == {("main.py", "util.py")}
    assert {frozenset(e) for e in edges(engine, "SIMILAR_TO")} == {frozenset(("sum_rows", "add_rows"))}
    assert ("app", "main.py") in edges(engine, "CONTAINS_FILE") and ("p", "app") in edges(engine, "CONTAINS_FOLDER")
    assert ("main.py", "run") in edges(engine, "DEFINES")
    assert not engine.query_graph('MATCH (a) WHERE a.name = "hidden" RETURN a', "p").count()


def test_questions(engine, repo):
    rows = engine.search_graph("p", name_pattern="helper").collect()
    assert {r.name for r in rows} == {"helper", "test_helper"} and rows[0].total == 2 and not rows[0].has_more
    assert engine.search_graph("p", query="requests").where("name = 'run'").count() == 1
    assert engine.search_graph("p", semantic_query=["helper"]).first().name in ("helper", "test_helper")
    calls = {(r.name, r.hop, r.risk) for r in engine.trace_call_path("p", "run").collect()}
    assert ("helper", 1, "CRITICAL") in calls
    back = engine.trace_call_path("p", "helper", "in").collect()
    assert {r.name for r in back} == {"run"}
    assert {r.name for r in engine.trace_call_path("p", "helper", "in", include_tests=True).collect()} == {"run", "test_helper"}
    found = engine.get_code_snippet("p", "python:helper").collect()
    assert len(found) == 1 and found[0].match_method == "suffix" and found[0].source.startswith("def helper(x):\n    return x") and found[0].callers == 2
    schema = {(r.kind, r.key): r.n for r in engine.get_graph_schema("p").collect()}
    assert schema["language", "python"] == 4 and schema["label", "Project"] == 1
    aspects = engine.get_architecture("p", ("all",))
    assert {r.package for r in aspects["packages"].collect()} == {"app", "web", "."} and aspects["hotspots"].count() == 10 and aspects["messages"].count() == 1
    code = engine.search_code("p", "total = total", limit=3).collect()
    assert {r.name for r in code} == {"sum_rows", "add_rows"} and code[0].label == "Function"
    assert engine.search_code("p", "helper", "full", context=1).first().source
    assert {r.file_path for r in engine.search_code("p", "helper", "files", file_pattern="*.py").collect()} == {"app/main.py", "app/test_util.py", "app/util.py"}
    assert engine.connected("p").where("size(inbound) > 0").count() > 5


def test_changes(engine, repo, spark):
    path = repo / "app/util.py"
    old = path.read_text()
    path.write_text(old + "\n\ndef more():\n    pass\n")
    changed, hit, radius = engine.detect_changes("p", str(repo))
    assert {r.file_path for r in changed.collect()} == {"app/util.py"}
    assert "helper" in {r.name for r in hit.collect()}
    assert ("run", "high") in {(r.name, r.risk) for r in radius.collect()}
    states = {r.rel_path: r.state for r in engine.changed(str(repo), "p").collect()}
    assert states["app/util.py"] == "changed" and states["app/main.py"] == "same"
    path.write_text(old)
    assert sources.since_commit(str(repo), "HEAD")


def as_sets(engine, project):
    nodes = {r.id: (r.label, r.qualified_name.replace(project, "p"), r.start_line, r.end_line) for r in engine.store.read("nodes", project).collect()}
    return set(nodes.values()), {(r.type, nodes[r.source_id][1], nodes[r.target_id][1]) for r in engine.store.read("edges", project).collect()}


def test_a_new_index_follows_the_changed_files(spark, repo, tmp_path, monkeypatch):
    import shutil

    root = tmp_path / "tree"
    shutil.copytree(repo, root)
    made = Engine(spark, str(tmp_path / "store"))
    made.index_repository(str(root), "p")
    before = as_sets(made, "p")
    monkeypatch.setattr(ingest, "build", None)  # from here on only what changed is extracted
    made.index_repository(str(root), "p")
    assert as_sets(made, "p") == before
    (root / "app/util.py").write_text(FILES["app/util.py"] + "\n\ndef more():\n    helper(3)\n    requests.post('/api/more')\n")
    (root / "app/extra.py").write_text("from app.util import helper\n\n\ndef extra():\n    helper(4)\n")
    (root / "web/app.js").unlink()
    made.index_repository(str(root), "p")
    monkeypatch.undo()
    after = as_sets(made, "p")
    Engine(spark, str(tmp_path / "other")).index_repository(str(root), "p")
    assert after == as_sets(Engine(spark, str(tmp_path / "other")), "p")
    names = {q for _, q, *_ in after[0]}
    assert any(q.endswith(":more") for q in names) and not any("web/app.js" in q for q in names) and any(q.endswith("folder:web") for q in names)
    shutil.rmtree(root / "web")
    made.index_repository(str(root), "p")
    assert not any("web" in q for _, q, *_ in as_sets(made, "p")[0])


def test_modes_limits_and_overlay(spark, repo, tmp_path):
    import json
    import shutil

    root = tmp_path / "tree"
    shutil.copytree(repo, root)
    (root / ".loomgraph").mkdir()
    symbol = {"symbol": "pkg a.py/thing#", "display_name": "", "kind": "struct", "start_line": 4}
    found = {"documents": [{"rel_path": "app/util.py", "language": "python", "symbols": [symbol, {"symbol": "x.y", "qualified_name": "far.away.y", "kind": "function", "start_line": 1, "end_line": 2}], "occurrences": []}]}
    (root / ".loomgraph/symbols.json").write_text(json.dumps(found))
    call = {"caller_qualified_name": "p:app/main.py:python:symbol:python:run", "callee_name": "helper", "full_callee_name": "", "resolved_qualified_name": "p:app/test_util.py:python:symbol:python:test_helper", "confidence": 0.7}
    (root / ".loomgraph/resolutions.json").write_text(json.dumps({"documents": [{"rel_path": "app/main.py", "language": "go", "resolved_calls": [call]}]}))
    made = Engine(spark, str(tmp_path / "store"))
    with pytest.raises(ingest.GraphTooLarge):
        made.index_repository(str(root), "p", most_nodes=3)
    assert not made.store.has("nodes", "p")  # nothing is replaced before all is made
    made.index_repository(str(root), "p", mode="fast")
    assert not edges(made, "SIMILAR_TO") and edges(made, "CALLS") and not made.store.has("overlay_symbols", "p")
    made.delete_project("p")
    made.index_repository(str(root), "p")
    assert ("run", "test_helper") in edges(made, "CALLS") and ("run", "helper") not in edges(made, "CALLS")  # the side file comes first
    assert edges(made, "SIMILAR_TO")
    assert made.get_code_snippet("p", "app.util.helper").first().match_method == "suffix"  # by file and name
    row = made.get_code_snippet("p", "far.away.y").first()
    assert (row.match_method, row.name, row.source) == ("overlay", "y", "LIMIT = 3\n")
    assert made.get_code_snippet("p", "away.y").first().match_method == "overlay_suffix"
    assert made.get_code_snippet("p", "pkg a.py/thing#").first().label == "Class"
    with pytest.raises(LookupError):
        made.get_code_snippet("p", "nowhere.at.all")
    counts = made.search_code("p", "total = total", limit=1, counts=True).first()
    assert counts.total == 2 and counts.has_more and counts.total_lines > 4 and 0 < counts.dedup_ratio < 1


def test_languages_of_names_and_contents(spark, tmp_path):
    texts = {"Dockerfile": "x", "Makefile": "x", "a.m": "@interface A", "b.m": "theorem t", "c.m": "x = 1", "d.q": "x", "e.svg": "x", "f.PNG": "x"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    table = sources.extension_map(" .q = Python, q=go,bad,=x")
    got = {r.file_path: r.language for r in sources.discover(spark, str(tmp_path), overrides=table).collect()}
    assert got == {"Dockerfile": "dockerfile", "Makefile": "makefile", "a.m": "objc", "b.m": "magma", "c.m": "matlab", "d.q": "python", "f.PNG": None}


def test_a_wrong_base_is_told(engine, repo):
    with pytest.raises(ValueError):
        engine.detect_changes("p", str(repo), "no-such-branch")


def test_bindings_lead_the_ladder(spark):
    symbols = [(1, "load", "lib.io.load", "Function", "lib/io.py", 1), (2, "load", "app.load", "Function", "app/a.py", 5), (3, "Reader", "lib.io.Reader", "Class", "lib/io.py", 9), (4, "load", "other.load", "Function", "b.py", 2)]
    table = spark.createDataFrame(symbols, "id long, name string, qualified_name string, label string, file_path string, start_line int")
    refs = [(1, "io.load", "app/a.py", None), (2, "rd", "app/a.py", None), (3, "load", "app/a.py", None), (4, "io.load", "b.py", None), (5, "x.load", "c.py", "Function"), (6, "nothing", "c.py", None), (7, "lib.io.load", "c.py", None)]
    asked = spark.createDataFrame(refs, "ref_id long, name string, file_path string, preferred_label string")
    bound = spark.createDataFrame([("app/a.py", "io", "lib.io"), ("app/a.py", "rd", "lib.io.Reader")], "file_path string, alias string, namespace string")
    got = {r.ref_id: (r.id, r.strategy) for r in resolve.resolve(asked, table, bound).collect()}
    assert got == {1: (1, "import_namespace"), 2: (3, "import_alias"), 3: (2, "same_file"), 4: (1, "qualified_suffix"), 5: (2, "preferred_label"), 7: (1, "exact")}


def test_projects(engine):
    engine.manage_adr("p", "update", "# One\ntext\n## Two\n")
    engine.manage_adr("p", "update", "# Three\n")
    assert [r.section for r in engine.manage_adr("p", "sections").collect()] == ["# Three"]
    engine.store.replace("nodes", engine.store.read("nodes", "p").withColumn("project", cypher.F.lit("q")))
    assert {r.name: r.status for r in engine.list_projects().collect()} == {"p": "ready", "q": "ready"}
    engine.store.delete("nodes", "q")
    assert engine.index_status("q").first().status == "not_found" and engine.index_status("p").first().status == "ready"
    assert engine.ingest_traces("p", [1, 2]) == 2


@pytest.mark.parametrize("text", ["RETURN a", "MATCH (a) RETURN", "MATCH (a)-[r:T*]->(b) RETURN a", "MATCH (a) WHERE RETURN a"])
def test_queries_outside_the_language(engine, text):
    with pytest.raises(cypher.QueryError):
        engine.query_graph(text, "p")


def test_coupling_limits(spark):
    rows = [(c, f) for c in range(3) for f in ("a", "b")] + [(9, f"f{i}") for i in range(21)] + [(c, "b") for c in range(10, 18)] + [(c, f) for c in (20, 21) for f in ("x", "y")]
    found = coupling.couplings(spark.createDataFrame(rows, "commit_id long, file_path string")).collect()
    assert [(r.a, r.b, r["both"], r.score) for r in found] == [("a", "b", 3, 1.0)]


def test_watch_sees_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("one")
    seen = []

    def refresh(batch, _):
        seen.extend(r.path.rsplit("/", 1)[1] for r in batch.select("path").collect())

    for name in ("b", "c"):
        watch.watch(spark, str(tmp_path / "in"), refresh, str(tmp_path / "state"), once=True).awaitTermination(60)
        (tmp_path / f"in/{name}.txt").write_text(name)
    assert seen == ["a.txt", "b.txt"]
    assert [watch.interval_seconds(n) for n in (0, 1000, 10**6)] == [5, 7, 60]


def test_activity_on_a_stream_equals_the_table(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    watch.activity(stream).writeStream.format("memory").queryName("activity").outputMode("complete").trigger(availableNow=True).start().awaitTermination(60)
    assert sorted(spark.table("activity").collect()) == sorted(watch.activity(events).collect())


def test_blocks_over_lines_hide_no_line_and_give_no_symbol(spark):
    python = 'def a():\n    """one\n    def hidden():\n        gone()\n    """\n    x = "/* no block"  # \'\'\' nor here\n    b()\n\'\'\'open\nc()\n'
    script = "/* function old() {\n lost(); */ kept();\nconst u = 'http://x/*y'; // /* not a block\nseen();\nconst t = `\nfunction fake() {\nfaked()`;\nlast(`one ${line}`);\n/* never closed\ngone()"
    files = spark.createDataFrame([("a.py", "python", python), ("b.js", "javascript", script), ("c.yaml", "yaml", "a: /*\nb: 1"), ("d.py", "python", ""), ("e.js", "javascript", None)], "file_path string, language string, content string")
    lines = extract.source_lines(files)
    assert {(r["file_path"], r["n"]) for r in lines.groupBy("file_path").agg(F.count("*").alias("n")).collect()} == {("a.py", 10), ("b.js", 10), ("c.yaml", 2), ("d.py", 1)}
    assert {(r["file_path"], r["line"], r["name"]) for r in extract.definitions(lines).where("language != 'yaml'").collect()} == {("a.py", 1, "a"), ("b.js", 3, "u"), ("b.js", 5, "t")}
    assert {(r["file_path"], r["line"], r["callee"]) for r in extract.calls(lines).collect()} == {("a.py", 7, "b"), ("b.js", 2, "kept"), ("b.js", 4, "seen"), ("b.js", 8, "last")}
    assert extract.definitions(lines).where("language = 'yaml'").count() == 2


def test_a_call_has_its_own_first_string(spark):
    code = 'send(get("/a"), "/b")\nput(x + "/c")\nlog("m", 1); api.post( \'/d\', y)\nnone(1); none2(2)'
    lines = extract.source_lines(spark.createDataFrame([("a.py", "python", code)], "file_path string, language string, content string"))
    assert {(r["line"], r["callee"], r["first_string"]) for r in extract.calls(lines).collect()} == {(1, "send", None), (1, "get", "/a"), (2, "put", "/c"), (3, "log", "m"), (3, "api.post", "/d"), (4, "none", None), (4, "none2", None)}


def test_imports_bind_every_name_of_a_line(spark):
    code = {
        "python": "from util import helper as renamed, other\nimport a.b as c, d  # x as y\nfrom . import *\nfrom pkg import (one,",
        "javascript": "import defaultThing, { helper as renamed, other } from \"./util\";\nimport * as all from 'm'\nconst {p: q} = require('n')\nconst r = require('o')\nimport 'side'",
        "rust": "use crate::util::{helper as renamed, other};\nuse a::b as c;\nuse d::e;",
        "go": 'import alias "example.com/tools/runtime"\nimport "fmt"',
        "java": "import java.util.List;",
        "zig": 'const std = @import("std");',
    }
    lines = extract.source_lines(spark.createDataFrame([(k, k, v) for k, v in code.items()], "file_path string, language string, content string"))
    got = {k: set() for k in code}
    for r in extract.imports(lines).collect():
        got[r["file_path"]].add((r["line"], r["target"], r["alias"], r["linked"]))
    assert got["python"] == {(1, "util", "", True), (1, "util.helper", "renamed", False), (1, "util.other", "other", False), (2, "a.b", "c", True), (2, "d", "d", True), (3, ".", "", True), (4, "pkg", "", True), (4, "pkg.one", "one", False)}
    assert got["javascript"] == {(1, "./util", "defaultThing", True), (1, "./util.helper", "renamed", False), (1, "./util.other", "other", False), (2, "m", "all", True), (3, "n", "", True), (3, "n.p", "q", False), (4, "o", "r", True), (5, "side", "side", True)}
    assert got["rust"] == {(1, "crate::util", "", True), (1, "crate::util::helper", "renamed", False), (1, "crate::util::other", "other", False), (2, "a::b", "c", True), (3, "d::e", "e", True)}
    assert got["go"] == {(1, "example.com/tools/runtime", "alias", True), (2, "fmt", "fmt", True)}
    assert got["java"] == {(1, "java.util.List", "List", True)}
    assert got["zig"] == {(1, "std", "std", True)}
