"""Indexing runs over a real tree: full, skipped, incremental, branch overlay, commits."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from tessera.functions import render
from tessera.operators import build_graph
from tessera.plans import index as ix
from tessera.plans import search as S
from tessera.sources.store import Store


@pytest.fixture
def tree(tmp_path):
    root = str(tmp_path / "tree")
    os.makedirs(f"{root}/app")

    def git(*a):
        return subprocess.run(["git", "-C", root, "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True, text=True).stdout.strip()

    git("init", "-q", "-b", "main")
    put(root, "app/a.py", "def alpha(x):\n    return beta(x)\n\n\ndef beta(x):\n    return x\n")
    put(root, "b.md", "# Title\nSome words that are long enough here.\n")
    git("add", "-A")
    git("commit", "-qm", "feat: one")
    return root, git


def put(root, path, text):
    with open(f"{root}/{path}", "w") as f:
        f.write(text)


def test_index_life(spark, tree, tmp_path):
    root, git = tree
    store, head = Store(spark, f"file://{tmp_path}/ix"), git("rev-parse", "HEAD")
    assert ix.index(store, root, head) == {"code_blocks": 2, "text_blocks": 0, "document_blocks": 1}
    assert store.marker("files") == head and store.count("file_metadata") == 2 and store.count("graph_edges") >= 3
    assert ix.index(store, root, head) == dict.fromkeys(ix.TABLE_OF.values(), 0)
    put(root, "app/a.py", "def alpha(x):\n    return beta(x)\n\n\ndef beta(x):\n    return 2 * x\n")
    os.utime(f"{root}/app/a.py", (4_000_000_000, 4_000_000_000))
    assert ix.index(store, root, "next")["code_blocks"] == 1
    assert sorted(r.symbols[0] for r in store.read("code_blocks").collect()) == ["alpha", "beta"]
    assert all(len(r.embedding) == 64 for r in store.read("code_blocks").collect())
    os.unlink(f"{root}/b.md")
    ix.index(store, root, "next")
    assert store.count("document_blocks") == 0 and store.count("file_metadata") == 1
    hits = S.search(ix.all_blocks(store).withColumn("embedding", F.transform("embedding", lambda x: x.cast("double"))), S.Request(["return beta"], "code", 3)).collect()
    assert hits and hits[0].path == "app/a.py"
    ix.reindex_file(store, root, spark.createDataFrame([("app/a.py",)], "path string"), spark.createDataFrame([], "path string"))
    assert store.count("code_blocks") == 2


def test_commits_and_branches(spark, tree, tmp_path):
    root, git = tree
    store = Store(spark, f"file://{tmp_path}/ix2")
    head = git("rev-parse", "HEAD")
    ix.index(store, root, head)
    assert ix.index_commits(store, root) == 1 and ix.index_commits(store, root) == 0
    git("checkout", "-qb", "topic/x")
    put(root, "app/a.py", "def alpha(x):\n    return 'topic'\n")
    os.unlink(f"{root}/b.md")
    git("commit", "-qam", "fix: two")
    assert ix.index_commits(store, root) == 1
    m = ix.index_branch(store, root, "topic/x", "main")
    assert m["changed_paths"] == ["app/a.py"] and m["deleted_paths"] == ["b.md"] and ix.branches(store) == ["topic/x"]
    delta, hidden = ix.overlay_of(store, "topic/x")
    assert sorted(r.path for r in hidden.collect()) == ["app/a.py", "b.md"] and "topic" in delta.first().content
    store.set_marker("files", "moved", 1)
    assert ix.overlay_of(store, "topic/x") is None
    assert ix.prune_branches(store, root, "main") == []
    git("checkout", "-q", "main")
    git("merge", "-q", "topic/x")
    assert ix.prune_branches(store, root, "main") == ["topic/x"] and ix.branches(store) == []


def test_graph_views(spark):
    rows = spark.createDataFrame([("p", 1, 9, "b", ["y", "x"]), ("p", 0, 4, "a", ["x"])], "path string, start_line int, end_line int, content string, symbols array<string>")
    r = ix.file_nodes(rows).first()
    assert (r.symbols, r.size_lines) == (["x", "y"], 9) and r.hash == spark.sql("SELECT sha2('a\nbp', 256)").first()[0]
    assert ix.siblings(rows).first().symbols == ["x", "y"]
    edges = spark.createDataFrame([("a", "b", "calls"), ("a", "b", "imports"), ("b", "c", "extends")], "source string, target string, relation_type string")
    paths = spark.createDataFrame([("a", "c", ["a", "b", "c"])], "source string, target string, path array<string>")
    assert ix.rendered_paths(paths, edges).first().text == "a -calls-> b -extends-> c"
    assert sorted(map(tuple, ix.consumers(["b", "c"], edges).collect())) == [("b", "a"), ("c", "b")]
    nodes = spark.createDataFrame([("Alpha", "class", "loads configuration with class_loader")], "name string, kind string, description string")
    assert {r.concept: r.weight for r in ix.key_concepts(nodes).collect()} == {"alpha": 1.0, "class": 0.8, "configuration": 0.5, "class_loader": 0.5}
    imports = spark.createDataFrame([("a.md", "markdown", "b.md", "b.md"), ("x.py", "python", "lib.go_fast", "lib.py")], "path string, language string, name string, target string")
    exports = spark.createDataFrame([("lib.py", "go_fast")], "path string, name string")
    assert sorted((r.source, r.target, r.relation_type) for r in ix.direct_import_edges(imports, exports).collect()) == [("a.md", "b.md", "references"), ("lib.py", "x.py", "exports"), ("x.py", "lib.py", "imports")]
    lex, sem = spark.createDataFrame([("a", 0), ("b", 1)], "id string, rank int"), spark.createDataFrame([("b", 0), ("c", 1)], "id string, rank int")
    assert [r.id for r in ix.search_composition(lex, sem).collect()] == ["a", "b", "c"]
    files = spark.createDataFrame([("p/__init__.py", "python"), ("p/q/m.py", "python"), ("g/a.go", "go"), ("g/b.go", "go")], "path string, language string")
    assert sorted((r.source, r.target) for r in build_graph.layout_edges(files).collect()) == [("g/a.go", "folder:go:g"), ("g/b.go", "folder:go:g"), ("p/__init__.py", "p/q/m.py")]
    beside = build_graph.siblings(build_graph.layout_edges(files), files)
    assert sorted(map(tuple, beside.collect())) == [("g/a.go", "g/b.go"), ("g/b.go", "g/a.go")]


def test_rendering():
    s = render.signatures("a.py", "python", "# says\ndef f(x):\n    return x\n")
    assert s[0]["head"] == "def f(x)" and s[0]["comment"] == "# says"
    assert [x["kind"] for x in render.signatures("a.md", "markdown", "# A\nx\n## B\ny\n")] == ["h1", "h2"]
    assert render.patch_ranges("--- a/x.py\n+++ b/x.py\n@@ -3,2 +3,4 @@\n@@ -9 +11,0 @@\n--- /dev/null\n+++ b/n\n@@ -0,0 +1 @@") == [("x.py", 3, 4), ("x.py", 9, 9)]
    assert render.format_text("\tx  \r\n  y\n\n", "space", 4) == "    x\n  y\n" and render.format_text("     x", "tab", 4) == "\t x\n"
    assert render.long_lines("a\nbbb", 2) == [2] and render.diff("f", "a\n", "b\n").startswith("--- a/f") and render.combine(["a", "b"]).startswith("## Part 1")
