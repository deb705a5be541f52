"""Operators on small literal inputs: structural search, extraction, graph building, sources, store, streaming, search."""

import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.languages import extract
from tessera.operators import blocks as B
from tessera.operators import build_graph, chunks, fusion, graph, incremental, metrics, resolve, structural
from tessera.plans import search as S
from tessera.sources import files as FS
from tessera.sources.store import Lock, Store
from tessera.streaming import feed

SOURCES = {
    "app/main.py": "from app.util import helper as h, Base\nimport app.util as u\n\nclass Job(Base):\n    def run(self):\n        self.stop()\n        return h(1)\n\n    def stop(self):\n        pass\n\n\ndef start():\n    Job().run()\n    start()\n",
    "app/util.py": "# a helper\ndef helper(x):\n    return other(x)\n\n\nclass Base:\n    pass\n\n\ndef other(x):\n    return x\n",
    "web/index.ts": "import { go } from './lib';\nexport class K extends L {\n  run(x: number): void {\n    go(x, 1);\n    go(y, 2);\n  }\n}\n",
    "web/lib.ts": "export function go(a, b) { return a; }\nexport class L {}\n",
    "notes.md": "# Top\nintro text here\n\n## Part\nmore words about helper\n\n[x](docs/a.md#q)\n",
    "plain.txt": "line one\nline two\n",
}


@pytest.fixture(scope="module")
def files(spark):
    rows = [(p, c) for p, c in SOURCES.items()]
    return spark.createDataFrame(rows, "path string, content string").withColumn("language", T.language(F.col("path"))).cache()


# structural
def test_patterns():
    text = "foo(a.b(c), 1);\nfoo(x);\nbar.unwrap(); a.b(c).unwrap()"
    got = [text[a:b] for a, b, _ in structural.find("foo($A, $B)", text, "javascript")]
    assert got == ["foo(a.b(c), 1)"]
    assert [b for *_, b in structural.find("foo($$$ARGS)", text, "javascript")] == [{"ARGS": "a.b(c), 1"}, {"ARGS": "x"}]
    assert [b["X"] for *_, b in structural.find("$X.unwrap()", text, "javascript")] == ["bar", "a.b(c)"]
    assert [b["X"] for *_, b in structural.find("$X.unwrap()", text, "javascript", {"X": "^b"})] == ["bar"]
    assert [text_ for text_ in [m[2] for m in structural.find("$A == $A", "x == x; y == z;", "javascript")]] == [{"A": "x"}]
    assert list(structural.find("foo($A)", "// foo(1)\n'foo(2)'", "javascript")) == []
    assert structural.rewrite("foo($A, $B)", "foo($B, $A)", text, "javascript") == (text.replace("foo(a.b(c), 1)", "foo(1, a.b(c))"), 1)
    assert structural.diagnose("f($A, ", "rust")["error"] == "unbalanced"


def test_structural_search(files):
    rows = structural.search(files, "go($A, $B)").orderBy("line").collect()
    assert [(r.path, r.line, r.column, r.text, r.breadcrumb) for r in rows if r.path == "web/index.ts"] == [("web/index.ts", 4, 4, "go(x, 1)", "K › run"), ("web/index.ts", 5, 4, "go(y, 2)", "K › run")]
    assert structural.smart(files, "def $NAME helper")[0] == "kind"
    assert structural.smart(files, "intro text $X here")[0] in ("pattern", "lexical")
    assert structural.smart(files, "nothing_like_this($A)")[0] == "none"
    kind, refs = structural.symbols(files, "helper", refs=True)
    assert kind == "references" and any(r.text.endswith("[def]") for r in refs.collect())
    assert structural.symbols(files, "hel*")[1].collect()[0].name == "helper"
    assert [r.column for r in structural.lexical(files, "two").collect()] == [5]
    page = structural.page(structural.search(files, "go($A, $B)"), 0, 1).collect()
    assert page[0].matches == 3 and page[0].files == 2


# extraction and graph
@pytest.mark.parametrize(
    "lang,text,relations,imports",
    [
        ("rust", "use a::b as c;\nimpl Tr for S {\n fn go(&self) {}\n}\ntrait X: Y + Z {}", {("S", "implements", "Tr"), ("X", "extends", "Y"), ("X", "extends", "Z")}, ["a::b as c"]),
        ("java", "import a.B;\nclass A extends B implements C, D<E> {}", {("A", "extends", "B"), ("A", "implements", "C"), ("A", "implements", "D")}, ["a.B"]),
        ("go", 'import "fmt"\ntype T struct {\n\tBase\n\tx int\n}', {("T", "extends", "Base")}, ["fmt"]),
        ("cpp", '#include "a.h"\nclass A : public B, private C {};', {("A", "extends", "B"), ("A", "extends", "C")}, ['"a.h"']),
        ("ruby", "require 'set'\nclass A < B\nend", {("A", "extends", "B")}, ["set"]),
        ("php", "<?php\nuse A\\B;\nclass C extends D implements E {}", {("C", "extends", "D"), ("C", "implements", "E")}, ["A\\B"]),
        ("swift", "import Foundation\nclass A: B {}\nprotocol Q: R {}", {("A", "implements", "B"), ("Q", "extends", "R")}, ["Foundation"]),
        ("typescript", "import x from './m';\nclass K extends L implements M {}\ninterface I extends J {}", {("K", "extends", "L"), ("K", "implements", "M"), ("I", "extends", "J")}, ["./m"]),
        ("lua", "local m = require('a.b')", set(), ["a.b"]),
        ("bash", "source ./lib.sh", set(), ["./lib.sh"]),
        ("css", "@import 'x.css';", set(), ["x.css"]),
        ("markdown", "[a](b.md) ![i](z.md) [e](http://q/x.md) [c](c.markdown#t)", set(), ["b.md", "c.markdown"]),
    ],
)
def test_languages(lang, text, relations, imports):
    x = extract(lang, text)
    assert {(s, k, t) for _, s, k, t in x.relations} == relations and x.imports == imports


def test_broken_source_gives_nothing():
    assert extract("python", "def (").symbols == [] and extract("unknown", "x").symbols == []


def test_graph_of_files(files):
    nodes, edges = build_graph.build(files)
    e = {(r.source, r.target, r.relation_type): r for r in edges.collect()}
    assert ("app/main.py", "app/util.py", "imports") in e and ("web/index.ts", "web/lib.ts", "imports") in e
    assert e["app/main.py::Job::run", "app/util.py::helper", "calls"].confidence == pytest.approx(0.95)  # through the bound name
    assert e["app/main.py::Job::run", "app/main.py::Job::stop", "calls"].provenance == "extracted"
    assert e["app/main.py::start", "app/main.py::start", "calls"].confidence == 1.0
    assert ("app/main.py::Job", "app/util.py::Base", "extends") in e and ("web/index.ts::K", "web/lib.ts::L", "extends") in e
    assert ("app/util.py", "app/util.py::Base", "contains") in e
    ids = [r.id for r in nodes.collect()]
    assert len(ids) == len(set(ids))


def test_symbol_ids_and_resolution(spark):
    s = spark.createDataFrame([("f", None, "x", 1), ("f", None, "x", 5), ("f", "A", "x", 7)], "path string, owner string, name string, start_line int")
    assert sorted(r.id for r in graph.symbol_ids(s).collect()) == ["f::A::x", "f::x@2", "f::x@6"]
    decl = spark.createDataFrame([("a1", "a", "n"), ("b1", "b", "n"), ("c1", "c", "m"), ("c2", "c", "m"), ("d1", "d", "m")], "id string, path string, name string")
    uses = spark.createDataFrame([(1, "a", "n"), (2, "x", "n"), (3, "y", "m"), (4, "z", "n")], "use_id int, path string, name string")
    imports = spark.createDataFrame([("x", "b"), ("y", "c")], "path string, imported string")
    got = {r.use_id: (r.target, r.confidence) for r in resolve.scoped(uses, decl, imports).collect()}
    assert got == {1: ("a1", 0.9), 2: ("b1", 0.85)}  # 3 is ambiguous among imports, which ends the search; 4 is ambiguous among all
    many = resolve.scoped(uses, decl, imports, ambiguous=True).where("use_id = 3").collect()
    assert sorted(r.target for r in many) == ["c1", "c2"] and many[0].confidence == 0.45
    n = spark.createDataFrame([("src/a.rs",), ("src/a.rs::S::go",), ("src/b.rs::run",), ("src/c.rs::run",)], "id string")
    asked = spark.createDataFrame([("src/a.rs",), ("./src/a.rs",), ("A.RS",), ("S::go",), ("go",), ("run",)], "text string")
    got = {r.text: r.id for r in graph.resolve_id(n, asked).collect()}
    assert got == {"src/a.rs": "src/a.rs", "./src/a.rs": "src/a.rs", "A.RS": "src/a.rs", "S::go": "src/a.rs::S::go", "go": "src/a.rs::S::go"}


def test_calls_meet_counts_not_declarations(spark):
    """300 calls through two bindings to files with 300 declarations of the name: no row for each pair."""
    uses = [(k, "a", f"C{k}" if k % 2 else None, "n", None if k % 3 else "q") for k in range(300)]
    uses += [(1000, "a", None, "one", None), (1001, "a", "C", "two", "self"), (1002, "a", None, "deep", "K"), (1003, "z", None, "one", None), (1003, None, None, "one", None)]
    uses = spark.createDataFrame(uses, "use_id int, path string, owner string, name string, qualifier string")
    decl = [(f"b{k}", "b", None, "n") for k in range(300)] + [("b::one", "b", None, "one"), ("b::one", "b", "X", "one"), ("a::two", "a", "C", "two"), ("b::K::deep", "b", "K", "deep"), ("b::L::deep", "b", "L", "deep"), ("c::one", "c", None, "one")]
    decl = spark.createDataFrame(decl, "id string, path string, owner string, name string")
    binds = [("a", local, None if local != "K" else real, "b") for local in ("n", "q", "one", "K") for real in ("K", "M")] + [("a", "n", "n", "b"), ("a", "one", "one", "b")]
    binds = spark.createDataFrame(binds, "path string, local string, real string, bound string")
    imports = spark.createDataFrame([("a", "b", "b")], "path string, raw string, imported string")
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = lambda: store.stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), None)
    before = {stages().apply(k).stageId() for k in range(stages().size())}
    got = sorted(tuple(r) for r in resolve.calls(uses, decl, imports, binds).collect())
    assert got == [(1000, "b::one", 0.95, "extracted"), (1001, "a::two", 0.95, "extracted"), (1002, "b::K::deep", 0.95, "extracted")]
    after = [x for k in range(stages().size()) if (x := stages().apply(k)).stageId() not in before]
    assert 0 < sum(x.shuffleWriteRecords() for x in after) < 20_000


def test_paths_are_simple_and_capped(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("b", "a"), ("a", "b")], "source string, target string")
    one = lambda x: spark.createDataFrame([(x,)], "id string")
    got = [r.path for r in graph.paths(e, one("a"), one("c"), 4).collect()]
    assert sorted(got) == [["a", "b", "c"], ["a", "c"]]
    assert [r.path for r in graph.paths(e, one("a"), one("c"), 4, cap=1).collect()] == [["a", "c"]]


def test_overlay_graph(spark):
    nodes = lambda *x: spark.createDataFrame([(i, i.split("::")[0]) for i in x], "id string, path string")
    edges = lambda *x: spark.createDataFrame(list(x), "source string, target string")
    n, e = graph.merge_overlay((nodes("a", "b", "c"), edges(("a", "b"), ("b", "c"), ("a", "c"))), (nodes("b", "d"), edges(("b", "d"), ("d", "gone"))), spark.createDataFrame([("b",)], "path string"))
    assert sorted(r.id for r in n.collect()) == ["a", "b", "c", "d"] and sorted(map(tuple, e.collect())) == [("a", "c"), ("b", "d")]


# fusion, overlay, metrics
def test_fusion_rules(spark):
    lists = spark.createDataFrame([(1, "x", 0, 0.5), (2, "y", 0, 0.2), (1, "y", 1, None), (2, "z", 1, 0.9)], "q int, hash string, rank int, distance double")
    rows = {r.hash: r for r in fusion.fuse_queries(lists, ["hash"], 0.6).collect()}
    assert set(rows) == {"x", "y"} and rows["y"].fused > rows["x"].fused and rows["y"].distance == 0.2
    main = spark.createDataFrame([(1, "a", 0.1), (1, "b", None), (1, "c", 0.3)], "q int, path string, distance double")
    branch = spark.createDataFrame([(1, "a2", 0.1)], "q int, path string, distance double")
    over = spark.createDataFrame([("c",)], "path string")
    assert [r.path for r in fusion.overlay(main, branch, over, "path", ["q"], "path", 5).orderBy("rank").collect()] == ["b", "a2", "a"]


def test_metric_example(spark):
    """Hits miss, grade 2, grade 1 against grades 2 and 1: the reciprocal rank is a half, all truths are found."""
    hits = spark.createDataFrame([(1, "x", 0), (1, "a", 1), (1, "b", 2)], "query_id int, id string, rank int")
    truth = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0)], "query_id int, id string, grade double")
    r = metrics.per_query(hits, truth).first()
    assert (r.mrr, r.recall_at_10, r.hit_at_5) == (0.5, 1.0, 1.0) and r.ndcg_at_10 == pytest.approx(1.7618595 / 2.6309298, abs=1e-5)
    assert metrics.gate(metrics.per_query(hits, truth))[1]
    t = metrics.parse_truths(spark.createDataFrame([("q", "a.rs:3-9:2", "bad", None)], "query string, r1 string, r2 string, r3 string"), ["r1", "r2", "r3"]).collect()
    assert [tuple(x) for x in t] == [("q", "a.rs", 3, 9, 2.0)]
    res = spark.createDataFrame([(1, 0, "p", 5, 6), (1, 1, "p", 50, 60)], "query_id int, rank int, path string, start int, end int")
    tr = spark.createDataFrame([(1, "p", 1, 5, 1.0), (1, "p", 6, 8, 2.0)], "query_id int, path string, t_start int, t_end int, grade double")
    assert [r.grade for r in metrics.range_grades(res, tr).orderBy("rank").collect()] == [2.0, 0.0]


# chunks
def test_text_chunks():
    assert list(chunks.text_chunks("", 10, 1)) == []
    assert list(chunks.text_chunks("\n\naa\nbb\ncc", 6, 0)) == [("aa\nbb", 1, 4), ("cc", 5, 5)]
    assert list(chunks.text_chunks("aa\nbb\ncc\ndd", 6, 1)) == [("aa\nbb", 1, 2), ("bb\ncc", 2, 3), ("cc\ndd", 3, 4)]
    assert list(chunks.text_chunks("a" * 50, 6, 1)) == [("a" * 50, 1, 1)]
    text = "\n".join(f"line {k} ü" * (k % 5) for k in range(300))
    got = list(chunks.text_chunks(text, 120, 2))
    assert all(len(c.encode()) <= 120 or "\n" not in c for c, *_ in got)
    assert {k for _, a, b in got for k in range(a, b + 1)} == set(range(1, 301))


def test_markdown():
    text = "pre\n# A\naaaa\n## B\nbbbb\n```\n# no header\n```\n# C\ncccc\n####### deep\n"
    s = chunks.sections(text)
    assert [(x.level, x.title, x.start, x.end) for x in s] == [(1, "", 0, 0), (1, "A", 1, 2), (2, "B", 3, 7), (1, "C", 8, 10)]
    assert s[1].children == [2] and s[2].context == ["# A", "## B"] and "####### deep" in s[3].content
    assert not chunks.valid("```\n```") and not chunks.valid("short") and chunks.valid("long enough text")
    whole = chunks.markdown_chunks("# T\n" + "w " * 40 + "\n## S\n" + "v " * 40, 100)
    assert {c.title for c in whole} == {"T", "S"} or len(whole) == 1
    assert chunks._fences(["```", "a", "~~~", "```"]) == [True, True, True, False]


def test_diff_chunks():
    part = lambda n, k: f"diff --git a/{n} b/{n}\n--- a/{n}\n+++ b/{n}\n@@ -1 +1 @@\n" + "+x\n" * k
    assert chunks.diff_chunks(part("a b.txt", 2)) == [(part("a b.txt", 2), "a b.txt")]
    got = chunks.diff_chunks(part("one", 2000) + part("two", 2000) + part("big", 9000))
    assert all(chunks.size(c) <= 8000 + 200 + 1 for c, _ in got) and got[0][1] == "one" and all("+++ b/big" in c for c, n in got if n == "big")
    assert chunks.truncate("aé", 2) == "a" and chunks.diff_summary(["a"] * 5) == "5 files"
    assert chunks.smart_truncate("x" * 90, 30).startswith("x" * 10 + " [") and chunks.smart_truncate("ab", 0) == "ab"
    assert chunks.symbol_body("a\nfn f() {\n if x {\n }\n}\nrest", 1) == "fn f() {\n if x {\n }\n}"
    assert [len(g) for g in chunks.merge_lines([(k, k, "use x") for k in range(20)] + [(90, 95, "fn")])] == [15, 5, 1]


# text functions
def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    assert one(T.normalise_path(lit("a\\b/../c/./d"))) == "a/c/d" and one(T.normalise_path(lit("../../x/.."))) == "../.." and one(T.normalise_path(lit("/../a"))) == "/a"
    assert one(T.relative_to(lit("src/a/b.ts"), lit("../c"))) == "src/c"
    assert one(T.strip_preamble(T.code_preamble(lit("p"), lit("rust"), F.array(lit("f")), lit("body\n\nmore")))) == "body\n\nmore"
    assert one(T.strip_preamble(lit("no preamble"))) == "no preamble"
    assert one(T.markdown_links(lit("[a](x.md#q) [b](http://e/x.md) ![c](y.md) [d](a.markdown)"))) == ["a.markdown", "x.md"]
    assert one(T.simple_type(lit("a::B<C>"))) == "B" and one(F.struct(*[c.alias(n) for n, c in zip("nq", T.callee(lit("&self.a?.b::<T>")))])) == ("b", "self::a")
    assert T.prefilter_tokens("foo($A).bar_baz($$$X, y)") == ["bar_baz", "foo"]
    assert one(T.path_matches(lit("src/a/b.rs"), "src/**/*.rs")) and not one(T.path_matches(lit("src/a/b.rs"), "src/*.rs")) and one(T.path_matches(lit("src/a[b"), "[b"))
    assert one(T.severity_shown(lit("low"), "HIGH")) is False and one(T.severity_shown(lit("odd"), "HIGH")) is True
    assert T.bump("1.2.3", False, True) == "1.3.0" and T.bump("v1.2.3-rc.1", True, True) == "2.0.0"
    with pytest.raises(ValueError):
        T.bump("1.2", False, False)
    assert one(T.import_candidates(lit("use_a::b"))) == ["use_a::b", "a::b", "b"]


def test_index_rules():
    assert [incremental.index_params(n) for n in (999, 1000, 4_000_000, 1_048_575, 2_097_152)] == [None, 31, 3, 1023, 2]
    assert incremental.candidate_budget(10, 3) == 6 and incremental.candidate_budget(10, 3, 50, True) == 100 and incremental.rerank_headroom(3) == 2
    assert incremental.coherent("", "x") and incremental.coherent("x", "x") and not incremental.coherent("x", "y")


# sources and store
def test_walker(tmp_path):
    for p, c in {".gitignore": "*.log\n/build/\n!keep.log\n", "a.log": "", "keep.log": "", "build/x.py": "", "src/build/y.py": "", "src/.hid": "", "src/.gitignore": "z*\n", "src/zz.py": "", ".git/config": ""}.items():
        os.makedirs(os.path.dirname(tmp_path / p), exist_ok=True)
        (tmp_path / p).write_text(c)
    assert list(FS.walk(str(tmp_path))) == [".gitignore", "keep.log", "src/.gitignore", "src/.hid", "src/build/y.py"]
    assert ".gitignore" not in list(FS.walk(str(tmp_path), hidden=False))
    assert not FS.has_noindex(str(tmp_path)) and FS.watch_ignored("x/.git/y", FS.ignore_of(str(tmp_path))) and FS.watch_ignored("q/a.log", FS.ignore_of(str(tmp_path)))


def test_source_files_and_git(spark, tmp_path):
    root = str(tmp_path / "r")
    os.makedirs(root)
    run = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    for p, c in SOURCES.items():
        os.makedirs(os.path.dirname(f"{root}/{p}"), exist_ok=True)
        with open(f"{root}/{p}", "w") as f:
            f.write(c)
    run("add", "-A")
    run("commit", "-qm", "feat: first | part")
    with open(f"{root}/plain.txt", "a") as f:
        f.write("more\n")
    assert FS.all_changed(root) == ["plain.txt"] and FS.staged(root) == []
    run("commit", "-qam", "fix: second\n\nbody")
    rows = FS.commits(spark, root).collect()
    assert [r.message for r in rows] == ["feat: first | part", "fix: second\n\nbody"] and rows[1].files == ["plain.txt"]
    assert FS.commits(spark, root, since=rows[0].hash).count() == 1 and FS.changed_since(root, rows[0].hash) == ["plain.txt"]
    assert FS.default_branch(root) == "main" and FS.commits_ahead(root, rows[0].hash) == 1 and FS.resolve_ref(root, "nope") is None and "+more" in FS.commit_diff(root, rows[1].hash)
    found = FS.source_files(spark, root)
    assert {r.path: r.language for r in found.collect()} == {p: T.LANGUAGES.get(p.rsplit(".")[-1]) for p in SOURCES}
    assert FS.repo_stamp(found)[0] == len(SOURCES) and FS.fingerprint(found)


def test_store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/ix")
    rows = spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], "path string, mtime bigint, indexed_at bigint")
    assert s.count("file_metadata") == 0 and s.read("file_metadata").count() == 0
    s.append("file_metadata", rows)
    s.upsert_metadata(spark.createDataFrame([("a", 5, 2), ("c", 1, 2)], rows.schema))
    assert sorted(map(tuple, s.read("file_metadata").collect())) == [("a", 5, 2), ("b", 2, 1), ("c", 1, 2)]
    s.append("graph_edges", spark.createDataFrame([("a", "b", "calls"), ("b", "c", "calls"), ("c", "c", "calls")], "source string, target string, relation_type string").selectExpr("*", "'' AS description", "1.0D AS confidence", "1.0D AS weight", "'extracted' AS provenance"))
    s.cascade(spark.createDataFrame([("a",)], "path string"))
    assert s.count("file_metadata") == 2 and s.count("graph_edges") == 2
    assert s.set_marker("files", "abc", 1) and not s.set_marker("files", "abc", 2) and s.marker("files") == "abc"
    s.export(f"file://{tmp_path}/out")
    s.compact("graph_edges")
    s.drop("graph")
    assert s.count("graph_edges") == 0 and s.marker("files") == "abc"
    s.drop("all")
    s.load(f"file://{tmp_path}/out")
    assert s.count("graph_edges") == 2 and s.marker("files") == "abc"
    with pytest.raises(ValueError):
        s.load(f"file://{tmp_path}/ix")
    assert Store(spark, "/x", "a/b").root == "/x/branches/a--b/storage"


def test_store_writes_only_what_changes(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/ix", buckets=4)
    ddl = "path string, mtime bigint, indexed_at bigint"
    s.append("file_metadata", spark.createDataFrame([(f"f{i}", i, 1) for i in range(40)], ddl))
    first = s.manifest("file_metadata")["parts"]
    assert sorted(first) == ["0", "1", "2", "3"]
    before = s.read("file_metadata")
    s.upsert_metadata(spark.createDataFrame([("f7", 99, 2)], ddl))
    second = s.manifest("file_metadata")["parts"]
    assert sum(first[k] != second[k] for k in first) == 1
    assert before.count() == 40 and before.where("mtime = 99").count() == 0  # the state before still reads
    s.append("file_metadata", spark.createDataFrame([("new", 1, 3)], ddl))
    s.delete("file_metadata", spark.createDataFrame([("f8",)], "path string"), "path")
    s.delete("file_metadata", spark.createDataFrame([(99,), (3,)], "mtime long"), "mtime")  # found by a scan
    assert {r.path for r in s.read("file_metadata").collect()} == {f"f{i}" for i in range(40) if i not in (3, 7, 8)} | {"new"}
    # a part of a writer that died before its manifest isn't read, and goes
    s._written("file_metadata", s.read("file_metadata"), 4)
    assert s.count("file_metadata") == 38
    s.compact("file_metadata")
    assert s.count("file_metadata") == 38 and all(len(p) == 1 for p in s.manifest("file_metadata")["parts"].values())
    named = {p.split("/")[0] for ps in s.manifest("file_metadata")["parts"].values() for p in ps}
    assert named < {p.name for p in (tmp_path / "ix/storage/file_metadata").glob("part-*")}
    old = s.manifest("file_metadata") | {"version": 1}
    with pytest.raises(RuntimeError):
        s._commit("file_metadata", old, {})


def test_lock(tmp_path):
    p = str(tmp_path / "lock")
    with Lock(p):
        with pytest.raises(TimeoutError):
            Lock(p, wait=0.05, poll=0.01).__enter__()
    with open(p, "w") as f:
        f.write("999999999")
    with Lock(p, wait=1):
        assert os.path.exists(p)
    assert not os.path.exists(p)


# streaming
def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    os.makedirs(src)

    def put(name, rows):
        with open(src / f".{name}", "w") as f:
            f.writelines(json.dumps(dict(zip(("path", "ts", "action", "mtime"), r))) + "\n" for r in rows)
        os.rename(src / f".{name}", src / f"{name}.json")

    put("1", [("a", "2024-01-01T00:00:00", "write", 1), ("a", "2024-01-01T00:00:01", "write", 1), ("b", "2024-01-01T00:00:01", "write", 1), (".git/x", "2024-01-01T00:00:01", "write", 1)])
    put("2", [("a", "2024-01-01T00:00:09", "delete", 2), ("z", "2024-01-01T01:00:00", "write", 1)])
    seen = []
    q = feed.apply(feed.events(spark, str(src), 1), lambda up, gone, n: seen.append((sorted(r.path for r in up.collect()), sorted(r.path for r in gone.collect()))), str(tmp_path / "c1"), lambda p: F.contains(p, F.lit(".git/")), once=True)
    q.awaitTermination(60)
    assert sorted(seen) == [(["a", "b"], []), (["z"], ["a"])]
    q = feed.debounced(feed.events(spark, str(src), 1)).writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.path, r.n) for r in spark.table("bursts").collect())[1:] == [("a", 1), ("a", 2), ("b", 1)]
    q = feed.distinct_events(feed.events(spark, str(src), 1)).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("once").where("path = 'a'").count() == 2


# search
def test_search_end_to_end(spark, files):
    b = B.embedded(B.blocks(files)).cache()
    kinds = {(r.path, r.modality) for r in b.collect()}
    assert {("app/main.py", "code"), ("notes.md", "document"), ("plain.txt", "text")} <= kinds
    assert len({r.hash for r in b.collect()}) == b.count()
    hits = S.search(b, S.Request(["helper other", "def helper"], "all", 5)).orderBy("place").collect()
    assert hits[0].path == "app/util.py" and len(hits) <= 5
    only = S.search(b, S.Request(["words helper"], "document", 5)).collect()
    assert {r.modality for r in only} == {"document"}
    py = S.search(b, S.Request(["go run number"], "code", 5, language="python")).collect()
    assert py and all(r.language == "python" for r in py)
    over = spark.createDataFrame([("app/util.py",)], "path string")
    changed = B.embedded(B.blocks(files.where("path = 'app/util.py'").withColumn("content", F.lit("def helper(x):\n    return 'branch other'\n"))))
    merged = S.search(b, S.Request(["helper other"], "code", 5), branch=(changed, over)).collect()
    assert all("branch" in r.content for r in merged if r.path == "app/util.py") and any("branch" in r.content for r in merged)
    _, edges = build_graph.build(files)
    files_only = edges.where("relation_type = 'imports'")
    more = S.search(b, S.Request(["class Job run"], "code", 1), edges=files_only).collect()
    assert {"app/main.py", "app/util.py"} <= {r.path for r in more}
    ranked = S.search(b, S.Request(["helper other"], "code", 3), scorer=S.overlap_score).orderBy("place").collect()
    assert [r.distance for r in ranked] == sorted(r.distance for r in ranked)
    assert {r.path for r in S.expand_symbols(b.where("path = 'app/main.py'"), b).collect()} <= {"app/util.py", "app/main.py"}


@pytest.mark.parametrize("bad", [dict(queries=[]), dict(queries=["ab"]), dict(queries=["abc"] * 11), dict(queries=["abc"], mode="x"), dict(queries=["abc"], threshold=2), dict(queries=["abc"], max_results=0), dict(queries=["abc"], weights=(0, 0)), dict(queries=["abc"], weights=(2, 0))])
def test_requests_are_checked(bad):
    with pytest.raises(ValueError):
        S.Request(**bad)
