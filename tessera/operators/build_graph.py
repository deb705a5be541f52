"""Files to graph: nodes for files and symbols, edges by containment, imports, calls and type relations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.rows import top
from tessera.functions.text import relative_to
from tessera.languages import extract
from tessera.operators import graph, resolve

FACTS = "path string, language string, fact string, line int, name string, a string, b string, end_line int"


def facts(files: DataFrame) -> DataFrame:
    """One row a fact of each file(path, content, language): symbol (name, a: kind, b: owner), import (name), binding (name: local, a: imported, b: module), call (name, a: qualifier), extends and implements (name: target, a: source), export (name)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(),) * 3 + (pa.int32(),) + (pa.string(),) * 3 + (pa.int32(),)
        for b in batches:
            rows = []
            for p, t, lang in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = extract(lang or "", t or "")
                rows += [(p, lang, "symbol", s.start, s.name, s.kind, s.owner, s.end) for s in x.symbols]
                rows += [(p, lang, "import", None, i, None, None, None) for i in x.imports] + [(p, lang, "export", None, e, None, None, None) for e in x.exports]
                rows += [(p, lang, "binding", None, local, name, module, None) for local, name, module in x.bindings]
                rows += [(p, lang, "call", line, name, q, None, None) for line, name, q in x.calls]
                rows += [(p, lang, kind, line, target, source, None, None) for line, source, kind, target in x.relations]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in FACTS.split(", ")])

    return files.select("path", "content", "language").mapInArrow(run, FACTS)


def import_paths(path: Column, lang: Column, text: Column) -> Column:
    """Paths that an import may mean, best first, by language family."""
    here = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)
    dots = F.length(F.regexp_extract(text, r"^(\.*)", 1))
    module = F.regexp_replace(F.regexp_replace(text, r"^\.+", ""), r"\.", "/")
    up = F.concat(here, F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))), module)
    python = F.when(dots > 0, F.array(F.concat(up, F.lit(".py")), F.concat(up, F.lit("/__init__.py")))).otherwise(F.array(F.concat(module, F.lit(".py")), F.concat(module, F.lit("/__init__.py")), F.concat(here, module, F.lit(".py"))))
    use = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\s+as\s+\w+$|::\{[^}]*\}|::\*$", ""), r"^(crate|super|self)::", ""), "::", "/")
    rust = F.flatten(F.transform(F.array(use, F.regexp_replace(use, r"/[^/]+$", "")), lambda u: F.array(F.concat(F.lit("src/"), u, F.lit(".rs")), F.concat(F.lit("src/"), u, F.lit("/mod.rs")), F.concat(here, u, F.lit(".rs")))))
    base = F.when(text.startswith("/"), F.substring(text, 2, 1 << 20)).when(text.startswith("."), F.concat(here, text)).otherwise(text)
    script = F.transform(F.array(*[F.lit(x) for x in ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".svelte", "/index.ts", "/index.js", "/index.tsx")]), lambda e: F.concat(base, e))
    include = F.regexp_replace(text, r"""^[<"]|[>"]$""", "")
    cpp = F.when(text.startswith('"'), F.array(F.concat(here, include), include)).otherwise(F.array(include))
    cpp = F.concat(cpp, F.transform(F.array(*[F.lit(d) for d in ("include/", "inc/", "headers/", "lib/")]), lambda d: F.concat(d, include)))
    dotted = F.regexp_replace(text, r"[.\\]", "/")
    lua = F.array(F.concat(here, dotted, F.lit(".lua")), F.concat(here, dotted, F.lit("/init.lua")), F.concat(here, text, F.lit(".lua")))
    java = F.array(F.concat(dotted, F.lit(".java")), F.concat(F.lit("src/main/java/"), dotted, F.lit(".java")))
    php = F.array(F.concat(dotted, F.lit(".php")), F.concat(F.lit("src/"), dotted, F.lit(".php")), F.concat(here, F.element_at(F.split(dotted, "/"), -1), F.lit(".php")), F.concat(here, text))
    ruby = F.array(F.concat(here, text, F.lit(".rb")), F.concat(F.lit("lib/"), text, F.lit(".rb")), F.concat(text, F.lit(".rb")))
    css = F.array(F.concat(here, text), F.concat(here, text, F.lit(".scss")), F.concat(here, text, F.lit(".css")), text)
    plain = F.array(F.concat(here, text), text)
    out = F.when(lang == "python", python).when(lang == "rust", rust).when(lang.isin("javascript", "typescript", "svelte"), script).when(lang == "cpp", cpp).when(lang == "lua", lua)
    return out.when(lang == "java", java).when(lang == "php", php).when(lang == "ruby", ruby).when(lang == "css", css).otherwise(plain)


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """path, name, target: the first candidate path that exists, for imports(path, language, name)."""
    tried = imports.select("path", "name", F.posexplode(import_paths(F.col("path"), F.col("language"), F.col("name"))).alias("order", "candidate"))
    tried = tried.withColumn("target", relative_to(F.lit(""), F.col("candidate")))
    return top(tried.join(files.select(F.col("path").alias("target")), "target"), ["path", "name"], [F.col("order")], 1).select("path", "name", "target")


def _edges(df: DataFrame, kind: str | Column, weight: float, confidence: Column | float = 1.0, provenance: Column | str = "extracted") -> DataFrame:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select("source", "target", as_col(kind).alias("relation_type"), F.lit("").alias("description"), as_col(confidence).alias("confidence"), F.lit(weight).alias("weight"), as_col(provenance).alias("provenance"))


def build(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, name, kind, path, start_line, end_line, language; edges) of files(path, content, language)."""
    found = facts(files).persist()
    symbols = graph.symbol_ids(found.where("fact = 'symbol'").select("path", F.col("b").alias("owner"), "name", F.col("line").alias("start_line"), "end_line", F.col("a").alias("kind"), "language")).persist()
    nodes = symbols.select("id", "name", "kind", "path", "start_line", "end_line", "language")
    nodes = nodes.unionByName(files.select(F.col("path").alias("id"), F.element_at(F.split("path", "/"), -1).alias("name"), F.lit("file").alias("kind"), "path", F.lit(0).alias("start_line"), F.size(F.split("content", "\n")).alias("end_line"), "language"))
    linked = resolve_imports(found.where("fact = 'import'").select("path", "language", "name").distinct(), files).persist()
    edges = [graph.contains_edges(symbols), _edges(linked.where("path <> target").select(F.col("path").alias("source"), "target"), "imports", 0.7)]
    imported = linked.select("path", F.col("target").alias("imported")).distinct().persist()
    decls = symbols.select("id", "path", "owner", "name")
    ranges = symbols.select("path", F.col("id").alias("range_id"), F.col("start_line").alias("start"), F.col("end_line").alias("end"))
    owners = symbols.select(F.col("id").alias("range_id"), F.when(F.col("kind").isin("class", "struct", "interface", "trait", "enum", "impl"), F.col("name")).otherwise(F.col("owner")).alias("owner"))
    bindings = found.where("fact = 'binding'").select("path", F.col("name").alias("local"), F.col("a").alias("real"), F.col("b").alias("module"))
    bindings = bindings.join(linked.select("path", F.col("name").alias("module"), F.col("target").alias("bound")), ["path", "module"]).select("path", "local", "real", "bound").persist()
    for facts_, weight in ((["call"], 0.8), (["extends", "implements"], 1.0)):
        rows = found.where(F.col("fact").isin(facts_)).select("path", "line", "name", F.col("a").alias("qualifier"), "fact").distinct().withColumn("use_id", F.xxhash64("path", "line", "name", "qualifier", "fact"))
        inside = resolve.smallest_enclosing(rows.select("path", F.col("use_id").alias("point_id"), F.col("line").alias("at")), ranges, "path", 64)
        rows = rows.join(inside.withColumnRenamed("point_id", "use_id"), "use_id", "left").join(owners, "range_id", "left").persist()
        if facts_ == ["call"]:
            to = resolve.calls(rows, decls, linked.select("path", F.col("name").alias("raw"), F.col("target").alias("imported")), bindings)
        else:  # a bound name is looked up by what it stands for
            real = bindings.where("real IS NOT NULL").select("path", F.col("local").alias("name"), "real").dropDuplicates(["path", "name"])
            to = resolve.scoped(rows.join(real, ["path", "name"], "left").select("use_id", "path", F.coalesce("real", "name").alias("name")), decls, imported, ambiguous=True)
        own = to.join(rows.select("use_id", "fact", F.coalesce("range_id", "path").alias("source")), "use_id")
        edges.append(_edges(own, F.when(F.col("fact") == "call", "calls").otherwise(F.col("fact")), weight, F.when(F.col("source") == F.col("target"), 1.0).otherwise(F.col("confidence")), F.col("provenance")))
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return nodes, graph.edge_dedup(out)


def layout_edges(files: DataFrame) -> DataFrame:
    """Edges by file layout: package and module heads to the files below their folder, Go and PHP files to those beside them."""
    f = files.select("path", "language", F.regexp_extract("path", r"^(?:(.*)/)?[^/]*$", 1).alias("dir"), F.regexp_extract("path", r"([^/.]+)[^/]*$", 1).alias("stem"))
    below = f.select(F.col("path").alias("target"), "language", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("dir", "/"))), lambda k: F.array_join(F.slice(F.split("dir", "/"), 1, k), "/"))).alias("dir"))
    heads = f.where("(language = 'rust' AND stem IN ('mod', 'lib', 'main')) OR (language IN ('javascript', 'typescript') AND stem = 'index') OR (language = 'python' AND stem = '__init__')")
    down = heads.select(F.col("path").alias("source"), "language", "dir", "stem").join(below, ["language", "dir"]).where("source <> target")
    strong = F.col("stem").isin("mod", "__init__")
    first = _edges(down.where("stem <> '__init__'"), "parent_module", 0.7, F.when(strong, 0.8).otherwise(0.7)).unionByName(_edges(down.where("stem = '__init__'"), "parent_module", 0.7, 0.8))
    beside = f.where("language IN ('go', 'php')").withColumn("key", F.when(F.col("language") == "go", F.element_at(F.split("dir", "/"), -1)).otherwise(F.col("dir")))
    # files of a folder belong to one node, so a folder of n files has n edges, not n * n; siblings() has the pairs of given files
    folder = beside.select(F.col("path").alias("source"), F.concat(F.lit("folder:"), "language", F.lit(":"), "key").alias("target"))
    return first.unionByName(_edges(folder, "sibling_module", 0.7, 0.8))


def siblings(members: DataFrame, files: DataFrame) -> DataFrame:
    """source, target: the files beside each of files(path), by the folders of layout_edges()."""
    own = members.where("relation_type = 'sibling_module'").select("source", F.col("target").alias("folder"))
    asked = own.join(files.select(F.col("path").alias("source")), "source", "left_semi")
    return asked.join(own.withColumnRenamed("source", "target"), "folder").where("source <> target").select("source", "target")
