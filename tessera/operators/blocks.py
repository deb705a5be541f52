"""Files to blocks: code regions, text chunks and Markdown chunks with hashes and embeddings."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import config
from tessera.functions.rows import computed, tokens
from tessera.functions.text import is_text_name
from tessera.functions.vector import hashed_bag
from tessera.languages import EXTRACTORS, extract
from tessera.operators.chunks import lines_of, markdown_chunks, merge_lines, text_chunks

BLOCK = "path string, modality string, language string, title string, content string, context array<string>, symbols array<string>, level int, start_line int, end_line int, hash string"
#: Containers whose members are blocks of their own.
CONTAINERS = frozenset("class impl module interface trait protocol extension".split())


def _hash(*parts: object) -> str:
    return hashlib.sha256("".join(map(str, parts)).encode("utf-8", "surrogatepass")).hexdigest()


def code_regions(path: str, lang: str, text: str) -> Iterator[tuple[str, list[str], int, int]]:
    """(content, symbols, first line, last line), 0-based. A declaration takes the comments and attributes above it; one-line ones near each other are merged."""
    rows = lines_of(text)
    own = sorted((s.start, s.end, s.name, s.kind) for s in extract(lang, text).symbols)
    spans, last = [], -1
    for a, b, name, kind in own:
        inner = any(x > a and y <= b for x, y, *_ in own)
        if a <= last or kind in CONTAINERS and inner:
            continue
        top_line = a
        while top_line - 1 > last and rows[top_line - 1].lstrip().startswith(("//", "#", "/*", "*", "@", "--", "#[")):
            top_line -= 1
        spans.append((top_line, min(b, len(rows) - 1), name or f"{kind}_{a}"))
        last = b
    names = {(a, b): n for a, b, n in spans}
    for group in merge_lines([(a, b, rows[a].strip()) for a, b, _ in spans]):
        a, b = group[0][0], group[-1][1]
        yield "\n".join(rows[a : b + 1]), [names[x, y] for x, y, _ in group], a, b


def blocks(files: DataFrame) -> DataFrame:
    """Blocks of files(path, content, language): Markdown by section, code by region, other allowed text by size."""
    rows = files.where(F.col("language").isNotNull() | is_text_name(F.col("path"))).select("path", "content", "language")
    known = frozenset([*EXTRACTORS, "python"]) | {"rust", "go", "java", "cpp", "php", "ruby", "lua", "bash", "swift", "javascript", "typescript", "svelte", "css", "json"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in BLOCK.split(", ")]
        types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.int32(), pa.string())
        for b in batches:
            out = []
            for path, text, lang in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text = text or ""
                if lang == "markdown":
                    out += [(path, "document", lang, s.title, s.content, s.context, None, s.level, s.start, s.end, _hash(s.content, path, s.start, s.end)) for s in markdown_chunks(text)]
                elif lang in known:
                    out += [(path, "code", lang, None, c, None, names_, None, a, z, _hash(c, path, a, z)) for c, names_, a, z in code_regions(path, lang, text)]
                else:
                    out += [(path, "text", lang, None, c, None, None, None, a, z, _hash(c, f"{path}#{i}")) for i, (c, a, z) in enumerate(text_chunks(text))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return rows.mapInArrow(run, BLOCK)


def embedded(df: DataFrame, text: Column | str = "content", embed=hashed_bag) -> DataFrame:
    """df with an embedding. embed: from a tokens column; any expression or pandas UDF can stand in."""
    return computed(df, words=tokens(F.col(text) if isinstance(text, str) else text)).withColumn("embedding", embed(F.col("words"))).drop("words")
