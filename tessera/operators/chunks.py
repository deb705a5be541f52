"""Chunkers: state runs from line to line, so they are generators applied to whole texts in Arrow batches.

Sizes are bytes. Text chunks have 1-based lines, Markdown sections 0-based ones.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera import config

FENCE = re.compile(r"\s*(`{3,}|~{3,})")
SHARES = {1: (2, 1), 2: (1, 1), 3: (3, 4), 4: (1, 2)}  # of the base size, by level; deeper: a third


def size(s: str) -> int:
    return len(s.encode("utf-8", "surrogatepass"))


def lines_of(text: str) -> list[str]:
    """Lines without their ends; a line end at the end of the text starts no line."""
    return [x.removesuffix("\r") for x in text.removesuffix("\n").split("\n")] if text else []


def text_chunks(text: str, limit: int = config.CHUNK_BYTES, overlap: int = config.OVERLAP_LINES) -> Iterator[tuple[str, int, int]]:
    """(content, first line, last line). A chunk takes lines while they fit, at least one with content and at most `limit` lines; blank lines in front vanish.

    The next chunk starts `overlap` lines before the end of this one where that lies ahead of its start.
    """
    rows = lines_of(text)
    start = 0
    while start < len(rows):
        ahead = rows[start : start + limit]
        blank = next((i for i, x in enumerate(ahead) if x), len(ahead))
        fits = blank + 1 + sum(1 for _ in _while(lambda total: total <= limit, accumulate((size(x) + 1 for x in ahead[blank + 1 :]), initial=size(ahead[blank]) if blank < len(ahead) else 0), skip=1))
        end = start + min(fits, len(ahead))
        if blank < len(ahead):
            yield "\n".join(rows[start + blank : end]), start + 1, end
        if end >= len(rows):
            return
        back = end - overlap if 0 < overlap < end else end
        start = back if back > start else end


def _while(test: Callable, xs: Iterator, skip: int) -> Iterator:
    for i, x in enumerate(xs):
        if i >= skip:
            if not test(x):
                return
            yield x


@dataclass
class Section:
    level: int
    content: str
    context: list[str]
    start: int
    end: int
    children: list[int] = field(default_factory=list)

    @property
    def title(self) -> str:
        return self.context[-1].lstrip("#").strip() if self.context else ""

    @property
    def open_fence(self) -> bool:
        return _fences(self.content.split("\n"))[-1]

    @property
    def only_fence(self) -> bool:
        rows = [x for x in self.content.split("\n") if x.strip()]
        return bool(rows) and all(FENCE.match(x) for x in rows)


def _fences(rows: list[str]) -> list[bool]:
    """Whether a fence is open behind each line; a run closes what it starts with."""
    out, mark = [], ""
    for x in rows:
        if m := FENCE.match(x):
            mark = m[1] if not mark else "" if x.lstrip().startswith(mark) else mark
        out.append(bool(mark))
    return out or [False]


def sections(text: str) -> list[Section]:
    """Header sections with content: headers of up to six # outside fences, what stands before the first one as level 1."""
    rows = lines_of(text)
    opened = _fences(rows)
    heads = [(i, len(t) - len(t.lstrip("#"))) for i, t in enumerate(x.lstrip() for x in rows) if t.startswith("#") and not opened[i]]
    heads = [(i, n) for i, n in heads if n <= 6]
    cuts = [i for i, _ in heads] + [len(rows)]
    out, stack = [], []
    if front := "\n".join(rows[: cuts[0]]).strip():
        out.append(Section(1, front, [], 0, max(cuts[0] - 1, 0)))
    for (i, n), stop in zip(heads, cuts[1:], strict=True):
        stack = [*stack[: n - 1], f"{'#' * n} {rows[i].lstrip().lstrip('#').strip()}"]
        if body := "\n".join(rows[i + 1 : stop]).strip():
            out.append(Section(n, body, stack, i, stop - 1))
    for i, s in enumerate(out):
        parent = next((j for j in range(i - 1, -1, -1) if out[j].level < s.level), None)
        if parent is not None:
            out[parent].children.append(i)
    return out


def target(level: int, base: int) -> int:
    a, b = SHARES.get(level, (1, 3))
    return base * a // b


class _Merger:
    """Sections to chunks from the deepest level up."""

    def __init__(self, text: str, base: int):
        self.all, self.base, self.done, self.out = sections(text), base, set(), []

    def tree(self, i: int) -> list[int]:
        return [i, *(k for c in self.all[i].children for k in self.tree(c))]

    def joined(self, ids: list[int], between: str = "\n\n", heads: bool = True) -> Section:
        first = self.all[ids[0]]
        parts = [first.content] + [(f"{self.all[i].context[-1]}\n" if heads and self.all[i].context else "") + self.all[i].content for i in ids[1:]]
        return replace(first, content=between.join(parts), level=min(self.all[i].level for i in ids), end=max(self.all[i].end for i in ids), children=[])

    def emit(self, ids: list[int], **how) -> None:
        self.out.append(self.joined(ids, **how))
        self.done.update(ids)

    def window(self, ids: list[int]) -> list[int]:
        """Up to four children in a row, counted from the front, that fill the base size best; each adds a tenth. The first child where one alone is best."""
        fits = {}
        for a in range(len(ids)):
            for b in range(a + 1, min(len(ids), a + 4) + 1):
                total = sum(size(self.all[i].content) for i in ids[a:b])
                if total <= self.base:
                    fits[a, b] = total / self.base + 0.1 * (b - a)
        a, b = max(fits, key=fits.get, default=(0, 1))
        return ids[a:b] if b - a > 1 else ids[:1]

    def run(self) -> list[Section]:
        for level in range(6, 0, -1):
            for i, s in enumerate(self.all):
                if s.level != level or i in self.done or s.only_fence:
                    continue
                sibling = next((j for j in range(i + 1, len(self.all)) if self.all[j].level <= level), None)
                if s.open_fence and sibling is not None and self.all[sibling].level == level and sibling not in self.done:
                    self.emit([i, sibling], between="\n", heads=False)
                elif size(s.content) <= target(level, self.base):
                    self.emit([i, *(k for k in self.tree(i)[1:] if k not in self.done)])
                else:
                    left = [k for k in s.children if k not in self.done]
                    while left:
                        best = self.window(left)
                        self.emit(best)
                        left = [k for k in left if k not in best]
                    self.emit([i])
        return self.out


def _behind(a: Section, b: Section) -> Section:
    return replace(a, content=f"{a.content}\n\n{b.context[-1] if b.context else b.title}\n{b.content}", level=min(a.level, b.level), end=b.end)


def _tiny(rows: list[Section], base: int) -> list[Section]:
    """Chunks below a quarter of the base take in the next one when it is at most five lines away; a last tiny one joins the one before."""
    out, todo, small = [], rows[::-1], base // 4
    while todo:
        a = todo.pop()
        if size(a.content) < small and todo and todo[-1].start - a.end <= 5:
            a = _behind(a, todo.pop())
        out.append(a)
    if len(out) > 1 and size(out[-1].content) < small:
        last = out.pop()
        out[-1] = replace(_behind(out[-1], last), level=out[-1].level)
    return out


def valid(content: str) -> bool:
    """Ten bytes, not just a fence, and a line that is neither blank nor a fence."""
    rows = [x.strip() for x in content.strip().split("\n")]
    fence = lambda x: x.startswith(("```", "~~~"))
    return size(content) >= 10 and not (fence(rows[0]) and len(rows) <= 2) and any(x and not fence(x) for x in rows)


def _repaired(rows: list[Section]) -> list[Section]:
    out, todo = [], rows[::-1]
    while todo:
        a = todo.pop()
        if not valid(a.content) and todo and valid(both := f"{a.content}\n{todo[-1].content}"):
            a = replace(a, content=both, end=todo.pop().end)
        out += [a] if valid(a.content) else []
    return out


def markdown_chunks(text: str, base: int = config.MARKDOWN_BASE) -> list[Section]:
    return _repaired(_tiny(_Merger(text, base).run(), base))


def diff_files(diff: str) -> list[str]:
    """One text a file; a file above the limit in pieces that repeat its header."""
    out: list[str] = []
    for part in re.split(r"(?m)^(?=diff --git)", "".join(x + "\n" for x in lines_of(diff))):
        if size(part) <= config.DIFF_BYTES:
            out += [part] if part else []
            continue
        cut = part.find("\n@@") + 1
        head, budget = part[:cut], max(config.DIFF_BYTES - size(part[:cut]), 256)
        body = ""
        for row in (piece for x in lines_of(part[cut:]) for piece in _pieces(x, budget - 1)):
            if body and size(head) + size(body) + size(row) + 1 > config.DIFF_BYTES:
                out.append(head + body)
                body = ""
            body += row + "\n"
        out += [head + body] if body else []
    return out


def _pieces(line: str, limit: int) -> Iterator[str]:
    """A line in parts of at most `limit` bytes, cut between characters."""
    while size(line) > limit:
        part = truncate(line, limit)
        yield part
        line = line[len(part) :]
    yield line


def truncate(s: str, limit: int) -> str:
    """At most `limit` bytes, cut between characters."""
    return s.encode("utf-8", "surrogatepass")[:limit].decode("utf-8", "ignore") if size(s) > limit else s


def diff_name(part: str) -> str | None:
    """The `+++ b/` path, else the second path of the `diff --git` line."""
    if m := re.search(r"(?m)^\+\+\+ b/(.*)$", part):
        return m[1]
    m = re.search(r"(?m)^diff --git \S+ (?:b/)?(\S+)", part)
    return m[1] if m else None


def diff_summary(names: list[str]) -> str:
    return "no files" if not names else names[0] if len(names) == 1 else ", ".join(names) if len(names) <= 3 else f"{len(names)} files"


def diff_chunks(diff: str) -> list[tuple[str, str]]:
    """(content, file names). Files are packed while they fit; a new chunk starts with the last whole lines of the one before."""
    if size(diff) <= config.DIFF_BYTES:
        return [(diff, diff_summary([n for p in re.split(r"(?m)^(?=diff --git)", diff) if (n := diff_name(p))]))]
    out: list[tuple[str, list[str]]] = []
    for part in diff_files(diff):
        if not out or size(out[-1][0]) + size(part) > config.DIFF_BYTES:
            tail = out[-1][0].encode("utf-8", "surrogatepass")[-config.DIFF_OVERLAP :].decode("utf-8", "ignore") if out else ""
            out.append((tail.split("\n", 1)[-1] if "\n" in tail else tail, []))
        text, names = out[-1]
        out[-1] = (text + part + "\n", names + ([n] if (n := diff_name(part)) else []))
    return [(text, ", ".join(names)) for text, names in out[: config.DIFF_CHUNKS]]


def smart_truncate(text: str, limit: int) -> str:
    """0: whole. One line: its first and last third of the limit; several: lines from both ends, half of (limit - 50) each."""
    if limit == 0 or len(text) <= limit:
        return text
    rows = text.split("\n")
    if len(rows) == 1:
        third = limit // 3
        return f"{text[:third]} [... {len(text) - 2 * third} more chars] {text[len(text) - third :]}"
    half = max(limit - 50, 0) // 2
    take = lambda xs: sum(1 for _ in _while(lambda t: t <= half, accumulate(len(x) + 1 for x in xs), skip=0))
    a, b = take(rows), take(rows[::-1])
    b = min(b, len(rows) - a)
    return "\n".join([*rows[:a], f"[... {len(rows) - a - b} more lines]", *rows[len(rows) - b :]])


def symbol_body(text: str, line: int, limit: int = 50) -> str:
    """From a definition line to where its braces close, at most `limit` lines."""
    rows, depth, seen = text.split("\n")[line : line + limit], 0, False
    for i, x in enumerate(rows):
        depth += x.count("{") - x.count("}")
        seen = seen or "{" in x
        if seen and depth <= 0:
            return "\n".join(rows[: i + 1])
    return "\n".join(rows)


def merge_lines(regions: list[tuple[int, int, str]], gap: int = 3, theme_gap: int = 10, most: int = 15, theme: Callable[[str], str] = lambda s: s.split("(")[0].split(" ")[0]) -> list[list[tuple[int, int, str]]]:
    """One-line regions (start, end, text) in a row, near each other or of one theme, in groups of at most `most`."""

    def step(groups: list, r: tuple[int, int, str]) -> list:
        last = groups[-1][-1] if groups else None
        near = last and last[0] == last[1] and r[0] == r[1] and r[0] - last[1] <= (theme_gap if theme(last[2]) == theme(r[2]) else gap)
        if near and len(groups[-1]) < most:
            groups[-1].append(r)
        else:
            groups.append([r])
        return groups

    return reduce(step, sorted(regions), [])


def chunk_table(df: DataFrame, key: str, text: str, chunker: Callable, *args) -> DataFrame:
    """key, chunk, start_line, end_line, content, hash of every text; hash: SHA-256 of content, `key#chunk`."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, t in zip(b.column(0), b.column(1), strict=True):
                rows = [(i, a, z, c, hashlib.sha256(f"{c}{k.as_py()}#{i}".encode("utf-8", "surrogatepass")).hexdigest()) for i, (c, a, z) in enumerate(chunker(t.as_py() or "", *args))]
                if rows:
                    cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(rows), b.column(0).type), *cols], [key, "chunk", "start_line", "end_line", "content", "hash"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, chunk int, start_line int, end_line int, content string, hash string")


def markdown_table(df: DataFrame, key: str, text: str, base: int = config.MARKDOWN_BASE) -> DataFrame:
    """key, title, level, context, start_line, end_line, content of the chunks of every Markdown text."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, t in zip(b.column(0), b.column(1), strict=True):
                rows = [(s.title, s.level, s.context, s.start, s.end, s.content) for s in markdown_chunks(t.as_py() or "", base)]
                if rows:
                    types = (pa.string(), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.string())
                    cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(rows), b.column(0).type), *cols], [key, "title", "level", "context", "start_line", "end_line", "content"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, title string, level int, context array<string>, start_line int, end_line int, content string")
