"""Structural search over source texts.

A pattern is code with metavariables: `$NAME` stands for one expression, `$_` for one that isn't bound, `$$$` or
`$$$NAME` for any number of them. Texts and patterns are cut into tokens (strings whole, comments left out), and a
metavariable takes balanced tokens, as few as possible; one name stands for one text. Lines are 1-based, columns
are 0-based bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.rows import top
from tessera.functions.text import has_all, name_matches, prefilter_tokens
from tessera.languages import extract
from tessera.languages.generic import GRAMMARS

TOKEN = re.compile(r"""\$\$\$\w*|\$\w+|[A-Za-z_]\w*|\d[\w.]*|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|::|->|=>|==|!=|<=|>=|&&|\|\||\?\.|[^\s\w]""")
OPEN, CLOSE = "([{", ")]}"
FILE_CAP, TOTAL_CAP, LEXICAL_FILE_CAP, LEXICAL_CAP = 500, 10_000, 20, 200

#: What a searcher may call a kind, and the kinds of declarations that it means.
KIND_WORDS = {
    "function": ["function", "method"], "func": ["function", "method"], "fn": ["function", "method"], "def": ["function", "method"], "method": ["method"], "class": ["class"], "struct": ["struct", "class"],
    "interface": ["interface", "trait", "protocol"], "trait": ["trait", "interface", "protocol"], "protocol": ["protocol", "interface", "trait"], "enum": ["enum"], "type": ["type"], "module": ["module"], "mod": ["module"], "macro": ["macro"], "const": ["constant"],
}


@dataclass(frozen=True)
class Token:
    text: str
    start: int
    end: int


def _comment(lang: str) -> str:
    grammar = next((g for names, g in GRAMMARS.items() if lang in names.split()), None)
    return "#" if lang in ("python", "bash", "ruby") else grammar.line_comment or "" if grammar else "//"


def tokenise(text: str, lang: str) -> list[Token]:
    mark = _comment(lang)
    skip = "|".join(([r"/\*.*?\*/"] if mark == "//" else []) + ([re.escape(mark) + r"[^\n]*"] if mark else []) + [r"(?!)"])
    return [Token(m[0], m.start(), m.end()) for m in re.finditer(f"(?s:(?P<skip>{skip}))|(?:{TOKEN.pattern})", text) if m["skip"] is None]


def _units(tokens: list[Token], i: int, many: bool) -> Iterator[int]:
    """Ends of balanced stretches from i, shortest first. One expression has no separator outside brackets."""
    depth = 0
    for k in range(i, len(tokens)):
        t = tokens[k].text
        depth += (t in OPEN) - (t in CLOSE)
        if depth < 0 or depth == 0 and t == ";" or not many and depth == 0 and t in ",{}":
            return
        if depth == 0:
            yield k + 1


def _match(pattern: list[Token], p: int, tokens: list[Token], i: int, text: str, bound: dict[str, str]) -> tuple[int, dict[str, str]] | None:
    """End and bindings of the first way to match, by depth-first search."""
    if p == len(pattern):
        return i, bound
    t = pattern[p].text
    if not t.startswith("$"):
        return _match(pattern, p + 1, tokens, i + 1, text, bound) if i < len(tokens) and tokens[i].text == t else None
    many, name = t.startswith("$$$"), t.lstrip("$")
    ends = ([i] if many else []) + list(_units(tokens, i, many))
    if p + 1 == len(pattern):
        ends = ends[-1:] if many or ends else ends  # nothing follows: as much as there is
    for end in ends:
        got = text[tokens[i].start : tokens[end - 1].end] if end > i else ""
        if name and name != "_" and bound.get(name, got) != got:
            continue
        if found := _match(pattern, p + 1, tokens, end, text, bound | ({name: got} if name and name != "_" else {})):
            return found
    return None


def find(pattern: str, text: str, lang: str, constraints: dict[str, str] | None = None, tokens: list[Token] | None = None) -> Iterator[tuple[int, int, dict[str, str]]]:
    """(start, end, bindings) of matches that don't overlap; every constrained metavariable must be bound and match its expression."""
    pat = tokenise(pattern, lang)
    tokens = tokenise(text, lang) if tokens is None else tokens
    if not pat:
        return
    first = None if pat[0].text.startswith("$") else pat[0].text
    at = 0
    while at < len(tokens):
        found = _match(pat, 0, tokens, at, text, {}) if first is None or tokens[at].text == first else None
        if not found or found[0] == at:
            at += 1
            continue
        if all(k in found[1] and re.search(r, found[1][k]) for k, r in (constraints or {}).items()):
            yield tokens[at].start, tokens[found[0] - 1].end, found[1]
        at = found[0]


def rewrite(pattern: str, template: str, text: str, lang: str, constraints: dict[str, str] | None = None) -> tuple[str, int]:
    """Text with every match replaced, and how many; edits go from the last to the first."""
    found = list(find(pattern, text, lang, constraints))
    for a, b, bound in reversed(found):
        text = text[:a] + re.sub(r"\$\$\$\w*|\$\w+", lambda m: bound.get(m[0].lstrip("$"), m[0]), template) + text[b:]
    return text, len(found)


def breadcrumb(text: str, lang: str) -> list[tuple[int, int, str]]:
    """(first line, last line, name) of named declarations, outermost first."""
    return sorted(((s.start, s.end, s.name) for s in extract(lang, text).symbols), key=lambda x: (x[0], -x[1]))


def diagnose(pattern: str, lang: str) -> dict:
    """Metavariables, literal tokens and what is wrong with a pattern."""
    pat = tokenise(pattern, lang)
    depth = sum((t.text in OPEN) - (t.text in CLOSE) for t in pat)
    return {"metavariables": sorted({t.text for t in pat if t.text.startswith("$")}), "literals": prefilter_tokens(pattern), "error": "empty" if not pat else "unbalanced" if depth else None}


MATCH = "path string, line int, column int, text string, start_byte int, end_byte int, breadcrumb string"
MATCH_TYPES = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string())


def _row(path: str, text: str, a: int, b: int, crumbs: list[tuple[int, int, str]]) -> tuple:
    line, head = text.count("\n", 0, a), text.rfind("\n", 0, a) + 1
    around = [n for x, y, n in crumbs if x <= line <= y]
    size = lambda s: len(s.encode("utf-8", "surrogatepass"))
    start = size(text[:a])
    return path, line + 1, size(text[head:a]), text[a:b], start, start + size(text[a:b]), " › ".join(around) or None


def _scan(files: DataFrame, one, ddl: str = MATCH, types: tuple = MATCH_TYPES) -> DataFrame:
    """files(path, content, language) through one(path, text, language) -> match rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in ddl.split(", ")]
        for b in batches:
            rows = [r for p, t, lang in zip(*(c.to_pylist() for c in b.columns), strict=True) for r in one(p, t or "", lang or "")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return files.select("path", "content", "language").mapInArrow(run, ddl)


def search(files: DataFrame, pattern: str, constraints: dict[str, str] | None = None) -> DataFrame:
    """Matches of a pattern; the literal tokens of the pattern are tested before a text is cut into tokens."""

    def one(path: str, text: str, lang: str) -> Iterator[tuple]:
        crumbs = None
        for a, b, _ in find(pattern, text, lang, constraints):
            crumbs = breadcrumb(text, lang) if crumbs is None else crumbs
            yield _row(path, text, a, b, crumbs)

    return _scan(files.where(has_all(F.col("content"), prefilter_tokens(pattern))), one)


def search_many(files: DataFrame, patterns: dict[str, str], constraints: dict[str, str] | None = None) -> DataFrame:
    """label and match rows of several patterns {label: pattern}: each text is read and cut into tokens once."""
    labels = F.create_map(*[F.lit(x) for n, label in enumerate(patterns) for x in (n, label)])

    def one(path: str, text: str, lang: str) -> Iterator[tuple]:
        tokens, crumbs = None, None
        for n, pattern in enumerate(patterns.values()):
            if not all(t in text for t in prefilter_tokens(pattern)):
                continue
            tokens = tokenise(text, lang) if tokens is None else tokens
            for a, b, _ in find(pattern, text, lang, constraints, tokens):
                crumbs = breadcrumb(text, lang) if crumbs is None else crumbs
                yield (n, *_row(path, text, a, b, crumbs))

    return _scan(files, one, f"label int, {MATCH}", (pa.int32(), *MATCH_TYPES)).withColumn("label", F.element_at(labels, F.col("label")))


def search_within(files: DataFrame, scaffold: str, selected: str) -> DataFrame:
    """Matches of a metavariable inside a scaffold: rows of what `$selected` stands for where the whole scaffold matches."""

    def one(path: str, text: str, lang: str) -> Iterator[tuple]:
        crumbs = None
        for a, b, bound in find(scaffold, text, lang):
            if (part := bound.get(selected)) and (at := text.find(part, a, b)) >= 0:
                crumbs = breadcrumb(text, lang) if crumbs is None else crumbs
                yield _row(path, text, at, at + len(part), crumbs)

    return _scan(files.where(has_all(F.col("content"), prefilter_tokens(scaffold))), one)


def rewritten(files: DataFrame, pattern: str, template: str, constraints: dict[str, str] | None = None) -> DataFrame:
    """path, content, n of the files that a rewrite changes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, *rewrite(pattern, template, t or "", lang or "", constraints)) for p, t, lang in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            rows = [r for r in rows if r[2]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int32()), strict=True)], ["path", "content", "n"])

    return files.where(has_all(F.col("content"), prefilter_tokens(pattern))).select("path", "content", "language").mapInArrow(run, "path string, content string, n int")


#: By language, how a pattern begins and the declarations that it means.
ITEM_WORDS = {
    "rust": {"struct": "struct", "enum": "enum", "trait": "trait", "impl": "impl", "fn": "function", "use": "import", "mod": "module", "type": "type"},
    "javascript": {"class": "class", "function": "function", "interface": "interface", "import": "import"},
    "typescript": {"class": "class", "function": "function", "interface": "interface", "import": "import"},
    "python": {"def": "function", "class": "class", "from": "import", "import": "import"},
    "go": {"func": "function", "type": "type", "import": "import"},
}
#: Words that may stand in front of them.
BEFORE_ITEM = {"rust": ("pub", "async", "const", "unsafe"), "javascript": ("export", "async"), "typescript": ("export", "async"), "python": ("async",), "go": ()}


def item_kind(pattern: str, lang: str) -> str | None:
    """What kind of item a pattern starts with; the keyword must be followed by white space."""
    rest = pattern.lstrip()
    while m := re.match(r"(\w+)\s+", rest):
        if kind := ITEM_WORDS.get(lang, {}).get(m[1]):
            return kind
        if m[1] not in BEFORE_ITEM.get(lang, ()):
            return None
        rest = rest[m.end() :]
    return None


def contexts(pattern: str, lang: str) -> list[tuple[str, str]]:
    """(selected kind, scaffold) in which a pattern can be read that doesn't stand alone."""
    if lang == "rust":
        typed = "<" in pattern and ">" in pattern and not any(x in pattern for x in ("{", ";", "fn "))
        return [("generic_type", f"type _ = {pattern};")] if typed else []
    frames = {"go": [("call_expression", "package _\nfunc _() {{ {} }}")], "json": [("pair", "{{ {} }}")]}
    frames |= dict.fromkeys(("javascript", "typescript"), [("field_definition", "class _ {{ {} }}"), ("method_definition", "class _ {{ {} }}")])
    return [(kind, frame.format(pattern)) for kind, frame in frames.get(lang, [])]


def declarations(files: DataFrame, kinds: list[str] | None = None, name: str = "*") -> DataFrame:
    """path, name, kind, owner, start_line, end_line (1-based) of declarations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, s.name, s.kind, s.owner, s.start + 1, s.end + 1) for p, t, lang in zip(*(c.to_pylist() for c in b.columns), strict=True) for s in extract(lang or "", t or "").symbols]
            if rows:
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(),) * 4 + (pa.int32(),) * 2, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, ["path", "name", "kind", "owner", "start_line", "end_line"])

    cheap = files if "*" in name else files.where(F.contains("content", F.lit(name)))
    out = cheap.select("path", "content", "language").mapInArrow(run, "path string, name string, kind string, owner string, start_line int, end_line int").where(name_matches(F.col("name"), name))
    return out.where(F.col("kind").isin(kinds)) if kinds else out


def references(files: DataFrame, name: str) -> DataFrame:
    """Matches of an identifier; text is the trimmed line, with [def] where it is declared."""

    def one(path: str, text: str, lang: str) -> Iterator[tuple]:
        own = {(s.start, s.name) for s in extract(lang, text).symbols}
        crumbs, rows = breadcrumb(text, lang), text.split("\n")
        for t in tokenise(text, lang):
            if t.text == name:
                r = _row(path, text, t.start, t.end, crumbs)
                yield (*r[:3], rows[r[1] - 1].strip() + (" [def]" if (r[1] - 1, name) in own else ""), *r[4:])

    return _scan(files.where(F.contains("content", F.lit(name))), one)


def lexical(files: DataFrame, token: str) -> DataFrame:
    """Lines that hold the token; column: bytes before its first place. No Python."""
    lines = files.where(F.contains("content", F.lit(token))).select("path", F.posexplode(F.split("content", "\n")).alias("n", "row")).where(F.contains("row", F.lit(token)))
    out = lines.select("path", (F.col("n") + 1).alias("line"), F.octet_length(F.substring_index("row", token, 1)).alias("column"), F.col("row").alias("text"))
    return capped(out, LEXICAL_FILE_CAP, LEXICAL_CAP)


def capped(matches: DataFrame, per_file: int = FILE_CAP, total: int = TOTAL_CAP) -> DataFrame:
    return top(matches, ["path"], [F.col("line"), F.col("column")], per_file).orderBy("path", "line", "column").limit(total)


def page(matches: DataFrame, offset: int, size: int, boost: list[str] = ()) -> DataFrame:
    """One page in order of path, line, column, files whose path has one of `boost` first; with totals of matches and files."""
    liked = F.greatest(*[F.contains(F.lower("path"), F.lit(b.lower())) for b in boost], F.lit(False), F.lit(False))
    totals = matches.agg(F.count("*").alias("matches"), F.countDistinct("path").alias("files"))
    return matches.orderBy(liked.desc(), "path", "line", "column").offset(offset).limit(size).join(F.broadcast(totals))  # one row


def smart(files: DataFrame, pattern: str, constraints: dict[str, str] | None = None) -> tuple[str, DataFrame]:
    """The first way with a result: the pattern, declarations by its keyword, its words as a kind, its longest literal."""
    ways = [("pattern", lambda: search(files, pattern, constraints))]
    words = re.findall(r"[A-Za-z_]+", re.sub(r"\$+\w*", " ", pattern))
    item = next((KIND_WORDS[w] for w in words if w in KIND_WORDS), None)
    if item:
        name = next((w for w in words if w not in KIND_WORDS and len(w) > 1), "*")
        ways.append(("kind", lambda: declarations(files, item, name).select("path", F.col("start_line").alias("line"), F.lit(0).alias("column"), F.concat_ws(" ", "kind", "name").alias("text"))))
    if literals := prefilter_tokens(pattern):
        ways.append(("lexical", lambda: lexical(files, literals[0])))
    for label, way in ways:
        found = way()
        if not found.isEmpty():
            return label, found
    return "none", ways[0][1]()


def symbols(files: DataFrame, name: str, refs: bool = False) -> tuple[str, DataFrame]:
    """Definitions or references of a name, else lines that hold its literal part."""
    found = references(files, name) if refs else declarations(files, None, name)
    literal = max(re.findall(r"\w{2,}", name), key=len, default="")
    if found.isEmpty() and literal:
        return "lexical", lexical(files, literal)
    return ("references" if refs else "definitions"), found


def count_hits(matches: DataFrame) -> DataFrame:
    return matches.withColumn("in_file", F.count("*").over(Window.partitionBy("path")))
