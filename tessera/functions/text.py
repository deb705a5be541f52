"""Text and path expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages by file extension.
LANGUAGES = {
    "rs": "rust", "py": "python", "js": "javascript", "mjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "c++": "cpp", "c": "cpp", "h": "cpp", "hpp": "cpp", "hxx": "cpp", "cppm": "cpp", "ixx": "cpp", "mxx": "cpp", "ccm": "cpp", "cxxm": "cpp",
    "php": "php", "sh": "bash", "bash": "bash", "rb": "ruby", "lua": "lua", "json": "json", "swift": "swift", "svelte": "svelte", "css": "css", "scss": "css", "sass": "css", "md": "markdown", "markdown": "markdown",
}
#: Plain-text files that are chunked as text.
TEXT_NAMES = "txt md markdown rst org adoc asciidoc readme changelog license contributors authors notes yaml yml toml ini conf cfg properties env xml html htm sql csv tsv log dockerfile makefile".split()
#: Words that are never technical terms.
PLAIN_WORDS = (
    "about after again below could every first found great house large learn never other place plant point right small sound spell still study their there these thing think three water where which world would write"
).split()


def block_hash(*parts: Column | str) -> Column:
    """SHA-256 over the parts without separators."""
    return F.sha2(F.concat(*[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]), 256)


def extension(path: Column, lower: bool = True) -> Column:
    found = F.regexp_extract(path, r"\.([^./\\]+)$", 1)
    return F.lower(found) if lower else found


def language(path: Column, overrides: dict[str, str] | None = None) -> Column:
    """Project overrides first (`*.ext` or `ext`), then the built-in table, null where neither knows. Case counts."""
    ext = extension(path, lower=False)
    known = LANGUAGES | {k.removeprefix("*").removeprefix("."): v for k, v in (overrides or {}).items()}
    table = F.create_map(*[F.lit(x) for kv in sorted(known.items()) for x in kv])
    return F.element_at(table, ext)


def is_text_name(path: Column) -> Column:
    """By extension; names without one by themselves. Case doesn't count."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return F.when(extension(path) != "", extension(path).isin(TEXT_NAMES)).otherwise(name.isin(TEXT_NAMES))


def looks_like_text(content: Column) -> Column:
    """Non-empty, no NUL, and printable ASCII characters over the length in bytes above 0.8, so text of other alphabets fails."""
    printable = F.length(F.regexp_replace(content, r"[^\x20-\x7E\n\r\t]", ""))
    return (content != "") & (F.instr(content, "\0") == 0) & (printable / F.octet_length(content) > 0.8)


def path_matches(path: Column, spec: str) -> Column:
    """A glob if the spec has one of * ? [, else a substring. `**` crosses directories."""
    if not any(c in spec for c in "*?["):
        return F.contains(path, F.lit(spec))
    out, i = "", 0
    while i < len(spec):
        c = spec[i]
        if spec.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif spec.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[":
            end = spec.find("]", i + 2)
            if end < 0:
                return F.contains(path, F.lit(spec))  # not a glob after all
            body = spec[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body) + "]", end + 1
        else:
            out, i = out + (c if c.isalnum() or c == "_" else "\\" + c), i + 1
    return path.rlike(f"^{out}$")


def name_matches(name: Column, pattern: str) -> Column:
    """Exact, or anchored with `*` as any run of characters."""
    if "*" not in pattern:
        return name == pattern
    quoted = "".join(".*" if c == "*" else c if c.isalnum() or c == "_" else "\\" + c for c in pattern)
    return name.rlike(f"^{quoted}$")


def normalise_path(path: Column) -> Column:
    r"""`\` to `/`, `.` and `..` resolved; a `..` that can't be resolved stays, except at a root."""
    clean = F.regexp_replace(path, r"\\", "/")
    absolute = clean.startswith("/")
    parts = F.filter(F.split(clean, "/"), lambda p: (p != "") & (p != "."))
    step = lambda acc, p: F.when(p != "..", F.array_append(acc, p)).when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1) != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1)).when(absolute, acc).otherwise(F.array_append(acc, p))
    return F.concat(F.when(absolute, "/").otherwise(""), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))


def relative_to(source: Column, target: Column) -> Column:
    """target as seen from the directory of source."""
    return normalise_path(F.concat(F.regexp_extract(source, r"^(.*/)?[^/]*$", 1), target))


def markdown_links(text: Column) -> Column:
    """Sorted distinct targets of links to .md and .markdown files, without anchors, external targets and images."""
    plain = F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)", "")
    found = F.regexp_extract_all(plain, F.lit(r"\[[^\]]*\]\(\s*([^)\s#]+\.(?:md|markdown))(?:#[^)]*)?\s*\)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: ~x.rlike("^https?://"))))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1))


def code_preamble(path: Column, lang: Column, defines: Column, content: Column, description: Column | None = None) -> Column:
    """Header lines that put a block into its place, a blank line, the content."""
    names = F.when(F.size(defines) > 0, F.concat(F.lit("# Defines: "), F.array_join(defines, ", ")))
    said = [] if description is None else [F.nullif(description, F.lit(""))]
    return F.concat(F.concat_ws("\n", *said, F.concat(F.lit("# File: "), path), F.concat(F.lit("# Language: "), lang), names), F.lit("\n\n"), content)


def text_preamble(path: Column, content: Column, context: Column | None = None) -> Column:
    lines = [F.concat(F.lit("# File: "), path)] + ([F.nullif(F.array_join(context, "\n"), F.lit(""))] if context is not None else [])
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n\n"), content)


def strip_preamble(content: Column) -> Column:
    """Cut from `# File: ` at a line start to the first blank line behind it."""
    return F.when(content.rlike(r"(?s)(?:^|\n)# File: .*?\n\n"), F.regexp_extract(content, r"(?s)(?:^|\n)# File: .*?\n\n(.*)$", 1)).otherwise(content)


def preview(content: Column, head: int = 4, tail: int = 3, whole: int = 10, first_line: Column | int = 1) -> Column:
    """Numbered lines: all up to `whole`, else the first and the last ones and how many are left out."""
    lines = F.split(content, "\n")
    numbered = F.transform(lines, lambda x, i: F.concat(i + first_line, F.lit(": "), x))
    n = F.size(lines)
    cut = F.concat(F.slice(numbered, 1, head), F.array(F.concat(F.lit("... ("), n - (head + tail), F.lit(" more lines)"))), F.slice(numbered, F.greatest(n - (tail - 1), F.lit(1)), tail))
    return F.array_join(F.when(n <= whole, numbered).otherwise(cut), "\n")


def doc_preview(content: Column, first_line: Column | int = 1, head: int = 4, tail: int = 3, whole: int = 10) -> Column:
    """As preview(), from the first line that isn't blank; what is left between head and tail counts from there."""
    lines = F.split(content, "\n")
    numbered = F.transform(lines, lambda x, i: F.concat(i + first_line, F.lit(": "), x))
    n = F.size(lines)
    filled = F.array_position(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")) != ""), True).cast("int")
    start = F.greatest(filled - 1, F.lit(0))
    left = n - (start + head)
    front = F.slice(numbered, start + 1, F.lit(head))
    rest = F.when(left > tail, F.concat(F.array(F.concat(F.lit("... ("), left, F.lit(" more lines)"))), F.slice(numbered, F.greatest(n - (tail - 1), F.lit(1)), F.lit(tail))))
    rest = rest.when(left > 0, F.slice(numbered, start + head + 1, F.greatest(left, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.when(n <= whole, numbered).otherwise(F.concat(front, rest)), "\n")


def simple_description(name: Column, lang: Column, symbols: Column, lines: Column) -> Column:
    """What a file holds by the prefixes of its symbols: functions and methods, classes and structs."""
    count = lambda *parts: F.size(F.filter(symbols, lambda s: reduce(lambda a, b: a | b, [F.contains(s, F.lit(p)) for p in parts])))
    functions, classes = count("function_", "method_"), count("class_", "struct_")
    some = lambda n, what: F.when(n > 0, F.concat(n, F.lit(what)))
    parts = F.concat_ws(" and ", some(functions, " functions"), some(classes, " classes"))
    return F.concat(name, F.lit(" "), lang, F.lit(" file"), F.when(parts != "", F.concat(F.lit(" with "), parts)).otherwise(""), F.lit(" ("), lines, F.lit(" lines)"))


def next_version(version: Column, breaking: Column, feat: Column) -> Column:
    """As bump(), for columns; null where a version hasn't three numbers in front."""
    core = F.regexp_replace(version, r"[-+].*$", "")
    part = lambda k: F.regexp_extract(core, r"^(\d+)\.(\d+)\.(\d+)$", k).cast("int")
    up = F.when(breaking, F.concat(part(1) + 1, F.lit(".0.0"))).when(feat, F.concat_ws(".", part(1), part(2) + 1, F.lit("0"))).otherwise(F.concat_ws(".", part(1), part(2), part(3) + 1))
    return F.when(core.rlike(r"^\d+\.\d+\.\d+$"), up)


def conventional(message: Column) -> dict[str, Column]:
    """type, scope, breaking, description of the first line; without the form the type comes from the first word."""
    line = F.element_at(F.split(message, "\n"), 1)
    form = r"^(\w+)(?:\(([^)]*)\))?(!)?:\s*(.*)$"
    kind = F.lower(F.regexp_extract(line, form, 1))
    word = F.lower(F.regexp_extract(line, r"^(\w+)", 1))
    guessed = F.when(word.isin("fix", "fixed", "fixes", "bug"), "fix").when(word.isin("add", "added", "adds", "feature", "implement"), "feat").otherwise("other")
    has = kind != ""
    return {
        "type": F.when(has, kind).otherwise(guessed),
        "scope": F.nullif(F.regexp_extract(line, form, 2), F.lit("")),
        "breaking": (F.regexp_extract(line, form, 3) == "!") | F.contains(message, F.lit("BREAKING CHANGE")),
        "description": F.when(has, F.regexp_extract(line, form, 4)).otherwise(line),
    }


def category(kind: Column, breaking: Column) -> Column:
    return F.when(breaking, "breaking").when(kind.isin("feat", "fix"), kind).otherwise("other")


def bump(version: str, breaking: bool, feat: bool) -> str:
    """The next version: major if breaking, minor if there is a feature, else patch."""
    import re

    m = re.fullmatch(r"v?(\d+)\.(\d+)\.(\d+)(?:-[0-9A-Za-z.-]+)?(?:\+[0-9A-Za-z.-]+)?", version)
    if not m:
        raise ValueError(f"{version!r} isn't a semantic version")
    a, b, c = map(int, m.groups())
    return f"{a + 1}.0.0" if breaking else f"{a}.{b + 1}.0" if feat else f"{a}.{b}.{c + 1}"


def file_kind(path: Column) -> Column:
    """By path pattern; the source pattern needs a slash before `src`."""
    has = lambda *xs: reduce(lambda a, b: a | b, [F.contains(path, F.lit(x)) for x in xs])
    return F.when(has("/test/", "/tests/", "_test.", ".test.", "test_"), "test_file").when(has("/examples/", "/example/"), "example_file").when(has("/docs/", "/doc/") | path.endswith(".md"), "documentation").when(has("/config/", "config."), "config_file").when(has("/src/"), "source_file").otherwise("file")


def simple_type(name: Column) -> Column:
    """Without generics, the last `::` or `.` part, without outer punctuation."""
    bare = F.regexp_replace(name, r"<.*$", "")
    return F.regexp_replace(F.element_at(F.split(bare, r"::|\."), -1), r"^[^\w]+|[^\w]+$", "")


def callee(text: Column) -> tuple[Column, Column]:
    """name, qualifier (`::`-joined, null if none) of a call; both null for dynamic ones."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"^[&*\s]+", ""), r"::<[^()]*>|<[^()]*>", ""), r"\?\.|->", ".")
    static = clean.rlike(r"^[A-Za-z_$][\w$]*(?:(?:::|\.)[A-Za-z_$][\w$]*)*$")
    parts = F.split(clean, r"::|\.")
    return F.when(static, F.element_at(parts, -1)), F.when(static & (F.size(parts) > 1), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "::"))


def is_technical(word: Column) -> Column:
    """Without what stands around letters and digits, in lower case: not a plain word, and with an underscore or longer than six bytes."""
    bare = F.lower(F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return ~bare.isin(PLAIN_WORDS) & (F.contains(bare, F.lit("_")) | (F.octet_length(bare) > 6))


def prefilter_tokens(pattern: str) -> list[str]:
    """Identifiers of two or more characters that aren't metavariables, longest first: all must occur in a file."""
    import re

    return sorted(set(re.findall(r"(?<![\w$])[A-Za-z_]\w+", re.sub(r"\$+\w*", " ", pattern))), key=lambda t: (-len(t), t))


def has_all(content: Column, tokens: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.contains(content, F.lit(t)) for t in tokens], F.lit(True))


def severity_shown(severity: Column, least: str) -> Column:
    """CRITICAL, HIGH, MEDIUM, LOW in this order; unknown ones are shown."""
    order = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3}
    level = reduce(lambda acc, kv: acc.when(F.upper(severity) == kv[0], kv[1]), order.items(), F.when(F.lit(False), -1))
    return F.coalesce(level <= order.get(least.upper(), 3), F.lit(True))


def symbol_match(symbol: Column) -> Column:
    """Import and export names without their prefixes."""
    return F.regexp_replace(symbol, r"^(?:import_|use_|from_|export_|pub_|public_)", "")


def import_candidates(text: Column) -> Column:
    """Texts to look an import up by, in order: as it is, without its prefix, and its last part."""
    return F.array_distinct(F.array(text, symbol_match(text), F.element_at(F.split(text, r"[:./]+"), -1)))
