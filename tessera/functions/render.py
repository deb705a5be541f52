"""Rendering: signatures, rewrite diffs, formatting by editor settings."""

from __future__ import annotations

import difflib
import re

from tessera.languages import extract


def signatures(path: str, lang: str, text: str, most: int = 20) -> list[dict]:
    """Items of a file: kind, name, lines (1-based), head (up to the body) and the comment above. Markdown: headings."""
    rows = text.split("\n")
    if lang == "markdown":
        from tessera.operators.chunks import sections

        return [{"path": path, "kind": f"h{s.level}", "name": s.title, "start": s.start + 1, "end": s.end + 1, "head": "\n".join(s.content.split("\n")[:most]), "comment": None} for s in sections(text) if s.context]
    out = []
    for s in sorted(extract(lang, text).symbols, key=lambda s: s.start):
        top = s.start
        while top > 0 and rows[top - 1].strip().startswith(("//", "#", "*", "/*", "--")):
            top -= 1
        head = re.split(r"[{]|:\s*$", "\n".join(rows[s.start : min(s.end + 1, s.start + most)]), maxsplit=1, flags=re.MULTILINE)[0].strip()
        out.append({"path": path, "kind": s.kind, "name": s.name, "start": s.start + 1, "end": s.end + 1, "head": head, "comment": "\n".join(x.strip() for x in rows[top : s.start]) or None})
    return out


def diff(path: str, before: str, after: str) -> str:
    return "".join(difflib.unified_diff(before.splitlines(True), after.splitlines(True), f"a/{path}", f"b/{path}"))


def patch_ranges(patch: str) -> list[tuple[str, int, int]]:
    """(path, first, last) of the old side of every hunk; pure insertions count the line before them."""
    out, path = [], None
    for line in patch.split("\n"):
        if m := re.match(r"--- (?:a/)?(.*)", line):
            path = None if m[1] == "/dev/null" else m[1]
        elif (m := re.match(r"@@ -(\d+)(?:,(\d+))? ", line)) and path:
            first, n = int(m[1]), int(m[2] or 1)
            out.append((path, first, first + max(n, 1) - 1))
    return out


def format_text(text: str, indent: str | None = None, size: int = 4, trim: bool = True, final_newline: bool | None = True, eol: str = "\n") -> str:
    """Editor settings: indent `space` or `tab` of leading blanks, trailing blanks, the last line end, line ends."""
    rows = re.split(r"\r\n|\r|\n", text)
    if indent:
        def lead(x: str) -> str:
            blanks = re.match(r"[ \t]*", x)[0]
            n = len(blanks.expandtabs(size))
            return (" " * n if indent == "space" else "\t" * (n // size) + " " * (n % size)) + x[len(blanks) :]

        rows = [lead(x) for x in rows]
    if trim:
        rows = [x.rstrip(" \t") for x in rows]
    out = eol.join(rows)
    if final_newline is not None:
        out = out.rstrip("\r\n") + (eol if final_newline and out.strip() else "")
    return out


def long_lines(text: str, limit: int) -> list[int]:
    """1-based lines above the limit."""
    return [i for i, x in enumerate(text.split("\n"), 1) if len(x) > limit]


def combine(parts: list[str]) -> str:
    """Answers about parts of one input, numbered where there are several."""
    return parts[0] if len(parts) == 1 else "\n\n".join(f"## Part {i}\n\n{p.strip()}" for i, p in enumerate(parts, 1))
