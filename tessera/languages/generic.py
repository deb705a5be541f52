"""Brace, keyword and rule languages, by declaration patterns over text without comments and strings.

Ends of declarations come from brace depth, or from indentation where a language has no braces.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from tessera.languages.registry import EXTRACTORS, Extract, Symbol

NAME = r"[A-Za-z_$][\w$]*"
#: Words before a parenthesis that aren't calls.
NO_CALL = frozenset("if for while switch catch return match loop else fn func function def sizeof new await assert when guard unless until elsif elif do try with using super typeof in not and or import package".split())


@dataclass
class Grammar:
    """kind -> declaration patterns (group `n`: name, `o`: owner); import patterns (group 1: text); relations: kind -> patterns (groups s, t)."""

    symbols: dict[str, list[str]]
    imports: list[str] = field(default_factory=list)
    relations: dict[str, list[str]] = field(default_factory=dict)
    bindings: list[str] = field(default_factory=list)  # groups l: local name, i: imported name or empty, m: module
    named: str | None = None  # groups list: `a, b as c`, m: module
    exports: str | None = None
    line_comment: str | None = "//"
    braces: bool = True
    owners: tuple[str, ...] = ("class", "struct", "trait", "interface", "impl", "enum", "protocol", "module", "record", "extension")


def masked(text: str, line_comment: str | None) -> str:
    """Comments and the insides of strings as blanks; positions stay. Without comments (JSON) the text stays."""
    if line_comment is None:
        return text
    parts = [r"/\*.*?\*/"] if line_comment == "//" else []
    parts.append(re.escape(line_comment) + r"[^\n]*")
    parts += [r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'", r"`(?:\\.|[^`\\])*`"]
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    return re.sub("|".join(parts), lambda m: m[0][0] + blank(m)[1:-1] + m[0][-1] if m[0][0] in "\"'`" and len(m[0]) > 1 else blank(m), text, flags=re.DOTALL)


def _end(code: str, at: int, braces: bool) -> int:
    """Position where the declaration at `at` ends."""
    if not braces:
        m = re.compile(r"^[ \t]*end\b", re.MULTILINE)
        indent = len(re.match(r"[ \t]*", code[code.rfind("\n", 0, at) + 1 :])[0])
        for x in m.finditer(code, at):
            if len(x[0]) - 3 <= indent:
                return x.end() - 1
        return code.find("\n", at) if "\n" in code[at:] else len(code) - 1
    depth = 0
    for m in re.compile(r"[{};]").finditer(code, at):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if depth <= 0:
                return m.start()
        elif depth == 0:
            return m.start()
    return len(code) - 1


def build(g: Grammar):
    compiled = [(kind, re.compile(p, re.MULTILINE)) for kind, ps in g.symbols.items() for p in ps]

    def run(text: str) -> Extract:
        code, out = masked(text, g.line_comment), Extract()
        line = lambda at: code.count("\n", 0, at)
        found = []
        for kind, p in compiled:
            for m in p.finditer(code):
                start = m.start("n")
                found.append((m.start() + len(m[0]) - len(m[0].lstrip()), _end(code, start, g.braces), m["n"], kind, m.groupdict().get("o")))
        found.sort()
        owners = [(a, b, n) for a, b, n, kind, _ in found if kind in g.owners]
        for a, b, n, kind, own in found:
            around = [(z - x, o) for x, z, o in owners if x < a and b <= z]
            owner = own or (min(around)[1] if around else None)
            if kind != "impl":
                out.symbols.append(Symbol(n, "method" if kind == "function" and owner else kind, line(a), line(max(b, a)), owner))
        for p in g.imports:
            out.imports += [next(x for x in m.groups() if x is not None) for m in re.finditer(p, text, re.MULTILINE)]
        for p in g.bindings:
            out.bindings += [(m["l"], m["i"] or None, m["m"]) for m in re.finditer(p, text, re.MULTILINE)]
        for m in re.finditer(g.named, text, re.MULTILINE) if g.named else ():
            for item in filter(None, (x.strip() for x in m["list"].split(","))):
                name, _, local = (x.strip() for x in item.removeprefix("type ").partition(" as "))
                out.bindings.append((local or name, name, m["m"]))
        for kind, ps in g.relations.items():
            for p in ps:
                for m in re.finditer(p, code, re.MULTILINE):
                    for t in re.split(r"[,+&]", re.sub(r"<[^<>]*>|\([^()]*\)", "", m["t"])):
                        if t := re.sub(r"\b(?:public|private|protected|virtual)\b", "", t).strip():
                            out.relations.append((line(m.start()), m["s"], kind, re.split(r"::|\.|\\", t)[-1].strip()))
        declared = {m.start("n") for _, p in compiled for m in p.finditer(code)}
        for m in re.finditer(rf"(?<![\w$])((?:{NAME}(?:::|\?\.|\.|->))*)({NAME})!?\s*\(", code):
            before = code[max(0, m.start() - 12) : m.start()].rstrip()
            if m[2] not in NO_CALL and m.start(2) not in declared and not re.search(r"\b(?:fn|func|function|def|class|sub)$", before):
                q = re.sub(r"\?\.|->|\.", "::", m[1]).strip(":")
                out.calls.append((line(m.start()), m[2], q or None))
        if g.exports:
            out.exports = [m["n"] for m in re.finditer(g.exports, code, re.MULTILINE)]
        return out

    return run


MODS = r"^[ \t]*(?:(?:export|default|public|private|protected|internal|open|fileprivate|static|final|abstract|async|sealed|override|inline|virtual|constexpr|extern|readonly|declare|unsafe|const|mutating|pub(?:\([^)]*\))?)\s+)*"
QUOTED = r"""['"]([^'"]+)['"]"""

_SCRIPT = Grammar(
    {
        "function": [rf"{MODS}function\s*\*?\s*(?P<n>{NAME})", rf"{MODS}(?:let|var)?\s*(?P<n>{NAME})\s*=\s*(?:async\s*)?(?:\([^)]*\)|{NAME})\s*=>", rf"^[ \t]+(?:(?:async|static|get|set|public|private|protected|readonly)\s+)*(?!(?:if|for|while|switch|catch|return|function)\b)(?P<n>{NAME})\s*\([^)]*\)\s*(?::\s*[^{{;=]+)?\{{"],
        "class": [rf"{MODS}class\s+(?P<n>{NAME})"], "interface": [rf"{MODS}interface\s+(?P<n>{NAME})"], "type": [rf"{MODS}type\s+(?P<n>{NAME})\s*="], "enum": [rf"{MODS}enum\s+(?P<n>{NAME})"],
    },
    [rf"^\s*(?:import|export)\b[^'\"\n;]*?\bfrom\s*{QUOTED}", rf"^\s*import\s*{QUOTED}", rf"\brequire\(\s*{QUOTED}\s*\)"],
    {"extends": [rf"\bclass\s+(?P<s>{NAME})[^{{]*?\bextends\s+(?P<t>[\w$.]+)", rf"\binterface\s+(?P<s>{NAME})[^{{]*?\bextends\s+(?P<t>[^{{]+)"], "implements": [rf"\bclass\s+(?P<s>{NAME})[^{{]*?\bimplements\s+(?P<t>[^{{]+)"]},
    [rf"""^\s*import\s+(?P<i>)\*\s+as\s+(?P<l>{NAME})\s+from\s*['"](?P<m>[^'"]+)['"]"""],
    r"""^\s*import\b[^{'"\n;]*\{(?P<list>[^}]*)\}\s*from\s*['"](?P<m>[^'"]+)['"]""",
    rf"^[ \t]*export\s+(?:(?:default|abstract|async|const)\s+)*(?:function\*?|class|let|var|interface|type|enum)?\s*(?P<n>{NAME})",
)

GRAMMARS = {
    "javascript typescript svelte": _SCRIPT,
    "rust": Grammar(
        {"function": [rf"{MODS}fn\s+(?P<n>{NAME})"], "struct": [rf"{MODS}struct\s+(?P<n>{NAME})"], "enum": [rf"{MODS}enum\s+(?P<n>{NAME})"], "trait": [rf"{MODS}trait\s+(?P<n>{NAME})"],
         "module": [rf"{MODS}mod\s+(?P<n>{NAME})\s*\{{"], "constant": [rf"{MODS}(?:static\s+(?:mut\s+)?)?(?P<n>[A-Z_][A-Z0-9_]+)\s*:"], "type": [rf"{MODS}type\s+(?P<n>{NAME})"], "macro": [rf"^\s*macro_rules!\s*(?P<n>{NAME})"], "impl": [rf"^\s*impl\b(?:<[^>]*>)?\s*(?:[^{{;]*?\bfor\s+)?(?P<n>{NAME})"]},
        [r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);"],
        {"implements": [rf"^\s*impl\b(?:<[^>]*>)?\s*(?P<t>[\w:]+)(?:<[^>]*>)?\s+for\s+(?P<s>{NAME})"], "extends": [rf"\btrait\s+(?P<s>{NAME})(?:<[^>]*>)?\s*:\s*(?P<t>[^{{]+?)\s*(?:where\b|\{{)"]},
        [rf"^\s*use\s+(?P<m>[\w:]+)::(?P<i>{NAME})\s+as\s+(?P<l>{NAME})"], None, rf"^\s*pub(?:\([^)]*\))?\s+(?:async\s+|const\s+|unsafe\s+)*(?:fn|struct|enum|trait|mod|type|static)\s+(?P<n>{NAME})",
    ),
    "go": Grammar(
        {"function": [rf"^func\s+(?P<n>{NAME})"], "method": [rf"^func\s+\(\s*\w*\s*\*?(?P<o>{NAME})[^)]*\)\s*(?P<n>{NAME})"], "struct": [rf"^type\s+(?P<n>{NAME})\s+struct"], "interface": [rf"^type\s+(?P<n>{NAME})\s+interface"], "type": [rf"^type\s+(?P<n>{NAME})\s+(?!struct|interface)"]},
        [r'^\s*import\s+(?:[\w.]+\s+)?"([^"]+)"', r'^\s+(?:[\w.]+\s+)?"([^"]+)"\s*$'], {"extends": [rf"\btype\s+(?P<s>{NAME})\s+struct\s*\{{[^}}]*?^\s*\*?(?P<t>[A-Z][\w.]*)\s*$"]},
        [r'^\s*(?:import\s+)?(?P<l>\w+)\s+(?P<i>)"(?P<m>[^"]+)"'], None, r"^(?:func|type|var|const)\s+(?:\([^)]*\)\s*)?(?P<n>[A-Z]\w*)",
    ),
    "java": Grammar(
        {"class": [rf"{MODS}class\s+(?P<n>{NAME})"], "interface": [rf"{MODS}interface\s+(?P<n>{NAME})"], "enum": [rf"{MODS}enum\s+(?P<n>{NAME})"], "record": [rf"{MODS}record\s+(?P<n>{NAME})"], "function": [rf"{MODS}(?:<[^>]+>\s*)?[\w<>\[\],.? ]+\s+(?P<n>{NAME})\s*\([^;{{)]*\)\s*(?:throws\s+[\w., ]+)?\{{"]},
        [r"^\s*import\s+(?:static\s+)?([\w.*]+);"],
        {"extends": [rf"\b(?:class|interface)\s+(?P<s>{NAME})[^{{]*?\bextends\s+(?P<t>[\w.<>, ]+?)(?:\bimplements\b|\{{)"], "implements": [rf"\b(?:class|enum|record)\s+(?P<s>{NAME})[^{{]*?\bimplements\s+(?P<t>[^{{]+)"]}, [], None, rf"^\s*public\s+(?:\w+\s+)*(?:class|interface|enum|record)\s+(?P<n>{NAME})",
    ),
    "cpp": Grammar(
        {"class": [rf"{MODS}class\s+(?P<n>{NAME})\s*[:{{]"], "struct": [rf"{MODS}struct\s+(?P<n>{NAME})\s*[:{{]"], "enum": [rf"{MODS}enum\s+(?:class\s+)?(?P<n>{NAME})"], "module": [rf"^\s*namespace\s+(?P<n>{NAME})"], "function": [rf"{MODS}[\w:<>*&, ]+[\s*&](?:(?P<o>{NAME})::)?(?P<n>~?{NAME})\s*\([^;{{]*\)\s*(?:const|noexcept|override|\s)*\{{"]},
        [r"""^\s*#\s*include\s*([<"][^>"]+[>"])"""], {"extends": [rf"\b(?:class|struct)\s+(?P<s>{NAME})\s*(?:final\s*)?:(?!:)\s*(?P<t>[^{{;]+)"]},
    ),
    "php": Grammar(
        {"function": [rf"{MODS}function\s+&?(?P<n>{NAME})"], "class": [rf"{MODS}class\s+(?P<n>{NAME})"], "interface": [rf"{MODS}interface\s+(?P<n>{NAME})"], "trait": [rf"{MODS}trait\s+(?P<n>{NAME})"], "enum": [rf"{MODS}enum\s+(?P<n>{NAME})"]},
        [r"^\s*use\s+([\w\\]+)", rf"\b(?:require|include)(?:_once)?\s*\(?\s*{QUOTED}"],
        {"extends": [rf"\bclass\s+(?P<s>{NAME})\s+extends\s+(?P<t>[\w\\]+)", rf"\binterface\s+(?P<s>{NAME})\s+extends\s+(?P<t>[^{{]+)"], "implements": [rf"\b(?:class|enum)\s+(?P<s>{NAME})[^{{]*?\bimplements\s+(?P<t>[^{{]+)"]},
        [rf"^\s*use\s+(?P<m>[\w\\]+)\\(?P<i>{NAME})\s+as\s+(?P<l>{NAME})"],
    ),
    "ruby": Grammar(
        {"function": [r"^[ \t]*def\s+(?:self\.)?(?P<n>\w+[?!]?)"], "class": [rf"^[ \t]*class\s+(?P<n>{NAME})"], "module": [rf"^[ \t]*module\s+(?P<n>{NAME})"]},
        [rf"^\s*require(?:_relative)?\s+{QUOTED}"], {"extends": [rf"\bclass\s+(?P<s>{NAME})\s*<\s*(?P<t>[\w:]+)"]}, [], None, None, "#", False,
    ),
    "lua": Grammar({"function": [rf"^[ \t]*(?:local\s+)?function\s+(?:(?P<o>{NAME})[.:])?(?P<n>{NAME})"]}, [rf"\brequire\s*\(?\s*{QUOTED}"], {}, [], None, None, "--", False),
    "bash": Grammar({"function": [r"^[ \t]*(?:function\s+)?(?P<n>[\w-]+)\s*\(\)\s*\{", r"^[ \t]*function\s+(?P<n>[\w-]+)\s*\{"]}, [r"""^\s*(?:source|\.)\s+["']?([^\s"']+)"""], {}, [], None, None, "#"),
    "swift": Grammar(
        {"function": [rf"{MODS}func\s+(?P<n>{NAME})"], "class": [rf"{MODS}(?:class|actor)\s+(?P<n>{NAME})"], "struct": [rf"{MODS}struct\s+(?P<n>{NAME})"], "enum": [rf"{MODS}enum\s+(?P<n>{NAME})"], "protocol": [rf"{MODS}protocol\s+(?P<n>{NAME})"], "extension": [rf"{MODS}extension\s+(?P<n>{NAME})"]},
        [r"^\s*import\s+([\w.]+)"], {"implements": [rf"\b(?:class|struct|enum|actor)\s+(?P<s>{NAME})(?:<[^>]*>)?\s*:\s*(?P<t>[^{{]+)"], "extends": [rf"\bprotocol\s+(?P<s>{NAME})\s*:\s*(?P<t>[^{{]+)"]},
    ),
    "css": Grammar({"rule": [r"^[ \t]*(?P<n>[.#]?[\w-]+)[^{};]*\{"], "variable": [r"^[ \t]*(?P<n>(?:\$|--)[\w-]+)\s*:"]}, [rf"@(?:import|use|forward)\s+(?:url\(\s*)?{QUOTED}"]),
    "json": Grammar({"key": [r'^ {0,2}"(?P<n>[^"\n]+)"\s*:']}, line_comment=None),
}
EXTRACTORS.update({name: build(g) for names, g in GRAMMARS.items() for name in names.split()})


def _markdown(text: str) -> Extract:
    plain = re.sub(r"!\[[^\]]*\]\([^)]*\)", "", text)
    links = re.findall(r"\[[^\]]*\]\(\s*([^)\s#]+\.(?:md|markdown))(?:#[^)]*)?\s*\)", plain)
    return Extract(imports=sorted({x for x in links if not x.startswith(("http://", "https://"))}))


EXTRACTORS["markdown"] = _markdown
