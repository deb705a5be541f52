"""Extraction results and the registry of languages. Lines are 0-based."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class Symbol:
    name: str
    kind: str
    start: int
    end: int
    owner: str | None = None


@dataclass
class Extract:
    symbols: list[Symbol] = field(default_factory=list)
    imports: list[str] = field(default_factory=list)
    exports: list[str] = field(default_factory=list)
    #: (local name, imported name or None for a module, module)
    bindings: list[tuple[str, str | None, str]] = field(default_factory=list)
    #: (line, name, qualifier)
    calls: list[tuple[int, str, str | None]] = field(default_factory=list)
    #: (line, source, extends or implements, target)
    relations: list[tuple[int, str | None, str, str]] = field(default_factory=list)


EXTRACTORS: dict[str, Callable[[str], Extract]] = {}


def language(*names: str) -> Callable:
    def add(f: Callable[[str], Extract]) -> Callable[[str], Extract]:
        EXTRACTORS.update(dict.fromkeys(names, f))
        return f

    return add


def extract(lang: str, text: str) -> Extract:
    """Nothing for languages without an extractor and for texts that can't be parsed."""
    from tessera.languages import generic, python  # noqa: F401  (importing registers)

    f = EXTRACTORS.get(lang)
    try:
        return f(text) if f else Extract()
    except (SyntaxError, ValueError, RecursionError):
        return Extract()
