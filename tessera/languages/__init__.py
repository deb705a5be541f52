"""Extractors of symbols, imports, calls and type relations from source texts, by language."""

from tessera.languages.registry import EXTRACTORS, Extract, extract

__all__ = ["EXTRACTORS", "Extract", "extract"]
