"""Fixed table schemas, the dimension guard and reading older tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_TEXT = "path string, language string, content string, start_line int, end_line int, hash string, embedding array<float>"
_FUNCTION = "struct<name: string, signature: string, start_line: int, end_line: int, calls: array<string>, called_by: array<string>, parameters: array<string>, return_type: string, extends: array<string>, implements: array<string>>"

#: Tables by name; list columns are real arrays, JSON appears only at import and export.
TABLES = {
    "code_blocks": _TEXT.replace("start_line", "symbols array<string>, start_line"),
    "text_blocks": _TEXT,
    "document_blocks": "path string, title string, content string, context array<string>, level int, start_line int, end_line int, hash string, embedding array<float>",
    "commit_blocks": "hash string, author string, date bigint, message string, content string, files array<string>, description string, embedding array<float>",
    "graph_nodes": f"id string, name string, kind string, path string, description string, symbols array<string>, imports array<string>, exports array<string>, functions array<{_FUNCTION}>, size_lines int, language string, hash string, embedding array<float>",
    "graph_edges": "source string, target string, relation_type string, description string, confidence double, weight double, provenance string",
    "file_metadata": "path string, mtime bigint, indexed_at bigint",
    "markers": "name string, commit_hash string, indexed_at bigint",
}
#: Values for columns that older tables lack.
DEFAULTS = {"provenance": "extracted", "size_lines": 0, "language": "unknown"}
#: Relation types in their order and the weight of each.
RELATIONS = {
    "imports": 0.7, "calls": 0.8, "extends": 1.0, "implements": 1.0, "references": 0.6, "contains": 0.3, "sibling_module": 0.7, "parent_module": 0.7, "child_module": 0.7,
    "configures": 0.9, "architectural_dependency": 0.9, "factory_creates": 0.9, "observer_pattern": 0.9, "strategy_pattern": 0.9, "adapter_pattern": 0.9, "decorator_pattern": 0.9,
}


def schema_of(name: str) -> StructType:
    """The schema of a table; needs a session, which parses it."""
    return StructType.fromDDL(TABLES[name])


def read_table(spark: SparkSession, path: str | list[str], name: str) -> DataFrame:
    """A table by its schema; columns that the files lack get their default."""
    schema = schema_of(name)
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(DEFAULTS.get(f.name)).cast(f.dataType).alias(f.name) for f in schema])


def dimension_ok(df: DataFrame, dim: int, column: str = "embedding") -> bool:
    """Whether every vector has dim entries: one aggregate."""
    low, high = df.where(F.col(column).isNotNull()).agg(F.min(F.size(column)), F.max(F.size(column))).first()
    return low is None or low == high == dim


def relation(text: str) -> str:
    """Unknown relation texts read as imports."""
    return text if text in RELATIONS else "imports"


def provenance(text: str) -> str:
    return text if text in ("extracted", "inferred", "ambiguous") else "extracted"
