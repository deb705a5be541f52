"""Expression helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns computed once a row: a one-row generator keeps the optimizer from copying their expressions into lambda functions."""
    return df.select("*", F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("_one")).select(*df.columns, *[F.col("_one")[k].alias(k) for k in columns])


def top(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first k rows of each group; each partition keeps k a group before rows move. rank: a column for the 0-based place."""
    out = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= k)
    return (out.withColumn(rank, F.col("_rn") - 1) if rank else out).drop("_rn")


def tokens(text: str | Column, cls: str = r"[\p{L}\p{N}_]+") -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), F.lit(cls), F.lit(0))
