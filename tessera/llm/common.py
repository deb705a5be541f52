"""What the operators share: the shared folder, table reading and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: White space that all word and text rules of this subpackage use: space, tab, LF, VT, FF, CR.
SPACES = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read by Spark alone so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a new local folder serves a
    local master, whose executors are this process; any other master raises, since its executors wouldn't see it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        root = spark.sparkContext.getCheckpointDir()
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder for one written table. It goes when the driver's JVM ends: results are
    lazy and read it until then."""
    path = f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def fresh(columns: list[str], name: str) -> str:
    """name, with underscores behind it until no column has it (names differ in more than case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def tasks(spark: SparkSession) -> int:
    """Partitions for a shuffle whose rows are small but mean much work: adaptive execution leaves a given number alone."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def stored(df: DataFrame, what: str, **options: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def extended(df: DataFrame, ddl: str) -> StructType:
    """The schema of df with the fields of ddl behind it."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row: a one-row generator keeps the optimizer from putting their
    expressions into lambda functions, where each call would compute them again."""
    return df.select("*", F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("_one")).select(*df.columns, *[F.col("_one")[k].alias(k) for k in columns])


def large_star(cur: DataFrame) -> DataFrame:
    """Each node's larger neighbours meet the least of its neighbours and itself."""
    both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least", compression="zstd")
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, root) for every node of edges(u, v): root is the smallest node that u reaches.

    Alternating large-star and small-star steps. Each step is one minimum per node (combined before the
    shuffle), which is written, and one equi-join. As both sides of the join are then plain shuffles, adaptive
    execution can split a hub's edges over tasks. Each round is checkpointed; it ends when a round leaves the edge
    set as it was.
    """
    shared_root(edges.sparkSession)
    cur = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()

    def print_of(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = print_of(cur)
    for _ in range(rounds):
        if not seen[0]:
            break
        large = stored(large_star(cur).distinct(), "large", compression="zstd")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least", compression="zstd")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        cur = small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct().checkpoint()
        now = print_of(cur)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components: no fixed point after {rounds} rounds")
    roots = cur.select(F.col("v").alias("u")).distinct()
    return cur.groupBy("u").agg(F.min("v").alias("root")).union(roots.select("u", F.col("u").alias("root"))).groupBy("u").agg(F.min("root").alias("root"))
