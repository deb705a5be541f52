"""Connected components against union-find; hubs over several tasks; names that don't clash."""

import random

import pytest

from tessera.llm import common


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(100, 140)] + [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(999, k) for k in range(500, 600)]
    got = {r.u: r.root for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: r for x, r in brute(edges).items() if any(x in e and e[0] != e[1] for e in edges)}


def test_a_hub_is_split(spark):
    """A node with most of the edges: adaptive execution deals its rows to several tasks."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        edges = spark.range(0, 200_000, 1, 16).selectExpr("id + 1 AS u", "0L AS v").checkpoint()
        assert "skew=true" in _final(common.large_star(edges))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _final(df):
    query = df._jdf.queryExecution()
    df._jdf.collectToPython()
    return query.executedPlan().toString()


def test_fresh_names():
    assert common.fresh(["a", "_Row", "_row_"], "_row") == "_row__"


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Conf:
        get = staticmethod(lambda *a: None)

    class Session:
        sparkContext, conf = Context, Conf

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_root(Session)
