"""Connected components of an edge table: a small one in one task, others by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import Scratch

#: Up to so many edges between bigint nodes are settled by one task, which takes some 150 bytes for each.
ONE_TASK_EDGES = 1 << 20


def _settled(batches):
    """Arrow function: all edges (a, b) of a graph to its nodes, each with the smallest of its component."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in batches:
        a.append(batch.column("a").to_numpy(zero_copy_only=False))
        b.append(batch.column("b").to_numpy(zero_copy_only=False))
    nodes, at = np.unique(np.concatenate((*a, *b)), return_inverse=True)
    left, right = np.split(at, 2)
    root, before = np.arange(len(nodes)), None
    while not np.array_equal(root, before):
        before = root
        low, root = np.minimum(before[left], before[right]), before.copy()
        np.minimum.at(root, before[left], low)
        np.minimum.at(root, before[right], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(nodes[root], pa.int64())], names=["node", "component"])


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; ``component`` is the smallest node of its component.

    Up to ``ONE_TASK_EDGES`` edges between bigint nodes are one task's work, as a round has some ten shuffle stages
    whatever its size. Of more edges, or other nodes, each round aggregates a minimum per node (partial aggregation absorbs hubs) and rewrites the edges
    towards it; tables are cut through the shared scratch folder. Edges with a null end are ignored,
    self-loops keep their node, repeated edges are merged, no edges give no rows. Rounds grow with the
    logarithm of the diameter.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    if all(kind == "bigint" for _, kind in pairs.dtypes):
        pairs = scratch.table(pairs, "pairs")
        if pairs.count() <= ONE_TASK_EDGES:
            found = scratch.table(pairs.coalesce(1).mapInArrow(_settled, "node bigint, component bigint"), "found")
            scratch.drop("pairs")
            return found
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    nodes = scratch.table(nodes, "nodes")
    now = scratch.table(
        pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "e0"
    )
    seen = _state(now)
    for i in range(1, max_rounds + 1):
        both = now.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))).alias("p")).select("p.*")
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.table(large, f"l{i}")
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("p")).select("p.*").where("u <> v").distinct()
        now = scratch.table(small, f"e{i}")
        scratch.drop(f"e{i - 1}")
        scratch.drop(f"l{i - 1}")
        if (state := _state(now)) == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    found = scratch.table(nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "found")
    for name in ("pairs", "nodes", f"e{i}", f"l{i}"):
        scratch.drop(name)
    return found
