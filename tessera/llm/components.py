"""Connected components of an edge table, in one task or by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import delete, scratch

#: Edges that one task joins at most (some 200 MB in its worker); more are joined by rounds of all tasks.
TASK_EDGES = 1 << 21


def least_nodes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, and the least node of each one's component.

    Every root is hooked to the least root next to it, so each round leaves half of a component's roots at most."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != (further := label[label])).any():
            label = further
        x, y = label[x], label[y]
        x, y = x[x != y], y[x != y]
    return nodes, nodes[label]


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, component) of all nodes of edges (a, b): the component is its least node, which has a row as well.

    Up to ``task_edges`` are joined in one task. More take rounds of large and small stars until no edge changes. In a
    star every node links its neighbours (in a small one those below it and itself, in a large one those above it) to
    the least node that it knows. Edges and least nodes are tables in the shared folder, so a node with many neighbours
    is one side of a plain join, which can be split."""
    spark = edges.sparkSession
    made: list[str] = []

    def written(df: DataFrame, schema: str) -> DataFrame:
        made.append(scratch(spark, "edges"))
        df.write.parquet(made[-1])
        return spark.read.schema(schema).parquet(made[-1])

    def star(now: DataFrame, small: bool) -> DataFrame:
        both = now.select(F.col("b").alias("u"), F.col("a").alias("v"))
        if not small:
            both = both.unionByName(now.select(F.col("a").alias("u"), F.col("b").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        least = written(least, "u long, m long")
        linked = both.join(least, "u")
        if small:
            linked = linked.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(
                least.select(F.col("m").alias("a"), F.col("u").alias("b"))
            )
        else:
            linked = linked.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        return written(linked.where("a < b").distinct(), "a long, b long")

    def state(now: DataFrame) -> tuple:
        return tuple(now.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("a", "b"), 16))).first())

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy() for c in batch.columns] for batch in batches if batch.num_rows]
        if held:
            nodes, least = least_nodes(*(np.concatenate(x) for x in zip(*held, strict=True)))
            for at in range(0, len(nodes), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(nodes[part]), pa.array(least[part])], ["node", "component"])

    ordered = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    now = written(ordered.where("a < b"), "a long, b long")
    if now.count() <= task_edges:
        kind = "node long, component long"
        found = written(now.coalesce(1).mapInArrow(joined, kind), kind)
        delete(spark, made[0])
        return found
    before, after = None, state(now)
    while after != before:
        now = star(star(now, False), True)
        before, after = after, state(now)
        for path in made[:-1]:
            delete(spark, path)
        del made[:-1]
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
