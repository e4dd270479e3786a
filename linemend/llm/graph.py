"""Connected components of an edge table by alternating large and small stars.

Every round is two joins; the table shrinks towards one star for each component. Rounds grow with
the logarithm of the longest way, and each is written to the shared folder, so lineage stays short
and a lost executor costs one round. Nothing is gathered by component. A table of at most `FINISH` edges,
which is 8 MB whatever its components are, is finished by one task instead of further rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_work_dir, work_dir

#: Edges, rows of 16 bytes, that one task joins.
FINISH = 1 << 19


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node go to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and the node, go to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def least_nodes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node of the component of each) of a few edges."""
    nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        low = np.minimum(root[x], root[y])
        # The roots of both ends learn of the lower one, then every node takes the root of its root.
        for end in (root[x], root[y], x, y):
            np.minimum.at(root, end, low)
        root = root[root]
        if (root == before).all():
            return nodes, nodes[root]


def _finished(edges: DataFrame) -> DataFrame:
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            a.append(batch.column("a").to_numpy())
            b.append(batch.column("b").to_numpy())
        nodes, roots = least_nodes(np.concatenate(a), np.concatenate(b))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["node", "root"])

    return edges.select("a", "b").coalesce(1).mapInArrow(join, "node long, root long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge: edges have two columns of 64-bit numbers, root is the least node."""
    spark = edges.sparkSession
    a, b = (F.col(c) for c in edges.columns[:2])
    path, mark = work_dir(spark, "stars"), None
    edges.select(a.cast("long").alias("a"), b.cast("long").alias("b")).filter("a <> b").distinct().write.parquet(path)
    while True:
        now = spark.read.parquet(path)
        told = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if told[0] <= FINISH:
            return _finished(now)
        if tuple(told) == mark:
            break
        path, before, mark = work_dir(spark, "stars"), path, tuple(told)
        _small_star(_large_star(now)).write.parquet(path)
        drop_work_dir(spark, before)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
