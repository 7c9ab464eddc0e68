"""Connected components of a graph that is only held as a distributed table of edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.common import cut


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, int(row.h or 0)


def connected_components(spark: SparkSession, edges: DataFrame, most: int = 60) -> DataFrame:
    """(id, component) for every id that occurs in `edges` (two long columns); component is the least id reachable.

    Large-star and small-star steps alternate until the edges no longer change. Minima are aggregated before they are
    joined back, so a node with very many neighbours is never one row or one Python object. Rows with a null end and
    self links are ignored.
    """
    a, b = edges.columns[:2]
    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    e = cut(spark, e.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))).where(edges[a].isNotNull() & edges[b].isNotNull()).distinct())
    before = _state(e)
    for _ in range(most):
        if not before[0]:
            break
        both = e.union(e.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(least, F.col("u") == F.col("k"))
        e = cut(spark, small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u != v").distinct())
        now = _state(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not converge")
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Root (the least index of its component) of each of n nodes, given links a[i] - b[i]; for one bounded block."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            break
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root
