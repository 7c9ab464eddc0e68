"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosine, connected components.

Equal vectors form one class and only classes are compared; a class counts its members. Each table hashes a class by the signs
of its products with some random hyperplanes; classes of one bucket are candidates, and a link needs a cosine of at least LEAST
in double precision. A pair that meets in several tables is counted in the first of them, which both codes tell, so no list of
pairs has to be made unique. `plan` sets the bits from the counted classes (about BUCKET in a bucket) and the tables so that a
pair just at the limit is missed with chance MISSED, a closer one with less; the tests measure recall against all pairs.

A bucket is compared in blocks of BLOCK classes: block i meets block j >= i, and each pair of blocks is a group of its own, so
that a bucket with very many near copies is spread over tasks. Matrix products of tiles find the links; a group only returns,
for each class, its number of links and its root in the group's spanning forest, never the pairs. Distributed connected
components join the forests.

Defined cases: vectors that are null, empty, zero, or with null or non-finite components link with nothing; vectors of several
lengths are worked on length by length, as those of different lengths have no cosine; repeated rows (one vec_id) are vectors of their own that share an id; a null vec_id
stays and names no component while another member has an id; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.buckets import BLOCK, bucket_links
from voxloom.llm.common import cut, table
from voxloom.llm.components import connected_components

LEAST, MISSED, BUCKET = 0.95, 0.002, 64


def plan(n: int, least: float = LEAST, missed: float = MISSED, bucket: int = BUCKET) -> tuple[int, int]:
    """(tables, bits) for n vectors: buckets of about `bucket` vectors, and a pair at the limit missed with chance `missed`."""
    bits = min(30, max(8, math.ceil(math.log2(max(1, n) / bucket))))
    p = (1 - math.acos(least) / math.pi) ** bits
    return max(1, math.ceil(math.log(missed) / math.log(1 - p))) if p < 1 else 1, bits


def codes(unit: np.ndarray, tables: int, bits: int, seed: int = 11) -> np.ndarray:
    """Bucket of each unit vector in each table: (vectors, tables)."""
    planes = np.random.default_rng([seed, unit.shape[1]]).normal(size=(unit.shape[1], tables * bits))
    signs = (unit @ planes > 0).reshape(len(unit), tables, bits)
    return (signs * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that can link, and their unit vectors in double precision."""
    rows = [x if x is not None and len(x) == dim and None not in x else None for x in column.to_pylist()]
    ok = np.array([x is not None for x in rows], bool)
    m = np.array([x for x in rows if x is not None], np.float64).reshape(-1, dim)
    good, unit = _unit(m)
    return np.flatnonzero(ok)[good], unit


def _unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(all="ignore"):
        top = np.abs(m).max(axis=1, initial=0)
        good = np.isfinite(m).all(axis=1) & (top > 0)
        m = m[good] / top[good, None]  # so that squares neither overflow nor vanish
    return good, m / np.sqrt((m * m).sum(axis=1))[:, None]


def near_vectors(spark: SparkSession, vectors: DataFrame, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    rows = rows.withColumn("c", F.xxhash64("v")).withColumn("c2", F.xxhash64(F.lit(1), "v"))  # 128 bits name a class
    classes = cut(spark, rows.where("v is not null").groupBy("c", "c2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.any_value("v").alias("v")))
    lengths = classes.where(F.size("v") > 0).groupBy(F.size("v").alias("n")).agg(F.count("*").alias("m")).collect()  # a row for each length
    found = [_links(spark, classes.where(F.size("v") == r.n), r.n, r.m, least, block) for r in lengths]
    found = functools.reduce(DataFrame.union, found) if found else spark.createDataFrame([], "c long, c2 long, links long, r long, r2 long")
    counted = found.groupBy("c", "c2").agg(F.sum("links").alias("links"))
    # classes are the nodes (64 bits name one here), so that a class without an id still links; a component is named afterwards
    component = connected_components(spark, found.where("c != r").select("c", "r"))
    known = classes.select("c", "c2", "rep", "m").join(counted, ["c", "c2"], "left").join(component, F.col("c") == F.col("id"), "left")
    known = cut(spark, known.withColumn("to", F.coalesce("component", "c")).drop("id", "component"))
    known = known.join(known.groupBy("to").agg(F.min("rep").alias("least")), "to")
    # a vector that is nothing to compare does not link with its own copies either
    known = known.join(_comparable(classes).withColumnsRenamed({"c": "_g", "c2": "_g2"}), (F.col("c") == F.col("_g")) & (F.col("c2") == F.col("_g2")), "left_semi")
    known = known.select(F.col("c").alias("_c"), F.col("c2").alias("_c2"), (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("_links"), F.col("least").alias("_to"))
    out = rows.select("vec_id", "c", "c2").join(known, (F.col("c") == F.col("_c")) & (F.col("c2") == F.col("_c2")), "left")
    out = out.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("_to", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _comparable(classes: DataFrame) -> DataFrame:
    """(c, c2) of classes whose vector has a direction."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return classes.where((F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0)).select("c", "c2")


def _links(spark: SparkSession, classes: DataFrame, dim: int, n: int, least: float, block: int) -> DataFrame:
    """Links between n classes of vectors of one length, as bucket_links gives them."""
    tables, bits = plan(n, least)
    kind = dict(classes.dtypes)["v"]

    def hashed(parts):
        for part in parts:
            at, unit = _matrix(part.column(4), dim)
            own, pick = codes(unit, tables, bits) if len(at) else np.zeros((0, tables), np.int32), pa.array(at)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * tables, pa.int32()), pa.array(own.ravel()))
            yield pa.RecordBatch.from_arrays([*(part.column(i).take(pick) for i in range(5)), flat], names=["c", "c2", "rep", "m", "v", "codes"])

    units = cut(spark, classes.mapInArrow(hashed, f"c long, c2 long, rep long, m long, v {kind}, codes array<int>"))

    def members(column: pa.Array) -> np.ndarray:
        return _unit(column.flatten().to_numpy().reshape(len(column), dim).astype(np.float64))[1]

    return bucket_links(spark, units.select("c", "c2", "m", "v", "codes"), tables << bits, members, lambda a, b: a @ b.T >= least, block)


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark, table(spark, sf_dir, "embeddings"))
