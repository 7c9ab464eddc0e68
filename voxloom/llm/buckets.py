"""Links between classes that share a bucket in at least one of several hash tables, without listing pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.common import cut, give_back
from voxloom.llm.components import forest

BLOCK, TILE, SMALL = 4096, 512, 500_000


def pair_links(codes_a, codes_b, a, b, t: int, near, same: bool):
    """Index pairs of members a, b of one bucket of table t that are near and did not meet in an earlier table."""
    for i in range(0, len(a), TILE):
        for j in range(i if same else 0, len(b), TILE):
            x, y = np.nonzero(near(a[i : i + TILE], b[j : j + TILE]))
            x, y = x + i, y + j
            if same:
                x, y = x[x < y], y[x < y]
            if t and len(x):
                new = ~(codes_a[x, :t] == codes_b[y, :t]).any(axis=1)
                x, y = x[new], y[new]
            if len(x):
                yield x, y


def bucket_links(spark: SparkSession, units: DataFrame, buckets: int, members, near, block: int = BLOCK, counted: bool = True) -> DataFrame:
    """(c, c2, links, r, r2): for each class and group its links there, by members, and its root in the group's forest.

    units: c, c2 (long, the class), m (its members), v (what is compared), codes array<int> (its bucket in each table).
    members(column) makes the matrix of a column of v; near(a, b) says which rows of two matrices are linked; buckets is an
    upper bound of the number of buckets, whose sizes are broadcast if it is small; else only those of buckets of over a block
    are, which are the `block`-th part of the placed rows at most, so rows are shuffled once. With counted=False a pair that
    meets in several tables counts in each of them, and the codes that tell this are not shuffled.

    Block i of a bucket meets block j >= i, and each pair of blocks is a group, so a large bucket is spread over tasks. Rows
    are sorted by group and streamed; no Python call per group and no list of pairs leaves a task.
    """
    placed = units.select("c", "c2", "m", "v", ("codes" if counted else F.array().cast("array<int>").alias("codes")), F.posexplode("codes").alias("t", "code"))
    sizes = placed.groupBy("t", "code").agg(F.count("*").alias("n")).where("n > 1").select("t", "code", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    if buckets <= SMALL:
        placed = placed.join(F.broadcast(sizes), ["t", "code"])
    else:
        placed = placed.join(F.broadcast(sizes.where("blocks > 1")), ["t", "code"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("c2", "c"), F.col("blocks")).cast("int")
    met = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("t", "code", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "c", "c2", "m", "v", F.slice("codes", F.lit(1), F.col("t")).alias("codes") if counted else "codes")

    def compare(key, side, v, code, m, c, c2):
        t, _, i, j = key
        t = t if counted else 0
        n = len(c)
        a, b = np.flatnonzero(side == i), np.flatnonzero(side == j)
        links, root = np.zeros(n, np.int64), np.arange(n)
        for x, y in pair_links(code[a], code[b], v[a], v[b], t, near, i == j):
            x, y = a[x], b[y]
            links += np.bincount(x, m[y], n).astype(np.int64) + np.bincount(y, m[x], n).astype(np.int64)
            if (root[x] != root[y]).any():
                root = forest(root[x], root[y], n)[root]
        at = np.flatnonzero(links)
        return c[at], c2[at], links[at], c[root[at]], c2[root[at]]

    def compare_sorted(parts):
        def done(held: pa.Table):
            held = held.combine_chunks()
            key = [held.column(k).to_numpy() for k in ("t", "code", "i", "j")]
            side, m, c, c2 = (held.column(k).to_numpy() for k in ("own", "m", "c", "c2"))
            v, codes = members(held.column("v").combine_chunks()), held.column("codes").combine_chunks()
            flat, at = codes.flatten().to_numpy(), codes.offsets.to_numpy()
            at = at - at[0]
            first = np.flatnonzero(np.concatenate(([True], np.any([k[1:] != k[:-1] for k in key], axis=0))))
            out = []
            for a, b in zip(first.tolist(), [*first[1:].tolist(), held.num_rows]):
                if b - a > 1:
                    own = tuple(int(k[a]) for k in key)
                    out.append(compare(own, side[a:b], v[a:b], flat[at[a] : at[b]].reshape(b - a, own[0] if counted else 0), m[a:b], c[a:b], c2[a:b]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["c", "c2", "links", "r", "r2"])

        held = None
        for part in parts:
            piece = pa.Table.from_batches([part])
            held = piece if held is None else pa.concat_tables([held, piece]).combine_chunks()
            last = np.all([(k := held.column(x).to_numpy()) == k[-1] for x in ("t", "code", "i", "j")], axis=0)
            keep = held.num_rows - int(last.sum())  # the last group may go on
            if keep:
                yield from done(held.slice(0, keep))
                held = held.slice(keep)
        if held is not None and held.num_rows:
            yield from done(held)
        give_back()

    met = met.repartition("t", "code", "i", "j").sortWithinPartitions("t", "code", "i", "j")
    found = met.mapInArrow(compare_sorted, "c long, c2 long, links long, r long, r2 long")
    return cut(spark, found) if counted else found
