import random

import numpy as np
import pyarrow as pa

from voxloom.llm.buckets import bucket_links
from voxloom.llm.common import Members, slices
from voxloom.llm.components import connected_components, forest


def roots(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]
    edges += [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5001 + i) for i in range(300)] + [(-5, -7), (2**62, -(2**62))] + [edges[0]] * 3
    df = spark.createDataFrame([*edges, (None, 3), (4, None), (77, 77)], "x long, y long")
    got = {r.id: r.component for r in connected_components(spark, df).collect()}
    assert got == roots([e for e in edges if e[0] != e[1]])
    assert connected_components(spark, df.limit(0)).collect() == []


def test_forest():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 300, 200), rng.integers(0, 300, 200)
    want = roots(list(zip(a.tolist(), b.tolist())))
    assert forest(a, b, 300).tolist() == [want.get(i, i) for i in range(300)]


def test_members(spark):
    keys = np.random.default_rng(3).integers(-(2**63), 2**63, 500)
    some = Members(spark, spark.createDataFrame([(int(k),) for k in keys], "k long"))
    other = np.random.default_rng(4).integers(-(2**63), 2**63, 20_000)
    assert some(keys).all() and some(other).mean() < 0.1
    assert not Members(spark, spark.createDataFrame([], "k long"))(keys).any()


def test_slices():
    part = pa.record_batch({"i": list(range(6)), "t": ["a" * 5, None, "b" * 20, "", "c" * 3, "d"]})
    got = [x.column(0).to_pylist() for x in slices(part, 1, 8)]
    assert sum(got, []) == list(range(6)) and [2] in got


def test_bucket_blocks_count_each_pair_once(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 4))
    v /= np.linalg.norm(v, axis=1)[:, None]
    codes = rng.integers(0, 3, (60, 5))
    rows = [(i, -i, 1 + i % 2, x.tolist(), c.tolist()) for i, (x, c) in enumerate(zip(v, codes))]
    df = spark.createDataFrame(rows, "c long, c2 long, m long, v array<double>, codes array<int>")
    near = v @ v.T >= 0.5
    meet = (codes[:, None, :] == codes[None, :, :]).any(axis=2)
    want = {i: int(sum(1 + j % 2 for j in range(60) if j != i and near[i, j] and meet[i, j])) for i in range(60)}
    for block in (100, 4):
        found = bucket_links(spark, df, 15, lambda c: c.flatten().to_numpy().reshape(len(c), 4), lambda a, b: a @ b.T >= 0.5, block)
        got = {r.c: r.n for r in found.groupBy("c").agg({"links": "sum"}).withColumnRenamed("sum(links)", "n").collect()}
        assert got == {i: n for i, n in want.items() if n}
        edges = [(r.c, r.r) for r in found.collect() if r.c != r.r]
        assert roots(edges) == roots([(i, j) for i in range(60) for j in range(60) if i != j and near[i, j] and meet[i, j]])


def test_bucket_rows_are_shuffled_once_without_codes(spark, monkeypatch):
    """Sizes of many buckets are no join that shuffles rows and codes again, and large buckets still meet as a whole."""
    from voxloom.llm import buckets

    monkeypatch.setattr(buckets, "SMALL", 0)
    rng = np.random.default_rng(7)
    rows = [(i, i, 1, float(rng.integers(0, 4)), [0, int(rng.integers(0, 9))]) for i in range(60)]
    df = spark.createDataFrame(rows, "c long, c2 long, m long, v double, codes array<int>")
    found = bucket_links(spark, df, 18, lambda c: c.to_numpy(), lambda a, b: a[:, None] == b[None, :], 8, counted=False)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString() and "slice" not in plan
    got = roots(found.where("c != r").select("c", "r").collect())
    want = {}
    for c, _, _, v, _ in rows:
        want.setdefault(v, []).append(c)
    assert {frozenset(k for k in got if got[k] == r) for r in set(got.values())} == {frozenset(x) for x in want.values() if len(x) > 1}
