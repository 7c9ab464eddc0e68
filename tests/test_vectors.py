"""Queries over all vectors against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import vectors as V
from voxloom.plans import inputs

D = "/root/testdata/sf0.001"


def slow_decide(labels, m, support, floor=0.86, thin=0.90, gap=0.06, profile=0.12, drop_gap=0.18, ratio=0.35, most=0.35):
    n, groups, chosen = len(labels), [{i} for i in range(len(labels))], []
    cos = sorted((m[i, j] for i in range(n) for j in range(i)), reverse=True)
    if len(cos) == 1:
        chosen = [(0, 1)] if cos[0] >= thin else []
    elif cos:
        k = max(range(len(cos) - 1), key=lambda x: cos[x] - cos[x + 1])
        if cos[k] - cos[k + 1] >= gap and cos[k] >= floor:
            rest = lambda i, j: max((abs(m[i, x] - m[j, x]) for x in range(n) if x not in (i, j)), default=0)
            chosen = [(i, j) for i in range(n) for j in range(i + 1, n) if m[i, j] >= max(cos[k], floor) and rest(i, j) <= profile]
    for i, j in chosen:
        a, b = next(g for g in groups if i in g), next(g for g in groups if j in g)
        if a is not b:
            groups.remove(b)
            a |= b
    groups = [sorted(g) for g in groups]
    merged = sorted([labels[i] for i in g] for g in groups if len(g) > 1)
    if len(groups) < 3:
        return merged, []
    near = [max(np.mean([m[i, j] for i in a for j in b]) for b in groups if b is not a) for a in groups]
    order = sorted(range(len(near)), key=lambda g: near[g])
    at = max(range(len(near) - 1), key=lambda x: near[order[x + 1]] - near[order[x]])
    low, cohort, step = order[: at + 1], float(np.median([near[g] for g in order[at + 1 :]])), near[order[at + 1]] - near[order[at]]
    if step < drop_gap or not (cohort <= 0 or near[low[-1]] <= ratio * cohort):
        return merged, []
    return merged, sorted(labels[i] for g in low for i in groups[g] if sum(support[labels[x]] for x in groups[g]) <= most)


@pytest.mark.parametrize("soft", [True, False])
def test_decide(soft):
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 6, 15, 40):
        for spread in (0.05, 0.2, 0.6):
            v = rng.normal(size=(max(1, n // 3), 16))[rng.integers(0, max(1, n // 3), n)] + spread * rng.normal(size=(n, 16))
            v /= np.linalg.norm(v, axis=1)[:, None]
            labels, limits = [10 * i for i in range(n)], V._SOFT if soft else {}
            support = dict.fromkeys(labels, 0.1)
            merged, drop = V.decide(labels, v @ v.T, support, **limits)
            want = slow_decide(labels, v @ v.T, support, **limits)
            assert (sorted(map(sorted, merged)), sorted(drop)) == want


def test_decisions_see_every_vector(spark):
    every = V.clusters(spark, D).count()
    assert V.decide_all(spark, D).count() == every
    ids = {r.cluster for r in V.decide_all(spark, D).collect()}
    assert ids == {r.cluster for r in V.clusters(spark, D).collect()}


@pytest.mark.parametrize("block", [2048, 64])
def test_best_per_name(spark, block):
    c, s = V.clusters(spark, D), V.samples(spark, D)
    want, enrolled = {}, s.collect()
    for x in c.collect():
        for y in enrolled:
            want[x.cluster, y.name] = max(want.get((x.cluster, y.name), -2), float(np.dot(x.v, y.v)))
    got = {(r.cluster, r.name): r.score for r in V.best_per_name(c, s, block).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


@pytest.mark.parametrize("block", [2048, 16])
def test_nearest_in_blocks(spark, block):
    c, s = V.clusters(spark, D).where("cluster % 20 = 0"), V.samples(spark, D)
    own = s.collect()
    for x in c.collect():
        order = sorted(((-float(np.dot(x.v, y.v)), y.sample) for y in own))
        got = V.nearest(c.where(F.col("cluster") == x.cluster), s, 5, block).collect()
        assert sorted(r.sample for r in got) == sorted(i for _, i in order[:5])
        break
    assert V.nearest(c, s, None, block).count() == c.count() * s.count()


def test_greedy_sees_every_cluster(spark):
    got = V.join_greedy_one_to_one(spark, D).collect()
    e = inputs.load(spark, D, "embeddings").select(F.col("label"), "vec_id", F.col("embedding").cast("array<double>").alias("v")).collect()
    best = {}
    for x in e:
        for y in e:
            key = x.label, x.vec_id, f"name{y.vec_id % 7}"
            best[key] = max(best.get(key, -2), float(np.dot(x.v, y.v)))
    done, want = set(), set()
    for (m, c, n), score in sorted(best.items(), key=lambda i: (-round(i[1], 4), i[0][1], i[0][2])):
        if round(score, 4) >= 0.1 and (m, "c", c) not in done and (m, "n", n) not in done:
            done |= {(m, "c", c), (m, "n", n)}
            want.add((m, c, n))
    assert {(r.meeting, r.cluster, r.name) for r in got} == want


@pytest.mark.parametrize("side", [1024, 16])
def test_decide_without_the_matrix(monkeypatch, side):
    """Cosines in blocks decide as the whole matrix does, and no block is larger than asked for."""
    monkeypatch.setattr(V, "SIDE", side)
    monkeypatch.setattr(V, "SORTED", 4 * side)
    rng = np.random.default_rng(8)
    for n in (1, 2, 3, 40, 120):
        v = rng.normal(size=(max(1, n // 3), 16))[rng.integers(0, max(1, n // 3), n)] + 0.2 * rng.normal(size=(n, 16))
        v /= np.linalg.norm(v, axis=1)[:, None]
        support = dict.fromkeys(range(n), 0.1)
        for limits in (V._SOFT, {**V._SOFT, "floor": -1.0, "profile": 0.5}, {}):
            merged, drop = V.decide(list(range(n)), V.Cosines(v), support, **limits)
            assert (sorted(map(sorted, merged)), sorted(drop)) == slow_decide(list(range(n)), v @ v.T, support, **limits)
    m = V.Cosines(v)
    assert max(x.size for *_, x, _ in m.blocks()) <= side * side
    top = np.sort((v @ v.T)[np.triu_indices(n, 1)])[::-1]
    k = int(np.argmax(top[:-1] - top[1:]))
    assert np.allclose(m.widest_gap(), (top[k], top[k + 1]))


def test_profiles_and_cohesion_in_blocks(spark):
    """Blocks give what joins of all pairs give, and meetings without a matrix still go through the joins."""
    c = V.clusters(spark, D)
    plain, odd = V.by_form(c)
    assert odd.isEmpty() and plain.count() == c.count()
    key = lambda df: sorted((r.meeting, r.a, r.b, round(r.apart, 3)) for r in df.collect())
    assert key(V.apart_blocks(plain, 0.1, 7)) == key(V.apart_joined(c, 0.1)) != []
    near = {(r.meeting, r.cluster): r.cos for r in V.max_neighbor(V.pairwise(c)).collect()}
    got = {(r.meeting, r.cluster): r.cos for r in V.nearest_in_meeting(plain).collect()}
    assert got.keys() == near.keys() and all(abs(got[k] - near[k]) < 1e-12 for k in got)
    some = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, 3, None), (3, 4, [1.0, float("nan")]), (4, 5, [1.0, 0.0])], "meeting int, cluster long, v array<double>")
    plain, odd = V.by_form(some)
    assert {r.meeting for r in plain.collect()} == {4} and odd.count() == 4


def test_rounded_keeps_the_sign_of_zero(spark):
    """As DuckDB's round(), which the SQL of the cosine queries uses."""
    import duckdb

    xs = [-0.00003, 0.00003, -0.0, 0.0, -0.00005, 0.12346, -1.5, None]
    got = [r.x for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(V.rounded("x", 4).alias("x")).collect()]
    want = [duckdb.execute("SELECT round(?::DOUBLE, 4)", [x]).fetchone()[0] for x in xs]
    assert [repr(x) for x in got] == [repr(x) for x in want]
