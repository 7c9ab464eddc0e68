import math

import numpy as np
import pytest

from voxloom.llm.embedding_dedup import near_vectors, op3_embeddings, plan


def brute(rows, least=0.95):
    """vec ids -> (links, component) from all pairs."""
    ok = [i for i, (_, v) in enumerate(rows) if v and len(v) == len(rows[0][1]) and None not in v and all(map(math.isfinite, v)) and any(v)]
    m = np.array([rows[i][1] for i in ok], np.float64)
    m /= np.linalg.norm(m, axis=1)[:, None]
    near = m @ m.T >= least
    np.fill_diagonal(near, False)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in zip(*np.nonzero(near)):
        x, y = find(ok[a]), find(ok[b])
        if x != y:
            root[max(x, y)] = min(x, y)
    links = dict(zip(ok, near.sum(1)))
    least_id = {}
    for i, (v, _) in enumerate(rows):
        r = find(i)
        least_id[r] = v if least_id.get(r) is None else min(least_id[r], v if v is not None else least_id[r])
    return [(v, int(links.get(i, 0)), least_id[find(i)]) for i, (v, _) in enumerate(rows)]


def data(seed=3, copies=150):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(300, 24))
    near = v[0] + rng.normal(size=(copies, 24)) * 0.12  # one large group around a vector
    pairs = v[50:90] + rng.normal(size=(40, 24)) * 0.2
    rows = [x.astype(np.float32).tolist() for x in (*v, *near, *pairs, *v[10:20], *v[10:14])]
    rows += [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23, [1.0] * 3, (np.array(rows[5]) * 1e-30).tolist(), (np.array(rows[6]) * 1e30).tolist()]
    ids = rng.permutation(len(rows)).tolist()
    return list(zip(ids, rows))


@pytest.mark.parametrize("block", [4096, 7])
def test_against_all_pairs(spark, block):
    rows = data()
    df = spark.createDataFrame([(0, i, v, "x") for i, v in rows], "c int, vec_id long, embedding array<float>, m string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(spark, df, block=block).collect()}
    want = {i: (n, c, i == c) for i, n, c in brute(rows)}
    assert len(got) == len(rows)
    found, total = sum(g[0] for g in got.values()), sum(w[0] for w in want.values())
    assert 0.99 * total <= found <= total and all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)


def test_null_ids_and_repeats(spark):
    v, w = [1.0, 0.0], [0.0, 1.0]
    rows = [(None, v), (3, v), (3, v), (5, w), (None, None)]
    got = sorted(map(tuple, near_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=str)
    assert got == sorted([(None, 2, 3, False), (3, 2, 3, True), (3, 2, 3, True), (5, 0, 5, True), (None, 0, None, False)], key=str)


def test_empty(spark):
    assert near_vectors(spark, spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_plan():
    for n in (0, 1, 500, 10**5, 10**9):
        tables, bits = plan(n)
        p = (1 - math.acos(0.95) / math.pi) ** bits
        assert (1 - p) ** tables <= 0.002 and 1 <= tables < 300


def test_query(spark):
    got = op3_embeddings(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 500 and all(r.n_links == 0 and r.kept for r in got)


def test_links_through_null_ids(spark):
    """Whichever class is the root of a group, its vectors without an id neither divide it nor take its name."""
    import numpy as np

    from voxloom.llm.embedding_dedup import near_vectors

    rng = np.random.default_rng(17)
    for _ in range(3):
        base = rng.normal(size=24)
        near = [(base + 1e-3 * rng.normal(size=24)).tolist() for _ in range(8)]
        rows = [(None if i % 2 else 20 + i, v) for i, v in enumerate(near)]
        got = near_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
        assert {(r.n_links, r.component_id) for r in got} == {(7, 20)} and [r.vec_id for r in got if r.kept] == [20]


def test_vectors_of_several_lengths(spark):
    """Each length links among itself, however rare it is; nothing links across."""
    rng = np.random.default_rng(12)
    common, rare = rng.normal(size=(30, 24)).tolist(), rng.normal(size=(3, 7)).tolist()
    rows = list(enumerate(common)) + [(100 + i, [x * 1.001 for x in v]) for i, v in enumerate(rare)] + [(200 + i, [*v[:-1], v[-1] * 1.01]) for i, v in enumerate(rare)] + [(300, rare[0][:6]), (301, []), (302, [0.0] * 7), (303, [0.0] * 7)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    for i in range(3):
        assert got[100 + i] == (1, 100 + i, True) and got[200 + i] == (1, 100 + i, False)
    assert got[300] == (0, 300, True) and got[301] == (0, 301, True) and got[302] == (0, 302, True) and got[303] == (0, 303, True)
