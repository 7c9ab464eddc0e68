import random

import numpy as np
import pytest
import xxhash

from voxloom.llm import simhash
from voxloom.llm.components import connected_components
from voxloom.llm.simhash import block_links, fingerprint, keep_one, near_duplicates, op10_simhash, route, similar_forest, vantage_tree, verified_links


def slow(text, k=3):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def components(fps, ids):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    a = np.array(fps, np.uint64)
    for i, j in zip(*np.nonzero(np.bitwise_count(a[:, None] ^ a[None, :]) <= 2)):
        x, y = find(i), find(j)
        root[max(x, y)] = min(x, y)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(fps))]


def test_fingerprint():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 300):
        text = " ".join(rng.choice(["A", "b", "Éa", "xyz"]) + str(rng.randrange(99)) for _ in range(n))
        assert fingerprint(text) == slow(text)
    assert fingerprint(None) == 0 and fingerprint("x " * 70_000) == slow("x " * 70_000) and fingerprint("a\x1cb c") == slow("a\x1cb c")


@pytest.mark.parametrize("depth", [0, 3, 6])
def test_tree_loses_no_pair(depth):
    rng = np.random.default_rng(depth)
    base = rng.integers(0, 2**64, 400, dtype=np.uint64)
    flips = np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) for _ in range(3)])
    fps = np.unique(np.concatenate((base, flips, np.array([0, 1, 3, 7, 2**64 - 1], np.uint64))))
    points, radii = vantage_tree(fps[::5], depth)
    got = set()
    for _, rows, home in route(fps, points, radii, 2):
        for a, b in zip(*block_links(fps[rows], home, 2)):
            got.add((int(fps[rows[a]]), int(fps[rows[b]])))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    want = {(int(fps[i]), int(fps[j])) for i, j in zip(*np.nonzero(near)) if fps[i] < fps[j]}
    assert got == want


def texts():
    rng = random.Random(4)
    words = lambda n: [rng.choice("the of and to in".split()) + str(rng.randrange(60)) for _ in range(n)]
    out = [words(rng.randrange(3, 200)) for _ in range(80)]
    for i in range(60):
        w = list(out[i])
        for _ in range(rng.randrange(2)):
            w[rng.randrange(len(w))] = "new"
        out.append(w)
    return [" ".join(w) for w in out] + [None, "", " \n", "one", "ONE", "two words", "x " * 50_000]


@pytest.mark.parametrize("block", [4096, 16])
def test_components(spark, block):
    rows = list(enumerate(texts(), 10))
    rows += [(5, rows[3][1]), (None, rows[4][1]), (12, rows[2][1]), (900, "unlike anything else here at all")]
    df = spark.createDataFrame([(t, d, "x", 0) for d, t in rows], "text string, doc_id long, fp string, component_id int")
    got = sorted(map(tuple, near_duplicates(spark, df, block=block).collect()), key=str)
    fps = [slow(t) for _, t in rows]
    want = components(fps, [d for d, _ in rows])
    assert got == sorted([(d, f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, want)], key=str)


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    fps = [slow(t) for _, t in rows]
    want = {(i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, components(fps, [i for i, _ in rows]))}
    assert set(map(tuple, op10_simhash(spark, d).collect())) == want


def test_keep_one(spark):
    rng = random.Random(9)
    words = lambda n: [rng.choice("the of and to in".split()) + str(rng.randrange(900)) for _ in range(n)]
    base = [words(300) for _ in range(40)]
    rows = [(1000 + i, " ".join(w)) for i, w in enumerate(base)]
    rows += [(i, " ".join(base[i])) for i in range(10)]  # exact copies with smaller ids
    for i in range(10, 30):  # two words of 300 changed: similarity about 0.93
        w = list(base[i])
        w[40], w[200] = "changed", "too"
        rows.append((2000 + i, " ".join(w)))
    for i in range(30, 40):  # far from 0.8
        w = list(base[i])
        for j in range(0, 300, 12):
            w[j] = f"other{j}"
        rows.append((2000 + i, " ".join(w)))
    rows += [(3000, None), (3001, ""), (3002, " "), (1005, " ".join(base[5])), (7, " ".join(base[7])), (None, " ".join(base[8]))]
    df = spark.createDataFrame([(t, d, d, "x") for d, t in rows], "text string, doc_id long, c long, v string")
    got = keep_one(spark, df).collect()
    ids = [r.doc_id for r in got]
    assert len(ids) == len(set(ids)) and all(r.c == r.doc_id and r.v == "x" for r in got)
    assert set(ids) == {*range(10), *range(1010, 1040), *range(2030, 2040), 3000}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(spark, df).collect() == [] and keep_one(spark, df).collect() == []


def test_keep_one_at_the_limit(spark):
    """Pairs on both sides of a similarity of 0.8, of short and long texts, against all pairs."""
    rng, rows = random.Random(12), []
    for i in range(600):
        n = (8, 9, 12, 30, 104, 404, 1004)[i % 7]
        w = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        rows.append((i, " ".join(w)))
        m = n - 4  # shingles; cutting words at the end leaves m - less of m, changing them leaves (m - less) / (m + less)
        if i % 2:
            less = max(1, round(m * rng.choice((0.15, 0.18, 0.2, 0.21, 0.24, 0.28))))
            w = w[: n - less]
        else:
            less = max(1, round(m * rng.choice((0.08, 0.1, 0.11, 0.115, 0.13, 0.16))))
            w = [*w[: n - less], *(f"v{rng.randrange(10**6)}" for _ in range(less))]
        rows.append((10_000 + i, " ".join(w)))

    def grams(x):
        w = x.split()
        return {" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4))}

    def alike(x, y):
        a, b = grams(x), grams(y)
        return 10 * len(a & b) >= 8 * len(a | b)

    text = dict(rows)
    like = {i for i in range(600) if alike(text[i], text[10_000 + i])}
    assert 150 < len(like) < 450
    kept = {r.doc_id for r in keep_one(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(600)) <= kept
    assert not {i for i in range(600) if 10_000 + i not in kept} - like  # nothing goes that is less than 0.8 alike
    assert len({i for i in like if 10_000 + i in kept}) <= 0.02 * len(like)


@pytest.mark.parametrize("crossed", [False, True])
def test_similar_forest(crossed):
    rng = np.random.default_rng(8)
    base = [rng.choice(60, rng.integers(0, 30), replace=False) for _ in range(25)]
    sets = [np.sort(s[rng.random(len(s)) < p]).astype(np.uint64) for s in base for p in (1, 0.95, 0.85)]
    side = rng.integers(0, 2, len(sets)) if crossed else np.zeros(len(sets), int)
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(np.intersect1d(a, b))
            if 10 * both >= 8 * (len(a) + len(b) - both) and (not crossed or side[i] != side[j]):
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    assert similar_forest(np.concatenate(sets), np.array([len(s) for s in sets]), side, 0.8).tolist() == root


def test_verified_links_in_blocks(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = [(i, " ".join([*base[:-1], f"x{i}"])) for i in range(40)] + [(100 + i, f"other text number {i} of its own") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "xxhash64(text) AS c", "xxhash64(1, text) AS c2")
    classes = df.selectExpr("c", "c2", "doc_id AS rep", "100L AS w")
    groups = df.selectExpr("c AS id", "0L AS component")
    for texts in (512, 7):
        edges = verified_links(spark, df, classes, groups, 5, 0.8, False, texts)
        got = {r.component for r in connected_components(spark, edges).collect()}
        assert len(got) == 1 and len({r.id for r in connected_components(spark, edges).collect()}) == 40


def test_components_through_null_ids(spark, monkeypatch):
    """Fingerprints 0b0, 0b11, 0b1111: the ends are four bits apart and meet only in the row without an id."""
    made = {"a": 0, "b": 3, "c": 15, "d": 2**63 + 2**62 + 2**40}
    rows = [(8, "a"), (None, "b"), (5, "c"), (None, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    prints = spark.createDataFrame([(d, made[t] - 2**64 if made[t] >= 2**63 else made[t]) for d, t in rows], "doc_id long, fp long")
    monkeypatch.setattr("voxloom.llm.simhash.fingerprints", lambda docs, k: prints)
    got = {(r.doc_id, int(r.fingerprint, 16)): r.component_id for r in near_duplicates(spark, df).collect()}
    assert got == {(8, 0): 5, (None, 3): 5, (5, 15): 5, (None, made["d"]): None}


def test_keep_one_searches_the_tree(spark, monkeypatch):
    """Near texts whose fingerprints the tree links are found whatever the tables miss, and rounds of tables find the others."""
    rng = random.Random(21)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(400)] for _ in range(30)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)] + [(100 + i, " ".join([*w[:-1], "end"])) for i, w in enumerate(base)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    first = lambda t: simhash.wide_signs(np.unique(simhash._shingle_hashes(t, 5)))[:8].view("<u8")[0]
    near = {i for i in range(30) if np.bitwise_count(first(rows[i][1]) ^ first(rows[30 + i][1])) <= 2}
    assert len(near) > 20
    monkeypatch.setattr(simhash, "ROUND", 5)
    assert {r.doc_id for r in keep_one(spark, df).collect()} == set(range(30))
    none = lambda spark, units, *_, **__: units.selectExpr("c", "c AS r").limit(0)
    monkeypatch.setattr(simhash, "bucket_links", none)
    assert {r.doc_id for r in keep_one(spark, df).collect()} == set(range(30)) | {100 + i for i in range(30) if i not in near}
