import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from voxloom.llm import ngram_lm as lm
from voxloom.llm.elias_fano import EliasFano, encode


@pytest.mark.parametrize("n,top", [(0, 1), (1, 0), (1, 2**62), (500, 40), (500, 2**40), (3000, 3000), (2000, 2**62)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, top + 1, n))
    assert (EliasFano(**encode(v)).values(np.arange(n)) == v).all()  # repeats can be coded, but not searched
    v, n = np.unique(v), len(np.unique(v))
    ef = EliasFano(**encode(v))
    assert (ef.values(np.arange(n)) == v).all()
    ask = np.concatenate((v, v + 1, rng.integers(0, top + 1, 300), [0, top, 2**62]))
    at = ef.find(ask)
    present = np.isin(ask, v)
    assert ((at >= 0) == present).all() and (v[at[present]] == ask[present]).all()


@pytest.mark.parametrize("contexts,n", [(1, 1), (1, 700), (90, 40), (40, 9000), (3000, 3100)])
def test_pointers_and_successors(contexts, n):
    rng = np.random.default_rng(n)
    keys = np.unique((np.minimum(rng.integers(0, contexts, n), rng.integers(0, contexts, n)) << 12) | rng.integers(0, 4096, n))
    ef = EliasFano(**encode(keys, 12))
    lo, hi = ef.children(np.arange(-1, contexts + 3))
    assert [list(range(a, b)) for a, b in zip(lo, hi)] == [np.flatnonzero(keys >> 12 == c).tolist() for c in range(-1, contexts + 3)]
    ask = np.concatenate((keys, rng.integers(0, contexts << 12, 500)))
    at = ef.successor(ask & 4095, *ef.children(ask >> 12))
    present = np.isin(ask, keys)
    assert ((at >= 0) == present).all() and (keys[at[present]] == ask[present]).all()


def q(x):
    return 10 ** (-lm.STEP * min(255, max(0, round(-math.log10(x) / lm.STEP))))


def slow(rows):
    """The model with dictionaries: (rows, probability of a word after the tokens before it)."""
    toks = ["".join(c.lower() if c.isascii() else c for c in t or "").encode().split() + [None] for _, t in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows]
    c, pairs, triples, after, after2 = Counter(), Counter(), Counter(), Counter(), Counter()
    for x, h in zip(toks, held):
        if not h:
            c.update(x)
            c["<s>"] += 1
            pairs.update(zip(["<s>", *x], x))
            triples.update(zip(["<s>", *x], x, x[1:]))
    after.update(a for a, _ in pairs)
    after2.update((a, b) for a, b, _ in triples)
    n, v = sum(m for k, m in c.items() if k != "<s>"), len(c) - ("<s>" in c)
    p1 = lambda w: (c[w] + 0.5) / (n + 0.5 * (v + 1))

    def p2(u, w):
        if not c[u]:
            return p1(w)
        return (q((pairs[u, w] - lm.DISCOUNT) / c[u]) if (u, w) in pairs else 0) + lm.DISCOUNT * after[u] / c[u] * p1(w)

    def p3(u, v, w):
        if (u, v) not in after2:
            return p2(v, w)
        m = pairs[u, v]
        return (q((triples[u, v, w] - lm.DISCOUNT) / m) if (u, v, w) in triples else 0) + q(lm.DISCOUNT * after2[u, v] / m) * p2(v, w)

    out = []
    for (d, _), x, h in zip(rows, toks, held):
        y = ["<s>", *x]
        score = sum(math.log10(p3(y[i - 2], y[i - 1], y[i]) if i > 1 else p2(y[0], y[1])) for i in range(1, len(y)))
        out.append((d, h, len(x), sum(c[w] > 0 for w in x), n, sum(math.log10(p1(w)) for w in x), score))
    return out, p3, [w for w in c if w != "<s>"]


@pytest.mark.parametrize("shard,words", [(1_500_000, 1 << 19), (50, 16)])
def test_against_dictionaries(spark, monkeypatch, shard, words):
    monkeypatch.setattr(lm, "SHARD", shard)
    monkeypatch.setattr(lm, "WORDS", words)
    rng = random.Random(2)
    words = ["the", "of", "AND", "to", "é"] * 8 + [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(200)]
    rows += [(300, None), (301, ""), (302, "a\x1cb   c"), (303, "the " * 3000), (305, " \t\n "), (None, "null id the of"), (7, rows[7][1]), (304, "unseen " * 5)]
    df = spark.createDataFrame([(t, d, "x", 1) for d, t in rows], "text string, doc_id long, h string, n int")
    model = lm.train(spark, df)
    assert shard > 50 or (len(model.cuts) > 20 and len(model.split_ids) and len(model.before) > 8)
    got = sorted(map(tuple, lm.score(df, model).collect()), key=str)
    want, p3, vocabulary = slow(rows)
    assert len(got) == len(want)
    key = lambda r: (r[0] is None, r[0] or 0)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-6), (a, b)
    for u, v in ((b"the", b"of"), (b"w3", b"w4"), ("<s>", b"the"), (b"no", b"no")):  # sums to one, unseen words included
        assert sum(p3(u, v, w) for w in [*vocabulary, b"new"]) == pytest.approx(1, abs=0.06)


def test_very_long_text(spark):
    """A text of 200,000 words, one of a single 300,000-byte word, and many blocks of one trigram in a shard."""
    rng = random.Random(4)
    rows = [(1, " ".join(f"w{int(rng.paretovariate(0.6)) % 5000}" for _ in range(200_000))), (2, "x" * 300_000), (3, "a b c " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r[0]: r for r in slow(rows)[0]}
    for r in lm.score(df, lm.train(spark, df)).collect():
        assert tuple(r)[:5] == want[r.doc_id][:5] and tuple(r)[5:] == pytest.approx(want[r.doc_id][5:], rel=1e-9)


def test_blocks():
    rng = np.random.default_rng(1)
    x = [np.sort(rng.integers(0, 2**63, 50).astype(np.uint64)), rng.integers(0, 2**32, 50), rng.integers(1, 9, 50)]
    assert all((a == b).all() for a, b in zip(lm._unpacked(lm._packed(*x)), x))
    pairs, w, n = lm._joined([lm._unpacked(lm._packed(*x)), lm._unpacked(lm._packed(*x))])[0]
    assert (pairs == x[0]).all() and (w == x[1]).all() and (n == 2 * x[2]).all()


def test_better_than_base_on_held_out_text(spark):
    rng = random.Random(3)
    follow = {f"w{i}": [f"w{(7 * i + k) % 40}" for k in range(3)] for i in range(40)}

    def text():
        w = ["w0"]
        for _ in range(80):
            w.append(rng.choice(follow[w[-1]]))
        return " ".join(w)

    df = spark.createDataFrame([(i, text()) for i in range(200)], "doc_id long, text string")
    held = [r for r in lm.score(df, lm.train(spark, df)).collect() if r.held_out]
    assert len(held) > 20 and all(r.score > 0.6 * r.base_score for r in held)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(df, lm.train(spark, df)).collect() == []
    one = spark.createDataFrame([(i, "x") for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1], "doc_id long, text string")
    got = lm.score(one, lm.train(spark, one)).collect()
    assert got and all(r.held_out and r.n_known == 0 and r.score == r.base_score == 0.0 for r in got)


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = {r[0]: r for r in slow(rows)[0]}
    for r in lm.op6_lm(spark, d).collect():
        assert tuple(r)[:5] == want[r.doc_id][:5] and tuple(r)[5:] == pytest.approx(want[r.doc_id][5:], abs=1e-5)
