import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from voxloom.llm import suffix_dedup
from voxloom.llm.suffix_dedup import PASSAGE, WORDS, SuffixOrder, dedup_text, kept_bytes, long_passages, whole_characters

L = 60


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "délta", "eps", "zeta", "eta", "theta", "iota"]) + str(rng.randrange(40)) for _ in range(n))


def corpus(seed):
    rng = random.Random(seed)
    passages = [words(rng, 14) for _ in range(5)]
    docs = [(i, words(rng, rng.randrange(3, 60))) for i in range(60)]
    docs += [(100 + i, words(rng, rng.randrange(0, 20)) + " " + rng.choice(passages) + " " + words(rng, rng.randrange(0, 20))) for i in range(60)]
    docs += [(200 + i, docs[i][1]) for i in range(12)] + [(300, None), (301, ""), (302, "a" * 500), (303, "ab" * 300), (304, "a" * 500), (None, docs[3][1]), (7, docs[7][1])]
    return docs


def places(docs):
    at = defaultdict(list)
    for k, (_, text) in enumerate(docs):
        raw = (text or "").encode()
        for i in range(len(raw) - L + 1):
            at[raw[i : i + L]].append((k, i))
    return at


def expected(docs):
    drop = [np.zeros(len((t or "").encode()), bool) for _, t in docs]
    for own in places(docs).values():
        if len(own) > 1:
            for k, i in own:
                drop[k][i : i + L] = True
    for (d, t), gone in zip(docs, drop):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        yield d, len(raw), int(gone.sum()), runs, hashlib.sha256(raw[~gone].tobytes()).hexdigest()


@pytest.mark.parametrize("seed,group,heavy", [(1, 8192, 10_000), (2, 8192, 3), (2, 1, 10_000), (4, 4, 5)])
def test_all_copies(spark, monkeypatch, seed, group, heavy):
    monkeypatch.setattr(suffix_dedup, "HEAVY", heavy)
    docs = corpus(seed)
    got = kept_bytes(spark, spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, h string"), L, "none", group).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(expected(docs), key=key)


@pytest.mark.parametrize("group", [8192, 3, 1])
def test_first_stays(spark, group):
    docs = [x for x in corpus(3) if x[0] is not None and x[0] != 7]
    df = spark.createDataFrame([(t, d, d, d) for d, t in docs], "text string, doc_id long, lo long, n long")
    got = {r.doc_id: r for r in dedup_text(spark, df, L, "first", group).collect()}
    assert all(r.lo == r.n == r.doc_id for r in got.values()) and len(got) == len(docs)
    order = {d: i for i, (d, _) in enumerate(sorted(docs))}
    drop = {d: np.zeros(len((t or "").encode()), bool) for d, t in docs}
    for own in places(docs).values():
        own = sorted((order[docs[k][0]], i, docs[k][0]) for k, i in own)
        for _, i, d in own[1:]:
            drop[d][i : i + L] = True
    for d, t in docs:
        raw = (t or "").encode()
        edge = np.flatnonzero(np.diff(np.concatenate(([0], drop[d].astype(int), [0]))))
        out, at = b"", 0
        for a, b in whole_characters(raw, list(zip(edge[::2], edge[1::2]))):
            out, at = out + raw[at:a], b
        assert (got[d].text or "") == (out + raw[at:]).decode(), d


def test_factors():
    rng = np.random.default_rng(5)
    for letters, depth in ((2, 12), (2, 20), (3, 9), (1, 16)):
        data = rng.integers(97, 97 + letters, 120).astype(np.uint8)
        at = np.arange(len(data) - depth + 1)
        order = SuffixOrder(data, at, depth, exact=True)
        raw = data.tobytes()
        common = lambda i, j: next((k for k in range(depth) if raw[i + k] != raw[j + k]), depth)
        assert [raw[i : i + depth] for i in order.sa] == sorted(raw[i : i + depth] for i in at)
        for later in (False, True):
            for i, lpf in zip(*order.factors(1, later)):
                assert lpf == max((common(i, j) for j in at if (j > i if later else j < i)), default=0)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert kept_bytes(spark, df).collect() == [] and dedup_text(spark, df).collect() == []


def test_passages_by_words(spark):
    rng = random.Random(21)
    own = lambda n: " ".join(f"{rng.randrange(10**7)}" for _ in range(n))
    short = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(51)), " ".join(f"w{rng.randrange(1000)}" for _ in range(54)), " ".join(rng.choice(["né", "so", "über"]) + rng.choice("abcdefgh") for _ in range(60))]
    stays = " ".join(f"word{rng.randrange(1000)}" for _ in range(40))  # repeated, but of 40 words and under 400 bytes
    long = "x".join(f"{rng.randrange(10**8)}" for _ in range(50))  # one word of over 400 bytes
    assert all(len(x.encode()) < 400 for x in [*short, stays]) and len(long) > 400
    rows = [(i * 10 + j, f"{own(30)} {x} {own(30)}") for i, x in enumerate([*short, stays, long]) for j in range(3)]
    rows += [(1000 + i, own(200)) for i in range(5)]
    got = {r.doc_id: r.text for r in dedup_text(spark, spark.createDataFrame(rows, "doc_id long, text string"), PASSAGE, words=WORDS).collect()}
    for d, text in rows:
        x = [*short, stays, long][d // 10] if d < 1000 else None
        a, _, b = text.partition(x) if x and x != stays and d % 10 else (text, "", "")
        # what is cut may reach a few bytes into the neighbours, where these happen to agree too
        assert got[d] == text if not b else x not in got[d] and got[d].startswith(a[:-4]) and got[d].endswith(b[4:]) and len(got[d]) <= len(a) + len(b)


def test_short_repeats_that_touch_are_no_passage():
    raw = b" ".join([b"ab"] * 90)
    assert long_passages([[0, 10], [110, 120]], raw, 101, 50) == []
    assert long_passages([[0, 30], [30, 55]], raw, 101, 50) == [(0, 155)]


def test_megabytes_of_one_byte(spark):
    """Texts of one byte make an excerpt for each place; all of them are one string."""
    rows = [(1, "a" * 1_000_000), (2, "b" * 399), (3, "c" * 400), (4, "ab" * 100_000), (5, "".join(f"{i} " for i in range(9000)))]
    got = {r.doc_id: r for r in kept_bytes(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: (r.n_removed, r.n_spans) for d, r in got.items()} == {1: (1_000_000, 1), 2: (0, 0), 3: (0, 0), 4: (200_000, 1), 5: (0, 0)}
    first = {r.doc_id: r.text for r in dedup_text(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: len(x) for d, x in first.items()} == {1: 1, 2: 399, 3: 400, 4: 2, 5: len(rows[4][1])}


def test_halves_hold_every_place_once():
    rng = random.Random(8)
    raw = words(rng, 400).encode()
    n = L - suffix_dedup.GRAM + 1
    want = sorted(range(len(raw) - L + 1))
    every = lambda x: np.ones(len(x), bool)
    for level in range(n.bit_length() + 2):
        rows = [r for part in suffix_dedup.excerpt_rows([raw], L, [every] * level) for r in zip(*(x.tolist() for x in part))]
        assert sorted(a + i for _, a, k, _, _ in rows for i in range(k)) == want
    assert all(r[2] == 1 for r in rows)  # each place by itself in the end, and its group by the whole string
    groups = defaultdict(set)
    for _, a, _, h, _ in rows:
        groups[h].add(raw[a : a + L])
    assert all(len(x) == 1 for x in groups.values())
