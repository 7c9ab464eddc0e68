import zlib

import numpy as np
import pytest

from voxloom.llm import quality as Q


def test_chunks_cover_the_text():
    for n in (0, 1, Q.CHUNK, Q.CHUNK + 1, Q.STRIDE + Q.CHUNK, 5000):
        data = np.arange(n) % 251 + 1
        rows = Q.chunks(data.astype(np.uint8))
        back = np.zeros(len(rows) * Q.STRIDE + Q.CHUNK, np.uint8)
        for i, r in enumerate(rows):
            back[i * Q.STRIDE : i * Q.STRIDE + Q.CHUNK] = r
        assert (back[:n] == data).all() and (len(rows) - 1) * Q.STRIDE < max(n, 1)


def test_activations_are_the_convolution():
    model = Q.Model(np.random.default_rng(1).normal(size=(Q.WIDTH, 256, Q.FILTERS)).astype(np.float32), np.zeros(Q.FILTERS), np.zeros(Q.FILTERS), 0.0)
    row = np.random.default_rng(2).integers(0, 256, (1, Q.CHUNK)).astype(np.uint8)
    act = Q.activations(model.pairs(), row)
    for at in (0, 7, Q.CHUNK - Q.WIDTH):
        assert np.allclose(act[0, at], sum(model.tables[j, row[0, at + j]] for j in range(Q.WIDTH)), atol=1e-4)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = Q.op7_quality(spark, d).collect()
    assert len(got) == 1000
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) >= 0.95


def test_defined_cases(spark):
    docs = spark.createDataFrame([("x", d, t) for d, t in [(1, None), (2, ""), (3, "a b c " * 20_000), (3, "a b c " * 20_000), (None, "z")]], "score string, doc_id long, text string")
    labels = spark.createDataFrame([(2, 1), (3, 0), (3, 1), (4, None), (None, 1)], "doc_id long, quality int")
    rows = Q.score(docs, Q.train(docs, labels)).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert rows[0].score == rows[1].score  # null is empty
    for share, want in (([], 0.5), ([(2, 1)], 1.0)):
        model = Q.train(docs, spark.createDataFrame(share, "doc_id long, quality int"))
        assert Q.score(docs, model).first().score == pytest.approx(want, abs=1e-3)
    assert Q.score(docs.limit(0), Q.train(docs.limit(0), labels)).collect() == []


def slow_probability(model, text):
    """The network place by place, over the whole text."""
    data = text.encode()
    starts = range(0, max(1, len(data) - (Q.CHUNK - Q.STRIDE)), Q.STRIDE) if len(data) > Q.CHUNK else [0]
    total = 0.0
    for a in starts:
        piece = data[a : a + Q.CHUNK].ljust(Q.CHUNK, b"\0")
        sums = [[sum(float(model.tables[j, piece[i + j], f]) for j in range(Q.WIDTH)) for i in range(Q.CHUNK - Q.WIDTH + 1)] for f in range(Q.FILTERS)]
        total += sum(max(max(x) + float(model.bias[f]), 0) * float(model.dense[f]) for f, x in enumerate(sums)) + model.offset
    return 1 / (1 + np.exp(-total / len(starts)))


def test_query_against_a_slow_network(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{d}/{x}.parquet") for x in ("documents", "labels"))
    model = Q.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in Q.op7_quality(spark, d).collect()}
    long = max(texts, key=lambda i: (len(texts[i]) < 6000, len(texts[i])))
    for i in [*sorted(texts)[:6], long]:
        assert abs(got[i].score - slow_probability(model, texts[i] or "")) < 1e-3 and got[i].predicted == (got[i].score >= 0.3)


def test_learns_from_the_whole_of_a_long_text():
    """What tells the labels apart stands in one place of a long text, wherever that is."""
    rng = np.random.default_rng(2)
    plain = lambda n: bytes(rng.choice(np.frombuffer(b"abcdefgh ", np.uint8), n))
    texts, labels = [], []
    for i in range(80):
        a = int(rng.integers(0, 5000))
        texts.append(plain(a) + (b"ZZZZZZZZ" if i % 2 else b"") + plain(5000 - a))
        labels.append(i % 2)
    model = Q.fit(texts, labels, steps=60)
    p = Q.probabilities(model, model.pairs(), texts)
    assert np.mean((p > 0.5) == np.array(labels)) > 0.9
