import gc
import hashlib
import random
import time

import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from voxloom.llm import bpe

PATH, PATTERN = bpe.default_tokenizer()


@pytest.fixture(scope="module")
def own():
    return bpe.Codec(PATH, PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


TEXTS = [
    "", " ", "  ", "a", "   \n\n x  ", "aaaaaaaaaa" * 300, "ab" * 4000, "\x1c\x85 x y", "héllo wörld 你好" * 20, "I'm they'LL 123456 \x00 \x00!!  ", " " * 500 + "x", "👍🏽" * 100,
    "".join(random.Random(1).choice("abcdeé ñ\n1!") for _ in range(20000)), "".join(random.Random(2).choice("thenrs") for _ in range(300)), "x. y,z  w", "'s it's 'S",
]


def test_same_as_library(own, library):
    ids, named = own.encode(TEXTS)
    for t, i, n in zip(TEXTS, ids, named):
        assert i.tolist() == library.encode_ordinary(t)
        assert n == ",".join(map(str, i.tolist()))
    assert own.decode(ids) == [t.encode() for t in TEXTS]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_any_text(own, library, texts):
    ids, _ = own.encode(texts)
    assert [x.tolist() for x in ids] == [library.encode_ordinary(t) for t in texts]
    assert own.decode(ids) == [t.encode() for t in texts]


def test_very_long_words(own, library):
    """Unbroken runs of up to 100,000 letters: the library's ids, and in time that grows with their length."""
    rng = random.Random(9)
    runs = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (1025, 5001, 100_000)]
    runs += ["a" * 6000, "ab" * 2000, "the" * 2000, "é" * 2000, "".join(rng.choice(["tion", "der", "é", "ing", "x", "qu"]) for _ in range(4000)), "x" * 1024, "=" * 3000, "Aa" * 900]
    began = time.time()
    assert own.encode([runs[2]])[0][0].tolist() == library.encode_ordinary(runs[2]) and time.time() - began < 60
    for got, text in zip(own.encode(runs)[0], runs):
        assert got.tolist() == library.encode_ordinary(text)


def test_seams_that_do_not_fit(own, library, monkeypatch):
    """Small blocks and narrow seams, where many words fall back to the whole recursion."""
    monkeypatch.setattr(bpe, "WHOLE", 6)
    monkeypatch.setattr(bpe, "BLOCK", 5)
    monkeypatch.setattr(bpe, "SEAM", 1)
    rng = random.Random(10)
    words = ["".join(rng.choice(["tion", "er", "e", "ing", "x", "an", "th", "é"]) for _ in range(rng.randrange(2, 30))).encode() for _ in range(400)]
    for got, w in zip(own.words(words), words):
        assert got.tolist() == library._encode_single_piece(w)


@pytest.mark.parametrize("name,bound", [("CACHE", 5), ("CACHED", 100)])
def test_memo_is_bounded(own, library, monkeypatch, name, bound):
    monkeypatch.setattr(bpe, name, bound)
    for t in TEXTS[:5] + TEXTS[8:12]:
        assert own.encode([t])[0][0].tolist() == library.encode_ordinary(t)
    assert len(own.named) <= bound or own.held <= 10 * max(map(len, TEXTS)) + bound


def test_unknown_id(own):
    with pytest.raises(ValueError):
        own.decode([[50_300]])


def test_frames(spark, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (3, "a"), (None, "null id")]
    df = spark.createDataFrame([(t, d, "x", 7) for d, t in rows], "text string, doc_id long, ids string, n_tokens int")
    want = sorted(((d, len(e := library.encode_ordinary(t or "")), hashlib.sha256(",".join(map(str, e)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows), key=str)
    assert sorted(map(tuple, bpe.digests(df, PATH, PATTERN).collect()), key=str) == want
    back = bpe.decode(bpe.encode(df, PATH, PATTERN), PATH, PATTERN).collect()
    assert sorted((str(r.doc_id), bytes(r.bytes)) for r in back) == sorted((str(d), (t or "").encode()) for d, t in rows)
    kept = bpe.with_ids(df, PATH, PATTERN)
    assert kept.columns == ["text", "doc_id", "ids", "n_tokens", "input_ids"] and all(r.n_tokens == len(r.input_ids) and r.ids == "x" for r in kept.collect())
    empty = df.limit(0)
    assert bpe.digests(empty, PATH, PATTERN).collect() == bpe.encode(empty, PATH, PATTERN).collect() == bpe.with_ids(empty, PATH, PATTERN).collect() == []


def test_with_ids_keeps_no_codec(spark, library, monkeypatch):
    """A worker that has ended a partition holds no codec while it is idle or works for another stage."""
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    monkeypatch.setattr(bpe, "_CODECS", {})
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)
    run = bpe.with_ids(docs, PATH, PATTERN)
    alive = lambda: sum(isinstance(x, bpe.Codec) for x in gc.get_objects())
    gc.collect()
    before = alive()
    for _ in range(2):
        out = list(run(iter([pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["unwritable texts", None]})])))
        assert [x.column("input_ids").to_pylist() for x in out] == [[library.encode_ordinary("unwritable texts"), []]]
    assert alive() == before
