import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from voxloom.llm import decontam, quality, suffix_dedup


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    d, docs, out = "/root/testdata/sf0.01", None, []
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out.append(docs)
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        at = str(tmp_path_factory.mktemp("stage") / str(i))
        f(spark, docs, d).write.parquet(at)
        docs = spark.read.parquet(at)
        out.append(docs)
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "simhash near-dedup", "suffix-array dedup", "benchmark decontamination", "byte-level BPE"]
    assert all(sorted(x.columns) == sorted(stages[0].columns) for x in stages[:-1])


def test_quality(spark, stages):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = labels.join(stages[1], "doc_id", "left_semi").groupBy("quality").count().collect()
    total = labels.groupBy("quality").count().collect()
    kept, total = dict(map(tuple, kept)), dict(map(tuple, total))
    assert kept[1] >= 0.99 * total[1] and kept.get(0, 0) <= 0.15 * total[0]


def similarity(a, b):
    def grams(x):
        w = x.lower().split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b)


def test_near_duplicates(stages):
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in stages[1:3])
    assert set(after) < set(before) and len(set(after.values())) == len(after)
    gone = {i: t for i, t in before.items() if i not in after}
    near = {i: max((similarity(t, x) for j, x in before.items() if j != i and abs(len(x) - len(t)) < 0.6 * len(t) + 10), default=0) for i, t in list(gone.items())[:60]}
    assert min(near.values()) > 0.6  # nothing unlike all others goes


def test_repeats(stages):
    before, after = ({r.doc_id: r for r in x.collect()} for x in stages[2:4])
    assert set(before) == set(after) and all(r.n_chars == len(r.text) for r in after.values())
    assert all(len(after[i].text) <= len(before[i].text) for i in before)
    seen, n = set(), suffix_dedup.LENGTH
    for i in sorted(after):
        raw = after[i].text.encode()
        own = {raw[k : k + n] for k in range(len(raw) - n + 1)} if before[i].text == after[i].text else set()
        assert not own & seen
        seen |= own


def test_decontamination(spark, stages):
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    found = {r.doc_id for r in decontam.find_items(stages[3], items).collect()}
    before, after = ({r.doc_id for r in x.select("doc_id").collect()} for x in stages[3:5])
    assert after == before - found and found and decontam.find_items(stages[4], items).isEmpty()


def test_ids(spark, stages):
    from voxloom.llm import bpe

    out = stages[5]
    assert out.count() == stages[4].count() and out.where(F.size("input_ids") != F.col("n_tokens")).isEmpty()
    back = bpe.decode(out.select("doc_id", F.col("input_ids").alias("ids")), *bpe.default_tokenizer())
    assert back.join(out, "doc_id").where(F.encode("text", "utf-8") != F.col("bytes")).isEmpty()


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.01")
    same = lambda x: sorted((r.doc_id, r.text, r.n_tokens) for r in x.collect())
    assert same(got) == same(stages[5])


def test_threshold():
    assert quality.THRESHOLD == 0.3


@pytest.mark.parametrize("k", range(5))
def test_stages_bear_odd_rows(spark, k):
    """Null, empty and very long texts, null and repeated ids, repeated rows, columns with clashing names; and an empty table."""
    d = "/root/testdata/sf0.001"
    item = spark.read.parquet(f"{d}/benchmark.parquet").orderBy("item_id").first().text
    prose = " ".join(f"word{i * i % 977}" for i in range(120))
    rows = [(1, prose), (1, prose), (2, None), (3, ""), (None, "a null id"), (4, " ".join(f"{i}" for i in range(30_000))), (5, f"{prose} and then {item}"), (5, "another text of this id"), (6, "short")]
    extra = "doc_id long, text string, score double, _found long, h long, lo long, n long, key string, component long, n_chars long"
    docs = spark.createDataFrame([(i, t, 0.5, 1, 2, 3, 4, "x", 5, len(t or "")) for i, t in rows], extra)
    name, stage = corpus_pipeline.STAGES[k]
    got = stage(spark, docs, d)
    out = got.collect()
    assert set(docs.columns) <= set(got.columns) and all((r.score, r._found, r.h, r.lo, r.n, r.key, r.component) == (0.5, 1, 2, 3, 4, "x", 5) for r in out)
    if name == "simhash near-dedup":
        assert sorted((r.doc_id or 0, r.text or "") for r in out) == sorted({(i or 0, t or "") for i, t in rows if i != 3})  # of two empty texts one stays
    if name == "suffix-array dedup":
        assert len(out) == len(rows) and all(r.n_chars == len(r.text or "") for r in out if r.text is not None)
    if name == "benchmark decontamination":
        assert sorted(map(str, ((r.doc_id, r.text) for r in out))) == sorted(map(str, (x for x in rows if x[1] is None or item not in x[1])))
    if name == "byte-level BPE":
        assert len(out) == len(rows) and all(r.n_tokens == len(r.input_ids) and bool(r.text) == bool(r.input_ids) for r in out)
    assert stage(spark, docs.limit(0), d).count() == 0
