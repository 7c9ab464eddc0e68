import json
import time

import pytest
from pyspark.sql import functions as F

from voxloom.streaming.jobs import Heartbeat, KeyPool, cached_stream, acknowledge, model_calls, read_table, run_jobs, upsert
from voxloom.streaming import jobs as J
from voxloom.sources.readers import parse_job


def test_job_loop(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "1.txt").write_text('{"conversationId": "c1", "tenant_id": "t", "file_urls": ["a"]}\n{bad\n{"conversationId": "c2", "path": "p"}\n')
    acks = []

    def work(jobs):
        ok = F.col("conversation_id") == "c1"
        return jobs.withColumns({"description": F.lit("done"), "bucket": F.lit("b"), "object_key": F.when(ok, F.lit("k"))})

    def start():
        stream = spark.readStream.schema("value string").text(str(src))
        q = run_jobs(spark, stream, work, out, lambda df: acks.extend(df.collect()), str(tmp_path / "checkpoint"))
        q.awaitTermination(120)
        assert q.exception() is None

    start()
    (src / "2.txt").write_text('{"conversationId": "c1", "tenant_id": "t", "file_urls": ["a"]}\n')  # delivered again
    start()
    assert sorted(r.conversation_id for r in read_table(spark, f"{out}/jobs").collect()) == ["c1", "c2"]
    assert [r.value for r in spark.read.parquet(f"{out}/poison").collect()] == ["{bad"]
    said = {(r.key, (v := json.loads(r.value))["message"], v.get("summaryObjectKey")) for r in acks}
    assert said == {("c1", "SUCCESS", "k"), ("c2", "FAILURE", None)}


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    upsert(spark, path, make(("a", 1), ("b", 1), ("a", 2)), "k", "v")
    upsert(spark, path, make(("b", 3)), "k", "v")
    assert sorted(map(tuple, read_table(spark, path).collect())) == [("a", 2), ("b", 3)]
    assert read_table(spark, path + "-none") is None


def test_upsert_survives_a_crash_at_any_point(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    make = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    rows = lambda: sorted(map(tuple, read_table(spark, path).collect()))
    every = [(f"k{i}", 1) for i in range(40)]
    upsert(spark, path, make(*every), "k", "v", buckets=4)
    # killed while the new version is written: some files, but no mark of completion
    half = tmp_path / "t" / "v=2" / "_vx_bucket=0"
    half.mkdir(parents=True)
    (half / "part-0.parquet").write_bytes(b"half a file")
    assert rows() == sorted(every)
    # killed between the new version and the removal of old ones
    monkeypatch.setattr(J, "_drop_old", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
    for v in (2, 3):
        with pytest.raises(KeyboardInterrupt):
            upsert(spark, path, make(("k1", v)), "k", "v", buckets=4)
        assert rows() == sorted([("k1", v), *(x for x in every if x[0] != "k1")])
    monkeypatch.undo()
    upsert(spark, path, make(("k1", 3)), "k", "v", buckets=4)  # the batch again
    assert rows() == sorted([("k1", 3), *(x for x in every if x[0] != "k1")])
    assert sum(x.is_dir() for x in (tmp_path / "t").glob("v=*/_vx_bucket=*")) <= 2 * 4 + 1  # the bucket's old versions are gone


def test_acknowledgements_echo_fields_with_their_types(spark):
    sent = [
        {"conversationId": "c1", "userId": "u", "isUser": True, "path": "a/b.wav", "data": "{}", "grading": None, "metaData": {"a": [1, 2.5, {"x": None}]}, "themes": [], "secret": 1},
        {"isUser": "true", "path": "", "queryId": 7, "file_urls": ["x"]},
    ]
    jobs = parse_job(spark.createDataFrame([(json.dumps(x), i) for i, x in enumerate(sent)], "value string, n int"), "value")
    done = jobs.withColumns({"description": F.lit("word " * 100), "bucket": F.lit("b"), "object_key": F.when(F.col("n") == 0, "k/1.docx")})
    a, b = (json.loads(r.value) for r in acknowledge(done).orderBy("key").collect()[::-1])
    assert {k: a[k] for k in sent[0] if k not in ("secret", "path")} == {k: v for k, v in sent[0].items() if k not in ("secret", "path")}
    assert a["isUser"] is True and a["grading"] is None and a["path"] == "b/k/1.docx" == f"{a['summaryBucketName']}/{a['summaryObjectKey']}" and "secret" not in a
    assert b["isUser"] == "true" and b["path"] == "" and b["queryId"] == 7 and b["message"] == "FAILURE"
    assert not {"summaryBucketName", "summaryObjectKey", "conversationId", "userId", "data", "grading"} & set(b)
    assert len(a["description"]) <= 400 and a["description"].endswith("word…")


def test_model_calls_report_failures(spark):
    def client():
        def ask(p):
            if p == "bad":
                raise TimeoutError(p)
            return p + "!"

        return ask

    got = {r.k: (r.reply, r.reason) for r in model_calls(spark.createDataFrame([(1, "a"), (2, "bad"), (3, "a")], "k int, p string"), "k", "p", client).collect()}
    assert got == {1: ("a!", None), 2: (None, "TimeoutError"), 3: ("a!", None)}


def test_cache(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"k": "x", "v": "1"}\n{"k": "x", "v": "2"}\n{"k": "y", "v": "3"}\n')
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = cached_stream(spark.readStream.schema("k string, v string").json(str(src)), "k", "v")
        q = stream.writeStream.format("memory").queryName("cached").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted(map(tuple, spark.table("cached").collect()))
    assert len(got) == 3 and sum(not hit for _, _, hit in got) == 2 and len({v for k, v, _ in got if k == "x"}) == 1


def test_key_pool():
    now = [0.0]
    pool = KeyPool(["a", "b", "a"], 60, lambda: now[0])
    assert [pool.take() for _ in range(3)] == ["a", "b", "a"]
    pool.refused("b")
    assert [pool.take() for _ in range(2)] == ["a", "a"]
    pool.refused("a")
    assert pool.take() == "b"  # both rest; b is free first
    now[0] = 61
    pool.invalid("a")
    assert [pool.take() for _ in range(2)] == ["b", "b"]
    pool.invalid("b")
    with pytest.raises(LookupError):
        pool.take()


def test_heartbeat(spark, tmp_path):
    beats = []
    own = Heartbeat(beats.append)
    spark.streams.addListener(own)
    try:
        (tmp_path / "a.txt").write_text("x\n")
        q = spark.readStream.schema("value string").text(str(tmp_path)).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "_c")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        for _ in range(50):
            if len(beats) >= 2:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(own)
    assert len(beats) >= 2
