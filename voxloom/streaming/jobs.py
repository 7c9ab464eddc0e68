"""The job stream: parse, set bad messages aside, work, write idempotently, acknowledge.

Delivery is at least once. Sinks overwrite by key, so a batch that runs again changes nothing: `upsert` keeps the latest row
of each key in versions that only count when complete, and chunk indexes replace all chunks of a file. Spark keeps offsets in the checkpoint and commits them after the
batch, which is after the acknowledgement was written.
"""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as St
from pyspark.sql.streaming import StreamingQueryListener

from voxloom.functions import text as T
from voxloom.operators.chunking import explode_text, word_windows
from voxloom.plans import inputs
from voxloom.plans.registry import query
from voxloom.sources.readers import parse_job

#: Fields of a message that an acknowledgement repeats.
ECHO = ["accessVar", "userId", "isUser", "user", "path", "conversationId", "clientSessionId", "queryId", "metaData", "uploadType", "grading", "data", "themes"]
#: Parts of a keyed table that are rewritten by themselves.
BUCKETS = 64


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the last by order: an aggregate, combined before the shuffle."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.col(order)).alias("x")).select("x.*")


def _versions(spark: SparkSession, path: str) -> tuple[int, dict[int, list[str]]]:
    """(the last version begun, the folders of each bucket in complete versions, from old to new)."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[int, list[str]] = {}
    if not fs.exists(at):
        return 0, found
    names = sorted(int(x.getPath().getName()[2:]) for x in fs.listStatus(at) if x.getPath().getName().startswith("v="))
    for v in names:
        own = f"{path}/v={v}"
        if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{own}/_SUCCESS")):
            for x in fs.listStatus(jvm.org.apache.hadoop.fs.Path(own)):
                if (name := x.getPath().getName()).startswith("_vx_bucket="):
                    found.setdefault(int(name.split("=")[1]), []).append(f"{own}/{name}")
    return (names or [0])[-1], found


def read_table(spark: SparkSession, path: str, only: set[int] | None = None) -> DataFrame | None:
    """The rows of a table that `upsert` keeps: of each bucket the last complete version. None if there is none."""
    at = [x[-1] for k, x in sorted(_versions(spark, path)[1].items()) if only is None or k in only]
    return spark.read.parquet(*at) if at else None


def upsert(spark: SparkSession, path: str, rows: DataFrame, key: str, order: str, buckets: int = BUCKETS) -> None:
    """Write rows into a table of one row a key, in folders path/v=N; `read_table` reads it.

    A batch writes a new version of the buckets that its keys fall into, and of no others. A version counts once Spark has
    marked it complete, so a crash at any point leaves the table as it was or as it shall be, and a batch that runs again
    writes the same rows. The version before is kept for readers that have begun; older ones of the bucket go.
    """
    rows = rows.withColumn("_vx_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    touched = {r[0] for r in rows.select("_vx_bucket").distinct().collect()}  # at most `buckets` rows
    if not touched:
        return
    last, _ = _versions(spark, path)
    old = read_table(spark, path, touched)
    if old is not None:
        rows = rows.unionByName(old.withColumn("_vx_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))
    latest(rows, key, order).write.mode("overwrite").partitionBy("_vx_bucket").parquet(f"{path}/v={last + 1}")
    _drop_old(spark, path, touched)


def _drop_old(spark: SparkSession, path: str, touched: set[int]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for k, own in _versions(spark, path)[1].items():
        for folder in own[:-2] if k in touched else ():
            at = jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(conf).delete(at, True)


def acknowledge(jobs: DataFrame) -> DataFrame:
    """(key, value) of acknowledgements.

    Fields of the message (column `value`, if there is one) that are to be echoed come back with their values and JSON types:
    a string of braces stays a string, null stays null, what is absent stays absent. `conversationId` is the job's, and `path`
    becomes bucket/key on success. Location fields exist only on success.
    """
    done = (F.coalesce("object_key", F.lit("")) != "") & (F.coalesce("bucket", F.lit("")) != "")
    given = F.try_parse_json(F.col("value") if "value" in jobs.columns else F.lit(None).cast("string"))
    echo = {k: F.try_variant_get(given, f"$.{k}", "variant") for k in ECHO}
    text = lambda c: c.cast("variant")
    echo["conversationId"] = F.when(F.coalesce("conversation_id", F.lit("")) != "", text(F.col("conversation_id"))).otherwise(echo["conversationId"])
    echo["path"] = F.when(echo["path"].isNotNull() & done, text(F.concat("bucket", F.lit("/"), "object_key"))).otherwise(echo["path"])
    value = F.struct(
        *(x.alias(k) for k, x in echo.items()), F.col("document_ids").alias("fileIds"), F.col("tenant_id").alias("tenantId"), F.col("compare_mode").alias("compareMode"), F.lit("save").alias("action"),
        F.when(done, "SUCCESS").otherwise("FAILURE").alias("message"), T.capped(F.col("description")).alias("description"),
        F.when(done, F.col("bucket")).alias("summaryBucketName"), F.when(done, F.col("object_key")).alias("summaryObjectKey"),
    )
    return jobs.select(F.col("conversation_id").alias("key"), F.to_json(value).alias("value"))


def run_jobs(spark: SparkSession, messages: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, acks: Callable[[DataFrame], None], checkpoint: str, once: bool = True):
    """Start the loop over a stream with a column `value` (JSON text) and return the query.

    work(jobs) adds description, bucket and object_key (null on failure). Results go to out/jobs by conversation, messages that
    are no JSON to out/poison. acks(frame of key and value) writes acknowledgements, for instance to Kafka.
    """

    def batch(df: DataFrame, number: int) -> None:
        jobs = parse_job(df.select("value"), "value").persist()
        jobs.where("bad").select("value").withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/poison/batch={number}")
        done = work(jobs.where("NOT bad"))
        if not done.isEmpty():
            upsert(spark, f"{out}/jobs", done.select("conversation_id", "description", "object_key", F.lit(number).cast("long").alias("batch")), "conversation_id", "batch")
            acks(acknowledge(done))
        jobs.unpersist()

    w = messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="5 seconds")).start()


def kafka_messages(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """One message a batch, from the earliest; needs the Kafka connector on the class path."""
    s = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return s.option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", "1").load().select(F.col("value").cast("string"))


def kafka_acks(servers: str, topic: str) -> Callable[[DataFrame], None]:
    return lambda df: df.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def model_calls(rows: DataFrame, key: str, prompt: str, client: Callable[[], Callable[[str], str]], tries: int = 3) -> DataFrame:
    """(key, reply, reason): a model's replies, the model boundary. client() is called once a partition and gives the function
    that answers a prompt. Equal prompts are asked once in a partition; a call that raises is tried again, then its reason is
    returned instead of a reply, and nothing is made up."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask, known = client(), {}
        for pdf in parts:
            out = []
            for k, p in zip(pdf["_k"], pdf["_p"]):
                if p not in known or known[p][1]:
                    for _ in range(tries):
                        try:
                            known[p] = (ask(p), None)
                            break
                        except Exception as e:  # the client's own errors are data here
                            known[p] = (None, type(e).__name__)
                out.append((k, *known[p]))
            yield pd.DataFrame(out, columns=[key, "reply", "reason"])

    kind = dict(rows.dtypes)[key]
    return rows.select(F.col(key).alias("_k"), F.col(prompt).alias("_p")).mapInPandas(run, f"{key} {kind}, reply string, reason string")


def cached_stream(rows: DataFrame, key: str, value: str, seconds: int = 3600) -> DataFrame:
    """(key, value, hit): the first value seen for a key answers until it expires."""
    from pyspark.sql.streaming import StatefulProcessor

    schema = St.StructType([St.StructField("value", St.StringType())])

    class Cache(StatefulProcessor):
        def init(self, handle) -> None:
            self.state = handle.getValueState("value", schema, ttlDurationMs=seconds * 1000)

        def handleInputRows(self, k, parts, timer):
            out = []
            for pdf in parts:
                for v in pdf[value]:
                    hit = self.state.exists()
                    if not hit:
                        self.state.update((v,))
                    out.append((k[0], self.state.get()[0], hit))
            yield pd.DataFrame(out, columns=[key, value, "hit"])

        def close(self) -> None:
            pass

    kind = dict(rows.dtypes)[key]
    return rows.groupBy(key).transformWithStateInPandas(Cache(), f"{key} {kind}, {value} string, hit boolean", "Append", "ProcessingTime")


# ---- queries


@query("stream_poison", "SELECT event_id % 3 = 2 AS bad, count(*) AS n FROM events GROUP BY ALL")
def stream_poison(spark, sf_dir):
    """Messages that do not parse are counted and set aside; the rest go on."""
    raw = F.when(F.col("event_id") % 3 == 2, "{broken").otherwise(F.col("props"))
    return parse_job(inputs.load(spark, sf_dir, "events").select(raw.alias("value")), "value").groupBy("bad").agg(F.count("*").alias("n"))


@query("stream_idempotent", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def stream_idempotent(spark, sf_dir):
    """Every message delivered twice leaves one row a key, the latest."""
    e = inputs.load(spark, sf_dir, "events").select("user_id", "event_id")
    return latest(e.unionAll(e), "user_id", "event_id")


@query("stream_single_flight", "SELECT event_type || '/' || (user_id % 10) AS k, count(*) AS n FROM events GROUP BY ALL")
def stream_single_flight(spark, sf_dir):
    """Equal requests are one call: distinct first, then the function, then back by key."""
    e = inputs.load(spark, sf_dir, "events").select(F.concat("event_type", F.lit("/"), (F.col("user_id") % 10).cast("string")).alias("k"))
    replies = model_calls(e.distinct(), "k", "k", lambda: str.upper).select("k", "reply")
    return e.groupBy("k").agg(F.count("*").alias("n")).join(replies, "k").select("k", "n")


@query("snk_index_mom", "SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def snk_index_mom(spark, sf_dir):
    """One document a meeting under a stable id; the latest wins."""
    return latest(inputs.load(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn")


@query("snk_index_translation", "SELECT source, max(doc_id) AS doc_id, arg_max(lang, doc_id) AS lang FROM documents GROUP BY source")
def snk_index_translation(spark, sf_dir):
    return latest(inputs.load(spark, sf_dir, "documents").select("source", "doc_id", "lang"), "source", "doc_id")


@query("snk_chunks")
def snk_chunks(spark, sf_dir):
    """Search chunks of documents with deterministic ids, file_page_paragraph."""
    x = explode_text(inputs.load(spark, sf_dir, "documents"), "doc_id", "text", word_windows, "text")
    return x.select(F.concat_ws("_", F.col("doc_id").cast("string"), F.lit("1"), F.col("no").cast("string")).alias("id"), F.col("doc_id").alias("fId"), F.lit(1).alias("pageNo"), F.col("no").alias("para"), "text", F.lit(False).alias("in_trash"))


_ACK = """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'SUCCESS' ELSE 'FAILURE' END AS message, CASE WHEN c_custkey % 2 = 0 THEN 's/' || c_name END AS object_key, '"u' || c_custkey || '"' AS user_id,
    CASE c_custkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN '"true"' END AS is_user, '{"deep":[1,null],"n":' || c_custkey || '}' AS meta, '"{}"' AS data, CASE WHEN c_custkey % 2 = 0 THEN '"b/s/' || c_name || '"' ELSE '""' END AS path,
    '"' || c_custkey || '"' AS conversation, 'null' AS grading FROM customer"""


@query("snk_kafka_ack", _ACK)
def snk_kafka_ack(spark, sf_dir):
    """Acknowledgements of parsed messages, each echoed field as the JSON it is."""
    k = F.col("c_custkey")
    parts = [F.lit('{"conversationId":"'), k, F.lit('","userId":"u'), k, F.lit('","path":"","grading":null,"data":"{}","metaData":{"deep":[1,null],"n":'), k, F.lit("}"), F.when(k % 3 == 0, ',"isUser":true').when(k % 3 == 1, ',"isUser":"true"').otherwise(""), F.lit(',"other":1}')]
    raw = inputs.load(spark, sf_dir, "customer").select(F.concat(*(x.cast("string") for x in parts)).alias("value"), F.when(k % 2 == 0, F.concat(F.lit("s/"), "c_name")).alias("object_key"))
    a = acknowledge(parse_job(raw, "value").withColumns({"description": F.lit("done"), "bucket": F.lit("b")}))
    field = lambda name: F.to_json(F.try_variant_get(F.parse_json("value"), f"$.{name}", "variant"))
    named = {"user_id": "userId", "is_user": "isUser", "meta": "metaData", "data": "data", "path": "path", "conversation": "conversationId", "grading": "grading"}
    text = lambda name: F.get_json_object("value", f"$.{name}")
    return a.select(F.col("key").cast("long").alias("c_custkey"), text("message").alias("message"), text("summaryObjectKey").alias("object_key"), *(field(x).alias(n) for n, x in named.items()))


@query("udf_llm", "SELECT conv_id * 100 + turn AS k, 'reply: ' || text AS reply FROM conversations")
def udf_llm(spark, sf_dir):
    """The model boundary with a stand-in client."""
    c = inputs.load(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("k"), F.col("text").alias("p"))
    return model_calls(c, "k", "p", lambda: "reply: {}".format).select("k", "reply")


@query("udf_translate_batch")
def udf_translate_batch(spark, sf_dir):
    """Aligned replies for each chunk, with a reason where there is none."""
    from voxloom.operators.chunking import chunk

    x = explode_text(inputs.load(spark, sf_dir, "documents"), "doc_id", "text", chunk)

    def client():
        def ask(p: str) -> str:
            if "," not in p:
                raise ValueError("nothing to translate")
            return p.replace(",", " ,")

        return ask

    x = x.withColumn("k", F.concat_ws("_", F.col("doc_id").cast("string"), F.col("no").cast("string")))
    return model_calls(x, "k", "chunk", client).select("k", F.length("reply").alias("n"), "reason")


@query("stream_retry", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'ValueError' END AS reason FROM events")
def stream_retry(spark, sf_dir):
    """Calls that fail once succeed when tried again; those that always fail keep their reason."""

    def client():
        seen = set()

        def ask(p: str) -> str:
            if int(p) % 3 == 0 or p not in seen:
                seen.add(p)
                raise ValueError(p)
            return p

        return ask

    e = inputs.load(spark, sf_dir, "events").select("event_id", F.col("event_id").cast("string").alias("p"))
    return model_calls(e, "event_id", "p", client).select("event_id", "reason")


class KeyPool:
    """Keys of a service in turn: a key that is refused rests for a while, one that is invalid is not used again."""

    def __init__(self, keys: list[str], rest: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.keys, self.rest, self.clock = list(dict.fromkeys(keys)), rest, clock
        self.ready: dict[str, float] = {k: 0.0 for k in self.keys}
        self.next = 0

    def take(self) -> str:
        """The next key that may be used; the one that rests shortest if all rest."""
        if not self.ready:
            raise LookupError("no key left")
        order = [k for k in self.keys[self.next :] + self.keys[: self.next] if k in self.ready]
        key = next((k for k in order if self.ready[k] <= self.clock()), None) or min(order, key=self.ready.get)
        self.next = (self.keys.index(key) + 1) % len(self.keys)
        return key

    def refused(self, key: str) -> None:
        if key in self.ready:
            self.ready[key] = self.clock() + self.rest

    def invalid(self, key: str) -> None:
        self.ready.pop(key, None)


class Heartbeat(StreamingQueryListener):
    """Calls beat(time) at every progress and idle report of a streaming query, so that a probe can see it live."""

    def __init__(self, beat: Callable[[float], None]):
        self.beat = beat

    def onQueryStarted(self, event) -> None:
        self.beat(time.time())

    def onQueryProgress(self, event) -> None:
        self.beat(time.time())

    def onQueryIdle(self, event) -> None:
        self.beat(time.time())

    def onQueryTerminated(self, event) -> None:
        pass


@query("stream_job_loop", "SELECT event_type, count(*) AS n, max(event_id) AS last FROM events GROUP BY event_type")
def stream_job_loop(spark, sf_dir):
    """The loop over the event table as a stream: each batch is parsed, worked on and upserted by conversation."""
    at = f"{spark.conf.get('spark.checkpoint.dir', None) or 'file://' + tempfile.mkdtemp(prefix='voxloom-jobs-')}/jobs-{uuid.uuid4().hex}"
    events = spark.readStream.schema(inputs.load(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    value = F.to_json(F.struct(F.col("event_type").alias("conversationId"), F.col("event_id").cast("string").alias("userId")))

    def batch(df: DataFrame, number: int) -> None:
        jobs = parse_job(df, "value").where("NOT bad").groupBy(F.col("conversation_id").alias("event_type")).agg(F.count("*").alias("n"), F.max(F.col("user_id").cast("long")).alias("last"))
        upsert(spark, f"{at}/out", jobs.withColumn("batch", F.lit(number)), "event_type", "batch")

    q = events.select(value.alias("value")).writeStream.foreachBatch(batch).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return read_table(spark, f"{at}/out").select("event_type", "n", "last")
