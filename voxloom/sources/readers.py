"""Sources: job messages, speech-recogniser JSON, speaker-turn files, plain documents, object paths."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators.chunking import reflow
from voxloom.plans import inputs
from voxloom.plans.registry import query

#: First bytes of document formats.
MAGIC = [(b"%PDF", ".pdf"), (b"PK\x03\x04", ".docx"), (b"\xd0\xcf\x11\xe0", ".doc")]
#: Encodings in the order they are tried. UTF-16 comes before cp1252, so text of even length can be misread.
ENCODINGS = ["utf-8-sig", "utf-16", "utf-8", "cp1252", "latin-1"]
EXTENSIONS = [".pdf", ".docx", ".doc", ".txt"]


def sniff(content: Column, path: Column) -> Column:
    """Extension of a file by its first bytes, else by its name, else .txt."""
    ext = F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))
    out = F.when(ext.isin(EXTENSIONS), ext).otherwise(".txt")
    for magic, kind in reversed(MAGIC):
        out = F.when(F.startswith(content, F.lit(magic)), kind).otherwise(out)
    return out


def decode_text(raw: bytes) -> str:
    for e in ENCODINGS[:-1]:
        try:
            return raw.decode(e)
        except UnicodeError:
            pass
    return raw.decode(ENCODINGS[-1])


def text_blocks(text: str) -> list[str]:
    """Paragraphs: parts between blank lines if there are any, else lines flowed together."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    parts = [re.sub(r"\s+", " ", p).strip() for p in re.split(r"\n\s*\n", text)] if re.search(r"\n\s*\n", text) else reflow(text)
    return [p for p in (re.sub("[ \t ]+", " ", p).strip() for p in parts) if p]


def blocks_column(content) -> Column:
    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda raw: text_blocks(decode_text(bytes(raw))))

    return run(content)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, block_no, text) of plain files; other kinds give no blocks (they need a reader of their own)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content", sniff(F.col("content"), F.col("path")).alias("kind"))
    plain = files.where("kind = '.txt'").select("path", "kind", F.posexplode(blocks_column("content")).alias("block_no", "text"))
    return plain.unionByName(files.where("kind <> '.txt'").select("path", "kind", F.lit(None).cast("int").alias("block_no"), F.lit(None).cast("string").alias("text")))


def read_rttm(lines: DataFrame, text: str = "value") -> DataFrame:
    """(speaker, start, stop, duration) of the lines with eight columns or more."""
    c = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    x = lines.select(c.alias("c")).where(F.size("c") >= 8)
    start, d = F.get("c", F.lit(3)).cast("double"), F.get("c", F.lit(4)).cast("double")
    return x.select(F.get("c", F.lit(7)).alias("speaker"), start.alias("start"), (start + d).alias("stop"), d.alias("duration"))


_ASR = "struct<text:string,duration:double,segments:array<struct<text:string,start:double,end:double>>>"


def parse_asr(raw: DataFrame, key: str, json: str) -> DataFrame:
    """(key, seg_no, text, start, stop): segments with text; a flat result gives one segment."""
    r = raw.select(key, F.from_json(json, _ASR).alias("r"))
    flat = F.array(F.struct(F.col("r.text").alias("text"), F.lit(0.0).alias("start"), F.col("r.duration").alias("end")))
    segs = F.filter(F.when(F.size("r.segments") > 0, F.col("r.segments")).otherwise(flat), lambda s: F.trim(F.coalesce(s.text, F.lit(""))) != "")
    return r.select(key, F.posexplode(segs).alias("seg_no", "s")).select(key, "seg_no", F.trim("s.text").alias("text"), F.round("s.start", 3).alias("start"), F.round("s.end", 3).alias("stop"))


#: Fields of a job message and the spellings in which they come.
JOB = {"tenant_id": ["tenant_id", "tenantId"], "user_id": ["userId", "user_id"], "conversation_id": ["conversationId", "conversation_id"], "mode": ["mode"], "compare_mode": ["compare_mode", "compareMode"]}
JOB_LISTS = {"document_ids": ["document_ids", "documentIds"], "file_fids": ["file_fids", "fileFids", "fIds"], "document_names": ["document_names", "documentNames"]}


def _given(json, *names) -> Column:
    """The first spelling whose value is not null, "" or []."""
    return F.coalesce(*(F.when(~v.isin("", "[]"), v) for v in (F.get_json_object(json, f"$.{n}") for n in names)))


def parse_job(raw: DataFrame, json: str) -> DataFrame:
    """Fields of job messages; lists default to empty, texts to ''. `bad` marks what is no JSON object."""
    strings = {k: F.coalesce(_given(json, *v), F.lit("")) for k, v in JOB.items()}
    empty = F.array().cast("array<string>")
    arrays = {k: F.coalesce(F.from_json(_given(json, *v), "array<string>"), empty) for k, v in JOB_LISTS.items()}
    urls = F.filter(F.coalesce(F.from_json(_given(json, "file_urls", "fileUrls"), "array<string>"), empty), lambda u: F.trim(u) != "")
    path = F.coalesce(F.get_json_object(json, "$.path"), F.lit(""))
    arrays["file_urls"] = F.when(F.size(urls) > 0, urls).when(F.trim(path) != "", F.array(path)).otherwise(empty)
    return raw.withColumns({**strings, **arrays, "bad": F.json_object_keys(json).isNull()})


def object_key(tenant, conversation, user, digest, ext: str = "docx", folder: str = "summaries") -> Column:
    """{tenant or conversation or user or shared}/{folder}/{digest}.{ext}"""
    scope = F.regexp_replace(F.coalesce(F.nullif(tenant, F.lit("")), F.nullif(conversation, F.lit("")), F.nullif(user, F.lit("")), F.lit("shared")), "^/+|/+$", "")
    return F.concat(F.coalesce(F.nullif(scope, F.lit("")), F.lit("shared")), F.lit(f"/{folder}/"), digest, F.lit(f".{ext}"))


@query("src_txt")
def src_txt(spark, sf_dir):
    """Documents as bytes, decoded and cut to blocks."""
    d = inputs.load(spark, sf_dir, "documents").select("doc_id", F.encode("text", "utf-8").alias("content"))
    return d.select("doc_id", F.posexplode(blocks_column("content")).alias("block_no", "text"))


@query("src_sniff", "SELECT page_id, CASE page_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.doc' ELSE '.txt' END AS kind FROM pages")
def src_sniff(spark, sf_dir):
    k = F.col("page_id") % 5
    content = F.when(k == 0, F.lit(b"%PDF-1.7")).when(k == 1, F.lit(b"PK\x03\x04zip")).when(k == 2, F.lit(b"\xd0\xcf\x11\xe0\xa1")).otherwise(F.encode("html", "utf-8"))
    return inputs.load(spark, sf_dir, "pages").select("page_id", sniff(content, F.concat("url", F.when(k == 1, ".txt").otherwise(".xyz"))).alias("kind"))


@query("src_rttm", f"WITH {inputs.SPANS} SELECT kind AS speaker, round(start, 3) AS start, round(round(start, 3) + round(stop - start, 3), 3) AS stop, round(stop - start, 3) AS duration FROM spans WHERE no <> 2")
def src_rttm(spark, sf_dir):
    s = inputs.spans(spark, sf_dir)
    three = lambda c: F.round(c, 3).cast("decimal(20,3)").cast("string")
    short = F.concat(F.lit("SPEAKER m 1 "), three(F.col("start")))
    line = F.when(F.col("no") == 2, short).otherwise(F.concat(short, F.lit("  "), three(F.col("stop") - F.col("start")), F.lit(" <NA> <NA> "), "kind", F.lit(" <NA>")))
    return read_rttm(s.select(line.alias("value"))).withColumn("stop", F.round("stop", 3))


@query("src_asr_json", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seg_no, trim(text) AS text, turn + 0.125 AS start, turn + 1.0 AS stop FROM conversations WHERE trim(text) <> ''")
def src_asr_json(spark, sf_dir):
    """Conversations as a recogniser's JSON, read back into segments."""
    seg = F.struct(F.col("text"), (F.col("turn") + 0.125).alias("start"), (F.col("turn") + 1.0).alias("end"))
    c = inputs.load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", seg.alias("s")))), lambda x: x.s).alias("segments"))
    return parse_asr(c.select("conv_id", F.to_json(F.struct("segments")).alias("j")), "conv_id", "j")


@query("src_job_json", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 't' || user_id ELSE '' END AS tenant_id, CASE event_id % 3 WHEN 0 THEN '' ELSE 'u' || user_id END AS user_id, CASE event_id % 3 WHEN 2 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS urls, event_id % 3 = 2 AS bad FROM events WHERE event_id % 3 < 2 UNION ALL SELECT event_id, '', '', 0, true FROM events WHERE event_id % 3 = 2")
def src_job_json(spark, sf_dir):
    e = inputs.load(spark, sf_dir, "events")
    k, u = F.col("event_id") % 3, F.col("user_id").cast("string")
    raw = F.when(k == 0, F.concat(F.lit('{"tenant_id": "", "tenantId": "t'), u, F.lit('", "file_urls": ["a", " ", "b"]}'))).when(k == 1, F.concat(F.lit('{"userId": "u'), u, F.lit('", "fileUrls": [], "path": "p/q"}'))).otherwise("not json")
    x = parse_job(e.select("event_id", raw.alias("raw")), "raw")
    return x.select("event_id", "tenant_id", "user_id", F.size("file_urls").alias("urls"), "bad")


@query("src_object", "SELECT page_id, split_part(ltrim(p, '/'), '/', 1) AS bucket, CASE WHEN contains(ltrim(p, '/'), '/') THEN substring(ltrim(p, '/'), instr(ltrim(p, '/'), '/') + 1) ELSE '' END AS key FROM (SELECT page_id, regexp_replace(url, '^[a-z]+:', '') AS p FROM pages)")
def src_object(spark, sf_dir):
    p = F.regexp_replace(F.regexp_replace("url", "^[a-z]+:", ""), "^/+", "")
    return inputs.load(spark, sf_dir, "pages").select("page_id", F.substring_index(p, "/", 1).alias("bucket"), F.regexp_extract(p, "(?s)^[^/]*/(.*)$", 1).alias("key"))


@query("snk_object_key", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'acme' WHEN 1 THEN 'conv' || c_custkey WHEN 2 THEN 'user' ELSE 'shared' END || '/summaries/' || md5(c_name) || '.docx' AS key FROM customer")
def snk_object_key(spark, sf_dir):
    k = F.col("c_custkey") % 4
    only = lambda n, v: F.when(k == n, v).otherwise("")
    key = object_key(only(0, F.lit("/acme/")), only(1, F.concat(F.lit("conv"), F.col("c_custkey").cast("string"))), only(2, F.lit("user")), F.md5("c_name"))
    return inputs.load(spark, sf_dir, "customer").select("c_custkey", key.alias("key"))


@query("describe_media", "SELECT c_custkey, 'Translated ' || c_name || ' (' || (c_custkey % 60) || ' s) from Hindi into English.' AS y FROM customer WHERE c_custkey % 60 > 0")
def describe_media(spark, sf_dir):
    from voxloom.functions.text import duration_text

    s = F.col("c_custkey") % 60
    return inputs.load(spark, sf_dir, "customer").where(s > 0).select("c_custkey", F.concat(F.lit("Translated "), "c_name", F.lit(" ("), duration_text(s), F.lit(") from Hindi into English.")).alias("y"))


@query("latin_terms")
def latin_terms(spark, sf_dir):
    """The first four distinct Latin runs of three words or less."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        def one(text):
            seen, out = set(), []
            for m in re.finditer(r"[A-Za-z][A-Za-z0-9]*(?:[-.'’&][A-Za-z0-9]+)*(?:\s+[A-Za-z0-9]+(?:[-.'’&][A-Za-z0-9]+)*)*", text):
                words = m[0].lower().split()
                name = " ".join(words)
                if len(m[0]) > 1 and len(words) <= 3 and name not in seen:
                    seen.update([name, *words])
                    out.append(m[0])
            return out[:4]

        return s.map(one)

    return inputs.lines(spark, sf_dir).select("doc_id", "pos", run(F.regexp_replace("line", " ", ", ")).alias("terms"))
