"""Inputs that several queries share, as temporary views for Spark and as common table expressions for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, pos, line): the lines of documents."""
    return load(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


LINES = "lines AS (SELECT doc_id, source, unnest(range(0, len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents))"


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(meeting, kind, no, start, stop): events of a user and type as intervals up to the next such event, in seconds."""
    e = load(spark, sf_dir, "events")
    own = W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    at = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))") / F.lit(1e6)  # whatever the session's time zone
    s = e.select(F.col("user_id").alias("meeting"), F.col("event_type").alias("kind"), F.row_number().over(own).cast("long").alias("no"), at.alias("start"), F.lead(at).over(own).alias("stop"), "value")
    return s.where("stop is not null")


SPANS = """spans AS (SELECT * FROM (SELECT user_id AS meeting, event_type AS kind, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS no,
    epoch_us(ts) / 1e6 AS start, lead(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS stop, value FROM events) WHERE stop IS NOT NULL)"""


def views(spark: SparkSession, sf_dir: str, *names: str) -> SparkSession:
    """Register tables or shared inputs as temporary views."""
    for name in names:
        df = {"lines": lines, "spans": spans}[name](spark, sf_dir) if name in ("lines", "spans") else load(spark, sf_dir, name)
        df.createOrReplaceTempView(name)
    return spark
