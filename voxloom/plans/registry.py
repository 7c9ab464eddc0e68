"""All queries of the library and their SQL counterparts: key -> query, key -> DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register a query under its key, with the SQL that must give the same rows."""

    def put(f):
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return put


@query(
    "agg_distinct_chunks",
    """
    SELECT source, count(*) AS chunks, count(DISTINCT line) AS distinct_chunks, count(*) - count(DISTINCT line) AS repeats
    FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '' GROUP BY source""",
)
def agg_distinct_chunks(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", F.explode(F.split("text", "\n")).alias("line")).where(F.trim("line") != "")
    per_line = lines.groupBy("source", "line").agg(F.count("*").alias("n"))  # one shuffle of distinct lines; hot lines are combined before it
    return per_line.groupBy("source").agg(F.sum("n").alias("chunks"), F.count("*").alias("distinct_chunks"), (F.sum("n") - F.count("*")).alias("repeats"))


def fill() -> None:
    """Import every module that registers queries."""
    from voxloom.operators import chunking, intervals, minutes, predicates, sequences, strings, vectors  # noqa: F401
    from voxloom.sources import docx, readers  # noqa: F401
    from voxloom.streaming import jobs  # noqa: F401
