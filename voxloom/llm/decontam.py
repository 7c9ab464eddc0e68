"""Benchmark decontamination with DataFrame functions only: MinHash containment search by item size, then exact verification.

Words are runs of letters, marks and digits after A-Z are lower-cased; shingles are K consecutive words (an item or document
with fewer words is one shingle of all of them). An item is found in a document if at least SHARE of its distinct shingles
occur there.

All shingles are ordered by one hash. An item with n distinct shingles needs r = ceil(SHARE * n) of them, so at most n - r
are missing: its n - r + 1 smallest hashes, its MinHash sketch, hold at least one hash of any document that contains it.
Items are partitioned by size (powers of two). Each partition has a bound, its largest sketch hash, and its least r; a
document is only asked for hashes under the bounds of partitions whose r it can reach at all. So nothing is lost however
short the item and however long the document, which a fixed-length MinHash signature of the document could not promise.
Documents with a common hash are read once more, and the containment of the shingles themselves decides.

What is small is broadcast by its counted size: sketches of at most SKETCH_ROWS rows (24 bytes each), candidate documents with
at most so many pairs, and items with at most SHINGLES shingles in all. Then no text and no shingle of a document is shuffled;
beyond a bound that join shuffles instead.

Defined cases: null text is empty; no words: no shingle, never found; repeated items are items of their own; repeated
documents (one doc_id) give one row for each item, the largest containment; null ids are ids; empty tables give an empty
result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.common import ascii_lower, stored, table

K, SHARE = 5, 0.8
SKETCH_ROWS, SHINGLES = 2_000_000, 1_000_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))


def _windows(column: str, k: int, make) -> Column:
    """make(list of k words) for each window of a column of words; null words at the end of a sequence that is too short."""
    at = F.sequence(F.lit(0), F.greatest(F.size(column) - k, F.lit(0)))
    return F.when(F.size(column) > 0, F.transform(at, lambda i: make([F.get(F.col(column), i + j) for j in range(k)]))).otherwise(F.array().cast("array<string>") if make is _joined else F.array().cast("array<bigint>"))


def _joined(xs: list[Column]) -> Column:
    return F.concat_ws(" ", *xs)


def _hashed(xs: list[Column]) -> Column:
    return F.xxhash64(*xs)


def _required(n: Column, share: float) -> Column:
    return F.ceil(n * F.lit(str(share)).cast("decimal(9,6)")).cast("int")


def find_items(docs: DataFrame, items: DataFrame, k: int = K, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment) for each item found in a document.

    docs: doc_id, text; items: item_id, text.
    """
    spark = docs.sparkSession
    item = items.select(F.col("item_id"), words(F.col("text")).alias("_w")).withColumn("_uid", F.monotonically_increasing_id())
    item = item.select("item_id", "_uid", F.array_distinct(_windows("_w", k, _joined)).alias("_s"), F.array_distinct(_windows("_w", k, _hashed)).alias("_h")).where(F.size("_s") > 0)
    item = stored(spark, item.withColumn("_n", F.size("_h")).withColumn("_need", _required(F.col("_n"), share)), "items")
    sketch = item.select("_uid", "_need", "_n", F.explode(F.slice(F.array_sort("_h"), F.lit(1), F.col("_n") - F.col("_need") + 1)).alias("_hash"))
    sizes = sketch.groupBy(F.floor(F.log2("_n")).alias("size")).agg(F.max("_hash").alias("bound"), F.min("_need").alias("need"), F.count("*").alias("rows")).collect()  # a row for each power of two
    shingles = item.agg(F.sum("_n")).first()[0] or 0
    doc = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    hashes = doc.select("doc_id", F.xxhash64("text").alias("_t"), words(F.col("text")).alias("_w")).select("doc_id", "_t", _windows("_w", k, _hashed).alias("_h"))
    most = F.greatest(*[F.when(F.size("_h") >= r.need, F.lit(r.bound)) for r in sizes], F.lit(-(2**63)), F.lit(-(2**63)))
    asked = hashes.withColumn("_most", most).select("doc_id", "_t", F.size("_h").alias("_m"), F.explode(F.filter("_h", lambda h: h <= F.col("_most"))).alias("_hash"))
    probe = sketch.select("_hash", "_uid", "_need")
    probe = F.broadcast(probe) if sum(r.rows for r in sizes) <= SKETCH_ROWS else probe
    pairs = stored(spark, asked.join(probe, "_hash").where("_m >= _need").select("doc_id", "_t", "_uid").distinct(), "candidates")
    asks = pairs.groupBy("doc_id", "_t").agg(F.collect_list("_uid").alias("_uids")).toDF("_d", "_dt", "_uids")
    asks = F.broadcast(asks) if pairs.count() <= SKETCH_ROWS else asks
    again = doc.withColumn("_t", F.xxhash64("text")).join(asks, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_dt")))
    again = again.select("doc_id", "_uids", words(F.col("text")).alias("_w")).select("doc_id", "_uids", _windows("_w", k, _joined).alias("_ds")).select("doc_id", "_ds", F.explode("_uids").alias("_uid"))
    wanted = item.select("_uid", "item_id", "_s")
    both = again.join(F.broadcast(wanted) if shingles <= SHINGLES else wanted, "_uid")
    both = both.select("doc_id", "item_id", F.size("_s").cast("long").alias("n_shingles"), F.size(F.array_intersect("_s", "_ds")).cast("long").alias("n_found"))
    found = both.where(F.col("n_found") >= _required(F.col("n_shingles"), share)).groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("n_found") / F.col("n_shingles"), "n_shingles", "n_found")).alias("x"))
    return found.select("doc_id", "item_id", "x.n_shingles", "x.n_found", (F.col("x.n_found") / F.col("x.n_shingles")).alias("containment"))


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SHINGLES = """
    SELECT DISTINCT {id}, array_to_string(ws[i:i + 4], ' ') AS s
    FROM (SELECT {id}, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i
          FROM (SELECT {id}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\p{{L}}\\p{{M}}\\p{{N}}]+') AS ws FROM {of})
          WHERE len(ws) > 0)"""

ORACLE = f"""
WITH d AS ({_SHINGLES.format(id="doc_id", of="documents")}),
b AS ({_SHINGLES.format(id="item_id", of="benchmark")}),
n AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, count(*) AS n_found, count(*) / n_shingles AS containment
FROM d JOIN b USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_shingles HAVING count(*) * 5 >= n_shingles * 4
"""
