"""License scans with DataFrame functions only: diagonal voting over word k-grams.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased. Every template is a sequence of words; its k-grams
(k = 3, or the template's length if it has fewer words) are joined to all rolling k-grams of a document by hash, and the words
themselves are compared in the join, so a collision is no hit. A hit of document word i with template word j lies on
diagonal i - j. Votes are summed for each document, template and diagonal; diagonals at most an eighth of the template's length
apart are neighbours and merge (words put in or left out move the diagonal). A merged span is verified: at least COVER of the
template's k-grams must be found, and at least DENSE of the k-grams of the span must be hits.

Base phrases are templates of one k-gram, so each hit of theirs is one place and none merge.

Before rows are made of k-grams, a bit table of the templates' hashes (fixed size) drops those that cannot join. The template
table is part of the program, a few hundred rows, and is broadcast. Rows are shuffled once, by a row number.

Defined cases: null text is empty; without words all counts are 0, labels empty and the first and last word null; repeated
rows and null ids stay rows of their own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxloom.llm.common import ascii_lower, table

#: Base phrases and labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: Passages of public licenses, by label.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2.0", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("warranty", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
]
K, COVER, DENSE, BITS = 3, 0.6, 0.5, 16384


def template_grams() -> list[tuple]:
    """(template, label, base, k, template word, template k-grams, reach, three words or null) of each k-gram."""
    out = []
    for t, (text, label, base) in enumerate([(p, l, True) for p, l in BASE] + [(x, l, False) for l, x in TEMPLATES]):
        w = text.split()
        k = min(K, len(w))
        for j in range(len(w) - k + 1):
            out.append((t, label, base, k, j, len(w) - k + 1, 0 if base else max(1, len(w) // 8), *w[j : j + k], *[None] * (3 - k)))
    return out


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    grams = spark.createDataFrame(template_grams(), "tid int, label string, base boolean, k int, at int, grams int, reach int, a string, b string, c string")
    known = [r.h for r in grams.select(F.xxhash64("a", "b", "c").alias("h")).distinct().collect()]
    bits = [0] * (BITS // 64)
    for h in known:
        bits[(h % BITS) // 64] |= 1 << (h % 64)
    bits = F.lit([x - (1 << 64) if x >> 63 else x for x in bits])

    def may(h):
        return F.expr("1L").bitwiseAND(F.call_function("shiftright", F.get(bits, F.shiftrightunsigned(h.bitwiseAND(F.lit(BITS - 1)), 6).cast("int")), h.bitwiseAND(F.lit(63)).cast("int"))) == 1

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id"), F.regexp_extract_all(ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(_WORD), F.lit(0)).alias("w"))
    two = lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1))
    three = lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))
    at = F.when(F.size("w") > 1, F.sequence(F.lit(0), F.size("w") - 2))
    rows = rows.select("uid", "doc_id", F.size("w").cast("long").alias("n_words"), F.transform(F.filter(at, lambda i: may(two(i)) | may(three(i))), lambda i: F.struct(i.alias("i"), F.get("w", i).alias("wa"), F.get("w", i + 1).alias("wb"), F.get("w", i + 2).alias("wc"))).alias("hits"))
    hits = rows.select("uid", "doc_id", "n_words", F.explode_outer("hits").alias("x")).select("uid", "doc_id", "n_words", "x.*")
    hits = hits.withColumn("g", F.explode(F.array(F.struct(F.lit(2).alias("k"), F.xxhash64("wa", "wb").alias("h")), F.struct(F.lit(3).alias("k"), F.xxhash64("wa", "wb", "wc").alias("h"))))).select("*", "g.k", "g.h").drop("g")
    own = F.broadcast(grams.withColumn("h", F.xxhash64("a", "b", "c")).withColumnsRenamed({"k": "tk", "h": "th"}))
    hits = hits.join(own, (F.col("k") == F.col("tk")) & (F.col("h") == F.col("th")) & (F.col("wa") == F.col("a")) & (F.col("wb") == F.col("b")) & ((F.col("k") == 2) | (F.col("wc") == F.col("c"))), "left")
    hits = hits.select("uid", "doc_id", "n_words", "tid", "label", "base", F.col("tk").alias("k"), "at", "grams", "reach", "i").repartition("uid")

    doc = ["uid", "doc_id", "n_words"]
    kind = ["tid", "label", "base", "k", "grams", "reach"]
    votes = hits.withColumn("diagonal", F.col("i") - F.col("at")).groupBy(*doc, *kind, "diagonal").agg(F.collect_set("at").alias("found"), F.min("i").alias("lo"), F.max("i").alias("hi"))
    order = W.partitionBy(*doc, "tid").orderBy("diagonal")
    new = F.when(F.col("diagonal") - F.lag("diagonal").over(order) <= F.col("reach"), 0).otherwise(1)
    spans = votes.withColumn("new", new).withColumn("span", F.sum("new").over(order)).groupBy(*doc, *kind, "span")
    spans = spans.agg(F.size(F.array_distinct(F.flatten(F.collect_list("found")))).alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    good = F.col("tid").isNotNull() & (F.col("n") >= COVER * F.col("grams")) & (F.col("n") >= DENSE * (F.col("hi") - F.col("lo") + 1))
    spans = spans.withColumn("good", good).withColumn("place", F.when(F.col("base"), F.col("lo").cast("long")))
    labels = lambda c: F.concat_ws(",", F.array_sort(F.collect_set(F.when(c, F.col("label")))))
    return (
        spans.groupBy(*doc)
        .agg(
            F.count("place").alias("n_base"), F.min("place").alias("first_word"), F.max("place").alias("last_word"), labels(F.col("base") & F.col("good")).alias("base_labels"), labels(F.col("good")).alias("labels"),
            F.coalesce(F.max(F.when(F.col("good"), F.col("n") / F.col("grams"))), F.lit(0.0)).alias("score"),
        )
        .drop("uid")
    )


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


ORACLE = f"""
WITH g(tid, label, base, k, pos, grams, reach, a, b, c) AS (VALUES {", ".join("(" + ", ".join(_sql(x) for x in r) + ")" for r in template_grams())}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, i - 1 AS i, w[i] AS wa, w[i + 1] AS wb, w[i + 2] AS wc FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d)),
h AS (SELECT doc_id, tid, label, base, grams, reach, p.i, pos FROM p JOIN g ON wa = a AND wb = b AND (k = 2 OR wc = c)),
v AS (SELECT doc_id, tid, label, base, grams, reach, i - pos AS diagonal, list(DISTINCT pos) AS found, min(i) AS lo, max(i) AS hi FROM h GROUP BY ALL),
n AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, tid ORDER BY diagonal) <= reach THEN 0 ELSE 1 END AS fresh FROM v),
m AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, tid ORDER BY diagonal) AS span FROM n),
s AS (SELECT doc_id, tid, label, base, grams, span, len(list_distinct(flatten(list(found)))) AS n, min(lo) AS lo, max(hi) AS hi FROM m GROUP BY ALL),
r AS (SELECT *, n >= {COVER} * grams AND n >= {DENSE} * (hi - lo + 1) AS good FROM s)
SELECT d.doc_id, CAST(any_value(len(w)) AS BIGINT) AS n_words, count(lo) FILTER (base) AS n_base, CAST(min(lo) FILTER (base) AS BIGINT) AS first_word, CAST(max(lo) FILTER (base) AS BIGINT) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND good), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (good), '') AS labels,
       coalesce(max(n / grams) FILTER (good), 0.0) AS score
FROM d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id
"""
