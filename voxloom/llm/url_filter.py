"""URL filters: rules by host and path, and a classifier over segmented names for the rest.

Rules come first, the longest that fits wins. Pages without a rule get the verdict of a multinomial naive Bayes model over the
words of host and path. Names are runs of letters or digits; a name such as `cheappills` is split into words by a unigram
Viterbi search, digits are one token, and what the search can only read as unknown is no evidence.

What the model may learn: the rules' own names (`example`, `com`, ...) and a language at the head of the path (`/de/`), which is
what rules speak about, are no features, or it would only repeat the rules.
Blocked pages stand against all other pages, decided or not, so a name that many ordinary pages carry speaks for none. SEEDS
are words whose meaning is known beforehand; each counts as SEEDED of all tokens, so they weigh the same at every size. The
priors are even, because the share of pages that happen to have a rule says nothing about the others.

Nothing is capped and no vocabulary is sent to a task. Word counts of all titles (and the seeds) are a table. Each distinct name
is segmented once: its substrings that pass a bit table of the words are looked up by a join, and only those that are words
come back to the name. Token counts, odds and the scores of names are joins and sums too; keys with very many rows (`blog`,
the digits) are met by a broadcast of those few keys, see `meet`.

Defined cases: a null url or one without `://` has an empty host and path, no rule and no names; without names, or at even odds,
the verdict is allow; null titles give no words; repeated rows and null ids stay; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.common import Members, ascii_lower, give_back, meet, stored, table

#: Verdict, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Words known beforehand, and the share of all tokens that each of them counts as.
SEEDS = {
    "block": "ads adult advert bet betting bitcoin casino cheap click crack escort gambling hack jackpot keygen loan loans lottery malware nude payday pharma phish phishing pill pills poker porn sex slots spam torrent track tracker tracking viagra warez xxx".split(),
    "allow": "academy archive blog book books college docs forum gov health help history journal library magazine museum news paper press research review school science society university wiki".split(),
}
SEEDED, SMOOTH = 0.01, 1.0
#: A language at the head of a path: rules speak about it, so it is no feature.
LANGUAGE = r"^/[a-z]{2}/"
UNKNOWN, DIGITS = "<unknown>", "<digits>"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty for null or without `://`."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    return ascii_lower(F.regexp_extract(url, _URL, 1)), F.regexp_extract(url, _URL, 2)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def names_of(host: Column, path: Column, rules=RULES) -> Column:
    """The names of a url that are features, repeats included."""
    own = sorted({x for _, h, p in rules for x in re.findall(r"[^\W\d_]+", (h + " " + p).lower())})
    names = F.regexp_extract_all(F.lower(F.concat_ws(" ", host, F.regexp_replace(path, LANGUAGE, "/"))), F.lit(r"\p{L}+|\p{Nd}+"), F.lit(0))
    names = F.transform(names, lambda x: F.when(x.rlike(r"^\p{Nd}"), DIGITS).otherwise(x))
    return F.filter(names, lambda x: ~x.isin(own))


def segment(name: str, counts: dict[str, int], total: int) -> list[str]:
    """The most probable reading of a name: words by their share of all words, and unknown stretches, each longer one ten times
    less probable by letter. Ties prefer the word that ends the reading and begins first."""
    sizes = sorted({len(w) for w in counts}, reverse=True)
    enter, more = math.log(total) + 1, math.log(10)
    best, back = [0.0] + [math.inf] * len(name), [0] * (len(name) + 1)
    open_cost, open_at = math.inf, 0
    for b in range(1, len(name) + 1):
        if best[b - 1] + enter < open_cost + more:  # an unknown stretch begins here, or goes on
            open_cost, open_at = best[b - 1] + enter, b - 1
        else:
            open_cost += more
        best[b], back[b] = open_cost, -open_at - 1
        for n in sizes:
            if n <= b and (c := counts.get(name[b - n : b])) is not None and best[b - n] + math.log(total / c) <= best[b]:
                best[b], back[b] = best[b - n] + math.log(total / c), b - n
    out, b = [], len(name)
    while b:
        a = back[b]
        out.append(name[a:b] if a >= 0 else UNKNOWN)
        b = a if a >= 0 else -a - 1
    return out[::-1]


def title_words(pages: DataFrame) -> DataFrame:
    """(word, n): the words of all page titles, and the seeds, which count at least once."""
    title = F.lower(F.regexp_extract(F.coalesce(F.col("html").cast("string"), F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1))
    found = pages.select(F.explode(F.regexp_extract_all(title, F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    seeds = pages.sparkSession.createDataFrame([(w,) for own in SEEDS.values() for w in own], "word string")
    return found.union(seeds).groupBy("word").agg(F.count("*").alias("n"))


def segmented(spark: SparkSession, names: DataFrame, words: DataFrame) -> DataFrame:
    """(name, tokens) for distinct names (name), read by the word counts (word, n)."""
    size = words.agg(F.coalesce(F.sum("n"), F.lit(1)).alias("total"), F.coalesce(F.max(F.length("word")), F.lit(0)).alias("longest")).first()
    known = Members(spark, words.select(F.xxhash64("word")))
    total, longest = size.total, size.longest

    def substrings(parts):
        for part in parts:
            out = ([], [])
            for name in part.column(0).to_pylist():
                own = [] if name == DIGITS else sorted({name[a:b] for a in range(len(name)) for b in range(a + 1, min(len(name), a + longest) + 1)})
                if own:
                    keys = np.fromiter((xxhash.xxh64_intdigest(w.encode(), 42) for w in own), np.uint64, len(own)).view(np.int64)
                    for w in np.flatnonzero(known(keys)).tolist():
                        out[0].append(name)
                        out[1].append(own[w])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in out], names=["name", "word"])
        give_back()

    asked = stored(spark, names.mapInArrow(substrings, "name string, word string"), "substrings")
    found = meet(asked, words, "word").groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("own"))

    def read(parts):
        for part in parts:
            out = [[DIGITS] if name == DIGITS else segment(name, {x["word"]: x["n"] for x in own or ()}, total) for name, own in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.list_(pa.string()))], names=["name", "tokens"])

    return names.join(found, "name", "left").select("name", "own").mapInArrow(read, "name string, tokens array<string>")


def name_scores(spark: SparkSession, rows: DataFrame, words: DataFrame) -> DataFrame:
    """(name, score): log odds of block against allow of each name in rows (u, names, blocked), u a url's host and path."""
    seen = rows.groupBy("u", "blocked").agg(F.any_value("names").alias("names"), F.count("*").alias("n"))
    seen = seen.select(F.explode("names").alias("name"), "blocked", "n").groupBy("name")
    seen = stored(spark, seen.agg(F.sum(F.when(F.col("blocked"), F.col("n")).otherwise(0)).alias("b"), F.sum(F.when(F.col("blocked"), 0).otherwise(F.col("n"))).alias("a")), "names")
    read = stored(spark, segmented(spark, seen.select("name"), words).select("name", F.explode(F.filter("tokens", lambda t: t != UNKNOWN)).alias("token")), "segments")
    counted = read.join(seen, "name").groupBy("token").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    counted = stored(spark, counted, "tokens")
    all_a, all_b = counted.agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    weight = max(1, round(SEEDED * (all_a + all_b)))
    seeds = spark.createDataFrame([(w, weight * (v == "allow"), weight * (v == "block")) for v, own in SEEDS.items() for w in own], "token string, a long, b long")
    counted = counted.union(seeds).groupBy("token").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    size = counted.agg(F.count("*").alias("v"), F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    share = lambda n, of: (F.col(n) + SMOOTH) / F.lit(float(of + SMOOTH * size.v))
    odds = counted.select("token", (F.log(share("b", size.b)) - F.log(share("a", size.a))).alias("odds"))
    return meet(read, odds, "token").groupBy("name").agg(F.sum("odds").alias("score"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score) for each row of pages (page_id, url, html); the score is null by rule."""
    spark = pages.sparkSession
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    # a path is empty or begins with a slash, which no host holds, so host and path together name both
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("given"), F.concat("host", "path").alias("u"), names_of(F.col("host"), F.col("path"), rules).alias("names"))
    blocked = rows.select("u", "names", F.coalesce(F.col("given") == "block", F.lit(False)).alias("blocked"))
    scores = stored(spark, name_scores(spark, blocked, stored(spark, title_words(pages), "words")), "scores")
    asked = stored(spark, rows.where("given IS NULL").select("u", "names").distinct().select("u", F.explode("names").alias("name")), "asked")
    judged = meet(asked, scores, "name").groupBy("u").agg(F.sum("score").alias("z"))
    out = meet(stored(spark, rows.drop("names"), "pages"), judged, "u", "left")
    z = F.coalesce("z", F.lit(0.0))
    return out.select("page_id", "host", "path", "rule", F.coalesce("given", F.when(z > 0, "block").otherwise("allow")).alias("verdict"), F.when(F.col("given").isNull(), 1 / (1 + F.exp(-z))).alias("block_score"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
