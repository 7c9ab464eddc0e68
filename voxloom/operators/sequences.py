"""Operators that pass over the ordered rows of a document or meeting: islands, duplicates, loops, aggregates by word."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxloom.functions import text as T
from voxloom.operators.strings import _TERMS
from voxloom.plans import inputs
from voxloom.plans.registry import query

#: Words that start or are a channel's sign-off, closings of a recording, and words no trimmed text ends in.
SIGN_OFF = ["सब्सक्राइब", "subscribe"]
CLOSINGS = ["subscribe", "सब्सक्राइब", "like and subscribe", "thanks for watching"]
DANGLING = {"और", "or", "but", "तो", "कि", "for", "of", "to", "with", "in", "on", "at", "by", "the", "a", "an"}

_TURN = "x AS (SELECT user_id, event_type, event_id, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS fresh, row_number() OVER w AS pos FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), y AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY pos) AS island FROM x)"


def islands(rows: DataFrame, key: str, order: list[str], speaker: str) -> DataFrame:
    """rows with pos (within key) and island: the number of speaker changes so far."""
    w = W.partitionBy(key).orderBy(*order)
    fresh = F.when(F.col(speaker) == F.lag(speaker).over(w), 0).otherwise(1)
    return rows.withColumn("fresh", fresh).withColumn("pos", F.row_number().over(w)).withColumn("island", F.sum("fresh").over(w))


@query("win_turn_islands", f"WITH {_TURN} SELECT user_id, island, any_value(event_type) AS speaker, count(*) AS n, min(pos) AS first, string_agg(event_id, ' ' ORDER BY pos) AS ids FROM y GROUP BY user_id, island")
def win_turn_islands(spark, sf_dir):
    """Neighbouring rows of one speaker become one turn."""
    e = islands(inputs.load(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts"), "user_id", ["ts", "event_id"], "event_type")
    ids = F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("event_id").cast("string").alias("id")))), lambda s: s.id))
    return e.groupBy("user_id", "island").agg(F.min("event_type").alias("speaker"), F.count("*").alias("n"), F.min("pos").alias("first"), ids.alias("ids"))


@query("win_first_appearance", f"WITH {_TURN} SELECT user_id, event_type, dense_rank() OVER (PARTITION BY user_id ORDER BY min(pos)) AS speaker_no FROM y GROUP BY user_id, event_type")
def win_first_appearance(spark, sf_dir):
    first = inputs.load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    return first.select("user_id", "event_type", F.row_number().over(W.partitionBy("user_id").orderBy("first")).alias("speaker_no"))


@query("render_transcript", """WITH f AS (SELECT conv_id, role, dense_rank() OVER (PARTITION BY conv_id ORDER BY min(turn)) AS k FROM conversations GROUP BY conv_id, role)
    SELECT conv_id, string_agg('[Speaker_' || k || '] ' || trim(text), chr(10) ORDER BY turn) AS transcript, max(k) AS speakers FROM conversations JOIN f USING (conv_id, role) GROUP BY conv_id""")
def render_transcript(spark, sf_dir):
    """A tagged line for each turn, speakers numbered by first appearance, neighbouring turns of one speaker joined."""
    c = inputs.load(spark, sf_dir, "conversations").where(F.trim("text") != "")
    x = islands(c, "conv_id", ["turn"], "role").withColumn("first", F.min("turn").over(W.partitionBy("conv_id", "role")))
    x = x.withColumn("k", F.dense_rank().over(W.partitionBy("conv_id").orderBy("first")))
    said = F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("turn", F.trim("text").alias("t")))), lambda s: s.t))
    turns = x.groupBy("conv_id", "island", "k").agg(said.alias("t"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("island", "k", "t"))), lambda s: F.concat(F.lit("[Speaker_"), s.k.cast("string"), F.lit("] "), s.t))
    return turns.groupBy("conv_id").agg(F.concat_ws("\n", lines).alias("transcript"), F.max("k").cast("long").alias("speakers"))


def smooth_runs(runs: list[tuple], least: int = 3) -> list[tuple]:
    """(speaker, words) runs, in which runs of under `least` words pass to a neighbour, both sides' speaker first."""
    runs = [[s, list(w)] for s, w in runs]
    while len(runs) > 1:
        short = next((i for i, (_, w) in enumerate(runs) if len(w) < least), None)
        if short is None:
            break
        sides = [runs[i][0] for i in (short - 1, short + 1) if 0 <= i < len(runs)]
        runs[short][0], out = sides[0], []
        for s, w in runs:
            if out and out[-1][0] == s:
                out[-1][1] += w
            else:
                out.append([s, list(w)])
        if len(out) == len(runs):
            break
        runs = out
    return [(s, w) for s, w in runs]


@query("win_run_smoothing")
def win_run_smoothing(spark, sf_dir):
    """Events of a user as one-word runs, smoothed; one user's few events at a time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "event_id"])
        runs = smooth_runs([(s, [i]) for s, i in zip(pdf["event_type"], pdf["event_id"])])
        return pd.DataFrame([(int(pdf["user_id"].iloc[0]), k, s, len(w)) for k, (s, w) in enumerate(runs)], columns=["user_id", "run", "speaker", "n"])

    return inputs.load(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts").groupBy("user_id").applyInPandas(run, "user_id long, run int, speaker string, n int")


@query("win_word_guard", "SELECT conv_id, turn, len(string_split(text, ' ')) >= 6 AND lower(regexp_replace(text, '\\s+', '', 'g')) = lower(regexp_replace(array_to_string(string_split(text, ' '), ''), '\\s+', '', 'g')) AS ok FROM conversations")
def win_word_guard(spark, sf_dir):
    w = F.split("text", " ")
    flat = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    return inputs.load(spark, sf_dir, "conversations").select("conv_id", "turn", ((F.size(w) >= 6) & (flat(F.col("text")) == flat(F.array_join(w, "")))).alias("ok"))


def keep_unlike_last(items: Column, same) -> Column:
    """Fold over an ordered array: each item that is not `same` as the last one kept."""
    return F.aggregate(items, F.slice(items, 1, 1), lambda kept, x: F.when(same(F.element_at(kept, -1), x), kept).otherwise(F.concat(kept, F.array(x))))


def keep_unlike_any(items: Column, same) -> Column:
    """Fold over an ordered array: each item that is `same` as none kept before."""
    return F.aggregate(items, F.slice(items, 1, 0), lambda kept, x: F.when(F.exists(kept, lambda k: same(k, x)), kept).otherwise(F.concat(kept, F.array(x))))


def _overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a.w, b.w)) >= 0.70 * F.greatest(F.size(a.w), F.size(b.w))


def drop_consecutive(rows: DataFrame, key: str, pos: str, text: str) -> DataFrame:
    """(key, pos, text) without rows that repeat the last kept one: equal, or 70 % of the larger word set shared."""
    low = F.lower(F.col(text))
    items = rows.where(F.trim(text) != "").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), F.col(text).alias("text"), low.alias("low"), F.array_distinct(T.words(low)).alias("w")))).alias("items"))
    kept = keep_unlike_last(F.col("items"), lambda a, b: (a.low == b.low) | _overlap(a, b))
    return items.select(key, F.explode(F.when(F.size("items") > 0, kept)).alias("x")).select(key, F.col("x.pos").alias(pos), F.col("x.text").alias(text))


@query("win_consecutive_dup")
def win_consecutive_dup(spark, sf_dir):
    return drop_consecutive(inputs.lines(spark, sf_dir), "doc_id", "pos", "line")


_SENT = "s AS (SELECT doc_id, unnest(range(0, len(l))) AS pos, unnest(l) AS s FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[.!?]\\s+'), lambda x: trim(x) <> '') AS l FROM documents))"


@query("win_sentence_dup", f"WITH {_SENT} SELECT doc_id, pos, s FROM s QUALIFY lower(regexp_replace(s, '[^\\p{{L}}\\p{{N}}_]', '', 'g')) IS DISTINCT FROM lag(lower(regexp_replace(s, '[^\\p{{L}}\\p{{N}}_]', '', 'g'))) OVER (PARTITION BY doc_id ORDER BY pos)")
def win_sentence_dup(spark, sf_dir):
    s = inputs.load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.filter(F.split("text", r"[.!?]\s+"), lambda x: F.trim(x) != "")).alias("pos", "s"))
    norm = F.lower(F.regexp_replace("s", r"[^\p{L}\p{N}_]", ""))
    x = s.withColumn("norm", norm).withColumn("before", F.lag("norm").over(W.partitionBy("doc_id").orderBy("pos")))
    return x.where(~F.col("norm").eqNullSafe(F.col("before"))).select("doc_id", "pos", "s")


def near(a: Column, b: Column) -> Column:
    """Two term sets say the same: three shared and 60 % of the smaller, or two or more and one inside the other."""
    n, x, y = F.size(F.array_intersect(a, b)), F.size(a), F.size(b)
    return (y > 0) & (x > 0) & (((n >= 3) & (n >= 0.6 * F.least(x, y))) | ((y >= 2) & ((n == y) | (n == x))))


def _points(spark, sf_dir) -> DataFrame:
    """(doc_id, pos, text, terms, nums): the lines of a document stand for the points of a meeting."""
    rows = inputs.lines(spark, sf_dir).withColumn("text", F.concat("line", F.lit(" $"), (F.col("pos") % 3 * 50).cast("string")))
    return rows.select("doc_id", F.struct("pos", "text", T.task_terms(F.col("text")).alias("terms"), F.array_distinct(F.regexp_extract_all("text", F.lit(r"([0-9][0-9,.]*)"), F.lit(1))).alias("nums")).alias("x"))


def _fold(points: DataFrame, same) -> DataFrame:
    items = points.groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias("items"))
    return items.select("doc_id", F.explode(keep_unlike_any(F.col("items"), same)).alias("x")).select("doc_id", "x.pos", "x.text")


@query("win_near_dup_greedy")
def win_near_dup_greedy(spark, sf_dir):
    return _fold(_points(spark, sf_dir), lambda k, x: near(k.terms, x.terms))


@query("win_repeated_figures")
def win_repeated_figures(spark, sf_dir):
    def same(k, x):
        n = F.size(F.array_intersect(k.terms, x.terms))
        return F.arrays_overlap(k.nums, x.nums) & (n >= F.greatest(F.lit(2), F.floor(F.least(F.size(k.terms), F.size(x.terms)) * 0.6)))

    return _fold(_points(spark, sf_dir), same)


_T = _TERMS.replace("(x)", "(line)").replace("lower(x)", "lower(line)")


@query("win_restatement", f"""WITH {inputs.LINES}, p AS (SELECT doc_id, pos, {_T} AS terms FROM lines)
    SELECT DISTINCT a.doc_id, a.pos FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos < a.pos WHERE len(a.terms) > 0 AND len(b.terms) > 0 AND len(list_intersect(a.terms, b.terms)) >= greatest(3, ceil(0.85 * greatest(len(a.terms), len(b.terms))))""")
def win_restatement(spark, sf_dir):
    """Points that an earlier one of the document restates. A document is folded in its own row; only the rows of an id that
    occurs again are brought together."""
    d = inputs.load(spark, sf_dir, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL")
    again = d.groupBy("doc_id").count().where("count > 1").select("doc_id")
    terms = F.transform(F.split("text", "\n"), lambda x: T.task_terms(x))
    n = again.count()
    again = F.broadcast(again) if n <= 1_000_000 else again
    once = (d.join(again, "doc_id", "left_anti") if n else d).select("doc_id", terms.alias("terms"))

    def fold(parts):
        for pdf in parts:
            found = [(i, restated(enumerate(x))) for i, x in zip(pdf["doc_id"], pdf["terms"])]
            yield pd.DataFrame([(i, p) for i, ps in found for p in ps], columns=["doc_id", "pos"])

    def fold_rows(pdf: pd.DataFrame) -> pd.DataFrame:
        found = restated((i, t) for x in pdf["terms"] for i, t in enumerate(x))
        return pd.DataFrame({"doc_id": pdf["doc_id"].iloc[0], "pos": found})

    schema = "doc_id long, pos int"
    found = once.mapInPandas(fold, schema)
    if not n:
        return found
    more = d.join(again, "doc_id", "left_semi").select("doc_id", terms.alias("terms"))
    return found.union(more.groupBy("doc_id").applyInPandas(fold_rows, schema))


def restated(points) -> list[int]:
    """Positions of points (position, terms) that share three terms, and 85 % of the larger set, with one of a lower position.

    Two sets that share so much share one of the few first terms of each, in one order of all terms: points meet by such a term,
    rare ones first. Equal sets are one entry, at its least position.
    """
    places: dict = {}
    for at, terms in points:
        if len(terms) >= 3:  # three are to be shared
            places.setdefault(frozenset(terms), []).append(at)
    often = Counter(t for x in places for t in x)
    index: dict = {}
    out = set()
    for terms, at in sorted(places.items(), key=lambda x: min(x[1])):
        first, n = min(at), len(terms)
        out.update(p for p in at if p > first)
        keys = sorted(terms, key=lambda t: (often[t], t))[: n + (-85 * n // 100) + 1]
        seen = {}
        for other, q in (y for k in keys for y in index.get(k, ())):
            seen[id(other)] = other, q
        if first not in out and any(q < first and 100 * len(terms & other) >= 85 * max(n, len(other)) and len(terms & other) >= 3 for other, q in seen.values()):
            out.add(first)
        for k in keys:
            index.setdefault(k, []).append((terms, first))
    return sorted(out)


@query("win_merge_passes", f"WITH {inputs.LINES}, u AS (SELECT doc_id, 0 AS pass, pos, line FROM lines WHERE pos % 2 = 0 UNION ALL SELECT doc_id, 1, pos, line FROM lines WHERE pos % 3 = 0), k AS (SELECT *, trim(regexp_replace(lower(line), '[^a-z0-9 ]+', '', 'g')) AS key FROM u) SELECT doc_id, pass, pos FROM k WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY pass, pos) = 1")
def win_merge_passes(spark, sf_dir):
    """Items of a main and a focused pass, once for each key, the main pass first."""
    l = inputs.lines(spark, sf_dir)
    u = l.where("pos % 2 = 0").withColumn("pass", F.lit(0)).unionByName(l.where("pos % 3 = 0").withColumn("pass", F.lit(1))).withColumn("key", T.task_key(F.col("line")))
    return u.where("key <> ''").groupBy("doc_id", "key").agg(F.min(F.struct("pass", "pos")).alias("x")).select("doc_id", "x.pass", "x.pos")


@query("win_ordered_dedup", f"WITH {inputs.LINES} SELECT doc_id, pos, line FROM lines QUALIFY row_number() OVER (PARTITION BY doc_id, lower(line) ORDER BY pos) = 1")
def win_ordered_dedup(spark, sf_dir):
    """First of lines equal but for case: an aggregate by key, which combines before the shuffle, not a sort."""
    first = inputs.lines(spark, sf_dir).groupBy("doc_id", F.lower("line").alias("key")).agg(F.min(F.struct("pos", "line")).alias("x"))
    return first.select("doc_id", "x.pos", "x.line")


# ---- loops at the end of a segment: small strings, many rules on positions, so Arrow batches of plain Python


def trim_loop(text: str, least: int = 3, most: int = 6) -> str:
    """text without a phrase of up to `most` words that repeats at its end `least` times or more, one copy kept."""
    w = text.split()
    if len(w) < most * least:
        return text
    found: list[tuple[int, int]] = []
    for size in range(1, most + 1):
        for skip in range(size + 1):
            end = len(w) - skip
            if end >= size * least:
                at = end - size
                while at >= size and w[at - size : at] == w[end - size : end]:
                    at -= size
                if (end - at) // size >= least and at > 0:
                    found.append((at, at + size))
    if not found:
        return text
    first = min(at for at, _ in found)
    kept = w[: next(end for at, end in found if at == first)]
    while kept and kept[-1].lower() in DANGLING:
        kept.pop()
    out = " ".join(kept)
    return out if len(out) < len(text) - 5 else text


def trim_suffix(text: str, least: int = 15) -> str:
    """text without a tail of `least` characters or more that occurs before it; tails shrink from half the text by five."""
    for n in range(len(text) // 2, least - 1, -5) if len(text) >= 2 * least else ():
        rest = text[:-n].strip()
        if rest and text[-n:].strip().lower() in rest.lower():
            return rest
    return text


def trim_garbled(text: str, tail: int = 8, share: float = 0.5) -> str:
    """text cut where its last words begin to recycle each other."""
    w = text.split()
    unlike = lambda a: len({x.lower() for x in w[a : a + tail]}) / tail > share
    if len(w) < 2 * tail or unlike(len(w) - tail):
        return text
    cut = next((a + 1 for a in range(len(w) - tail, len(w) - 2 * tail, -1) if unlike(a)), len(w) - tail)
    return " ".join(w[:cut])


def _udf(f):
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(f)

    return run


def _looping(spark, sf_dir) -> DataFrame:
    tail = F.element_at(F.split("line", " "), -1)
    return inputs.lines(spark, sf_dir).select("doc_id", "pos", F.concat_ws(" ", "line", *[tail] * 4, F.lit("and the")).alias("x"))


@query("win_trailing_loop")
def win_trailing_loop(spark, sf_dir):
    return _looping(spark, sf_dir).select("doc_id", "pos", _udf(trim_loop)("x").alias("y"))


@query("win_trailing_suffix")
def win_trailing_suffix(spark, sf_dir):
    return _looping(spark, sf_dir).select("doc_id", "pos", _udf(trim_suffix)("x").alias("y"))


@query("win_garbled_tail")
def win_garbled_tail(spark, sf_dir):
    return _looping(spark, sf_dir).select("doc_id", "pos", _udf(trim_garbled)("x").alias("y"))


def _loops(words: list[str]) -> tuple[bool, bool]:
    """Whether one word has 70 % of five or more, and one pair 40 % of seven or more pairs."""
    low = [w.lower() for w in words]
    one = len(low) >= 5 and max(Counter(low).values()) >= 0.70 * len(low)
    two = len(low) >= 8 and max(Counter(zip(low, low[1:])).values()) >= 0.40 * (len(low) - 1)
    return one, two


def salvage(text: str) -> str | None:
    """The segment, or what is good of it before a loop, or None."""
    for which in (0, 1):
        w = text.split()
        if (which == 0 or len(w) >= 8) and _loops(w)[which]:
            kept = trim_loop(text, least=2)
            if len(kept.split()) < 3 or kept == text:
                return None
            text = kept
    return text


def unless_looping(text: str | None) -> str:
    """The segment, or nothing if one word still has 70 % of it."""
    return "" if not text or _loops(text.split())[0] else text


def clean_segments(rows: DataFrame, key: str, pos: str, text: str) -> DataFrame:
    """(key, pos, text) of segments that are no hallucinations. Gates on columns run first, so that the Python step only sees
    what they leave; a closing remark at the end of a key goes if anything else is left."""
    t = F.trim(text)
    w = T.words(t)
    long = F.filter(w, lambda x: F.length(x) >= 8)
    first = F.regexp_replace(F.lower(F.get(w, F.lit(0))), "[.,!?।]+$", "")
    bad = ((F.size(w) <= 2) & F.exists(w, lambda x: F.lower(x).isin(SIGN_OFF))) | first.isin(SIGN_OFF) | ((F.size(long) > 0) & (F.size(F.filter(long, T.char_loop)) >= 0.5 * F.size(long)))
    x = rows.where((t != "") & ~F.coalesce(bad, F.lit(False))).select(key, pos, t.alias("t"))
    # the second Python step takes the cleaned text as its argument, so that the patterns run once
    x = x.withColumn("t", _udf(salvage)("t")).withColumn("t", _udf(unless_looping)(T.remove_hallucinations(F.col("t")))).where("t <> ''")
    own = W.partitionBy(key)
    x = x.withColumn("last", F.max(pos).over(own) == F.col(pos)).withColumn("n", F.count("*").over(own))
    return x.where(~(F.col("last") & (F.col("n") > 1) & F.lower(F.trim("t")).isin(CLOSINGS))).select(key, pos, F.col("t").alias(text))


@query("agg_word_counts", f"WITH {inputs.LINES}, w AS (SELECT doc_id, pos, w, count(*) AS n FROM (SELECT doc_id, pos, unnest(list_filter(string_split(lower(line), ' '), lambda x: x <> '')) AS w FROM lines) GROUP BY ALL) SELECT doc_id, pos, round(max(n) / sum(n), 6) AS share FROM w GROUP BY doc_id, pos")
def agg_word_counts(spark, sf_dir):
    w = inputs.lines(spark, sf_dir).select("doc_id", "pos", F.explode(F.filter(F.split(F.lower("line"), " "), lambda x: x != "")).alias("w")).groupBy("doc_id", "pos", "w").count()
    return w.groupBy("doc_id", "pos").agg(F.round(F.max("count") / F.sum("count"), 6).alias("share"))


@query("agg_bigram_counts", f"WITH {inputs.LINES}, l AS (SELECT doc_id, pos, list_filter(string_split(lower(line), ' '), lambda x: x <> '') AS l FROM lines), b AS (SELECT doc_id, pos, l[i] AS a, l[i + 1] AS b, count(*) AS n FROM (SELECT doc_id, pos, l, unnest(range(1, len(l))) AS i FROM l) GROUP BY ALL) SELECT doc_id, pos, round(max(n) / sum(n), 6) AS share FROM b GROUP BY doc_id, pos")
def agg_bigram_counts(spark, sf_dir):
    l = inputs.lines(spark, sf_dir).select("doc_id", "pos", F.filter(F.split(F.lower("line"), " "), lambda x: x != "").alias("l")).where(F.size("l") > 1)
    b = l.select("doc_id", "pos", F.explode(F.arrays_zip(F.expr("slice(l, 1, size(l) - 1)").alias("a"), F.expr("slice(l, 2, size(l) - 1)").alias("b"))).alias("x")).groupBy("doc_id", "pos", "x").count()
    return b.groupBy("doc_id", "pos").agg(F.round(F.max("count") / F.sum("count"), 6).alias("share"))


@query("agg_failure_reasons", "SELECT event_type AS reason, count(*) AS n FROM events WHERE value > 100 GROUP BY event_type")
def agg_failure_reasons(spark, sf_dir):
    return inputs.load(spark, sf_dir, "events").where("value > 100").groupBy(F.col("event_type").alias("reason")).agg(F.count("*").alias("n"))


@query("agg_levels", "SELECT user_id, round(sqrt(avg(value * value)), 4) AS rms, round(20 * log10(sqrt(avg(value * value))), 4) AS dbfs, max(abs(value)) AS peak, round(avg(CASE WHEN abs(value) >= 150 THEN 1.0 ELSE 0.0 END), 6) AS clipped FROM events GROUP BY user_id")
def agg_levels(spark, sf_dir):
    rms = F.sqrt(F.avg(F.col("value") * F.col("value")))
    return inputs.load(spark, sf_dir, "events").groupBy("user_id").agg(F.round(rms, 4).alias("rms"), F.round(20 * F.log10(rms), 4).alias("dbfs"), F.max(F.abs("value")).alias("peak"), F.round(F.avg(F.when(F.abs("value") >= 150, 1.0).otherwise(0.0)), 6).alias("clipped"))


@query("agg_mom_counts", "SELECT conv_id, count(*) FILTER (role = 'user') AS points, count(*) FILTER (role = 'assistant') AS decisions, count(*) FILTER (role = 'system') AS actions FROM conversations GROUP BY conv_id")
def agg_mom_counts(spark, sf_dir):
    n = lambda r: F.count_if(F.col("role") == r)
    return inputs.load(spark, sf_dir, "conversations").groupBy("conv_id").agg(n("user").alias("points"), n("assistant").alias("decisions"), n("system").alias("actions"))


@query("agg_term_frequency", "SELECT t, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Z][a-z]*[A-Z][A-Za-z]*')) AS t FROM documents) GROUP BY t HAVING count(*) >= 3")
def agg_term_frequency(spark, sf_dir):
    t = inputs.load(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]*[A-Z][A-Za-z]*"), F.lit(0))).alias("t"))
    return t.groupBy("t").agg(F.count("*").alias("n")).where("n >= 3")
