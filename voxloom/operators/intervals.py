"""Interval joins between segments and speaker turns of one meeting, and the reassignments built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxloom.plans import inputs
from voxloom.plans.registry import query


def max_overlap(segments: DataFrame, turns: DataFrame, width: float | None = None) -> DataFrame:
    """(meeting, no, turn): for each segment the turn it overlaps most, the first of equals; without any, the nearest midpoint.

    segments: meeting, no, start, stop; turns: meeting, turn, t_start, t_stop. The join is an equi-join on the meeting with a
    range condition; with `width` both sides are also bucketed by time, for meetings too long for one task. Argmax is an
    aggregate that combines before the shuffle, so no window sorts the pairs. The midpoint branch only sees segments without
    a hit.
    """
    s, t = segments.select("meeting", "no", "start", "stop"), turns.select("meeting", "turn", "t_start", "t_stop")
    on = ["meeting"]
    a, b = s, t
    if width:
        cells = lambda x, y: F.explode(F.sequence(F.floor(F.col(x) / width), F.floor(F.col(y) / width)))
        a, b, on = s.withColumn("cell", cells("start", "stop")), t.withColumn("cell", cells("t_start", "t_stop")), ["meeting", "cell"]
    over = F.least("stop", "t_stop") - F.greatest("start", "t_start")
    hit = a.join(b, on).where((F.col("t_start") < F.col("stop")) & (F.col("start") < F.col("t_stop")) & (over > 0))
    hit = hit.groupBy("meeting", "no").agg(F.max_by("turn", F.struct(over, -F.col("turn"))).alias("turn"))
    away = F.abs((F.col("start") + F.col("stop")) / 2 - (F.col("t_start") + F.col("t_stop")) / 2)
    miss = s.join(hit, ["meeting", "no"], "left_anti").join(t, "meeting").groupBy("meeting", "no").agg(F.min_by("turn", F.struct(away, "turn")).alias("turn"))
    return hit.unionByName(miss)


def overlap_sql(s: str, t: str) -> str:
    """The same over relations s(meeting, no, start, stop) and t(meeting, turn, t_start, t_stop)."""
    return f"""SELECT meeting, no, turn FROM (SELECT s.meeting, s.no, t.turn, row_number() OVER (PARTITION BY s.meeting, s.no
        ORDER BY CASE WHEN least(stop, t_stop) - greatest(start, t_start) > 0 THEN 0 ELSE 1 END, CASE WHEN least(stop, t_stop) - greatest(start, t_start) > 0 THEN -(least(stop, t_stop) - greatest(start, t_start)) ELSE abs((start + stop) / 2 - (t_start + t_stop) / 2) END, t.turn) AS r
        FROM {s} s JOIN {t} t USING (meeting)) WHERE r = 1"""


_TURNS = "t AS (SELECT meeting, no AS turn, start AS t_start, stop AS t_stop FROM spans WHERE kind = 'click')"
_SEGS = "s AS (SELECT meeting, no, start, stop FROM spans WHERE kind = 'view')"


def _both(spark, sf_dir):
    x = inputs.spans(spark, sf_dir)
    return x.where("kind = 'view'"), x.where("kind = 'click'").select("meeting", F.col("no").alias("turn"), F.col("start").alias("t_start"), F.col("stop").alias("t_stop"))


@query("join_max_overlap", f"WITH {inputs.SPANS}, {_SEGS}, {_TURNS} {overlap_sql('s', 't')}")
def join_max_overlap(spark, sf_dir):
    return max_overlap(*_both(spark, sf_dir))


@query("join_nearest_by_time", f"WITH {inputs.SPANS}, s AS (SELECT meeting, no, start, stop FROM spans WHERE kind = 'error'), {_TURNS} {overlap_sql('s', 't')}")
def join_nearest_by_time(spark, sf_dir):
    x = inputs.spans(spark, sf_dir)
    return max_overlap(x.where("kind = 'error'"), _both(spark, sf_dir)[1])


@query(
    "join_word_speaker",
    f"""WITH {inputs.SPANS}, {_TURNS}, s AS (SELECT meeting, no * 4 + k AS no, start + (stop - start) * k / 4 AS start, start + (stop - start) * (k + 1) / 4 AS stop FROM spans, range(4) r(k) WHERE kind = 'view'),
    w AS ({overlap_sql('s', 't')}), i AS (SELECT *, CASE WHEN turn IS DISTINCT FROM lag(turn) OVER (PARTITION BY meeting, no // 4 ORDER BY no) THEN 1 ELSE 0 END AS fresh FROM w)
    SELECT meeting, no // 4 AS segment, sum(fresh) OVER (PARTITION BY meeting, no // 4 ORDER BY no) AS run, turn, no FROM i""",
)
def join_word_speaker(spark, sf_dir):
    """Words (quarters of a segment) get turns, and neighbours with one turn form runs."""
    segs, turns = _both(spark, sf_dir)
    k = segs.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    at = lambda i: F.col("start") + (F.col("stop") - F.col("start")) * i / 4
    words = k.select("meeting", (F.col("no") * 4 + F.col("k")).alias("no"), at(F.col("k")).alias("start"), at(F.col("k") + 1).alias("stop"))
    order = W.partitionBy("meeting", "segment").orderBy("no")
    found = max_overlap(words, turns).withColumn("segment", F.floor(F.col("no") / 4))
    fresh = F.when(F.col("turn").eqNullSafe(F.lag("turn").over(order)), 0).otherwise(1)
    return found.withColumn("fresh", fresh).select("meeting", "segment", F.sum("fresh").over(order).alias("run"), "turn", "no")


@query(
    "join_gap_speech",
    f"""WITH {inputs.SPANS}, {_TURNS}, g AS (SELECT meeting, no, stop AS g0, lead(start) OVER (PARTITION BY meeting ORDER BY no) AS g1 FROM (SELECT meeting, no, start, start + (stop - start) / 2 AS stop FROM spans WHERE kind = 'view')),
    o AS (SELECT g.meeting, greatest(0, least(g1, t_stop) - greatest(g0, t_start)) AS x FROM g JOIN t ON g.meeting = t.meeting AND t_start < g1 AND g0 < t_stop WHERE g1 - g0 >= 2.0)
    SELECT meeting, round(sum(x), 2) AS lost FROM o GROUP BY meeting""",
)
def join_gap_speech(spark, sf_dir):
    """Seconds of turns inside the gaps of two seconds or more between segments; overlapping turns count twice."""
    segs, turns = _both(spark, sf_dir)
    segs = segs.withColumn("stop", F.col("start") + (F.col("stop") - F.col("start")) / 2)
    gaps = segs.select("meeting", F.col("stop").alias("g0"), F.lead("start").over(W.partitionBy("meeting").orderBy("no")).alias("g1")).where("g1 - g0 >= 2.0")
    hit = gaps.join(turns, "meeting").where("t_start < g1 AND g0 < t_stop")
    return hit.groupBy("meeting").agg(F.round(F.sum(F.greatest(F.lit(0.0), F.least("g1", "t_stop") - F.greatest("g0", "t_start"))), 2).alias("lost"))


def talk_time(turns: DataFrame) -> DataFrame:
    """(meeting, speaker, total, n, average) of turns (meeting, speaker, start, stop)."""
    d = F.col("stop") - F.col("start")
    return turns.groupBy("meeting", "speaker").agg(F.sum(d).alias("total"), F.count("*").alias("n"), F.avg(d).alias("average"))


def phantoms(turns: DataFrame, total: float = 4.0, count: int = 2, average: float = 2.0) -> DataFrame:
    """(meeting, speaker) of speakers below all three limits, unless a meeting has no other."""
    t = talk_time(turns).withColumn("phantom", (F.col("total") < total) & (F.col("n") <= count) & (F.col("average") < average))
    return t.withColumn("real", F.sum((~F.col("phantom")).cast("int")).over(W.partitionBy("meeting"))).where("phantom AND real > 0").select("meeting", "speaker")


def reassign(turns: DataFrame, gone: DataFrame) -> DataFrame:
    """turns (meeting, turn, speaker, start, stop) with those of `gone` speakers given to the speaker they overlap most."""
    gone = gone.withColumn("gone", F.lit(True))
    marked = turns.join(gone, ["meeting", "speaker"], "left")
    real = marked.where("gone IS NULL")
    to = real.select("meeting", "turn", F.col("start").alias("t_start"), F.col("stop").alias("t_stop"))
    lost = marked.where("gone").select("meeting", F.col("turn").alias("no"), "start", "stop")
    named = max_overlap(lost, to).join(real.select("meeting", "turn", F.col("speaker").alias("to")), ["meeting", "turn"]).select("meeting", F.col("no").alias("turn"), "to")
    return marked.join(named, ["meeting", "turn"], "left").select("meeting", "turn", F.coalesce("to", "speaker").alias("speaker"), F.col("to").isNotNull().alias("moved"))


def event_turns(spark, sf_dir) -> DataFrame:
    x = inputs.spans(spark, sf_dir)
    return x.select("meeting", F.row_number().over(W.partitionBy("meeting").orderBy("start", "kind")).cast("long").alias("turn"), F.col("kind").alias("speaker"), "start", "stop")


_EVENT_TURNS = "u AS (SELECT meeting, row_number() OVER (PARTITION BY meeting ORDER BY start, kind) AS turn, kind AS speaker, start, stop FROM spans)"
_TALK = "k AS (SELECT meeting, speaker, sum(stop - start) AS total, count(*) AS n, avg(stop - start) AS average FROM u GROUP BY meeting, speaker)"


def _reassign_sql(gone: str) -> str:
    return f"""WITH {inputs.SPANS}, {_EVENT_TURNS}, {_TALK}, gone AS ({gone}), s AS (SELECT u.meeting, turn AS no, start, stop FROM u SEMI JOIN gone USING (meeting, speaker)),
    t AS (SELECT u.meeting, turn, start AS t_start, stop AS t_stop FROM u ANTI JOIN gone USING (meeting, speaker)), m AS ({overlap_sql('s', 't')})
    SELECT u.meeting, u.turn, coalesce(r.speaker, u.speaker) AS speaker, r.speaker IS NOT NULL AS moved FROM u LEFT JOIN m ON u.meeting = m.meeting AND u.turn = m.no LEFT JOIN u r ON r.meeting = m.meeting AND r.turn = m.turn"""


#: The limits for driver tables, whose turns last hours.
_LIMITS = {"total": 2_450_000.0, "count": 11, "average": 250_000.0}
_GONE = f"SELECT meeting, speaker FROM (SELECT *, total < {_LIMITS['total']} AND n <= {_LIMITS['count']} AND average < {_LIMITS['average']} AS phantom FROM k) QUALIFY phantom AND count(*) FILTER (NOT phantom) OVER (PARTITION BY meeting) > 0"


@query("join_phantom_reassign", _reassign_sql(_GONE))
def join_phantom_reassign(spark, sf_dir):
    t = event_turns(spark, sf_dir)
    return reassign(t, phantoms(t, **_LIMITS))


@query("phantom_rule", f"WITH {inputs.SPANS}, {_EVENT_TURNS}, {_TALK} {_GONE}")
def phantom_rule(spark, sf_dir):
    return phantoms(event_turns(spark, sf_dir), **_LIMITS)


def beyond_top(turns: DataFrame, most: int) -> DataFrame:
    """(meeting, speaker) of all but the `most` speakers with the longest total."""
    return talk_time(turns).withColumn("r", F.row_number().over(W.partitionBy("meeting").orderBy(F.desc("total"), "speaker"))).where(F.col("r") > most).select("meeting", "speaker")


@query("join_cap_reassign", _reassign_sql("SELECT meeting, speaker FROM k QUALIFY row_number() OVER (PARTITION BY meeting ORDER BY total DESC, speaker) > 3"))
def join_cap_reassign(spark, sf_dir):
    t = event_turns(spark, sf_dir)
    return reassign(t, beyond_top(t, 3))


@query("topk_cap_speakers", f"WITH {inputs.SPANS}, {_EVENT_TURNS}, {_TALK} SELECT meeting, speaker FROM k QUALIFY row_number() OVER (PARTITION BY meeting ORDER BY total DESC, speaker) <= 3")
def topk_cap_speakers(spark, sf_dir):
    t = talk_time(event_turns(spark, sf_dir))
    return t.withColumn("r", F.row_number().over(W.partitionBy("meeting").orderBy(F.desc("total"), "speaker"))).where("r <= 3").select("meeting", "speaker")


@query("agg_talk_time", f"WITH {inputs.SPANS}, {_EVENT_TURNS}, {_TALK} SELECT meeting, speaker, round(total, 2) AS total, n, round(average, 2) AS average FROM k")
def agg_talk_time(spark, sf_dir):
    return talk_time(event_turns(spark, sf_dir)).select("meeting", "speaker", F.round("total", 2).alias("total"), "n", F.round("average", 2).alias("average"))


@query("agg_support", f"WITH {inputs.SPANS}, {_EVENT_TURNS}, {_TALK} SELECT meeting, speaker, round(total / sum(total) OVER (PARTITION BY meeting), 6) AS support FROM k")
def agg_support(spark, sf_dir):
    return talk_time(event_turns(spark, sf_dir)).select("meeting", "speaker", F.round(F.col("total") / F.sum("total").over(W.partitionBy("meeting")), 6).alias("support"))


@query("win_transcript_gaps", f"WITH {inputs.SPANS} SELECT meeting, no, round(lead(start) OVER (PARTITION BY meeting ORDER BY no) - (start + (stop - start) / 2), 3) AS gap FROM spans WHERE kind = 'view'")
def win_transcript_gaps(spark, sf_dir):
    s = _both(spark, sf_dir)[0]
    return s.select("meeting", "no", F.round(F.lead("start").over(W.partitionBy("meeting").orderBy("no")) - (F.col("start") + (F.col("stop") - F.col("start")) / 2), 3).alias("gap"))
