"""Queries of filters, predicates, language checks and dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.functions import text as T
from voxloom.operators.strings import _in, q, scalar
from voxloom.plans import inputs
from voxloom.plans.registry import query

_PLAIN = "SELECT doc_id, pos, line AS x FROM lines"
_RECORDS = "SELECT doc_id, pos, line || CASE pos % 5 WHEN 0 THEN ' motion was passed' WHEN 1 THEN ' was asked to report by Friday' WHEN 2 THEN ' were seconded and ADJOURNED' WHEN 3 THEN ' that''s all, let''s end' ELSE ' it is unclear' END AS x FROM lines"
_LOOP = "length(w) >= 8 AND len(list_distinct(string_split(w, ''))) <= 0.35 * length(w)"


@query("char_loop_word", f"WITH {inputs.LINES} SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(string_split(line, ' ')) AS w FROM lines) WHERE {_LOOP}")
def char_loop_word(spark, sf_dir):
    w = inputs.lines(spark, sf_dir).select("doc_id", F.explode(F.split("line", " ")).alias("w"))
    return w.where(T.char_loop(F.col("w"))).distinct()


@query("words_char_loops", f"""WITH {inputs.LINES} SELECT doc_id, pos FROM (SELECT doc_id, pos, list_filter(string_split(line, ' '), lambda w: length(w) >= 8) AS l FROM lines)
    WHERE len(l) > 0 AND len(list_filter(l, lambda w: {_LOOP})) >= 0.5 * len(l)""")
def words_char_loops(spark, sf_dir):
    long = F.filter(F.split("line", " "), lambda w: F.length(w) >= 8)
    rows = inputs.lines(spark, sf_dir).select("doc_id", "pos", long.alias("l"))
    return rows.where((F.size("l") > 0) & (F.size(F.filter("l", T.char_loop)) >= 0.5 * F.size("l"))).select("doc_id", "pos")


@query("filter_segments")
def filter_segments(spark, sf_dir):
    """Segments that pass all gates, in order, with the closing remark of a document dropped."""
    from voxloom.operators.sequences import clean_segments

    return clean_segments(inputs.lines(spark, sf_dir), "doc_id", "pos", "line")


@query("is_degenerate")
def is_degenerate(spark, sf_dir):
    t = F.trim("text")
    run = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(t, F.lit(r"((.)\2+)"), F.lit(1)), F.length)), F.lit(0))
    dense = F.split(F.regexp_replace(t, r"(?U)\s", ""), "")
    top = F.when(F.size(dense) > 0, T.most_frequent(dense) / F.size(dense))
    rows = inputs.load(spark, sf_dir, "documents").select("doc_id", F.length(t).alias("n"), run.alias("run"), top.alias("share"))
    return rows.where((F.col("n") >= 80) & ((F.col("run") > 40) | (F.col("share") > 0.30))).select("doc_id", "run", F.round("share", 6).alias("share"))


@query("scanned_page", "SELECT doc_id, length(trim(text)) < 40 AS scanned FROM documents")
def scanned_page(spark, sf_dir):
    return inputs.load(spark, sf_dir, "documents").select("doc_id", (F.length(F.trim("text")) < 40).alias("scanned"))


@query("transcript_too_short", "SELECT conv_id, sum(length(text)) AS n, CASE WHEN sum(length(text)) < 80 THEN 'too short' END AS note FROM conversations GROUP BY conv_id")
def transcript_too_short(spark, sf_dir):
    c = inputs.load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("n"))
    return c.select("conv_id", "n", F.when(F.col("n") < 80, "too short").alias("note"))


@query("empty_mom", "SELECT conv_id, count(*) FILTER (role = 'user') = 0 AND count(*) FILTER (role = 'assistant') = 0 AS is_empty, count(*) FILTER (role = 'system') > 0 AND count(*) FILTER (role = 'user') < 2 AS degraded FROM conversations GROUP BY conv_id")
def empty_mom(spark, sf_dir):
    n = lambda r: F.count_if(F.col("role") == r)
    return inputs.load(spark, sf_dir, "conversations").groupBy("conv_id").agg(((n("user") == 0) & (n("assistant") == 0)).alias("is_empty"), ((n("system") > 0) & (n("user") < 2)).alias("degraded"))


scalar("trivial_decision", _RECORDS, lambda x: x.rlike("(?i)" + T.CLOSING), f"regexp_matches(x, {q('(?i)' + T.CLOSING)})")
scalar("past_record", _RECORDS, lambda x: x.rlike("(?i)" + T.PAST) & ~x.rlike("(?i)" + T.FUTURE), f"regexp_matches(x, {q('(?i)' + T.PAST)}) AND NOT regexp_matches(x, {q('(?i)' + T.FUTURE)})")
scalar("meta_marker", _RECORDS, lambda x: x.rlike("(?i)" + T.META), f"regexp_matches(x, {q('(?i)' + T.META)})")
_NAME = "^[A-Z][A-Za-z''’.-]*(?:\\s+[A-Z][A-Za-z''’.-]*){0,3}$"
scalar("name_shape", "SELECT doc_id, pos, CASE pos % 4 WHEN 0 THEN 'Ann O''Neil' WHEN 1 THEN substring(line, 1, 12) WHEN 2 THEN 'Speaker 3' ELSE 'A B C D E' END AS x FROM lines",
       lambda x: x.rlike(_NAME.replace("''", "'")) & (F.length(x) <= 40) & ~x.rlike("(?i)^\\[?\\s*speaker[\\s_-]*(?:[0-9]+|[a-z])\\s*\\]?$") & ~F.lower(x).isin("unknown", "unnamed", "n/a", "none"),
       f"regexp_matches(x, '{_NAME}') AND length(x) <= 40 AND NOT regexp_matches(x, '(?i)^\\[?\\s*speaker[\\s_-]*(?:[0-9]+|[a-z])\\s*\\]?$') AND lower(x) NOT IN ('unknown', 'unnamed', 'n/a', 'none')")
scalar("correction_guard", "SELECT doc_id, pos, line || '|' || substring(line, 1, length(line) - pos % 9) AS x FROM lines",
       lambda x: F.length(F.element_at(F.split(x, "\\|"), -1)) >= 0.9 * F.length(F.element_at(F.split(x, "\\|"), 1)),
       "length(list_last(string_split(x, '|'))) >= 0.9 * length(string_split(x, '|')[1])")
scalar("mostly_other_script", "SELECT doc_id, pos, line || CASE WHEN pos % 3 = 0 THEN ' 大家好大家好大家好大家好大家好大家好大家好大家好大家好大家好大家好大家好大家好大家好大家好大家好大家好大家好' ELSE '' END AS x FROM lines",
       lambda x: (F.length(F.regexp_replace(x, r"[^\p{L}]", "")) > 0) & (F.length(F.regexp_replace(x, "[^A-Za-zऀ-ॿ]", "")) < 0.5 * F.length(F.regexp_replace(x, r"[^\p{L}]", ""))),
       "length(regexp_replace(x, '[^\\p{L}]', '', 'g')) > 0 AND length(regexp_replace(x, '[^A-Za-zऀ-ॿ]', '', 'g')) < 0.5 * length(regexp_replace(x, '[^\\p{L}]', '', 'g'))")
scalar("shrink_note", "SELECT doc_id, pos, pos + 5 AS x FROM lines", lambda x: F.greatest(x - F.lit(3) - F.lit(4), F.lit(0)).cast("long"), "CAST(greatest(x - 3 - 4, 0) AS BIGINT)")
scalar("classify_type", "SELECT doc_id, pos, CASE pos % 4 WHEN 0 THEN ' Standup, daily' WHEN 1 THEN 'INTERVIEW' WHEN 2 THEN line ELSE 'council' END AS x FROM lines",
       lambda x: F.when(F.lower(F.regexp_extract(x, r"^\s*([A-Za-z]+)", 1)).isin("standup", "interview", "council", "lecture"), F.lower(F.regexp_extract(x, r"^\s*([A-Za-z]+)", 1))).otherwise("general"),
       "CASE WHEN lower(regexp_extract(x, '^\\s*([A-Za-z]+)', 1)) IN ('standup', 'interview', 'council', 'lecture') THEN lower(regexp_extract(x, '^\\s*([A-Za-z]+)', 1)) ELSE 'general' END")
_HOST = "regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)"
_KIND = "CASE WHEN h IN ('localhost', '127.0.0.1', '::1') THEN 'local' WHEN regexp_like(h, '^(?:10\\\\.|192\\\\.168\\\\.|172\\\\.(?:1[6-9]|2[0-9]|3[01])\\\\.)') THEN 'private' ELSE 'public' END"


@query("remote_host", "SELECT page_id, h AS host, CASE WHEN h IN ('localhost', '127.0.0.1', '::1') THEN 'local' WHEN regexp_matches(h, '^(?:10\\.|192\\.168\\.|172\\.(?:1[6-9]|2[0-9]|3[01])\\.)') THEN 'private' ELSE 'public' END AS kind FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '10.0.0.' || page_id % 9 WHEN 1 THEN '172.20.1.1' WHEN 2 THEN 'localhost' ELSE regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) END AS h FROM pages)")
def remote_host(spark, sf_dir):
    n = F.col("page_id") % 4
    h = F.when(n == 0, F.concat(F.lit("10.0.0."), (F.col("page_id") % 9).cast("string"))).when(n == 1, "172.20.1.1").when(n == 2, "localhost").otherwise(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1))
    rows = inputs.load(spark, sf_dir, "pages").select("page_id", h.alias("host"))
    kind = F.when(F.col("host").isin("localhost", "127.0.0.1", "::1"), "local").when(F.col("host").rlike(r"^(?:10\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.)"), "private").otherwise("public")
    return rows.withColumn("kind", kind)


scalar("detect_language", "SELECT doc_id, pos, line || CASE WHEN pos % 3 = 0 THEN ' यह एक लंबा हिंदी वाक्य है जो गिना जाता है और बहुत लंबा है और बहुत बहुत लंबा है' ELSE '' END AS x FROM lines", T.detect_language,
       "CASE WHEN length(regexp_replace(x, '[^ऀ-ॿ]', '', 'g')) + length(regexp_replace(x, '[^A-Za-z]', '', 'g')) > 0 AND length(regexp_replace(x, '[^ऀ-ॿ]', '', 'g')) >= 0.15 * (length(regexp_replace(x, '[^ऀ-ॿ]', '', 'g')) + length(regexp_replace(x, '[^A-Za-z]', '', 'g'))) THEN 'Hindi' ELSE 'English' END")


@query("resolve_languages", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Hindi' ELSE 'English' END AS source_lang, CASE WHEN doc_id % 3 = 0 THEN 'English' ELSE 'Hindi' END AS target_lang, doc_id % 3 = 1 AS detected FROM documents")
def resolve_languages(spark, sf_dir):
    """The missing side is the other language; what is given on neither side is detected."""
    d = inputs.load(spark, sf_dir, "documents").withColumns({"given": F.when(F.col("doc_id") % 3 == 0, "Hindi"), "wanted": F.when(F.col("doc_id") % 3 == 2, "Hindi")})
    other = lambda c: F.when(c == "Hindi", "English").when(c == "English", "Hindi")
    source = F.coalesce("given", other(F.col("wanted")), T.detect_language(F.col("text")))
    return d.select("doc_id", source.alias("source_lang"), F.coalesce("wanted", other(source)).alias("target_lang"), (F.col("given").isNull() & F.col("wanted").isNull()).alias("detected"))


_MIXED = "SELECT doc_id, pos, line || ' 60 H2O Kafka MinIO words ' || pos || 'x' AS x FROM lines"
scalar("content_chars", _MIXED, lambda x: F.length(T.content_chars(x)).cast("long"), None)


@query("agg_script_ratios", "SELECT doc_id, round(length(regexp_replace(text, '[^A-Za-zÀ-ɏ]', '', 'g')) / length(regexp_replace(text, '[^\\p{L}]', '', 'g')), 6) AS latin FROM documents WHERE length(regexp_replace(text, '[^\\p{L}]', '', 'g')) > 0")
def agg_script_ratios(spark, sf_dir):
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    return inputs.load(spark, sf_dir, "documents").where(letters > 0).select("doc_id", F.round(F.length(F.regexp_replace("text", "[^A-Za-zÀ-ɏ]", "")) / letters, 6).alias("latin"))


scalar("time_parse", "SELECT doc_id, pos, CASE pos % 4 WHEN 0 THEN (pos % 12 + 1) || ':30 pm' WHEN 1 THEN (pos % 24) || ':05' WHEN 2 THEN '1430 hrs' ELSE line END AS x FROM lines",
       lambda x: F.when(x.rlike(r"(?i)^\s*[0-9]{1,2}:[0-9]{2}\s*[ap]m\s*$"), F.format_string("%02d%s Hr", ((F.regexp_extract(x, "([0-9]{1,2}):", 1).cast("int") % 12) + F.when(x.rlike("(?i)pm"), 12).otherwise(0)), F.regexp_extract(x, ":([0-9]{2})", 1)))
       .when(x.rlike(r"^\s*(?:[01]?[0-9]|2[0-3]):[0-5][0-9]\s*$"), F.format_string("%02d%s Hr", F.regexp_extract(x, "([0-9]{1,2}):", 1).cast("int"), F.regexp_extract(x, ":([0-9]{2})", 1)))
       .when(x.rlike(r"(?i)^\s*(?:[01][0-9]|2[0-3])[0-5][0-9]\s*(?:hrs?)?\s*$"), F.concat(F.regexp_extract(x, "([0-9]{4})", 1), F.lit(" Hr"))).otherwise(""),
       "CASE WHEN regexp_matches(x, '(?i)^\\s*[0-9]{1,2}:[0-9]{2}\\s*[ap]m\\s*$') THEN lpad(CAST(CAST(regexp_extract(x, '([0-9]{1,2}):', 1) AS INT) % 12 + CASE WHEN regexp_matches(x, '(?i)pm') THEN 12 ELSE 0 END AS VARCHAR), 2, '0') || regexp_extract(x, ':([0-9]{2})', 1) || ' Hr' WHEN regexp_matches(x, '^\\s*(?:[01]?[0-9]|2[0-3]):[0-5][0-9]\\s*$') THEN lpad(regexp_extract(x, '([0-9]{1,2}):', 1), 2, '0') || regexp_extract(x, ':([0-9]{2})', 1) || ' Hr' WHEN regexp_matches(x, '(?i)^\\s*(?:[01][0-9]|2[0-3])[0-5][0-9]\\s*(?:hrs?)?\\s*$') THEN regexp_extract(x, '([0-9]{4})', 1) || ' Hr' ELSE '' END")


_STYLES = ["yyyy-MM-dd", "d-M-yyyy", "dd/MM/yyyy", "d.M.yyyy", "d MMMM yyyy", "d MMM yyyy", "dd MMMM, yyyy", "MMMM d, yyyy", "MMM d, yyyy", "MMMM d yyyy", "MMM d yyyy", "d MMM yy", "dd-MMM-yyyy", "d-MMM-yy", "EEEE, d'th' MMMM yyyy", "yyyy-MM-dd'T'HH:mm", "'on' d MMMM"]


@query("date_parse", "SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 16 THEN '' ELSE strftime(o_orderdate, '%d %b %y') END AS y FROM orders")
def date_parse(spark, sf_dir):
    """Dates written in all ways, with weekday, ordinal and time, come back as `dd Mon yy`; what is none is empty."""
    at = F.col("o_orderkey") % len(_STYLES)
    text = F.coalesce(*(F.when(at == i, F.date_format("o_orderdate", style)) for i, style in enumerate(_STYLES)))
    return inputs.load(spark, sf_dir, "orders").select("o_orderkey", T.parse_date(text).alias("y"))


@query("gap_retry_rule", "SELECT event_id, value, value > greatest(45, 0.02 * 1800) AS retry FROM events")
def gap_retry_rule(spark, sf_dir):
    return inputs.load(spark, sf_dir, "events").select("event_id", "value", (F.col("value") > F.greatest(F.lit(45), F.lit(0.02 * 1800))).alias("retry"))
