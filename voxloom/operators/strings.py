"""Queries of the string operators: each applies a column function to lines of documents in which the sought forms are planted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from voxloom.functions import text as T
from voxloom.plans import inputs
from voxloom.plans.registry import query


def scalar(key: str, sample: str, function, oracle: str | None) -> None:
    """Register y = function(x) over `sample`, SQL both engines read, over the lines (doc_id, pos, line)."""
    sql = f"WITH {inputs.LINES}, i AS ({sample}) SELECT doc_id, pos, {oracle} AS y FROM i" if oracle else None

    @query(key, sql)
    def run(spark, sf_dir):
        rows = inputs.views(spark, sf_dir, "lines").sql(sample)
        return rows.select("doc_id", "pos", function(F.col("x")).alias("y"))


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


_PLAIN = "SELECT doc_id, pos, line AS x FROM lines"
_TIMED = "SELECT doc_id, pos, (pos % 12) || ':0' || (pos % 10) || '7 seconds ' || line || ' 1:141 minute, 14 seconds 10:0110 minutes, ' || pos || ' second' AS x FROM lines"
_SPOKEN = "SELECT doc_id, pos, '[Speaker_' || (pos % 7) || '] ' || line || ' uh Speaker ' || (doc_id % 4) || ' um speaker_b said' AS x FROM lines"
_META = "SELECT doc_id, pos, line || ' (R-92, Series ' || pos || ') (implied, not explicitly stated as date) end  (assuming ' || doc_id || ').' AS x FROM lines"
_TAGS = "SELECT doc_id, pos, CASE pos % 6 WHEN 0 THEN '[speaker_' || doc_id || ']' WHEN 1 THEN 'Speaker ' || doc_id WHEN 2 THEN ' speaker-' || pos || ' ' WHEN 3 THEN 'Speaker_A' WHEN 4 THEN line ELSE 'SPEAKER' || pos END AS x FROM lines"
_TASKS = "SELECT doc_id, pos, line || CASE pos % 4 WHEN 0 THEN ' — Owner: Ann Lee — Due: next week' WHEN 1 THEN ' — Owner: unassigned — Due: TBD' WHEN 2 THEN ' - Owner: B. C. - Due: 5 May' ELSE '' END AS x FROM lines"
_VALUES = f"SELECT doc_id, pos, CASE WHEN pos % 3 = 0 THEN line WHEN pos % 3 = 1 THEN ' TBD. ' ELSE CASE doc_id % 5 WHEN 0 THEN 'N/A' WHEN 1 THEN ' . ' WHEN 2 THEN 'No One' WHEN 3 THEN 'team.' ELSE 'Teams' END END AS x FROM lines"

scalar("strip_timestamps", _TIMED, T.strip_timestamps, f"regexp_replace(x, {q(T.TIMESTAMP)}, '', 'g')")
scalar("collapse_blank_lines", "SELECT doc_id, pos, line || '\n\n\n' || pos || '\n\n\n\n\n' || line || '\n\n' AS x FROM lines", T.collapse_blank_lines, "regexp_replace(x, '\\n{3,}', chr(10) || chr(10), 'g')")
scalar("remove_fillers", _SPOKEN, T.remove_fillers, None)
scalar("collapse_repeats", "SELECT doc_id, pos, line || ' ' || line AS x FROM lines", T.collapse_repeats, None)
scalar("remove_hallucinations", "SELECT doc_id, pos, line || ' [silence] thanks for watching thanks for watching  bye ... ' || line || ' ♪♪ [upbeat music]' AS x FROM lines", T.remove_hallucinations, None)
scalar("strip_meta", _META, T.strip_meta, f"regexp_replace(regexp_replace(regexp_replace(x, '(?i)\\s*\\([^()]*{T.META.replace(chr(39), chr(39) * 2)}[^()]*\\)', '', 'g'), '\\s{{2,}}', ' ', 'g'), '^[ .,;:]+|[ .,;:]+$', '', 'g')")
scalar("clean_placeholder", _VALUES, T.clean_placeholder, f"CASE WHEN regexp_replace(lower(trim(x)), '^[ .]+|[ .]+$', '', 'g') IN {_in(T.PLACEHOLDERS)} THEN '' ELSE trim(x) END")
scalar("normalise_tag", _TAGS, T.normalise_tag, "CASE WHEN regexp_extract(trim(x), '(?i)^\\[?\\s*speaker[\\s_-]*([0-9]+)\\s*\\]?$', 1) <> '' THEN 'Speaker_' || regexp_extract(trim(x), '(?i)^\\[?\\s*speaker[\\s_-]*([0-9]+)\\s*\\]?$', 1) ELSE trim(x) END")
scalar("attendee_key", _TAGS, lambda x: F.lower(T.normalise_tag(x)), "lower(CASE WHEN regexp_extract(trim(x), '(?i)^\\[?\\s*speaker[\\s_-]*([0-9]+)\\s*\\]?$', 1) <> '' THEN 'Speaker_' || regexp_extract(trim(x), '(?i)^\\[?\\s*speaker[\\s_-]*([0-9]+)\\s*\\]?$', 1) ELSE trim(x) END)")
scalar("despeaker_summary", _SPOKEN, lambda x: F.regexp_replace(x, T.SPEAKER, "a participant"), f"regexp_replace(x, {q(T.SPEAKER)}, 'a participant', 'g')")
scalar("task_key", _TASKS, T.task_key, "trim(regexp_replace(lower(x), '[^a-z0-9 ]+', '', 'g'))")
_STEM = "CASE " + " ".join(f"WHEN length(w) > {len(s) + 2} AND suffix(w, '{s}') THEN left(w, length(w) - {len(s)}) || '{'y' if s in ('ies', 'ied') else ''}'" for s in T.SUFFIXES) + " ELSE w END"
scalar("stem", "SELECT doc_id, pos, lower(line) AS x FROM lines", lambda x: F.concat_ws(" ", F.transform(F.split(x, " "), T.stem)), f"array_to_string(list_transform(string_split(x, ' '), lambda w: {_STEM}), ' ')")
_TERMS = f"list_distinct(list_transform(list_filter(string_split(trim(regexp_replace(lower(x), '[^a-z0-9 ]+', '', 'g')), ' '), lambda w: w <> '' AND w NOT IN {_in(T.STOPWORDS)}), lambda w: {_STEM}))"
scalar("task_terms", _TASKS, lambda x: F.concat_ws(" ", F.array_sort(T.task_terms(x))), f"array_to_string(list_sort({_TERMS}), ' ')")
scalar("norm_quote", _SPOKEN, T.norm_quote, f"regexp_replace(regexp_replace(lower(x), '\\b(?:{T.FILLERS})\\b', ' ', 'g'), '[^a-z0-9]+', '', 'g')")
scalar("normalize_digits", "SELECT doc_id, pos, line || ' ०.८६ १२३४५६७९ ' || pos AS x FROM lines", lambda x: F.translate(x, "०१२३४५६७८९", "0123456789"), "translate(x, '०१२३४५६७८९', '0123456789')")
scalar("has_translatable", "SELECT doc_id, pos, CASE WHEN pos % 3 = 0 THEN '⟦' || pos || '⟧ - ⟦ २ ⟧ 12' ELSE line END AS x FROM lines", lambda x: F.regexp_replace(x, r"⟦\s*[0-9०-९]+\s*⟧", " ").rlike(r"\p{L}"), "regexp_matches(regexp_replace(x, '⟦\\s*[0-9०-९]+\\s*⟧', ' ', 'g'), '\\p{L}')")
scalar("localize_speaker", "SELECT doc_id, pos, CASE WHEN pos % 2 = 0 THEN 'Speaker_' || pos WHEN pos % 5 = 1 THEN 'speaker C' ELSE line END AS x FROM lines",
       lambda x: F.when(x.rlike("(?i)^\\[?speaker[ _-]*[0-9]+\\]?$"), F.concat(F.lit("Teilnehmer "), F.regexp_extract(x, "([0-9]+)", 1))).when(x.rlike("(?i)^\\[?speaker[ _-]*[a-z]\\]?$"), F.concat(F.lit("Teilnehmer "), (F.ascii(F.upper(F.regexp_extract(x, "(?i)([a-z])\\]?$", 1))) - 64).cast("string"))).otherwise(x),
       "CASE WHEN regexp_matches(x, '(?i)^\\[?speaker[ _-]*[0-9]+\\]?$') THEN 'Teilnehmer ' || regexp_extract(x, '([0-9]+)', 1) WHEN regexp_matches(x, '(?i)^\\[?speaker[ _-]*[a-z]\\]?$') THEN 'Teilnehmer ' || (ascii(upper(regexp_extract(x, '(?i)([a-z])\\]?$', 1))) - 64) ELSE x END")
scalar("clean_whitespace_blocks", "SELECT doc_id, pos, '  ' || line || '  \t ' || line || '  x ' AS x FROM lines", lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "\r", " "), "[ \t ]+", " ")), "trim(regexp_replace(replace(x, chr(13), ' '), '[ \t ]+', ' ', 'g'))")
scalar("ack_description", _PLAIN, lambda x: F.when(F.length(T.one_space(x)) > 400, F.concat(F.regexp_replace(F.substring(T.one_space(x), 1, 400), r"\s\S*$", ""), F.lit("…"))).otherwise(T.one_space(x)),
       "CASE WHEN length(trim(regexp_replace(x, '\\s+', ' ', 'g'))) > 400 THEN regexp_replace(left(trim(regexp_replace(x, '\\s+', ' ', 'g')), 400), '\\s\\S*$', '') || '…' ELSE trim(regexp_replace(x, '\\s+', ' ', 'g')) END")
_SOUND = reduce(lambda t, ab: f"replace({t}, '{ab[0]}', '{ab[1]}')", T.SOUNDS, "regexp_replace(lower(x), '[^a-z]', '', 'g')")
_SQUEEZED = reduce(lambda t, c: f"regexp_replace({t}, '{c}+', '{c}', 'g')", "abcdefghijklmnopqrstuvwxyz", "left(w, 1) || regexp_replace(substring(w, 2), '[aeiou]', '', 'g')")
scalar("phonetic_key", _PLAIN, T.phonetic_key, f"(SELECT {_SQUEEZED} FROM (SELECT {_SOUND} AS w))")
scalar("clean_mom_output", "SELECT doc_id, pos, 'Here is the MoM: ' || line || '\n- point ' || pos || '\n+ more\n•  \n\n\n\n\nend' AS x FROM lines",
       lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"(?im)^here\s+is\s+the\s+(?:synthesized\s+)?(?:minutes|mom)", ""), r"(?m)^[ \t]*\+\s+", "  • "), r"(?m)^[ \t]*-\s+([^S])", "  • $1"), "\n[ \t]*•[ \t]*\n", "\n"), "\n{4,}", "\n\n\n")),
       "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '(?im)^here\\s+is\\s+the\\s+(?:synthesized\\s+)?(?:minutes|mom)', '', 'g'), '(?m)^[ \\t]*\\+\\s+', '  • ', 'g'), '(?m)^[ \\t]*-\\s+([^S])', '  • \\1', 'g'), '\\n[ \\t]*•[ \\t]*\\n', chr(10), 'g'), '\\n{4,}', chr(10) || chr(10) || chr(10), 'g'))")
scalar("duration_text", "SELECT doc_id, pos, doc_id * 37 + pos * 61 AS x FROM lines", T.duration_text,
       "CASE WHEN x > 0 THEN concat_ws(' ', CASE WHEN x // 3600 > 0 THEN (x // 3600) || ' h' END, CASE WHEN x % 3600 // 60 > 0 THEN (x % 3600 // 60) || ' min' END, CASE WHEN x % 60 > 0 THEN (x % 60) || ' s' END) ELSE '' END")
scalar("bullets_to_list", "SELECT doc_id, pos, '• ' || line || '\n- None explicitly stated\n\n* item ' || pos || '\n  - ' || line AS x FROM lines",
       lambda x: F.to_json(F.filter(F.transform(F.split(x, "\n"), lambda l: F.trim(F.regexp_replace(F.trim(l), "^[•*-]+", ""))), lambda l: (l != "") & ~F.contains(F.lower(l), F.lit("none explicitly stated")))),
       "CAST(to_json(list_filter(list_transform(string_split(x, chr(10)), lambda l: trim(regexp_replace(trim(l), '^[•*-]+', ''))), lambda l: l <> '' AND NOT contains(lower(l), 'none explicitly stated'))) AS VARCHAR)")
scalar("token_estimate", _PLAIN, lambda x: F.floor(F.length(x) / 4).cast("long"), "length(x) // 4")
scalar("output_budget", _PLAIN, lambda x: F.least(F.greatest(F.floor(F.length(x) / 2), F.lit(500)) * 3, F.lit(6000)).cast("long"), "least(greatest(length(x) // 2, 500) * 3, 6000)")
#: How a model announces a translation, and how it declines one.
_PREAMBLE = r"(?i)^\s*[\"'`]*\s*(?:sure[,!.]?\s*)?(?:here(?:\s+is|'s)\s+(?:the\s+)?)?(?:translation|translated(?:\s+text)?)(?:\s+of\s+(?:the\s+)?new\s+text)?\s*(?:is)?\s*[:–—-]+\s*"
_REFUSAL = r"(?i)^\s*[\"'`(]*\s*(?:the\s+)?(?:translation\s+(?:of\s+the\s+new\s+text\s+)?is\s+not\s+(?:needed|required|necessary)|no\s+translation\s+(?:is\s+)?(?:needed|required)|(?:same\s+)?(?:text|sentence|content|input)\s+is\s+already\s+(?:written\s+)?in\s+(?:the\s+(?:target|source|same|original|requested)\s+language\b|(?:english|hindi)\b)|(?:i\s+)?can(?:'?t|not)\s+translate)"


def clean_translation(reply, original):
    """The reply without its announcement and quotes; the original where there is none or it is declined."""
    body = F.trim(F.regexp_replace(F.trim(reply), _PREAMBLE, ""))
    body = F.when(body.rlike(r"^([\"'`]).*\1$") & (F.length(body) >= 2), F.trim(F.regexp_replace(body, r"^.|.$", ""))).otherwise(body)
    return F.when((F.trim(reply) == "") | F.trim(reply).rlike(_REFUSAL) | (body == ""), original).otherwise(body)


@query("clean_translation", f"WITH {inputs.LINES} SELECT doc_id, pos, CASE pos % 4 WHEN 1 THEN line ELSE CASE pos % 4 WHEN 3 THEN line ELSE 'x' || pos || ' ok' END END AS y FROM lines WHERE trim(line) <> ''")
def clean_translation_query(spark, sf_dir):
    n, x = F.col("pos") % 4, F.concat(F.lit("x"), F.col("pos").cast("string"), F.lit(" ok"))
    reply = F.when(n == 0, F.concat(F.lit("Sure, here is the translation: \""), x, F.lit("\""))).when(n == 1, "The text is already in English.").when(n == 2, F.concat(F.lit("Translated text of the new text - "), x)).otherwise(" ")
    return inputs.lines(spark, sf_dir).where("trim(line) <> ''").select("doc_id", "pos", clean_translation(reply, F.col("line")).alias("y"))


@query("single_pass_limit", "SELECT doc_id, greatest(5000, 8192 + doc_id % 20000 - 900 - 1500 - 500) AS y FROM documents")
def single_pass_limit(spark, sf_dir):
    return inputs.load(spark, sf_dir, "documents").select("doc_id", F.greatest(F.lit(5000), F.col("doc_id") % 20000 + 8192 - 900 - 1500 - 500).alias("y"))


@query("route_model", "SELECT doc_id, length(text) // 4 AS tokens, CASE WHEN length(text) // 4 >= 5000 THEN 'long' ELSE 'default' END AS model, greatest(5000, 8192 - 900 - 1500 - 500) AS single_pass FROM documents")
def route_model(spark, sf_dir):
    d = inputs.load(spark, sf_dir, "documents")
    tokens = F.floor(F.length("text") / 4).cast("long")
    return d.select("doc_id", tokens.alias("tokens"), F.when(tokens >= 5000, "long").otherwise("default").alias("model"), F.greatest(F.lit(5000), F.lit(8192 - 900 - 1500 - 500)).alias("single_pass"))


_OWNER = r"\s*[—–-]+\s*Owner:\s*(.*?)\s*[—–-]+\s*Due:\s*(.*?)\s*$"
_UNSET = ["none", "n/a", "na", "unassigned", "unknown", "not specified", "unspecified", "not stated", "tbd", "to be determined", "not mentioned", "nil", "-", "--", "", "no one", "nobody", "not assigned", "none stated"]


def parse_action(bullet):
    """(task, assigned_to, due) of a bullet `task — Owner: x — Due: y`; values that say nothing become empty."""
    has = bullet.rlike("(?i)" + _OWNER)
    part = lambda i: F.regexp_extract(bullet, "(?i)" + _OWNER, i)
    said = lambda v: F.when(F.lower(v).isin(_UNSET), "").otherwise(v)
    return F.trim(F.regexp_replace(bullet, "(?i)" + _OWNER, "")), F.when(has, said(part(1))).otherwise(""), F.when(has, said(part(2))).otherwise("")


def _said(i: int) -> str:
    x = f"regexp_extract(x, '(?i){_OWNER}', {i})"
    return f"CASE WHEN lower({x}) IN {_in(_UNSET)} THEN '' ELSE {x} END"


@query("parse_action_bullet", f"WITH {inputs.LINES}, i AS ({_TASKS}) SELECT doc_id, pos, trim(regexp_replace(x, '(?i){_OWNER}', '')) AS task, {_said(1)} AS assigned_to, {_said(2)} AS due FROM i")
def parse_action_bullet(spark, sf_dir):
    task, owner, due = parse_action(F.col("x"))
    return inputs.views(spark, sf_dir, "lines").sql(_TASKS).select("doc_id", "pos", task.alias("task"), owner.alias("assigned_to"), due.alias("due"))


@query("fallback_metadata", f"WITH {inputs.LINES} SELECT doc_id, pos, 'D' || doc_id AS date, '10:' || pos AS time, '' AS venue FROM lines")
def fallback_metadata(spark, sf_dir):
    rows = inputs.views(spark, sf_dir, "lines").sql("SELECT doc_id, pos, line || '\nFALLBACK DATE:  D' || doc_id || ' \nFALLBACK TIME: 10:' || pos || '\n' || line AS x FROM lines")
    at = lambda k: F.trim(F.regexp_extract("x", rf"FALLBACK {k}:\s*(.+)", 1))
    return rows.select("doc_id", "pos", at("DATE").alias("date"), at("TIME").alias("time"), F.lit("").alias("venue"))


_LANGS = {"hi": "Hindi", "hin": "Hindi", "hindi": "Hindi", "devanagari": "Hindi", "en": "English", "eng": "English", "english": "English"}


@query("normalize_lang", f"SELECT doc_id, CASE WHEN lower(trim(lang)) IN ('', 'auto') THEN NULL WHEN lower(trim(lang)) IN {_in(k for k, v in _LANGS.items() if v == 'English')} THEN 'English' ELSE 'unsupported' END AS y FROM documents")
def normalize_lang(spark, sf_dir):
    key = F.lower(F.trim("lang"))
    known = F.create_map(*(F.lit(x) for kv in _LANGS.items() for x in kv))
    return inputs.load(spark, sf_dir, "documents").select("doc_id", F.when(key.isin("", "auto"), F.lit(None)).otherwise(F.coalesce(F.try_element_at(known, key), F.lit("unsupported"))).alias("y"))


@query("lang_name_to_code", "SELECT doc_id, CASE lang WHEN 'en' THEN 'en' ELSE CASE lang WHEN 'german' THEN 'de' ELSE lang END END AS y FROM documents")
def lang_name_to_code(spark, sf_dir):
    names = F.create_map(*(F.lit(x) for kv in {"english": "en", "hindi": "hi", "german": "de", "french": "fr", "spanish": "es"}.items() for x in kv))
    return inputs.load(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.try_element_at(names, F.lower("lang")), F.col("lang")).alias("y"))


@query("cache_key", "SELECT conv_id, turn, sha1(role || '|' || 'hi' || '|' || trim(regexp_replace(nfc_normalize(regexp_replace(text, '^\\[[^\\]]*\\]\\s*', '')), '\\s+', ' ', 'g'))) AS y FROM conversations")
def cache_key(spark, sf_dir):
    @F.pandas_udf("string")
    def nfc(s):
        return s.str.normalize("NFC")

    t = T.one_space(nfc(F.regexp_replace("text", r"^\[[^\]]*\]\s*", "")))
    return inputs.load(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha1(F.concat_ws("|", "role", F.lit("hi"), t)).alias("y"))
