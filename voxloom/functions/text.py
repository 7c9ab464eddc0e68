"""Column functions for transcript and document text.

Java's \\w, \\b and \\s are ASCII unless (?U) is set, and with (?U) \\w also takes combining marks, which the rules here must
not; WORD and the look-arounds EDGE_L and EDGE_R state the letters, digits and underscore that count as word characters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD, NOT_WORD = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
EDGE_L, EDGE_R = rf"(?<!{WORD})", rf"(?!{WORD})"

#: What speech models write for silence and noise, as Java patterns. Repeated groups are possessive, because a
#: backtracking group overflows the regex stack on long loops; none of them can need to give anything back.
HALLUCINATIONS = [
    r"(?:सब्सक्राइब\s*+){2,}+", r"सब्सक्राइब", rf"(?:{EDGE_L}हमेशा करने के लिए\s*+){{2,}}+", rf"(?:{EDGE_L}उपयोग करने के लिए\s*+){{2,}}+", rf"(?:{EDGE_L}कर सकते हैं\s*+){{3,}}+", rf"(?:{EDGE_L}धन्यवाद\s*+){{3,}}+", rf"(?:{EDGE_L}नमस्ते\s*+){{3,}}+",
    r"(?:subscribe\s*+){2,}+", r"(?:thanks for watching\s*+){2,}+", r"(?:thank you for watching\s*+){2,}+", r"(?:please subscribe\s*+){2,}+", r"(?:like and subscribe\s*+){2,}+", r"(?:click the bell\s*+){2,}+", r"(?:see you in the next\s*+){2,}+", r"(?:bye bye\s*+){3,}+",
    r"(?:thank you\.\s*+){3,}+", r"(?:thank you\s*+){4,}+", r"(?:you\.\s*+){4,}+", rf"(?:{EDGE_L}i see{EDGE_R}\s*+){{3,}}+", rf"(?:{EDGE_L}uh++\s*+){{4,}}+", rf"(?:{EDGE_L}um++\s*+){{4,}}+", rf"(?:{EDGE_L}hmm++\s*+){{3,}}+",
    r"^(?:\.?\s*thank you\.?\s*)++$", r"^(?:\.?\s*okay\.?\s*)++$", r"^(?:\.?\s*yes\.?\s*)++$", r"Transcribed by\s+https?://\S+", r"Subtitles by\s+\S+", r"\[silence\]", r"\[inaudible\]", r"\[crosstalk\]", r"\[background noise\]",
    rf"(?:{WORD}{{1,8}}+-){{5,}}+{WORD}{{0,8}}+", r"\.{3,}", r"(?:\s*+\.\s*+){5,}+", r"^[\s.,\-]+$", r"\[.*?music.*?\]", r"\[.*?applause.*?\]", r"\[.*?laughter.*?\]", r"♪+",
]
#: Stand-ins for an answer.
PLACEHOLDERS = ["none", "null", "n/a", "na", "nil", "tbd", "unknown", "not specified", "unspecified", "no one", "nobody", "not applicable", "team", "-", "--", ""]
#: Words that carry no content in a task, and suffixes in the order they are tried.
STOPWORDS = "a an the and or of to for on in at by with within is are be will that this it its as from up".split()
SUFFIXES = ["ingly", "edly", "ing", "ies", "ied", "ed", "es", "ly", "s"]
#: Fillers that a quote may lose, traces of a model's reasoning, records of the past, marks of the future, closings.
FILLERS = "uh|um|erm|ah|mm|hmm|like|you know|i mean|sort of|kind of"
META = r"\b(?:this is an inference|not explicitly stated|the correct output|implied[,;]|cannot be determined|no specific date (?:was )?mentioned|inferred from|assuming|presumably|it is unclear|note:|NO:)\b"
PAST = r"\b(?:was|were)\s+(?:made|seconded|approved|passed|carried|adopted|held|taken|read|introduced|opened|closed|adjourned|asked|requested|invited|thanked|noted)\b|\bpassed\s+unanimously\b|\b(?:motion|vote|roll\s*call)\s+(?:was|passed|carried)\b"
FUTURE = r"\b(?:by|before|within|no later than|upcoming|will|shall|due|deadline)\b|\bnext\s+(?:week|month|quarter|year|meeting)\b|\b(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b|\b(?:january|february|march|april|june|july|august|september|october|november|december)\b"
CLOSING = r"(?:end(?:ing)?\s+(?:this\s+)?meeting|meeting\s+(?:end|close)|wrap(?:ping)?\s+up|that'?s?\s+all|let'?s?\s+end|adjourn)"
TIMESTAMP = r"[0-9]{1,2}:[0-9]{2}[0-9]*\s*(?:[0-9]+\s*minutes?,?\s*[0-9]*\s*seconds?|[0-9]+\s*minutes?|[0-9]+\s*seconds?)"
SPEAKER = r"\[\s*[Ss]peaker[\s_-]*(?:[0-9]+|[A-Za-z])\s*\]|\b[Ss]peaker[\s_-]*(?:[0-9]+|[A-Z])\b"


def words(text: Column) -> Column:
    """The text's words, split at white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def one_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def remove_hallucinations(text: Column) -> Column:
    return one_space(reduce(lambda t, p: F.regexp_replace(t, "(?iuU)" + p, ""), HALLUCINATIONS, text))


def strip_timestamps(text: Column) -> Column:
    return F.regexp_replace(text, TIMESTAMP, "")


def remove_fillers(text: Column) -> Column:
    """Words said three times or more and doubled words become one (not had, that); uh and um go."""
    text = F.regexp_replace(text, rf"(?iu){EDGE_L}({WORD}+)(?:(?U:\s)+\1){{2,}}{EDGE_R}", "$1")
    text = F.regexp_replace(text, rf"(?iu){EDGE_L}(?!(?:had|that){EDGE_R})({WORD}+)(?U:\s)+\1{EDGE_R}", "$1")
    text = F.regexp_replace(text, rf"(?iu){EDGE_L}(?:uh|um|uh uh){EDGE_R}", "")
    return F.regexp_replace(text, "  +", " ")


def collapse_repeats(text: Column) -> Column:
    """Phrases of eight down to four words, then of one, two and three, that follow themselves, are kept once."""
    gap = r"(?U:\s)"
    for n in range(8, 3, -1):
        text = F.regexp_replace(text, rf"(?iu)({rf'(?:{WORD}+{gap}+)' * (n - 1)}{WORD}+)(?:{gap}+\1)+", "$1")
    for n in (1, 2, 3):
        text = F.regexp_replace(text, rf"(?iu){EDGE_L}({(gap + '+').join([WORD + '+'] * n)}){gap}+\1{EDGE_R}", "$1")
    text = F.regexp_replace(text, rf"{gap}+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s*([,;:।])\s*", "$1 "), r"\s*([.!?])\s*", "$1 "))


def collapse_blank_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\n{3,}", "\n\n")


def strip_meta(text: Column) -> Column:
    """Parentheses that explain reasoning go, others stay."""
    body = META.replace(r"\b(?:", r"(?:").replace(r")\b", ")")
    text = F.regexp_replace(text, rf"(?i)\s*\([^()]*\b{body}\b[^()]*\)", "")
    return F.regexp_replace(F.regexp_replace(text, r"\s{2,}", " "), r"^[ .,;:]+|[ .,;:]+$", "")


def clean_placeholder(value: Column) -> Column:
    v = F.trim(F.coalesce(value, F.lit("")))
    return F.when(F.regexp_replace(F.lower(v), r"^[ .]+|[ .]+$", "").isin(PLACEHOLDERS), "").otherwise(v)


def normalise_tag(key: Column) -> Column:
    n = F.regexp_extract(F.trim(key), r"(?i)^\[?\s*speaker[\s_-]*([0-9]+)\s*\]?$", 1)
    return F.when(n != "", F.concat(F.lit("Speaker_"), n)).otherwise(F.trim(key))


#: All but a-z, 0-9 and space, as ranges: threads of one JVM slow each other down many times over in Java's complement of a class.
NO_KEY = r"[\x00-\x1f!-/:-`{-\x{10ffff}]+"


def task_key(task: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(task), NO_KEY, ""))


def stem(w: Column) -> Column:
    out = w
    for s in reversed(SUFFIXES):
        out = F.when((F.length(w) > len(s) + 2) & w.endswith(s), F.concat(F.substring(w, F.lit(1), F.length(w) - len(s)), F.lit("y" if s in ("ies", "ied") else ""))).otherwise(out)
    return out


def task_terms(task: Column) -> Column:
    """Stemmed content words, each once."""
    return F.array_distinct(F.transform(F.filter(F.split(task_key(task), " +"), lambda w: (w != "") & ~w.isin(STOPWORDS)), stem))


def norm_quote(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), rf"\b(?:{FILLERS})\b", " "), "[^a-z0-9]+", "")


def latin_letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^A-Za-z]", ""))


def devanagari(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^\u0900-\u097f]", ""))


def detect_language(text: Column) -> Column:
    """Hindi if Devanagari has 15 % or more of both scripts' characters, else English."""
    d, l = devanagari(text), latin_letters(text)
    return F.when((d + l > 0) & (d >= 0.15 * (d + l)), "Hindi").otherwise("English")


def char_loop(word: Column) -> Column:
    """Eight characters or more of which at most 35 % are distinct."""
    return (F.length(word) >= 8) & (F.size(F.array_distinct(F.filter(F.split(word, ""), lambda c: c != ""))) <= 0.35 * F.length(word))


def content_chars(text: Column) -> Column:
    """Letters left after tokens with digits and capitalised Latin runs are dropped."""
    text = F.regexp_replace(text, rf"{WORD}*\p{{N}}{WORD}*", " ")
    text = F.regexp_replace(text, r"(?<![A-Za-z'’])[A-Z][A-Za-z'’]*", " ")
    return F.regexp_replace(text, r"[^\p{L}]", "")


def most_frequent(items: Column) -> Column:
    """How often the most frequent item of an array of strings occurs, 0 in an empty one: one pass over the sorted items."""

    def step(acc: Column, x: Column) -> Column:
        run = F.when(acc.getField("x").eqNullSafe(x), acc.getField("run") + 1).otherwise(1)
        return F.struct(x.alias("x"), run.alias("run"), F.greatest(acc.getField("best"), run).alias("best"))

    start = F.struct(F.lit(None).cast("string").alias("x"), F.lit(0).alias("run"), F.lit(0).alias("best"))
    return F.aggregate(F.array_sort(items), start, step, lambda acc: acc.getField("best"))


#: How dates are written, in the order they are tried.
DATES = [
    (r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}", "yyyy-M-d"), (r"[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}", "d-M-yyyy"), (r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", "d/M/yyyy"), (r"[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}", "d.M.yyyy"),
    (r"[0-9]{1,2} [A-Za-z]+ [0-9]{4}", "d MMMM yyyy"), (r"[0-9]{1,2} [A-Za-z]{3} [0-9]{4}", "d MMM yyyy"), (r"[0-9]{1,2} [A-Za-z]+, [0-9]{4}", "d MMMM, yyyy"), (r"[A-Za-z]+ [0-9]{1,2}, [0-9]{4}", "MMMM d, yyyy"),
    (r"[A-Za-z]{3} [0-9]{1,2}, [0-9]{4}", "MMM d, yyyy"), (r"[A-Za-z]+ [0-9]{1,2} [0-9]{4}", "MMMM d yyyy"), (r"[A-Za-z]{3} [0-9]{1,2} [0-9]{4}", "MMM d yyyy"), (r"[0-9]{1,2} [A-Za-z]{3} [0-9]{2}", "d MMM yy"),
    (r"[0-9]{1,2}-[A-Za-z]{3}-[0-9]{4}", "d-MMM-yyyy"), (r"[0-9]{1,2}-[A-Za-z]{3}-[0-9]{2}", "d-MMM-yy"),
]


def parse_date(text: Column) -> Column:
    """A date in any of the usual ways as `dd Mon yy`, '' if none fits. A weekday in front and ordinal endings do not count, and
    an ISO date may be followed by anything."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    t = F.regexp_replace(t, r"(?i)^(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?,? +", "")
    t = F.regexp_replace(t, r"([0-9])(?:st|nd|rd|th)\b", "$1")

    def parsed(x: Column) -> Column:
        iso = F.try_to_timestamp(F.nullif(F.regexp_extract(x, r"^[0-9]{4}-[0-9]{2}-[0-9]{2}", 0), F.lit("")), F.lit("yyyy-MM-dd"))
        return F.coalesce(iso, *(F.when(x.rlike(f"^{shape}$"), F.try_to_timestamp(x, F.lit(form))) for shape, form in DATES))

    # a function of one item, so that the text is made once and not once for each pattern
    return F.coalesce(F.date_format(F.get(F.transform(F.array(t), parsed), F.lit(0)), "dd MMM yy"), F.lit(""))


def capped(text: Column, most: int = 400) -> Column:
    """White space collapsed; a text over `most` characters is cut at a word and ends with an ellipsis."""
    t = one_space(F.coalesce(text, F.lit("")))
    return F.when(F.length(t) > most, F.concat(F.regexp_replace(F.substring(t, 1, most - 1), r" [^ ]*$", ""), F.lit("…"))).otherwise(t)


def duration_text(seconds: Column) -> Column:
    t = seconds.cast("long")
    parts = [(F.floor(t / 3600), "h"), (F.floor(F.pmod(t, F.lit(3600)) / 60), "min"), (F.pmod(t, F.lit(60)), "s")]
    return F.when(t > 0, F.concat_ws(" ", *(F.when(n > 0, F.concat(n.cast("string"), F.lit(" " + u))) for n, u in parts))).otherwise("")


#: Rewrites of a word before its vowels go, in order.
SOUNDS = [("ph", "f"), ("gh", ""), ("ck", "k"), ("q", "k"), ("x", "ks"), ("z", "s"), ("c", "k"), ("wh", "w"), ("w", ""), ("y", ""), ("h", "")]


def phonetic_key(word: Column) -> Column:
    """A key under which words that sound alike agree."""
    w = reduce(lambda t, ab: F.replace(t, F.lit(ab[0]), F.lit(ab[1])), SOUNDS, F.regexp_replace(F.lower(word), "[^a-z]", ""))
    return F.regexp_replace(F.concat(F.substring(w, 1, 1), F.regexp_replace(F.substring(w, F.lit(2), F.length(w)), "[aeiou]", "")), r"(.)\1+", "$1")
