"""Refinement of extracted minutes against their source, lexicon correction, masking, validation and rendering."""

from __future__ import annotations

import difflib
import re
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxloom.functions import text as T
from voxloom.operators.strings import parse_action
from voxloom.plans import inputs
from voxloom.plans.registry import query


# ---- evidence


def ground_quotes(points, transcripts, least: int = 14):
    """points (meeting, pos, quote, ..) whose normalised quote has `least` characters and occurs in the meeting's transcript.

    The meeting is the join key, so a quote only meets its own transcript.
    """
    t = transcripts.select("meeting", T.norm_quote(F.col("text")).alias("hay"))
    n = T.norm_quote(F.col("quote"))
    return points.withColumn("nq", n).where(F.length("nq") >= least).join(t, "meeting").where(F.contains("hay", F.col("nq"))).drop("hay", "nq")


_NQ = lambda c: f"regexp_replace(regexp_replace(lower({c}), '\\b(?:{T.FILLERS})\\b', ' ', 'g'), '[^a-z0-9]+', '', 'g')"


def _quotes(spark, sf_dir):
    d = inputs.load(spark, sf_dir, "documents")
    shifted = d.select((F.col("doc_id") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)).alias("meeting"), F.substring("text", 5, 40).alias("quote"), F.col("doc_id").alias("pos"))
    return shifted, d.select(F.col("doc_id").alias("meeting"), "text")


@query("join_quote_ground", f"SELECT p.doc_id AS pos, t.doc_id AS meeting FROM documents p JOIN documents t ON t.doc_id = p.doc_id + CASE WHEN p.doc_id % 3 = 0 THEN 1 ELSE 0 END WHERE length({_NQ('substring(p.text, 5, 40)')}) >= 14 AND contains({_NQ('t.text')}, {_NQ('substring(p.text, 5, 40)')})")
def join_quote_ground(spark, sf_dir):
    return ground_quotes(*_quotes(spark, sf_dir)).select("pos", "meeting")


@query("join_decision_evidence", f"WITH e AS (SELECT p.doc_id AS pos, t.doc_id AS meeting, t.doc_id % 50 AS grp, length({_NQ('substring(p.text, 5, 40)')}) >= 14 AND contains({_NQ('t.text')}, {_NQ('substring(p.text, 5, 40)')}) AS ok FROM documents p JOIN documents t ON t.doc_id = p.doc_id + CASE WHEN p.doc_id % 3 = 0 THEN 1 ELSE 0 END) SELECT pos, meeting FROM e QUALIFY ok OR count(*) FILTER (ok) OVER (PARTITION BY grp) = 0")
def join_decision_evidence(spark, sf_dir):
    """Decisions with evidence; a group in which none has any keeps all."""
    p, t = _quotes(spark, sf_dir)
    nq, hay = T.norm_quote(F.col("quote")), T.norm_quote(F.col("text"))
    x = p.join(t, "meeting").select("pos", "meeting", (F.col("meeting") % 50).alias("grp"), ((F.length(nq) >= 14) & F.contains(hay, nq)).alias("ok"))
    return x.withColumn("any", F.max("ok").over(W.partitionBy("grp"))).where("ok OR NOT any").select("pos", "meeting")


@query("join_attendee_tags", "SELECT a.c_custkey, c.conv_id FROM customer a JOIN conversations c ON c.conv_id = a.c_custkey AND c.turn = 1 WHERE a.c_custkey % 2 = 0 AND contains(lower(c.text), 'the') OR a.c_custkey % 2 = 1 AND regexp_matches(lower(c.text), '\\b(?:and|of)\\b')")
def join_attendee_tags(spark, sf_dir):
    """Attendees whose tag occurs in their meeting, or one of whose words is spoken as a word."""
    a = inputs.load(spark, sf_dir, "customer").select("c_custkey")
    c = inputs.load(spark, sf_dir, "conversations").where("turn = 1").select("conv_id", F.lower("text").alias("low"))
    even = F.col("c_custkey") % 2 == 0
    return a.join(c, F.col("c_custkey") == F.col("conv_id")).where((even & F.contains("low", F.lit("the"))) | (~even & F.col("low").rlike(r"\b(?:and|of)\b"))).select("c_custkey", "conv_id")


@query("ground_roles", "SELECT p_partkey, coalesce(nullif(array_to_string(list_filter(string_split(p_type, ' '), lambda w: length(w) > 5 AND contains(lower(p_name), lower(left(w, 2)))), ', '), ''), 'Unknown') AS role FROM part")
def ground_roles(spark, sf_dir):
    """Parts of a role that the source supports, else Unknown."""
    kept = F.filter(F.split("p_type", " "), lambda w: (F.length(w) > 5) & F.contains(F.lower("p_name"), F.lower(F.substring(w, 1, 2))))
    return inputs.load(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.nullif(F.concat_ws(", ", kept), F.lit("")), F.lit("Unknown")).alias("role"))


#: Capitalised words that are no names.
_NOT_NAMES = "the a an and or but if then this that these those we you they i he she it our your their his her its is are was were be been being have has had do does did will would shall should may might must can could there here what when where who whom which why how all any both each few more most other some such no nor not only own same so than too very just now also".split()


def unsupported_names(text, low):
    """Capitalised words inside sentences that the lower-cased source does not hold."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![.!?] )(?<![.!?])(?<!^)\b([A-Z][A-Za-z'’-]{2,})"), F.lit(1))
    return F.filter(found, lambda w: ~F.lower(w).isin(_NOT_NAMES) & ~F.contains(low, F.lower(w)))


def _names(spark, sf_dir):
    l = inputs.lines(spark, sf_dir).withColumn("text", F.concat(F.lit("it was "), "line", F.when(F.col("pos") == 1, " said Sandra Zersky").otherwise("")))
    return l.select("doc_id", "pos", "text", unsupported_names(F.col("text"), F.lower("line")).alias("bad"))


@query("proper_nouns_unsupported")
def proper_nouns_unsupported(spark, sf_dir):
    return _names(spark, sf_dir).where(F.size("bad") > 0).select("doc_id", "pos", "bad")


@query("drop_unsupported_names", f"WITH {inputs.LINES} SELECT doc_id, pos, 'it was ' || line AS text FROM lines WHERE pos <> 1")
def drop_unsupported_names(spark, sf_dir):
    return _names(spark, sf_dir).where(F.size("bad") == 0).select("doc_id", "pos", "text")


@query("join_speaker_names", "WITH p AS (SELECT conv_id, turn, 'Speaker_' || (turn % 3) AS tag, CASE turn % 4 WHEN 0 THEN 'Ann Lee' WHEN 1 THEN 'Bo' WHEN 2 THEN 'Speaker 3' ELSE 'Ann Lee' END AS name FROM conversations WHERE turn < 3 OR conv_id % 2 = 0 AND turn = 3) SELECT conv_id, tag, name FROM p WHERE NOT regexp_matches(name, '(?i)^speaker') QUALIFY count(*) OVER (PARTITION BY conv_id, lower(name)) = 1")
def join_speaker_names(spark, sf_dir):
    """Proposed names that are names and that one proposal only claims."""
    t = F.col("turn")
    p = inputs.load(spark, sf_dir, "conversations").where("turn < 3 OR conv_id % 2 = 0 AND turn = 3")
    p = p.select("conv_id", F.concat(F.lit("Speaker_"), (t % 3).cast("string")).alias("tag"), F.when(t % 4 == 1, "Bo").when(t % 4 == 2, "Speaker 3").otherwise("Ann Lee").alias("name")).where(~F.col("name").rlike("(?i)^speaker"))
    return p.withColumn("n", F.count("*").over(W.partitionBy("conv_id", F.lower("name")))).where("n = 1").select("conv_id", "tag", "name")


@query("normalise_actions", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS assigned_to, CASE WHEN c_custkey % 35 = 0 THEN c_name WHEN c_custkey % 7 = 0 OR c_custkey % 5 = 0 THEN '' ELSE 'boss' END AS assigned_by FROM customer WHERE c_custkey % 11 <> 0")
def normalise_actions(spark, sf_dir):
    """Stand-ins become empty, nobody assigns to themselves, records of the past are no tasks."""
    k = F.col("c_custkey")
    a = inputs.load(spark, sf_dir, "customer").select("c_custkey", F.when(k % 11 == 0, "motion was passed").otherwise("do it").alias("task"), F.when(k % 5 == 0, " TBD.").otherwise(F.col("c_name")).alias("to"), F.when(k % 7 == 0, F.col("c_name")).when(k % 5 == 0, "nobody").otherwise("boss").alias("by"))
    a = a.where(~(F.col("task").rlike("(?i)" + T.PAST) & ~F.col("task").rlike("(?i)" + T.FUTURE)))
    to, by = T.clean_placeholder(F.col("to")), T.clean_placeholder(F.col("by"))
    return a.select("c_custkey", to.alias("assigned_to"), F.when(by == to, "").otherwise(by).alias("assigned_by"))


@query("merge_duplicates", "SELECT c_nationkey, c_mktsegment, arg_max(c_custkey, {'o': CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END, 'l': length(c_name), 'k': -c_custkey}) AS kept, count(*) AS n FROM customer GROUP BY ALL")
def merge_duplicates(spark, sf_dir):
    """Of each given group one item stays: with an owner before without, then the longest, then the first."""
    order = F.struct((F.col("c_acctbal") > 0).cast("int"), F.length("c_name"), -F.col("c_custkey"))
    return inputs.load(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.max_by("c_custkey", order).alias("kept"), F.count("*").alias("n"))


@query("split_owner_due", "SELECT c_custkey, 'Call ' || c_name AS task, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END AS assigned_to, CASE WHEN c_custkey % 2 = 0 THEN 'May ' || c_custkey ELSE '' END AS due FROM customer")
def split_owner_due(spark, sf_dir):
    k = F.col("c_custkey")
    x = F.concat(F.lit("Call "), "c_name", F.when(k % 2 == 0, F.concat(F.lit(" — Owner: "), "c_mktsegment", F.lit(" — Due: May "), k.cast("string"))).otherwise(" — Owner: none — Due: TBD"))
    task, to, due = parse_action(F.col("x"))
    return inputs.load(spark, sf_dir, "customer").select("c_custkey", x.alias("x")).select("c_custkey", task.alias("task"), to.alias("assigned_to"), due.alias("due"))


# ---- lexicon


def alike(a: str, b: str, key_a: str, key_b: str) -> float:
    """Likeness of two words by their phonetic keys or their letters, whichever is more."""
    ratio = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()
    return max(ratio(key_a, key_b), ratio(a.lower(), b.lower()))


class Likeness:
    """The first of the terms (term: key) that a word is most alike, and how much, where that is `least` or more; else two Nones.

    A term is compared only where the letters that word and term share could reach `least` and beat the terms before it.
    """

    def __init__(self, keys: dict[str, str], least: float):
        self.least, self.terms = least, [(t, [self._side(x) for x in (keys[t], t.lower())]) for t in keys]

    @staticmethod
    def _side(x: str):
        return x, len(x), Counter(x), difflib.SequenceMatcher(None, "", x)

    def __call__(self, word: str, key: str):
        best, found = 0.0, None
        own = [(x, len(x), Counter(x)) for x in (key, word.lower())]
        for term, sides in self.terms:
            for (x, n, count), (y, m, there, matcher) in zip(own, sides):
                if n + m:  # the same quotient as the ratio's, with at least its matches
                    if 2.0 * min(n, m) / (n + m) < self.least or 2.0 * sum(min(c, there[k]) for k, c in count.items() if k in there) / (n + m) < self.least:
                        continue
                matcher.set_seq1(x)
                score = matcher.ratio()
                if score >= self.least and (found is None or score > best):
                    best, found = score, term
        return (found, best) if found is not None else (None, None)


def term_keys(spark, terms: list[str]) -> dict[str, str]:
    """Phonetic keys of a lexicon's terms."""
    return {r.t: r.k for r in spark.createDataFrame([(t,) for t in terms], "t string").select("t", T.phonetic_key(F.col("t")).alias("k")).collect()}


def word_keys(text, pattern: str):
    """Phonetic keys of the words of a text, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), T.phonetic_key)


def _tokens(spark, sf_dir, pattern: str):
    """(token): distinct matches of a pattern in the lines of documents."""
    return inputs.lines(spark, sf_dir).select(F.explode(F.regexp_extract_all("line", F.lit(pattern), F.lit(0))).alias("token")).distinct()


@query("join_alias_lookup", f"WITH {inputs.LINES} SELECT DISTINCT t AS token, CASE lower(t) WHEN 'with' THEN 'WITH' WHEN 'that' THEN 'That' ELSE 'The-Re' END AS canonical FROM (SELECT unnest(regexp_extract_all(line, '[A-Za-z]{{4,12}}')) AS t FROM lines) WHERE lower(t) IN ('with', 'that', 'there')")
def join_alias_lookup(spark, sf_dir):
    """Tokens that are an alias of a term; as in its SQL, a longer word counts as pieces of twelve letters."""
    lexicon = spark.createDataFrame([("with", "WITH"), ("that", "That"), ("there", "The-Re")], "alias string, canonical string")  # three rows
    return _tokens(spark, sf_dir, "[A-Za-z]{4,12}").join(F.broadcast(lexicon), F.lower("token") == F.col("alias")).select("token", "canonical")


_TERMS = ["Thionation", "Erentha", "Kafka", "Oneration"]


@query("join_phonetic")
def join_phonetic(spark, sf_dir):
    """Tokens that sound like a term: every token sees the lexicon of a few terms inside the function, so no pairs are made.

    Tokens are whole words, however long; words under four letters are too short for the rule. Each distinct token is matched
    once: a filter on a column function would be moved below the distinct, to every place of a token.
    """

    keys = term_keys(spark, _TERMS)

    def best(parts):
        finder = Likeness(keys, 0.7)
        for pdf in parts:
            found = [(w, *finder(w, k)) for w, k in zip(pdf["token"], pdf["key"])]
            yield pd.DataFrame([x for x in found if x[1] is not None], columns=["token", "term", "score"])

    x = _tokens(spark, sf_dir, "[A-Za-z]{4,}").select("token", T.phonetic_key(F.col("token")).alias("key"))
    return x.mapInPandas(best, "token string, term string, score double").select("token", "term", F.round("score", 6).alias("score"))


@query("correct_terms")
def correct_terms(spark, sf_dir):
    """Lines with aliases, casing and sound-alikes put right."""
    aliases, canon, keys = {"erwh": "Kafka"}, {t.lower(): t for t in _TERMS}, term_keys(spark, _TERMS)

    def fix(line: str, own) -> str:
        own = iter(own)

        def one(m):
            w, k = m[0].lower(), next(own)
            if w in aliases or w in canon:
                return aliases.get(w) or canon[w]
            score, term = max((alike(w, t, k, keys[t]), t) for t in _TERMS) if len(w) >= 8 else (0, "")
            return term if score >= 0.86 else m[0]

        return re.sub("[A-Za-z]+", one, line)

    @F.pandas_udf("string")
    def run(s: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series([fix(x, k) for x, k in zip(s, own)])

    return inputs.lines(spark, sf_dir).select("doc_id", "pos", run("line", word_keys("line", "[A-Za-z]+")).alias("y"))


@query("learn_aliases")
def learn_aliases(spark, sf_dir):
    """Words that a correction replaced, one for one, by a term that sounds alike."""
    word, keys = "[A-Za-z][A-Za-z']*", term_keys(spark, _TERMS)

    @F.pandas_udf("array<struct<alias:string,term:string>>")
    def run(before: pd.Series, after: pd.Series, own: pd.Series) -> pd.Series:
        out = []
        for x, y, k in zip(before, after, own):
            a, b = re.findall(word, x), re.findall(word, y)
            codes = difflib.SequenceMatcher(None, [w.lower() for w in a], [w.lower() for w in b]).get_opcodes()
            pairs = [(a[i].lower(), b[j], k[i]) for tag, i, i2, j, j2 in codes if tag == "replace" and i2 - i == j2 - j == 1]
            out.append([{"alias": u, "term": v} for u, v, sound in pairs if v in keys and len(u) >= 3 and alike(u, v, sound, keys[v]) >= 0.58])
        return pd.Series(out)

    x, y = F.concat("line", F.lit(" kafga ok")), F.concat("line", F.lit(" Kafka ok"))
    return inputs.lines(spark, sf_dir).select("doc_id", "pos", F.explode(run(x, y, word_keys(x, word))).alias("p")).select("doc_id", "pos", "p.alias", "p.term")


@query("similarity")
def similarity(spark, sf_dir):
    """Ratcliff-Obershelp similarity of neighbouring lines, with the library's junk rule as it is."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        norm = lambda s: re.sub(r"\s+", " ", re.sub(r"[^\w]", " ", s.lower())).strip()
        return pd.Series([difflib.SequenceMatcher(None, norm(x), norm(y)).ratio() for x, y in zip(a, b)])

    l = inputs.lines(spark, sf_dir).withColumn("next", F.lead("line").over(W.partitionBy("doc_id").orderBy("pos"))).where("next IS NOT NULL")
    return l.select("doc_id", "pos", F.round(run("line", "next"), 6).alias("ratio"))


@query("name_fuzzy_merge")
def name_fuzzy_merge(spark, sf_dir):
    """Names of a nation's customers that resemble a first one become its longest form."""

    def like(a: str, b: str) -> bool:
        m = difflib.SequenceMatcher(None, a, b)
        return m.real_quick_ratio() >= 0.75 and m.quick_ratio() >= 0.75 and m.ratio() >= 0.75  # the first two are upper bounds

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, done, out = sorted(pdf["c_name"].unique()), set(), []
        for n in names:
            if n not in done:
                own = [m for m in names if m not in done and (m == n or like(n.lower(), m.lower()))]
                done.update(own)
                out += [(int(pdf["c_nationkey"].iloc[0]), m, max(own, key=len)) for m in own]
        return pd.DataFrame(out, columns=["c_nationkey", "name", "canonical"])

    return inputs.load(spark, sf_dir, "customer").select("c_nationkey", "c_name").groupBy("c_nationkey").applyInPandas(run, "c_nationkey int, name string, canonical string")


# ---- masking

#: Commands that begin a line of shell.
COMMANDS = (
    "curl|wget|docker|docker-compose|kubectl|python3?|pip3?|git|npm|npx|yarn|make|bash|sh|zsh|cd|ls|cat|grep|egrep|awk|sed|jq|tail|head|sort|uniq|wc|find|chmod|"
    "sudo|apt|apt-get|systemctl|uvicorn|pytest|export|source|echo|mkdir|rm|cp|mv|diff|ssh|scp"
)
#: Spans of a technical text that are not translated, in the order they are taken.
SPANS = [
    r"`{1,3}[^`\n]+`{1,3}",
    rf"(?m)^[ \t]*(?:{COMMANDS})\b[^\n#]*[^\s#]",
    r"https?://\S+",
    r"\b[\w.-]+:\d{2,5}(?:/[^\s,;)]*)?",
    r"\b[\w.-]+(?:/[\w.-]+)*\.(?:py|js|ts|tsx|jsx|json|ya?ml|toml|ini|cfg|conf|txt|md|sh|sql|html?|css|go|rs|java|cpp?|hpp?|rb|php|env|lock|log)\b",
    r"(?:\.{1,2}/|(?<![\w])/)[\w.-]+(?:/[\w.-]+)*",
    r"\B--[\w-]+(?:=[^\s,;)]+)?",
    r"\b[A-Za-z_]\w*=[^\s,;)]+",
    r"\b\w+(?:\.\w+)+\(\s*\)",
    r"\b\w+\(\s*\)",
    r"\b[A-Za-z_]\w*(?:\.[A-Za-z_]\w*){1,}\b",
    r"\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\b",
    r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b",
    r"\b(?![A-Z0-9]{5,}\b)[A-Za-z][a-z0-9]*[A-Z][A-Za-z0-9]*\b",
    r"[\"“]([A-Za-z][\w.-]*)[\"”]",
    r"[\U0001F000-\U0001FAFF☀-➿️←-⇿⬀-⯿]",
]
_SLOT = re.compile(r"[⟦〖]\s*([0-9०-९]+)\s*[⟧〗]")
_DIGITS = str.maketrans("०१२३४५६७८९", "0123456789")


def mask(text: str) -> tuple[str, list[str]]:
    """text with its spans replaced by ⟦n⟧, numbered pattern by pattern, and the spans."""
    spans: list[str] = []
    for p in SPANS:
        text = re.sub(p, lambda m: spans.append(m[0]) or f"⟦{len(spans) - 1}⟧" if m[0].strip() else m[0], text)
    return text, spans


def unmask(text: str, spans: list[str]) -> tuple[str, int]:
    """text with its spans back, and how many are missing."""
    used = {int(n.translate(_DIGITS)) for n in _SLOT.findall(text)} & set(range(len(spans)))
    return _SLOT.sub(lambda m: spans[n] if (n := int(m[1].translate(_DIGITS))) in used else m[0], text), len(spans) - len(used)


def mask_column(text):
    @F.pandas_udf("struct<masked:string,spans:array<string>>")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(s.map(mask).tolist(), columns=["masked", "spans"], index=s.index)

    return run(text)


def unmask_column(text, spans):
    @F.pandas_udf("struct<text:string,missing:int>")
    def run(s: pd.Series, own: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([unmask(t, list(x)) for t, x in zip(s, own)], columns=["text", "missing"], index=s.index)

    return run(text, spans)


def _coded(spark, sf_dir):
    return inputs.lines(spark, sf_dir).select("doc_id", "pos", F.concat(F.lit("run `ls -l` see https://a.b/c and my_file.py then "), "line").alias("x"))


@query("mask_code")
def mask_code(spark, sf_dir):
    return _coded(spark, sf_dir).select("doc_id", "pos", mask_column("x").alias("m")).select("doc_id", "pos", "m.masked", "m.spans")


@query("unmask_code", f"WITH {inputs.LINES} SELECT doc_id, pos, 'run `ls -l` see https://a.b/c and my_file.py then ' || line AS text, 0 AS missing FROM lines")
def unmask_code(spark, sf_dir):
    m = _coded(spark, sf_dir).select("doc_id", "pos", mask_column("x").alias("m"))
    return m.select("doc_id", "pos", unmask_column("m.masked", "m.spans").alias("u")).select("doc_id", "pos", "u.text", "u.missing")


@query("mask_terms")
def mask_terms(spark, sf_dir):
    """Glossary terms, in any case, as slots shared by value."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        slots: dict[str, str] = {}
        one = lambda m: slots.setdefault(m[0].lower(), f"⟦{len(slots)}⟧")

        def line(x):
            slots.clear()
            return re.sub(r"(?i)\b(?:the|of)\b", one, x)

        return s.map(line)

    return inputs.lines(spark, sf_dir).select("doc_id", "pos", run("line").alias("masked"))


@query("unmask_terms", f"WITH {inputs.LINES} SELECT doc_id, pos, 'term ' || line || '  end' AS y FROM lines")
def unmask_terms(spark, sf_dir):
    """Known slots come back, unknown ones go."""
    x = F.concat(F.lit("⟦ 0 ⟧ "), "line", F.lit(" ⟦9⟧ end"))
    known = F.regexp_replace(x, r"⟦\s*0\s*⟧", "term")
    return inputs.lines(spark, sf_dir).select("doc_id", "pos", F.regexp_replace(known, r"⟦\s*[0-9]+\s*⟧", "").alias("y"))


@query("term_restore_map", "SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'T-' || n_name ELSE n_name END AS restored FROM nation")
def term_restore_map(spark, sf_dir):
    """A term's approved translation if there is one, else the term itself."""
    n = inputs.load(spark, sf_dir, "nation")
    approved = n.where("n_nationkey % 4 = 0").select(F.col("n_name").alias("term"), F.concat(F.lit("T-"), "n_name").alias("t"))
    return n.join(F.broadcast(approved), F.col("n_name") == F.col("term"), "left").select("n_nationkey", F.coalesce("t", "n_name").alias("restored"))


@query("join_glossary", "SELECT c_custkey, coalesce(CASE WHEN c_mktsegment = 'BUILDING' THEN 'Bau' END, c_mktsegment) AS y FROM customer")
def join_glossary(spark, sf_dir):
    g = spark.createDataFrame([("BUILDING", "Bau")], "term string, t string")
    return inputs.load(spark, sf_dir, "customer").join(F.broadcast(g), F.col("c_mktsegment") == F.col("term"), "left").select("c_custkey", F.coalesce("t", "c_mktsegment").alias("y"))


# ---- validation

#: Scripts of target languages; least share of the target's letters, of foreign ones, and of likeness for an echo.
_LIMITS = {"conform": 0.60, "contaminated": 0.20, "echo": 0.90}


def _share(content, script: str):
    return F.length(F.regexp_replace(content, rf"[^\p{{Is{script}}}]", "")) / F.length(content)


@query("validate_translation")
def validate_translation(spark, sf_dir):
    """Why an English output is rejected, or null: empty, echo of a foreign source, wrong or mixed script. The costly
    similarity only sees rows that the cheap tests leave open."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        norm = lambda s: re.sub(r"\s+", " ", re.sub(r"[^\w]", " ", s.lower())).strip()
        return pd.Series([difflib.SequenceMatcher(None, norm(x), norm(y)).ratio() for x, y in zip(a, b)])

    k = F.col("doc_id") % 5
    hindi = F.lit("यह एक हिंदी वाक्य है")
    l = inputs.lines(spark, sf_dir).select("doc_id", "pos", F.when(k == 0, hindi).otherwise(F.col("line")).alias("source"), F.when(k == 1, "").when(k <= 2, hindi).when(k == 3, F.concat(F.substring("line", 1, 40), F.lit(" "), hindi)).otherwise(F.col("line")).alias("output"))
    x = l.withColumn("content", T.content_chars(F.col("output")))
    done = (F.trim("output") == "") | (F.length("content") == 0)
    quick = x.where(done).select("doc_id", "pos", F.when(F.trim("output") == "", "empty").alias("reason"))
    slow = x.where(~done).withColumns({"sim": ratio("output", "source"), "own": _share(F.col("content"), "Latin"), "foreign": _share(F.col("content"), "Devanagari"), "source_own": _share(F.concat(T.content_chars(F.col("source")), F.lit("")), "Latin")})
    echo = F.col("sim") >= _LIMITS["echo"]
    reason = F.when(echo & (F.col("source_own") < _LIMITS["conform"]), "echo").when(echo, None).when(F.col("own") < _LIMITS["conform"], "wrong_script").when(F.col("foreign") >= _LIMITS["contaminated"], "mixed_script")
    return quick.unionByName(slow.select("doc_id", "pos", reason.alias("reason")))


@query("conforms")
def conforms(spark, sf_dir):
    l = inputs.lines(spark, sf_dir).select("doc_id", "pos", T.content_chars(F.col("line")).alias("c"))
    return l.select("doc_id", "pos", F.when(F.length("c") == 0, True).otherwise((_share(F.col("c"), "Latin") >= _LIMITS["conform"]) & (_share(F.col("c"), "Devanagari") < _LIMITS["contaminated"])).alias("ok"))


# ---- JSON replies of a model


def json_body(raw):
    """The object in a reply with fences or prose around it."""
    return F.regexp_extract(raw, r"(?s)(\{.*\})", 1)


_REPLY = "'Here you are: ```json {\"summary\": \"' || turn || '\", \"key_points\": [\"a\", \"b' || conv_id || '\"]} ``` done'"


@query("json_extract", "SELECT conv_id, turn, CAST(turn AS VARCHAR) AS summary, 'b' || conv_id AS point FROM conversations")
def json_extract(spark, sf_dir):
    inputs.views(spark, sf_dir, "conversations")
    x = spark.sql(f"SELECT conv_id, turn, {_REPLY} AS raw FROM conversations")
    got = F.from_json(json_body(F.col("raw")), "summary string, key_points array<string>")
    return x.select("conv_id", "turn", got.alias("g")).select("conv_id", "turn", "g.summary", F.get("g.key_points", F.lit(1)).alias("point"))


@query("json_repair", "SELECT conv_id, turn, CAST(turn AS VARCHAR) AS summary, 2 AS n FROM conversations")
def json_repair(spark, sf_dir):
    """Trailing commas go, open arrays and objects are closed, arrays first."""
    raw = F.concat(F.lit('{"summary": "'), F.col("turn").cast("string"), F.lit('", "key_points": ["a", "b",'))
    count = lambda s, c: F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))
    c = inputs.load(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace(raw, r",\s*$", "").alias("s"))
    closed = F.concat("s", F.repeat(F.lit("]"), count(F.col("s"), "[") - count(F.col("s"), "]")), F.repeat(F.lit("}"), count(F.col("s"), "{") - count(F.col("s"), "}")))
    return c.select("conv_id", "turn", F.from_json(closed, "summary string, key_points array<string>").alias("g")).select("conv_id", "turn", "g.summary", F.size("g.key_points").alias("n"))


@query("json_array", "SELECT conv_id, turn, turn + 1 AS n FROM conversations")
def json_array(spark, sf_dir):
    raw = F.concat(F.lit("```json ["), F.array_join(F.transform(F.sequence(F.lit(0), F.col("turn").cast("int")), lambda i: F.concat(F.lit('"x'), i.cast("string"), F.lit('"'))), ","), F.lit("] ```"))
    return inputs.load(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(F.from_json(F.regexp_extract(raw, r"(?s)(\[.*\])", 1), "array<string>")).cast("long").alias("n"))


@query("json_valid", "SELECT event_id, event_id % 3 = 0 AS ok FROM events")
def json_valid(spark, sf_dir):
    raw = F.when(F.col("event_id") % 3 == 0, '{"summary": 1, "x": 2}').when(F.col("event_id") % 3 == 1, F.col("props")).otherwise("no json")
    keys = F.json_object_keys(raw)
    return inputs.load(spark, sf_dir, "events").select("event_id", F.coalesce(F.arrays_overlap(keys, F.array(F.lit("summary"), F.lit("key_points"), F.lit("decisions"))), F.lit(False)).alias("ok"))


@query("json_parse_content", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN ['p', 'q' || event_id] ELSE ['r'] END AS key_points FROM events")
def json_parse_content(spark, sf_dir):
    """Bullets that are strings or objects with text, point or item."""
    k = F.col("event_id")
    raw = F.when(k % 2 == 0, F.concat(F.lit('{"key_points": ["p", {"point": "q'), k.cast("string"), F.lit('"}, " "]}'))).otherwise('{"key_points": [{"text": " r "}]}')
    items = F.from_json(F.get_json_object(raw, "$.key_points"), "array<string>")
    one = lambda s: F.trim(F.when(s.startswith("{"), F.coalesce(F.get_json_object(s, "$.text"), F.get_json_object(s, "$.point"), F.get_json_object(s, "$.item"), F.lit(""))).otherwise(s))
    return inputs.load(spark, sf_dir, "events").select("event_id", F.filter(F.transform(items, one), lambda s: s != "").alias("key_points"))


@query("json_points", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_points(spark, sf_dir):
    """A reply parsed as it is, else its body."""
    raw = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat(F.lit("Points: "), "props", F.lit(" .")))
    k = lambda s: F.get_json_object(s, "$.k")
    return inputs.load(spark, sf_dir, "events").select("event_id", F.coalesce(k(raw), k(json_body(raw))).cast("long").alias("k"))


@query("mom_response", "SELECT conv_id, coalesce(max(text) FILTER (role = 'system'), 'Meeting') AS title, count(*) FILTER (role = 'user') AS key_points, count(*) FILTER (role = 'user') = 0 AS degraded FROM conversations GROUP BY conv_id")
def mom_response(spark, sf_dir):
    c = inputs.load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max(F.when(F.col("role") == "system", F.col("text"))).alias("t"), F.count_if(F.col("role") == "user").alias("key_points"))
    return c.select("conv_id", F.coalesce("t", F.lit("Meeting")).alias("title"), "key_points", (F.col("key_points") == 0).alias("degraded"))


@query("render_mom", "SELECT conv_id, concat_ws(chr(10), 'MINUTES', nullif('Topic: ' || coalesce(max(text) FILTER (role = 'system'), ''), 'Topic: '), string_agg('- ' || left(text, 30), chr(10) ORDER BY turn) FILTER (role = 'user')) AS document FROM conversations GROUP BY conv_id")
def render_mom(spark, sf_dir):
    """A text document; sections without content are left out."""
    c = inputs.load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max(F.when(F.col("role") == "system", F.col("text"))).alias("t"), F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", F.substring("text", 1, 30).alias("s"))))).alias("p"))
    points = F.when(F.size("p") > 0, F.concat_ws("\n", F.transform("p", lambda x: F.concat(F.lit("- "), x.s))))
    return c.select("conv_id", F.concat_ws("\n", F.lit("MINUTES"), F.when(F.col("t") != "", F.concat(F.lit("Topic: "), "t")), points).alias("document"))


@query("mom_items", "SELECT conv_id, list(CASE role WHEN 'assistant' THEN left(text, 20) || ' (due ' || turn || ')' ELSE left(text, 20) END ORDER BY CASE role WHEN 'assistant' THEN 1 ELSE 0 END, turn) AS items FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def mom_items(spark, sf_dir):
    task = F.col("role") == "assistant"
    item = F.when(task, F.concat(F.substring("text", 1, 20), F.lit(" (due "), F.col("turn").cast("string"), F.lit(")"))).otherwise(F.substring("text", 1, 20))
    return inputs.load(spark, sf_dir, "conversations").where("role <> 'system'").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(task.cast("int").alias("k"), "turn", item.alias("i")))), lambda s: s.i).alias("items"))


@query("translatable_slots", "SELECT conv_id, turn, 'text' AS slot, text AS value FROM conversations WHERE trim(text) <> '' AND role <> 'system' UNION ALL SELECT conv_id, turn, 'topic', text FROM conversations WHERE trim(text) <> '' AND role = 'system'")
def translatable_slots(spark, sf_dir):
    slots = F.array(F.struct(F.lit("text").alias("slot"), F.when(F.col("role") != "system", F.col("text")).alias("value")), F.struct(F.lit("topic").alias("slot"), F.when(F.col("role") == "system", F.col("text")).alias("value")))
    return inputs.load(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(slots).alias("s")).select("conv_id", "turn", "s.*").where("trim(value) <> ''")


@query("labels_for", f"SELECT doc_id, CASE lang WHEN 'de' THEN 'Teilnehmer' WHEN 'fr' THEN 'Participant' ELSE 'Speaker' END AS label FROM documents")
def labels_for(spark, sf_dir):
    labels = F.create_map(*(F.lit(x) for kv in {"de": "Teilnehmer", "german": "Teilnehmer", "fr": "Participant", "french": "Participant"}.items() for x in kv))
    return inputs.load(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.try_element_at(labels, F.lower("lang")), F.lit("Speaker")).alias("label"))


@query("pipe_docx_text", "SELECT r_regionkey, CASE r_regionkey WHEN 0 THEN '' WHEN 1 THEN 'I' WHEN 2 THEN 'II' WHEN 3 THEN 'III' ELSE 'IV' END AS roman, CASE WHEN suffix(r_name, '.') THEN r_name ELSE r_name || '.' END AS sentence FROM region")
def pipe_docx_text(spark, sf_dir):
    n, roman = F.col("r_regionkey"), F.lit("")
    rest = n
    for v, s in [(10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]:
        times = F.floor(rest / v).cast("int")
        roman, rest = F.concat(roman, F.repeat(F.lit(s), times)), rest - times * v
    return inputs.load(spark, sf_dir, "region").select("r_regionkey", roman.alias("roman"), F.when(F.col("r_name").endswith("."), F.col("r_name")).otherwise(F.concat("r_name", F.lit("."))).alias("sentence"))


@query("preprocess")
def preprocess(spark, sf_dir):
    """The string steps of a transcript before extraction, in order."""
    x = T.collapse_blank_lines(T.remove_fillers(T.strip_timestamps(F.concat(F.lit("0:077 seconds uh "), "text"))))
    return inputs.load(spark, sf_dir, "conversations").select("conv_id", "turn", F.trim(x).alias("y"))


@query("full_pipeline")
def full_pipeline(spark, sf_dir):
    """From a conversation to its items: cleaned turns, points that are no near duplicates, tasks without records of the past."""
    from voxloom.operators.sequences import keep_unlike_any, near

    c = inputs.load(spark, sf_dir, "conversations").select("conv_id", "turn", F.trim(T.remove_fillers(T.strip_timestamps(F.col("text")))).alias("text"))
    c = c.where((F.col("text") != "") & ~(F.col("text").rlike("(?i)" + T.PAST) & ~F.col("text").rlike("(?i)" + T.FUTURE)))
    items = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", T.task_terms(F.col("text")).alias("terms")))).alias("items"))
    return items.select("conv_id", F.explode(keep_unlike_any(F.col("items"), lambda k, x: near(k.terms, x.terms))).alias("x")).select("conv_id", "x.turn", "x.text")


