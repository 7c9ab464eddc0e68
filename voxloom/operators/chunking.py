"""Operators that turn one text into many: sentences, paragraphs, chunks, batches and windows.

Greedy packing depends on what was packed before, so it is plain Python in Arrow batches (`explode_text`); what has a closed
form is a column expression.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxloom.plans import inputs
from voxloom.plans.registry import query

CHUNK, BATCH_ITEMS, BATCH_CHARS, BLOCK, TRANSCRIPT, CORRECTION, SYNTHESIS = 1200, 10, 2500, 600, 20_000, 4_000, 16_000
WINDOW, OVERLAP = 1800, 350
WORDS, WORD_OVERLAP, LONGEST, SHORTEST = 120, 30, 1200, 15

_SENTENCE = re.compile(r"(?<=[.!?।॥])[\"'”’)\]]*\s+")
#: Fixed value: how a list item or heading begins.
_ITEM = re.compile(r"(?:[-•·◦▪*]|\(?\d{1,3}[.)]|[a-zA-Z][.)]|[०-९]{1,3}[.)])\s+")
_END, _HYPHEN = re.compile(r"[.!?।॥:][\"'”’)\]]*$"), re.compile(r"(\w)-$")


def sentences(text: str) -> list[str]:
    return [p for p in (x.strip() for x in _SENTENCE.split(text)) if p]


def pack(parts, limit: int, glue: str = " ") -> list[str]:
    """Parts joined greedily to at most `limit` characters; a part that is longer stands alone."""
    out, now = [], None
    for p in parts:
        if now is not None and len(now) + len(glue) + len(p) > limit:
            out.append(now)
            now = None
        now = p if now is None else now + glue + p
    return [*out, now] if now is not None else out


def hard_split(text: str, limit: int) -> list[str]:
    """Words packed to `limit`; a longer word is cut into slices, the last of which goes on with the next word."""
    out, now = [], ""
    for word in text.split(" "):
        if len(word) > limit:
            out += [now] * bool(now) + [word[i : i + limit] for i in range(0, len(word) - (len(word) % limit or limit), limit)]
            now, word = "", word[len(word) - (len(word) % limit or limit) :]
        joined = f"{now} {word}".strip()
        if now and len(joined) > limit:
            out.append(now)
            joined = word
        now = joined
    return out + [now] * bool(now)


def chunk(block: str, limit: int = CHUNK) -> list[str]:
    if len(block) <= limit:
        return [block]
    return pack((p for s in sentences(block) for p in ([s] if len(s) <= limit else hard_split(s, limit))), limit)


def reflow(text: str) -> list[str]:
    """Visual lines to paragraphs: blank lines end one, list items begin one, closed sentences end one, hyphens join words."""
    out: list[str] = []
    open_ = False
    for line in map(str.strip, text.split("\n")):
        if not line:
            open_ = False
            continue
        if not open_ or _ITEM.match(line):
            out.append(line)
        elif _HYPHEN.search(out[-1]):
            out[-1] = out[-1][:-1] + line
        else:
            out[-1] += " " + line
        open_ = not _END.search(out[-1])
    return out


def char_windows(text: str, size: int = WINDOW, overlap: int = OVERLAP) -> list[str]:
    """Overlapping windows, cut at the last newline, else the last sentence end, of their second half."""
    out, a = [], 0
    while a < len(text):
        b = min(a + size, len(text))
        if b < len(text):
            at = next((x for x in (text.rfind(c, a + size // 2, b) for c in ("\n", ". ")) if x != -1), b - 1)
            b = at + 1
        out.append(text[a:b])
        if b == len(text):
            break
        a = max(a + 1, b - overlap)
    return out


def word_windows(text: str, size: int = WORDS, overlap: int = WORD_OVERLAP, longest: int = LONGEST, shortest: int = SHORTEST) -> list[str]:
    """Overlapping windows of words, of at most `longest` characters; a short last one only if it is the only one."""
    words, out, a = text.split(), [], 0
    while a < len(words):
        b, n = a + 1, len(words[a])
        while b < len(words) and b - a < size and n + 1 + len(words[b]) <= longest:
            n, b = n + 1 + len(words[b]), b + 1
        if out and b - a < shortest:
            break
        out.append(" ".join(words[a:b]))
        if b == len(words):
            break
        a += max(b - a - overlap, 1)
    return out


def _counted(parts: list[str], limit: int, glue: str, first: int) -> list[str]:
    """Packing that counts one more for each part added (and for the first of a chunk only if `first`)."""
    out, now, n = [], [], 0
    for p in parts:
        if now and n + len(p) + first > limit:
            out.append(glue.join(now))
            now, n = [p], len(p) + first
        else:
            now.append(p)
            n += len(p) + 1
    return out + [glue.join(now)] * bool(now)


def transcript_chunks(text: str, limit: int = TRANSCRIPT) -> list[str]:
    if text and text.count("\n") < len(text) / 1000:
        return _counted(re.split(r"(?<=[.!?])\s+", text), limit, " ", 0)
    return _counted(text.split("\n"), limit, "\n", 0)


def correction_chunks(text: str, limit: int = CORRECTION) -> list[str]:
    return _counted(text.split("\n"), limit, "\n", 1)


def explode_text(rows: DataFrame, key: str, text: str, split, name: str = "chunk") -> DataFrame:
    """(key, no, name): the parts that split(text) gives for each row, numbered from 0; null text gives none."""

    def run(parts):
        for part in parts:
            ids, no, out = [], [], []
            for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                found = split(t) if t is not None else []
                ids += [i] * len(found)
                no += range(len(found))
                out += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(no, pa.int32()), pa.array(out, pa.string())], names=[key, "no", name])

    return rows.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, f"{key} long, no int, {name} string")


def _docs(split, name="chunk"):
    return lambda spark, sf_dir: explode_text(inputs.load(spark, sf_dir, "documents"), "doc_id", "text", split, name)


for _key, _split in {
    "tvf_chunk_blocks": lambda t: [c for b in reflow(t) for c in chunk(b)], "tvf_reflow": reflow, "tvf_hard_split": lambda t: hard_split(t, 80), "tvf_windows": char_windows,
    "tvf_word_windows": word_windows, "tvf_chunk_transcript": transcript_chunks, "tvf_correction_chunks": correction_chunks,
}.items():
    query(_key)(_docs(_split))


@query("tvf_sentences", "SELECT doc_id, unnest(range(0, len(l))) AS no, unnest(l) AS sentence FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?।॥])[\"''”’)\\]]*\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents)")
def tvf_sentences(spark, sf_dir):
    trim = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    parts = F.split("text", r"(?<=[.!?।॥])[\"'”’)\]]*\s+")
    return inputs.load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.filter(F.transform(parts, trim), lambda x: x != "")).alias("no", "sentence"))


def batch_numbers(sizes: list[int], items: int = BATCH_ITEMS, chars: int = BATCH_CHARS) -> list[int]:
    """The batch of each chunk: batches close before an item or character limit would be passed."""
    out, now, n, held = [], 0, 0, 0
    for s in sizes:
        if n and (n >= items or held + s > chars):
            now, n, held = now + 1, 0, 0
        out.append(now)
        n, held = n + 1, held + s
    return out


@query("tvf_batch_chunks")
def tvf_batch_chunks(spark, sf_dir):
    """Chunks of each document in batches for a model: the fold runs in the document's row, so nothing is collected."""

    def split(t: str) -> list[str]:
        chunks = [c for b in reflow(t) for c in chunk(b)]
        out: dict[int, list[int]] = {}
        for i, b in enumerate(batch_numbers([len(c) for c in chunks])):
            out.setdefault(b, []).append(i)
        return [" ".join(map(str, x)) for x in out.values()]

    return explode_text(inputs.load(spark, sf_dir, "documents"), "doc_id", "text", split, "chunks")


@query("tvf_transcript_blocks")
def tvf_transcript_blocks(spark, sf_dir):
    """Turns of a conversation packed to blocks of 600 characters."""
    c = inputs.load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    joined = c.select("conv_id", F.concat_ws("\u0001", F.transform("x", lambda s: s.text)).alias("t"))
    return explode_text(joined, "conv_id", "t", lambda t: pack(t.split("\u0001"), BLOCK), "block")


@query("tvf_sections", "SELECT conv_id, s.no AS no, s.name AS section, s.text AS text FROM (SELECT conv_id, unnest([{'no': 0, 'name': 'Title', 'text': coalesce(max(text) FILTER (role = 'system'), '')}, {'no': 1, 'name': 'Summary', 'text': coalesce(min(text) FILTER (role = 'user'), '')}, {'no': 2, 'name': 'Decisions', 'text': coalesce(max(text) FILTER (role = 'assistant'), '')}]) AS s FROM conversations GROUP BY conv_id) WHERE trim(s.text) <> ''")
def tvf_sections(spark, sf_dir):
    of = lambda f, r: F.coalesce(f(F.when(F.col("role") == r, F.col("text"))), F.lit(""))
    c = inputs.load(spark, sf_dir, "conversations").groupBy("conv_id").agg(of(F.max, "system").alias("a"), of(F.min, "user").alias("b"), of(F.max, "assistant").alias("c"))
    parts = F.array(*(F.struct(F.lit(n).alias("section"), F.col(x).alias("text")) for n, x in (("Title", "a"), ("Summary", "b"), ("Decisions", "c"))))
    return c.select("conv_id", F.posexplode(parts).alias("no", "s")).select("conv_id", "no", "s.section", "s.text").where("trim(text) <> ''")


@query("tvf_join_partials", "WITH p AS (SELECT user_id, count(*) AS n, sum(k) + 2 * (count(*) - 1) AS total, list(k) AS ks FROM (SELECT conv_id % 20 AS user_id, length(text) * 12 AS k FROM conversations) GROUP BY user_id) SELECT user_id, CASE WHEN total <= 16000 THEN total ELSE CAST(list_sum(list_transform(ks, lambda k: least(k, greatest(500, (16000 - 2 * (n - 1)) // n)))) AS BIGINT) + 2 * (n - 1) END AS joined FROM p")
def tvf_join_partials(spark, sf_dir):
    """Length of partial texts joined for a second pass: beyond the limit each is trimmed to an equal share."""
    c = inputs.load(spark, sf_dir, "conversations").select((F.col("conv_id") % 20).alias("user_id"), F.expr("repeat(text, 12)").alias("text"))
    p = c.groupBy("user_id").agg(F.count("*").alias("n"), (F.sum(F.length("text")) + 2 * (F.count("*") - 1)).alias("total"))
    share = F.greatest(F.lit(500), F.floor((SYNTHESIS - 2 * (F.col("n") - 1)) / F.col("n")))
    x = c.join(p, "user_id").withColumn("kept", F.when(F.col("total") <= SYNTHESIS, F.col("text")).otherwise(F.substring("text", F.lit(1), share.cast("int"))))
    return x.groupBy("user_id").agg((F.sum(F.length("kept")) + 2 * (F.count("*") - 1)).alias("joined"))


@query("tvf_transcript_lines", f"WITH {inputs.LINES}, t AS (SELECT doc_id, pos, CASE WHEN pos % 3 = 0 THEN pos || ':07' WHEN pos % 3 = 1 THEN pos || ' seconds' ELSE line END AS x FROM lines) SELECT doc_id, pos, x, CASE WHEN regexp_matches(x, '^\\s*[0-9]+:[0-9]{{2}}\\s*$') THEN 'time' WHEN regexp_matches(x, '^\\s*(?:[0-9]+ minutes?,? ?)?(?:[0-9]+ seconds?)?\\s*$') AND regexp_matches(x, '[0-9]') THEN 'spoken' ELSE 'text' END AS kind FROM t")
def tvf_transcript_lines(spark, sf_dir):
    n = F.col("pos") % 3
    x = F.when(n == 0, F.concat(F.col("pos").cast("string"), F.lit(":07"))).when(n == 1, F.concat(F.col("pos").cast("string"), F.lit(" seconds"))).otherwise(F.col("line"))
    rows = inputs.lines(spark, sf_dir).select("doc_id", "pos", x.alias("x"))
    kind = F.when(F.col("x").rlike(r"^\s*[0-9]+:[0-9]{2}\s*$"), "time").when(F.col("x").rlike(r"^\s*(?:[0-9]+ minutes?,? ?)?(?:[0-9]+ seconds?)?\s*$") & F.col("x").rlike("[0-9]"), "spoken").otherwise("text")
    return rows.withColumn("kind", kind)


# ---- documents on their way through a model: each distinct text once, and back to every place


@query("join_dedup_mapback", f"WITH {inputs.LINES}, u AS (SELECT line, md5(line) AS y FROM (SELECT DISTINCT line FROM lines)) SELECT doc_id, pos, y FROM lines JOIN u USING (line)")
def join_dedup_mapback(spark, sf_dir):
    """A costly function sees each distinct text once. The result is joined back by text, where a frequent text is skewed, so
    the join is left to adaptive execution, which splits such partitions."""
    l = inputs.lines(spark, sf_dir).select("doc_id", "pos", "line")
    done = l.select("line").distinct().select("line", F.md5("line").alias("y"))
    return l.join(done, "line").select("doc_id", "pos", "y")


@query("join_block_owner", f"WITH {inputs.LINES} SELECT doc_id, pos // 3 AS block, string_agg(line, ' ' ORDER BY pos) AS y FROM lines GROUP BY doc_id, pos // 3")
def join_block_owner(spark, sf_dir):
    x = inputs.lines(spark, sf_dir).groupBy("doc_id", F.floor(F.col("pos") / 3).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("x"))
    return x.select("doc_id", "block", F.concat_ws(" ", F.transform("x", lambda s: s.line)).alias("y"))


@query("agg_translation_stats", f"WITH {inputs.LINES} SELECT doc_id, count(*) AS chunks, count(*) FILTER (length(line) > 20) AS translated, count(*) FILTER (length(line) <= 20) AS untranslated, count(*) - count(DISTINCT line) AS repeats, sum(length(line) - length(replace(line, ',', ''))) AS spans FROM lines GROUP BY doc_id")
def agg_translation_stats(spark, sf_dir):
    l = inputs.lines(spark, sf_dir).groupBy("doc_id", "line").agg(F.count("*").alias("n"))
    n, long = F.col("n"), F.length("line") > 20
    return l.groupBy("doc_id").agg(F.sum("n").alias("chunks"), F.sum(F.when(long, n).otherwise(0)).alias("translated"), F.sum(F.when(~long, n).otherwise(0)).alias("untranslated"), (F.sum("n") - F.count("*")).alias("repeats"), F.sum(n * (F.length("line") - F.length(F.replace("line", F.lit(","), F.lit(""))))).alias("spans"))


@query("topk_samples5", f"WITH {inputs.LINES} SELECT doc_id, list(left(line, 160) ORDER BY pos)[1:5] AS samples FROM lines WHERE length(line) > 40 GROUP BY doc_id")
def topk_samples5(spark, sf_dir):
    """The first five of each document; ranking inside the window keeps five rows a key and task before the shuffle."""
    l = inputs.lines(spark, sf_dir).where(F.length("line") > 40).withColumn("r", F.row_number().over(W.partitionBy("doc_id").orderBy("pos"))).where("r <= 5")
    return l.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.substring("line", 1, 160).alias("s")))), lambda x: x.s).alias("samples"))


@query("limit_lang_sample", "SELECT doc_id, length(array_to_string(string_split(text, chr(10))[1:40], ' ')) AS n FROM documents")
def limit_lang_sample(spark, sf_dir):
    return inputs.load(spark, sf_dir, "documents").select("doc_id", F.length(F.concat_ws(" ", F.slice(F.split("text", "\n"), 1, 40))).alias("n"))


@query("limit_speaker_sample", "SELECT doc_id, md5(left(text, 24000)) AS y FROM documents")
def limit_speaker_sample(spark, sf_dir):
    return inputs.load(spark, sf_dir, "documents").select("doc_id", F.md5(F.substring("text", 1, 24000)).alias("y"))


@query("limit_alias_cap", "SELECT n_regionkey, list(n_name ORDER BY n_name)[1:3] AS kept FROM nation GROUP BY n_regionkey")
def limit_alias_cap(spark, sf_dir):
    return inputs.load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.slice(F.array_sort(F.collect_list("n_name")), 1, 3).alias("kept"))


@query("sort_present", "SELECT conv_id, list(role ORDER BY CASE role WHEN 'system' THEN 0 WHEN 'assistant' THEN 2 ELSE 1 END, turn) AS present FROM conversations GROUP BY conv_id")
def sort_present(spark, sf_dir):
    rank = F.when(F.col("role") == "system", 0).when(F.col("role") == "assistant", 2).otherwise(1)
    return inputs.load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("k"), "turn", "role"))), lambda s: s.role).alias("present"))


# ---- sets


@query("set_word_overlap", f"WITH {inputs.LINES}, w AS (SELECT doc_id, pos, list_distinct(string_split(lower(line), ' ')) AS w FROM lines) SELECT a.doc_id, a.pos, round(len(list_intersect(a.w, b.w)) / greatest(len(a.w), len(b.w)), 6) AS share FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1")
def set_word_overlap(spark, sf_dir):
    w = inputs.lines(spark, sf_dir).select("doc_id", "pos", F.array_distinct(F.split(F.lower("line"), " ")).alias("w"))
    w = w.withColumn("x", F.lead("w").over(W.partitionBy("doc_id").orderBy("pos"))).where("x IS NOT NULL")
    return w.select("doc_id", "pos", F.round(F.size(F.array_intersect("w", "x")) / F.greatest(F.size("w"), F.size("x")), 6).alias("share"))


@query("set_contaminating", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN ['Latin'] ELSE ['Devanagari'] END AS scripts FROM documents")
def set_contaminating(spark, sf_dir):
    """Source scripts that are none of the target's."""
    source, target = F.array(F.lit("Latin"), F.lit("Devanagari")), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("Devanagari"))).otherwise(F.array(F.lit("Latin")))
    return inputs.load(spark, sf_dir, "documents").select("doc_id", F.array_except(source, target).alias("scripts"))


@query("set_union_candidates", "SELECT conv_id, 'main' AS origin, turn FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, 'window', turn FROM conversations WHERE role = 'assistant'")
def set_union_candidates(spark, sf_dir):
    c = inputs.load(spark, sf_dir, "conversations")
    of = lambda r, o: c.where(F.col("role") == r).select("conv_id", F.lit(o).alias("origin"), "turn")
    return of("user", "main").unionByName(of("assistant", "window"))


@query("set_missing_spans", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 1 END AS missing FROM documents")
def set_missing_spans(spark, sf_dir):
    text = F.when(F.col("doc_id") % 4 == 0, "a ⟦0⟧ b").otherwise("⟦ 2 ⟧ x ⟦0⟧")
    found = F.transform(F.regexp_extract_all(text, F.lit(r"⟦\s*([0-9]+)\s*⟧"), F.lit(1)), lambda x: x.cast("int"))
    return inputs.load(spark, sf_dir, "documents").select("doc_id", F.size(F.array_except(F.sequence(F.lit(0), F.lit(2)), found)).alias("missing"))


@query("set_lexicon_add", "SELECT n_name AS term FROM nation WHERE lower(n_name) NOT IN (SELECT lower(r_name) FROM region)")
def set_lexicon_add(spark, sf_dir):
    n, r = inputs.load(spark, sf_dir, "nation"), inputs.load(spark, sf_dir, "region").select(F.lower("r_name").alias("low"))
    return n.select(F.col("n_name").alias("term")).join(F.broadcast(r), F.lower("term") == F.col("low"), "left_anti")


@query("set_content_names", "SELECT DISTINCT c_mktsegment AS name FROM customer UNION SELECT DISTINCT o_orderpriority FROM orders UNION SELECT DISTINCT role FROM conversations WHERE role <> 'system'")
def set_content_names(spark, sf_dir):
    of = lambda t, c: inputs.load(spark, sf_dir, t).select(F.col(c).alias("name")).distinct()
    return of("customer", "c_mktsegment").union(of("orders", "o_orderpriority")).union(of("conversations", "role").where("name <> 'system'")).distinct()
