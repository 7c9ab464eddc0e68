"""Queries over documents see every line, and groups every row, on a small table whose cases come late."""

import difflib

import pytest
from pyspark.sql import functions as F

from voxloom.plans import registry

registry.fill()
LINES = [f"plain filler sentence number {i} about topic{i} and thing{i * 7}" for i in range(30)]
LATE = [
    "budget approval meeting schedule quarterly forecast",
    "budget approval meeting schedule quarterly forecast",
    "we use kafka and Thionnation here",
    "x" * 310 + " alpha beta",
    "x" * 310 + " gamma beta",
    "यह एक हिंदी वाक्य है",
]


@pytest.fixture(scope="module")
def late(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("late"))
    spark.createDataFrame([(i, "\n".join([*LINES, *LATE]), "s") for i in (5, 7)], "doc_id long, text string, source string").write.parquet(f"{at}/documents.parquet")
    names = sorted({f"{a}{b} {c}" for a in ("Ann", "Bob", "Cyril", "Dora") for b in ("a", "elle", "iston") for c in ("Lee", "Leigh", "Marchetti", "Zersky", "Oduya", "Vaz")})
    spark.createDataFrame([(i, n, 3) for i, n in enumerate(names)], "c_custkey long, c_name string, c_nationkey int").write.parquet(f"{at}/customer.parquet")
    return at


def got(spark, late, key):
    return registry.QUERIES[key](spark, late).collect()


@pytest.mark.parametrize("key", ["correct_terms", "conforms", "mask_terms", "mask_code", "win_trailing_loop", "win_trailing_suffix", "win_garbled_tail", "latin_terms", "learn_aliases", "validate_translation"])
def test_every_line(spark, late, key):
    assert {(r.doc_id, r.pos) for r in got(spark, late, key)} == {(d, i) for d in (5, 7) for i in range(len(LINES) + len(LATE))}


def test_late_cases(spark, late):
    n = len(LINES)
    fixed = {r.pos: r.y for r in got(spark, late, "correct_terms") if r.doc_id == 5}
    assert fixed[n + 2] == "we use Kafka and Thionation here"
    assert {r.pos for r in got(spark, late, "conforms") if r.doc_id == 5 and not r.ok} == {n + 5}
    ratio = {r.pos: r.ratio for r in got(spark, late, "similarity") if r.doc_id == 5}
    assert len(ratio) == n + len(LATE) - 1 and ratio[n] == 1 and ratio[n + 3] == round(difflib.SequenceMatcher(None, LATE[3], LATE[4]).ratio(), 6) < 1
    assert any(r.token == "Thionnation" for r in got(spark, late, "join_phonetic"))
    assert {r.pos for r in got(spark, late, "proper_nouns_unsupported")} <= {1}  # the sentence with a name that no source holds


@pytest.mark.parametrize("key", ["win_near_dup_greedy", "win_repeated_figures"])
def test_late_points(spark, late, key):
    kept = {r.pos for r in got(spark, late, key) if r.doc_id == 5}
    assert len(LINES) in kept or key == "win_repeated_figures"
    assert max(kept) > 12 and (key != "win_near_dup_greedy" or len(LINES) + 1 not in kept)


def test_every_name(spark, late):
    rows = {r.name: r.canonical for r in got(spark, late, "name_fuzzy_merge")}
    names = sorted(r.c_name for r in spark.read.parquet(f"{late}/customer.parquet").collect())
    assert len(names) > 40
    done, want = set(), {}
    for a in names:
        if a not in done:
            own = [b for b in names if b not in done and (a == b or difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio() >= 0.75)]
            done.update(own)
            want |= dict.fromkeys(own, max(own, key=len))
    assert rows == want


def test_restated_against_all_pairs():
    import random

    from voxloom.operators.sequences import restated

    rng = random.Random(6)
    for n in (0, 1, 30, 90):
        points = [(rng.randrange(n), sorted({rng.choice("abcdefghijkl") for _ in range(rng.randrange(14))})) for _ in range(n)]
        alike = lambda a, b: len({*a} & {*b}) >= 3 and 100 * len({*a} & {*b}) >= 85 * max(len(a), len(b))
        assert restated(points) == sorted({p for p, a in points if any(q < p and alike(a, b) for q, b in points)})


def test_restatement_shuffles_no_text(spark, late, tmp_path):
    """Rows are folded where they are, and rows of one id still restate each other."""
    spark.createDataFrame([(1, "x\nbudget approval meeting schedule", "s"), (1, "budget approval meeting schedule\ny", "s"), (None, "a", "s"), (2, None, "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r.doc_id, r.pos) for r in registry.QUERIES["win_restatement"](spark, str(tmp_path)).collect()] == [(1, 1)]
    plan = registry.QUERIES["win_restatement"](spark, late)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and "Join" not in plan and "MapInPandas" in plan


def test_likeness_is_the_best_of_all(spark):
    import random

    from voxloom.operators import minutes as M

    rng, keys = random.Random(5), M.term_keys(spark, M._TERMS)
    words = ["".join(rng.choice("aeionkfrthKTO") for _ in range(rng.randrange(4, 12))) for _ in range(300)] + [t[:i] + "e" + t[i:] for t in M._TERMS for i in range(len(t))]
    find, done = M.Likeness(keys, 0.7), 0
    for w in words:
        want = max(((M.alike(w, t, w[:3].lower(), keys[t]), t) for t in M._TERMS), key=lambda x: x[0])
        assert find(w, w[:3].lower()) == ((want[1], want[0]) if want[0] >= 0.7 else (None, None))
        done += want[0] >= 0.7
    assert done > 20


def test_key_letters(spark):
    """The ranges of task_key are the complement of its letters, which Java matches slowly in several threads of one JVM."""
    from voxloom.functions import text as T

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    key = T.task_key(F.col("x"))
    assert "[^" not in spark.range(1).select(F.lit("x").alias("x")).select(key)._jdf.queryExecution().analyzed().toString()
    low = spark.createDataFrame([(every,)], "x string").select(F.lower("x").alias("x"))
    assert low.select(key == F.trim(F.regexp_replace("x", "[^a-z0-9 ]+", ""))).first()[0]


def test_distinct_tokens_are_matched_once(spark, late):
    """No filter on the match is moved below the distinct, where it would run at every place of a token."""
    plan = registry.QUERIES["join_phonetic"](spark, late)._jdf.queryExecution().optimizedPlan().toString()
    match, distinct = plan.find("MapInPandas"), plan.find("Aggregate")
    assert plan.count("best(") == 1 and 0 <= match < distinct


def test_long_words_are_matched_whole(spark, tmp_path):
    """A word of any length is one token, compared with every term by brute force."""
    import re

    from voxloom.operators import minutes as M

    texts = ["Kaf kafk Kafka\nErenthaaaaaa Erenthaaaaaaa Thiiooonnnaaattiion", "x1K" + "a" * 5000 + "fka, Oneration-Oooneeeraaatiooon", None, "", "Thionationinternationally äErenthaäOnerationnnnnn"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s")).write.parquet(f"{tmp_path}/documents.parquet")
    words = {w for t in texts if t for w in re.findall("[A-Za-z]+", t) if len(w) >= 4}
    keys = M.term_keys(spark, sorted({*words, *M._TERMS}))
    want = {}
    for w in words:
        score, _, term = max((M.alike(w, t, keys[w], keys[t]), -i, t) for i, t in enumerate(M._TERMS))
        if score >= 0.7:
            want[w] = (term, pytest.approx(score, abs=1e-6))
    rows = registry.QUERIES["join_phonetic"](spark, str(tmp_path)).collect()
    assert len(rows) == len(want) and {r.token: (r.term, r.score) for r in rows} == want
    assert {len(w) for w in want} >= {4, 12, 13, 19, 5004}
