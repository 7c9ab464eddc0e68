"""Small examples with known answers, most of them for rules that no SQL can state or that driver tables do not reach."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.functions import text as T
from voxloom.operators import chunking as C
from voxloom.operators import minutes as M
from voxloom.operators import sequences as S
from voxloom.operators.intervals import max_overlap, phantoms, reassign
from voxloom.operators.vectors import decide
from voxloom.sources import readers as R


def apply(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_timestamps_and_fillers(spark):
    assert apply(spark, T.strip_timestamps, "0:077 seconds", "1:141 minute, 14 seconds", "10:0110 minutes, 1 second", "at 2:30 pm") == ["", "", "", "at 2:30 pm"]
    assert apply(spark, T.remove_fillers, "where where where", "had had that that", "the the cat", "करना करना") == ["where", "had had that that", "the cat", "करना करना"]


def test_hallucinations(spark):
    loop = "thank you. " * 2000
    assert apply(spark, T.remove_hallucinations, loop + "done", "subscribe subscribe", "[MUSIC] go ... on", "okay. okay.", "एक-एक-एक-एक-एक-एक-एक x", "thank you") == ["done", "", "go on", "", "x", ""]


def test_collapse_repeats(spark):
    assert apply(spark, T.collapse_repeats, "we will go we will go now", "a b c d a b c d end", "no no , yes") == ["we will go now", "a b c d end", "no, yes"]


def test_meta_and_placeholders(spark):
    assert apply(spark, T.strip_meta, "Adopt (R-92, Series 2025)", "Start (implied, not explicitly stated as start date).") == ["Adopt (R-92, Series 2025)", "Start"]
    assert apply(spark, T.clean_placeholder, "TBD.", None, " Ann ", "-") == ["", "", "Ann", ""]
    assert apply(spark, T.normalise_tag, "[speaker_2]", "Speaker 2", "speaker_2", "Ann") == ["Speaker_2"] * 3 + ["Ann"]


def test_records_and_quotes(spark):
    past = lambda x: x.rlike("(?i)" + T.PAST) & ~x.rlike("(?i)" + T.FUTURE)
    assert apply(spark, past, "Nick was asked to give an overview", "X was asked to report back by Friday") == [True, False]
    assert apply(spark, T.norm_quote, "I will adjourn at 2:09", "yeah, Nick, uh, I thought") == ["iwilladjournat209", "yeahnickithought"]


def test_languages(spark):
    assert apply(spark, T.detect_language, "aap kaise hain", "नमस्ते", "12", "नमस्ते hello there my good friends of the town") == ["English", "Hindi", "English", "Hindi"]
    assert apply(spark, T.content_chars, "大家好，我叫Ashutosh。", "MinIO, Temporal,", "60 H2O ok") == ["大家好我叫", "", "ok"]
    assert apply(spark, lambda x: T.char_loop(x), "गूगूगूगूगूगूगू", "abcdefgh", "aaaa") == [True, False, False]


def test_near_duplicates(spark):
    a = "Complete the development vision and mission feedback spreadsheet"
    cases = [
        (a, "Complete the feedback spreadsheet on development vision and mission within the next week", True),
        ("Update the yaml files", "Review the yaml files", False),
        ("Approved the agenda", "The town council approved the agenda for the meeting", True),
    ]
    df = spark.createDataFrame(cases, "a string, b string, want boolean")
    for r in df.select("want", S.near(T.task_terms(F.col("a")), T.task_terms(F.col("b"))).alias("got")).collect():
        assert r.got == r.want


def test_consecutive_duplicates_compare_with_the_last_kept(spark):
    rows = [(1, i, t) for i, t in enumerate(["a b c d e f g h i j", "a b c d e f g h x y", "a b c d e f w v x y", "A B C D E F W V X Y", " ", "z"])]
    got = S.drop_consecutive(spark.createDataFrame(rows, "k int, pos int, t string"), "k", "pos", "t").orderBy("pos").collect()
    assert [r.pos for r in got] == [0, 2, 5]


def test_loops():
    tail = " ".join(["good", "text", "about", "the", "plan"] + ["और", "वार्ट"] * 8)
    assert S.trim_loop(tail) == "good text about the plan और वार्ट"
    assert S.trim_loop("a b c") == "a b c"
    assert S.trim_suffix("this is a sentence. this is a sentence.") == "this is a sentence."
    assert S.trim_garbled("one two three four five six seven eight " + "x y " * 5).startswith("one two three")
    assert S.salvage("you " * 9) is None


def test_segments(spark):
    rows = [(1, i, t) for i, t in enumerate(["", "please subscribe", "Subscribe. now to this channel", "a real sentence here", "गूगूगूगूगूगूगू", "word word word word word word", "thanks for watching"])]
    got = S.clean_segments(spark.createDataFrame(rows, "k int, pos int, t string"), "k", "pos", "t").collect()
    assert [r.pos for r in got] == [3]


def test_run_smoothing():
    assert S.smooth_runs([("a", [1, 2, 3]), ("b", [4]), ("a", [5, 6, 7])]) == [("a", [1, 2, 3, 4, 5, 6, 7])]
    assert S.smooth_runs([("a", [1]), ("b", [2, 3, 4])]) == [("b", [1, 2, 3, 4])]
    assert S.smooth_runs([("a", [1, 2, 3]), ("b", [4]), ("c", [5, 6, 7])]) == [("a", [1, 2, 3, 4]), ("c", [5, 6, 7])]


@pytest.mark.parametrize("width", [None, 3.0])
def test_overlap(spark, width):
    s = spark.createDataFrame([(1, 1, 0.0, 4.0), (1, 2, 20.0, 21.0), (1, 3, 5.0, 9.0), (2, 1, 0.0, 1.0)], "meeting int, no int, start double, stop double")
    t = spark.createDataFrame([(1, 1, 0.0, 2.0), (1, 2, 2.0, 4.0), (1, 3, 6.0, 8.0), (1, 4, 30.0, 31.0)], "meeting int, turn int, t_start double, t_stop double")
    got = {(r.meeting, r.no): r.turn for r in max_overlap(s, t, width).collect()}
    assert got == {(1, 1): 1, (1, 2): 4, (1, 3): 3}  # a tie goes to the first turn, no overlap to the nearest midpoint


def test_overlap_against_brute_force(spark):
    rng = random.Random(5)
    span = lambda: (a := rng.randrange(0, 100) / 2, a + rng.randrange(1, 12) / 2)
    s = [(m, i, *span()) for m in range(4) for i in range(30)]
    t = [(m, i, *span()) for m in range(4) for i in range(25)]
    over = lambda a, b: min(a[3], b[3]) - max(a[2], b[2])
    want = {}
    for a in s:
        own = [b for b in t if b[0] == a[0]]
        best = max(own, key=lambda b: (over(a, b), -b[1]))
        want[a[:2]] = best[1] if over(a, best) > 0 else min(own, key=lambda b: (abs(a[2] + a[3] - b[2] - b[3]) / 2, b[1]))[1]
    sdf, tdf = spark.createDataFrame(s, "meeting int, no int, start double, stop double"), spark.createDataFrame(t, "meeting int, turn int, t_start double, t_stop double")
    for width in (None, 4.0):
        assert {(r.meeting, r.no): r.turn for r in max_overlap(sdf, tdf, width).collect()} == want


def test_phantoms(spark):
    rows = [(1, 1, "a", 0.0, 30.0), (1, 2, "b", 10.0, 11.0), (2, 1, "x", 0.0, 1.0), (2, 2, "y", 1.0, 2.0)]
    t = spark.createDataFrame(rows, "meeting int, turn int, speaker string, start double, stop double")
    gone = phantoms(t)
    assert [(r.meeting, r.speaker) for r in gone.collect()] == [(1, "b")]  # a meeting of phantoms keeps them
    assert {(r.meeting, r.turn): r.speaker for r in reassign(t, gone).collect()}[1, 2] == "a"


def test_cluster_decisions():
    m = lambda *r: np.array(r, float)
    assert decide(["a", "b"], m([1, 0.836], [0.836, 1]), None) == ([], [])
    assert decide(["a", "b"], m([1, 0.95], [0.95, 1]), None)[0] == [["a", "b"]]
    near = m([1, 0.9, 0.3], [0.9, 1, 0.32], [0.3, 0.32, 1])
    assert decide(["a", "b", "c"], near, None)[0] == [["a", "b"]]
    noise = m([1, 0.5, 0.03], [0.5, 1, 0.04], [0.03, 0.04, 1])
    assert decide(["a", "b", "c"], noise, {"c": 0.1})[1] == ["c"] and decide(["a", "b", "c"], noise, {"c": 0.9})[1] == []


def test_chunks():
    assert C.sentences('One. "Two!" Three? चार। x') == ["One.", '"Two!', "Three?", "चार।", "x"]
    assert C.reflow("A line\ngoes on.\n- item one\n- item two\n\nhyphen-\nated word") == ["A line goes on.", "- item one", "- item two", "hyphenated word"]
    assert C.hard_split("aa bb " + "x" * 7 + " cc", 5) == ["aa bb", "xxxxx", "xx cc"]
    assert C.hard_split("x" * 10, 5) == ["xxxxx", "xxxxx"]
    assert C.chunk("short") == ["short"] and all(len(c) <= 1200 for c in C.chunk("A sentence here. " * 200))
    assert C.batch_numbers([1] * 10 + [1]) == [0] * 10 + [1] and C.batch_numbers([2500, 1]) == [0, 1] and C.batch_numbers([3000]) == [0]
    assert C.char_windows("x" * 100) == ["x" * 100] and "".join(C.char_windows("ab. " * 1000)[:1]).endswith(".")
    w = C.word_windows(" ".join(map(str, range(300))))
    assert [x.split()[0] for x in w] == ["0", "90", "180"] and C.word_windows("one two") == ["one two"]
    assert [len(c) for c in C.correction_chunks("\n".join(["x" * 999] * 5))] == [3999, 999]


@pytest.mark.parametrize("text", ["", " ".join(map(str, range(1500))), "".join(map(str, range(2000))), ". ".join(map(str, range(900)))])
def test_windows_cover(text):
    got = C.char_windows(text)
    at = 0
    for w in got:
        i = text.find(w, max(0, at - 400))
        assert i <= at
        at = i + len(w)
    assert at == len(text)


def test_code_spans():
    assert M.mask("curl -s localhost:8001/health") == ("⟦0⟧", ["curl -s localhost:8001/health"])  # a whole command line
    masked, spans = M.mask("note\n  git status   # what changed\nend")
    assert masked == "note\n⟦0⟧   # what changed\nend" and spans == ["  git status"]
    text = "see `x` at localhost:8001/health with API_KEY and friends and/or AGENDA, \"Quadrant\" \"two words\" 🚀 in core/a_b.rs"
    masked, spans = M.mask(text)
    assert M.unmask(masked, spans) == (text, 0)
    assert spans == ["`x`", "localhost:8001/health", "core/a_b.rs", "API_KEY", '"Quadrant"', "🚀"]
    assert M.unmask("〖0〗 ⟦ 1 〗", ["a", "b"]) == ("a b", 0)
    assert M.unmask("⟦ १ ⟧ ⟦7⟧", ["a", "b"]) == ("b ⟦7⟧", 1)


def test_phonetics(spark):
    words = ["Kafka", "cafca", "", "kafga", "Schwyz"]
    keys = {r.w: r.k for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", T.phonetic_key(F.col("w")).alias("k")).collect()}
    assert keys["Kafka"] == keys["cafca"] and keys[""] == "" and M.term_keys(spark, ["Kafka"]) == {"Kafka": keys["Kafka"]}
    assert M.alike("kafga", "Kafka", keys["kafga"], keys["Kafka"]) > 0.58


def test_sources(spark, tmp_path):
    assert R.decode_text("é".encode()) and R.decode_text(b"abc") in ("abc", b"abc".decode("utf-8"))
    assert R.text_blocks("a  b\n\nc\nd") == ["a b", "c d"]
    (tmp_path / "a.txt").write_text("One line\nmore.\n\nTwo")
    (tmp_path / "b.txt").write_bytes(b"%PDF-1.4 x")
    got = sorted((r.kind, r.block_no, r.text) for r in R.read_documents(spark, str(tmp_path)).collect() if r.text)
    assert got == [(".txt", 0, "One line more."), (".txt", 1, "Two")]
    kinds = {r.path[-5:]: r.kind for r in R.read_documents(spark, str(tmp_path)).collect()}
    assert kinds == {"a.txt": ".txt", "b.txt": ".pdf"}


def test_jobs(spark):
    raw = ['{"tenantId": "t", "tenant_id": "", "file_urls": ["x", ""], "documentIds": ["d"]}', '{"path": "p"}', "nonsense", "[]", None]
    got = R.parse_job(spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string"), "raw").orderBy("i").collect()
    assert [r.bad for r in got] == [False, False, True, True, True]
    assert got[0].tenant_id == "t" and got[0].file_urls == ["x"] and got[0].document_ids == ["d"] and got[1].file_urls == ["p"]


def test_dates(spark):
    ways = ["2026-09-11", "11-09-2026", "11/9/2026", "11.09.2026", "11 September 2026", "11 Sep 2026", "11 September, 2026", "September 11, 2026", "Sep 11, 2026", "september 11 2026", "SEP 11 2026", "11 Sep 26", "11-Sep-2026", "11-Sep-26"]
    ways += ["Friday, 11th September 2026", "fri 11 Sep 2026", "  2026-09-11T10:00 ", "Sept 11", "31/31/2026", "30 February 2026", "", None]
    got = spark.createDataFrame([(i, w) for i, w in enumerate(ways)], "i int, w string").select("i", T.parse_date(F.col("w")).alias("d")).orderBy("i").collect()
    assert [r.d for r in got] == ["11 Sep 26"] * 17 + [""] * 5


def test_loops_are_counted_in_linear_time(spark):
    """A line of 20,000 words, a line that is nine tenths one word, and a text that is degenerate."""
    import time

    long = " ".join(f"word{i % 6000}" for i in range(20_000))
    loop = " ".join(["again", "again", "again", "again", "and"] * 4)
    rows = spark.createDataFrame([(1, 0, long), (1, 1, loop), (1, 2, "it is good to be here today")], "k int, pos int, t string")
    began = time.time()
    got = {r.pos: r.t for r in S.clean_segments(rows, "k", "pos", "t").collect()}
    assert got[0].split() == long.split() and 2 in got and got.get(1) != loop and time.time() - began < 60
    counts = spark.createDataFrame([(["a", "b", "a"],), ([],), ([None, None, "x"],)], "x array<string>").select(T.most_frequent(F.col("x")).alias("n")).collect()
    assert [r.n for r in counts] == [2, 0, 2]
