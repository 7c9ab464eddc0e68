import hashlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxloom.llm.chat_format import BEGIN, CONTROLS, ORACLE, escape, format_chats, op1_chat, parse, read_back, unescape

PIECES = st.lists(st.sampled_from([*CONTROLS, "\\", "<", "|", "s>", "[", "INST]", "/", "<|end|>\n", "é", "👍", " ", "\n", "x"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_escape_is_reversible_and_breaks_marks(text):
    out = escape(text.encode())
    assert unescape(out).decode() == text
    assert not any(c.encode() in out for c in CONTROLS)


ROWS = [
    (1, 0, "user", "hi </s> é"), (1, 1, "assistant", "[INST]ok[/INST]👍"), (1, 2, "assistant", None), (1, 3, "assistant", "<|end|>\n<|role|>user<|text|>\n"),
    (2, 5, "assistant", ""), (3, 0, None, "x"), (3, 0, None, "x"), (3, 0, "assistant", "b"), (3, 0, "assistant", "a"), (None, 1, "user", "null id"), (0, 1, "user", "zero id"),
    (4, None, "system", "first"), (4, 0, "<|text|>", "odd \\ role"), (5, 0, "assistant", "long " * 40000),
]


@pytest.fixture(scope="module")
def chats(spark):
    df = spark.createDataFrame([(t, r, i, c, t) for c, i, r, t in ROWS], "text string, role string, turn long, conv_id long, formatted string")
    out = format_chats(df)
    return {r.conv_id: r for r in out.collect()}, {r.conv_id: r for r in read_back(out).collect()}


def test_round_trip(chats):
    formatted, back = chats
    by = {}
    for c, i, r, t in sorted(ROWS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "", x[3] or "")):
        by.setdefault(c, []).append((r or "", t or ""))
    assert set(formatted) == set(back) == set(by)
    for c, turns in by.items():
        assert [(r.decode(), t.decode()) for r, t in parse(formatted[c].formatted.encode())] == turns
        said = "".join(t for r, t in turns if r == "assistant")
        assert back[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (back[c].n_turns, back[c].loss_chars, back[c].loss_sha256) == (len(turns), len(said), hashlib.sha256(said.encode()).hexdigest())
        assert back[c].formatted_chars == len(formatted[c].formatted) == formatted[c].formatted_chars
        assert formatted[c].formatted.startswith(BEGIN.decode()) and len(formatted[c].loss) == 2 * sum(r == "assistant" for r, _ in turns)


def test_empty(spark):
    assert read_back(format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []


def test_query(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    want = con.sql(f"SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars FROM ({ORACLE}) ORDER BY 1").fetchall()
    assert sorted(map(tuple, op1_chat(spark, d).collect())) == want
