import duckdb

from voxloom.llm.licenses import ORACLE, TEMPLATES, scan

APACHE = dict((l, t) for l, t in TEMPLATES)["apache-2.0"]
ROWS = [
    (1, "CC BY cc-by CC\nBY, All Rights Reserved."), (2, None), (3, ""), (4, "one"), (5, "cc"), (6, "the GENERAL public license general Public License"),
    (7, "x " * 300 + APACHE.upper() + " y" * 200), (8, APACHE.replace("may not use", "may certainly not ever use")), (9, " ".join(APACHE.split()[:8])),
    (10, "über cc by é" + " cc by" * 500), (1, "CC BY cc-by CC\nBY, All Rights Reserved."), (None, "all rights reserved"), (11, TEMPLATES[0][1] + " " + TEMPLATES[2][1]), (12, "a" * 100_000 + " cc by"),
]


def test_against_sql(spark, tmp_path):
    rows = [r for r in ROWS if r[0] is not None][:10] + ROWS[-2:]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, label string, i int")
    got = {r.doc_id: tuple(r) for r in scan(df).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = {r[0]: r for r in con.sql(f"SELECT doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score FROM ({ORACLE})").fetchall()}
    assert got == want
    assert got[1][1:7] == (9, 4, 0, 6, "cc-by,reserved", "cc-by,reserved") and got[2] == (2, 0, 0, None, None, "", "", 0.0)
    assert got[7][6] == "apache-2.0" and got[8][6] == "apache-2.0" and got[9][6] == "" and got[10][2] == 501 and got[11][6] == "bsd,mit"


def test_repeats_and_null_ids(spark):
    got = scan(spark.createDataFrame(ROWS, "doc_id long, text string")).collect()
    assert len(got) == len(ROWS) and sum(r.doc_id == 1 and r.n_base == 4 for r in got) == 2
    assert [r.labels for r in got if r.doc_id is None] == ["reserved"]
    assert scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
