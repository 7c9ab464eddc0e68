import math
import random
import re

import duckdb
import pytest

from voxloom.llm import decontam
from voxloom.llm.decontam import ORACLE, find_items


def shingles(text, k=5):
    w = re.findall(r"[^\W_]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(docs, items):
    out = {}
    for d, t in docs:
        s = shingles(t)
        for i, x in items:
            b = shingles(x)
            n = len(b & s)
            if b and n >= math.ceil(len(b) * 0.8 - 1e-9):
                out[d, i] = max(out.get((d, i), (0, 0)), (n, len(b)))
    return {k: (v[1], v[0]) for k, v in out.items()}


@pytest.mark.parametrize("seed,small", [(1, 2_000_000), (2, 0)])
def test_against_brute_force(spark, monkeypatch, seed, small):
    monkeypatch.setattr(decontam, "SKETCH_ROWS", small)  # 0: nothing is broadcast
    monkeypatch.setattr(decontam, "SHINGLES", small)
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice("ab cd ef gh ij kl mn op qr st uv wx yz été".split()) + str(rng.randrange(30)) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 5, 6, 9, 20, 60]))) for i in range(40)] + [(90, ""), (91, None), (92, "Tie, tie! TIE tie tie tie tie")]
    docs = [(i, text(rng.randrange(0, 200))) for i in range(60)]
    for i in range(60):
        w = (rng.choice(items[:40])[1] or "").split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = "changed"
        docs.append((100 + i, text(rng.randrange(0, 400)) + " " + ",  ".join(w).upper() + "\n" + text(rng.randrange(0, 3000))))
    docs += [(300, None), (301, ""), (302, "tie tie tie tie tie"), (103, docs[63][1]), (103, "other"), (None, items[5][1])] + [(400 + i, items[3][1]) for i in range(50)]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, item_id string")
    it = spark.createDataFrame([(t, i, 1) for i, t in items], "text string, item_id long, doc_id int")
    got = {(r.doc_id, r.item_id): (r.n_shingles, r.n_found) for r in find_items(df, it).collect()}
    assert got == brute(docs, items)
    con = duckdb.connect()
    for name, key, rows in (("documents", "doc_id", [x for x in docs if x[0] is not None and x[0] != 103]), ("benchmark", "item_id", items)):
        con.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    want = {(d, i): (n, f) for d, i, n, f in con.sql(f"SELECT doc_id, item_id, n_shingles, n_found FROM ({ORACLE})").fetchall()}
    assert {k: v for k, v in got.items() if k[0] is not None and k[0] != 103} == want


def test_empty(spark):
    none, item = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert find_items(none, item).collect() == find_items(one, item).collect() == find_items(none, one.withColumnRenamed("doc_id", "item_id")).collect() == []
