import itertools
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from voxloom.llm import common
from voxloom.llm.url_filter import DIGITS, RULES, SEEDED, SEEDS, UNKNOWN, judge, op9_urls, rule_columns, segment, split_url


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    path = rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def rule(host, path):
    fit = [(h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=lambda x: len(x[0])) if fit else (None, None)


URLS = [
    "http://Example.com/en/1", "https://www.EXAMPLE.com/en/", "https://m.www.example.com/en/x?y#z", "http://example.com/de", "http://a.com", "http://a.com/", "http://notexample.net/es/1", "http://x.net/fr/?q",
    "http://x.net?/fr/", "no scheme", "", None, "://", "http://É.Com/é", "a://b://c.com/d", "http://xcom/", "http://x\ny.com/a\nb#c", "http://" + "a" * 5000 + ".org/" + "b" * 5000,
]


def test_split_and_rules(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "i int, url string")
    host, path = split_url(F.col("url"))
    got = df.select("i", host.alias("host"), path.alias("path")).select("*", *rule_columns(F.col("host"), F.col("path"))).collect()
    for r in got:
        assert (r[1], r[2]) == parts(URLS[r[0]])
        assert (r[3], r[4]) == rule(r[1], r[2]), URLS[r[0]]


def test_segmentation_is_optimal():
    counts = {"cheap": 5, "pills": 5, "pill": 2, "heap": 1, "che": 3, "the": 50, "in": 20, "ing": 9, "s": 1}
    total = sum(counts.values())
    assert segment("cheappills", counts, total) == ["cheap", "pills"] and segment("thein", counts, total) == ["the", "in"] and segment("", counts, total) == []
    assert segment("q" * 3000, counts, total) == [UNKNOWN] and segment("theqqqq", counts, total) == ["the", UNKNOWN]

    def cost(words):
        return sum(-math.log(counts[w] / total) if w in counts else math.log(total) + 1 + math.log(10) * (len(w) - 1) for w in words)

    for name in ("theing", "pillsin", "xthe", "cheheap", "zzpillzz", "ingsinthe"):
        cuts = (c for k in range(len(name)) for c in itertools.combinations(range(1, len(name)), k))
        words = [[name[a:b] for a, b in zip((0, *c), (*c, len(name)))] for c in cuts]
        got, at, own = segment(name, counts, total), 0, []
        best = min(words, key=cost)
        for i, w in enumerate(got):  # unknown stretches back to their letters
            rest = sum(len(x) for x in got[i + 1 :] if x != UNKNOWN)
            n = len(w) if w != UNKNOWN else len(best[i]) if len(best) == len(got) else len(name) - at - rest
            own.append(name[at : at + n])
            at += n
        assert "".join(own) == name and math.isclose(cost(own), cost(best)), (got, best)


def bayes(rows):
    """Log odds of each (host, path) without a rule, by dictionaries."""
    own = {x for _, h, p in RULES for x in re.findall(r"[a-z]+", h + " " + p)}
    words = Counter(w for _, _, html in rows for t in re.findall(r"(?is)<title[^>]*>(.*?)</title>", html or "")[:1] for w in re.findall(r"[^\W\d_]+", t.lower()))
    words.update(w for x in SEEDS.values() for w in x)
    total = sum(words.values())

    def tokens(host, path):
        names = re.findall(r"[^\W\d_]+|\d+", (host + " " + re.sub("^/[a-z]{2}/", "/", path)).lower())
        return [t for n in names if n not in own for t in ([DIGITS] if n[0].isdigit() else segment(n, words, total)) if t != UNKNOWN]

    a, b = Counter(), Counter()
    for _, url, _ in rows:
        (b if rule(*parts(url))[1] == "block" else a).update(tokens(*parts(url)))
    weight = max(1, round(SEEDED * (sum(a.values()) + sum(b.values()))))
    for v, x in (("allow", a), ("block", b)):
        for w in SEEDS[v]:
            x[w] += weight
    v = len(a | b)
    odds = lambda t: math.log((b[t] + 1) / (sum(b.values()) + v)) - math.log((a[t] + 1) / (sum(a.values()) + v))
    return lambda url: sum(odds(t) for t in tokens(*parts(url)))


@pytest.mark.parametrize("heavy", [10_000, 3])
def test_verdicts_against_dictionaries(spark, monkeypatch, heavy):
    monkeypatch.setattr(common, "HEAVY", heavy)
    rng = random.Random(6)
    word = ["good", "shop", "garden", "river", "stone", "pills", "cheap", "casino", "cloud", "été"]
    title = "<title>good shop garden river stone cloud été</title>"
    rows = [(i, f"http://{rng.choice(['', 'm.', 'blog.'])}{rng.choice(word)}{rng.choice(word)}.example.{rng.choice(['net', 'org', 'com'])}/{rng.choice(['en', 'es', 'fr', 'de'])}/{rng.choice(word)}/{i % 40}", rng.choice([title, "", None])) for i in range(400)]
    rows += [(None, None, None), (7, rows[7][1], title), (901, "http://" + "cheapq" * 200 + ".org/", title), (902, "http://[::]/", "<title></title>")]
    z = bayes(rows)
    got = judge(spark.createDataFrame([(a, b, c, b, 1) for a, b, c in rows], "page_id long, url string, html string, host string, n int")).collect()
    assert len(got) == len(rows)
    urls = {**{a: b for a, b, _ in rows}}
    for r in got:
        want = rule(r.host, r.path)
        assert r.rule == want[0] and (r.host, r.path) == parts(urls[r.page_id])
        if want[0] is None:
            x = z(urls[r.page_id])
            assert r.block_score == pytest.approx(1 / (1 + math.exp(-x)), abs=1e-9) and r.verdict == ("block" if x > 0 else "allow")
        else:
            assert r.verdict == want[1] and r.block_score is None


def test_names_never_seen(spark):
    """Beside all pages of a table: concatenated names of spam are blocked, ordinary ones and the table's own hosts are not."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    bad = ["cheap-pills.example.org", "casinojackpot.org", "spam-farm.example.org", "adstracker.example.net", "pokerslots.net"]
    fine = ["dailynews.example.org", "townlibrary.net", "scienceforum.org", "ththan.example.net", "blog.history.net"]
    more = spark.createDataFrame([(10**6 + i, f"https://{h}/de/{i}", None) for i, h in enumerate(bad + fine)], "page_id long, url string, html string")
    got = judge(pages.unionByName(more)).where("rule IS NULL").collect()
    verdict = {r.host: r.verdict for r in got if r.page_id >= 10**6}
    assert [verdict[h] for h in bad] == ["block"] * 5 and [verdict[h] for h in fine] == ["allow"] * 5
    own = [r for r in got if r.page_id < 10**6]
    assert sum(r.verdict == "block" for r in own) <= 0.1 * len(own)


def test_empty(spark):
    assert judge(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{d}/pages.parquet").collect()]
    urls, z = {a: b for a, b, _ in rows}, bayes(rows)
    for r in op9_urls(spark, d).collect():
        own = rule(r.host, r.path)
        assert (r.host, r.path) == parts(urls[r.page_id]) and r.rule == own[0]
        assert r.verdict == (own[1] or ("block" if z(urls[r.page_id]) > 0 else "allow"))
