"""Cosine joins, vector search and the repair of speaker clusters. A meeting is a label of `embeddings`, a cluster one vector."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxloom.plans import inputs
from voxloom.plans.registry import query


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def rounded(x: Column | str, n: int) -> Column:
    """x rounded as SQL does it: what rounds to zero keeps its sign, which Spark's round() loses."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(F.round(x, n) == 0, x * F.lit(0.0)).otherwise(F.round(x, n))


def clusters(spark, sf_dir) -> DataFrame:
    """(meeting, cluster, v): unit vectors in double precision."""
    return inputs.load(spark, sf_dir, "embeddings").select(F.col("label").alias("meeting"), F.col("vec_id").alias("cluster"), F.col("embedding").cast("array<double>").alias("v"))


def pairwise(c: DataFrame) -> DataFrame:
    """(meeting, a, b, cos) for each pair a < b of a meeting's clusters."""
    x = c.select("meeting", F.col("cluster").alias("a"), F.col("v").alias("va"))
    y = c.select("meeting", F.col("cluster").alias("b"), F.col("v").alias("vb"))
    return x.join(y, "meeting").where("a < b").select("meeting", "a", "b", dot(F.col("va"), F.col("vb")).alias("cos"))


_C = "c AS (SELECT label AS meeting, vec_id AS cluster, embedding::DOUBLE[] AS v FROM embeddings)"
_P = "p AS (SELECT x.meeting, x.cluster AS a, y.cluster AS b, list_dot_product(x.v, y.v) AS cos FROM c x JOIN c y ON x.meeting = y.meeting AND x.cluster < y.cluster)"
_N = "n AS (SELECT meeting, cluster, max(cos) AS cos FROM (SELECT meeting, a AS cluster, cos FROM p UNION ALL SELECT meeting, b, cos FROM p) GROUP BY meeting, cluster)"
_SAMPLES = "e AS (SELECT vec_id AS sample, 'name' || (vec_id % 7) AS name, embedding::DOUBLE[] AS v FROM embeddings)"


def samples(spark, sf_dir) -> DataFrame:
    """(sample, name, v): every vector plays an enrolled voice."""
    e = inputs.load(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("sample"), F.concat(F.lit("name"), (F.col("vec_id") % 7).cast("string")).alias("name"), F.col("embedding").cast("array<double>").alias("v"))


@query("join_pairwise_cosine", f"WITH {_C}, {_P} SELECT meeting, a, b, round(cos, 4) AS cos FROM p WHERE cos >= 0.3")
def join_pairwise_cosine(spark, sf_dir):
    return pairwise(clusters(spark, sf_dir)).where("cos >= 0.3").withColumn("cos", F.round("cos", 4))


def max_neighbor(p: DataFrame) -> DataFrame:
    both = p.select("meeting", F.explode(F.array(F.struct(F.col("a").alias("cluster"), "cos"), F.struct(F.col("b").alias("cluster"), "cos"))).alias("x")).select("meeting", "x.*")
    return both.groupBy("meeting", "cluster").agg(F.max("cos").alias("cos"))


@query("agg_max_neighbor", f"WITH {_C}, {_P}, {_N} SELECT meeting, cluster, round(cos, 4) AS cos FROM n")
def agg_max_neighbor(spark, sf_dir):
    return max_neighbor(pairwise(clusters(spark, sf_dir))).withColumn("cos", rounded("cos", 4))


def largest_gap(values: DataFrame, key: str, value: str) -> DataFrame:
    """(key, gap, boundary, below): widest drop in each key's values from the largest down, the value above and the one below."""
    order = W.partitionBy(key).orderBy(F.desc(value))
    d = values.select(key, value, F.lead(value).over(order).alias("next"), F.row_number().over(order).alias("r")).where("next IS NOT NULL")
    top = d.groupBy(key).agg(F.max_by(F.struct(value, "next"), F.struct(F.col(value) - F.col("next"), -F.col("r"))).alias("x"))
    return top.select(key, (F.col(f"x.{value}") - F.col("x.next")).alias("gap"), F.col(f"x.{value}").alias("boundary"), F.col("x.next").alias("below"))


_GAP = "g AS (SELECT meeting, cos - nxt AS gap, cos AS boundary, nxt AS below FROM (SELECT meeting, cos, lead(cos) OVER (PARTITION BY meeting ORDER BY cos DESC) AS nxt FROM {0}) WHERE nxt IS NOT NULL QUALIFY row_number() OVER (PARTITION BY meeting ORDER BY cos - nxt DESC, cos DESC) = 1)"


@query("win_largest_gap", f"WITH {_C}, {_P}, {_GAP.format('p')} SELECT meeting, round(gap, 5) AS gap, round(boundary, 5) AS boundary FROM g")
def win_largest_gap(spark, sf_dir):
    return largest_gap(pairwise(clusters(spark, sf_dir)), "meeting", "cos").select("meeting", F.round("gap", 5).alias("gap"), F.round("boundary", 5).alias("boundary"))


#: Rows and columns of the blocks in which a meeting's cosines are made; values of them that are sorted at once.
SIDE, SORTED = 1024, 1 << 22


class Cosines:
    """Cosines of one meeting's rows, made block by block from the vectors, so that a large meeting's matrix is never held."""

    def __init__(self, v):
        self.v, self.n = v, len(v)

    def part(self, a, b):
        return self.v[a] @ self.v[b].T

    def means(self, inside, first, sizes) -> Cosines:
        """Mean cosines between groups: by linearity those of the groups' mean vectors."""
        return Cosines(np.add.reduceat(self.v[inside], first, axis=0) / sizes[:, None])

    def blocks(self):
        """(first row, first column, cosines, which of them are pairs of different rows, each once) of each block."""
        for i in range(0, self.n, SIDE):
            for j in range(i, self.n, SIDE):
                x = self.part(slice(i, i + SIDE), slice(j, j + SIDE))
                yield i, j, x, np.triu(np.ones(x.shape, bool), 1) if i == j else np.ones(x.shape, bool)

    def nearest(self):
        """Each row's largest cosine to another."""
        best = np.full(self.n, -np.inf)
        for i, j, x, up in self.blocks():
            x = np.where(up, x, -np.inf)
            for at, most in ((i, x.max(axis=1)), (j, x.max(axis=0))):
                best[at : at + SIDE] = np.maximum(best[at : at + SIDE], most)
        return best

    def apart(self, i, j):
        """For each pair (i, j), sorted by i: how far apart their cosines to a third row get at most; -inf without a third."""
        if self.n < 3:
            return np.full(len(i), -np.inf)
        used, at = np.unique(np.concatenate((i, j)), return_inverse=True)
        out, own, left, right = np.zeros(len(i)), np.flatnonzero(np.diff(i, prepend=-1)), at[: len(i)], at[len(i) :]
        ends = [*own[1:].tolist(), len(i)]
        for k in range(0, self.n, SIDE // 2):
            m = self.part(used, slice(k, k + SIDE // 2))
            for a, b in zip(own.tolist(), ends):
                for a, b in ((x, min(b, x + 256)) for x in range(a, b, 256)):
                    x, row, to = m[right[a:b]], i[a], j[a:b] - k
                    x -= m[left[a]]
                    if 0 <= row - k < x.shape[1]:
                        x[:, row - k] = 0
                    here = np.flatnonzero((to >= 0) & (to < x.shape[1]))
                    x[here, to[here]] = 0
                    np.maximum(out[a:b], np.maximum(x.max(axis=1), -x.min(axis=1)), out=out[a:b])
        return out

    def apart_at_most(self, i, j):
        """An upper bound of apart(): the distance of two rows times the longest row."""
        far = [np.linalg.norm(self.v[i[k : k + SIDE]] - self.v[j[k : k + SIDE]], axis=1) for k in range(0, len(i), SIDE)]
        return np.concatenate([np.zeros(0), *far]) * np.linalg.norm(self.v, axis=1).max() + 1e-9

    def widest_gap(self):
        """(value above, value below) of the widest drop between cosines from the largest down, the highest of equal ones.

        Ranges of values are cut into slots of which only the least and the largest value are kept; slots that could hold a wider
        drop than any between slots are looked at again, and ranges of few values are sorted.
        """
        best, todo = (-np.inf, -np.inf, -np.inf), [(-np.inf, np.inf)]
        while todo:
            lo, hi = todo.pop()
            if hi - lo < best[0]:
                continue
            count, low, high = 0, np.inf, -np.inf
            held: list | None = []
            for *_, x, up in self.blocks():
                x = x[up & (x >= lo) & (x <= hi)]
                if len(x):
                    count, low, high = count + len(x), min(low, x.min()), max(high, x.max())
                    if held is not None:
                        held.append(x)
                        held = held if count <= SORTED else None
            if count < 2 or low == high:
                if count > 1:
                    best = max(best, (0.0, high, low))
                continue
            if held is None:
                slots = SORTED // 4
                at = lambda x: np.minimum(((x - low) / (high - low) * slots).astype(np.int64), slots - 1)
                least, most = np.full(slots, np.inf), np.full(slots, -np.inf)
                for *_, x, up in self.blocks():
                    x = x[up & (x >= lo) & (x <= hi)]
                    k = at(x)
                    np.minimum.at(least, k, x)
                    np.maximum.at(most, k, x)
                full = np.flatnonzero(most >= least)
                ends, inside = np.stack([least[full][1:], most[full][:-1]]), most[full] - least[full]
            else:
                x = np.sort(np.concatenate(held))
                ends, inside = np.stack([x[1:], x[:-1]]), np.zeros(0)
            gaps = ends[0] - ends[1]
            if len(gaps):
                k = len(gaps) - 1 - int(np.argmax(gaps[::-1]))
                best = max(best, (gaps[k], ends[0, k], ends[1, k]))
            for k in np.flatnonzero((inside > 0) & (inside >= best[0])).tolist():
                todo.append((least[full[k]], most[full[k]]))
        return best[1], best[2]


class Matrix(Cosines):
    """The same of cosines that are there as a matrix."""

    def part(self, a, b):
        return self.v[a, b]

    def apart_at_most(self, i, j):
        return np.full(len(i), np.inf)

    def means(self, inside, first, sizes) -> Cosines:
        return Matrix(np.add.reduceat(np.add.reduceat(self.v[np.ix_(inside, inside)], first, axis=0), first, axis=1) / np.outer(sizes, sizes))


def by_form(c: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clusters of meetings that have a matrix (ids once, finite vectors of one length), and those of other meetings."""
    fine = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    form = c.groupBy("meeting").agg((F.min(fine) & (F.count("*") == F.count_distinct("cluster")) & (F.min(F.size("v")) == F.max(F.size("v")))).alias("plain"), F.count("*").alias("n"))
    x = c.join(form, "meeting")
    return x.where("plain").drop("plain"), x.where("NOT plain").drop("plain", "n")


def apart_joined(c: DataFrame, least: float = 0.3) -> DataFrame:
    """(meeting, a, b, apart) by joins of all pairs, whatever the vectors hold."""
    p = pairwise(c)
    s = p.union(p.select("meeting", "b", "a", "cos"))
    near = p.where(F.col("cos") >= least).select("meeting", F.col("a").alias("i"), F.col("b").alias("j"))
    x, y = s.select("meeting", F.col("a").alias("i"), F.col("b").alias("k"), F.col("cos").alias("x")), s.select("meeting", F.col("a").alias("j"), F.col("b").alias("k"), F.col("cos").alias("y"))
    both = near.join(x, ["meeting", "i"]).where("k <> j").join(y, ["meeting", "j", "k"])
    return both.groupBy("meeting", "i", "j").agg(F.round(F.max(F.abs(F.col("x") - F.col("y"))), 4).alias("apart")).toDF("meeting", "a", "b", "apart")


def apart_blocks(c: DataFrame, least: float = 0.3, rows: int = 1024) -> DataFrame:
    """The same of clusters (meeting, cluster, v, n): a task has a meeting's vectors and looks at the pairs of `rows` of them, in
    matrix products, so neither pairs nor triples are shuffled."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cluster")
        ids, m, out = pdf["cluster"].to_numpy(), Cosines(np.stack(pdf["v"].to_numpy())), []
        at = int(pdf["block"].iloc[0]) * rows
        for i in range(at, min(at + rows, m.n), 64):
            a, b = np.nonzero(m.part(slice(i, min(i + 64, at + rows)), slice(i, m.n)) >= least)
            a, b = a[a < b] + i, b[a < b] + i
            out.append((a, b))
        a, b = (np.concatenate(x) for x in zip(*out))
        far = m.apart(a, b)
        a, b, far = a[far >= 0], b[far >= 0], far[far >= 0]
        return pd.DataFrame({"meeting": pdf["meeting"].iloc[0] if len(pdf) else 0, "a": ids[a], "b": ids[b], "apart": far})

    sent = c.withColumn("block", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / rows).cast("int") - 1)))
    found = sent.repartition(F.col("meeting"), F.col("block")).groupBy("meeting", "block").applyInPandas(run, "meeting int, a long, b long, apart double")
    return found.withColumn("apart", F.round("apart", 4))


@query("same_profile", f"""WITH {_C}, {_P}, s AS (SELECT meeting, a, b, cos FROM p UNION ALL SELECT meeting, b, a, cos FROM p), t AS (SELECT * FROM p WHERE cos >= 0.3)
    SELECT t.meeting, t.a, t.b, round(max(abs(x.cos - y.cos)), 4) AS apart FROM t JOIN s x ON t.meeting = x.meeting AND t.a = x.a AND x.b <> t.b JOIN s y ON t.meeting = y.meeting AND t.b = y.a AND x.b = y.b GROUP BY ALL""")
def same_profile(spark, sf_dir):
    """For near pairs: how far apart their cosines to a third cluster get at most."""
    plain, odd = by_form(clusters(spark, sf_dir))
    return apart_blocks(plain).union(apart_joined(odd))


def decide(labels: list, m, support: dict | None, floor=0.86, thin=0.90, gap=0.06, profile=0.12, drop_gap=0.18, ratio=0.35, most=0.35):
    """(groups to merge, labels to drop) for one meeting's cosines m; merging is decided first, drops on what is left."""
    m = m if isinstance(m, Cosines) else Matrix(m)
    n, root, limit = len(labels), list(range(len(labels))), None

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    if n == 2:
        limit, profile = thin, np.inf
    elif n > 2:
        above, below = m.widest_gap()
        if above - below >= gap and above >= floor:
            limit = max(above - min(1e-12, (above - below) / 2), floor)  # a block may be made with another last bit
    for i, j, x, up in m.blocks() if limit is not None else ():
        a, b = np.nonzero(up & (x >= limit))
        for sure in (True, False):  # pairs that need no look at third rows first: most others are in one group then
            new = np.array([find(p) != find(q) for p, q in zip((a + i).tolist(), (b + j).tolist())], bool)
            a, b = a[new], b[new]
            fits = m.apart_at_most(a + i, b + j) <= profile if sure else m.apart(a + i, b + j) <= profile if len(a) else new[new]
            for p, q in zip((a[fits] + i).tolist(), (b[fits] + j).tolist()):
                root[find(q)] = find(p)
    groups: dict = {}
    for i in range(n):
        groups.setdefault(find(i), []).append(i)
    groups = list(groups.values())
    merged = [[labels[i] for i in g] for g in groups if len(g) > 1]
    k = len(groups)
    if k < 3:
        return merged, []
    inside, sizes = np.concatenate(groups), np.array([len(g) for g in groups])
    near = m.means(inside, np.cumsum(sizes) - sizes, sizes).nearest()
    order = np.argsort(near, kind="stable")
    steps = near[order][1:] - near[order][:-1]
    at = int(np.argmax(steps))
    low, high = order[: at + 1], order[at + 1 :]
    cohort = float(np.median(near[high]))
    drop = []
    if steps[at] >= drop_gap and (cohort <= 0 or near[low].max() <= ratio * cohort):
        share = lambda g: sum((support or {}).get(labels[i], 0.0) for i in groups[g])
        drop = [g for g in low if support is None or share(g) <= most]
    return merged, [labels[i] for g in drop for i in groups[g]] if len(drop) < k else []


def decide_all_meetings(c: DataFrame, **limits) -> DataFrame:
    """(meeting, cluster, group, drop) for clusters (meeting, cluster, v, support): one meeting at a time, its cosines in blocks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cluster")
        labels, v = pdf["cluster"].tolist(), np.stack(pdf["v"].to_numpy())
        merged, drop = decide(labels, Cosines(v), dict(zip(labels, pdf["support"])) if pdf["support"].notna().all() else None, **limits)
        to, drop = {x: y for g in merged for y in [min(g)] for x in g}, set(drop)
        return pd.DataFrame({"meeting": pdf["meeting"], "cluster": labels, "group": [to.get(x, x) for x in labels], "drop": [x in drop for x in labels]})

    return c.groupBy("meeting").applyInPandas(run, "meeting int, cluster long, group long, drop boolean")


def _supported(spark, sf_dir):
    return clusters(spark, sf_dir).withColumn("support", F.lit(0.01))


_SOFT = {"floor": 0.2, "thin": 0.2, "gap": 0.0, "profile": 0.9, "drop_gap": 0.0, "ratio": 2.0}


@query("decide_all")
def decide_all(spark, sf_dir):
    return decide_all_meetings(_supported(spark, sf_dir), **_SOFT)


@query("decide_merges")
def decide_merges(spark, sf_dir):
    return decide_all_meetings(_supported(spark, sf_dir), **_SOFT).where("group <> cluster").select("meeting", "cluster", "group")


@query("decide_drops", f"""WITH {_C}, {_P}, {_N}, {_GAP.format('n')}, k AS (SELECT n.meeting, max(n.cos) FILTER (n.cos <= below) AS low, median(n.cos) FILTER (n.cos > below) AS cohort, any_value(gap) AS gap FROM n JOIN g USING (meeting) GROUP BY n.meeting)
    SELECT n.meeting, n.cluster FROM n JOIN g USING (meeting) JOIN k USING (meeting) WHERE n.cos <= below AND low <= 0.9 * cohort AND g.gap >= 0.01""")
def decide_drops(spark, sf_dir):
    """Clusters below the widest gap of cohesion, if they are far enough below the rest's median."""
    plain, odd = by_form(clusters(spark, sf_dir))
    n = nearest_in_meeting(plain).union(max_neighbor(pairwise(odd)))
    return drops_below(n)


def nearest_in_meeting(c: DataFrame) -> DataFrame:
    """max_neighbor() of all pairs of a meeting, in matrix products: each pair's cosine is made once, for both of its clusters."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"meeting": pdf["meeting"], "cluster": pdf["cluster"], "cos": Cosines(np.stack(pdf["v"].to_numpy())).nearest()})

    return c.where("n > 1").groupBy("meeting").applyInPandas(run, "meeting int, cluster long, cos double")


def drops_below(n: DataFrame) -> DataFrame:
    """(meeting, cluster) of cohesions (meeting, cluster, cos) below each meeting's widest gap; cohesions of a meeting are one
    number a cluster and come from one pass over its pairs."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cos = np.sort(pdf["cos"].dropna().to_numpy())[::-1]
        steps = cos[:-1] - cos[1:]
        at = int(np.argmax(steps)) if len(steps) else 0
        low, high = cos[at + 1 :], cos[: at + 1]
        high = high[high > low[0]] if len(low) else high
        drop = len(low) and len(high) and steps[at] >= 0.01 and low[0] <= 0.9 * np.median(high)
        return pdf.loc[pdf["cos"] <= low[0], ["meeting", "cluster"]] if drop else pdf.loc[[], ["meeting", "cluster"]]

    return n.groupBy("meeting").applyInPandas(run, "meeting int, cluster long")


@query("apply_decision")
def apply_decision(spark, sf_dir):
    """Vectors after merging groups: unit means of what is not dropped."""
    c = _supported(spark, sf_dir)
    d = decide_all_meetings(c, **_SOFT)
    x = c.join(d, ["meeting", "cluster"]).where("NOT drop").select("meeting", "group", F.posexplode("v").alias("i", "x"))
    mean = x.groupBy("meeting", "group", "i").agg(F.avg("x").alias("x"))
    v = mean.groupBy("meeting", "group").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return v.select("meeting", "group", F.transform("v", lambda s: F.round(s.x / F.col("norm"), 6)).alias("v"))


def graph(edges: DataFrame) -> DataFrame:
    """(meeting, cluster, root): least cluster reachable inside a meeting; a meeting's links are few and handled together."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        root: dict = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in zip(pdf["a"], pdf["b"]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        return pd.DataFrame([(pdf["meeting"].iloc[0], x, find(x)) for x in sorted(root)], columns=["meeting", "cluster", "root"])

    return edges.groupBy("meeting").applyInPandas(run, "meeting int, cluster long, root long")


@query("graph_components", f"""WITH RECURSIVE {_C}, {_P}, e AS (SELECT meeting, a, b FROM p WHERE cos >= 0.3 UNION SELECT meeting, b, a FROM p WHERE cos >= 0.3),
    r(meeting, cluster, reach) AS (SELECT DISTINCT meeting, a, a FROM e UNION SELECT r.meeting, r.cluster, e.b FROM r JOIN e ON r.meeting = e.meeting AND r.reach = e.a) SELECT meeting, cluster, min(reach) AS root FROM r GROUP BY meeting, cluster""")
def graph_components(spark, sf_dir):
    return graph(pairwise(clusters(spark, sf_dir)).where("cos >= 0.3").select("meeting", "a", "b"))


@query("fixed_merge", f"""WITH RECURSIVE {_C}, {_P}, e AS (SELECT meeting, a, b FROM p WHERE cos >= 0.35 UNION SELECT meeting, b, a FROM p WHERE cos >= 0.35),
    r(meeting, cluster, reach) AS (SELECT DISTINCT meeting, a, a FROM e UNION SELECT r.meeting, r.cluster, e.b FROM r JOIN e ON r.meeting = e.meeting AND r.reach = e.a) SELECT meeting, cluster, min(reach) AS root FROM r GROUP BY meeting, cluster""")
def fixed_merge(spark, sf_dir):
    return graph(pairwise(clusters(spark, sf_dir)).where("cos >= 0.35").select("meeting", "a", "b"))


@query("fixed_drop", f"WITH {_C}, {_P}, {_N} SELECT meeting, cluster FROM n WHERE cos < 0.15 AND 0.02 < 0.30 OR cos < 0.25 AND 0.02 < 0.10")
def fixed_drop(spark, sf_dir):
    return max_neighbor(pairwise(clusters(spark, sf_dir))).withColumn("support", F.lit(0.02)).where("cos < 0.15 AND support < 0.30 OR cos < 0.25 AND support < 0.10").select("meeting", "cluster")


@query("agg_group_cosine", f"WITH {_C}, q AS (SELECT x.meeting, x.cluster % 4 AS ga, y.cluster % 4 AS gb, list_dot_product(x.v, y.v) AS cos FROM c x JOIN c y ON x.meeting = y.meeting AND x.cluster % 4 < y.cluster % 4) SELECT meeting, ga, gb, round(avg(cos), 5) AS cos FROM q GROUP BY ALL")
def agg_group_cosine(spark, sf_dir):
    """Mean cosine across two groups: by linearity the product of the groups' mean vectors, so no pairs are made."""
    x = clusters(spark, sf_dir).select("meeting", (F.col("cluster") % 4).alias("g"), F.posexplode("v").alias("i", "x")).groupBy("meeting", "g", "i").agg(F.avg("x").alias("x"))
    a, b = x.select("meeting", F.col("g").alias("ga"), "i", F.col("x").alias("a")), x.select("meeting", F.col("g").alias("gb"), "i", F.col("x").alias("b"))
    return a.join(b, ["meeting", "i"]).where("ga < gb").groupBy("meeting", "ga", "gb").agg(rounded(F.sum(F.col("a") * F.col("b")), 5).alias("cos"))


@query("agg_cluster_mean", "WITH x AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings) GROUP BY label, i), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM x GROUP BY label) SELECT label, i, round(x / n, 5) AS x FROM x JOIN n USING (label)")
def agg_cluster_mean(spark, sf_dir):
    x = inputs.load(spark, sf_dir, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x")).groupBy("label", F.col("i").cast("long").alias("i")).agg(F.avg("x").alias("x"))
    return x.withColumn("n", F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy("label")))).select("label", "i", rounded(F.col("x") / F.col("n"), 5).alias("x"))


def block_products(c: DataFrame, s: DataFrame, pick, schema: str, block: int = 2048) -> DataFrame:
    """pick(clusters, samples, cosines) over every block of clusters and every block of samples: matrix products of bounded
    size, so neither side is broadcast."""
    n, k = -(-c.count() // block) or 1, -(-s.count() // block) or 1
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    x = c.select("meeting", "cluster", "v", F.pmod(F.xxhash64("cluster"), F.lit(n)).cast("int").alias("i"), every(k).alias("j"))
    y = s.select("sample", "name", "v", F.pmod(F.xxhash64("sample"), F.lit(k)).cast("int").alias("j"), every(n).alias("i"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({f.split()[0]: [] for f in schema.split(", ")})
        b = b.sort_values(["name", "sample"], kind="stable")
        return pick(a, b, np.stack(a["v"].to_numpy()) @ np.stack(b["v"].to_numpy()).T)

    return x.groupBy("i", "j").cogroup(y.groupBy("i", "j")).applyInPandas(run, schema)


def asked(spark, sf_dir) -> DataFrame:
    """The stated query set of the searches: clusters whose id is divisible by 100. They meet all samples."""
    return clusters(spark, sf_dir).where("cluster % 100 = 0")


def nearest(c: DataFrame, s: DataFrame, most: int | None = None, block: int = 2048) -> DataFrame:
    """(cluster, name, sample, cos): all samples of each cluster, or the `most` nearest (the least sample first among equals)."""
    def pick(a: pd.DataFrame, b: pd.DataFrame, cos) -> pd.DataFrame:
        sample = b["sample"].to_numpy()
        at = np.tile(np.arange(len(b)), (len(a), 1)) if most is None else np.lexsort((np.tile(sample, (len(a), 1)), -cos), axis=1)[:, :most]
        names = b["name"].to_numpy()
        return pd.DataFrame({"cluster": np.repeat(a["cluster"].to_numpy(), at.shape[1]), "name": names[at.ravel()], "sample": sample[at.ravel()], "cos": np.take_along_axis(cos, at, 1).ravel()})

    found = block_products(c, s, pick, "cluster long, name string, sample long, cos double", block)
    if most is None:
        return found
    return found.withColumn("r", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("cos"), "sample"))).where(F.col("r") <= most).drop("r")


def best_per_name(c: DataFrame, s: DataFrame, block: int = 2048) -> DataFrame:
    """(meeting, cluster, name, score): each cluster's greatest cosine to a name's samples."""
    def pick(a: pd.DataFrame, b: pd.DataFrame, cos) -> pd.DataFrame:
        names, first = np.unique(b["name"].to_numpy().astype(str), return_index=True)
        top = np.maximum.reduceat(cos, first, axis=1)
        return pd.DataFrame({"meeting": np.repeat(a["meeting"].to_numpy(), len(names)), "cluster": np.repeat(a["cluster"].to_numpy(), len(names)), "name": np.tile(names, len(a)), "score": top.ravel()})

    found = block_products(c, s, pick, "meeting int, cluster long, name string, score double", block)
    return found.groupBy("meeting", "cluster", "name").agg(F.max("score").alias("score"))


_E = f"{_C}, {_SAMPLES}, x AS (SELECT c.meeting, c.cluster, e.name, e.sample, list_dot_product(c.v, e.v) AS cos FROM c, e WHERE c.cluster % 100 = 0)"


@query("join_enrolled", f"WITH {_E}, b AS (SELECT cluster, name, round(max(cos), 4) AS score FROM x GROUP BY cluster, name) SELECT cluster, name, score FROM b QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY score DESC, name) = 1 AND score >= 0.15")
def join_enrolled(spark, sf_dir):
    b = best_per_name(asked(spark, sf_dir), samples(spark, sf_dir)).withColumn("score", F.round("score", 4))
    best = b.groupBy("cluster").agg(F.min(F.struct(-F.col("score"), "name")).alias("x"))
    return best.select("cluster", "x.name", (-F.col("x.col1")).alias("score")).where("score >= 0.15")


@query("join_enrolled_report", f"WITH {_E} SELECT cluster, sample, name, round(cos, 4) AS cos FROM x")
def join_enrolled_report(spark, sf_dir):
    return nearest(asked(spark, sf_dir), samples(spark, sf_dir)).select("cluster", "sample", "name", rounded("cos", 4).alias("cos"))


@query("agg_best_per_name", f"WITH {_E} SELECT cluster, name, round(max(cos), 4) AS score FROM x GROUP BY cluster, name")
def agg_best_per_name(spark, sf_dir):
    return best_per_name(asked(spark, sf_dir), samples(spark, sf_dir)).select("cluster", "name", rounded("score", 4).alias("score"))


@query("topk_similar", f"WITH {_E}, k AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY cos DESC, sample) <= 20), b AS (SELECT cluster, name, max(cos) AS cos FROM k GROUP BY ALL) SELECT cluster, name, round(cos, 4) AS score, round(greatest(cos, 0) * 100, 1) AS score_pct, cos >= 0.2 AS passed FROM b")
def topk_similar(spark, sf_dir):
    """The 20 nearest samples of each cluster, then the best of each name; the pass mark sees the unrounded score."""
    x = nearest(asked(spark, sf_dir), samples(spark, sf_dir), 20)
    return x.groupBy("cluster", "name").agg(F.max("cos").alias("cos")).select("cluster", "name", rounded("cos", 4).alias("score"), F.round(F.greatest("cos", F.lit(0.0)) * 100, 1).alias("score_pct"), (F.col("cos") >= 0.2).alias("passed"))


@query("join_greedy_one_to_one")
def join_greedy_one_to_one(spark, sf_dir):
    """Best first, each cluster and each name once, inside a meeting."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        done, out = set(), []
        for r in pdf.sort_values(["score", "cluster", "name"], ascending=[False, True, True]).itertuples():
            if r.score >= 0.1 and ("c", r.cluster) not in done and ("n", r.name) not in done:
                done |= {("c", r.cluster), ("n", r.name)}
                out.append((r.meeting, r.cluster, r.name, r.score))
        return pd.DataFrame(out, columns=["meeting", "cluster", "name", "score"])

    b = best_per_name(clusters(spark, sf_dir), samples(spark, sf_dir)).withColumn("score", F.round("score", 4))
    return b.groupBy("meeting").applyInPandas(run, "meeting int, cluster long, name string, score double")


@query("agg_speakers", f"WITH {_SAMPLES} SELECT name, min(sample) AS first_id, count(*) AS n FROM e GROUP BY name")
def agg_speakers(spark, sf_dir):
    return samples(spark, sf_dir).groupBy("name").agg(F.min("sample").alias("first_id"), F.count("*").alias("n"))


@query("win_sample_index", f"WITH {_SAMPLES} SELECT sample, name, row_number() OVER (PARTITION BY name ORDER BY sample) AS sample_index FROM e")
def win_sample_index(spark, sf_dir):
    return samples(spark, sf_dir).select("sample", "name", F.row_number().over(W.partitionBy("name").orderBy("sample")).alias("sample_index"))


@query("sort_samples", f"WITH {_SAMPLES} SELECT name, list(sample ORDER BY sample) AS samples FROM e GROUP BY name")
def sort_samples(spark, sf_dir):
    return samples(spark, sf_dir).groupBy("name").agg(F.array_sort(F.collect_list("sample")).alias("samples"))


@query("db_enroll", f"WITH {_SAMPLES}, n AS (SELECT sample, name, CASE WHEN sample < 100 THEN 0 ELSE 1 END AS fresh FROM e) SELECT sample, name, count(*) OVER (PARTITION BY name ORDER BY fresh, sample) AS sample_index FROM n")
def db_enroll(spark, sf_dir):
    """New samples are appended with the next index of their name."""
    s = samples(spark, sf_dir).select("sample", "name")
    old = s.where("sample < 100").withColumn("sample_index", F.row_number().over(W.partitionBy("name").orderBy("sample")))
    have = old.groupBy("name").agg(F.max("sample_index").alias("have"))
    new = s.where("sample >= 100").join(have, "name", "left").select("sample", "name", (F.row_number().over(W.partitionBy("name").orderBy("sample")) + F.coalesce("have", F.lit(0))).alias("sample_index"))
    return old.unionByName(new)


@query("db_delete_name", f"WITH {_SAMPLES} SELECT sample, name FROM e WHERE name NOT IN ('name1', 'name3')")
def db_delete_name(spark, sf_dir):
    gone = spark.createDataFrame([("name1",), ("name3",)], "name string")
    return samples(spark, sf_dir).select("sample", "name").join(gone, "name", "left_anti").select("sample", "name")


@query("db_delete_id", f"WITH {_SAMPLES} SELECT sample, name FROM e WHERE sample % 20 <> 3")
def db_delete_id(spark, sf_dir):
    s = samples(spark, sf_dir).select("sample", "name")
    return s.join(s.where("sample % 20 = 3").select("sample"), "sample", "left_anti")


@query("db_reset", "SELECT count(*) AS deleted FROM embeddings")
def db_reset(spark, sf_dir):
    return samples(spark, sf_dir).agg(F.count("*").alias("deleted"))


@query("agg_quality", f"WITH {_SAMPLES} SELECT y.sample, round(coalesce(avg(list_dot_product(x.v, y.v)), 0), 4) + 0 AS quality FROM e y LEFT JOIN e x ON x.name = y.name AND x.sample < y.sample GROUP BY y.sample")
def agg_quality(spark, sf_dir):
    """Mean cosine to the samples of a name that came before: the product with their mean vector, by a running window."""
    order = W.partitionBy("name", "i").orderBy("sample").rowsBetween(W.unboundedPreceding, -1)
    x = samples(spark, sf_dir).select("sample", "name", F.posexplode("v").alias("i", "x")).withColumn("before", F.avg("x").over(order))
    return x.groupBy("sample").agg((F.round(F.coalesce(F.sum(F.col("x") * F.col("before")), F.lit(0.0)), 4) + F.lit(0.0)).alias("quality"))


@query("agg_consistency", f"WITH {_SAMPLES}, l AS (SELECT name, max(sample) AS last FROM e GROUP BY name), x AS (SELECT name, i, avg(x) FILTER (sample < last) AS m, sum(x) FILTER (sample = last) AS t FROM (SELECT name, sample, last, unnest(v) AS x, unnest(range(64)) AS i FROM e JOIN l USING (name)) GROUP BY name, i) SELECT name, round(least(greatest(sum(m * t) / sqrt(sum(m * m)), 0), 1), 4) AS score FROM x GROUP BY name")
def agg_consistency(spark, sf_dir):
    """The last sample of a name against the unit mean of the earlier ones."""
    x = samples(spark, sf_dir).withColumn("last", F.max("sample").over(W.partitionBy("name"))).select("name", "sample", "last", F.posexplode("v").alias("i", "x"))
    d = x.groupBy("name", "i").agg(F.avg(F.when(F.col("sample") < F.col("last"), F.col("x"))).alias("m"), F.sum(F.when(F.col("sample") == F.col("last"), F.col("x"))).alias("t"))
    return d.groupBy("name").agg(F.round(F.least(F.greatest(F.sum(F.col("m") * F.col("t")) / F.sqrt(F.sum(F.col("m") * F.col("m"))), F.lit(0.0)), F.lit(1.0)), 4).alias("score"))
