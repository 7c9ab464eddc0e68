"""SimHash near-duplicates: 64-bit fingerprints, linked at few differing bits through a vantage-point tree.

Fingerprints: texts lose A-Z capitals, words are `[^\\x20\\x09-\\x0D]+`, features are the space-joined word shingles with
repeats, hashed by XXH64. Equal fingerprints form one class, and only classes are compared.

Search: a tree of vantage points is fitted on a bounded sample of class fingerprints (SAMPLE). Each inner node has a vantage
point and a radius; a fingerprint lives in one leaf and is sent as a query to every leaf whose region it may reach by the
triangle bound, so no pair within the limit is lost whatever the sample was. Leaves are split into blocks of about BLOCK
fingerprints, and inside a block the distance to the zero fingerprint (the number of one bits) prunes once more. A block
returns a spanning forest of its links, and distributed connected components join the blocks.

Defined cases: null text is empty; no words give fingerprint zero, which links like any other; fewer words than the shingle
give one shingle of all words; repeated rows stay as rows; a null doc_id keeps its row but is no component's name while
another member has an id; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.buckets import bucket_links
from voxloom.llm.common import Members, cut, drop_shuffles, give_back, table
from voxloom.llm.components import connected_components, forest

#: Fingerprints on which the tree is fitted, at most; fingerprints in a block, about.
SAMPLE, BLOCK = 8192, 4096
#: Bits of the fingerprints by which keep_one() finds candidates; texts and bytes of shingles in a block that it verifies.
WIDE, TEXTS, BYTES = 512, 512, 8 << 20
#: Hash tables that keep_one() shuffles at once: disk holds the rows of so many, however many tables there are.
ROUND = 12
#: Greatest chance that a bit of two sets with a Jaccard similarity of 0.8 or more differs: sets of 4 and 5 shingles; large sets
#: of one size have 0.152.
APART = 3 / 16
_ODD = (np.random.default_rng(31).integers(0, 2**63, WIDE // 64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def fingerprint(text: str | None, k: int = 3) -> int:
    """Fingerprint as an unsigned 64-bit integer."""
    return int(_signs(_shingle_hashes(text or "", k)).view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, fp long) for each row."""

    def run(parts):
        for part in parts:
            fps = np.fromiter((fingerprint(x.as_py(), k) for x in part.column(1)), np.uint64, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def vantage_tree(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and radii of the inner nodes in heap order; a radius of 64 sends everything left."""
    n = 2**depth
    points, radii = np.zeros(n, np.uint64), np.full(n, 64, np.int64)

    def grow(node: int, own: np.ndarray) -> None:
        if node >= n:
            return
        best = None
        for v in own[:: max(1, len(own) // 8)][:8]:
            d = np.bitwise_count(own ^ v).astype(np.int64)
            spread = float(d.std())
            if best is None or spread > best[0]:
                best = spread, v, int(np.median(d)), d
        if best is None or best[0] == 0:
            return
        points[node], radii[node] = best[1], best[2]
        grow(2 * node, own[best[3] <= best[2]])
        grow(2 * node + 1, own[best[3] > best[2]])

    grow(1, np.unique(sample.astype(np.uint64)))
    return points, radii


def route(fps: np.ndarray, points: np.ndarray, radii: np.ndarray, reach: int):
    """(leaf, rows that may have a match there, which of them live there) for each leaf that any row reaches."""
    todo, n = [(1, np.arange(len(fps)), np.ones(len(fps), bool))], len(points)
    while todo:
        node, rows, home = todo.pop()
        if not len(rows):
            continue
        if node >= n:
            yield node, rows, home
            continue
        d, r = np.bitwise_count(fps[rows] ^ points[node]).astype(np.int64), radii[node]
        left, right = d - reach <= r, d + reach > r
        if r >= 64:
            right[:] = False
        todo.append((2 * node, rows[left], home[left] & (d[left] <= r)))
        todo.append((2 * node + 1, rows[right], home[right] & (d[right] > r)))


def block_links(fps: np.ndarray, home: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (query, member) of one block within `reach` bits, each unordered pair of fingerprints once."""
    weight = np.bitwise_count(fps).astype(np.int64)
    members, queries = np.flatnonzero(home), np.arange(len(fps))
    members, queries = members[np.argsort(weight[members], kind="stable")], queries[np.argsort(weight, kind="stable")]
    wm, a, b = weight[members], [], []
    for i in range(0, len(queries), 512):
        q = queries[i : i + 512]
        lo, hi = np.searchsorted(wm, weight[q[0]] - reach), np.searchsorted(wm, weight[q[-1]] + reach, "right")
        for j in range(lo, hi, 2048):
            m = members[j : min(hi, j + 2048)]
            x, y = np.nonzero(np.bitwise_count(fps[q][:, None] ^ fps[m][None, :]) <= reach)
            keep = fps[q[x]] < fps[m[y]]
            a.append(q[x[keep]])
            b.append(m[y[keep]])
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *a]), np.concatenate([empty, *b])


def links(spark: SparkSession, classes: DataFrame, reach: int = 2, block: int = BLOCK) -> DataFrame:
    """(a, b): representatives of classes (fp, rep) that are linked, as a forest with the same components."""
    n = classes.count()
    sample = np.array([r.fp for r in classes.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    depth = max(0, math.ceil(math.log2(max(1, n) / block)))
    points, radii = vantage_tree(sample, min(depth, 20))

    def send(parts):
        for part in parts:
            fps, rep = part.column(0).to_numpy().view(np.uint64), part.column(1).to_numpy()
            for i in range(0, len(fps), 16384):
                for leaf, rows, home in route(fps[i : i + 16384], points, radii, reach):
                    rows = rows + i
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), leaf, np.int64)), pa.array(fps[rows].view(np.int64)), pa.array(rep[rows]), pa.array(home)], names=["leaf", "fp", "rep", "home"])

    def match(group: pa.Table) -> pa.Table:
        fps, rep = group.column("fp").to_numpy().view(np.uint64), group.column("rep").to_numpy()
        home = group.column("home").to_numpy()
        a, b = block_links(fps, home, reach)
        used, at = np.unique(np.concatenate((rep[a], rep[b])), return_inverse=True)
        root = forest(at[: len(a)], at[len(a) :], len(used))
        own = np.flatnonzero(root != np.arange(len(used)))
        return pa.table({"a": used[own], "b": used[root[own]]})

    sent = cut(spark, classes.where("rep is not null").select("fp", "rep").mapInArrow(send, "leaf long, fp long, rep long, home boolean"))
    sizes = sent.where("home").groupBy("leaf").agg(F.ceil(F.count("*") / F.lit(2 * block)).alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    blocks = sent.join(sizes, "leaf").select("leaf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "fp", "rep", (F.col("home") & (F.col("block") == own)).alias("home"))
    return blocks.groupBy("leaf", "block").applyInArrow(match, "a long, b long")


def near_duplicates(spark: SparkSession, docs: DataFrame, k: int = 3, reach: int = 2, block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs (doc_id, text)."""
    prints = cut(spark, fingerprints(docs, k))
    classes = cut(spark, prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    # fingerprints are the nodes, so that a class without an id still links; a component is named by its least id afterwards
    named = connected_components(spark, links(spark, classes.select("fp", F.col("fp").alias("rep")), reach, block))
    classes = cut(spark, classes.join(named, F.col("fp") == F.col("id"), "left").select(F.col("fp").alias("_fp"), "rep", F.coalesce("component", "fp").alias("to")))
    least = classes.groupBy("to").agg(F.min("rep").alias("component_id"))
    classes = classes.join(least, "to").select("_fp", "component_id")
    return prints.join(classes, F.col("fp") == F.col("_fp")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _shingle_hashes(text: str, k: int) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    norm, n = b" ".join(words), max(1, len(words) - k + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = (np.concatenate(([0], ends[:-1] + 1)))[:n].tolist()
    stops = (ends[k - 1 :] if len(words) >= k else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(norm[a:b], 42) for a, b in zip(starts, stops)], dtype="<u8")


def _signs(h: np.ndarray) -> np.ndarray:
    """For each of 64 bits whether it is set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 255 * 256):  # sums of 255 bits fit a byte
        bits = np.unpackbits(h[i : i + 255 * 256].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bits = np.concatenate((bits, np.zeros((-len(bits) % 255, 64), np.uint8))).reshape(-1, 255, 64)
        ones += bits.sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little")


def wide_signs(h: np.ndarray) -> np.ndarray:
    """SimHash of WIDE bits, as bytes, over a set of shingle hashes: each 64 bits from a remixed hash."""
    out = []
    for odd in _ODD:
        x = h * odd
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x9E3779B97F4A7C15)
        out.append(_signs(x ^ (x >> np.uint64(32))))
    return np.concatenate(out)


def wide_limit(apart: float, bits: int) -> int:
    """Differing bits that a pair whose bits differ with chance `apart` exceeds with chance 0.001: the mean and 3 s.d."""
    return int(bits * apart + 3 * math.sqrt(bits * apart * (1 - apart)))


def similar_forest(flat: np.ndarray, sizes: np.ndarray, side: np.ndarray, similarity: float) -> np.ndarray:
    """Root of each of the sets whose members lie one after another in `flat`, linked at a Jaccard similarity of `similarity`
    or more: all pairs of one side, or with two sides the pairs across them. Two empty sets are alike."""
    n, ends = len(sizes), np.cumsum(sizes)
    starts, ids, root = ends - sizes, np.unique(flat, return_inverse=True)[1], np.arange(n)
    crossed, mark = (side != side[0]).any(), np.zeros(len(flat), bool)
    for i in range(n - 1):
        there = (root[i + 1 :] != root[i]) & (np.minimum(sizes[i + 1 :], sizes[i]) >= similarity * np.maximum(sizes[i + 1 :], sizes[i]))
        at = np.flatnonzero(there & (side[i + 1 :] != side[i]) if crossed else there) + i + 1
        if not len(at):
            continue
        mark[ids[starts[i] : ends[i]]] = True
        total = np.concatenate(([0], np.cumsum(mark[ids])))
        mark[ids[starts[i] : ends[i]]] = False
        both = total[ends[at]] - total[starts[at]]
        near = np.append(root[at[both >= similarity * (sizes[i] + sizes[at] - both)]], root[i])
        root[np.isin(root, near)] = near.min()
    return root


def _whole_groups(parts, keys: list[str]):
    """(table, first rows of its groups): the rows of Arrow batches sorted by `keys`, no group divided."""
    held = None
    for part in parts:
        piece = pa.Table.from_batches([part])
        held = piece if held is None else pa.concat_tables([held, piece]).combine_chunks()
        own = [held.column(k).to_numpy() for k in keys]
        first = np.flatnonzero(np.concatenate(([True], np.any([k[1:] != k[:-1] for k in own], axis=0)))) if held.num_rows else []
        if len(first) > 1:  # the last group may go on
            yield held.slice(0, first[-1]), first[:-1]
            held = held.slice(first[-1])
    if held is not None and held.num_rows:
        yield held, np.zeros(1, np.int64)


def verified_links(spark: SparkSession, rows: DataFrame, classes: DataFrame, groups: DataFrame, k: int, similarity: float, again: bool, texts: int = TEXTS, size: int = BYTES) -> DataFrame:
    """(a, b): texts, named by c, whose sets of k-word shingles have the Jaccard similarity or more, as a forest of all such
    links inside the given groups of candidates.

    rows: doc_id, c, c2, text; classes: c, c2, rep, w (shingles); groups: id, component. All pairs of a group are compared: a large
    group is split into blocks, and each pair of blocks is a task's group. Only shingles of texts with a candidate are shuffled.
    """
    own = classes.join(groups, F.col("c") == F.col("id")).select("c", "c2", "rep", "w", "component")
    sizes = own.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / F.lit(texts)), F.ceil(8 * F.sum("w") / F.lit(size)), F.lit(1)).cast("int").alias("blocks"))
    own = cut(spark, own.join(sizes, "component").select(F.col("c").alias("_c"), F.col("c2").alias("_c2"), "rep", "component", "blocks"))
    held = Members(spark, own.select(F.xxhash64("_c", "_c2", "rep")))

    def shingled(parts):
        for part in parts:
            part = part.filter(pa.array(held(part.column(3).to_numpy())))
            sets = [np.unique(_shingle_hashes(x.as_py(), k)).tobytes() for x in part.column(4)]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(sets, pa.binary())], names=["doc_id", "c", "c2", "h"])
        held.release()
        give_back()

    def compare(parts):
        for held, first in _whole_groups(parts, ["component", "i", "j"]):
            c, side, sets = held.column("c").to_numpy(), held.column("own").to_numpy(), held.column("h").to_pylist()
            out = []
            for a, b in zip(first.tolist(), [*first[1:].tolist(), held.num_rows]):
                flat, count = np.frombuffer(b"".join(sets[a:b]), np.uint64), np.array([len(x) // 8 for x in sets[a:b]])
                root = similar_forest(flat, count, side[a:b], similarity)
                at = np.flatnonzero(root != np.arange(b - a))
                out.append((c[a + at], c[a + root[at]]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["a", "b"])
        give_back()

    sets = rows.select("doc_id", "c", "c2", F.xxhash64("c", "c2", "doc_id").alias("at"), "text").mapInArrow(shingled, "doc_id long, c long, c2 long, h binary")
    sets = sets.join(own, (F.col("c") == F.col("_c")) & (F.col("c2") == F.col("_c2")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    if again:
        sets = sets.dropDuplicates(["c", "c2"])
    met = sets.withColumn("own", F.pmod(F.xxhash64("c2", "c"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "c", "h")
    return met.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(compare, "a long, b long")


def tree_links(spark: SparkSession, classes: DataFrame, reach: int) -> DataFrame:
    """(c, r): texts whose first 64 fingerprint bits (of v) differ in `reach` bits at most, as a forest, found through the tree."""
    word = F.conv(F.hex(F.substring("v", 1, 8)), 16, -10).cast("long")  # in any order of bytes: distances stay
    own = cut(spark, classes.select("c", word.alias("fp")))
    prints = cut(spark, own.groupBy("fp").agg(F.min("c").alias("rep")))
    equal = own.join(prints, "fp").where("c != rep").select("c", F.col("rep").alias("r"))
    return cut(spark, links(spark, prints, reach).toDF("c", "r").union(equal))


def keep_one(spark: SparkSession, docs: DataFrame, k: int = 5, similarity: float = 0.8, missed: float = 0.01, reach: int = 2) -> DataFrame:
    """docs without near-duplicates: of each group the row with the smallest doc_id stays, with all its columns.

    Texts are linked whose sets of k-word shingles have the given Jaccard similarity or more, by the sets themselves.
    Fingerprints only find the candidates, in two ways. The first 64 bits are linked through the vantage-point tree at `reach`
    bits, which loses no such pair. Pairs at the limit are about 10 of 64 bits apart, where distances to vantage points no longer
    tell leaves apart, so the rest meet in tables of sampled bits of WIDE-bit fingerprints: up to wide_limit() bits apart, which
    is 3 s.d. more than a pair at the limit is expected to be (APART is for 0.8; a lower similarity gets the angle between its
    sets); a pair at the limit shares no bucket with chance `missed` at most. ROUND tables are shuffled at once and their files
    given back before the next. Groups of candidates are then compared in full.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    c, c2 = F.xxhash64(text), F.xxhash64(F.lit(1), text)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), c.alias("c"), c2.alias("c2"))

    def run(parts):
        for part in parts:
            sets = [np.unique(_shingle_hashes(x.as_py(), k)) for x in part.column(3)]
            wide = [wide_signs(h).tobytes() for h in sets]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([len(h) for h in sets], pa.int64()), pa.array(wide, pa.binary())], names=["doc_id", "c", "c2", "w", "v"])
        give_back()

    prints = rows.select("doc_id", "c", "c2", "text").mapInArrow(run, "doc_id long, c long, c2 long, w long, v binary")
    prints = cut(spark, prints)
    classes = prints.groupBy("c", "c2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m"), F.any_value("w").alias("w"), F.any_value("v").alias("v"))
    apart = max(APART, math.acos(2 * similarity / (1 + similarity)) / math.pi)
    n, limit = prints.count(), wide_limit(apart, WIDE)
    bits = min(24, max(8, math.ceil(math.log2(max(1, n))) - 7))
    # a sampled bit differs as often as the pair's own share of bits does, which spreads around `apart`
    share = np.random.default_rng(6).binomial(WIDE, apart, 1 << 16) / WIDE
    tables = next(t for t in range(1, 10_000) if np.mean((1 - (1 - share) ** bits) ** t) <= missed)
    picked = np.array([np.random.default_rng([5, t]).permutation(WIDE)[:bits] for t in range(tables)])

    def coded(own):
        def run(parts):
            for part in parts:
                flags = np.unpackbits(np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(-1, WIDE // 8), axis=1, bitorder="little")
                codes = (flags[:, own].astype(np.int32) << np.arange(bits, dtype=np.int32)).sum(axis=2, dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1) * len(own), pa.int32()), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=["c", "c2", "m", "v", "codes"])

        return run

    def members(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, WIDE // 64)

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        apart = np.zeros((len(a), len(b)), np.uint16)
        for w in range(WIDE // 64):
            apart += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
        return apart <= limit

    classes = cut(spark, classes)
    edges = [tree_links(spark, classes, reach)]
    for t in range(0, tables, ROUND):
        own = picked[t : t + ROUND]
        units = classes.select("c", "c2", "m", "v").mapInArrow(coded(own), "c long, c2 long, m long, v binary, codes array<int>")
        found = bucket_links(spark, units, len(own) << bits, members, near, counted=False)
        edges.append(cut(spark, found.where("c != r").select("c", "r").distinct()))  # 64 bits name a text here
        drop_shuffles(spark)
    groups = connected_components(spark, functools.reduce(DataFrame.union, edges))
    again = not prints.groupBy("doc_id", "c", "c2").count().where("count > 1").isEmpty()
    joined = connected_components(spark, verified_links(spark, rows, classes, groups, k, similarity, again))
    named = classes.select("c", "c2", "rep").join(joined, F.col("c") == F.col("id"), "left").withColumn("to", F.coalesce("component", "c"))
    best = named.groupBy("to").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "c", "c2")).alias("x")).select(F.col("x.rep").alias("_vx_rep"), F.col("x.c").alias("_vx_c"), F.col("x.c2").alias("_vx_c2"))
    here = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    kept = docs.join(best, docs["doc_id"].cast("long").eqNullSafe(F.col("_vx_rep")) & (here == F.col("_vx_c")), "inner")
    return (kept.dropDuplicates(["_vx_c", "_vx_c2"]) if again else kept).select(*(docs[f"`{x}`"] for x in docs.columns))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"))
