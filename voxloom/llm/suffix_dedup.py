"""Removal of long repeated byte strings by suffix arrays and longest-previous-factor arrays.

A place (window start) is repeated if the LENGTH bytes from it also start anywhere else in the corpus. To find these places
without one suffix array over the whole corpus:

1. Each place gets an anchor: of all GRAM-byte hashes inside its LENGTH bytes the least, leftmost first. Equal strings have
   the same anchor at the same offset, so only places with one anchor hash need to be compared. Consecutive places with one
   anchor form an excerpt: the bytes from the first place to the end of the last one's string.
2. Equal excerpts of an anchor hash form a class with a count; the first member (by doc_id, text hash, offset) represents it.
   Classes are counted before their bytes move, and the bytes of a class move only if its anchor hash has other classes.
3. Inside an anchor hash the places of all class excerpts are put into suffix order by prefix doubling to depth LENGTH, equal
   ones in text order. Neighbours give the LCP array; previous and next smaller positions in suffix order give each place's
   longest previous factor (LPF), previous and next larger ones its longest next factor (LNF). A place with LPF >= LENGTH is
   a later copy; one with either >= LENGTH is repeated. A member that is not its class's first is a later copy throughout.
4. An anchor hash with more than GROUP classes is too much for one task. Its excerpts are divided by the distance from place to
   anchor, into halves of a range of distances, and the bytes that all strings of a half share take the place of the anchor
   hash. Equal strings share them, so the method goes on as before inside these smaller groups, and divides again while a group
   is too large: at the ninth division (of 400 bytes) the shared bytes are the whole string, so that one class is left.

Members of a class get its result by a join; classes with more members than the HEAVY-th part of all (and HEAVY) are so few that
their results are broadcast, and no task holds the members of one class. No other side of a join that grows with the corpus is
broadcast, also where it happens to be small.

Every byte that a chosen place's LENGTH bytes cover is removed: places of later copies with keep="first", all repeated places
with keep="none".

Defined cases: null text is empty; texts under LENGTH bytes lose nothing; repeats inside one text count; rows with one doc_id
and one text are copies of each other with keep="none" and one document with keep="first"; a null doc_id is an id and comes
first; an empty table gives an empty result; further columns are ignored by `kept_bytes` and kept by `dedup_text`.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from voxloom.llm.common import Members, cut, give_back, slices, stored, table

LENGTH, GRAM = 400, 32
#: Classes of an anchor that one task compares; members of a class, and at most so many classes, whose result is broadcast.
GROUP, HEAVY = 2048, 10_000
#: A passage of more than WORDS words has this many bytes at least.
WORDS, PASSAGE = 50, 101
_CHUNK, _HELD, _POS = 1 << 17, 1 << 18, (1 << 20) - 1
_BYTE = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)
_MULT = (np.random.default_rng(77).integers(0, 2**63, 8, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A mixed hash of the GRAM bytes from each place."""
    h, width, k = _BYTE[data], 1, 0
    while width < GRAM:
        h = h[:-width] * _MULT[k] + h[width:]
        width, k = 2 * width, k + 1
    h ^= h >> np.uint64(32)
    h *= _MULT[6]
    h ^= h >> np.uint64(29)
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    m, have = x, 1
    while 2 * have <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[: len(x) - width + 1], m[width - have :][: len(x) - width + 1]) if have < width else m


def anchors(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH):
    """For the texts data[bounds[i]:bounds[i+1]]: (text, first place in it, number of places, anchor hash, distance from the first
    place to the anchor) of each excerpt.

    data has at most 2**20 bytes, so an anchor's position fits below the hash's upper 44 bits.
    """
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, np.zeros(0, np.uint64), empty
    h = gram_hashes(data)
    key = (h & ~np.uint64(_POS)) | np.arange(len(h), dtype=np.uint64)
    at = (sliding_min(key, length - GRAM + 1) & np.uint64(_POS)).astype(np.int64)
    owner = np.searchsorted(bounds, np.arange(len(at)), "right") - 1
    inside = np.arange(len(at)) + length <= bounds[owner + 1]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    new &= inside
    starts = np.flatnonzero(new)
    ends = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True)) + 1
    return owner[starts], starts - bounds[owner[starts]], ends - starts, h[at[starts]], at[starts] - starts


def _pieces(texts: list[bytes], length: int):
    """(buffer, bounds, text indices, offsets of the pieces in their texts): runs of texts, long ones in overlapping pieces."""
    parts, own, offsets, held = [], [], [], 0
    for i, x in enumerate(texts):
        for a in range(0, max(1, len(x) - length + 1), _CHUNK):
            piece = x[a : a + _CHUNK + length - 1]
            if held + len(piece) > _HELD and parts:
                yield b"".join(parts), np.cumsum([0, *map(len, parts)]), own, offsets
                parts, own, offsets, held = [], [], [], 0
            parts.append(piece), own.append(i), offsets.append(a)
            held += len(piece)
    if parts:
        yield b"".join(parts), np.cumsum([0, *map(len, parts)]), own, offsets


def divided(raw: bytes, length: int, level: int, rows: np.ndarray, cols):
    """(row, first place in raw, places, hash, distance to the anchor) of the halves of excerpts `rows` of cols, which have
    been divided level - 1 times: a half has the hash of the bytes that all strings of its range of distances share."""
    first, n, d = (x[rows] for x in cols)
    most = length - GRAM
    span = max(1, (1 << most.bit_length()) >> level)
    half = d // span
    upper = np.minimum(n, d - half * span + 1)
    two = np.flatnonzero(upper < n)
    row = np.concatenate((rows, rows[two]))
    first, n, d, half = np.concatenate((first, (first + upper)[two])), np.concatenate((upper, (n - upper)[two])), np.concatenate((d, (d - upper)[two])), np.concatenate((half, half[two] - 1))
    a = first + d - half * span
    b = first + d - np.minimum((half + 1) * span - 1, most) + length
    digest, seed = xxhash.xxh3_64_intdigest, (level << 40) + half
    h = np.array([digest(raw[x:y], seed=z) for x, y, z in zip(a.tolist(), b.tolist(), seed.tolist())], np.uint64)
    return row, first, n, h, d


def excerpt_rows(texts: list[bytes], length: int, crowded=(), last: bool = False):
    """(text, place, places, anchor hash, hash of the excerpt) of each excerpt of the texts, as arrays.

    crowded: for each division which groups it divides; last: only what comes from the last division.
    """
    digest = xxhash.xxh3_64_intdigest
    for raw, bounds, own, offsets in _pieces(texts, length):
        doc, lo, n, h, d = anchors(np.frombuffer(raw, np.uint8), bounds, length)
        first, level = bounds[doc] + lo, np.zeros(len(doc), np.int64)
        for k, hot in enumerate(crowded, 1):
            rows = np.flatnonzero((level == k - 1) & hot(h.view(np.int64)))
            at, *new = divided(raw, length, k, rows, (first, n, d))
            stays = np.ones(len(doc), bool)
            stays[rows] = False
            doc, level = np.concatenate((doc[stays], doc[at])), np.concatenate((level[stays], np.full(len(at), k)))
            first, n, h, d = (np.concatenate((x[stays], y)) for x, y in zip((first, n, h, d), new))
        if last and crowded:
            keep = level == len(crowded)
            doc, first, n, h = doc[keep], first[keep], n[keep], h[keep]
        key = np.array([digest(raw[x:y]) for x, y in zip(first.tolist(), (first + n - 1 + length).tolist())], np.uint64)
        yield np.array(own, np.int64)[doc], np.array(offsets, np.int64)[doc] + first - bounds[doc], n, h.view(np.int64), key.view(np.int64)


def _dense(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    keys = keys[order]
    step = np.zeros(len(keys), np.int32)
    np.not_equal(keys[1:], keys[:-1], out=step[1:], casting="unsafe")
    np.cumsum(step, out=step)
    rank = keys.view(np.int64)  # not needed any more
    rank[order] = step
    return rank


class SuffixOrder:
    """Suffixes of `data` that start at `places`, in order of their first `depth` bytes and then of their position.

    The common prefix of neighbours (lcp) is `depth` or, unless exact, 0 for any shorter one.
    """

    def __init__(self, data: np.ndarray, places: np.ndarray, depth: int, exact: bool = False):
        self.depth, self.levels, self.data, n = depth, [], data.astype(np.int32), len(data)
        padded = np.concatenate((data, np.zeros(8, np.uint8)))
        rank = padded[:n].astype(np.int64)
        width = 1
        if depth >= 8:
            words = np.lib.stride_tricks.sliding_window_view(padded, 8)[:n]
            rank, width = _dense(np.ascontiguousarray(words).view(">u8")[:, 0].astype(np.uint64)), 8
        keep = (lambda: self.levels.append((width, rank.astype(np.int32)))) if exact else (lambda: None)
        keep()
        while 2 * width <= depth:
            after = np.full(n, -1, np.int64)
            after[: n - width] = rank[width:]
            rank = _dense((rank << 32) | (after + 1))
            width *= 2
            keep()
        last = rank[places]
        if width < depth:
            last = _dense((last << 32) | (self._at(rank, places + depth - width) + 1))
        order = np.argsort(last * (n + 1) + places)
        self.sa, own = places[order], last[order]
        self.lcp = np.zeros(len(order), np.int64)  # with the one before
        same = np.flatnonzero(own[1:] == own[:-1]) + 1
        self.lcp[same] = depth
        if exact:
            other = np.flatnonzero(own[1:] != own[:-1]) + 1
            self.lcp[other] = self._common(self.sa[other - 1], self.sa[other])

    @staticmethod
    def _at(rank: np.ndarray, i: np.ndarray) -> np.ndarray:
        return np.where(i < len(rank), rank[np.minimum(i, len(rank) - 1)], -1)

    def _common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of common prefixes."""
        l = np.zeros(len(i), np.int64)
        for width, rank in [*reversed(self.levels), *([] if self.levels[0][0] == 1 else [(1, self.data)] * 7)]:
            for _ in range(2 if width == self.levels[-1][0] else 1):
                x = self._at(rank, i + l)
                ok = (x >= 0) & (x == self._at(rank, j + l)) & (l + width <= self.depth)
                l[ok] += width
        return l

    def factors(self, least: int, later: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(place, longest match with an earlier place): LPF. With later=True the longest match with a later one.

        Values under `least` may be too small: such pointers are not followed.
        """
        sign = -1 if later else 1
        best = np.zeros(len(self.sa), np.int64)
        for back in (False, True):  # previous smaller, then next smaller, as previous smaller of the reversed order
            sa = (self.sa[::-1] if back else self.sa) * sign
            l = np.append(0, self.lcp[1:])
            l = np.append(0, l[::-1][:-1]) if back else l
            p = np.arange(-1, len(sa) - 1)
            live = np.flatnonzero((l >= least) & (p >= 0))
            while len(live):
                live = live[sa[p[live]] > sa[live]]
                nl, np_ = np.minimum(l[live], l[p[live]]), p[p[live]]
                l[live], p[live] = nl, np_
                end = (nl < least) | (np_ < 0)
                l[live[np_ < 0]] = 0
                live = live[~end]
            best = np.maximum(best, l[::-1] if back else l)
        return self.sa, best


def _ranges(flags: np.ndarray) -> np.ndarray:
    """[start, end) of each run of true, flat."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edge.astype(np.int32)


def compare(excerpts: list[bytes], counts: list[int], length: int):
    """For class excerpts in order of their first members: flat ranges of places with another copy, and of later copies."""
    data = np.frombuffer(b"".join(excerpts), np.uint8)
    sizes = np.array([len(x) for x in excerpts])
    first, n = np.cumsum(sizes) - sizes, sizes - length + 1
    of = np.repeat(np.arange(len(n)), n)
    places = first[of] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    order = SuffixOrder(data, places, length)
    later, other = np.zeros(len(data), bool), np.zeros(len(data), bool)
    at, lpf = order.factors(length)
    later[at] = lpf >= length
    at, lnf = order.factors(length, later=True)
    other[at] = lnf >= length
    other |= later
    for a, k, c in zip(first.tolist(), n.tolist(), counts):
        yield _ranges(other[a : a + k] if c < 2 else np.ones(k, bool)), _ranges(later[a : a + k])


_LISTS = pa.list_(pa.int32())


def _compare_sorted(length: int, at_once: int = 1 << 19):
    """Rows (h, doc_id, t, lo, key, m, excerpt) sorted by the first four -> (h, key, other, later); whole groups of h at a time.

    A class comes as a row with m and no excerpt; rows with an excerpt that belong to no such row are passed over.
    """

    def run(parts):
        def done(rows):
            known = {r[:5]: r[5] for r in rows if r[6] is None}
            own = list({r[:5]: r for r in rows if r[6] is not None and r[:5] in known}.values())
            found = list(compare([r[6] for r in own], [known[r[:5]] for r in own], length)) if own else []
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in own], pa.int64()), pa.array([r[4] for r in own], pa.int64()), pa.array([x for x, _ in found], _LISTS), pa.array([x for _, x in found], _LISTS)], names=["h", "key", "other", "later"])

        held, size = [], 0
        for part in parts:
            for row in zip(*(part.column(i).to_pylist() for i in range(7))):
                if size >= at_once and row[0] != held[-1][0]:
                    yield done(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[6] or b"")
        if held:
            yield done(held)
        give_back()

    return run


def _merge_places(parts):
    """Rows (doc_id, t, lo, ranges counted from lo) -> (doc_id, t, flat ranges): the rows of a batch with one text as one."""
    for part in parts:
        if not part.num_rows:
            continue
        ids, t, lists = part.column(0), part.column(1).to_numpy(), part.column(3)
        null, size = ids.is_null().to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy() // 2
        d, row, flat = pc.fill_null(ids, 0).to_numpy(), np.repeat(np.arange(part.num_rows), size), lists.flatten().to_numpy().astype(np.int64)
        lo = part.column(2).to_numpy()[row]
        a, b = flat[::2] + lo, flat[1::2] + lo
        order = np.lexsort((a, t[row], d[row], null[row]))
        row, a, b = row[order], a[order], b[order]
        new = np.concatenate(([True], (t[row[1:]] != t[row[:-1]]) | (d[row[1:]] != d[row[:-1]]) | (null[row[1:]] != null[row[:-1]])))
        text = np.cumsum(new) - 1
        reach = np.maximum.accumulate(b + (text << 40)) - (text << 40)
        starts = np.flatnonzero(new | np.concatenate(([True], a[1:] > reach[:-1])))
        ends = reach[np.append(starts[1:], len(a)) - 1]
        offsets = 2 * np.searchsorted(text[starts], np.arange(text[-1] + 2))
        at = pa.array(row[np.flatnonzero(new)])
        own = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.column_stack((a[starts], ends)).ravel().astype(np.int32)))
        yield pa.RecordBatch.from_arrays([ids.take(at), part.column(1).take(at), own], names=["doc_id", "t", "own"])


def _text_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, t, k, text): t and k name the text, and the row's id and text, by 64 bits."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))
    return rows.select("doc_id", "t", F.xxhash64("t", "doc_id").alias("k"), "text")


def _mixed(h, key, t, lo, doc_id):
    """64 bits for an excerpt's class and place, of columns or of arrays."""
    if isinstance(h, np.ndarray):
        return h ^ key ^ t ^ lo ^ doc_id ^ (doc_id << 24)
    return h.bitwiseXOR(key).bitwiseXOR(t).bitwiseXOR(lo).bitwiseXOR(doc_id).bitwiseXOR(F.shiftleft(doc_id, 24))


def _only(members: Members, at: int, inside: bool):
    """Rows whose key (a column) may be among the members, or cannot be."""

    def run(parts):
        for part in parts:
            keep = members(part.column(at).to_numpy())
            yield part.filter(pa.array(keep if inside else ~keep))
        members.release()
        give_back()

    return run


def removed_ranges(spark: SparkSession, docs: DataFrame, length: int = LENGTH, keep: str = "first", group: int = GROUP) -> DataFrame:
    """(_vx_d, _vx_t, _vx_own) for each document that loses bytes: doc_id, xxhash64 of the text, and the places that go as
    lists of flat ranges [start, end)."""
    if keep not in ("first", "none"):
        raise ValueError("keep is 'first' or 'none'")
    text = _text_rows(docs).select("doc_id", "t", "k", "text")

    def scan(crowded, among):
        def run(parts):
            for whole in parts:
                whole = whole if among is None else whole.filter(pa.array(among(whole.column(2).to_numpy())))
                for part in slices(whole, 3):
                    texts = part.column(3).cast(pa.binary()).to_pylist()
                    for own, lo, n, h, key in excerpt_rows(texts, length, crowded, True):
                        at = pa.array(own)
                        yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(lo), pa.array(n.astype(np.int32)), pa.array(h), pa.array(key)], names=["doc_id", "t", "lo", "n", "h", "key"])
            for x in (*crowded, *([] if among is None else [among])):
                x.release()
            give_back()

        return run

    crowded: list[Members] = []
    among, found, classes = None, [], []
    while True:
        # most anchors occur once: a bit table drops nearly all of them before they are shuffled
        own = stored(spark, text.mapInArrow(scan(list(crowded), among), "doc_id long, t long, lo long, n int, h long, key long"), "anchors")
        shared = stored(spark, own.groupBy("h").agg(F.count("*").alias("all")).where("all > 1").select("h"), "shared")
        own = own.mapInArrow(_only(Members(spark, shared), 4, True), own.schema)
        kinds = stored(spark, own.groupBy("h", "key").agg(F.count("*").alias("m"), F.min(F.struct("doc_id", "t", "lo")).alias("first")), "classes")
        many = stored(spark, kinds.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > group).select("h"), "crowded")
        if many.isEmpty():
            found.append(own)
            classes.append(kinds)
            break
        bits = Members(spark, many)
        found.append(own.mapInArrow(_only(bits, 4, False), own.schema))
        classes.append(kinds.mapInArrow(_only(bits, 0, False), kinds.schema))
        among = Members(spark, own.mapInArrow(_only(bits, 4, True), own.schema).select(F.xxhash64("t", "doc_id")).distinct())
        crowded.append(bits)
    found, classes = functools.reduce(DataFrame.union, found), functools.reduce(DataFrame.union, classes)
    classes = stored(spark, classes.withColumn("c", F.count("*").over(W.partitionBy("h"))).where("m > 1 or c > 1"), "classes")

    # the bytes of classes that share their anchor hash with another class: cut out where the text is, no text is shuffled
    reps = classes.where("c > 1").select("h", "first.doc_id", "first.t", "first.lo", "key", "m")
    held, taken = Members(spark, reps.select(F.xxhash64("t", "doc_id"))), Members(spark, reps.select(_mixed(F.col("h"), F.col("key"), F.col("t"), F.col("lo"), F.coalesce("doc_id", F.lit(0)))))

    def take(parts):
        for part in (x for whole in parts for x in slices(whole.filter(pa.array(held(whole.column(2).to_numpy()))), 3)):
            texts = part.column(3).cast(pa.binary()).to_pylist()
            ids, ts = pc.fill_null(part.column(0), 0).to_numpy(), part.column(1).to_numpy()
            for own, lo, n, h, key in excerpt_rows(texts, length, crowded):
                keep = np.flatnonzero(taken(_mixed(h, key, ts[own], lo, ids[own])))
                own, lo, n, h, key = (x[keep] for x in (own, lo, n, h, key))
                cut_out = [texts[i][a : a + k - 1 + length] for i, a, k in zip(own.tolist(), lo.tolist(), n.tolist())]
                at = pa.array(own)
                yield pa.RecordBatch.from_arrays([pa.array(h), part.column(0).take(at), part.column(1).take(at), pa.array(lo), pa.array(key), pa.array(cut_out, pa.binary())], names=["h", "doc_id", "t", "lo", "key", "excerpt"])
        for x in (*crowded, held, taken):
            x.release()
        give_back()

    order = ["h", "doc_id", "t", "lo"]
    rows = text.mapInArrow(take, "h long, doc_id long, t long, lo long, key long, excerpt binary").select(*order, "key", F.lit(None).cast("long").alias("m"), "excerpt")
    rows = rows.union(reps.select(*order, "key", "m", F.lit(None).cast("binary").alias("excerpt")))
    flags = rows.repartition("h").sortWithinPartitions(*order).mapInArrow(_compare_sorted(length), "h long, key long, other array<int>, later array<int>")

    flags = flags.withColumnsRenamed({"h": "_h", "key": "_k"})
    match = (F.col("h") == F.col("_h")) & (F.col("key") == F.col("_k"))
    results = stored(spark, classes.join(flags.hint("merge"), match, "left").select(F.col("h").alias("_h"), F.col("key").alias("_k"), "m", "first", "other", "later"), "results")
    heavy = max(HEAVY, (results.agg(F.sum("m")).first()[0] or 0) // HEAVY)
    few = results.where(F.col("m") > heavy)
    if few.isEmpty():
        members = found.join(results.hint("merge"), match)
    else:
        light = found.join(F.broadcast(few.select("_h", "_k")), match, "left_anti")
        members = light.join(results.where(F.col("m") <= heavy).hint("merge"), match).union(found.join(F.broadcast(few), match))
    whole = F.array(F.lit(0), F.col("n"))
    if keep == "none":
        goes = F.when(F.col("m") > 1, whole).otherwise(F.col("other"))
    else:
        goes = F.when(F.struct("doc_id", "t", "lo").eqNullSafe(F.col("first")), F.col("later")).otherwise(whole)
    own = members.select("doc_id", "t", "lo", goes.alias("ranges")).where("size(ranges) > 0").mapInArrow(_merge_places, "_vx_d long, _vx_t long, own array<int>")
    return own.groupBy("_vx_d", "_vx_t").agg(F.collect_list("own").alias("_vx_own"))


def _covered(own: list | None, size: int, more: int) -> np.ndarray:
    """Which of `size` bytes or places lie in one of the ranges, each longer by `more`."""
    ends = np.zeros(size + 1, np.int32)
    for x in own or ():
        r = np.array(x, np.int64)
        np.add.at(ends, r[::2], 1)
        np.add.at(ends, r[1::2] + more, -1)
    return np.cumsum(ends[:size]) > 0


def runs_of(own: list | None, size: int, length: int) -> list[tuple[int, int]]:
    """Maximal runs [a, b) of the bytes covered by the strings of the given places."""
    edge = _ranges(_covered(own, size, length - 1))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def long_passages(own: list | None, raw: bytes, length: int, words: int, least: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs [a, b) of the bytes of passages with over `words` words, parts of words included, or of `least` bytes.

    A passage is what the strings of consecutive places cover, so short repeats that only touch are not taken for one.
    """
    edge = _ranges(_covered(own, len(raw), 0))
    out: list[tuple[int, int]] = []
    for a, b in zip(edge[::2].tolist(), (edge[1::2] - 1 + length).tolist()):
        if b - a >= least or len(raw[a:b].split()) > words:
            if out and a <= out[-1][1]:
                a = out.pop()[0]
            out.append((a, b))
    return out


def without(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in runs:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def whole_characters(raw: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs, less the bytes of UTF-8 characters that are only partly inside."""
    out = []
    for a, b in runs:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def _packed(some: Members, key: int, at: int):
    """Rows whose key (a column) may be among the members, with a column of texts compressed."""

    def run(parts):
        codec = zstandard.ZstdCompressor(level=1)
        for part in parts:
            part = part.filter(pa.array(some(part.column(key).to_numpy())))
            texts = [x if x is None else codec.compress(x) for x in part.column(at).cast(pa.binary()).to_pylist()]
            yield part.set_column(at, part.schema.names[at], pa.array(texts, pa.binary()))

    return run


def _unpacked(texts: pa.Array) -> list[bytes | None]:
    codec = zstandard.ZstdDecompressor()
    return [x if x is None else codec.decompress(x) for x in texts.to_pylist()]


def _with_ranges(spark: SparkSession, docs: DataFrame, gone: DataFrame, names: list[str], at: int) -> tuple[DataFrame, DataFrame]:
    """(documents that may lose bytes, with compressed texts and _vx_own; documents that cannot): only the first are shuffled."""
    gone = cut(spark, gone)
    some = Members(spark, gone.select(F.xxhash64("_vx_t", "_vx_d")))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumn("_vx_t1", F.xxhash64(text)).withColumn("_vx_k", F.xxhash64("_vx_t1", F.col("doc_id").cast("long")))
    key = len(docs.columns) + 1
    outside = rows.mapInArrow(_only(some, key, False), rows.schema)
    inside = rows.mapInArrow(_packed(some, key, at), T.StructType([T.StructField(f.name, T.BinaryType() if i == at else f.dataType) for i, f in enumerate(rows.schema.fields)]))
    inside = inside.join(gone.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col("_vx_d")) & (F.col("_vx_t1") == F.col("_vx_t")), "left")
    cols = [f"`{n}`" for n in names]
    return inside.select(*cols, "_vx_own"), outside.select(*cols)


def kept_bytes(spark: SparkSession, docs: DataFrame, length: int = LENGTH, keep: str = "none", group: int = GROUP) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    inside, outside = _with_ranges(spark, docs, removed_ranges(spark, docs, length, keep, group), ["doc_id", "text"], 1)

    def run(parts):
        for part in (x for whole in parts for x in slices(whole, 1, 1 << 20 if whole.num_columns > 2 else 4 << 20)):
            packed = part.num_columns > 2
            raws = _unpacked(part.column(1)) if packed else part.column(1).cast(pa.binary()).to_pylist()
            out = []
            for raw, own in zip(raws, part.column(2).to_pylist() if packed else [None] * len(raws)):
                runs = runs_of(own, len(raw), length) if own else []
                out.append((len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(without(raw, runs)).hexdigest()))
            n, gone, spans, digest = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
        give_back()

    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return inside.mapInArrow(run, kind).union(outside.mapInArrow(run, kind))


def dedup_text(spark: SparkSession, docs: DataFrame, length: int = LENGTH, keep: str = "first", group: int = GROUP, words: int | None = None) -> DataFrame:
    """docs with repeated passages cut out of `text`; characters stay whole, and all other columns pass through.

    With `words`, repeats of `length` bytes only go if they belong to a passage of over so many words, or of LENGTH bytes.
    """
    names, at = docs.columns, docs.columns.index("text")
    docs = docs.select(*(F.col(f"`{n}`").cast("string").alias(n) if n == "text" else f"`{n}`" for n in names))
    inside, outside = _with_ranges(spark, docs, removed_ranges(spark, docs, length, keep, group), names, at)

    def run(parts):
        for part in (x for whole in parts for x in slices(whole, at, 1 << 20)):
            out = _unpacked(part.column(at))
            for i, own in enumerate(part.column(len(names)).to_pylist()):
                if own:
                    raw = out[i]
                    runs = runs_of(own, len(raw), length) if words is None else long_passages(own, raw, length, words)
                    out[i] = without(raw, whole_characters(raw, runs))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string()) if i == at else part.column(i) for i in range(len(names))], names=names)
        give_back()

    return inside.mapInArrow(run, docs.schema).union(outside)


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_bytes(spark, table(spark, sf_dir, "documents"))
