"""Language-model scoring with an Elias-Fano trie of n-grams of order three in memory-mapped levels.

Tokens are the words `[^\\x20\\x09-\\x0D]+` of a text with A-Z lower-cased, then one end. Training texts are those whose
crc32(doc_id as text) mod 5 is not 1.

Base: P1(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)), with counts of all training tokens. Model: interpolated absolute discounting
over all bigrams and trigrams of the training texts, however rare; a text's first token follows a start mark.

    P2(w | v)   = max(c(v w) - D, 0) / c(v)     + D T(v) / c(v)     P1(w)
    P3(w | u v) = max(c(u v w) - D, 0) / c(u v) + D T(u v) / c(u v) P2(w | v)

T counts distinct followers. A context that was not seen passes its word on to the next lower order. So the model sums to one
up to quantisation: the discounted part of a bigram or trigram and the weight D T(u v) / c(u v) are kept as log10 in steps of
STEP.

Levels: (1) the sorted 63-bit hashes of all training words with their counts, as an Elias-Fano code; a word's id is its position
and one, 0 is the start mark. (2) the followers of each word and (3) the followers of each bigram: the high part of the code is
the context's place in the level above, so its bit vector holds the context's monotone pointers, and the low bits are the
children's ids, sought by a successor search between the two pointers. T(v) is the distance of v's pointers.

Building: word counts first; then runs of texts give sorted, counted blocks of trigrams, which travel as packed columns to the
shard that their first two ids belong to. Shards are ranges of (first, second) of about SHARD tokens, cut at quantiles of a
sample; the sample decides nothing but their balance. A shard's blocks are merged into one file for levels 2 and 3, so pointers
between them are local. Bigrams need no counting of their own: each is the context of one trigram (an end is followed by a
mark that is no child). Only a word with more than a shard's tokens is in several shards; their numbers of its followers are
added up and kept with the model (at most two words a shard).

Scoring takes texts in runs of about BATCH bytes. Words are cut and numbered by Arrow, each distinct word, bigram and trigram of
a run is sought once, in the order of the levels, and only shards that hold any of them are opened. Files are written by executors
to the folder they share, moved into place when complete, so a task that runs again does no harm, and read by memory maps;
where the folder is no local path, shards are read through pyarrow's file systems and the last READ bytes are kept.

Two different words have one hash with probability V**2 / 2**64, which is taken for never; more than 2**32 - 2 distinct words
are refused, as ids have 32 bits.

Defined cases: null text is empty, which is one end; a null doc_id is trained on and not held out; repeated rows count each
time; with no training text P1 is 1; an empty table gives an empty result; further columns are ignored. A text is held in
memory as a whole, with some 200 bytes a word.
"""

from __future__ import annotations

import io
import json
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.common import crc_mod, give_back, new_path, slices, stored, table
from voxloom.llm.elias_fano import EliasFano, encode

DISCOUNT, STEP = 0.5, 1 / 24
#: Words in a shard of level 1; training tokens in a shard of levels 2 and 3, about; bytes of a run of texts.
WORDS, SHARD, BATCH = 1 << 19, 1_500_000, 4 << 20
#: Rows that a task gathers before it merges them; sampled bigrams of a run, and of all; bytes of shards read without a map.
HELD, SAMPLED, SAMPLE, READ = 1 << 21, 64, 100_000, 256 << 20
END = b" </s>"  # holds a space, so it is no word


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) >> 1


def quantised(x: np.ndarray) -> np.ndarray:
    """Codes of probabilities: -log10 in steps."""
    return np.clip(np.rint(-np.log10(np.maximum(x, 1e-30)) / STEP), 0, 255).astype(np.uint8)


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_arrays(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file: a line of JSON with type, length and place of each array, then the arrays."""
    head, at = {}, 0
    for name, x in arrays.items():
        head[name] = [x.dtype.str, len(x), at]
        at += -(-x.nbytes // 64) * 64
    out = io.BytesIO()
    line = json.dumps(head).encode()
    out.write(line + b" " * (-(len(line) + 1) % 64) + b"\n")
    for x in arrays.values():
        out.write(x.tobytes())
        out.write(bytes(-x.nbytes % 64))
    store, to = _store(path)
    store.create_dir(to.rsplit("/", 1)[0], recursive=True)
    new = f"{to}.{np.random.default_rng().integers(2**62)}"
    with store.open_output_stream(new) as f:
        f.write(out.getbuffer())
    store.move(new, to)


class Shards:
    """The files of a level, opened when asked for: mapped, or read and the last READ bytes kept."""

    def __init__(self, path: str):
        self.path, self.opened, self.bytes = path, OrderedDict(), 0

    def __getitem__(self, k: int) -> dict[str, np.ndarray]:
        if k in self.opened:
            self.opened.move_to_end(k)
            return self.opened[k][0]
        store, at = _store(f"{self.path}/{k}")
        if store.type_name == "local":
            raw, held = np.asarray(np.memmap(at, np.uint8, "r")), 0
        else:
            raw = np.frombuffer(store.open_input_file(at).read(), np.uint8)
            held = len(raw)
        first = next(i for i in range(64, len(raw) + 1, 64) if raw[i - 1] == 10)
        head = json.loads(raw[:first].tobytes())
        out = {name: raw[first + a : first + a + n * np.dtype(kind).itemsize].view(kind) for name, (kind, n, a) in head.items()}
        self.opened[k], self.bytes = (out, held), self.bytes + held
        while self.bytes > READ and len(self.opened) > 1:
            self.bytes -= self.opened.popitem(last=False)[1][1]
        return out


def _code(arrays: dict[str, np.ndarray], level: str = "") -> EliasFano:
    return EliasFano(*(arrays[level + x] for x in ("low", "high", "zeros", "shape")))


def _parts(of: np.ndarray):
    """(value, first, end) of each run of an ordered array."""
    edge = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.zeros(0, np.int64)
    return zip(of[edge].tolist(), edge.tolist(), [*edge[1:].tolist(), len(of)])


class Model:
    """What is needed to open the levels.

    total, distinct, texts: N, V and the number of training texts; words: words in each shard of level 1, by the top bits of the
    hash; cuts: where the shards of levels 2 and 3 begin; split: words in several shards and their numbers of followers.
    """

    def __init__(self, path: str, total: int, distinct: int, texts: int):
        self.path, self.total, self.distinct, self.texts = path, total, distinct, texts
        self.bits, self.id_bits = max(0, -(-distinct // WORDS) - 1).bit_length(), max(1, distinct.bit_length())
        self.before, self.cuts = np.zeros(2, np.int64), np.zeros(0, np.uint64)
        self.split_ids, self.split_counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def p1(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / (self.total + 0.5 * (self.distinct + 1))


class Trie:
    """The levels of a model, for one task."""

    def __init__(self, model: Model):
        self.model, self.words, self.grams = model, Shards(f"{model.path}/words"), Shards(f"{model.path}/grams")

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count) of words by hash."""
        m, ids, counts = self.model, np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        order = np.argsort(hashes)
        for k, a, b in _parts((hashes >> (63 - m.bits))[order]):
            if m.before[k + 1] > m.before[k]:
                own, rows = self.words[k], order[a:b]
                at = _code(own).find(hashes[rows] - (k << (63 - m.bits)))
                rows, at = rows[at >= 0], at[at >= 0]
                ids[rows], counts[rows] = m.before[k] + at + 1, own["count"][at]
        return ids, counts

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of ordered ids; the start mark's is the number of texts."""
        m, out = self.model, np.full(len(ids), self.model.texts, np.int64)
        for k, a, b in _parts(np.searchsorted(m.before, ids - 1, "right") - 1):
            if k >= 0:
                out[a:b] = self.words[k]["count"][ids[a:b] - 1 - m.before[k]]
        return out

    def _shard(self, pairs: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.model.cuts, pairs, "right") - 1

    def followers(self, ids: np.ndarray) -> np.ndarray:
        """T of ordered ids."""
        m, out = self.model, np.zeros(len(ids), np.int64)
        for k, a, b in _parts(self._shard(ids.astype(np.uint64) << np.uint64(32))):
            own = self.grams[k]
            lo, hi = _code(own, "2_").children(ids[a:b] - own["first"][0])
            out[a:b] = hi - lo
        at = np.searchsorted(m.split_ids, ids)
        hot = np.flatnonzero(np.isin(ids, m.split_ids))
        out[hot] = m.split_counts[at[hot]]
        return out

    def bigrams(self, u: np.ndarray, v: np.ndarray):
        """(shard, place in its level 2 or -1, discounted probability or 0, weight of the lower order) of ordered bigrams."""
        shard = self._shard((u.astype(np.uint64) << np.uint64(32)) | v.astype(np.uint64))
        at, p, rest = np.full(len(u), -1, np.int64), np.zeros(len(u)), np.ones(len(u))
        for k, a, b in _parts(shard):
            own = self.grams[k]
            code = _code(own, "2_")
            at[a:b] = i = code.successor(v[a:b], *code.children(u[a:b] - own["first"][0]))
            ok = np.flatnonzero(i >= 0)
            p[a + ok], rest[a + ok] = _LINEAR[own["2_code"][i[ok]]], _LINEAR[own["2_rest"][i[ok]]]
        return shard, at, p, rest

    def trigrams(self, shard: np.ndarray, at: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Discounted probabilities, or 0, of children w of bigrams at places of shards, in their order."""
        p = np.zeros(len(w))
        for k, a, b in _parts(shard):
            own = self.grams[k]
            code = _code(own, "3_")
            i = code.successor(w[a:b], *code.children(at[a:b]))
            ok = np.flatnonzero(i >= 0)
            p[a + ok] = _LINEAR[own["3_code"][i[ok]]]
        return p


_LINEAR = 10 ** (-STEP * np.arange(256))


def cut_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct words, the word at each place, words in each text)."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts.cast(pa.large_string()))))
    flat, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    sizes[pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)] = 0
    blank = pc.equal(flat, "").to_numpy(zero_copy_only=False)
    if blank.any():  # texts of nothing but white space
        text = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        flat, sizes = flat.filter(pa.array(~blank)), np.bincount(text[~blank], minlength=len(lists)).astype(np.int64)
    coded = flat.dictionary_encode()
    names = coded.dictionary.cast(pa.large_binary()).to_pylist()
    return np.fromiter(map(word_hash, names), np.int64, len(names)), coded.indices.to_numpy().astype(np.int64), sizes


def laid_out(places: np.ndarray, sizes: np.ndarray, marks: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all texts: marks[0], the words, the other marks; first place of each text)."""
    more = len(marks)
    first = np.cumsum(sizes + more) - sizes - more
    out = np.empty(len(places) + more * len(sizes), np.int64)
    out[np.arange(len(places)) + more * np.repeat(np.arange(len(sizes)), sizes) + 1] = places
    out[first] = marks[0]
    for i, x in enumerate(marks[1:]):
        out[first + sizes + 1 + i] = x
    return out, first


def _merged(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their sums of n."""
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    return keys[new], np.add.reduceat(n, new) if len(new) else n


def _runs(parts, text: int, held: int, limit: int):
    """Arrays of the texts that are learned from, some at a time."""
    for part in (x for whole in parts for x in slices(whole, text, limit)):
        texts = pc.fill_null(part.column(text).filter(pc.invert(part.column(held))), "")
        if len(texts):
            yield texts


def _counts(parts):
    """Rows (held, text) -> (h, a, n): counts of words (a null), and sampled bigrams (h -1: the start mark)."""

    def out(h, a, n):
        return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), a, pa.array(n, pa.int64())], names=["h", "a", "n"])

    keys, ns, size = [], [], 0
    for texts in _runs(parts, 1, 0, 2 * BATCH):
        hashes, places, sizes = cut_words(texts)
        hashes = np.append(hashes, [word_hash(END), -1])
        keys.append(hashes[:-1])
        ns.append(np.append(np.bincount(places, minlength=len(hashes) - 2), len(texts)))
        flat, _ = laid_out(places, sizes, (len(hashes) - 1, len(hashes) - 2))
        at = np.random.default_rng(len(flat)).integers(0, len(flat) - 1, SAMPLED)
        at = at[flat[at + 1] != len(hashes) - 1]  # not across texts
        yield out(hashes[flat[at]], pa.array(hashes[flat[at + 1]]), np.ones(len(at), np.int64))
        size += len(hashes)
        if size > HELD:
            keys, ns = ([x] for x in _merged(np.concatenate(keys), np.concatenate(ns)))
            size = len(keys[0])
            if size > HELD // 2:
                yield out(keys[0], pa.nulls(size, pa.int64()), ns[0])
                keys, ns, size = [], [], 0
    if keys:
        keys, ns = _merged(np.concatenate(keys), np.concatenate(ns))
        yield out(keys, pa.nulls(len(keys), pa.int64()), ns)
    give_back()


def _packed(pairs: np.ndarray, w: np.ndarray, n: np.ndarray) -> bytes:
    """Ordered trigrams as planes of bytes, which compress well."""
    return b"".join(np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(len(x), -1).T).tobytes() for x, kind in ((pairs, "<u8"), (w, "<u4"), (n, "<u4")))


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, planes = len(raw) // 16, np.frombuffer(raw, np.uint8)
    return tuple(np.ascontiguousarray(planes[a * n : b * n].reshape(b - a, n).T).view(kind).ravel() for a, b, kind in ((0, 8, "<u8"), (8, 12, "<u4"), (12, 16, "<u4")))


def _trigrams(model: Model):
    """Rows (held, text) -> (shard, block) of counted trigrams."""

    def run(parts):
        trie = Trie(model)
        for texts in _runs(parts, 1, 0, 2 * BATCH):
            hashes, places, sizes = cut_words(texts)
            ids = np.append(trie.ids(np.append(hashes, word_hash(END)))[0], 0)
            order = np.argsort(ids)
            rank, ids, bits = np.empty(len(ids), np.int64), ids[order], max(1, (len(ids) - 1).bit_length())
            rank[order] = np.arange(len(ids))
            flat, first = laid_out(rank[places], sizes, (0, int(rank[-2]), 0))
            begins = np.ones(len(flat), bool)  # of trigrams: all places but a text's last two
            begins[np.concatenate((first[1:] - 1, first[1:] - 2, [len(flat) - 1, len(flat) - 2]))] = False
            at = np.flatnonzero(begins)
            pairs = (flat[at] << bits) | flat[at + 1]
            known = None
            if 3 * bits > 63:
                known, pairs = np.unique(pairs, return_inverse=True)
            keys = np.sort((pairs << bits) | flat[at + 2])
            new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            n, keys = np.diff(np.append(new, len(keys))), keys[new]
            pairs, w = keys >> bits, ids[keys & ((1 << bits) - 1)]
            pairs = pairs if known is None else known[pairs]
            pairs = (ids[pairs >> bits].astype(np.uint64) << np.uint64(32)) | ids[pairs & ((1 << bits) - 1)].astype(np.uint64)
            edge = [*np.searchsorted(pairs, model.cuts).tolist(), len(pairs)]
            own = [(k, a, b) for k, (a, b) in enumerate(zip(edge[:-1], edge[1:])) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in own], pa.int64()), pa.array([_packed(pairs[a:b], w[a:b], n[a:b]) for _, a, b in own], pa.binary())], names=["shard", "block"])
        give_back()

    return run


def _joined(blocks: list) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """One block of counted trigrams from several."""
    pairs, w, n = (np.concatenate(x) for x in zip(*blocks))
    order = np.argsort(pairs)
    ordered = pairs[order]
    rank = np.empty(len(pairs), np.uint64)
    rank[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
    order = np.argsort((rank << np.uint64(32)) | w)
    pairs, w, n = pairs[order], w[order], n[order].astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (pairs[1:] != pairs[:-1]) | (w[1:] != w[:-1]))))
    return [(pairs[new], w[new], np.add.reduceat(n, new))]


def _write_grams(model: Model, trie: Trie, shard: int, pairs: np.ndarray, w: np.ndarray, n: np.ndarray):
    """Write a shard of levels 2 and 3; its (shard, first word, its followers here, last word, its followers here)."""
    new = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
    total, context = np.add.reduceat(n, new), np.repeat(np.arange(len(new)), np.diff(np.append(new, len(pairs))))
    u, v = (pairs[new] >> np.uint64(32)).astype(np.int64), (pairs[new] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    child = w > 0  # the mark behind an end is none
    kids = np.bincount(context[child], minlength=len(new))
    names = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
    each = np.diff(np.append(names, len(u)))
    seen = np.repeat(trie.counts(u[names]), each)
    two = encode(((u - u[0]) << model.id_bits) | v, model.id_bits)
    three = encode((context[child] << model.id_bits) | w[child].astype(np.int64), model.id_bits)
    write_arrays(
        f"{model.path}/grams/{shard}",
        {f"2_{k}": x for k, x in two.items()} | {f"3_{k}": x for k, x in three.items()}
        | {"first": u[:1], "2_code": quantised((total - DISCOUNT) / seen), "2_rest": quantised(DISCOUNT * kids / total), "3_code": quantised((n[child] - DISCOUNT) / total[context[child]])},
    )
    return shard, int(u[0]), int(each[0]), int(u[-1]), int(each[-1])


def _grams(model: Model):
    """Rows (shard, block) sorted by shard: one file for each shard, and a row for it."""
    names = ["shard", "u", "n", "u2", "n2"]

    def run(parts):
        trie, now, held, size = Trie(model), None, [], 0
        for part in parts:
            for k, raw in zip(part.column(0).to_pylist(), part.column(1)):
                if held and k != now:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, _write_grams(model, trie, now, *_joined(held)[0])))])
                    held, size = [], 0
                now = k
                held.append(_unpacked(raw.as_buffer()))
                size += len(held[-1][0])
                if size > HELD:
                    held = _joined(held)
                    size = len(held[0][0]) // 2  # merged again after as many rows as half of those that are left, and HELD
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(names, _write_grams(model, trie, now, *_joined(held)[0])))])
        give_back()

    return run


def _write_words(model: Model):
    """Rows (shard, h, n) sorted by them: one file for each shard."""

    def run(parts):
        def done(k, h, n):
            h, n = np.concatenate(h), np.concatenate(n)
            write_arrays(f"{model.path}/words/{k}", encode(h - (k << (63 - model.bits))) | {"count": n.astype(np.uint32 if n.max() < 2**32 else np.int64)})
            return pa.RecordBatch.from_arrays([pa.array([k]), pa.array([len(h)])], names=["shard", "n"])

        now, held = None, ([], [])
        for part in parts:
            shard, h, n = (part.column(i).to_numpy() for i in range(3))
            for k, a, b in _parts(shard):
                if now is not None and k != now:
                    yield done(now, *held)
                    held = ([], [])
                now = k
                held[0].append(h[a:b])
                held[1].append(n[a:b])
        if now is not None:
            yield done(now, *held)
        give_back()

    return run


def held_out(doc_id) -> F.Column:
    return F.coalesce(crc_mod(doc_id, 5) == 1, F.lit(False))


def _cuts(spark: SparkSession, model: Model, sampled: DataFrame) -> np.ndarray:
    """Where the shards of levels 2 and 3 begin: quantiles of the sampled bigrams, between words unless a word fills a shard."""
    want = -(-model.total // SHARD)
    rows = sampled.orderBy(F.xxhash64("h", "a"), "h", "a").limit(SAMPLE).collect() if want > 1 else []
    if not rows:
        return np.zeros(1, np.uint64)
    h, a, n = (np.array(x, np.int64) for x in zip(*sorted((r.h, r.a, r.n) for r in rows)))
    ends, of = np.cumsum(n), np.unique(h, return_inverse=True)[1]
    at = np.unique(np.searchsorted(ends, ends[-1] * np.arange(1, want) / want))
    hot = np.bincount(of, n)[of[at]] >= ends[-1] / want

    def to_ids(parts):
        trie = Trie(model)
        for part in parts:
            yield pa.RecordBatch.from_arrays([pa.array(trie.ids(part.column(i).to_numpy())[0]) for i in (0, 1)], names=["u", "v"])

    asked = spark.createDataFrame([(int(x), int(y)) for x, y in zip(h[at], a[at])], "h long, a long").coalesce(1)
    ids = asked.mapInArrow(to_ids, "u long, v long").collect()  # a row for each shard, at most
    u, v = (np.array(x, np.int64) for x in zip(*ids))
    return np.unique(np.append((np.maximum(u, 0).astype(np.uint64) << np.uint64(32)) | np.where(hot, np.maximum(v, 0), 0).astype(np.uint64), np.uint64(0)))


def train(spark: SparkSession, docs: DataFrame) -> Model:
    """Count, smooth and write the levels for the training rows of docs (doc_id, text)."""
    rows = docs.select(held_out(F.col("doc_id")).alias("held"), F.col("text").cast("string").alias("text"))
    counts = stored(spark, rows.mapInArrow(_counts, "h long, a long, n long").groupBy("h", "a").agg(F.sum("n").alias("n")), "ngram-counts")
    words = counts.where("a is null")
    size = words.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("t"), F.coalesce(F.max(F.when(F.col("h") == word_hash(END), F.col("n"))), F.lit(0)).alias("texts")).first()
    model = Model(new_path(spark, "ngram-lm"), size.t, size.v, size.texts)
    if not size.v:
        return model
    if size.v >= 2**32 - 1:
        raise ValueError("more words than ids of 32 bits")
    parts = 1 << model.bits
    sharded = words.select((F.shiftright("h", 63 - model.bits) if model.bits else F.lit(0)).cast("long").alias("shard"), "h", "n")
    got = sharded.repartition(parts, "shard").sortWithinPartitions("shard", "h").mapInArrow(_write_words(model), "shard long, n long").collect()  # a row for each shard
    model.before = np.zeros(parts + 1, np.int64)
    for r in got:
        model.before[r.shard + 1] = r.n
    model.before = np.cumsum(model.before)
    model.cuts = _cuts(spark, model, counts.where("a is not null").select("h", "a", "n"))
    # blocks may be large, so few of them make a batch
    blocks = rows.mapInArrow(_trigrams(model), "shard long, block binary").repartition(len(model.cuts), "shard").sortWithinPartitions("shard")
    got = blocks.mapInArrow(_grams(model), "shard long, u long, n long, u2 long, n2 long").collect()  # a row for each shard
    found: dict[int, int] = {}
    for r in got:
        for u, n in {(r.u, r.n), (r.u2, r.n2)} if r.u != r.u2 else {(r.u, r.n)}:
            found[u] = found.get(u, 0) + n
    split = sorted({int(x) >> 32 for x in model.cuts if int(x) & 0xFFFFFFFF})
    model.split_ids, model.split_counts = np.array(split, np.int64), np.array([found.get(u, 0) for u in split], np.int64)
    return model


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in order, the distinct key of each place)."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(new) - 1
    return ordered[new], back


def log_probabilities(trie: Trie, texts: pa.Array):
    """(tokens, known tokens, sum of log10 P1, log10 probability by the model) of each text."""
    m = trie.model
    hashes, places, sizes = cut_words(texts)
    ids, counts = trie.ids(np.append(hashes, word_hash(END)))
    ids, counts = np.append(ids, 0 if m.texts else -1), np.append(counts, m.texts)
    p1, end = m.p1(counts), len(ids) - 2
    order = np.argsort(ids)
    order = order[np.searchsorted(ids[order], 0) :]  # the symbols that the model knows, by id
    known, rank, bits = ids[order], np.full(len(ids), -1, np.int64), max(1, len(order).bit_length())
    rank[order] = np.arange(len(order))
    weight = np.ones(len(ids))
    weight[order] = DISCOUNT * trie.followers(known) / counts[order] if len(order) else 0
    weight[end] = 1  # nothing follows an end

    flat, first = laid_out(places, sizes, (end + 1, end))
    at = np.ones(len(flat), bool)
    at[first] = False
    at = np.flatnonzero(at)
    w, before = flat[at], flat[at - 1]
    p = weight[before] * p1[w]
    both = np.flatnonzero((rank[before] >= 0) & (rank[w] >= 0))
    keys, back = _distinct((rank[before[both]] << bits) | rank[w[both]])
    shard, place, q, rest = trie.bigrams(known[keys >> bits], known[keys & ((1 << bits) - 1)])
    p[both] += q[back]

    context = np.full(len(at), -1, np.int64)  # of the next token: the bigram that ends here
    context[both] = np.where(place[back] >= 0, back, -1)
    t = np.flatnonzero((context[:-1] >= 0) & (before[1:] != end + 1)) + 1  # a first token has one token of context
    p[t] *= rest[context[t - 1]]
    t = t[rank[w[t]] >= 0]
    keys, back = _distinct((context[t - 1] << bits) | rank[w[t]])
    own = keys >> bits
    p[t] += trie.trigrams(shard[own], place[own], known[keys & ((1 << bits) - 1)])[back]

    ends = np.cumsum(sizes + 1) - sizes - 1
    return sizes + 1, np.add.reduceat((counts[w] > 0).astype(np.int64), ends), np.add.reduceat(np.log10(p1)[w], ends), np.add.reduceat(np.log10(p), ends)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs (doc_id, text)."""

    def run(parts):
        trie = Trie(model)
        for part in (x for whole in parts for x in slices(whole, 2, BATCH)):
            if part.num_rows:
                n, seen, base, logs = log_probabilities(trie, pc.fill_null(part.column(2), ""))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(seen), pa.array(np.full(len(n), model.total, np.int64)), pa.array(base), pa.array(logs)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(spark, docs))
