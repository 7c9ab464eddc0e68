"""Byte-level BPE by DuckDB recursive queries inside each partition, and decoding by ordered aggregation.

Encoding: texts are cut by the tokenizer's pattern. Words that are one token need no merge; the others become
(word, position, token) rows. One step of the recursive query joins neighbouring rows to the merge table, finds for each word
the pair of least rank, leftmost first, and contracts it; a word without a pair leaves the recursion. Words over LONG bytes
take a step that contracts every place of the least rank at once where that provably gives the same tokens: no token pair
with the merged token may have a lower rank, and overlapping places alternate from the left. Words over WHOLE bytes are cut
into even blocks of at most BLOCK bytes that go through the recursion side by side; then the tokens around each cut, SEAM on either side,
are put together and go through it again. Tokens are the encoding of their bytes if each neighbouring pair is the encoding of
its own bytes, so the blocks and the seams between them make up the word's tokens if a seam begins and ends with a token of its
blocks. Where it does not, the seam is made wider, and then the blocks, up to the whole word.

Decoding: (text, position, id) rows join the vocabulary, and an ordered string aggregation puts the pieces together. Pieces
are bytes, carried as one character for each byte.

Only distinct words are encoded, and a memo of at most CACHE words and CACHED bytes lives as long as a Python worker; it is
emptied before the next run of texts when it has outgrown either. Texts are taken in
runs of about 4 MB, and their new words go through the recursion in runs of AT_ONCE bytes, so memory depends on the longest text
and not on the partition.

Defined cases: null text is empty; an empty text has no ids and decodes to nothing; repeated rows stay; a null doc_id stays;
an empty table gives an empty result; further columns are ignored (`encode` and `decode`) or kept (`with_ids`).
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.common import batches, bounded, give_back, slices, table

LONG, CACHE, AT_ONCE, AT_TIME = 48, 900_000, 1 << 18, 4 << 20
WHOLE, BLOCK, SEAM, CACHED = 1024, 256, 8, 64 << 20
#: Words that with_ids() keeps while it works on a partition, beside a pipeline's other stages in the same workers.
FEW = 150_000

_STEP = """
WITH RECURSIVE s(w, pos, tok, done) AS (
    SELECT w, pos, tok, false FROM todo
    UNION ALL
    (WITH pairs AS MATERIALIZED (
        SELECT n.w, n.pos, n.tok, n.prv, CAST(m.rank AS BIGINT) * 4294967296 + n.pos AS key
        FROM (SELECT w, pos, tok, lead(tok) OVER words AS nxt, lag(pos) OVER words AS prv FROM s WHERE NOT done
              WINDOW words AS (PARTITION BY w ORDER BY pos)) n
        LEFT JOIN merges m ON n.tok = m.a AND n.nxt = m.b),
    least AS (SELECT w, min(key) AS best FROM pairs GROUP BY w)
    SELECT p.w, pos, CASE WHEN key = best THEN CAST(key // 4294967296 AS INTEGER) ELSE tok END, best IS NULL
    FROM pairs p JOIN least USING (w)
    WHERE best IS NULL OR prv IS NULL OR prv <> best % 4294967296))
SELECT w, list(tok ORDER BY pos) AS ids FROM s WHERE done GROUP BY w
"""

_LONG_STEP = """
WITH RECURSIVE s(w, pos, tok, done) AS (
    SELECT w, pos, tok, false FROM todo
    UNION ALL
    SELECT w, pos, CASE WHEN hit THEN rank ELSE tok END, best IS NULL
    FROM (
        SELECT *, coalesce(lag(hit) OVER (PARTITION BY w ORDER BY pos), false) AS gone
        FROM (
            SELECT *, coalesce(rank = best // 4294967296 AND (key = best OR safe AND (row_number() OVER (PARTITION BY w, same, run ORDER BY pos)) % 2 = 1), false) AS hit
            FROM (
                SELECT *, rn - row_number() OVER (PARTITION BY w, same ORDER BY pos) AS run
                FROM (
                    SELECT *, coalesce(rank = best // 4294967296, false) AS same
                    FROM (
                        SELECT *, min(key) OVER (PARTITION BY w) AS best
                        FROM (
                            SELECT n.w, n.pos, n.tok, n.rn, m.rank, m.safe, CAST(m.rank AS BIGINT) * 4294967296 + n.pos AS key
                            FROM (SELECT w, pos, tok, lead(tok) OVER words AS nxt, row_number() OVER words AS rn FROM s WHERE NOT done
                                  WINDOW words AS (PARTITION BY w ORDER BY pos)) n
                            LEFT JOIN merges m ON n.tok = m.a AND n.nxt = m.b))))))
    WHERE NOT gone)
SELECT w, list(tok ORDER BY pos) AS ids FROM s WHERE done GROUP BY w
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """Encoder and decoder for one rank file and pattern."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.ranks, self.cut = read_ranks(path), regex.compile(pattern)
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.pieces = {rank: piece for piece, rank in self.ranks.items()}
        a, b, r = [], [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                x, y = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if x is not None and y is not None:
                    a.append(x), b.append(y), r.append(rank)
        a, b, r = (np.array(x, np.int32) for x in (a, b, r))
        unsafe = np.unique(np.concatenate((a[r < a], b[r < b])))
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        self._fill("merges", {"a": a, "b": b, "rank": r, "safe": ~np.isin(r, unsafe)})
        self._fill("vocab", {"id": np.array(list(self.ranks.values()), np.int32), "piece": [k.decode("latin-1") for k in self.ranks]})
        self.naming = True
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}  # word -> its number
        self.held = 0
        self.flat, self.start, self.size, self.named = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), []

    def close(self) -> None:
        """Give back the tables and the memo; the codec is of no use afterwards."""
        self.con.close()
        self._forget()

    def _fill(self, name: str, columns: dict) -> None:
        self.con.register("given", pa.table(columns))
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def words(self, words: list[bytes], block: int = 0) -> list[np.ndarray]:
        """Ids of each word: very long ones by blocks and seams, the others as they are."""
        block = block or BLOCK
        long = [i for i, w in enumerate(words) if len(w) > max(WHOLE, block) and w not in self.ranks]
        if not long:
            return self._whole(words)
        taken = set(long)
        out = self._whole([b"" if i in taken else w for i, w in enumerate(words)])
        cuts = [np.linspace(0, len(words[i]), -(-len(words[i]) // block) + 1).astype(int).tolist() for i in long]
        done = iter(self._whole([words[i][a:b] for i, own in zip(long, cuts) for a, b in zip(own, own[1:])]))
        parts = [[next(done).tolist() for _ in own[1:]] for own in cuts]
        # seams take at most half of a block's tokens, so no two share any; those that do not fit are tried wider
        fits: list[dict[int, tuple[int, int, list[int]]]] = [{} for _ in parts]
        open_, width = [(n, k) for n, own in enumerate(parts) for k in range(len(own) - 1)], SEAM
        while open_:
            sides = [(min(width, len(parts[n][k]) // 2), min(width, len(parts[n][k + 1]) // 2)) for n, k in open_]
            tried = [parts[n][k][len(parts[n][k]) - x :] + parts[n][k + 1][:y] for (n, k), (x, y) in zip(open_, sides)]
            new = [x.tolist() for x in self._whole([b"".join(map(self.pieces.__getitem__, x)) for x in tried])]
            again = []
            for (n, k), (x, y), old, ids in zip(open_, sides, tried, new):
                if x and y and ids[0] == old[0] and ids[-1] == old[-1]:
                    fits[n][k] = (x, y, ids)
                elif width < max(len(parts[n][k]), len(parts[n][k + 1])) // 2:
                    again.append((n, k))
            open_, width = again, 4 * width
        rest = []
        for n, i in enumerate(long):
            if len(fits[n]) < len(parts[n]) - 1:
                rest.append(i)
                continue
            ids, a = [], 0
            for k, own in enumerate(parts[n][:-1]):
                x, y, seam = fits[n][k]
                ids += own[a : len(own) - x] + seam
                a = y
            out[i] = np.array(ids + parts[n][-1][a:], np.int32)
        for i, ids in zip(rest, self.words([words[i] for i in rest], 4 * block) if rest else ()):
            out[i] = ids
        return out

    def _whole(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word, by the recursion over the whole of it."""
        out: list = [None] * len(words)
        todo: dict[bool, list[int]] = {False: [], True: []}
        for i, w in enumerate(words):
            if not w:
                out[i] = np.zeros(0, np.int32)
            elif (own := self.ranks.get(w)) is not None:
                out[i] = np.array([own], np.int32)
            else:
                todo[len(w) > LONG].append(i)
        for long, own in todo.items():
            for k, end in batches([words[i] for i in own], AT_ONCE):
                part = own[k:end]
                lens = np.array([len(words[i]) for i in part])
                pos = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
                self._fill("todo", {"w": np.repeat(np.arange(len(part), dtype=np.int32), lens), "pos": pos.astype(np.int32), "tok": self.byte[np.frombuffer(b"".join(words[i] for i in part), np.uint8)]})
                got = self.con.sql(_LONG_STEP if long else _STEP).to_arrow_table().combine_chunks()
                lists = got.column("ids").combine_chunks()
                ids, at = lists.flatten().to_numpy(), lists.offsets.to_numpy()
                at = at - at[0]
                for j, w in enumerate(got.column("w").to_numpy().tolist()):
                    out[part[w]] = ids[at[j] : at[j + 1]]
        return out

    def _learn(self, new: list[str]) -> None:
        ids = self.words([w.encode("utf-8", "surrogatepass") for w in new])
        self.memo.update(zip(new, range(len(self.memo), len(self.memo) + len(new))))
        self.held += sum(map(len, new)) + 10 * sum(map(len, ids))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(sizes) - sizes))
        self.size = np.concatenate((self.size, sizes))
        self.flat = np.concatenate((self.flat, *ids))
        if self.naming:
            text = list(map(str, range(len(self.ranks))))
            self.named += [",".join([text[i] for i in x.tolist()]) for x in ids]

    def encode(self, texts: list[str], cache: int | None = None, naming: bool = True) -> tuple[list[np.ndarray], list[str]]:
        """For each text its ids, as an array and (if `naming`, else nothing) as decimal numbers joined by commas."""
        if naming != self.naming:
            self.naming = naming
            self._forget()
        if len(self.memo) > (CACHE if cache is None else cache) or self.held > CACHED:
            self._forget()
        words = [self.cut.findall(x) for x in texts]
        found = [list(map(self.memo.get, x)) for x in words]
        new = {w for x, own in zip(words, found) if None in own for w, i in zip(x, own) if i is None}
        if new:
            self._learn(sorted(new, key=len))  # words of like length leave the recursion together
            memo = self.memo
            found = [[memo[w] if i is None else i for w, i in zip(x, own)] if None in own else own for x, own in zip(words, found)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        at = np.fromiter(chain.from_iterable(found), np.int64, int(counts.sum()))
        sizes = self.size[at]
        ends = np.cumsum(sizes)
        ids = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[at] - ends + sizes, sizes)]
        bounds = np.concatenate(([0], ends))[np.cumsum(np.concatenate(([0], counts)))]
        named = self.named
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])], [",".join([named[i] for i in own]) for own in found] if naming else []

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids; an unknown id is an error."""
        lens = np.array([len(x) for x in ids], np.int64)
        if not lens.sum():
            return [b""] * len(ids)
        pos = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
        self._fill("coded", {"d": np.repeat(np.arange(len(ids), dtype=np.int32), lens), "pos": pos.astype(np.int32), "id": np.concatenate(ids).astype(np.int32)})
        if self.con.execute("SELECT count(*) FROM coded ANTI JOIN vocab USING (id)").fetchone()[0]:
            raise ValueError("an id is not in the vocabulary")
        out = [b""] * len(ids)
        for d, text in self.con.execute("SELECT d, string_agg(piece, '' ORDER BY pos) FROM coded JOIN vocab USING (id) GROUP BY d").fetchall():
            out[d] = text.encode("latin-1")
        return out


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for a rank file, made once."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def default_tokenizer() -> tuple[str, str]:
    import public_tokenizers as tokenizers

    return tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) for each row of docs (doc_id, text)."""

    def run(parts):
        own = codec(path, pattern)
        for part in (x for whole in parts for x in slices(whole, 1, AT_TIME)):
            texts = pc.fill_null(part.column(1), "").to_pylist()
            ids, _ = own.encode(texts)
            at = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "ids"])
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes binary) for each row of coded (doc_id, ids); null ids decode to nothing."""

    def run(parts):
        own = codec(path, pattern)
        for part in parts:
            ids = [np.array(x or [], np.int32) for x in part.column(1).to_pylist()]
            for a, b in batches(ids, 1 << 19):
                yield pa.RecordBatch.from_arrays([part.column(0).slice(a, b - a), pa.array(own.decode(ids[a:b]), pa.binary())], names=["doc_id", "bytes"])

    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode, then decode the ids, and return the digests of both for each row of docs (doc_id, text)."""

    def run(parts):
        own = codec(path, pattern)
        for part in (x for whole in parts for x in slices(whole, 1, AT_TIME)):
            ids, named = own.encode(pc.fill_null(part.column(1), "").to_pylist())
            back = own.decode(ids)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in named]), pa.array([hashlib.sha256(x).hexdigest() for x in back])],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def with_ids(docs: DataFrame, path: str, pattern: str, to: str = "input_ids") -> DataFrame:
    """docs with a column of token ids and n_tokens; all other columns pass through as they are.

    Each partition makes its own codec and closes it: a worker that kept one would hold it through a pipeline's other stages,
    beside the workers that these start.
    """
    bounded(docs.sparkSession)
    at, kept = docs.columns.index("text"), [f for f in docs.schema.fields if f.name not in (to, "n_tokens")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_tokens long", f"`{to}` array<int>"])
    names = [f.name for f in kept]

    def run(parts):
        own = Codec(path, pattern)
        for part in (x for whole in parts for x in slices(whole, at, AT_TIME // 8)):
            ids, _ = own.encode(pc.fill_null(part.column(at), "").to_pylist(), FEW, naming=False)
            ends = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in names), pa.array(np.diff(ends), pa.int64()), lists], names=[*names, "n_tokens", to])
        own.close()
        del own
        give_back()

    return docs.mapInArrow(run, schema)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), *default_tokenizer())
