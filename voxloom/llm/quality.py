"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are covered by overlapping chunks of CHUNK bytes, STRIDE apart. Learned filters WIDTH bytes wide run over
every place of a chunk; each filter is max-pooled over the chunk, a dense layer gives the chunk's logit, and the mean of the
logits over all chunks gives one probability for the text. A chunk that is not full is padded with byte zero, so an empty text
is one chunk of padding.

Training is on the driver, on at most SAMPLE labelled rows (those whose id hashes lowest; the bound is a parameter), with all
chunks of their texts, some at a time; scoring always covers whole texts. Rows whose crc32(doc_id as text) mod 5 is
0 are never learned from. Gradients flow only through the place of each maximum. Labels, lang, source and doc_id are no
inputs. For scoring, the byte tables of two neighbouring places are added beforehand, so that a filter bank costs one lookup
for two bytes.

Defined cases: null text is empty; a null doc_id is scored and counts as not held out; several labels of one id: the lowest
holds; a null label is none; without labels of both kinds every text gets the share of label 1 (0.5 without any); repeated
rows stay; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.common import crc_mod, give_back, slices, table

SAMPLE = 3000
CHUNK, STRIDE, WIDTH, FILTERS = 512, 448, 6, 16
STEPS, BATCH, RATE, DECAY = 560, 32, 0.01, 1e-4
THRESHOLD = 0.3


@dataclass
class Model:
    """tables[j, byte, filter]: what a byte at place j adds to a filter; then bias, dense weights and offset."""

    tables: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    offset: float

    def pairs(self) -> list[np.ndarray]:
        """Tables of two places each, by first + 256 * second byte."""
        return [(self.tables[j][None, :, :] + self.tables[j + 1][:, None, :]).reshape(65536, -1).astype(np.float32) for j in range(0, WIDTH, 2)]


def chunks(data: np.ndarray) -> np.ndarray:
    """The overlapping chunks of one text's bytes, as rows."""
    n = max(1, -(-(len(data) - (CHUNK - STRIDE)) // STRIDE)) if len(data) > CHUNK else 1
    padded = np.zeros((n - 1) * STRIDE + CHUNK, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STRIDE]


def activations(model_pairs: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Filter sums at each place of each chunk, without bias: (chunks, places, filters)."""
    two = rows[:, :-1].astype(np.uint16) + (rows[:, 1:].astype(np.uint16) << 8)
    places = CHUNK - WIDTH + 1
    out = model_pairs[0][two[:, :places]]
    for j in range(1, WIDTH // 2):
        out += model_pairs[j][two[:, 2 * j : 2 * j + places]]
    return out


def logits(model: Model, model_pairs: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """One logit for each chunk, some chunks at a time so that the places stay in the cache."""
    out = np.empty(len(rows), np.float64)
    for i in range(0, len(rows), 16):
        pooled = np.maximum(activations(model_pairs, rows[i : i + 16]).max(axis=1) + model.bias, 0)
        out[i : i + 16] = pooled @ model.dense + model.offset
    return out


def fit(texts: list[bytes], labels: list[int], seed: int = 7, steps: int = STEPS) -> Model:
    """About `steps` steps of Adam on the log loss of the mean logit of each text's chunks."""
    rng = np.random.default_rng(seed)
    share = float(np.mean(labels)) if labels else 0.5
    model = Model(rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, FILTERS).astype(np.float32), 0.0)
    if not texts or not 0 < share < 1:
        model.dense[:], model.offset = 0, float(np.clip(np.log(max(share, 1e-6) / max(1 - share, 1e-6)), -14, 14)) if share != 0.5 else 0.0
        return model
    model.offset = float(np.log(share / (1 - share)))
    rows = []
    for x in texts:
        rows.append(chunks(np.frombuffer(x, np.uint8)))
    first = np.cumsum([0, *map(len, rows)])
    rows, y = np.concatenate(rows), np.array(labels, np.float64)
    names = ("tables", "bias", "dense")
    m1 = {k: np.zeros_like(getattr(model, k)) for k in names} | {"offset": 0.0}
    m2 = {k: np.zeros_like(getattr(model, k)) for k in names} | {"offset": 0.0}
    epochs = -(-steps // -(-len(texts) // BATCH))
    step, total = 0, epochs * -(-len(texts) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for b in range(0, len(order), BATCH):
            docs = order[b : b + BATCH]
            own = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
            of = np.repeat(np.arange(len(docs)), first[docs + 1] - first[docs])
            x = rows[own]
            pairs, at, peak = model.pairs(), np.empty((len(x), FILTERS), np.int64), np.empty((len(x), FILTERS), np.float32)
            for i in range(0, len(x), 32):  # only the place and the value of each maximum stay
                act = activations(pairs, x[i : i + 32])
                at[i : i + 32] = act.argmax(axis=1)
                peak[i : i + 32] = np.take_along_axis(act, at[i : i + 32, None, :], 1)[:, 0, :]
            peak += model.bias
            pooled = np.maximum(peak, 0)
            count = np.bincount(of, minlength=len(docs))
            z = np.bincount(of, pooled @ model.dense + model.offset, len(docs)) / count
            err = ((1 / (1 + np.exp(-z)) - y[docs]) / len(docs) / count)[of].astype(np.float32)
            back = err[:, None] * model.dense * (peak > 0)
            grad = {"dense": pooled.T @ err + DECAY * model.dense, "bias": back.sum(0), "offset": float(err.sum()), "tables": np.zeros_like(model.tables)}
            filters = np.arange(FILTERS)
            for j in range(WIDTH):
                np.add.at(grad["tables"][j], (x[np.arange(len(x))[:, None], at + j], filters[None, :]), back)
            step += 1
            rate = RATE * (1 - step / (total + 1))
            for k in (*names, "offset"):
                m1[k] = 0.9 * m1[k] + 0.1 * grad[k]
                m2[k] = 0.999 * m2[k] + 0.001 * grad[k] ** 2
                change = rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
                setattr(model, k, getattr(model, k) - change)
    return model


def probabilities(model: Model, pairs: list[np.ndarray], texts: list[bytes]) -> np.ndarray:
    """One probability for each text, over all its chunks."""
    rows = [chunks(np.frombuffer(x, np.uint8)) for x in texts]
    if not rows:
        return np.zeros(0)
    first = np.cumsum([0, *map(len, rows)])[:-1]
    z = np.add.reduceat(logits(model, pairs, np.concatenate(rows)), first) / np.array([len(x) for x in rows])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most `sample` rows (text, quality) that may be learned from."""
    known = labels.where("doc_id is not null and quality is not null").where(crc_mod(F.col("doc_id"), 5) != 0).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    rows = training_rows(docs, labels, sample)
    got = rows.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("text"), F.col("quality").cast("int").alias("quality")).collect()
    got.sort(key=lambda r: r.doc_id)
    return fit([bytes(r.text) for r in got], [r.quality for r in got])


def score(docs: DataFrame, model: Model, to: str = "score") -> DataFrame:
    """docs with a last column of scores, which replaces one of its name; all other columns pass through as they are."""
    at, kept = docs.columns.index("text"), [f for f in docs.schema.fields if f.name != to]
    names = [f.name for f in kept]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{to}` double"])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size, about 100 kB

    def run(parts):
        model, tables = sent.value, None
        for part in (x for whole in parts for x in slices(whole, at)):
            tables = tables or model.pairs()
            texts = [x.encode("utf-8", "surrogatepass") for x in pc.fill_null(part.column(at), "").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in names), pa.array(probabilities(model, tables, texts))], names=[*names, to])
        del tables
        give_back()

    return docs.mapInArrow(run, schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model)
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
