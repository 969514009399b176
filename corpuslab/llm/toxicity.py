"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the slots of its one- to three-word sequences and of word pairs with one word between them, each
and of the stems of longer words, present or not. FTRL-proximal keeps a learning rate for each slot, and its L1 term leaves most weights exactly zero, so the
model is the few slots that are not: at most ``2 ** bits`` pairs, which is the bound of what is broadcast.

The model is fitted by one task on at most ``most`` labelled documents (those with the least hash of their id); the rest of
the work, scoring, is one pass over whole texts without a shuffle. Null and empty texts have no feature, so their score is
the base rate's. A document that several label rows call differently counts as toxic. Without labels all scores are 0. Rows
of one id each have their own score; very long texts are scored whole, and ties of the hash of ids go to the smaller id.
Other columns stay as they are but for one named as the score, which is replaced. No rows give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .shared import mixed, steps, texts, word_hashes

BITS = 20
#: Documents that the model is fitted on, at most.
MOST = 16_000
THRESHOLD = 0.3
#: A word's first letters, as many, stand for its inflections and compounds.
STEMS = (4, 5, 6)
_SKIP = np.uint64(0xD6E8FEB86659FD93)
_NEXT = np.uint64(0x9E3779B97F4A7C15)


def slots(column: pa.Array, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature the slots of all rows, and the row of each (repeats stay)."""
    one, offsets, stems = word_hashes(column, STEMS)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    slot = lambda x: (mixed(x) >> np.uint64(64 - bits)).astype(np.int32)
    yield slot(one), row
    for stem in stems:
        kept = np.flatnonzero(stem)
        yield slot(stem[kept]), row[kept]
    same = row[:-1] == row[1:]
    two = one[:-1] * _NEXT + one[1:]
    yield slot(two[same]), row[:-1][same]
    same = row[:-2] == row[2:]
    yield slot((two[:-1] * _NEXT + one[2:])[same]), row[:-2][same]
    yield slot((one[:-2] * _SKIP + one[2:])[same]), row[:-2][same]


class Ftrl:
    """FTRL-proximal (McMahan et al., 2013) for logistic loss and features that are present or not."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 8.0, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)  # the last is the constant, without L1

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, l1 = self.z[at], np.where(at == len(self.z) - 1, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def training_rows(docs: DataFrame, labels: DataFrame, most: int, learn: Column) -> DataFrame:
    """Text and label of at most ``most`` labelled documents for which ``learn`` holds, by the least hash of their id."""
    ids = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    ids = ids.withColumn("_order", F.xxhash64("doc_id")).orderBy("_order", "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", F.col("_toxic").cast("int").alias("toxic"), "_order", "doc_id")


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, most: int = MOST, bits: int = BITS, passes: int = 4, learn: Column | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Slots with a weight other than zero, and the weights; the constant is slot ``2 ** bits``."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            pairs = np.unique(np.concatenate([(row.astype(np.int64) << bits) | at for at, row in slots(texts(batch), bits)]))
            cuts = np.searchsorted(pairs >> bits, np.arange(1, batch.num_rows))
            packed = [zlib.compress(np.diff(x, prepend=0).astype("<u4").tobytes(), 1) for x in np.split(pairs & ((1 << bits) - 1), cuts)]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), *(batch.column(k) for k in (1, 2, 3))], ["slots", "toxic", "_order", "doc_id"])

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, rows = Ftrl(1 << bits), []
        for batch in batches:
            rows += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        size = np.array([1 << bits])
        for _ in range(passes if rows else 0):
            for packed, label in rows:
                model.learn(np.concatenate([np.cumsum(np.frombuffer(zlib.decompress(packed), "<u4"), dtype=np.int64), size]), int(label > 0))
        at = np.flatnonzero(model.z)
        w = model.weights(at)
        yield pa.RecordBatch.from_arrays([pa.array(at[w != 0]), pa.array(w[w != 0])], ["slot", "weight"])

    rows = training_rows(docs, labels, most, ~held_out() if learn is None else learn)
    model = rows.mapInArrow(features, "slots binary, toxic int, _order bigint, doc_id bigint").repartition(1).sortWithinPartitions("_order", "doc_id", "slots")
    found = model.mapInArrow(learned, "slot bigint, weight double").toPandas()
    return found["slot"].to_numpy(), found["weight"].to_numpy()


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], *, bits: int = BITS, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with a column ``score`` (replaced if there): the probability that the text is toxic."""
    docs = docs.drop(score)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = shared.value
        weights = np.zeros((1 << bits) + 1)
        weights[at] = w
        carried = weights != 0
        for batch in steps(batches, text):
            pairs = []
            for found, row in slots(texts(batch, text), bits):
                kept = np.flatnonzero(carried[found])
                pairs.append((row[kept].astype(np.int64) << bits) | found[kept])
            pairs = np.unique(np.concatenate(pairs))
            total = np.bincount(pairs >> bits, weights[pairs & ((1 << bits) - 1)], batch.num_rows) + weights[-1]
            out = 1 / (1 + np.exp(-np.clip(total, -35, 35))) if len(at) else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, score])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(score, DoubleType())]))


def toxicity_report(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score and predicted, one row for each row of ``docs``; learned only from rows not held out."""
    out = scored(docs.select("doc_id", "text"), fit(docs, labels, **options))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
