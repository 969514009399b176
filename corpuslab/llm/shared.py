"""What the operators of this subpackage share: shared storage, Arrow batches, words and word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import mixed, word_hashes

#: Bytes of text that one step of a Python worker handles at once.
STEP_BYTES = 4 << 20
#: Words of a shingle, and the similarity from which two texts are near duplicates.
SHINGLE_WORDS = 5
SIMILARITY = 0.8

def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path for a table that all executors see, under ``spark.checkpoint.dir``.

    The setting is read from the session. Where it is unset (tests, one machine) a temporary folder becomes the
    checkpoint folder; on a cluster that would lose data, so there an unset folder is an error. The path is removed
    when the driver's JVM ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='corpuslab-')}"
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table in the shared folder: it cuts the lineage and outlives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(columns: list[str], name: str) -> str:
    """``name``, or with underscores behind it a name that ``columns`` don't have, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The text column as large strings, null as the empty text."""
    column = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(column.cast(pa.large_string()), "")


def steps(batches: Iterator[pa.RecordBatch], name: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes of text, one row at least. What Arrow holds in reserve goes back at the end, as workers live on."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0).to_numpy(zero_copy_only=False)
        step = (np.cumsum(size.astype(np.int64)) - size) // most
        edges = np.flatnonzero(np.diff(step)) + 1
        for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()


class Words:
    """Words of a batch of texts: ``codes`` index ``vocabulary``; those of row i are ``codes[offsets[i]:offsets[i + 1]]``."""

    def __init__(self, codes: np.ndarray, vocabulary: list[str], offsets: np.ndarray):
        self.codes, self.vocabulary, self.offsets = codes, vocabulary, offsets

    def mapped(self, values: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``values`` of the words for which ``keep`` holds (both by vocabulary), and the offsets of what is left."""
        kept = keep[self.codes]
        before = np.concatenate([[0], np.cumsum(kept, dtype=np.int64)])
        return values[self.codes[kept]], before[self.offsets]


def ascii_words(column: pa.Array) -> Words:
    """Words are runs without U+0020 and U+0009 to U+000D, unchanged."""
    split = pc.ascii_split_whitespace(column)
    flat = split.flatten().dictionary_encode()
    codes, offsets = flat.indices.to_numpy().astype(np.int64), split.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    vocabulary = flat.dictionary.to_pylist()
    if "" in vocabulary:  # at the ends of a text
        empty = vocabulary.index("")
        kept = codes != empty
        offsets = np.concatenate([[0], np.cumsum(kept, dtype=np.int64)])[offsets]
        codes = codes[kept]
    return Words(codes, vocabulary, offsets)


def word_hash(word: str) -> int:
    """Of a word as it is written."""
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` hashes; run i starts at i."""
    n = max(0, len(hashes) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= _FACTOR
        out += hashes[k : k + n]
    return mixed(out)


def shingles(hashes: np.ndarray, offsets: np.ndarray, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of all rows, where each starts in ``hashes``, and the row of each.

    A row with words, but fewer than ``width``, has one shingle of all its words; a row without words has none.
    """
    rows = len(offsets) - 1
    length = np.diff(offsets)
    row = np.repeat(np.arange(rows), length)
    at = np.flatnonzero(offsets[1:][row] - np.arange(len(hashes)) >= width)
    found = rolling(hashes, width)[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((length > 0) & (length < width))
    if len(short):
        extra = np.array([mixed(rolling(hashes[offsets[i] : offsets[i + 1]], int(length[i])) + length[i].astype(np.uint64))[0] for i in short], np.uint64)
        at, found = np.concatenate([at, offsets[short]]), np.concatenate([found, extra])
        order = np.argsort(at, kind="stable")
        at, found = at[order], found[order]
    return found, at, row[at]


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges [start, start + length), one after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)


class Bitmap:
    """A set of 64-bit integers by hash: ``2 ** bits`` bits, which may hold too much but never too little."""

    SLICE = 16

    def __init__(self, packed: np.ndarray, bits: int):
        self.packed, self.bits = packed, bits

    @staticmethod
    def slot(values: np.ndarray, bits: int) -> np.ndarray:
        return (mixed(values.astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)

    @classmethod
    def of(cls, values: DataFrame, least: int = 20, most: int = 28) -> Bitmap:
        """Of the one bigint column of ``values``, with 16 bits for each value, but 2 ** ``most`` (32 MB) in all.

        Beyond that it lets more pass, so whoever filters by it joins afterwards. Executors set the bits of one slice
        each; the driver gets finished slices.
        """
        bits = min(most, max(least, int(values.count()).bit_length() + 4))
        size = 1 << (cls.SLICE - 3)

        def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(cls.slot(batch.column(0).to_numpy(), bits)))], ["slot"])

        def packed(key: tuple, table: pa.Table) -> pa.Table:
            held = np.zeros(1 << cls.SLICE, bool)
            held[table["slot"].to_numpy() & ((1 << cls.SLICE) - 1)] = True
            return pa.table({"slice": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(held).tobytes()])})

        found = values.mapInArrow(slots, "slot bigint").distinct().withColumn("slice", F.shiftright("slot", cls.SLICE))
        whole = np.zeros(1 << (bits - 3), np.uint8)
        for r in found.groupBy("slice").applyInArrow(packed, "slice bigint, bits binary").toLocalIterator():
            whole[r[0] * size : (r[0] + 1) * size] = np.frombuffer(r[1], np.uint8)
        return cls(whole, bits)

    def has(self, values: np.ndarray) -> np.ndarray:
        slot = self.slot(values, self.bits)
        return (self.packed[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)


class WordWeights:
    """Relative inverse document frequencies of words, from 1 (in all documents) to 2 (in a share of them too small to tell).

    Of all pairs of a document and a word in it a word has some share. Words with a share of ``1 / SHARES`` or more have the
    weight of their document frequency, rarer ones that of exactly this share, which is the most. So the weights hang on
    shares alone and not on how many documents there are, and at most ``SHARES`` words have to be known: that bounds what is
    broadcast. A shingle's weight in a document is how often it occurs there times the mean weight of its words. Words and
    not shingles are weighed: a shingle that many copies share would else weigh next to nothing, and copies would not match.
    """

    SHARES = 1 << 17
    _SLOT_BITS = 20

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, other: float):
        order = np.argsort(hashes)
        self.hashes, self.weights, self.other = hashes[order], weights[order], other

    @classmethod
    def of(cls, docs: DataFrame, text: str = "text") -> WordWeights:
        """From the words of all rows of ``docs``."""

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, np.ndarray]] = []

            def merged() -> tuple[np.ndarray, np.ndarray]:
                word, of = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
                return word, np.bincount(of, np.concatenate([h[1] for h in held]), len(word)).astype(np.int64)

            for batch in steps(batches, text):
                hashes, offsets, _ = word_hashes(texts(batch, text))
                word, code = np.unique(hashes, return_inverse=True)
                if not len(word):
                    continue
                row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
                held.append((word, np.bincount(np.unique(row * len(word) + code) % len(word), minlength=len(word))))
                if sum(len(h[0]) for h in held) > 1 << 19:
                    held = [merged()]
                    if len(held[0][0]) > 1 << 18:
                        yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], ["word", "df"])
                        held = []
            if held:
                word, df = merged()
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(df)], ["word", "df"])

        table = written(docs.select(text).mapInArrow(counted, "word bigint, df bigint").groupBy("word").agg(F.sum("df").alias("df")), "words")
        rows, pairs = docs.count(), table.agg(F.sum("df")).first()[0] or 0
        least = pairs / cls.SHARES
        found = table.where(F.col("df") >= least).toPandas()
        rarest = min(max(least / max(rows, 1), 1e-9), 0.5)  # a share of the documents
        weigh = lambda share: 1 + np.log(np.clip(share, rarest, 1)) / np.log(rarest)
        return cls(found["word"].to_numpy(np.int64).view(np.uint64), weigh(found["df"].to_numpy(np.float64) / max(rows, 1)), 2.0)

    def __getstate__(self) -> tuple:
        return self.hashes, self.weights, self.other

    def __setstate__(self, state: tuple) -> None:
        self.hashes, self.weights, self.other = state

    def _slots(self) -> np.ndarray:
        """By the first bits of a hash where its word stands, or -1 (none), or -2 (several)."""
        if "slots" not in self.__dict__:
            at = (self.hashes >> np.uint64(64 - self._SLOT_BITS)).astype(np.int64)
            self.slots = np.full(1 << self._SLOT_BITS, -1, np.int32)
            self.slots[at] = np.arange(len(at))
            self.slots[at[1:][at[1:] == at[:-1]]] = -2
        return self.slots

    def of_words(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), self.other)
        if not len(self.hashes):
            return out
        at = self._slots()[(hashes >> np.uint64(64 - self._SLOT_BITS)).astype(np.int64)]
        several = np.flatnonzero(at == -2)
        at[several] = np.minimum(np.searchsorted(self.hashes, hashes[several]), len(self.hashes) - 1)
        known = np.flatnonzero(at >= 0)
        known = known[self.hashes[at[known]] == hashes[known]]
        out[known] = self.weights[at[known]]
        return out

    def shingles(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, hash and weight of each distinct shingle of each text, by row."""
        words, offsets, _ = word_hashes(column)
        found, at, row = shingles(words, offsets)
        weight = np.concatenate([[0.0], np.cumsum(self.of_words(words))])
        end = np.minimum(at + SHINGLE_WORDS, offsets[row + 1])
        # To a multiple of 2 ** -20, so that a shingle weighs the same wherever it stands.
        mean = np.round((weight[end] - weight[at]) / np.maximum(end - at, 1) * (1 << 20)) / (1 << 20)
        # Distinct by row: the row is mixed in, so that one sort of 64-bit integers does.
        order = np.argsort(found ^ mixed(row.astype(np.uint64)))
        found, row, mean = found[order], row[order], mean[order]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(found)))
        by_row = np.argsort(row[first], kind="stable")
        return row[first][by_row], found[first][by_row], (mean[first] * count)[by_row]


def weighted_jaccard(weights: WordWeights, a: pa.Array, b: pa.Array) -> np.ndarray:
    """The weighted Jaccard similarity of the shingles of each text of ``a`` and the text of ``b`` beside it; 0 without shingles."""
    n = len(a)
    both_columns = pa.concat_arrays([a, b]).dictionary_encode()  # a text that stands in many pairs is taken apart once
    of = both_columns.indices.to_numpy().astype(np.int64)
    row, found, weight = weights.shingles(both_columns.dictionary)
    edges = np.searchsorted(row, np.arange(len(both_columns.dictionary) + 1))
    at = gather(edges[of], np.diff(edges)[of])
    pair = np.repeat(np.arange(2 * n) % n, np.diff(edges)[of])
    found, weight = found[at], weight[at]
    order = np.argsort(found ^ mixed(pair.astype(np.uint64)))
    pair, found, weight = pair[order], found[order], weight[order]
    same = np.flatnonzero((pair[1:] == pair[:-1]) & (found[1:] == found[:-1]))
    both = np.bincount(pair[same], np.minimum(weight[same], weight[same + 1]), n)
    total = np.bincount(pair, weight, n) - both
    return np.where(total > 0, both / np.maximum(total, 1e-300), 0.0)
