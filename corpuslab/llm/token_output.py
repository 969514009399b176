"""Token ids as ORC files: run-length encoded integers, row indexes, Bloom filters on document ids.

Files are ordered as the documents are: ids of file k come before those of file k + 1. Within a file, ``pos`` counts the
documents from 0. ORC keeps integer lists as run-length encoded streams in stripes, which Spark reads in parallel; stripe
and row-index statistics and the Bloom filter let a reader skip what can't hold a document id.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Words, ascii_words, gather, shared_folder, steps, texts

FILE_SCHEMA = "doc_id bigint, pos bigint, n_tokens int, ids array<int>"
#: A word that is letters up to U+00FF and perhaps punctuation after them: two tokens before BPE, both normalised by lower-casing.
_SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")


def _byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordEncoder:
    """Encodes batches of texts, each distinct word of a batch once.

    The tokenizer turns white space into a space, splits there, and no token spans it; so a text's ids are those of its
    words, one after the other. Simple words go straight to the tokenizer's BPE model, all others through the whole
    tokenizer. Only for tokenizers with that property, whose words end in a suffix; others take :meth:`whole`.
    """

    def __init__(self, path: str, step: int = 2000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.full, self.step = Tokenizer.from_file(path), step
        suffix = getattr(self.full.model, "end_of_word_suffix", None)
        self.by_word = bool(suffix)
        if self.by_word:
            self.bare = Tokenizer(self.full.model)
            self.bare.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
            vocabulary = self.full.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
            self.letters = str.maketrans(dict(enumerate(_byte_letters())))

    def whole(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and how many each has, by the whole tokenizer."""
        ids = [e.ids for e in self.full.encode_batch_fast(column.to_pylist(), add_special_tokens=False)]
        return np.fromiter((i for x in ids for i in x), np.int32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = []
        mapped = [u if u.isascii() else u.encode().decode("latin-1").translate(self.letters) for u in units]
        for e in self.bare.encode_batch_fast([" ".join(mapped[i : i + self.step]) for i in range(0, len(mapped), self.step)], add_special_tokens=False):
            parts.append(np.array(e.ids, np.int32))
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(units):
            raise ValueError("the tokenizer's words don't end in its suffix")
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else np.zeros(0, np.int64)
        return ids, starts, ends - starts

    def _vocabulary(self, vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the words, where each word's start, and how many it has."""
        index: dict[str, int] = {}
        first, second, others = np.full(len(vocabulary), -1), np.full(len(vocabulary), -1), []
        for k, word in enumerate(vocabulary):
            if m := _SIMPLE.fullmatch(word):
                first[k] = index.setdefault(m[1].lower(), len(index))
                if m[2]:
                    second[k] = index.setdefault(m[2], len(index))
            elif word:
                others.append(k)
        ids, starts, lengths = self._units(list(index))
        more = [e.ids for e in self.full.encode_batch_fast([vocabulary[k] for k in others], add_special_tokens=False)] if others else []
        n = len(starts)
        more_lengths = np.fromiter(map(len, more), np.int64, len(more))
        first[others] = n + np.arange(len(others))
        starts = np.concatenate([starts, len(ids) + np.cumsum(more_lengths) - more_lengths, [0]]).astype(np.int64)
        lengths = np.concatenate([lengths, more_lengths, [0]]).astype(np.int64)  # the last: no unit, for -1
        ids = np.concatenate([ids, np.fromiter((i for x in more for i in x), np.int32)])
        pair = np.stack([first, second], 1).ravel()
        flat = ids[gather(starts[pair], lengths[pair])]
        count = lengths[first] + lengths[second]
        return flat, np.cumsum(count) - count, count

    def encode(self, column: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows with ``end_id`` after each row, and how many each row has."""
        if self.by_word:
            words: Words = ascii_words(column)
            flat, starts, lengths = self._vocabulary(words.vocabulary)
            codes, count = words.codes, np.diff(words.offsets)
        else:
            flat, count = self.whole(column)
            starts, lengths, codes = np.arange(len(flat)), np.ones(len(flat), np.int64), np.arange(len(flat))
        if end_id is not None:
            codes = np.insert(codes, np.cumsum(count), len(starts))
            flat, starts, lengths = np.append(flat, np.int32(end_id)), np.append(starts, len(flat)), np.append(lengths, 1)
            count = count + 1
        sizes = np.concatenate([[0], np.cumsum(lengths[codes])])[np.concatenate([[0], np.cumsum(count)])]
        return flat[gather(starts[codes], lengths[codes])].astype(np.int32), np.diff(sizes)


@cache
def encoder_of(path: str) -> WordEncoder:
    """A Python worker loads a tokenizer once."""
    return WordEncoder(path)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 1, text: str = "text", key: str = "doc_id") -> None:
    """Encodes ``docs`` and writes the ids to ORC files under ``path``, in ascending order of ``key``.

    Null text is empty, so the document has only the end id. Null keys come first. Rows of equal keys are ordered by
    their text; equal rows are kept. Other columns take no part. An empty table gives no document.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pos = encoder_of(tokenizer), 0
        for batch in steps(batches, "text", 32 << 20):
            ids, count = encoder.encode(texts(batch), end_id)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.arange(pos, pos + len(count))), pa.array(count, pa.int32()), lists], ["doc_id", "pos", "n_tokens", "ids"])
            pos += len(count)

    ordered = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).repartitionByRange(F.col("doc_id").asc_nulls_first())
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    options = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20)}
    ordered.mapInArrow(encode, FILE_SCHEMA).write.options(**options).orc(path)


def _file() -> Column:
    """The number of a row's file: Spark names the files of a write in the order of its partitions."""
    return F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)-", 1).cast("bigint")


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows of the files; with ``doc_ids`` stripes and row groups without them are skipped by their statistics and Bloom filters."""
    tokens = spark.read.schema(FILE_SCHEMA).orc(path)
    return tokens if doc_ids is None else tokens.where(F.col("doc_id").isin(*doc_ids))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, and ids_crc32 of its ids as little-endian 32-bit integers."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            values, offsets = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            raw = memoryview(values.tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pc.cast(pa.array(np.diff(offsets)), pa.int64()), pa.array(crc, pa.int64())], ["file", "pos", "doc_id", "n_tokens", "ids_crc32"])

    tokens = read_tokens(spark, path)
    rows = tokens.select(_file().alias("file"), "pos", "doc_id", "ids").mapInArrow(digest, "file bigint, pos bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint")
    # One row for each file; a file holds as much as a task writes, so neither window grows with a key.
    files = tokens.select(_file().alias("file"), "n_tokens").groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        rows.withColumn("within", within)
        .join(files.select("file", before.alias("before")), "file")
        .select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
    )


def token_output(docs: DataFrame, tokenizer: str, *, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Writes the ORC files of ``docs`` (under ``path``, else the shared folder) and returns :func:`token_index` of them."""
    path = path or shared_folder(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id=end_id)
    return token_index(docs.sparkSession, path)
