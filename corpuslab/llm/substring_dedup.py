"""Substring de-duplication: windows of words that also start in a document of smaller id, by super-k-mers.

A window is ``WINDOW`` consecutive words; its minimiser is the run of ``MINIMISER`` words in it whose hash is least.
Consecutive windows with one minimiser are a super-k-mer. Equal windows have equal minimisers, so only super-k-mers whose
minimiser occurs in two documents or more can hold a repeated window. Which those are is counted by minimiser, and a bitmap
sized by their number tells it to all tasks (a collision sends too much, never too little). Each such super-k-mer travels
once, as one packed string, to the bucket of its minimiser. A bucket's task sorts the super-k-mers, takes one minimiser after
the other, compares windows as word sequences and reports the least document of each.

Minimisers of very many super-k-mers would make hot buckets. Of these the windows of each task's super-k-mers are counted
first, by 128-bit hashes of their word sequences: only the least document of each distinct window travels, and those of two
documents or more, the repeated ones, meet the super-k-mers again, bucket by bucket, which are read through and not held. The
buckets of the very hottest minimisers are dealt out by document, with a copy of the repeated windows for each part. From how
many super-k-mers on this is done is ``SPREAD``, or more if over ``SPREAD_MOST`` minimisers had as many.

Ids that repeat are one document: its windows don't remove its own words. Null ids take no part in the comparison and
keep all words; null or empty texts have no words. Nothing is removed from texts of fewer than ``WINDOW`` words; very long
ones are compared whole. Of documents with equal windows the least id keeps them, so there are no ties. Columns other than
doc_id and text don't matter, whatever their names; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Bitmap, ascii_words, gather, mixed, rolling, shared_folder, steps, texts, word_hash, written
from .words import ExactWords

WINDOW, MINIMISER = 50, 10
#: Super-k-mers of one minimiser from which it is hot, minimisers that are at most, super-k-mers of a part of one that is dealt out, and its parts at most.
SPREAD, SPREAD_MOST, PART, PARTS = 512, 1 << 22, 4096, 1024
_STEP = 8 << 20


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


class Windows:
    """The super-k-mers of a batch: row, first window and number of windows of each, by position in ``words``."""

    def __init__(self, column: pa.Array, window: int, m: int):
        self.words, self.window = ExactWords(column), window
        hashes, offsets = self.words.hashes, self.words.offsets
        row = np.repeat(np.arange(len(column)), np.diff(offsets))
        if len(hashes) < window:
            self.minimiser, self.start, self.count, self.row = np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
            return
        least = _least(rolling(hashes, m), window - m + 1)
        inside = offsets[1:][row[: len(least)]] - np.arange(len(least)) >= window
        new = inside.copy()
        new[1:] &= ~inside[:-1] | (row[1 : len(least)] != row[: len(least) - 1]) | (least[1:] != least[:-1])
        self.start = np.flatnonzero(new)
        # A super-k-mer ends where the next starts or a window no longer fits.
        edge = np.flatnonzero(new | ~inside)
        after = np.append(edge, len(least))[np.searchsorted(edge, self.start, side="right")]
        self.minimiser, self.count, self.row = least[self.start], after - self.start, row[self.start]


def _window_hashes(words: ExactWords, window: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each run of ``window`` words, as two halves."""
    return rolling(words.hashes, window), rolling(mixed(words.hashes + np.uint64(1)), window)


class Maps:
    """Which minimisers two documents or more have, which of them are hot, which are dealt out, and in how many parts."""

    def __init__(self, seen: DataFrame, spread: int, spread_most: int, part: int, bits: int):
        while seen.where(F.col("n") > spread).count() > spread_most:
            spread = 4 * spread + 1
        part = max(part, spread)
        of = lambda least: Bitmap.of(seen.where(F.col("n") > least).select("minimiser"), 16, bits)
        self.shared, self.hot, self.dealt = of(0), of(spread), of(part)
        self.parts = int(min(PARTS, max(1, -(-(seen.agg(F.max("n")).first()[0] or 0) // part))))

    def part(self, minimiser: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Which part of its bucket a super-k-mer is in."""
        return np.where(self.dealt.has(minimiser), (mixed(doc.view(np.uint64)) % np.uint64(self.parts)).astype(np.int64), 0)


def minimiser_maps(docs: DataFrame, window: int, m: int, spread: int, spread_most: int, part: int, bits: int) -> Maps:
    """From a table of all minimisers of two documents or more; three bitmaps of 2 ** ``bits`` bits each at most."""

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", _STEP):
            found = Windows(texts(batch), window, m)
            if not len(found.row):
                continue
            doc = batch.column(0).to_numpy()[found.row]
            order = np.lexsort((doc, found.minimiser))
            minimiser, doc = found.minimiser[order], doc[order]
            first = np.flatnonzero(np.append(True, minimiser[1:] != minimiser[:-1]))
            last = np.append(first[1:], len(doc)) - 1
            yield pa.RecordBatch.from_arrays([pa.array(minimiser[first].view(np.int64)), pa.array(doc[first]), pa.array(doc[last]), pa.array(last - first + 1)], ["minimiser", "a", "b", "n"])

    seen = docs.mapInArrow(occurrences, "minimiser bigint, a bigint, b bigint, n bigint").groupBy("minimiser").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("n").alias("n"))
    return Maps(written(seen.where("a < b").select("minimiser", "n"), "minimisers"), spread, spread_most, part, bits)


def _sent(docs: DataFrame, maps, window: int, m: int) -> DataFrame:
    """The super-k-mers that can hold a repeated window: bucket, part, doc_id, first word, packed words, and whether the bucket is hot."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = maps.value
        for batch in steps(batches, "text", _STEP):
            found = Windows(texts(batch), window, m)
            words, ids = found.words, batch.column(0).to_numpy()
            kept = np.flatnonzero(known.shared.has(found.minimiser)) if len(found.start) else found.start
            for at in (kept[i : i + 20_000] for i in range(0, len(kept), 20_000)):
                start, row, minimiser = found.start[at], found.row[at], found.minimiser[at]
                own = [words.text(a, n) for a, n in zip(start.tolist(), (found.count[at] + window - 1).tolist(), strict=True)]
                columns = (minimiser.view(np.int64), known.part(minimiser, ids[row]), ids[row], (start - words.offsets[row]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(own, pa.binary()).cast(pa.string()), pa.array(known.hot.has(minimiser))], ["bucket", "part", "doc_id", "start", "words", "hot"])

    return docs.mapInArrow(packed, _SENT)


_SENT = "bucket bigint, part bigint, doc_id bigint, start int, words string, hot boolean"


def _in_rows(words: ExactWords, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the windows of each row, and the row of each."""
    count = np.maximum(np.diff(words.offsets) - window + 1, 0)
    return gather(words.offsets[:-1], count), np.repeat(np.arange(len(count)), count)


def _repeated_windows(hot: DataFrame, maps, window: int) -> DataFrame:
    """bucket, part, h1, h2 and the least document of each window of the hot buckets that two documents have, for each part of its bucket."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def merged() -> tuple[np.ndarray, ...]:
            bucket, h1, h2, a, b = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((h2, h1, bucket))
            bucket, h1, h2, a, b = bucket[order], h1[order], h2[order], a[order], b[order]
            first = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
            return bucket[first], h1[first], h2[first], np.minimum.reduceat(a, first), np.maximum.reduceat(b, first)

        def rows() -> pa.RecordBatch:
            bucket, h1, h2, a, b = held[0]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (bucket, h1.view(np.int64), h2.view(np.int64), a, b)], ["bucket", "h1", "h2", "a", "b"])

        for batch in steps(batches, "words", _STEP):
            words = ExactWords(texts(batch, "words"))
            at, of = _in_rows(words, window)
            h1, h2 = _window_hashes(words, window)
            doc = batch.column(1).to_numpy()[of]
            held.append((batch.column(0).to_numpy()[of], h1[at], h2[at], doc, doc))
            if sum(len(x[0]) for x in held) > 1 << 20:
                held = [merged()]
                if len(held[0][0]) > 1 << 19:
                    yield rows()
                    held = []
        if held:
            held = [merged()]
            yield rows()

    def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = maps.value
        for batch in batches:
            dealt = known.dealt.has(batch.column(0).to_numpy().view(np.uint64))
            times = np.where(dealt, known.parts, 1)
            each = batch.take(pa.array(np.repeat(np.arange(len(times)), times)))
            yield pa.RecordBatch.from_arrays([each.column(0), pa.array(gather(np.zeros(len(times), np.int64), times)), *each.columns[1:]], ["bucket", "part", "h1", "h2", "a"])

    found = hot.select("bucket", "doc_id", "words").mapInArrow(counted, "bucket bigint, h1 bigint, h2 bigint, a bigint, b bigint")
    found = found.groupBy("bucket", "h1", "h2").agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a < b").drop("b")
    return found.mapInArrow(copied, "bucket bigint, part bigint, h1 bigint, h2 bigint, a bigint")


def _lost(hot: DataFrame, first: DataFrame, window: int) -> DataFrame:
    """Ranges of the hot buckets' windows that a smaller document has, by the repeated windows ``first``: these come before the super-k-mers of each part of a bucket, and stay in mind while the super-k-mers pass."""
    empty = F.lit(None)
    known = first.select("bucket", "part", F.lit(0).alias("kind"), "h1", "h2", F.col("a").alias("doc_id"), empty.cast("int").alias("start"), empty.cast("string").alias("words"))
    passing = hot.select("bucket", "part", F.lit(1).alias("kind"), empty.cast("bigint").alias("h1"), empty.cast("bigint").alias("h2"), "doc_id", "start", "words")

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        table: tuple[np.ndarray, ...] | None = None
        for batch in steps(batches, "words", _STEP):
            bucket, part, kind, doc = (batch.column(i).to_numpy() for i in (0, 1, 2, 5))
            h1, h2, start = (batch.column(i).fill_null(0).to_numpy() for i in (3, 4, 6))
            words = ExactWords(texts(batch, "words"))
            w1, w2 = _window_hashes(words, window)
            at, of = _in_rows(words, window)
            edges = np.searchsorted(of, np.arange(batch.num_rows + 1))
            lost_doc, lost_start = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            new = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])))
            for low, high in zip(new.tolist(), [*new[1:].tolist(), batch.num_rows], strict=True):
                if (bucket[low], part[low]) != now:
                    now, held, table = (bucket[low], part[low]), [], None
                split = low + int(np.searchsorted(kind[low:high], 1))
                if split > low:
                    held.append((h1[low:split].view(np.uint64), h2[low:split].view(np.uint64), doc[low:split]))
                    table = None
                if split == high or not held:
                    continue
                if table is None:
                    table = tuple(np.concatenate(x) for x in zip(*held, strict=True))
                    order = np.lexsort((table[1], table[0]))
                    table = tuple(x[order] for x in table)
                    held = [table]
                own, row = at[edges[split] : edges[high]], of[edges[split] : edges[high]]
                place = np.searchsorted(table[0], w1[own])
                for _ in range(2):  # of equal first halves, which hardly ever occur, the next is tried
                    place = np.minimum(place, len(table[0]) - 1)
                    hit = (table[0][place] == w1[own]) & (table[1][place] == w2[own])
                    if not ((table[0][place] == w1[own]) & ~hit).any():
                        break
                    place = np.where((table[0][place] == w1[own]) & ~hit, place + 1, place)
                hit &= table[2][place] < doc[row]
                lost_doc.append(doc[row[hit]])
                lost_start.append(start[row[hit]].astype(np.int64) + own[hit] - words.offsets[row[hit]])
            yield _ranges(np.concatenate(lost_doc), np.concatenate(lost_start), window)

    rows = known.union(passing).repartition("bucket", "part").sortWithinPartitions("bucket", "part", "kind")
    return rows.mapInArrow(looked_up, "doc_id bigint, start int, end int")


def _ranges(doc: np.ndarray, start: np.ndarray, window: int) -> pa.RecordBatch:
    """Windows at ``start`` of ``doc`` as ranges of words, adjoining and overlapping ones as one."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] - start[:-1] > window)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1 if len(first) else first
    return pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(start[first], pa.int32()), pa.array(start[last] + window, pa.int32())], ["doc_id", "start", "end"])


def _repeated(super_kmers: pa.Table, window: int) -> pa.RecordBatch:
    """Of the super-k-mers of some whole buckets: the ranges of words in windows that a smaller document has too."""
    words = ascii_words(super_kmers["words"].combine_chunks().cast(pa.large_string()) if super_kmers.num_rows else pa.array([], pa.large_string()))
    begin = super_kmers["start"].to_numpy().astype(np.int64)
    length = np.diff(words.offsets)
    count = length - window + 1
    at = gather(words.offsets[:-1], count)
    of = np.repeat(np.arange(len(count)), count)
    doc, start = super_kmers["doc_id"].to_numpy()[of], at - words.offsets[of]
    # Sorted by the hash of the window and the document; windows of one hash are then compared word by word.
    hashes = np.fromiter(map(word_hash, words.vocabulary), np.uint64, len(words.vocabulary))[words.codes]
    key = rolling(hashes, window)[at] if len(at) else np.zeros(0, np.uint64)
    order = np.lexsort((doc, key))
    key, doc, start, at, of = key[order], doc[order], start[order], at[order], of[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(key) else np.zeros(0, np.int64)
    same = np.ones(len(key), bool)
    codes = words.codes.astype(np.int32)
    later = np.flatnonzero(doc[first] < doc)
    for k in range(window):
        same[later] &= codes[at[later] + k] == codes[at[first[later]] + k]
    hit = np.zeros(len(key), bool)
    hit[later] = same[later]
    for i in np.unique(first[later[~same[later]]]).tolist():  # two sequences of one hash: by their words
        group = np.arange(i, np.append(np.flatnonzero(new), len(key))[np.searchsorted(np.flatnonzero(new), i, side="right")])
        _, inverse = np.unique(codes[at[group][:, None] + np.arange(window)], axis=0, return_inverse=True)
        least = np.full(inverse.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, inverse.ravel(), doc[group])
        hit[group] = least[inverse.ravel()] < doc[group]
    return _ranges(doc[hit], begin[of[hit]] + start[hit], window)


def repeated_ranges(docs: DataFrame, *, window: int = WINDOW, m: int = MINIMISER, spread: int = SPREAD, spread_most: int = SPREAD_MOST, part: int = PART, step: int = _STEP, bits: int = 28) -> DataFrame:
    """doc_id, start, end (exclusive) of word ranges covered by windows that a document of smaller id has too; they may overlap."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    maps = docs.sparkSession.sparkContext.broadcast(minimiser_maps(docs, window, m, spread, spread_most, part, bits))
    path = shared_folder(docs.sparkSession, "windows")
    _sent(docs, maps, window, m).write.option("compression", "zstd").partitionBy("hot").parquet(path)
    sent = docs.sparkSession.read.schema(_SENT).parquet(path)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([pa.RecordBatch.from_arrays(batch.columns, ["bucket", "doc_id", "start", "words"])]))
            size += batch.nbytes
            if size < step:
                continue
            # Whole buckets go; of the last, which may go on, the rows stay.
            rows = pa.concat_tables(held).combine_chunks()
            bucket = rows["bucket"].to_numpy()
            cut = len(bucket) - int(np.argmax(bucket[::-1] != bucket[-1])) if bucket[0] != bucket[-1] else 0
            if cut:
                yield _repeated(rows.slice(0, cut), window)
            held = [rows.slice(cut)]
            size = held[0].nbytes if cut else 0
        if held:
            yield _repeated(pa.concat_tables(held), window)

    by_bucket = sent.where("NOT hot").select("bucket", "doc_id", "start", "words").repartition("bucket").sortWithinPartitions("bucket", "doc_id")
    ranges = by_bucket.mapInArrow(counted, "doc_id bigint, start int, end int")
    hot = sent.where("hot")
    return ranges.union(_lost(hot, _repeated_windows(hot, maps, window), window))


def with_ranges(docs: DataFrame, **options) -> DataFrame:
    """``docs`` (doc_id, text) with the array ``ranges`` of what is to be removed."""
    ranges = written(repeated_ranges(docs, **options), "ranges")
    # A document has no more ranges than windows.
    by_doc = ranges.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("ranges"))
    return docs.join(by_doc, "doc_id", "left")


def _kept(words: list[str], ranges: list[dict] | None) -> list[str]:
    out, at = [], 0
    for r in ranges or ():
        out += words[at : max(at, r["start"])]
        at = max(at, r["end"])
    return out + words[at:]


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """Options as of :func:`repeated_ranges`. doc_id, n_words, n_removed, kept (the words left, joined by one space) and its SHA-256, for each row of ``docs``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        separators = str.maketrans(dict.fromkeys("\t\n\x0b\x0c\r", " "))
        for batch in steps(batches, "text"):
            total, removed, kept = [], [], []
            for text, ranges in zip(texts(batch).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = [w for w in text.translate(separators).split(" ") if w]
                left = _kept(words, ranges)
                total.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(" ".join(left))
            digests = [hashlib.sha256(k.encode()).hexdigest() for k in kept]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    found = with_ranges(docs.select("doc_id", "text"), **options).select("doc_id", "text", "ranges")
    return found.mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept string, kept_sha256 string")


def repeat_report(docs: DataFrame, **options) -> DataFrame:
    return remove_repeats(docs, **options).select("doc_id", "n_words", "n_removed", "kept_sha256")
