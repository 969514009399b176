"""Benchmark decontamination: item-sized windows of documents, found by SimHash and verified by their weighted shingles.

For an item of n words the windows of a document are its runs of n words. Item and window have a SimHash fingerprint of
``BITS`` bits over their five-word shingles, weighed as for near duplicates (document frequencies are those of the items); a
document's fingerprints are rolled from sums up to each word. A multi-index finds all fingerprints within ``RADIUS``: of
``BLOCKS`` blocks of bits one differs in at most RADIUS // BLOCKS bits, so items are listed in each block under all values
``LISTED`` bits away, and looked up by all values that lie as far again as is missing. Of the pairs that it yields those within
the radius are compared in full, and a window whose exact weighted Jaccard similarity with the item is ``SIMILARITY`` or more
is a leak.

At a similarity of 0.8 fingerprints differ in some 29 of 192 bits, with a standard deviation of 5; the radius is 47. Of
unlike fingerprints a block lists one in 95, all blocks one in 7, and none in 10 ** 11 lies within the radius.

A window that is as similar shares a shingle with the item, so fingerprints are made only around the items' shingles; this
loses nothing, and without it each word would need a fingerprint for each length of an item. Items go out in blocks of at
most ``ITEM_BYTES`` of text, each a scan of the documents without a shuffle. A very long document is worked on in runs of
``REGION`` words and what a window more needs, so memory is bounded by that.

Null or empty texts have no words, items without words leak nowhere, items of under five words leak where all their words
stand together. A document shorter than an item is one window. Repeated items and documents each count; of windows equally
similar the first is reported. Columns other than those named don't matter, whatever their names. No rows, no leaks.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SHINGLE_WORDS, SIMILARITY, WordWeights, fresh, gather, mixed, rolling, shared_folder, steps, texts, word_hashes

BITS, RADIUS, BLOCKS, LISTED = 192, 47, 12, 1
ITEM_BYTES, REGION = 8 << 20, 1 << 13
_TABLE_BITS = 20
_LANES = BITS // 64


def _signs(shingle: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each shingle's hash."""
    lanes = np.stack([mixed(shingle + np.uint64(k)) for k in range(_LANES)], 1)
    return np.unpackbits(lanes.view(np.uint8), axis=1).astype(np.float32) * 2 - 1


def _packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(np.uint64)


class HammingIndex:
    """All fingerprints (rows of 64-bit integers) within ``radius`` of another, by blocks of 16 bits."""

    WIDTH = 16

    def __init__(self, fingerprints: np.ndarray, radius: int = RADIUS, blocks: int = BLOCKS, listed: int = LISTED):
        self.fingerprints, self.radius = fingerprints, radius
        near = lambda most: np.array([sum(1 << b for b in bits) for n in range(most + 1) for bits in combinations(range(self.WIDTH), n)], np.int64)
        self.asked = near(radius // blocks - listed)
        # By block and value the items listed there, one after the other.
        n, values = len(fingerprints), near(listed)
        slot = (np.arange(blocks)[None, :, None] << self.WIDTH) + (self._blocks(fingerprints)[:, :, None] ^ values)
        item = np.broadcast_to(np.arange(n)[:, None, None], slot.shape).ravel()
        order = np.argsort(slot.ravel(), kind="stable")
        self.slots, first = np.unique(slot.ravel()[order], return_index=True)
        self.items, self.edges = item[order], np.append(first, len(order))

    def _blocks(self, fingerprints: np.ndarray) -> np.ndarray:
        return fingerprints.view(np.uint16).astype(np.int64)

    def candidates(self, fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (position in ``fingerprints``, position in the index) that the blocks list, each once."""
        found = [np.zeros(0, np.int64)]
        blocks = self._blocks(fingerprints)
        for k in range(blocks.shape[1]):
            slot = (k << self.WIDTH) + (blocks[:, k, None] ^ self.asked)
            at = np.searchsorted(self.slots, slot)
            hit, which = np.nonzero(self.slots[np.minimum(at, len(self.slots) - 1)] == slot)
            at = at[hit, which]
            count = self.edges[at + 1] - self.edges[at]
            found.append(np.unique(np.repeat(hit, count) * len(self.fingerprints) + self.items[gather(self.edges[at], count)]))
        return np.divmod(np.unique(np.concatenate(found)), max(len(self.fingerprints), 1))

    def within(self, fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (position in ``fingerprints``, position in the index) that differ in at most ``radius`` bits."""
        pairs = [(np.zeros(0, np.int64),) * 2]
        for i in range(0, len(fingerprints), 1024):
            a, b = self.candidates(fingerprints[i : i + 1024])
            near = np.bitwise_count(fingerprints[a + i] ^ self.fingerprints[b]).sum(1) <= self.radius
            pairs.append((a[near] + i, b[near]))
        return tuple(np.concatenate(x) for x in zip(*pairs, strict=True))


class Items:
    """A block of benchmark items, ready to be looked for."""

    def __init__(self, ids: list, column: pa.Array, weights: WordWeights):
        self.weights = weights
        words, offsets, _ = word_hashes(column)
        word_weights = weights.of_words(words)
        self.ids, self.length = [], []
        self.short: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        self.counts: list[dict[int, float]] = []
        self.total: list[float] = []
        fingerprints, of, owner = [], [], []
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            if 0 < b - a < SHINGLE_WORDS:
                self.short[b - a][int(rolling(words[a:b], b - a)[0])].append(ids[i])
            if b - a < SHINGLE_WORDS:
                continue
            shingle = rolling(words[a:b], SHINGLE_WORDS)
            weight = self._means(word_weights[a:b])
            fingerprints.append(_packed((_signs(shingle) * weight[:, None]).sum(0, keepdims=True))[0])
            of.append(shingle)
            owner.append(np.full(len(shingle), len(self.ids)))
            self.counts.append(Counter(shingle.tolist()))
            self.total.append(float(weight.sum()))
            self.ids.append(ids[i])
            self.length.append(b - a)
        self.length = np.array(self.length, np.int64)
        every, owners = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (of, owner))
        order = np.argsort(every, kind="stable")
        self.shingles, self.owners = every.astype(np.uint64)[order], owners.astype(np.int64)[order]
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[(self.shingles >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
        self.by_length = {int(n): np.flatnonzero(self.length == n) for n in np.unique(self.length)}
        self.index = {n: HammingIndex(np.array(fingerprints, np.uint64)[k]) for n, k in self.by_length.items()}

    @staticmethod
    def _means(weight: np.ndarray) -> np.ndarray:
        """The weight of each shingle."""
        return np.convolve(weight, np.full(SHINGLE_WORDS, 1 / SHINGLE_WORDS), "valid")

    def _hits(self, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the items' shingles, and the lengths of items that have them (a position for each length)."""
        at = np.flatnonzero(self.table[(shingle >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        low, high = (np.searchsorted(self.shingles, shingle[at], side) for side in ("left", "right"))
        at, low, count = at[high > low], low[high > low], (high - low)[high > low]
        owners = self.owners[gather(low, count)]
        pairs = np.unique(np.stack([np.repeat(at, count), self.length[owners]], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
        return pairs[:, 0], pairs[:, 1]

    def _similarity(self, item: int, window: np.ndarray, weight: np.ndarray) -> float:
        own, both, seen = self.counts[item], 0.0, Counter()
        for s, w in zip(window.tolist(), weight.tolist(), strict=True):
            seen[s] += 1
            if seen[s] <= own.get(s, 0):
                both += w
        return both / (self.total[item] + float(weight.sum()) - both)

    def _near(self, words: np.ndarray, hits: np.ndarray, n: int) -> Iterator[tuple[int, int, float]]:
        """First word, item and similarity of windows that hold one of ``hits`` and lie within the radius of an item of ``n`` words."""
        size = min(n, len(words))  # words of the window
        span = size - SHINGLE_WORDS + 1  # its shingles
        cover = np.zeros(len(words) - size + 2, np.int32)
        np.add.at(cover, np.maximum(hits - span + 1, 0), 1)
        np.add.at(cover, np.minimum(hits, len(words) - size) + 1, -1)
        starts = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        for part in np.split(starts, np.flatnonzero(np.diff(starts // REGION)) + 1):
            low, high = int(part[0]), int(part[-1]) + size
            own = rolling(words[low:high], SHINGLE_WORDS)
            mean = self._means(self.weights.of_words(words[low:high]))
            sums = np.concatenate([np.zeros((1, BITS)), np.cumsum(_signs(own) * mean[:, None], axis=0, dtype=np.float64)])
            part = part - low
            window, item = self.index[n].within(_packed(sums[part + span] - sums[part]))
            for w, k in zip(part[window].tolist(), self.by_length[n][item].tolist(), strict=True):
                yield low + w, k, self._similarity(k, own[w : w + span], mean[w : w + span])

    def leaks(self, column: pa.Array, similarity: float) -> list[tuple[int, object, int, float]]:
        """Row, item, first word and similarity of the most similar window of each item that leaks into a row."""
        words, offsets, _ = word_hashes(column)
        row = np.repeat(np.arange(len(column)), np.diff(offsets))
        out: list[tuple[int, object, int, float]] = []
        for n, by_hash in self.short.items():
            found = rolling(words, n)
            known = np.array(list(by_hash), np.uint64)
            first = set()
            for p in np.flatnonzero(np.isin(found, known)).tolist():
                if row[p] == row[p + n - 1]:
                    for item in by_hash[int(found[p])]:
                        if (row[p], item) not in first:
                            first.add((row[p], item))
                            out.append((int(row[p]), item, int(p - offsets[row[p]]), 1.0))
        if len(words) < SHINGLE_WORDS or not self.ids:
            return out
        at, length = self._hits(rolling(words, SHINGLE_WORDS))
        inside = row[at] == row[at + SHINGLE_WORDS - 1]
        at, length = at[inside], length[inside]
        for i in np.unique(row[at]).tolist():
            a, b = int(offsets[i]), int(offsets[i + 1])
            mine = row[at] == i
            best: dict[int, tuple[float, int]] = {}
            for n in np.unique(length[mine]).tolist():
                for w, k, s in self._near(words[a:b], at[mine & (length == n)] - a, n):
                    if s >= similarity - 1e-9 and (-s, w) < best.get(k, (0.0, 0)):
                        best[k] = (-s, w)
            out += [(i, self.ids[k], w, -s) for k, (s, w) in best.items()]
        return out


def leaks(docs: DataFrame, items: DataFrame, *, similarity: float = SIMILARITY, carry: str = "doc_id", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``carry`` of the document, item_id, start (its first word) and similarity of each item's most similar window in each document."""
    spark = docs.sparkSession
    items = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    weights = WordWeights.of(items)
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // item_bytes))
    schema = f"{carry} {docs.schema[carry].dataType.simpleString()}, item_id bigint, start int, similarity double"

    def scan(block: DataFrame) -> DataFrame:
        rows = block.toPandas().sort_values(["item_id", "text"])
        shared = spark.sparkContext.broadcast((rows["item_id"].tolist(), rows["text"].tolist(), weights))

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, item_texts, weights = shared.value
            known = Items(ids, pa.array(item_texts, pa.large_string()), weights)
            for batch in steps(batches, "text"):
                found = known.leaks(texts(batch), similarity)
                if found:
                    rows, item, start, score = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(item, pa.int64()), pa.array(start, pa.int32()), pa.array(score, pa.float64())], [carry, "item_id", "start", "similarity"])

        return docs.select(carry, "text").mapInArrow(look, schema)

    if blocks == 1:
        return scan(items)
    path = shared_folder(spark, "leaks")
    for i in range(blocks):
        scan(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i)).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def without_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without those into which an item leaks; rows are told apart by the MD5 of their text, so null ids are no matter."""
    key = fresh(docs.columns, "text_md5")
    keyed = docs.withColumn(key, F.md5("text"))
    found = leaks(keyed, items, carry=key, **options).select(key).distinct()
    return keyed.join(found, key, "left_anti").select(*docs.columns)
