"""Counts and hashes of characters over Arrow batches: arrays of code points, no step for each character in Python."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points that are handled at once.
_STEP = 1 << 20
_SPACE = [*range(9, 14), 32]


def points(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of rows: the first row and the one after the last, their code points, and each row's offset in them."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    ends = np.cumsum(pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + _STEP, side="right")))
        part = "".join(column.slice(at, to - at).to_pylist())
        yield at, to, np.frombuffer(part.encode("utf-32-le"), "<u4"), np.concatenate([[0], ends[at:to] - before])
        at = to


#: Classes of characters, of which each is in the first that fits; ``other`` is what is neither white space nor in one of them.
CLASSES = ("space", "cyrillic", "latin", "arabic", "digit", "punct", "letter", "number", "other")


@cache
def class_table() -> np.ndarray:
    def of(c: int) -> str:
        kind = unicodedata.category(chr(c))
        if c in _SPACE:
            return "space"
        if 0x400 <= c <= 0x52F:
            return "cyrillic"
        if chr(c) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz":
            return "latin"
        if 0x600 <= c <= 0x6FF or 0x750 <= c <= 0x77F:
            return "arabic"
        return {"Nd": "digit", "P": "punct", "S": "punct", "L": "letter", "N": "number"}.get(kind if kind == "Nd" else kind[0], "other")

    index = {name: i for i, name in enumerate(CLASSES)}
    return np.fromiter((index[of(c)] for c in range(0x110000)), np.uint8, 0x110000)


def class_counts(text: Column) -> Column:
    """A struct of how many characters of ``text`` are in each of CLASSES; null of null."""

    @F.arrow_udf(", ".join(f"{c} bigint" for c in CLASSES))
    def counted(column: pa.Array) -> pa.Array:
        out = np.zeros((len(column), len(CLASSES)), np.int64)
        for a, b, codes, offsets in points(column):
            row = np.repeat(np.arange(b - a), np.diff(offsets))
            out[a:b] = np.bincount(row * len(CLASSES) + class_table()[codes], minlength=(b - a) * len(CLASSES)).reshape(b - a, -1)
        fields = [pa.field(c, pa.int64()) for c in CLASSES]
        return pa.StructArray.from_arrays([pa.array(out[:, i]) for i in range(len(CLASSES))], fields=fields, mask=pc.is_null(column))

    return counted(text)


_MIX = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` code points."""
    size = max(0, len(codes) - n + 1)
    value = (codes.astype(np.uint64) + np.uint64(1)) * _MIX
    value ^= value >> np.uint64(29)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += value[k : k + size]
    out ^= out >> np.uint64(32)
    return out * _MIX


def known_windows(df: DataFrame, text: str, n: int, known: list[str]) -> DataFrame:
    """The runs of ``n`` characters of the texts that are among ``known``, each once a batch, as ``gram``; ``known`` is broadcast."""
    column = pa.array(known, pa.large_string())
    hashes = np.sort(np.concatenate([window_hashes(codes, n)[offsets[:-1]] for _, _, codes, offsets in points(column)])) if known else np.zeros(0, np.uint64)
    table = np.zeros(1 << 20, bool)
    table[(hashes >> np.uint64(44)).astype(np.int64)] = True
    shared = df.sparkSession.sparkContext.broadcast((hashes, table, frozenset(known)))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, table, texts = shared.value
        for batch in batches:
            hits: set[str] = set()
            for _, _, codes, offsets in points(batch.column(0)):
                own = window_hashes(codes, n)
                at = np.flatnonzero(table[(own >> np.uint64(44)).astype(np.int64)])
                at = at[np.isin(own[at], hashes)]
                at = at[np.searchsorted(offsets, at, side="right") == np.searchsorted(offsets, at + n - 1, side="right")]  # within one row
                _, first = np.unique(own[at], return_index=True)
                hits |= {codes[a : a + n].tobytes().decode("utf-32-le") for a in at[first].tolist()}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(hits & texts), pa.string())], ["gram"])

    return df.select(text).mapInArrow(found, "gram string")


def repeated_windows(text: Column, n: int) -> Column:
    """Of the runs of ``n`` words of a text: how many occur more than once in it (``repeated``), and how many there are (``total``); null of null. Words are told apart by their places in a batch's vocabulary, runs by 64-bit hashes of these."""

    @F.arrow_udf("repeated bigint, total bigint")
    def counted(column: pa.Array) -> pa.Array:
        split = pc.ascii_split_whitespace(pc.fill_null(column.cast(pa.large_string()), ""))
        flat = split.flatten().dictionary_encode()
        codes, offsets = flat.indices.to_numpy().astype(np.int64), split.offsets.to_numpy().astype(np.int64)
        kept = codes != pc.index(flat.dictionary, pa.scalar("", pa.large_string())).as_py()
        offsets = np.concatenate([[0], np.cumsum(kept)])[offsets - offsets[0]]
        codes = codes[kept]
        row = np.repeat(np.arange(len(column)), np.diff(offsets))
        at = np.flatnonzero(offsets[1:][row] - np.arange(len(codes)) >= n)
        own, row = window_hashes(codes, n)[at], row[at]
        order = np.lexsort((own, row))
        own, row = own[order], row[order]
        same = (own[1:] == own[:-1]) & (row[1:] == row[:-1])
        twice = np.zeros(len(own), bool)
        twice[1:] |= same
        twice[:-1] |= same
        counts = [np.bincount(row[twice], minlength=len(column)), np.bincount(row, minlength=len(column))]
        fields = [pa.field(name, pa.int64()) for name in ("repeated", "total")]
        return pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in counts], fields=fields, mask=pc.is_null(column))

    return counted(text)
