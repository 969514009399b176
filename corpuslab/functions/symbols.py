"""Words as runs of symbols, and merges of symbols that stand side by side: blocks of many words as arrays, no step for each word in Python."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .chars import points

#: Closes each word. A symbol below is a code point; those above are merged ones, by their place in a list of texts.
END = 0x110000
#: A block's row: how many symbols (with ends) and words, and the words' counts and their symbols, compressed.
BLOCK = "symbols bigint, words bigint, data binary"
#: Symbols of a block, and a batch of words more at most.
_SIZE = 1 << 20

#: Symbols of some words, each closed by END, and how often each word occurs.
Block = tuple[np.ndarray, np.ndarray]
#: Two symbols and the one that they become.
Rule = tuple[int, int, int]


def word_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of BLOCK of rows (word, count)."""

    def parts() -> Iterator[Block]:
        for batch in batches:
            counts = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b, codes, offsets in points(batch.column(0)):
                yield np.insert(codes.astype(np.int32), offsets[1:], END), counts[a:b]

    return _packed(parts())


def merged_blocks(batches: Iterable[pa.RecordBatch], rules: Sequence[Rule]) -> Iterator[pa.RecordBatch]:
    """The blocks after these merges, in their order, without words that have become one symbol."""

    def parts() -> Iterator[Block]:
        for symbols, counts in _unpacked(batches):
            symbols = merged(symbols, rules)
            length = np.diff(np.flatnonzero(symbols == END), prepend=-1)
            yield symbols[np.repeat(length > 2, length)], counts[length > 2]

    return _packed(parts())


def pair_counts(batches: Iterable[pa.RecordBatch], rules: Sequence[Rule], texts: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """How often two symbols stand side by side after these merges, as rows (text, text, count); each pair once a block. ``texts`` are those of merged symbols."""
    for symbols, counts in _unpacked(batches):
        symbols = merged(symbols, rules)
        each = np.repeat(counts, np.diff(np.flatnonzero(symbols == END), prepend=-1))
        at = np.flatnonzero((symbols[:-1] != END) & (symbols[1:] != END))
        pairs = pa.table({"pair": symbols[at].astype(np.int64) << 32 | symbols[at + 1], "n": each[at]}).group_by("pair", use_threads=False).aggregate([("n", "sum")])
        pair = pairs["pair"].to_numpy()
        columns = [_named(pair >> 32, texts), _named(pair & 0xFFFFFFFF, texts), pairs["n_sum"].combine_chunks()]
        yield pa.RecordBatch.from_arrays(columns, ["a", "b", "n"])
    pa.default_memory_pool().release_unused()


def merged(symbols: np.ndarray, rules: Sequence[Rule]) -> np.ndarray:
    """Each rule's pairs become one symbol, from the left, where they overlap (runs of one symbol) every other one."""
    for a, b, new in rules:
        at = np.flatnonzero((symbols[:-1] == a) & (symbols[1:] == b))
        if len(at):
            first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            within = np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))
            at = at[within % 2 == 0]
            symbols = np.delete(symbols, at + 1)
            symbols[at - np.arange(len(at))] = new
    return symbols


def _named(ids: np.ndarray, texts: Sequence[str]) -> pa.Array:
    distinct, index = np.unique(ids, return_inverse=True)
    return pc.take(pa.array([chr(i) if i < END else texts[i - END - 1] for i in distinct.tolist()], pa.string()), pa.array(index))


def _packed(parts: Iterator[Block]) -> Iterator[pa.RecordBatch]:
    def row() -> pa.RecordBatch:
        symbols, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        data = pa.compress(counts.astype(np.int64).tobytes() + symbols.tobytes(), "zstd", asbytes=True)
        return pa.RecordBatch.from_arrays([pa.array([len(symbols)], pa.int64()), pa.array([len(counts)], pa.int64()), pa.array([data], pa.binary())], ["symbols", "words", "data"])

    held: list[Block] = []
    for part in parts:
        held.append(part)
        if sum(len(symbols) for symbols, _ in held) >= _SIZE:
            yield row()
            held = []
    if sum(len(symbols) for symbols, _ in held):
        yield row()
    pa.default_memory_pool().release_unused()


def _unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for size, words, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            raw = pa.decompress(data.as_buffer(), 4 * size + 8 * words, "zstd")
            yield np.frombuffer(raw, np.int32, size, 8 * words), np.frombuffer(raw, np.int64, words)
