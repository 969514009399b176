"""SentencePiece encoding and decoding by weighted finite-state transducers.

Three transducers are compiled from a model, as arrays of arcs:

* the normaliser: one state, arcs that copy a character, or turn a space into U+2581; a space is written before the text;
* the pieces: a trie whose arcs read a character; the arc that completes a piece returns to the start, writes its id and weighs 1;
* byte fallback: a character without a piece is one arc that writes the ids of its UTF-8 bytes and weighs 1.

The model at hand merges pairs (BPE), which no sum of piece weights alone reproduces. But a sequence of pieces is what BPE
makes of its text if and only if BPE leaves each two neighbours as they are. So the pieces' transducer has a start state for
each last piece, from which the arcs of a piece that BPE would not leave beside it weigh infinity. These arcs are not
written out but weighed as the composition meets them (``_apart``): the merges of the two pieces are undone, the latest
first, and the weight is infinite if the parts that then stand side by side would have been merged before.

Inputs are linear automata. Those of a whole batch are composed with the transducers at once, position by position, which
is a topological order of the composed lattice: from each state that has been reached with a finite weight the trie's arcs
are followed, and a completed piece relaxes the state after it in the tropical semiring (weights add along a path, the least
path wins). As BPE has one result for each prefix, at most one state of a position has a finite weight. The path is read
backwards from the end. Its ids are the library's, which tests compare id by id.

No piece holds a space after another character (checked when compiled), so all paths pass through the state before each
run of spaces. An input is cut there, and within a batch repeated parts are composed once. Decoding inverts the transducers:
each id writes its piece or byte.

Null and empty texts have no ids. U+2581 is encoded as a space, as the library does; all else decodes to the text itself.
Repeated rows each have their ids; very long texts are encoded whole, in parts. Paths have no ties: one is finite. Other columns
stay as they are but for one named as the new one, which is replaced. Models that aren't BPE, or whose normaliser has a
character map, removes extra spaces or doesn't escape spaces, or with pieces of characters that are none, raise an error.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .shared import gather, mixed, steps, texts

SPACE = "▁"
_INFINITE = np.float64(np.inf)
#: States of the composition in place of a last piece: at the start, and after a character that fell back to bytes.
_START, _BYTES = -1, -2


class Arcs:
    """From 64-bit keys to numbers, looked up for whole arrays: a hash table with linear probing. Absent keys give -1."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = np.flatnonzero(self.keys[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.values[at[put]] = keys[left[put]], values[left[put]]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, at = left[rest], (at[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], np.int32(-1))
        left = np.flatnonzero((found != keys) & (found >= 0))
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            found = self.keys[at]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[hit]]
            on = ~hit & (found >= 0)
            left, at = left[on], at[on]
        return out


class PieceTransducer:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules = model.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or model.trainer_spec.model_type != 2:
            raise ValueError("only BPE models whose normaliser keeps characters and spaces are compiled")
        kinds = type(model.pieces[0])
        self.prefix = bool(rules.add_dummy_prefix)
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        self.scores = {p.piece: p.score for p in model.pieces}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece spans a space")
        if any(c not in self.ids for p in self.ids for c in p):
            raise ValueError("a piece has a character that is no piece")
        self.pieces = list(self.ids)  # the numbers of pieces in here; ids go out
        number = {p: i for i, p in enumerate(self.pieces)}
        self.id_of = np.fromiter(self.ids.values(), np.int32, len(self.pieces))
        self._compile_trie(number)
        self._compile_merges(number)
        # What each id decodes to, as bytes.
        self.spelled = [bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else b"" if p.type in (kinds.CONTROL, kinds.UNUSED) else p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        self.spelled[self.unknown] = " ⁇ ".encode()

    def _compile_trie(self, number: dict[str, int]) -> None:
        """Arcs (state, character) -> state, and the piece that a state completes (-1: none)."""
        states = {p: i for i, p in enumerate(sorted({p[:n] for p in number for n in range(len(p) + 1)}))}
        characters = {c: i for i, c in enumerate(sorted({c for p in number for c in p}), 1)}
        self.width = len(characters) + 1
        self.character = np.zeros(0x110000, np.int64)  # by code point; 0 has no arc
        for c, i in characters.items():
            self.character[ord(c)] = i
        self.root = states[""]
        self.trie = Arcs(np.array([states[s[:-1]] * self.width + characters[s[-1]] for s in states if s]), np.array([i for s, i in states.items() if s]))
        self.final = np.full(len(states), -1, np.int64)
        for p, i in number.items():
            self.final[states[p]] = i

    def _compile_merges(self, number: dict[str, int]) -> None:
        """Of each piece the rank of the merge that makes it and the two parts; ranks of all pairs of pieces that make a piece."""
        n = len(self.pieces)
        order = np.array([-self.scores[p] for p in self.pieces], np.float64)
        self.rank = np.where([len(p) > 1 for p in self.pieces], order, _INFINITE)
        self.left, self.right, self.made = np.full(n, -1), np.full(n, -1), np.zeros(n, bool)
        for i, p in enumerate(self.pieces):
            parts, last = self._last_merge(p)
            self.made[i] = parts == [p]
            if self.made[i] and last:
                self.left[i], self.right[i] = number[last[0]], number[last[1]]
        # Pieces in whose making a merge of a higher or a shared rank comes first: their merges' order isn't their ranks'.
        shared = {r for r, k in Counter(self.rank[np.isfinite(self.rank)].tolist()).items() if k > 1}
        self.uneven = np.array([r in shared for r in self.rank.tolist()], bool)
        for i in sorted(np.flatnonzero(self.left >= 0).tolist(), key=lambda i: len(self.pieces[i])):
            for x in (self.left[i], self.right[i]):
                self.uneven[i] |= self.uneven[x] or (self.left[x] >= 0 and self.rank[x] > self.rank[i])
        pairs = [(number[p[:k]] * n + number[p[k:]], i) for p, i in number.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        self.joined = Arcs(*(np.array(x, np.int64) for x in zip(*pairs, strict=True)))
        self.odd: dict[tuple[int, int], bool] = {}

    def _last_merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """What BPE makes of a short text, and the two parts it merges last."""
        parts, last = list(text), None
        while len(parts) > 1:
            best, at = -_INFINITE, -1
            for i in range(len(parts) - 1):
                pair = parts[i] + parts[i + 1]
                if pair in self.ids and self.scores[pair] > best:
                    best, at = self.scores[pair], i
            if at < 0:
                break
            last = parts[at], parts[at + 1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, last

    def _odd_pair(self, a: int, b: int) -> bool:
        """Of pieces whose merges' order isn't their ranks'; these are few, and runs of one character."""
        if (a, b) not in self.odd:
            if len(self.odd) >= 1 << 16:
                self.odd.clear()
            one, two = self.pieces[a], self.pieces[b]
            self.odd[a, b] = self._last_merge(one + two)[0] == [one, two]
        return self.odd[a, b]

    def _apart(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether the arc of each ``piece`` from the state of its ``last`` has a finite weight."""
        ok = self.made[piece].copy()
        left = np.flatnonzero(ok & (last >= 0))
        odd = self.uneven[last[left]] | self.uneven[piece[left]]
        for i in left[odd].tolist():
            ok[i] = self._odd_pair(int(last[i]), int(piece[i]))
        left = left[~odd]
        a, b, limit = last[left], piece[left], np.full(len(left), _INFINITE)
        n = len(self.pieces)
        while len(left):
            joint = self.joined(a * n + b)
            merged = np.where(joint >= 0, self.rank[joint], _INFINITE) < limit
            ok[left[merged]] = False
            undo_a, undo_b = self.left[a] >= 0, self.left[b] >= 0
            undo_a &= ~undo_b | (self.rank[a] > self.rank[b])
            # What lies further left goes first among merges of one rank.
            limit = np.where(undo_a, self.rank[a], self.rank[b] + 0.5)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, np.where(undo_b, self.left[b], b))
            on = ~merged & (undo_a | undo_b)
            left, a, b, limit = left[on], a[on], b[on], limit[on]
        return ok

    def paths(self, points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the shortest paths through the lattices of normalised inputs (code points, one input after the other), and how many each has."""
        order = np.argsort(-lengths, kind="stable")  # the longest first, so those that go on are the first ones
        starts = (np.cumsum(lengths) - lengths)[order]
        length = lengths[order]
        node = starts + order  # each input has a state for each position and one for its end
        character = self.character[points]
        nodes = len(points) + len(lengths)
        weight, last, before = np.full(nodes, _INFINITE), np.full(nodes, _START, np.int64), np.zeros(nodes, np.int32)
        weight[node] = 0
        for at in range(int(length[0]) if len(length) else 0):
            some = np.flatnonzero(np.isfinite(weight[node[: np.searchsorted(-length, -at)] + at]))
            state, read = np.full(len(some), self.root), 0
            while len(some):
                read += 1
                c = character[starts[some] + at + read - 1]
                if read == 1 and not c.all():
                    self._relax(weight, last, before, node[some[c == 0]] + at, 1, np.full(int((c == 0).sum()), _BYTES))
                state = self.trie(state * self.width + c)
                on = state >= 0
                some, state = some[on], state[on].astype(np.int64)
                piece = self.final[state]
                ends = np.flatnonzero(piece >= 0)
                source = node[some[ends]] + at
                apart = self._apart(last[source], piece[ends])
                self._relax(weight, last, before, source[apart], read, piece[ends][apart])
                on = at + read < length[some]
                some, state = some[on], state[on]
        return self._written(points, starts, length, order, node, last, before)

    @staticmethod
    def _relax(weight: np.ndarray, last: np.ndarray, before: np.ndarray, source: np.ndarray, read: int, piece: np.ndarray) -> None:
        """Arcs from ``source`` that read as many characters and weigh 1; no two of them end in one state."""
        less = weight[source] + 1 < weight[source + read]
        to = source[less] + read
        weight[to], last[to], before[to] = weight[source[less]] + 1, piece[less], read

    def _written(self, points: np.ndarray, starts: np.ndarray, length: np.ndarray, order: np.ndarray, node: np.ndarray, last: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids along the paths that end in the inputs' last states."""
        left, at = np.flatnonzero(length > 0), length[length > 0]
        owner, position, piece = [], [], []
        while len(left):
            end = node[left] + at
            at = at - before[end]
            owner.append(order[left])
            position.append(starts[left] + at)
            piece.append(last[end])
            left, at = left[at > 0], at[at > 0]
        owner, position, piece = (np.concatenate(x[::-1]) if x else np.zeros(0, np.int64) for x in (owner, position, piece))
        by = np.argsort(position, kind="stable")  # inputs lie one after the other
        owner, position, piece = owner[by], position[by], piece[by]
        ids = np.where(piece >= 0, self.id_of[np.maximum(piece, 0)], np.int32(0))
        count = np.ones(len(ids), np.int64)
        raw = np.flatnonzero(piece == _BYTES)
        if len(raw):  # each in place of its first byte, then spread out
            fallen, of = np.unique(points[position[raw]], return_inverse=True)
            spelled = [self._fallback(chr(p)) for p in fallen.tolist()]
            size = np.array([len(s) for s in spelled])
            count[raw] = size[of]
            flat = np.array([i for s in spelled for i in s], np.int32)
            to = np.cumsum(count) - count
            ids = np.repeat(ids, count)
            ids[gather(to[raw], size[of])] = flat[gather((np.cumsum(size) - size)[of], size[of])]
        return ids.astype(np.int32), np.bincount(owner, count, len(length)).astype(np.int64)

    def _fallback(self, character: str) -> list[int]:
        own = [self.bytes.get(b) for b in character.encode("utf-8", "surrogatepass")]
        return [self.unknown] if None in own else own

    @staticmethod
    def parts(text: str) -> list[str]:
        """A normalised text, cut before each run of spaces."""
        out, spaces = [], 0
        first, *rest = text.split(SPACE)
        if first:
            out.append(first)
        for x in rest:
            spaces += 1
            if x:
                out.append(SPACE * spaces + x)
                spaces = 0
        return [*out, SPACE * spaces] if spaces else out

    def encode(self, text: str) -> list[int]:
        return self.encode_all(pa.array([text], pa.large_string()))[0].tolist()

    def encode_all(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and how many each has; each distinct part is composed once."""
        column = pc.replace_substring(column, SPACE, " ")
        split = pc.split_pattern(column, " ")
        flat = split.flatten().dictionary_encode()
        codes, offsets = flat.indices.to_numpy().astype(np.int64), split.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        vocabulary = flat.dictionary
        parts = pc.binary_join_element_wise(*(x if x is vocabulary else pa.scalar(x, pa.large_string()) for x in (SPACE, vocabulary, "")))
        lead = SPACE if self.prefix else ""
        empty = pc.index(vocabulary, pa.scalar("", pa.large_string())).as_py()
        odd = np.zeros(len(column), bool)  # rows with runs of spaces, spaces at an end, or without the space before the text
        if empty >= 0 or not self.prefix:
            odd = np.bincount(np.repeat(np.arange(len(column)), np.diff(offsets))[codes == empty], minlength=len(column)) > 0 if self.prefix else ~odd
        if odd.any():
            index: dict[str, int] = {}
            pieces = []
            for i in range(len(column)):
                if odd[i]:
                    text = column[i].as_py()
                    own = self.parts(lead + text.replace(" ", SPACE)) if text else []
                    pieces.append(np.array([index.setdefault(p, len(parts) + len(index)) for p in own], np.int64))
                else:
                    pieces.append(codes[offsets[i] : offsets[i + 1]])
            codes = np.concatenate(pieces)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
            parts = pa.concat_arrays([parts, pa.array(list(index), pa.large_string())])
        used = np.flatnonzero(np.bincount(codes, minlength=len(parts)))
        at = np.zeros(len(parts), np.int64)
        at[used] = np.arange(len(used))
        parts, codes = parts.take(pa.array(used)), at[codes]
        ids, lengths = self.paths(np.frombuffer("".join(parts.to_pylist()).encode("utf-32-le"), "<u4"), pc.utf8_length(parts).to_numpy().astype(np.int64))
        starts = np.cumsum(lengths) - lengths
        ends = np.concatenate([[0], np.cumsum(lengths[codes])])
        return ids[gather(starts[codes], lengths[codes])], np.diff(ends[offsets])

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array(ids, np.int64), np.array([len(ids)]))[0]

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        lengths = np.fromiter(map(len, self.spelled), np.int64, len(self.spelled))
        data = np.frombuffer(b"".join(self.spelled), np.uint8)
        starts = np.cumsum(lengths) - lengths
        raw = data[gather(starts[ids], lengths[ids])].tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths[ids])])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        out = (raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True))
        return [t[1:] if self.prefix and t.startswith(" ") else t for t in out]


@cache
def compiled(path: str) -> PieceTransducer:
    """The transducers of a model: a Python worker compiles them once."""
    return PieceTransducer(path)


def encoded(docs: DataFrame, model: str, *, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of its texts in a column ``ids`` (replaced if there). One pass, no shuffle."""
    docs = docs.drop(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = compiled(model)
        for batch in steps(batches, text):
            found, count = transducer.encode_all(texts(batch, text))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(found, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, ids])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(ids, ArrayType(IntegerType()))]))


def decoded(docs: DataFrame, model: str, *, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text of the ids in a column ``text`` (replaced if there); null ids give the empty text."""
    docs = docs.drop(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = compiled(model)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                lists = part.column(part.schema.get_field_index(ids))
                count = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
                found = transducer.decode_all(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), count)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string())], [*part.schema.names, text])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(text, StringType())]))


def piece_report(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, n_ids, the CRC-32 of the ids as little-endian 32-bit integers, and whether they decode to the text."""
    docs = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = compiled(model)
        for batch in steps(batches, "text"):
            column = texts(batch)
            found, count = transducer.encode_all(column)
            ends = np.concatenate([[0], np.cumsum(count)])
            raw = memoryview(found.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            back = pc.equal(pa.array(transducer.decode_all(found, count), pa.large_string()), pc.replace_substring(column, SPACE, " "))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(count, pa.int64()), pa.array(crc, pa.int64()), back], ["doc_id", "ids", "n_ids", "ids_crc32", "round_trip"])

    return docs.mapInArrow(run, "doc_id bigint, ids array<int>, n_ids bigint, ids_crc32 bigint, round_trip boolean")
