"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

Each text becomes a set of five-word shingles, weighed by how often they occur times their words' inverse document frequency
(``WordWeights``). Improved consistent weighted sampling (Ioffe, 2010) draws ``BANDS * ROWS`` samples from it, such that two
texts draw the same one with the probability of their weighted Jaccard similarity. Texts that agree on all samples of a band
share a bucket (at similarity 0.8 they miss all buckets with probability 0.0002), and a link is a pair of one bucket whose
exact weighted Jaccard similarity is ``SIMILARITY`` or more. Linked texts, and texts of one id, are one class.

Copies of one text are one node from the start. A bucket isn't expanded into pairs:

1. All its nodes are compared with one of them, its centre c: the one with the most company in all its buckets, which of a
   group of near copies is the text they were made from, as far as it is there. Links join nodes into components.
2. Only buckets of several components go on, and of those only pairs that can be links. Let W be a node's weight, U that of
   its shingles that no other node of those buckets has, s the least similarity and f = (1 - s) / (1 + s). A link means that
   (1 + s) / s * min(W(x) - U(x), W(y) - U(y)) is W(x) + W(y) or more: texts that share but a passage are done. Of what is
   left, all are compared with the bucket's node of the least share U / W, its pivot. Let D be the sum of the differences of
   a node's weights and the pivot's. A linked pair differs by f (W(x) + W(y)) at most, so what x and y have in common of
   their differences from the pivot is (D(x) + D(y) - f (W(x) + W(y))) / 2 or more, and of that nothing is in U. With
   X = D - f W and Y = D - 2 U + f W that is Y(x) >= X(y) and Y(y) >= X(x). One of x and y is not in the pivot's component, so
   the other's Y must reach the least X of such nodes: where copies have edits of their own hardly any does. What passes all
   this is compared in full, and nothing else can be a link.

Before texts are compared at all, their weights must allow the similarity, and one bit of each of the 64 samples must agree
in all but ``DIFFER``: at similarity 0.8 or more it does but for one pair in 200,000. Nothing is capped.

Null ids take no part (their class is null). Null text is empty; texts without words are like only to copies of themselves.
Very long texts are taken apart in pieces and compared whole. Columns other than doc_id and text don't matter, whatever their
names; ties of a bucket's first node go to the greater node number, which changes no class. An empty table gives no rows.
Buckets and components stay in the shared folder, never on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SIMILARITY, Bitmap, WordWeights, gather, mixed, remove, shared_folder, steps, texts, weighted_jaccard

BANDS, ROWS = 16, 4
#: Bits of 64, one of each sample, that may differ between texts that are compared.
DIFFER = 18
#: Links that one task joins into components, at most; and pairs of one node for each copy of its text.
HERE, SALT = 500_000, 256


def _e1(x: np.ndarray) -> np.ndarray:
    """The exponential integral, by its series up to 1 and by a continued fraction beyond."""
    small = np.minimum(x, 1.0)
    term, series = np.ones_like(small), np.zeros_like(small)
    for k in range(1, 30):
        term = term * -small / k
        series -= term / k
    low = series - np.euler_gamma - np.log(small)
    large, f = np.maximum(x, 1.0), np.zeros_like(x)
    for k in range(200, 0, -1):
        f = k / (1 + k / (large + f))
    return np.where(x <= 1, low, np.exp(-large) / (large + f))


class Curve:
    """A function by straight lines between its values at equal distances."""

    POINTS = 1 << 14

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.low, self.step = x[0], (x[-1] - x[0]) / (self.POINTS - 1)
        self.y = np.interp(np.linspace(x[0], x[-1], self.POINTS), x, y)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.clip((x - self.low) / self.step, 0, self.POINTS - 1.001)
        whole = at.astype(np.intp)
        y = self.y[whole]
        return y + (at - whole) * (self.y[whole + 1] - y)


@cache
def _curves() -> tuple[Curve, Curve, Curve, Curve]:
    """With p the share of z = c exp(-r) up to z: log z -> log(-log(1 - p)), its inverse, log z -> log E1(z), log E1(z) -> log z."""
    log_z = np.linspace(np.log(1e-13), np.log(30.0), 1 << 18)
    z = np.exp(log_z)
    e1 = _e1(z)
    level = np.log(-np.log(np.exp(-z) - z * e1))
    small = z < 1e-3
    level[small] = np.log(-np.log1p(-(z * e1 - np.expm1(-z))))[small]
    return Curve(log_z, level), Curve(level, log_z), Curve(log_z, np.log(e1)), Curve(np.log(e1)[::-1], log_z[::-1])


class Sampler:
    """Consistent weighted samples: of each (shingle, sample) the variates come from one hash, so all texts have the same.

    Of a shingle of weight w the method draws r, c of Gamma(2, 1) and b of [0, 1) and has the shingle with the least
    a = c exp(-r (t - b) - r), t = floor(log w / r + b). As exp(r (t - b)) <= w, a >= z / w with z = c exp(-r). The density of
    z is the exponential integral E1, and given z, c is s plus an exponential variate, where s > z has a density in
    proportion to exp(-s) / s. So z is drawn first, from one multiplication; only shingles whose z is small enough to win
    get the other variates. Where none of them is under the bound, the bound grows, so the least is always found.
    """

    #: Of the exponent of a miss by the first bound.
    REACH = 5.0

    def __init__(self, samples: int = BANDS * ROWS):
        self.factors = mixed(np.arange(1, samples + 1).astype(np.uint64) << np.uint64(20)) | np.uint64(1)

    @staticmethod
    def _variates(h: np.ndarray, g: np.ndarray, log_w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log a and t of hits with hashes ``h`` (for z) and ``g`` (for all else)."""
        _, to_z, to_e1, from_e1 = _curves()
        bits = np.uint64((1 << 21) - 1)
        u1, u2, beta = (((g >> np.uint64(k)) & bits).astype(np.float64) * 2.0**-21 + 2.0**-22 for k in (0, 21, 42))
        z = to_z(np.log(-np.log1p(-(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53))))
        s = np.exp(np.maximum(from_e1(np.log(u1) + to_e1(z)), z))
        log_c = np.log(s - np.log(u2))
        r = np.maximum(log_c - z, 1e-9)
        t = np.floor(log_w / r + beta)
        return log_c - r * (t - beta) - r, t

    def _draw(self, k: int, row: np.ndarray, shingle: np.ndarray, log_w: np.ndarray, limit: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows for which sample ``k`` is found, and what they draw; ``limit`` for each shingle's hash is that of ``bound`` for a."""
        h = shingle * self.factors[k]
        at = np.flatnonzero(h <= limit)
        h, of = h[at], row[at]
        g = mixed(h + np.uint64(k + 1))
        log_a, t = self._variates(h, g, log_w[at])
        if not len(at):
            return of, g
        starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        least = np.minimum.reduceat(log_a, starts)
        rows = of[starts]
        best = np.flatnonzero(log_a == np.repeat(least, np.diff(np.append(starts, len(of)))))
        best = best[np.append(True, of[best][1:] != of[best][:-1])]
        done = least <= bound[rows]
        best = best[done]
        return rows[done], mixed(g[best] + mixed(t[best].astype(np.int64).view(np.uint64)))

    def signatures(self, row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
        """rows x samples: what each row draws, as a hash; rows without shingles draw 0."""
        out = np.zeros((rows, len(self.factors)), np.uint64)
        if not len(row):
            return out
        level, *_ = _curves()
        starts = np.searchsorted(row, np.arange(rows + 1))
        some = np.diff(starts) > 0
        total = np.bincount(row, weight, rows)
        log_w = np.log(weight)

        def bounded(part: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
            bound = np.log(reach) - np.log(np.maximum(total, 1e-300))
            p = -np.expm1(-np.exp(level(bound[row[part]] + log_w[part])))
            return np.minimum(p * (1 + 1e-6) * 2.0**64, 2.0**64 - 4096).astype(np.uint64), bound

        every = slice(None)
        limit, bound = bounded(every, self.REACH)
        for k in range(len(self.factors)):
            part, reach, now, until = every, self.REACH, limit, bound
            left = some.copy()
            while True:
                found, drawn = self._draw(k, row[part], shingle[part], log_w[part], now, until)
                out[found, k] = drawn
                left[found] = False
                rest = np.flatnonzero(left)
                if not len(rest):
                    break
                part, reach = gather(starts[rest], starts[rest + 1] - starts[rest]), reach * 8
                now, until = bounded(part, reach)
                if reach > 1e6:  # every shingle
                    now, until = np.full(len(part), np.iinfo(np.uint64).max), np.full(rows, np.inf)
        return out


def signature_table(docs: DataFrame, weights: WordWeights) -> DataFrame:
    """doc_id, h1, h2, the weight of the text's shingles, a bit of each sample, and the bands' keys k0, k1 ... (null without shingles); of rows (doc_id, text, h1, h2)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    names = ["doc_id", "h1", "h2", "weight", "bits", *(f"k{i}" for i in range(BANDS))]

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        for batch in steps(batches, "text"):
            column = texts(batch).dictionary_encode()  # copies within a step are sampled once
            unique, of = column.dictionary, column.indices.to_numpy()
            row, shingle, weight = shared.value.shingles(unique)
            drawn = sampler.signatures(row, shingle, weight, len(unique))
            keys = np.zeros((len(unique), BANDS), np.uint64)
            for k in range(ROWS):
                keys = mixed(keys + drawn[:, k::ROWS] + np.arange(BANDS, dtype=np.uint64))
            total = np.bincount(row, weight, len(unique))
            bits = np.packbits((drawn >> np.uint64(40) & np.uint64(1)).astype(bool), axis=1).reshape(-1).view(np.int64)
            none = total[of] == 0
            columns = [pa.array(k, mask=none) for k in (total[of], bits[of], *keys[of].view(np.int64).T)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *columns], names)

    return docs.select("doc_id", "text", "h1", "h2").mapInArrow(signed, "doc_id bigint, h1 bigint, h2 bigint, weight double, bits bigint, " + ", ".join(f"k{i} bigint" for i in range(BANDS)))


def _joined_here(edges: DataFrame) -> DataFrame:
    """Components by union and find in one task; for as many edges as its caller bounds."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                up.setdefault(a, a)
                up.setdefault(b, b)
                a, b = top(a), top(b)
                up[max(a, b)] = min(a, b)
        ids = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([top(x) for x in ids], pa.int64())], ["id", "label"])

    return edges.select("a", "b").repartition(1).mapInArrow(join, "id bigint, label bigint")


class Tables:
    """Tables in the shared folder that go when they are no longer needed."""

    def __init__(self, docs: DataFrame, name: str):
        self.spark, self.root, self.n = docs.sparkSession, shared_folder(docs.sparkSession, name), 0

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for df in names:
            for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
                remove(self.spark, path)


def components(edges: DataFrame, tables: Tables, here: int = HERE) -> DataFrame:
    """id and least id of the component of each end of ``edges`` (a, b).

    Up to ``here`` edges one task joins them; beyond, labels go along edges and are followed until none changes, all in
    tables. Both give the same rows.
    """
    if edges.count() <= here:
        return tables.written(_joined_here(edges), "labels")
    both = tables.written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = tables.written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near, labels["id"] == near["a"]).select("id", "label", F.least("label", "near").alias("new"))
        least = tables.written(least, "labels")
        jump = least.select(F.col("id").alias("new"), F.col("new").alias("next"))
        labels = tables.written(least.join(jump, "new").select("id", F.col("next").alias("label"), (F.col("next") != F.col("label")).alias("changed")), "labels")
        done = labels.where("changed").isEmpty()
        labels = labels.select("id", "label")
        if done:
            return labels


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and text of ``nodes`` (node, rep, h1, h2): texts that no node needs are left out by a bitmap before the join."""
    shared = docs.sparkSession.sparkContext.broadcast(Bitmap.of(nodes.select("rep")))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.has(batch.column(0).to_numpy())))

    docs = docs.select("doc_id", "text", "h1", "h2")
    return docs.mapInArrow(held, docs.schema).withColumnRenamed("doc_id", "rep").join(nodes, ["rep", "h1", "h2"]).select("node", "text")


def compared(pairs: DataFrame, known: DataFrame, weights: WordWeights) -> DataFrame:
    """``pairs`` (a, b) with the similarity of their texts (in ``known``: node, text). A text in very many pairs is dealt out in copies."""
    shared = known.sparkSession.sparkContext.broadcast(weights)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text_b", 2 << 20):
            found = weighted_jaccard(shared.value, texts(batch, "text_a"), texts(batch, "text_b"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], ["a", "b", "similarity"])

    copies = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT).cast("int").alias("copies"))
    salted = pairs.join(copies, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int")).select("a", "b", "salt")
    a = copies.join(known.withColumnRenamed("node", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), F.col("text").alias("text_a"))
    b = known.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return salted.join(b, "b").join(a, ["a", "salt"]).select("a", "b", "text_a", "text_b").mapInArrow(measured, "a bigint, b bigint, similarity double")


def _unshared(known: DataFrame, weights: WordWeights) -> DataFrame:
    """node and own: the weight of its shingles that no other node of ``known`` (node, text) has."""
    shared = known.sparkSession.sparkContext.broadcast(weights)

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            row, shingle, weight = shared.value.shingles(texts(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(shingle.view(np.int64)), pa.array(weight.astype(np.float32))], ["node", "shingle", "own"])

    rows = known.mapInArrow(exploded, "node bigint, shingle bigint, own float")
    alone = rows.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("other"), F.min("own").alias("own")).where("node = other")
    return alone.groupBy("node").agg(F.sum("own").alias("own"))


def near_duplicates(docs: DataFrame, *, similarity: float = SIMILARITY, differ: int = DIFFER, here: int = HERE) -> DataFrame:
    """doc_id and class_id, the least id of its class, one row for each row of ``docs``."""
    tables = Tables(docs, "near")
    written = tables.written
    everything = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = everything.where("doc_id IS NOT NULL").withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(similarity), "text")})
    weights = WordWeights.of(docs)
    signed = written(signature_table(docs, weights), "signatures")
    first = [F.first(c).alias(c) for c in ("weight", "bits", *(f"k{i}" for i in range(BANDS)))]
    nodes = signed.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), *first)
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    buckets = nodes.where("weight IS NOT NULL").select(F.explode(F.array(*(f"k{i}" for i in range(BANDS)))).alias("key"), "node", "weight", "bits")
    crowded = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = written(buckets.join(crowded, "key"), "buckets")
    company = buckets.groupBy("node").agg(F.sum("n").alias("company"))
    buckets = buckets.drop("n").join(company, "node")
    centre = buckets.groupBy("key").agg(F.max(F.struct("company", "node", "weight", "bits")).alias("c")).select("key", *(F.col(f"c.{c}").alias(f"{c}_c") for c in ("node", "weight", "bits")))
    buckets = written(buckets.drop("company").join(centre, "key"), "members")

    def alike(a: str, b: str) -> Column:
        """That weights and samples allow the similarity."""
        ratio = F.least(F.col(f"weight{a}"), F.col(f"weight{b}")) >= F.greatest(F.col(f"weight{a}"), F.col(f"weight{b}")) * (similarity - 1e-6)
        return ratio & (F.bit_count(F.col(f"bits{a}").bitwiseXOR(F.col(f"bits{b}"))) <= differ)

    of_node = nodes.select("node", "rep", "h1", "h2")
    linked = F.col("similarity") >= similarity - 1e-9
    pairs = written(buckets.where((F.col("node") != F.col("node_c")) & alike("_c", "")).select(F.col("node_c").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    measured = written(compared(pairs, written(_texts(docs, of_node.join(ends, "node")), "texts"), weights), "measured")
    links = measured.where(linked).select("a", "b")
    labels = components(links, tables, here)

    def labelled(rows: DataFrame) -> DataFrame:
        """The rows of buckets of several components, with each node's ``label``."""
        rows = rows.join(labels.withColumnRenamed("id", "node"), "node", "left").withColumn("label", F.coalesce("label", "node"))
        several = rows.groupBy("key").agg(F.min("label").alias("one"), F.max("label").alias("other")).where("one < other").select("key")
        return rows.join(several, "key")

    at = written(labelled(buckets.select("key", "node", "weight", "bits")).drop("label"), "open")
    known = written(_texts(docs, of_node.join(at.select("node").distinct(), "node")), "texts")
    at = at.join(written(_unshared(known, weights), "own"), "node", "left").withColumn("own", F.coalesce("own", F.lit(0.0)))
    at = at.where((F.col("weight") - F.col("own")) * (1 + 1e-6) >= F.col("weight") * similarity)
    at = written(labelled(at).drop("label"), "alike")
    pivot = at.groupBy("key").agg(F.min(F.struct(F.col("own") / F.col("weight"), "node", "weight")).alias("p")).select("key", F.col("p.node").alias("pivot"), F.col("p.weight").alias("weight_p"))
    at = written(at.join(pivot, "key"), "pivots")
    pairs = at.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    measured = written(compared(pairs, known, weights), "measured")
    links = links.union(measured.where(linked).select("a", "b"))
    labels = components(links, tables, here)

    f = (1 - similarity) / (1 + similarity) * (1 + 1e-6)
    at = labelled(at).join(measured.withColumnsRenamed({"a": "pivot", "b": "node"}), ["pivot", "node"], "left")
    at = at.withColumn("d", F.when(F.col("node") == F.col("pivot"), 0.0).otherwise((F.col("weight") + F.col("weight_p")) * (1 - F.col("similarity")) / (1 + F.col("similarity"))))
    at = at.withColumns({"x": F.col("d") - f * F.col("weight"), "y": F.col("d") - 2 * F.col("own") + f * F.col("weight")})
    at = at.join(labels.select(F.col("id").alias("pivot"), F.col("label").alias("label_p")), "pivot", "left").withColumn("label_p", F.coalesce("label_p", "pivot"))
    at = written(at.select("key", "node", "label", "label_p", "weight", "bits", "own", "x", "y"), "left")
    least = at.where("label <> label_p").groupBy("key").agg(F.min("x").alias("least"))
    partners = at.join(least, "key").where(F.col("y") >= F.col("least"))
    lone, other = (df.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "label", "weight", "bits", "own", "x", "y"))) for df, s in ((at.where("label <> label_p"), "l"), (partners, "o")))
    enough = F.least(F.col("weight_l") - F.col("own_l"), F.col("weight_o") - F.col("own_o")) * (1 + similarity) / similarity * (1 + 1e-6) >= F.col("weight_l") + F.col("weight_o")
    cross = (F.col("y_l") >= F.col("x_o")) & (F.col("y_o") >= F.col("x_l"))
    pairs = lone.join(other, "key").where((F.col("label_l") != F.col("label_o")) & enough & cross & alike("_l", "_o"))
    pairs = written(pairs.select(F.least("node_l", "node_o").alias("a"), F.greatest("node_l", "node_o").alias("b")).distinct(), "pairs")
    links = links.union(written(compared(pairs, known, weights).where(linked).select("a", "b"), "links"))

    # Texts of one id belong together.
    of_doc = signed.select("doc_id", "h1", "h2").join(of_node, ["h1", "h2"]).select("doc_id", "node")
    same = of_doc.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.count("*").alias("n")).where("a < z")
    links = links.union(of_doc.join(same, "doc_id").where("node > a").select("a", F.col("node").alias("b")).distinct())
    labels = components(written(links, "links"), tables, here).withColumnRenamed("id", "node")
    label = of_node.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = label.groupBy("label").agg(F.min("rep").alias("class_id"))
    of_text = written(label.join(classes, "label").select("h1", "h2", "class_id"), "classes")
    found = signed.select("doc_id", "h1", "h2").join(of_text, ["h1", "h2"]).select("doc_id", "class_id")
    return found.union(everything.where("doc_id IS NULL").select("doc_id", F.lit(None).cast("bigint").alias("class_id")))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without near duplicates: of each class one row of its least id stays, of several such rows the first by its JSON; all rows without id stay."""
    classes = near_duplicates(docs, **options).where("doc_id = class_id").groupBy("doc_id").agg(F.count("*").alias("rows"))
    kept = docs.join(classes.select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    if not classes.where("rows > 1").isEmpty():
        whole = F.struct(*(kept[c] for c in kept.columns))
        kept = kept.groupBy("doc_id").agg(F.min_by(whole, F.to_json(whole)).alias("row")).select("row.*")
    return kept.union(docs.where("doc_id IS NULL"))
