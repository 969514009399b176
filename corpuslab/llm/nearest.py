"""Approximate nearest neighbours by randomly rotated one-bit codes.

Each vector, less the mean, is normalised and rotated by a random orthogonal map into ``bits`` dimensions (more than it
has, for closer estimates); its code is the signs, packed into 64-bit words. A query is rotated alike and rounded to
``PLANES`` bits a dimension, kept as as many packed planes, so the inner product of code and query is a sum of population
counts of code AND plane. With the norm and one correction scalar (the inner product of the rotated vector and its code) it
estimates the inner product with the query without bias, and bounds its error: each code gives an estimate and a lower bound of
the squared distance. The ``k`` vectors of the least estimates of each query are fetched first; their greatest exact distance is
one that the ``k``-th nearest can't exceed. Then those whose lower bound is not above it are reranked: only they are fetched,
and the ``k`` least by exact distance, in double precision, are the result.

The code table (vec_id, code, norm, correction) is the index of all vectors, written once; it holds no vector. Queries go out
in blocks of about ``BLOCK``, each read and broadcast by itself, so neither the driver nor a broadcast holds more than a block.

Vectors that are null, empty, zero, or hold a null or non-finite component take no part, and neither do null ids. Vectors are
compared with those of the same length. Rows with the query's id are the query's own and are no candidates; if they have
several vectors, the least (component by component) asks. Other rows of equal ids each count. Of equal distances the smaller
vec_id comes first. With fewer than ``k`` candidates all are returned. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import shared_folder, written

#: Code bits for each dimension, and standard errors within which an estimate is taken to be.
BITS_PER_DIMENSION, ERRORS = 8, 2.5
PLANES = 4
BLOCK = 2048
_STEP = 1024


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotation(dimension: int, seed: int = 7) -> np.ndarray:
    """A ``bits`` x ``dimension`` matrix with orthonormal columns, the same wherever it is made."""
    bits = -(-BITS_PER_DIMENSION * dimension // 64) * 64
    return np.linalg.qr(np.random.default_rng((seed, dimension)).standard_normal((bits, dimension)))[0]


def _by_length(batch: pa.RecordBatch, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and their vectors (as doubles) by length of the vector, some thousands at once."""
    lists = batch.column(k)
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    length = np.diff(offsets)
    for d in np.unique(length):
        rows = np.flatnonzero(length == d)
        for i in range(0, len(rows), _STEP):
            part = rows[i : i + _STEP]
            yield part, values[offsets[part][:, None] + np.arange(d)]


def centres(vectors: DataFrame) -> dict[int, np.ndarray]:
    """The mean vector of each length: as many numbers as the vectors have components."""
    parts = vectors.select(F.size("embedding").alias("d"), F.posexplode("embedding").alias("at", "x")).groupBy("d", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    found = parts.toPandas().sort_values(["d", "at"])
    return {int(d): part["x"].to_numpy() for d, part in found.groupby("d")}


def code_table(vectors: DataFrame, centre: dict[int, np.ndarray]) -> DataFrame:
    """vec_id, length of the vector, packed signs, norm and correction of each row."""
    shared = vectors.sparkSession.sparkContext.broadcast(centre)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            ids = batch.column(0)
            for rows, x in _by_length(batch, 1):
                d = x.shape[1]
                turn = turns[d] if d in turns else turns.setdefault(d, rotation(d))
                x = x - shared.value[d]
                norm = np.sqrt((x * x).sum(1))
                turned = (x / np.maximum(norm, 1e-300)[:, None]) @ turn.T
                fit = np.abs(turned).sum(1) / np.sqrt(turn.shape[0])
                packed = np.packbits(turned > 0, axis=1)
                columns = [pa.array(np.full(len(rows), d, np.int32)), pa.array([p.tobytes() for p in packed], pa.binary()), pa.array(norm), pa.array(np.where(norm > 0, fit, 1.0))]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), *columns], ["vec_id", "d", "code", "norm", "fit"])

    return vectors.mapInArrow(coded, "vec_id bigint, d int, code binary, norm double, fit double")


class Queries:
    """A block of queries of one length: rotated, rounded, and packed by planes of bits."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, centre: np.ndarray):
        self.ids = ids
        turned = (x - centre) @ rotation(x.shape[1]).T
        self.low = turned.min(1)
        self.step = np.maximum(turned.max(1) - self.low, 1e-300) / ((1 << PLANES) - 1)
        level = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.planes = [np.packbits(level >> p & 1, axis=1).view(np.uint64) for p in range(PLANES)]
        self.sum = self.low * turned.shape[1] + self.step * level.sum(1, dtype=np.int64)
        self.squares, self.bits = ((x - centre) ** 2).sum(1), turned.shape[1]

    def bounds(self, code: np.ndarray, norm: np.ndarray, fit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimates and lower bounds of the squared distances of the codes (rows of 64-bit words) from the queries (columns)."""
        ones = np.bitwise_count(code).sum(1, dtype=np.int32)
        counted = np.zeros((len(code), len(self.ids)), np.int32)
        for p, plane in enumerate(self.planes):
            for w in range(code.shape[1]):
                counted += np.bitwise_count(code[:, w, None] & plane[:, w]).astype(np.int32) << p
        # The inner product of the query, as rounded, with the signs: twice that with the bits less the sum of all.
        inner = (2 * (self.low * ones[:, None] + self.step * counted) - self.sum) / np.sqrt(self.bits) / fit[:, None]
        off = np.sqrt(np.maximum(1 - fit**2, 0) / fit**2 / (self.bits - 1))[:, None] * np.sqrt(self.squares)
        error = ERRORS * np.sqrt(off**2 + (self.step**2 / 12) / fit[:, None] ** 2)
        middle = (norm**2)[:, None] + self.squares
        return middle - 2 * norm[:, None] * inner, middle - 2 * norm[:, None] * (inner + error)


def _scan(codes: DataFrame, block: dict[int, Queries], each: Callable[[], tuple[Callable, Callable]]) -> DataFrame:
    """query_id, vec_id and estimate that ``each`` makes of a task's codes: a pair of what takes (length, ids, estimates, lower bounds) and what gives (query positions, ids, estimates) of a length at the end."""
    shared = codes.sparkSession.sparkContext.broadcast(block)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take, give = each()
        rows_of = lambda d, found: pa.RecordBatch.from_arrays([pa.array(shared.value[d].ids[found[0]]), pa.array(found[1]), pa.array(found[2])], ["query_id", "vec_id", "estimate"])
        for batch in batches:
            ids, length = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).to_numpy()
            norm, fit = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            for d, q in shared.value.items():
                rows = np.flatnonzero(length == d)
                for i in range(0, len(rows), _STEP):
                    part = rows[i : i + _STEP]
                    code = np.frombuffer(b"".join(batch.column(2).take(pa.array(part)).to_pylist()), np.uint64).reshape(len(part), -1)
                    estimate, low = q.bounds(code, norm[part], fit[part])
                    own = ids[part][:, None] == q.ids
                    estimate[own] = low[own] = np.inf
                    found = take(d, ids[part], estimate, low)
                    if found is not None:
                        yield rows_of(d, found)
        for d in shared.value:
            found = give(d)
            if found is not None:
                yield rows_of(d, found)

    return codes.mapInArrow(search, "query_id bigint, vec_id bigint, estimate double")


def _exact(pairs: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, vec_id and score of the pairs (query_id, vec_id), one row for each vector of the id."""
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"))
    both = pairs.join(vectors, "vec_id").join(asked, "query_id").where(F.size("asked") == F.size("embedding"))
    square = F.zip_with("asked", "embedding", lambda a, b: (a - b.cast("double")) * (a - b.cast("double")))
    return both.select("query_id", "vec_id", F.sqrt(F.aggregate(square, F.lit(0.0), lambda t, x: t + x)).alias("score"))


def _first(df: DataFrame, value: str, k: int) -> DataFrame:
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(value, "vec_id")))
    return ranked.where(F.col("rank") <= k)


def _search(codes: DataFrame, vectors: DataFrame, centre: dict[int, np.ndarray], queries: DataFrame, k: int) -> DataFrame:
    rows = queries.toPandas()
    by = rows.groupby(rows["embedding"].map(len))
    block = {int(d): Queries(part["vec_id"].to_numpy(np.int64), np.stack(part["embedding"].to_numpy()), centre[int(d)]) for d, part in by}

    def least() -> tuple[Callable, Callable]:
        """The ``k`` least estimates of each query in the task."""
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def take(d: int, ids: np.ndarray, estimate: np.ndarray, _: np.ndarray) -> None:
            vec = np.broadcast_to(ids[:, None], estimate.shape)
            if d in best:
                estimate, vec = np.concatenate([best[d][0], estimate]), np.concatenate([best[d][1], vec])
            first = np.argpartition(estimate, min(k, len(estimate)) - 1, axis=0)[:k]
            best[d] = np.take_along_axis(estimate, first, 0), np.take_along_axis(vec, first, 0)

        def give(d: int) -> tuple[np.ndarray, ...] | None:
            if d not in best:
                return None
            at, of = np.nonzero(np.isfinite(best[d][0]))
            return of, best[d][1][at, of], best[d][0][at, of]

        return take, give

    # k rows at most for each query and task go on; of the queries' distances one number each comes to the driver.
    probes = _first(_scan(codes, block, least), "estimate", k).select("query_id", "vec_id").distinct()
    reach = _first(_exact(probes, vectors, queries), "score", k).groupBy("query_id").agg(F.max("score").alias("score"), F.count("*").alias("n")).collect()
    far = {r["query_id"]: r["score"] ** 2 * (1 + 1e-9) + 1e-12 for r in reach if r["n"] == k}
    most = {d: np.array([far.get(i, np.inf) for i in q.ids.tolist()]) for d, q in block.items()}

    def near() -> tuple[Callable, Callable]:
        """All whose lower bound is within reach."""

        def take(d: int, ids: np.ndarray, estimate: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, ...]:
            at, of = np.nonzero((low <= most[d]) & np.isfinite(low))
            return of, ids[at], estimate[at, of]

        return take, lambda _: None

    pairs = _scan(codes, block, near).select("query_id", "vec_id").distinct()
    return _first(_exact(pairs, vectors, queries), "score", k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query: Column, *, k: int = 10) -> DataFrame:
    """The ``k`` nearest found by Euclidean distance for each row of ``vectors`` (vec_id, embedding) for which ``is_query`` holds."""
    spark = vectors.sparkSession
    vectors = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    centre = centres(vectors)
    codes = written(code_table(vectors, centre), "codes")
    queries = vectors.where(is_query).groupBy("vec_id").agg(F.min(F.col("embedding").cast("array<double>")).alias("embedding"))
    blocks = -(-queries.count() // BLOCK)
    if blocks <= 1:
        return _search(codes, vectors, centre, queries, k)
    path = shared_folder(spark, "neighbours")
    for i in range(blocks):
        _search(codes, vectors, centre, queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i), k).write.mode("append").parquet(path)
    return spark.read.parquet(path)
