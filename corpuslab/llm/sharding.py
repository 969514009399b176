"""Size-tiered compaction of immutable Parquet shards under a versioned manifest, in DataFrame functions only.

A dataset is a folder: shards ``data/<name>/*.parquet`` and manifests ``_manifest/<version>.json``. Arrivals are appended
as small shards that never change. Compaction groups shards into tiers by size (powers of ``fan_in`` below the target)
and merges runs of ``fan_in`` or more of one tier into files of about the target size; a run is read and written without
a shuffle. Each change writes a new manifest under a temporary name and renames it to the next version: the rename fails
if that version exists, so of two writers one starts again from the other's version, and a reader sees one version whole.
Such a rename is atomic in HDFS and local file systems; an object store has to offer it (or a put that can't overwrite).
Shards are listed, sized and named by the driver; rows stay on the executors.

Rows, columns and types are kept as they arrive, nulls, very long texts, ties and repeated rows too, whatever the columns'
names: none is added unless asked for. An empty arrival adds no shard and an empty dataset reads as no rows with the schema
in its manifest.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import defaultdict
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import fresh, shared_folder

#: Runs that one job merges side by side.
RUNS_A_JOB = 64


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    level: int


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str | None
    shards: tuple[Shard, ...]


class Conflict(Exception):
    """Another writer made that version."""


def _typed(schema: StructType) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in schema]


class ShardedDataset:
    def __init__(self, spark: SparkSession, path: str, *, target_bytes: int = 128 << 20, fan_in: int = 4):
        self.spark, self.path, self.target, self.fan_in = spark, path.rstrip("/"), target_bytes, fan_in
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._hadoop(self.path).getFileSystem(self._conf)

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _list(self, path: str) -> list[tuple[str, int]]:
        return [(s.getPath().toString(), s.getLen()) for s in self._fs.listStatus(self._hadoop(path))] if self._fs.exists(self._hadoop(path)) else []

    def manifest(self, version: int | None = None) -> Manifest:
        """That version, else the last; version 0 is the empty dataset."""
        if version is None:
            names = [p.rsplit("/", 1)[1] for p, _ in self._list(f"{self.path}/_manifest")]
            version = max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)
        if not version:
            return Manifest(0, None, ())
        stream = self._fs.open(self._hadoop(f"{self.path}/_manifest/{version:012}.json"))
        try:
            found = json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()
        return Manifest(found["version"], found["schema"], tuple(Shard(**s) for s in found["shards"]))

    def commit(self, new: Manifest) -> None:
        """Makes ``new`` the next version; raises Conflict if its version exists."""
        jvm, folder = self.spark._jvm, f"{self.path}/_manifest"
        self._fs.mkdirs(self._hadoop(folder))
        draft = self._hadoop(f"{folder}/.{uuid.uuid4().hex}")
        stream = self._fs.create(draft)
        stream.write(bytearray(json.dumps({"version": new.version, "schema": new.schema, "shards": [asdict(s) for s in new.shards]}).encode()))
        stream.close()
        last = self._hadoop(f"{folder}/{new.version:012}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf)
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            context.rename(draft, last, options)
        except Exception as e:
            self._fs.delete(draft, False)
            if self._fs.exists(last):
                raise Conflict(new.version) from e
            raise

    def _write(self, df: DataFrame, level: int) -> list[Shard]:
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(folder)
        return [Shard(p, n, level) for p, n in self._list(folder) if p.endswith(".parquet")]

    def append(self, df: DataFrame) -> Manifest:
        """Adds the rows of ``df`` as one shard for each of its partitions that has rows."""
        shards = self._write(df, 0)
        if df.sparkSession.read.schema(df.schema).parquet(*[s.path for s in shards]).isEmpty() if shards else True:
            shards = []
        while True:
            old = self.manifest()
            if old.schema is not None and _typed(StructType.fromJson(json.loads(old.schema))) != _typed(df.schema):
                raise ValueError("an arrival must have the dataset's columns and types")
            new = replace(old, version=old.version + 1, schema=old.schema or df.schema.json(), shards=old.shards + tuple(shards))
            try:
                self.commit(new)
            except Conflict:
                continue
            return new

    def _tier(self, shard: Shard) -> int:
        """0 from half the target on; each tier below is smaller by the factor ``fan_in``."""
        tier, size = 0, shard.bytes
        while size * 2 < self.target:
            size, tier = max(size, 1) * self.fan_in, tier + 1
        return tier

    def runs(self, shards: tuple[Shard, ...], least: int | None = None) -> list[list[Shard]]:
        """Runs to merge: in each tier below the target, shards in order, cut at the target; shorter runs than ``least`` wait."""
        tiers = defaultdict(list)
        for s in shards:
            tiers[self._tier(s)].append(s)
        out = []
        for tier, own in sorted(tiers.items()):
            if not tier or len(own) < (least or self.fan_in):
                continue
            run, size = [], 0
            for s in own:
                if run and size + s.bytes > self.target:
                    out.append(run)
                    run, size = [], 0
                run.append(s)
                size += s.bytes
            if len(run) > 1:
                out.append(run)
        return [r for r in out if len(r) > 1]

    def compact(self) -> Manifest:
        """Merges runs until no tier has one; each round commits a version that swaps the runs for what they became."""
        while True:
            old = self.manifest()
            runs = self.runs(old.shards)
            if not runs:
                return old
            schema = StructType.fromJson(json.loads(old.schema))
            merged: list[Shard] = []
            for i in range(0, len(runs), RUNS_A_JOB):
                read = [self.spark.read.schema(schema).parquet(*[s.path for s in run]).coalesce(1) for run in runs[i : i + RUNS_A_JOB]]
                merged += self._write(reduce(DataFrame.unionAll, read), 1 + max(s.level for run in runs[i : i + RUNS_A_JOB] for s in run))
            gone = {s.path for run in runs for s in run}
            while True:
                now = self.manifest()
                if not gone <= {s.path for s in now.shards}:  # another writer merged some of them; start again from its version
                    break
                new = replace(now, version=now.version + 1, shards=tuple(s for s in now.shards if s.path not in gone) + tuple(merged))
                try:
                    self.commit(new)
                    break
                except Conflict:
                    continue

    def read(self, version: int | None = None, *, shard: str | None = None) -> DataFrame:
        """The rows of a version (else the last), with the file that each is in as column ``shard`` if that is given a name."""
        found = self.manifest(version)
        if found.schema is None:
            raise ValueError("the dataset has no version yet")
        schema = StructType.fromJson(json.loads(found.schema))
        if shard and fresh(schema.names, shard) != shard:
            raise ValueError(f"the dataset has a column {shard}")
        if not found.shards:
            rows = self.spark.createDataFrame([], schema)
            return rows.withColumn(shard, F.lit(None).cast("string")) if shard else rows
        rows = self.spark.read.schema(schema).parquet(*[s.path for s in found.shards])
        return rows.withColumn(shard, F.col("_metadata.file_name")) if shard else rows

    def vacuum(self, keep: int = 1, *, unnamed_hours: float = 24.0) -> int:
        """Deletes the manifests before the last ``keep`` versions and the shards that only those name; how many.

        Shards that no manifest names may be another writer's, about to be committed: they go when they are older than
        ``unnamed_hours``, which must be longer than any write takes.
        """
        last = self.manifest()
        old = [v for v in range(1, last.version - keep + 1) if self._fs.exists(self._hadoop(f"{self.path}/_manifest/{v:012}.json"))]
        live = {s.path for v in range(max(1, last.version - keep + 1), last.version + 1) for s in self.manifest(v).shards}
        expired = {s.path for v in old for s in self.manifest(v).shards} - live
        before = (time.time() - 3600 * unnamed_hours) * 1000
        for folder in self._fs.listStatus(self._hadoop(f"{self.path}/data")) if self._fs.exists(self._hadoop(f"{self.path}/data")) else ():
            if folder.getModificationTime() < before:
                expired |= {p for p, _ in self._list(folder.getPath().toString()) if p.endswith(".parquet") and p not in live}
        for p in expired:
            self._fs.delete(self._hadoop(p), False)
        for v in old:  # last, so that what is left over after a crash is found again
            self._fs.delete(self._hadoop(f"{self.path}/_manifest/{v:012}.json"), False)
        return len(expired)


def shard(df: DataFrame, *, arrivals: int = 4, key: str = "doc_id", target_bytes: int = 128 << 20, fan_in: int = 4, path: str | None = None) -> ShardedDataset:
    """Appends ``df`` in ``arrivals`` parts (by a hash of ``key``, nulls too), compacting after each, and drops old versions."""
    out = ShardedDataset(df.sparkSession, path or shared_folder(df.sparkSession, "shards"), target_bytes=target_bytes, fan_in=fan_in)
    for k in range(arrivals):
        out.append(df.where(F.pmod(F.xxhash64(key), F.lit(arrivals)) == k))
        out.compact()
        out.vacuum()
    return out
