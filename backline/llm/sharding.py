"""Sharding: size-tiered compaction of immutable shards under a versioned manifest.

Arrivals are appended as small Parquet shards that never change. Compaction takes the shards
of one size tier (sizes within a factor ``fanout``) and merges them into files of the target
size; a tier is merged once it has ``fanout`` shards or a target's worth of bytes. Each append or
compaction writes new files and then commits version n + 1 of the manifest by renaming it into
place, which fails if another writer was first; an append then tries again on the newer version, as does a merge
whose shards are still there. Readers see whole versions only. Files of versions given up, and old files that no
version has named, left by failed jobs, are removed by ``vacuum``.

A merge reads its shards and coalesces them: nothing is shuffled, and a task's data is about a
target file. Every row, null, empty, repeated or very long, and every column is kept as it is, whatever its name; rows of equal
ids arrive together; an empty arrival commits a version without new shards.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_dir

TARGET_BYTES, FANOUT, SMALLEST = 64 << 20, 4, 64 << 10


class Conflict(RuntimeError):
    """Another writer committed the version first."""


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    rows: int
    tier: int


def _tail(path: str) -> str:
    """Folder and file of a shard, which name it whatever the root is called."""
    return "/".join(path.rsplit("/", 2)[1:])


def _file_of(df: DataFrame):
    """The file of each row, though a column may be called _metadata."""
    return df.metadataColumn("_metadata").getField("file_path")


class ShardStore:
    """A folder of shards and manifests in a file system of Hadoop's whose rename is exclusive: HDFS and local disks, not bare object stores.

    The driver holds a short row a shard, about 150 bytes for each target file.
    """

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.root, self.target, self.fanout = spark, root.rstrip("/"), target_bytes, fanout
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self):
        return self._path(self.root).getFileSystem(self._conf)

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / SMALLEST, self.fanout))) if size > SMALLEST else 0

    # Manifests.

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifests")
        fs = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, list[Shard]]:
        """A version's number and shards; version 0 is empty."""
        version = max([0, *self.versions()]) if version is None else version
        if not version:
            return 0, []
        fs, path = self._fs(), self._path(f"{self.root}/manifests/v{version:08d}.json")
        stream = fs.open(path)
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return version, [Shard(**s) for s in json.loads(text)["shards"]]

    def commit(self, base: int, shards: list[Shard], action: str) -> int:
        """Make version ``base + 1``; Conflict if it exists already."""
        version = base + 1
        done = self._path(f"{self.root}/manifests/v{version:08d}.json")
        draft = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}.draft")
        fs = self._fs()
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps({"version": version, "action": action, "shards": [asdict(s) for s in shards]}).encode()))
        stream.close()
        options = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(done.toUri() if done.toUri().getScheme() else fs.getUri(), self._conf)
        try:
            context.rename(draft, done, self.spark.sparkContext._gateway.new_array(options, 0))
        except Exception as failure:
            fs.delete(draft, False)
            if fs.exists(done):
                raise Conflict(f"version {version} is taken") from failure
            raise
        return version

    # Shards.

    def _write(self, df: DataFrame) -> list[Shard]:
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(folder)
        files = {s.getPath().getName(): s.getLen() for s in self._fs().listStatus(self._path(folder)) if s.getPath().getName().endswith(".parquet")}
        stored = self.spark.read.schema(df.schema).parquet(folder)
        counts = {r[0].rsplit("/", 1)[1]: r[1] for r in stored.groupBy(_file_of(stored).alias("file")).agg(F.count(F.lit(1))).collect()}
        return [Shard(f"{folder}/{name}", files[name], n, self.tier(files[name])) for name, n in sorted(counts.items()) if n]

    def append(self, arrival: DataFrame) -> int:
        """Add an arrival as it is partitioned, a shard a partition."""
        new = self._write(arrival)
        while True:
            version, shards = self.manifest()
            try:
                return self.commit(version, shards + new, "append")
            except Conflict:
                continue  # what others committed stays; theirs and ours add up

    def _due(self, shards: list[Shard]) -> list[list[Shard]]:
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.bytes * 2 <= self.target:
                tiers.setdefault(s.tier, []).append(s)
        return [t for _, t in sorted(tiers.items()) if len(t) >= self.fanout or len(t) > 1 and sum(s.bytes for s in t) >= self.target]

    def compact(self, schema) -> int:
        """Merge due tiers until none is, one version a round; each merge leaves fewer shards, so it ends."""
        version, shards = self.manifest()
        while due := self._due(shards):
            gone, new = {s.path for t in due for s in t}, []
            for t in due:
                files = max(1, round(sum(s.bytes for s in t) / self.target))
                new += self._write(self.spark.read.schema(schema).parquet(*[s.path for s in t]).coalesce(files))
            while gone <= {s.path for s in shards}:
                try:
                    left = [s for s in shards if s.path not in gone] + new
                    version, shards = self.commit(version, left, "compact"), left
                    break
                except Conflict:
                    version, shards = self.manifest()
        return version

    def read(self, schema, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        _, shards = self.manifest(version)
        return self.spark.read.schema(schema).parquet(*[s.path for s in shards]) if shards else self.spark.createDataFrame([], schema)

    def vacuum(self, keep: int = 1, least_age: float = 86_400) -> int:
        """Delete shards that only versions before the last ``keep`` name, and files of ``least_age`` seconds that none does; the number deleted.

        A younger file may be a shard that its writer has yet to commit. Readers of an older version lose it: with any about, keep more versions.
        """
        versions = self.versions()
        every = {v: {_tail(s.path) for s in self.manifest(v)[1]} for v in versions}
        kept, known = (set().union(*(every[v] for v in part)) for part in (versions[-keep:], versions))
        fs, n = self._fs(), 0
        data = self._path(f"{self.root}/data")
        for folder in fs.listStatus(data) if fs.exists(data) else []:
            for s in fs.listStatus(folder.getPath()):
                name = s.getPath().getName()
                tail = f"{folder.getPath().getName()}/{name}"
                old = tail in known or time.time() - s.getModificationTime() / 1000 >= least_age
                if name.endswith(".parquet") and tail not in kept and old:
                    n += bool(fs.delete(s.getPath(), False))
        return n


#: Shares, of 8, of the hash range that arrive together.
ARRIVALS = (5, 2, 1)


def shard_documents(documents: DataFrame, root: str | None = None, target_bytes: int = TARGET_BYTES) -> tuple[ShardStore, DataFrame]:
    """Append the documents in arrivals by id hash, compact, and return the store and the place of every document."""
    spark = documents.sparkSession
    store = ShardStore(spark, root or scratch_dir(spark), target_bytes)
    part, start = F.pmod(F.xxhash64("doc_id"), F.lit(sum(ARRIVALS))), 0
    for share in ARRIVALS:
        store.append(documents.where((part >= start) & (part < start + share)))
        start += share
    store.compact(documents.schema)
    store.vacuum(keep=1)  # nobody else reads this store yet
    version, shards = store.manifest()
    order = sorted(shards, key=lambda s: (-s.bytes, s.path))
    places = [(_tail(s.path), i, s.rows, s.bytes, s.tier, version) for i, s in enumerate(order)]
    names = "_tail", "shard", "shard_rows", "shard_bytes", "tier", "version"
    kinds = pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()
    # From Arrow, so that the planner knows the table's size and broadcasts it only if it is small.
    table = spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(list(zip(*places)) or [()] * 6, kinds, strict=True)], names=list(names)))
    stored = store.read(documents.schema)
    tail = F.regexp_extract(_file_of(stored), "([^/]+/[^/]+)$", 1) if shards else F.lit("")
    return store, stored.select("doc_id", tail.alias("_tail")).join(table, "_tail").drop("_tail")
