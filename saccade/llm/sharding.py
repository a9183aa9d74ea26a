"""Immutable shards with size-tiered compaction and a versioned manifest.

Arrivals are appended as small shards. Shards fall into tiers by size (a tier spans ``fanout``-fold
sizes, up to the target size); when a tier has ``fanout`` shards they are merged into files of the target
size. Nothing is changed in place: a manifest names the shards of a version, and committing writes the
next version's manifest to a temporary file and renames it, which fails if another writer was faster (as
atomically as the file system renames: HDFS does, object stores need a committer of their own). Readers see one whole version, and files that no version kept names are removed by vacuum().
"""

from __future__ import annotations

import json
import math
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ConflictError(RuntimeError):
    """Another writer committed this version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, fanout: int = 4):
        self.spark, self.root, self.target, self.fanout = spark, root.rstrip("/"), target_bytes, fanout
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    def version(self) -> int:
        """The latest version committed; 0 before the first."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[0] != "."), default=0)

    def manifest(self, version: int | None = None) -> dict:
        v = self.version() if version is None else version
        if v and not self._fs.exists(self._path(f"{self.root}/manifests/{v:08d}.json")):
            raise ValueError(f"{self.root} has no version {v}, or no longer")
        if v == 0:
            return {"version": 0, "shards": []}
        stream = self._fs.open(self._path(f"{self.root}/manifests/{v:08d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, base: int, shards: list[dict]) -> int:
        """Makes shards the next version after base. The manifest is written whole under another name and
        gets its own by a rename that doesn't replace: where another writer was faster, it fails."""
        path, draft = (self._path(f"{self.root}/manifests/{n}") for n in (f"{base + 1:08d}.json", f".draft-{uuid.uuid4().hex}"))
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps({"version": base + 1, "shards": shards}).encode()))
        out.close()
        jvm = self.spark._jvm.org.apache.hadoop.fs
        plain = self.spark.sparkContext._gateway.new_array(jvm.Options.Rename, 0)
        try:
            jvm.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, path, plain)
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if not self._fs.exists(path):
                raise
            raise ConflictError(f"version {base + 1} of {self.root} is there already") from e
        return base + 1

    def _write(self, rows: DataFrame) -> list[dict]:
        """A shard for each file written; they are complete before a manifest names them."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{folder}")
        files = [s for s in self._fs.listStatus(self._path(f"{self.root}/{folder}")) if s.getPath().getName().endswith(".parquet")]
        return sorted(({"file": f"{folder}/{s.getPath().getName()}", "bytes": s.getLen()} for s in files), key=lambda s: s["file"])

    def append(self, rows: DataFrame) -> int:
        """Adds an arrival as it is partitioned; tries again if another writer commits meanwhile."""
        made = self._write(rows)
        while True:
            now = self.manifest()
            try:
                return self.commit(now["version"], now["shards"] + made)
            except ConflictError:
                continue

    def tier(self, size: int) -> int:
        """0 for shards of about the target size, more for smaller ones: by powers of fanout below it."""
        return 0 if size >= self.target / 2 else math.ceil(math.log(self.target / max(size, 1), self.fanout))

    def compact(self) -> int:
        """Merges tiers that are full, smallest first, until none is; returns the version. Each merge
        reads its shards once, without a shuffle, and writes files of about the target size."""
        while True:
            now = self.manifest()
            tiers: dict[int, list[dict]] = {}
            for s in now["shards"]:
                tiers.setdefault(self.tier(s["bytes"]), []).append(s)
            full = [t for t in sorted(tiers, reverse=True) if t > 0 and len(tiers[t]) >= self.fanout]
            if not full:
                return now["version"]
            old = tiers[full[0]]
            total = sum(s["bytes"] for s in old)
            files = max(1, round(total / self.target))
            merged = self._write(self.read_shards(old).coalesce(files))
            gone = {s["file"] for s in old}
            try:
                self.commit(now["version"], [s for s in now["shards"] if s["file"] not in gone] + merged)
            except ConflictError:
                continue

    def read_shards(self, shards: list[dict]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/{s['file']}" for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with _shard: the file in it that holds the row (it takes the place of a
        stored column of that name)."""
        rows = self.read_shards(self.manifest(version)["shards"])
        return rows.withColumn("_shard", F.concat_ws("/", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2), F.col("_metadata.file_name")))

    def vacuum(self, keep: int = 1) -> int:
        """Removes all versions but the last ``keep``, and folders that none of these names; returns how many
        folders. Not to run while others append."""
        last = self.version()
        for s in self._fs.listStatus(self._path(f"{self.root}/manifests")):
            name = s.getPath().getName()
            if name.endswith(".json") and name[0] != "." and int(name[:-5]) <= last - keep:
                self._fs.delete(s.getPath(), False)
        named = {s["file"].split("/")[1] for v in range(max(1, last - keep + 1), last + 1) for s in self.manifest(v)["shards"]}
        gone = [s.getPath() for s in self._fs.listStatus(self._path(f"{self.root}/data")) if s.getPath().getName() not in named]
        return sum(self._fs.delete(p, True) for p in gone)


def shard(docs: DataFrame, root: str, arrivals: int = 4, target_bytes: int = 128 << 20, fanout: int = 4, by: str = "doc_id") -> ShardStore:
    """docs in a new store: dealt to ``arrivals`` by the hash of ``by``, each appended and followed by
    compaction. All columns and rows are kept, nulls, repeated rows, empty and very long texts too; an
    empty table makes shards without rows, so that its columns are known. A column named _shard is stored,
    but read() puts its own in its place. Each arrival leaves one version."""
    store = ShardStore(docs.sparkSession, root, target_bytes, fanout)
    for a in range(arrivals):
        store.append(docs.where(F.pmod(F.xxhash64(by), F.lit(arrivals)) == a))
        store.compact()
        store.vacuum()
    return store
