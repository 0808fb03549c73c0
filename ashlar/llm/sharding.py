"""Sharding by size-tiered compaction: arrivals become small immutable shards, runs of like size are merged to target size, and
each change is a new version of a manifest, committed atomically."""

from __future__ import annotations

import json
import math
import time
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ashlar.llm.common import filesystem, shared_dir, table

TARGET_BYTES = 128 << 20
#: Shards of a tier that are merged together at least, and the ratio of one tier's size to the next.
FAN_IN = 4
#: Sizes below this are one tier.
LEAST_BYTES = 1 << 20
#: How long merged and unfinished runs are kept for readers and writers that may still need them.
KEEP_HOURS = 24.0


class CommitConflict(RuntimeError):
    """Another writer committed the same version first; nothing of this one's is visible. Read again and retry."""


class ShardStore:
    """A table as shards listed by the newest manifest under `root`. Files are never changed. A reader sees one version whole.

    A manifest is written beside its name and then given it, which fails if the version exists: by a rename that doesn't
    overwrite, or on a local file system by a hard link, as a rename there looks first and renames then. So of two writers one wins
    and a writer that dies leaves files that no manifest names. A version is committed only if all its files exist. Shards are written by Spark's own committer: tasks of lost executors
    run again and leave no parts.
    """

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.root, self.target, self.fan_in = spark, root.rstrip("/"), target_bytes, fan_in
        self.fs, path = filesystem(spark, self.root)
        self.fs.mkdirs(path)

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def version(self) -> int:
        """The newest version, 0 if there is none."""
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path())]
        return max([int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")], default=0)

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "schema", "shards": [{"path", "bytes", "rows", "tier"}]}; of version 0, no schema and no shards."""
        v = self.version() if version is None else version
        if not v:
            return {"version": 0, "schema": None, "shards": []}
        path = self._path(f"manifest-{v:010d}.json")
        size = self.fs.getFileStatus(path).getLen()
        stream = self.fs.open(path)
        try:
            jvm = self.spark._jvm
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")) if size else {}
        finally:
            stream.close()

    def _commit(self, base: int, schema: str, shards: list[dict]) -> dict:
        new = {"version": base + 1, "schema": schema, "shards": sorted(shards, key=lambda s: s["path"])}
        there: dict[str, set[str]] = {}
        for run in {s["path"].split("/")[0] for s in shards}:
            there[run] = {f.getPath().getName() for f in self.fs.listStatus(self._path(run))} if self.fs.exists(self._path(run)) else set()
        if gone := [s["path"] for s in shards if s["path"].split("/")[1] not in there[s["path"].split("/")[0]]]:
            raise CommitConflict(f"files of version {base + 1} are gone: {gone[:3]}")
        draft, final = self._path(f".draft-{uuid.uuid4().hex}"), self._path(f"manifest-{base + 1:010d}.json")
        out = self.fs.create(draft, False)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        try:
            if not self._publish(draft, final):
                raise CommitConflict(f"version {base + 1} exists")
        finally:
            self.fs.delete(draft, False)
        return new

    def _publish(self, draft, final) -> bool:
        """Gives a written file its name, at once and only if there is none of that name."""
        uri = self.fs.makeQualified(final).toUri()
        if uri.getScheme() == "file":
            jvm = self.spark._jvm
            try:
                jvm.java.nio.file.Files.createLink(jvm.java.io.File(uri.getPath()).toPath(), jvm.java.io.File(self.fs.makeQualified(draft).toUri().getPath()).toPath())
                return True
            except Py4JJavaError as e:
                if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                    return False
                raise
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(self.fs.makeQualified(draft), self.fs.makeQualified(final), gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except Py4JJavaError:
            if self.fs.exists(final):
                return False
            raise

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / LEAST_BYTES, self.fan_in)))

    def _write(self, df: DataFrame) -> list[dict]:
        name = f"run-{uuid.uuid4().hex}"
        path = self._path(name)
        df.write.option("compression", "zstd").parquet(path.toString())
        files = [s for s in self.fs.listStatus(path) if s.getPath().getName().endswith(".parquet")]
        if not files:
            return []
        read = self.spark.read.schema(df.schema).parquet(path.toString())
        rows = dict(read.groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1)).count().collect())  # a row for each file just written
        out = []
        for s in files:
            n = s.getPath().getName()
            if rows.get(n):
                out.append({"path": f"{name}/{n}", "bytes": s.getLen(), "rows": rows[n], "tier": self.tier(s.getLen())})
        return out

    def append(self, df: DataFrame) -> dict:
        """Adds an arrival: each task writes its rows as one small shard; nothing is shuffled. Empty arrivals add a version without shards."""
        now = self.manifest()
        schema = now["schema"] or df.schema.json()
        if T.StructType.fromJson(json.loads(schema)).simpleString() != df.schema.simpleString():
            raise ValueError("the arrival's columns are not the table's")
        return self._commit(now["version"], schema, now["shards"] + self._write(df))

    def _mergeable(self, shards: list[dict]) -> list[dict]:
        """The shards of the lowest tier that has FAN_IN of them or more, all short of the target."""
        for t in sorted({s["tier"] for s in shards}):
            run = [s for s in shards if s["tier"] == t and s["bytes"] <= self.target // 2]
            if len(run) >= self.fan_in:
                return run
        return []

    def compact(self) -> dict:
        """Merges runs until no tier has enough. A run's shards, alike in size, are joined into as few files as the target allows,
        each by one task from whole input splits, without a shuffle. A merge must keep the number of rows, or it is not committed."""
        while run := self._mergeable((now := self.manifest())["shards"]):
            size = sum(s["bytes"] for s in run)
            schema = T.StructType.fromJson(json.loads(now["schema"]))
            df = self.spark.read.schema(schema).parquet(*(self._path(s["path"]).toString() for s in run))
            merged = self._write(df.coalesce(max(1, min(-(-size // self.target), len(run) // 2))))
            if sum(s["rows"] for s in merged) != sum(s["rows"] for s in run):
                raise RuntimeError("a merge changed the number of rows")
            gone = {s["path"] for s in run}
            if len(merged) >= len(run):
                break
            self._commit(now["version"], now["schema"], [s for s in now["shards"] if s["path"] not in gone] + merged)
        return self.manifest()

    def vacuum(self, keep_hours: float = KEEP_HOURS) -> int:
        """Deletes runs that no version of the last keep_hours names, the newest version's apart, and that were written before that too:
        so neither a writer that hasn't committed yet nor a reader of a version that was the newest keep_hours ago loses a file.
        Older versions can't be read afterwards. Returns how many runs went."""
        since = time.time() * 1000 - keep_hours * 3_600_000
        listed = list(self.fs.listStatus(self._path()))
        manifests = sorted((int(n[9:-5]), s.getModificationTime()) for s in listed if (n := s.getPath().getName()).startswith("manifest-") and n.endswith(".json"))
        # A version was the newest until the next one came.
        named = [v for k, (v, _) in enumerate(manifests) if k == len(manifests) - 1 or manifests[k + 1][1] > since]
        live = {s["path"].split("/")[0] for v in named for s in self.manifest(v)["shards"]}
        gone = [s.getPath() for s in listed if (n := s.getPath().getName()).startswith("run-") and n not in live and s.getModificationTime() <= since]
        for p in gone:
            self.fs.delete(p, True)
        return len(gone)

    def read(self, version: int | None = None, shard_col: str = "shard", tier_col: str = "tier") -> DataFrame:
        """The rows of one version, with the shard they are in and its tier. Underlines are put before the names of these columns
        as long as the table has columns of those names."""
        m = self.manifest(version)
        schema = T.StructType.fromJson(json.loads(m["schema"]))
        while shard_col in schema.names:
            shard_col = f"_{shard_col}"
        while tier_col in schema.names or tier_col == shard_col:
            tier_col = f"_{tier_col}"
        if not m["shards"]:
            empty = self.spark.createDataFrame([], schema)
            return empty.withColumn(shard_col, F.lit(None).cast("string")).withColumn(tier_col, F.lit(None).cast("int"))
        parts = []
        for tier in sorted({s["tier"] for s in m["shards"]}):  # a few, as their sizes grow by a factor: no join tells a row its tier
            part = self.spark.read.schema(schema).parquet(*(self._path(s["path"]).toString() for s in m["shards"] if s["tier"] == tier))
            parts.append(part.withColumn(shard_col, F.element_at(F.split(F.input_file_name(), "/"), -1)).withColumn(tier_col, F.lit(tier)))
        return reduce(DataFrame.unionByName, parts)


def shard(df: DataFrame, root: str | None = None, **options) -> ShardStore:
    """Appends df to the store at root (a new one in the shared folder by default), compacts it and deletes what was merged:
    at once in a store of its own, which nobody else knows, and else what is past KEEP_HOURS.
    Rows are kept as they are, nulls, repeats and very long texts included; each is in one live shard."""
    fresh = root is None
    store = ShardStore(df.sparkSession, root or shared_dir(df.sparkSession), **options)
    if fresh:
        store.fs.deleteOnExit(store._path())
    store.append(df)
    store.compact()
    store.vacuum(0 if fresh else KEEP_HOURS)
    return store


#: Arrivals that the query takes the documents in.
ARRIVALS = 6


def shard_arrivals(df: DataFrame, key: str, arrivals: int = ARRIVALS, root: str | None = None, vacuum: bool = True, **options) -> ShardStore:
    """A store that takes df's rows in as so many arrivals, dealt by a hash of `key` (rows of one key come together, null keys too), and is compacted after each. vacuum: what was merged is deleted after each arrival, so that
    the disk holds about twice the table; older versions can't be read then. An arrival without rows adds a version without shards."""
    store = ShardStore(df.sparkSession, root or shared_dir(df.sparkSession), **options)
    if root is None:
        store.fs.deleteOnExit(store._path())
    for k in range(arrivals):
        store.append(df.where(F.pmod(F.xxhash64(key), F.lit(arrivals)) == k))
        store.compact()
        if vacuum:
            store.vacuum(0)
    return store


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    """Every row of documents, taken in as several arrivals, as read back from the shards of the newest manifest."""
    store = shard_arrivals(table(spark, sf_dir, "documents"), "doc_id")
    return store.read().select("doc_id", "shard", "tier", F.lit(store.version()).alias("version"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"))
