"""Operator 9: sharding by size-tiered compaction with versioned manifests.

Arrivals are appended as small immutable shards (Parquet files). When a tier, a range of sizes, holds
enough shards, they are merged into files of the next sizes up to the target; files at the target are
left alone. What belongs to the store is said by a manifest alone: each commit writes the next version
under a name that must not exist yet, so a commit happens as a whole or not at all, and a reader keeps
the version that it opened.
"""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ._common import scratch_root

TARGET_BYTES = 128 << 20
#: Shards of one tier that make a merge, and the ratio between the sizes of two tiers.
FAN_IN = 4
RATIO = 4
#: Sizes below this are one tier.
SMALLEST = 1 << 20
#: Seconds after which a shard that a newer version has dropped may be deleted, and attempts at a commit.
GRACE = 7 * 24 * 3600
ATTEMPTS = 50


class CommitConflict(RuntimeError):
    """Another writer has committed this version first."""


class ShardStore:
    """Shards and manifests under one root folder of a shared file system."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.root, self.target, self.fan_in = spark, root.rstrip("/"), target_bytes, fan_in
        self._jvm = spark.sparkContext._jvm  # noqa: SLF001
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()  # noqa: SLF001

    def _path(self, name: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):  # noqa: ANN202
        return self._path("").getFileSystem(self._conf)

    def _sizes(self, folder: str) -> dict[str, int]:
        """Data files below a folder of shards, by their paths relative to the root."""
        listed = self._fs().listStatus(self._path(folder))
        return {f"{folder}/{f.getPath().getName()}": f.getLen() for f in listed if f.getPath().getName().endswith(".parquet")}

    def latest(self) -> int:
        """The newest committed version; 0 where nothing is committed."""
        where = self._path("manifests")
        if not self._fs().exists(where):
            return 0
        names = [f.getPath().getName() for f in self._fs().listStatus(where)]
        return max((int(n[1:9]) for n in names if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.latest() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": {}}
        stream = self._fs().open(self._path(f"manifests/v{version:08d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, base: dict, schema: str, shards: dict[str, int], what: str) -> int:
        """Write the whole manifest aside, then give it its name, which must be free."""
        version = base["version"] + 1
        body = json.dumps({"version": version, "what": what, "schema": schema, "shards": shards})
        aside, final = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/v{version:08d}.json")
        fs = self._fs()
        stream = fs.create(aside, False)
        stream.write(bytearray(body.encode()))
        stream.close()
        options = self._jvm.org.apache.hadoop.fs
        context = options.FileContext.getFileContext(fs.getUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(options.Options.Rename, 1)  # noqa: SLF001
        none[0] = options.Options.Rename.NONE
        try:
            context.rename(aside, final, none)  # fails if the name is taken
        except Exception as error:
            fs.delete(aside, False)
            raise CommitConflict(f"version {version} exists") from error
        return version

    def _publish(self, change: Callable[[dict[str, int]], dict[str, int] | None], schema: str, what: str) -> int | None:
        """Commit change(shards) on top of the newest version, again where another writer was faster; None if it gives None."""
        for attempt in range(ATTEMPTS):
            base = self.manifest()
            shards = change(base["shards"])
            if shards is None:
                return None
            try:
                return self._commit(base, schema, shards, what)
            except CommitConflict:
                if attempt == ATTEMPTS - 1:
                    raise
                time.sleep(random.uniform(0, 0.05 * min(attempt + 1, 20)))
        return None

    def append(self, df: DataFrame) -> int:
        """Add a batch as new shards, one a partition. An empty batch commits a version without new shards."""
        folder = f"shards/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        fresh = self._sizes(folder)
        return self._publish(lambda shards: shards | fresh, df.schema.json(), "append")

    def tier(self, size: int) -> int:
        tier, top = 0, SMALLEST
        while size >= top:
            tier, top = tier + 1, top * RATIO
        return tier

    def compact(self) -> int:
        """Merge tiers until none holds fan_in shards below the target; the version reached."""
        while True:
            base = self.manifest()
            tiers: dict[int, dict[str, int]] = {}
            for name, size in base["shards"].items():
                # a file that the target fits 1.5 times less than once is done
                if 3 * size < 2 * self.target:
                    tiers.setdefault(self.tier(size), {})[name] = size
            full = [t for t, held in sorted(tiers.items()) if len(held) >= self.fan_in]
            if not full:
                return base["version"]
            run = tiers[full[0]]
            files = max(1, min(len(run) // 2, round(sum(run.values()) / self.target)))
            folder = f"shards/{uuid.uuid4().hex}"
            self._files(base["schema"], run).coalesce(files).write.parquet(f"{self.root}/{folder}")
            merged = self._sizes(folder)

            def swapped(shards: dict[str, int]) -> dict[str, int] | None:
                if not run.keys() <= shards.keys():
                    return None  # another writer has merged some of them
                return {n: s for n, s in shards.items() if n not in run} | merged

            if self._publish(swapped, base["schema"], f"compact tier {full[0]}") is None:
                self._fs().delete(self._path(folder), True)

    def _files(self, schema: str, names: dict[str, int]) -> DataFrame:
        from pyspark.sql.types import StructType

        kind = StructType.fromJson(json.loads(schema))
        return self.spark.read.schema(kind).parquet(*[f"{self.root}/{n}" for n in names])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the newest one if none is named)."""
        found = self.manifest(version)
        if not found["version"]:
            raise ValueError(f"nothing is committed under {self.root}")
        if not found["shards"]:
            from pyspark.sql.types import StructType

            return self.spark.createDataFrame([], StructType.fromJson(json.loads(found["schema"])))
        return self._files(found["schema"], found["shards"])

    def vacuum(self, grace: float = GRACE) -> int:
        """Delete shards that a version has dropped at least grace seconds ago; how many.

        Only what a manifest once named goes, so shards that another writer has written but not yet committed
        stay. A reader keeps the version that it opened for the time of grace after the next one.
        """
        fs, newest, named, dropped = self._fs(), self.latest(), set(), {}
        now = time.time()
        for version in range(1, newest + 1):
            shards = set(self.manifest(version)["shards"])
            at = fs.getFileStatus(self._path(f"manifests/v{version:08d}.json")).getModificationTime() / 1000
            dropped |= dict.fromkeys(named - shards, at)
            named = shards
        old = [name for name, at in dropped.items() if name not in named and now - at >= grace]
        return sum(int(fs.delete(self._path(name), False)) for name in old)


def sharded(docs: DataFrame, root: str | None = None, target_bytes: int = TARGET_BYTES) -> ShardStore:
    """Append docs, one small shard for each of its partitions, and compact them.

    All columns and rows go through unchanged: nulls, empty and long texts, repeated rows and columns of
    any name. An empty table gives a store of an empty version.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, root or f"{scratch_root(spark)}/pagelattice/shards-{uuid.uuid4().hex}", target_bytes)
    store.append(docs)
    store.compact()
    # Nobody else can have opened a store in a new folder of its own.
    store.vacuum(GRACE if root else 0)
    return store
