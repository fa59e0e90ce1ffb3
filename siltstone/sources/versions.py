"""Versioned tables: a write becomes visible all at once, and readers keep theirs.

Each write goes to a new directory; then the manifest, a small file naming the current
version, is replaced by renaming. A failed write leaves the former version in place. The
former version stays for its readers until the next write.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionedTable:
    """A parquet table below ``root``, on any file system that Spark's session can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifest(self):
        return self._path(f"{self.root}/_current.json")

    def current(self) -> str | None:
        content = self._content()
        return content["version"] if content else None

    def _content(self) -> dict | None:
        if not self._fs.exists(self._manifest()):
            return None
        stream = self._fs.open(self._manifest())
        try:
            raw = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(raw)

    def read(self) -> DataFrame:
        version = self.current()
        if version is None:
            raise FileNotFoundError(self.root)
        return self.spark.read.parquet(f"{self.root}/{version}")

    def _switch(self, version: str, content: dict) -> None:
        """Makes a manifest the current one; versions that neither it nor the former names go."""
        former = self._content()
        waiting = self._path(f"{self.root}/_next-{version}.json")
        out = self._fs.create(waiting, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        # One rename that overwrites: readers see the former or the new manifest, never none.
        files = self.spark._jvm.org.apache.hadoop.fs
        option = self.spark.sparkContext._gateway.new_array(files.Options.Rename, 1)
        option[0] = files.Options.Rename.OVERWRITE
        files.FileContext.getFileContext(waiting.toUri(), self.spark._jsc.hadoopConfiguration()).rename(waiting, self._manifest(), option)
        named = {v for c in (content, former or {}) for v in (c.get("version"), *c.get("buckets", {}).values()) if v}
        for status in self._fs.listStatus(self._path(self.root)):
            name = status.getPath().getName()
            if name.startswith("v-") and name not in named:
                self._fs.delete(status.getPath(), True)

    def replace(self, df: DataFrame, partition_by: tuple[str, ...] = ()) -> str:
        version = f"v-{uuid.uuid4().hex}"
        writer = df.write.mode("errorifexists")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{self.root}/{version}")
        self._switch(version, {"version": version})
        return version


class BucketedTable(VersionedTable):
    """A table in buckets by the hash of its keys; a merge rewrites only the buckets it touches."""

    def __init__(self, spark: SparkSession, root: str, keys: tuple[str, ...], buckets: int = 64):
        super().__init__(spark, root)
        self.keys, self.buckets = keys, buckets

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _paths(self, held: dict[str, str], wanted) -> list[str]:
        return [f"{self.root}/{held[b]}/_b={b}" for b in wanted if b in held]

    def read(self) -> DataFrame:
        content = self._content()
        if content is None:
            raise FileNotFoundError(self.root)
        return self.spark.read.parquet(*self._paths(content["buckets"], content["buckets"]))

    def merge(self, rows: DataFrame) -> list[str]:
        """Rows by key replace the former ones; the touched buckets. The keys are unique in ``rows``."""
        held = (self._content() or {}).get("buckets", {})
        placed = rows.withColumn("_b", self._bucket())
        touched = sorted(str(r["_b"]) for r in placed.select("_b").distinct().collect())
        if not touched:
            return []
        version = f"v-{uuid.uuid4().hex}"
        paths = self._paths(held, touched)
        if paths:
            old = self.spark.read.parquet(*paths).select(*rows.columns).withColumn("_b", self._bucket())
            placed = old.join(rows.select(*self.keys).distinct(), list(self.keys), "left_anti").unionByName(placed)
        placed.write.mode("errorifexists").partitionBy("_b").parquet(f"{self.root}/{version}")
        self._switch(version, {"version": None, "buckets": {**held, **dict.fromkeys(touched, version)}})
        return touched
