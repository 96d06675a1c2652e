"""The translation cache as a table that grows: entries in buckets by key, versions named by a manifest, compaction.

Joins on the key read a bucket where it lies, so however large the cache is, only the keys that are asked for are
shuffled to it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text as tx

SCHEMA = "key string, value string, round long"


class CacheStore:
    """Entries (key, value) in a folder that all executors share.

    A version is a folder of Parquet files in buckets, sorted by key; added entries are further files of it. compact() writes the next version with one entry a key, and
    the manifest, a file a version, then names it; readers of the older one are not disturbed until
    vacuum() deletes it. What a failed write leaves is in no manifest, or is an entry twice: the latest
    valid entry of a key counts, of those added together the smallest value.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.versions = self._versions()
        if self.versions:
            self.buckets = self.versions[-1]["buckets"]
        else:
            self._commit(self._write_empty(), 0)

    def _hadoop(self, *names: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _versions(self) -> list[dict]:
        """All manifests in order; as many as there were compactions since vacuum()."""
        files, path = self._hadoop("manifest")
        if not files.exists(path):
            return []
        names = sorted(x.getPath().getName() for x in files.listStatus(path) if x.getPath().getName().endswith(".json"))
        rows = self.spark.read.option("wholetext", True).text([f"{self.path}/manifest/{n}" for n in names]).collect() if names else []
        return sorted((json.loads(r["value"]) for r in rows), key=lambda m: m["number"])

    def _commit(self, folder: str, number: int) -> None:
        """A manifest is written under another name and renamed, so it is whole or not there; two writers can't both give a number."""
        files, path = self._hadoop("manifest", f"{number:08d}.json")
        _, new = self._hadoop("manifest", f"_{uuid.uuid4().hex}")
        entry = {"number": number, "folder": folder, "buckets": self.buckets}
        out = files.create(new, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        if files.exists(path) or not files.rename(new, path):
            raise ValueError(f"another writer made version {number} of {self.path}")
        self.versions.append(entry)

    def _write_empty(self) -> str:
        folder = f"v-{uuid.uuid4().hex}"
        files, path = self._hadoop(folder)
        files.mkdirs(path)
        return folder

    @staticmethod
    def _name(folder: str) -> str:
        return f"cache_{folder.replace('-', '_')}"

    def _table(self, folder: str) -> str:
        """A table over a version's folder; its buckets are known by the files' names."""
        name = self._name(folder)
        if not self.spark.catalog.tableExists(name):
            location = f"{self.path}/{folder}".replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE {name} ({SCHEMA}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{location}'")
        self.spark.catalog.refreshTable(name)
        return name

    @property
    def current(self) -> str:
        return self.versions[-1]["folder"]

    def add(self, entries: DataFrame, number: int) -> None:
        """Entries (key, value) of a round of work; later rounds have larger numbers. Null keys and what isn't a translation are left out. The same round added twice changes nothing."""
        good = entries.filter(F.col("key").isNotNull() & tx.is_valid_translation("value"))
        rows = good.select("key", "value", F.lit(number).cast("long").alias("round"))
        rows.repartition(self.buckets, "key").write.mode("append").insertInto(self._table(self.current))

    def entries(self) -> DataFrame:
        """(key, value, round), every added entry; equal keys are in one bucket."""
        return self.spark.table(self._table(self.current)).select("key", "value", "round")

    def _latest(self, rows: DataFrame) -> DataFrame:
        last = F.max(F.struct("round", F.col("value").alias("value")))
        of = rows.groupBy("key", "round").agg(F.min("value").alias("value")).groupBy("key").agg(last.alias("last"))
        return of.select("key", "last.value", "last.round")

    def lookup(self, asked: DataFrame) -> DataFrame:
        """(key, value) of those keys of asked that the cache has. asked is dealt to the buckets, its keys once each; the cache's files are read where they lie."""
        keys = asked.select("key").filter("key is not null").repartition(self.buckets, "key").dropDuplicates(["key"])
        return self._latest(self.entries().hint("merge").join(keys, "key", "left_semi")).select("key", "value")

    def compact(self) -> None:
        """The next version, with each key's latest entry, by a pass over the buckets without a shuffle."""
        folder = self._write_empty()
        self._latest(self.entries()).select("key", "value", "round").write.insertInto(self._table(folder))
        self._commit(folder, self.versions[-1]["number"] + 1)

    def close(self) -> None:
        """Forget the session's tables over the folder; the folder stays."""
        for version in self.versions:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(version['folder'])}")

    def vacuum(self) -> None:
        """Delete all versions but the current one; nothing may read them any more."""
        *old, last = self.versions
        for version in old:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(version['folder'])}")
            for names in ((version["folder"],), ("manifest", f"{version['number']:08d}.json")):
                files, path = self._hadoop(*names)
                files.delete(path, True)
        self.versions = [last]
