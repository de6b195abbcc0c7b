"""Tables in buckets that change together, version by version.

A store is a folder of Parquet tables.  Each table is cut into a fixed number of buckets,
and a commit file names the folders that make up every bucket of every table.  A change
writes new folders and then its commit file, in one rename: readers see all of a version
or none of it, and a change that is run again replaces what it wrote before.  A change
reads and rewrites only the buckets it touches.  What one commit names is bounded by the
number of buckets and, per bucket, by the caller's compaction.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BUCKETS = 256
_PART = "_part"


def bucket_of(*columns: str | Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


class BucketStore:
    """``tables`` maps names to schemas, each with an integer column ``bucket``."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, str]):
        self.spark, self.path, self.tables = spark, path.rstrip("/"), tables

    def _files(self):
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _names(self, *parts: str) -> list[str]:
        files, folder = self._files(), self._path(*parts)
        return [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("_commits") if n.endswith(".json"))

    def _commit_of(self, version: int | None) -> dict[str, dict[str, list[str]]]:
        if version is None:
            return {}
        stream = self._files().open(self._path("_commits", f"{version:018d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest version, or the newest up to ``version``; empty before the first."""
        fit = [v for v in self.versions() if version is None or v <= version]
        return Snapshot(self, self._commit_of(fit[-1] if fit else None))

    def change(self, version: int) -> Change:
        """A change on top of the newest version before ``version``."""
        return Change(self, self.snapshot(version - 1)._parts, version)

    def vacuum(self, keep: int = 2) -> None:
        """Delete the commits before the newest ``keep`` and the folders that only they name."""
        versions = self.versions()
        kept = [self._commit_of(v) for v in versions[-keep:]]
        files = self._files()
        for version in versions[:-keep]:
            files.delete(self._path("_commits", f"{version:018d}.json"), False)
        for table in self.tables:
            used = {f for c in kept for folders in c.get(table, {}).values() for f in folders}
            for name in self._names(table):
                if name not in used:
                    files.delete(self._path(table, name), True)


class Snapshot:
    """The folders of one version."""

    def __init__(self, store: BucketStore, parts: dict[str, dict[str, list[str]]]):
        self.store, self._parts = store, parts

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a table, or of some of its buckets; other buckets' files are not opened."""
        held = self._parts.get(table, {})
        wanted = held if buckets is None else [str(b) for b in buckets if str(b) in held]
        paths = [f"{self.store.path}/{table}/{folder}/{_PART}={b}" for b in wanted for folder in held[b]]
        spark, schema = self.store.spark, self.store.tables[table]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def depth(self, table: str) -> dict[int, int]:
        """Folders per bucket."""
        return {int(b): len(folders) for b, folders in self._parts.get(table, {}).items()}


class Change(Snapshot):
    """Reads show the version before; writes become visible with :meth:`commit`."""

    def __init__(self, store: BucketStore, parts: dict[str, dict[str, list[str]]], version: int):
        super().__init__(store, parts)
        self.version = version
        self._after = {t: dict(buckets) for t, buckets in parts.items()}

    def _write(self, table: str, rows: DataFrame) -> tuple[str, list[str]]:
        folder = f"v{self.version}-{uuid.uuid4().hex[:12]}"
        names = [f.name for f in self.store.spark.createDataFrame([], self.store.tables[table]).schema]
        # One file per bucket and task; adaptive execution splits buckets that are too large for one.
        dealt = rows.select(*names).withColumn(_PART, F.col("bucket")).hint("rebalance", _PART)
        dealt.write.partitionBy(_PART).parquet(f"{self.store.path}/{table}/{folder}")
        return folder, [n.split("=")[1] for n in self.store._names(table, folder) if n.startswith(_PART)]

    def append(self, table: str, rows: DataFrame) -> None:
        folder, buckets = self._write(table, rows)
        after = self._after.setdefault(table, {})
        for b in buckets:
            after[b] = [*after.get(b, []), folder]

    def replace(self, table: str, rows: DataFrame, buckets: list[int]) -> None:
        """``rows`` become all there is in ``buckets``; they must lie in those."""
        folder, written = self._write(table, rows)
        if unknown := set(written) - {str(b) for b in buckets}:
            raise ValueError(f"rows of buckets that are not replaced: {sorted(unknown)}")
        after = self._after.setdefault(table, {})
        for b in map(str, buckets):
            after.pop(b, None)
        after.update((b, [folder]) for b in written)

    def commit(self) -> None:
        files = self.store._files()
        target = self.store._path("_commits", f"{self.version:018d}.json")
        draft = self.store._path("_commits", f".{uuid.uuid4().hex}")
        out = files.create(draft)
        try:
            out.write(bytearray(json.dumps(self._after).encode()))
        finally:
            out.close()
        files.delete(target, False)
        if not files.rename(draft, target):
            raise OSError(f"version {self.version} could not be committed")
