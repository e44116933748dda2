"""Committed state: tables in versions, which change together or not at all.

A version is a small JSON file that names, for each table, its schema and the
folders of Parquet files that hold it. A transaction writes new folders beside
the old ones and at its end publishes the next version by one rename that fails
if that version exists. So readers keep the version they began with, a run that
fails or is killed leaves the state as it was, and of two runs that began at
one version the second is told that it lost. Nothing is rewritten in place.

A table may be kept in parts, one folder for each value of a column (an
import's number): then a part is added, replaced or dropped by naming other
folders, and the files of all others stay untouched.

All file operations go through Hadoop's file systems. The rename is atomic on
HDFS and local disks; a store of objects must offer the same for its folder of
versions. ``vacuum`` removes what no kept version names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PART = "_part"
#: What Spark calls the folder of rows without a value.
_NULL = "__HIVE_DEFAULT_PARTITION__"


class Conflict(RuntimeError):
    """Another transaction has published the next version."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, below: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{below}" if below else self.root)

    def _names(self, below: str) -> list[str]:
        where = self._path(below)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def versions(self) -> list[int]:
        """The published versions that are kept."""
        return [int(n[:-5]) for n in self._names("versions") if n.endswith(".json") and n[:-5].isdigit()]

    def version(self) -> int:
        """The latest version; 0 before the first."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """The tables of a version, the latest by default: name -> schema and parts, each a list of folders."""
        version = self.version() if version is None else version
        if not version:
            return {}
        stream = self._fs.open(self._path(f"versions/{version:012d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def read(self, name: str, version: int | None = None, parts: Iterable | None = None) -> DataFrame:
        """A table of a version; of a table in parts only those of the values ``parts``, if given."""
        return self._frame(self.manifest(version)[name], parts)

    def _frame(self, entry: dict, parts: Iterable | None = None) -> DataFrame:
        schema = T.StructType.fromJson(entry["schema"])
        chosen = entry["parts"] if parts is None else {k: entry["parts"].get(k, []) for k in map(_key, parts)}
        folders = [f"{self.root}/{f}" for own in chosen.values() for f in own]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def begin(self) -> Transaction:
        return Transaction(self)

    def _publish(self, version: int, tables: dict) -> None:
        """The version's file appears whole or not at all; Conflict if it is there."""
        beside = self._path(f"versions/.{uuid.uuid4().hex}")
        out = self._fs.create(beside, False)
        try:
            out.write(bytearray(json.dumps(tables).encode()))
        finally:
            out.close()
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self._conf).rename(beside, self._path(f"versions/{version:012d}.json"), none)
        except Exception as e:
            self._fs.delete(beside, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {version} was published by another run") from e
            raise

    def vacuum(self, keep: int = 2, hours: float = 24) -> list[str]:
        """Removes all but the last ``keep`` versions, and folders that none of these names and that are older than ``hours``; returns the folders."""
        kept = self.versions()[-keep:]
        named = {f.rsplit("/_part=", 1)[0] for v in kept for e in self.manifest(v).values() for own in e["parts"].values() for f in own}
        for v in self.versions()[:-keep]:
            self._fs.delete(self._path(f"versions/{v:012d}.json"), False)
        gone, limit = [], self._jvm.java.lang.System.currentTimeMillis() - hours * 3.6e6
        for name in self._names("data"):
            for status in self._fs.listStatus(self._path(f"data/{name}")):
                folder = f"data/{name}/{status.getPath().getName()}"
                if folder not in named and status.getModificationTime() <= limit:
                    self._fs.delete(status.getPath(), True)
                    gone.append(folder)
        return gone


def _key(value) -> str:
    return _NULL if value is None else str(value)


class Transaction:
    """Changes to some tables of a store, published together when the ``with`` block ends without an error."""

    def __init__(self, store: Store):
        self.store, self.base, self.made = store, store.version(), []
        self.tables = store.manifest(self.base)

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is None and self.made is not None:
            self.commit()
        elif kind is not None:
            self.abandon()

    def read(self, name: str, parts: Iterable | None = None) -> DataFrame:
        """The table as this transaction has it."""
        return self.store._frame(self.tables[name], parts)

    def _write(self, name: str, df: DataFrame, by: str | None) -> dict[str, list[str]]:
        folder = f"data/{name}/{uuid.uuid4().hex}"
        self.made.append(folder)
        if by is None:
            df.write.parquet(f"{self.store.root}/{folder}")
            return {"": [folder]}
        df.withColumn(_PART, F.col(by).cast("string")).write.partitionBy(_PART).parquet(f"{self.store.root}/{folder}")
        return {n.removeprefix("_part="): [f"{folder}/{n}"] for n in self.store._names(folder) if n.startswith("_part=")}

    def _entry(self, name: str, df: DataFrame, by: str | None) -> dict:
        old = self.tables.get(name)
        if old is None:
            return {"schema": df.schema.jsonValue(), "by": by, "parts": {}}
        if old["by"] != by:
            raise ValueError(f"{name} is kept by {old['by']}, not by {by}")
        return old

    def write(self, name: str, df: DataFrame, by: str | None = None) -> DataFrame:
        """Replaces the whole table; returns it as written, so that what follows doesn't compute it again."""
        self.tables[name] = {"schema": df.schema.jsonValue(), "by": by, "parts": self._write(name, df, by)}
        return self.read(name)

    def append(self, name: str, df: DataFrame, by: str | None = None) -> None:
        """Adds rows, to the parts that they belong to where the table is kept by a column."""
        entry = self._entry(name, df, by)
        columns = df.select(*(f["name"] for f in entry["schema"]["fields"]))
        parts = dict(entry["parts"])
        for value, own in self._write(name, columns, by).items():
            parts[value] = parts.get(value, []) + own
        self.tables[name] = entry | {"parts": parts}

    def replace(self, name: str, df: DataFrame, by: str) -> None:
        """Replaces the parts that ``df`` has rows of; others keep their files."""
        entry = self._entry(name, df, by)
        self.tables[name] = entry | {"parts": entry["parts"] | self._write(name, df.select(*(f["name"] for f in entry["schema"]["fields"])), by)}

    def drop(self, name: str, values: Iterable) -> list[str]:
        """Takes the parts of ``values`` out of the table; returns those that it had."""
        entry, gone = self.tables[name], {_key(v) for v in values}
        self.tables[name] = entry | {"parts": {k: v for k, v in entry["parts"].items() if k not in gone}}
        return sorted(gone & entry["parts"].keys())

    def commit(self) -> int:
        """Publishes the next version and returns its number."""
        try:
            self.store._publish(self.base + 1, self.tables)
        except BaseException:
            self.abandon()
            raise
        self.made = None
        return self.base + 1

    def abandon(self) -> None:
        """Removes what was written; the state stays as it was."""
        for folder in self.made or []:
            self.store._fs.delete(self.store._path(folder), True)
        self.made = None
