"""Tables as versions that replace each other whole: the store behind operators.store's changes.

Rows lie in ``cells`` parts by the hash of their key, each part in a folder of the write that made it:
data/write=<id>/cell=<n>/. A version is one small file that names, for every cell, the write whose rows count. It gets
its number by a rename that never replaces, so of two writers one wins, and readers see a version
whole or not at all. A merge rewrites the cells that its batch touches and no others; writers of
different cells both succeed. Point reads open the cells of their keys.

A version's file has a line's worth of JSON for each cell, which the driver holds: choose ``cells`` so that one has some
100 MB (100 TB: about a million). A rename that doesn't replace is what HDFS has; object stores without
it need a store of checkpoints that has. Keys are unique and not null: a null key stops the write.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer changed the same cells since this one read them. Nothing of this write shows."""


@dataclass(frozen=True)
class Version:
    """What a version's file says. ``writes`` maps a cell to its write, ``done`` a stream to its last batch."""

    number: int
    key: str
    cells: int
    schema: dict[str, Any]
    writes: dict[int, str]
    changed: tuple[int, ...]
    done: dict[str, int]


class Snapshots:
    """The table at ``path``. Every method sees the newest version unless it is told a number."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        fs = spark._jvm.org.apache.hadoop.fs
        self._at = fs.Path
        self._files = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._root = str(self._files.makeQualified(self._at(self.path)).toString())

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str, cells: int) -> Snapshots:
        """A new table that holds ``rows``. Conflict if there is one at ``path``."""
        table = cls(rows.sparkSession, path)
        if table.numbers():
            raise Conflict(f"{path} holds a table")
        start = Version(0, key, cells, json.loads(rows.schema.json()), {}, (), {})
        table._commit(start, table._written(rows, start), range(cells), start=True)
        return table

    def numbers(self) -> list[int]:
        """The versions there are, oldest first."""
        folder = self._at(f"{self._root}/versions")
        if not self._files.exists(folder):
            return []
        names = (status.getPath().getName() for status in self._files.listStatus(folder))
        return sorted(int(name[:-5]) for name in names if name.endswith(".json") and not name.startswith("."))

    def version(self, number: int | None = None) -> Version:
        if number is None:
            number = max(self.numbers(), default=0)
        at = self._at(f"{self._root}/versions/{number:012d}.json")
        if not self._files.exists(at):
            raise FileNotFoundError(f"{self.path} has no version {number}")
        stream = self._files.open(at)
        try:
            found = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Version(**found | {"writes": {int(c): w for c, w in found["writes"].items()}, "changed": tuple(found["changed"])})

    def read(self, number: int | None = None) -> DataFrame:
        """All rows of a version."""
        version = self.version(number)
        return self._rows(version, sorted(version.writes))

    def get(self, *keys: Any, number: int | None = None) -> DataFrame:
        """Rows of the given keys: their cells are opened, and the filter goes to Parquet."""
        version = self.version(number)
        kind = StructType.fromJson(version.schema)[version.key].dataType
        asked = self.spark.createDataFrame([(k,) for k in keys], StructType().add(version.key, kind))
        return self._rows(version, self._touched(asked, version)).where(F.col(version.key).isin(*keys))

    def lookup(self, keys: DataFrame, number: int | None = None) -> DataFrame:
        """Rows whose key is among ``keys`` (a column named like the key). What is collected are numbers of cells."""
        version = self.version(number)
        asked = keys.select(version.key).where(F.col(version.key).isNotNull()).distinct()
        return self._rows(version, self._touched(asked, version)).join(asked, version.key, "left_semi")

    def merge(self, batch: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame], once: tuple[str, int] | None = None) -> int:
        """The number of the version in which ``change(old, batch)`` stands for the cells of the batch's keys.

        ``change`` gets the old rows of those cells (store.upsert, store.patch and the like) and returns
        their new ones; it mustn't make rows of other keys. ``once`` is a stream's name and a batch's
        number: a batch that is not above the last one done changes nothing and gets the newest number."""
        version = self.version()
        if once and once[1] <= version.done.get(once[0], -1):
            return version.number
        keys = batch.select(version.key).where(F.col(version.key).isNotNull())
        cells = self._touched(keys, version)
        new = change(self._rows(version, cells), batch)
        self._widened(version, new)
        version = replace(version, schema=json.loads(new.schema.json()))
        return self._commit(version, self._written(new, version, cells), cells, once)

    def replace(self, rows: DataFrame) -> int:
        """A version that holds ``rows`` and nothing else. Their columns may differ from those before."""
        version = replace(self.version(), schema=json.loads(rows.schema.json()))
        return self._commit(version, self._written(rows, version), range(version.cells))

    def vacuum(self, keep: int, hours: float) -> int:
        """Remove the versions before the last ``keep``, and writes that no version left names and that are older than
        ``hours``, which must be more than the longest write takes. How many writes went."""
        numbers = self.numbers()
        for number in numbers[:-keep]:
            self._files.delete(self._at(f"{self._root}/versions/{number:012d}.json"), False)
        named = {write for number in numbers[-keep:] for write in self.version(number).writes.values()}
        before = self.spark._jvm.java.lang.System.currentTimeMillis() - hours * 3_600_000
        gone = 0
        for status in self._files.listStatus(self._at(f"{self._root}/data")):
            write = status.getPath().getName().removeprefix("write=")
            if write not in named and status.getModificationTime() <= before:
                gone += self._files.delete(status.getPath(), True)
        return gone

    @staticmethod
    def _cell(version: Version) -> Column:
        key = F.col(version.key)
        return F.when(key.isNull(), F.raise_error(F.lit("a row has no key"))).otherwise(F.pmod(F.xxhash64(key), F.lit(version.cells)).cast("int"))

    def _touched(self, keys: DataFrame, version: Version) -> list[int]:
        """The cells of keys. There are at most ``cells`` of them, however many keys."""
        kind = StructType.fromJson(version.schema)[version.key].dataType
        typed = keys.select(F.col(version.key).cast(kind).alias(version.key))
        return sorted(r[0] for r in typed.select(self._cell(version).alias("cell")).distinct().collect())

    def _rows(self, version: Version, cells: list[int]) -> DataFrame:
        schema = StructType.fromJson(version.schema)
        paths = [f"{self._root}/data/write={version.writes[c]}/cell={c}" for c in cells if c in version.writes]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self._root}/data").parquet(*paths).select(*schema.names)

    def _written(self, rows: DataFrame, version: Version, cells: list[int] | None = None) -> tuple[str, list[int]]:
        """A new write of rows, one file a cell, sorted by key; and the cells that have rows."""
        write = uuid.uuid4().hex
        at = f"{self._root}/data/write={write}"
        celled = rows.withColumn("cell", self._cell(version))
        celled.repartition("cell").sortWithinPartitions("cell", version.key).write.partitionBy("cell").parquet(at)
        held = [s.getPath().getName() for s in self._files.listStatus(self._at(at)) if s.isDirectory()]
        found = sorted(int(name.removeprefix("cell=")) for name in held)
        if cells is not None and not set(found) <= set(cells):
            self._files.delete(self._at(at), True)
            raise ValueError("a change made rows of keys that its batch doesn't hold")
        return write, found

    @staticmethod
    def _widened(version: Version, new: DataFrame) -> None:
        """Cells that aren't rewritten are read with the new columns: those may only be more."""
        was, now = StructType.fromJson(version.schema), {f.name: f.dataType for f in new.schema}
        lost = [f.name for f in was if now.get(f.name) != f.dataType]
        if lost:
            raise ValueError(f"columns are gone or of another type: {', '.join(lost)}; replace() changes them")

    def _commit(self, base: Version, written: tuple[str, list[int]], cells: Any, once: tuple[str, int] | None = None, start: bool = False) -> int:
        """The next number after ``base`` for what was written. Where others were faster, their versions are taken
        over if they changed other cells and have the same columns."""
        write, held = written
        mine, now, schema = set(cells), base, base.schema
        while True:
            writes = {c: w for c, w in now.writes.items() if c not in mine} | dict.fromkeys(held, write)
            done = now.done | ({once[0]: once[1]} if once else {})
            next_ = Version(now.number + 1, base.key, base.cells, schema, writes, tuple(sorted(mine)), done)
            if self._published(next_):
                return next_.number
            newer = [self.version(n) for n in self.numbers() if n > now.number]
            last = newer[-1]
            if once and once[1] <= last.done.get(once[0], -1):
                return last.number
            if start or any(mine & set(v.changed) for v in newer) or last.schema != now.schema or schema != now.schema:
                self._files.delete(self._at(f"{self._root}/data/write={write}"), True)
                raise Conflict(f"{self.path}: version {last.number} changed what this write changes")
            now = last

    def _published(self, version: Version) -> bool:
        """Whether the version got its number. The file is whole before it has its name."""
        jvm, folder = self.spark._jvm, f"{self._root}/versions"
        hidden, shown = self._at(f"{folder}/.{uuid.uuid4().hex}"), self._at(f"{folder}/{version.number:012d}.json")
        stream = self._files.create(hidden, False)
        try:
            stream.write(bytearray(json.dumps(version.__dict__).encode()))
        finally:
            stream.close()
        fs = jvm.org.apache.hadoop.fs
        kind = getattr(fs, "Options$Rename")
        never = self.spark.sparkContext._gateway.new_array(kind, 1)
        never[0] = kind.NONE
        context = fs.FileContext.getFileContext(shown.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(hidden, shown, never)
        except Exception as failed:
            self._files.delete(hidden, False)
            if "FileAlreadyExistsException" in str(failed):
                return False
            raise
        return True
