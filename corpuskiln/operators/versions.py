"""An index of Parquet folders with committed versions: one writer at a time, deltas, compaction, look-up by bucket.

A version is a small file that names the folders it consists of; readers see whole versions only. A write adds one folder
(a delta); when there are more than ``most_deltas`` of them they are merged into one, so a version never has more folders than
that, and what a write reads of the index (keys and hashes of the buckets that it touches) does not grow with the number of
writes. A write that dies before its version is committed leaves a folder that no version names: ``clean`` removes it.

Needs a file system where creating a file fails if it exists and renaming is atomic (HDFS, POSIX).
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.operators.state import last_write, unseen


class Busy(RuntimeError):
    """Another writer holds the index."""


@dataclass
class IndexVersions:
    """Index at ``place``, keyed by ``key``; rows with an unchanged ``digest`` are not written again.

    ``buckets`` should follow the size of the index; a writer that has not ended after ``lease_s`` seconds loses its lock."""

    spark: SparkSession
    place: str
    key: str = "point_id"
    digest: str = "text_hash"
    buckets: int = 16
    most_deltas: int = 8
    lease_s: float = 6 * 3600

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.place}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _write_text(self, name: str, text: str, overwrite: bool) -> None:
        out = self._fs().create(self._path(name), overwrite)
        out.write(bytearray(text.encode()))
        out.close()

    def _read_text(self, name: str) -> str:
        return "\n".join(r.value for r in self.spark.read.text(f"{self.place}/{name}").collect())  # one small file of a version

    def _numbers(self) -> list[int]:
        found = self._fs().globStatus(self._path("commits/*.json")) or []
        return sorted(int(f.getPath().getName().partition(".")[0]) for f in found)

    def manifest(self, number: int | None = None) -> dict:
        """The newest (or the given) version: its number, folders from oldest to newest, and the last epoch of each source."""
        numbers = self._numbers()
        if not numbers:
            return {"number": -1, "folders": [], "epochs": {}}
        return json.loads(self._read_text(f"commits/{numbers[-1] if number is None else number:012}.json"))

    @contextmanager
    def writer(self) -> Iterator[None]:
        """The lock of the one writer; ``Busy`` where another one holds it."""
        fs, lock = self._fs(), self._path("writer.lock")
        if fs.exists(lock) and time.time() - fs.getFileStatus(lock).getModificationTime() / 1000 > self.lease_s:
            fs.delete(lock, False)
        try:
            self._write_text("writer.lock", "", overwrite=False)
        except Exception as e:
            if fs.exists(lock):
                raise Busy(f"{self.place} is being written") from e
            raise
        try:
            yield
        finally:
            fs.delete(lock, False)

    def _commit(self, old: dict, folders: list[str], epochs: dict[str, int]) -> dict:
        new = {"number": old["number"] + 1, "folders": folders, "epochs": epochs}
        self._write_text("commits/next.tmp", json.dumps(new), overwrite=True)
        if not self._fs().rename(self._path("commits/next.tmp"), self._path(f"commits/{new['number']:012}.json")):
            raise OSError(f"version {new['number']} of {self.place} was not committed")
        return new

    def _current(self, version: dict, columns: list[str] | None = None, buckets: list[int] | None = None) -> DataFrame:
        parts = []
        for i, name in enumerate(version["folders"]):
            if not self._fs().exists(self._path(name)):
                raise FileNotFoundError(f"{self.place}/{name}, which version {version['number']} names, is missing")
            part = self.spark.read.parquet(f"{self.place}/{name}")
            part = part if buckets is None else part.filter(F.col("bucket").isin(buckets))
            parts.append((part if columns is None else part.select(self.key, *columns)).withColumn("_order", F.lit(i)))
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        if len(parts) == 1:
            return rows.drop("_order")
        rest = [c for c in rows.columns if c not in (self.key, "_order")]
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), "_order").alias("_r")).select(self.key, "_r.*")

    def rows(self, number: int | None = None) -> DataFrame:
        """Rows of the newest (or the given) version, one of each key."""
        version = self.manifest(number)
        if not version["folders"]:
            raise FileNotFoundError(f"{self.place} has no rows yet")
        return self._current(version).drop("bucket")

    def _add(self, rows: DataFrame) -> list[str]:
        name = f"data-{uuid.uuid4().hex}"
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.place}/{name}")
        return [name] if self._fs().globStatus(self._path(f"{name}/bucket=*")) else []  # nothing new: no folder

    def upsert(self, batch: DataFrame, source: str = "", epoch: int | None = None) -> dict:
        """New and changed rows of ``batch`` as a new version; an epoch of a source that is committed already changes nothing.

        Of rows with one key the one with the greatest digest stays, so that a batch that runs again gives the same."""
        with self.writer():
            version = self.manifest()
            if epoch is not None and epoch <= version["epochs"].get(source, -1):
                return version
            rows = last_write(batch, [self.key], [F.desc(self.digest)]).withColumn("bucket", F.expr(f"cast(pmod(xxhash64({self.key}), {self.buckets}) as int)"))
            if version["folders"]:
                touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # numbers of buckets
                rows = unseen(rows, self._current(version, [self.digest], touched), [self.key, self.digest])
            epochs = version["epochs"] if epoch is None else {**version["epochs"], source: epoch}
            version = self._commit(version, version["folders"] + self._add(rows), epochs)
            if len(version["folders"]) > self.most_deltas:
                version = self._commit(version, self._add(self._current(version)), version["epochs"])
            return version

    def compact(self) -> dict:
        """All folders merged into one, as a new version."""
        with self.writer():
            version = self.manifest()
            return version if len(version["folders"]) < 2 else self._commit(version, self._add(self._current(version)), version["epochs"])

    def clean(self, keep: int = 2) -> int:
        """Removes versions but for the newest ``keep``, and folders that none of these names; gives the number of folders."""
        with self.writer():
            numbers = self._numbers()
            named = {name for n in numbers[-keep:] for name in self.manifest(n)["folders"]}
            for n in numbers[:-keep]:
                self._fs().delete(self._path(f"commits/{n:012}.json"), False)
            found = [f.getPath().getName() for f in self._fs().globStatus(self._path("data-*")) or []]
            unused = [name for name in found if name not in named]
            for name in unused:
                self._fs().delete(self._path(name), True)
            return len(unused)


def run_steps(steps: list[tuple[str, Callable[[], object]]]) -> list[tuple[str, bool, str]]:
    """Steps of a sync in order, each with its name, success and message; those after a failed one do not run."""
    out = []
    for name, step in steps:
        try:
            step()
        except Exception as e:  # the report names what failed
            return [*out, (name, False, f"{type(e).__name__}: {e}")]
        out.append((name, True, ""))
    return out
