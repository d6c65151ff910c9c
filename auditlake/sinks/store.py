"""Tables that are replaced while others read them: a manifest and a log-structured store.

``Manifest`` is a folder of numbered JSON files; the highest number is the state. A new
state is written beside and renamed into place, so a reader sees the old state or the new
one, and a writer that dies between data and manifest has changed nothing.

``LogStore`` keeps rows by key in a compacted base, cut into buckets by a hash of the key,
and in delta batches. Readers merge deltas into the buckets that they touch; untouched
buckets are read as they are. ``compact`` rewrites the touched buckets alone.

One writer at a time is assumed, as a streaming query has one driver; a second one that
commits the same number fails. Data folders are never changed, only deleted by ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
#: Files of one bucket that are written at once.
BUCKET_FILES = 4


class _Files:
    """The few file operations that are needed, on any file system Spark reads."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm = spark._jvm
        self.fs = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> Any:
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        path = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(path)] if self.fs.exists(path) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> None:
        """The whole file appears at once, or the call fails; nothing is replaced."""
        folder, _, last = name.rpartition("/")
        beside = f"{folder}/.{last}.{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(beside), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.fs.exists(self.path(name)) or not self.fs.rename(self.path(beside), self.path(name)):
            self.fs.delete(self.path(beside), False)
            raise FileExistsError(f"another writer has committed {name}")

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Manifest:
    def __init__(self, spark: SparkSession, folder: str):
        self.folder, self.files = f"{folder}/manifest", _Files(spark, folder)

    def versions(self) -> list[int]:
        names = (n for n in self.files.names(self.folder) if n.endswith(".json") and not n.startswith("."))
        return sorted(int(n.removesuffix(".json")) for n in names)

    def read(self) -> tuple[int, dict[str, Any]]:
        """(number, state); (0, {}) before the first commit."""
        versions = self.versions()
        return (versions[-1], self.state(versions[-1])) if versions else (0, {})

    def state(self, version: int) -> dict[str, Any]:
        return json.loads(self.files.read(self._name(version)))

    def commit(self, after: int, state: dict[str, Any]) -> None:
        self.files.write_new(self._name(after + 1), json.dumps(state))

    def forget(self, version: int) -> None:
        self.files.delete(self._name(version))

    def _name(self, version: int) -> str:
        return f"{self.folder}/{version:020d}.json"


class Published:
    """A small table whose versions replace each other; a reader never meets a gap."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.manifest = spark, folder, Manifest(spark, folder)

    def publish(self, df: DataFrame, batch_id: int | None = None) -> None:
        """Make ``df`` the table; a batch that was published already is not published again."""
        version, state = self.manifest.read()
        if batch_id is not None and batch_id <= state.get("batch_id", -1):
            return
        name = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{name}")
        self.manifest.commit(version, {"data": name, "batch_id": batch_id if batch_id is not None else -1})
        # readers of the version before may still be at work
        for old in self.manifest.versions()[:-2]:
            self.manifest.files.delete(f"{self.folder}/{self.manifest.state(old)['data']}")
            self.manifest.forget(old)

    def read(self) -> DataFrame:
        version, state = self.manifest.read()
        if not version:
            raise FileNotFoundError(f"nothing has been published in {self.folder}")
        return self.spark.read.parquet(f"{self.folder}/{state['data']}")


class LogStore:
    """Rows by ``keys``; ``merge(base, delta)`` says what remains of both.

    ``delta`` has a further column ``_delta``, higher in later batches.
    """

    def __init__(
        self, spark: SparkSession, folder: str, schema: T.StructType, keys: Sequence[str],
        merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS,
    ):
        self.spark, self.folder, self.schema = spark, folder, schema
        self.keys, self.merge, self.buckets = list(keys), merge, buckets
        self.manifest = Manifest(spark, folder)

    def _state(self) -> tuple[int, dict[str, Any]]:
        version, state = self.manifest.read()
        return version, {"base": {}, "deltas": [], "batch_id": -1, **state}

    def _write(self, df: DataFrame, kind: str) -> dict[str, Any]:
        """Writes rows by bucket; where they are and which buckets there are."""
        name = f"data/{kind}-{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        spread = F.pmod(F.hash(*self.keys), F.lit(BUCKET_FILES))
        (
            df.select(*self.schema.names).withColumn("bucket", bucket)
            .repartition(F.col("bucket"), spread).write.partitionBy("bucket").parquet(f"{self.folder}/{name}")
        )
        parts = [n for n in self.manifest.files.names(f"{self.folder}/{name}") if n.startswith("bucket=")]
        return {"name": name, "buckets": sorted(int(n.removeprefix("bucket=")) for n in parts)}

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/{p}" for p in paths))

    def append(self, df: DataFrame, batch_id: int | None = None) -> None:
        """Adds a delta. A batch that was added already, delivered again, is passed over."""
        version, state = self._state()
        if batch_id is not None and batch_id <= state["batch_id"]:
            return
        delta = self._write(df, "delta")
        if batch_id is not None:
            state["batch_id"] = batch_id
        if delta["buckets"]:
            state["deltas"].append(delta)
        self.manifest.commit(version, state)

    def _merged(self, state: dict[str, Any]) -> tuple[DataFrame, set[int]]:
        """Rows of the touched buckets as of now, and these buckets."""
        touched = {b for d in state["deltas"] for b in d["buckets"]}
        base = self._read([f"{n}/bucket={b}" for b, n in state["base"].items() if int(b) in touched])
        deltas = [
            self._read([f"{d['name']}/bucket={b}" for b in d["buckets"]]).withColumn("_delta", F.lit(i))
            for i, d in enumerate(state["deltas"])
        ]
        delta = reduce(DataFrame.unionByName, deltas, self._read([]).withColumn("_delta", F.lit(0)))
        return self.merge(base, delta).select(*self.schema.names), touched

    def read(self) -> DataFrame:
        _, state = self._state()
        merged, touched = self._merged(state)
        quiet = self._read([f"{n}/bucket={b}" for b, n in state["base"].items() if int(b) not in touched])
        return quiet.unionByName(merged) if touched else quiet

    def pending(self) -> int:
        """Deltas that are not compacted yet."""
        return len(self._state()[1]["deltas"])

    def compact(self) -> None:
        """Merges all deltas into new versions of the buckets that they touch."""
        version, state = self._state()
        if not state["deltas"]:
            return
        merged, touched = self._merged(state)
        new = self._write(merged, "base")
        kept = {b: n for b, n in state["base"].items() if int(b) not in touched}
        state["base"] = kept | {str(b): new["name"] for b in new["buckets"]}
        state["deltas"] = []
        self.manifest.commit(version, state)

    def vacuum(self, keep: int = 1) -> None:
        """Deletes what no manifest refers to but the last ``keep``; readers of older ones,
        and writers, must have ended."""
        versions = self.manifest.versions()
        for old in versions[: max(0, len(versions) - keep)]:
            self.manifest.forget(old)
        used: set[str] = set()
        for version in self.manifest.versions():
            state = self.manifest.state(version)
            used |= {d["name"] for d in state["deltas"]}
            used |= {f"{n}/bucket={b}" for b, n in state["base"].items()}
        names = {u.split("/bucket=")[0] for u in used}
        for folder in self.manifest.files.names(f"{self.folder}/data"):
            name = f"data/{folder}"
            if name not in names:
                self.manifest.files.delete(f"{self.folder}/{name}")
            elif folder.startswith("base-"):
                for part in self.manifest.files.names(f"{self.folder}/{name}"):
                    if part.startswith("bucket=") and f"{name}/{part}" not in used:
                        self.manifest.files.delete(f"{self.folder}/{name}/{part}")
