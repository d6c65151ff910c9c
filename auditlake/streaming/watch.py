"""Watching sources: snapshot diffs in batch, rescans of changed files as a stream.

A ``versions`` stream or table has one row per change of a file: (project,
root, path, version, op, content), op ``write`` or ``remove``; versions grow
with arrival, so file clocks never matter. Rescans are stateless and append;
the current view is "findings of each file's latest version".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from auditlake import catalog
from auditlake.functions import text as tx
from auditlake.functions.scale import storing
from auditlake.functions.sql import array
from auditlake.operators.rules import scan
from auditlake.operators.selection import eligible_files, with_path_columns
from auditlake.schemas import FINDING_COLUMNS, FINDINGS
from auditlake.sinks.store import BUCKETS, LogStore, Published


def is_watched(path: Column) -> Column:
    """Source suffix or env name, outside the pruned folders.

    Only folders are pruned: a file that is called like one is still watched.
    ``package.json`` is scanned but not watched.
    """
    name = tx.path_name(path)
    parts = tx.path_parts(path)
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    pruned = F.arrays_overlap(folders, F.expr(array(catalog.SKIPPED_DIRS)))
    return ~pruned & (
        tx.path_suffix(name).isin(*catalog.WATCHED_SUFFIXES) | name.startswith(".env")
    )


def snapshot(files: DataFrame) -> DataFrame:
    """Watched paths and their modification times."""
    return files.select("project", "path", "mtime").where(is_watched(F.col("path")))


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added, removed and modified paths (any different time counts)."""
    key = ["project", "path"]
    both = old.select(*key, F.col("mtime").alias("_old")).join(
        new.select(*key, F.col("mtime").alias("_new")), key, "full_outer"
    )
    change = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), "removed")
        .when(F.col("_old") != F.col("_new"), "modified")
    )
    return both.select(*key, change.alias("change")).where(F.col("change").isNotNull())


def watched_versions(versions: DataFrame) -> DataFrame:
    return versions.where(is_watched(F.col("path")))


def rescan(versions: DataFrame, root_files: DataFrame) -> DataFrame:
    """Built-in findings of every written version (batch or stream)."""
    written = with_path_columns(watched_versions(versions).where(F.col("op") == "write"))
    return scan(written, root_files, carry=["version"])


def scanned_total(versions: DataFrame) -> DataFrame:
    """Rescans per project, files counted again each time (batch or stream)."""
    written = eligible_files(watched_versions(versions).where(F.col("op") == "write"))
    return written.groupBy("project").agg(F.count("*").alias("scanned_files"))


def start_rescan(
    versions: DataFrame, root_files: DataFrame, folder: str, checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Run the rescan stream, appending findings and the change log below ``folder``.

    Each micro-batch writes its own ``batch_id`` folder in overwrite mode, so a
    batch that is repeated after a failure replaces its first try.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        log = watched_versions(batch).select("project", "path", "version", "op")
        log.write.mode("overwrite").parquet(f"{folder}/changes/batch_id={batch_id}")
        rescan(batch, root_files).write.mode("overwrite").parquet(
            f"{folder}/findings/batch_id={batch_id}"
        )

    writer = versions.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()


def start_scanned_total(
    versions: DataFrame, folder: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Keep the rescan counts of all projects as a small table in ``folder``."""

    def write_totals(totals: DataFrame, batch_id: int) -> None:
        totals.write.mode("overwrite").parquet(folder)

    writer = (
        scanned_total(versions).writeStream.outputMode("complete")
        .foreachBatch(write_totals).option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()


def current_findings(
    changes: DataFrame, rescanned: DataFrame, base: DataFrame | None = None
) -> DataFrame:
    """Findings as of now: a file's latest version replaces everything before it.

    ``base`` holds the findings of the initial scan (all domains); those of
    changed or removed files are dropped. The version is part of the join key,
    so a file with very many versions does not make a hot key.
    """
    latest = changes.groupBy("project", F.col("path").alias("file")).agg(
        F.max("version").alias("version"), F.max_by("op", "version").alias("op")
    )
    alive = latest.where(F.col("op") == "write").select("project", "file", "version")
    now = rescanned.join(alive, ["project", "file", "version"], "left_semi").select(
        *FINDING_COLUMNS
    )
    if base is None:
        return now
    kept = base.join(latest.select("project", "file"), ["project", "file"], "left_anti")
    return kept.select(*FINDING_COLUMNS).unionByName(now)


# ------------------------------------------------------------- maintained view
_FOUND = [c for c in FINDING_COLUMNS if c not in ("project", "file")]


def _file_rows(versions: DataFrame, found: DataFrame) -> DataFrame:
    """One row a file version: its findings as an array, empty for a clean or removed file."""
    per_file = found.groupBy("project", "file", "version").agg(
        F.collect_list(F.struct(*_FOUND)).alias("findings"))
    rows = versions.select("project", F.col("path").alias("file"), "version", "op").distinct()
    none = F.array().cast(per_file.schema["findings"].dataType)
    return rows.join(per_file, ["project", "file", "version"], "left").withColumn(
        "findings", F.coalesce("findings", none))


def _latest(base: DataFrame, delta: DataFrame) -> DataFrame:
    """A file's latest version wins, whichever side it is on."""
    key = ["project", "file"]
    content = F.struct("version", "op", "findings")
    new = delta.groupBy(*key).agg(F.max_by(content, "version").alias("new"))
    both = base.select(*key, content.alias("old")).join(new, key, "full_outer")
    later = F.col("old").isNull() | (F.col("new.version") > F.col("old.version"))
    return both.select(*key, F.when(later, F.col("new")).otherwise(F.col("old")).alias("v")).select(*key, "v.*")


class CurrentFindings:
    """Findings of each file's latest version, kept up to date at the cost of what changes.

    A change of a file replaces its findings; only the buckets with changes are merged when
    read and rewritten when compacted. Late and repeated versions change nothing. Removed
    files stay as rows without findings, so that a late older version is known to be old.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        found = T.ArrayType(T.StructType([f for f in T.StructType.fromDDL(FINDINGS) if f.name in _FOUND]))
        schema = T.StructType([
            T.StructField("project", T.StringType()), T.StructField("file", T.StringType()),
            T.StructField("version", T.LongType()), T.StructField("op", T.StringType()),
            T.StructField("findings", found),
        ])
        self.store = LogStore(spark, folder, schema, ["project", "file"], _latest, buckets)

    def start(self, found: DataFrame) -> None:
        """The findings of a first scan (all domains); any change of a file comes after it."""
        rows = found.select(*FINDING_COLUMNS, F.lit(-1).cast("bigint").alias("version"))
        files = rows.select("project", F.col("file").alias("path"), "version", F.lit("write").alias("op"))
        self.store.append(_file_rows(files, rows))
        self.store.compact()

    def change(self, versions: DataFrame, root_files: DataFrame, batch_id: int | None = None) -> None:
        """Rescans a batch of file versions, which is read once."""
        kept, done = storing(watched_versions(versions))
        self.store.append(_file_rows(kept, rescan(kept, root_files)), batch_id)
        done()

    def read(self) -> DataFrame:
        rows = self.store.read().where(F.col("op") == "write")
        return rows.select("project", "file", F.inline("findings")).select(*FINDING_COLUMNS)

    def follow(
        self, versions: DataFrame, root_files: DataFrame, checkpoint: str,
        compact_every: int = 16, available_now: bool = False,
    ) -> StreamingQuery:
        """Keep the view up to date from a stream; deltas are compacted every so many batches."""

        def apply(batch: DataFrame, batch_id: int) -> None:
            self.change(batch, root_files, batch_id)
            if self.store.pending() >= compact_every:
                self.store.compact()

        writer = versions.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
        writer = writer.trigger(availableNow=True) if available_now else writer
        return writer.start()


def delivered_once(versions: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """A stream in which an event may come again, with each version once.

    A repetition is dropped if it comes within ``delay`` of the first, by event time; the
    state holds the versions of that span alone.
    """
    timed = versions.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return timed.dropDuplicatesWithinWatermark(["project", "path", "version"]).drop(time)


def start_published_total(
    versions: DataFrame, folder: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Keep the rescan counts of all projects as a published table (:class:`Published`)."""
    table = Published(versions.sparkSession, folder)
    writer = (
        scanned_total(versions).writeStream.outputMode("complete")
        .foreachBatch(lambda totals, batch_id: table.publish(totals, batch_id))
        .option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
