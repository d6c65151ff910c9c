"""File tables: reading source trees, storing them, and reading side files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial, reduce

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions import text as tx
from auditlake.functions.scale import stored
from auditlake.operators.selection import in_skipped_dir, is_source, with_path_columns


_ENTRIES = "path string, is_dir boolean, size bigint, mtime_us bigint"
_READ_BATCH_BYTES = 64 << 20


NOT_READ = "not read"


def _list_folders(
    batches: Iterator[pd.DataFrame], missing_ok: bool = True
) -> Iterator[pd.DataFrame]:
    """Entries of each folder in the batches, one listing call per folder.

    A folder below the root may go between two rounds; a missing root is an error.
    """
    for batch in batches:
        for folder in batch["path"]:
            filesystem, inner = pafs.FileSystem.from_uri(folder)
            prefix = folder[: len(folder) - len(inner)] if folder.endswith(inner) else ""
            found = filesystem.get_file_info(pafs.FileSelector(inner, allow_not_found=missing_ok))
            yield pd.DataFrame(
                {
                    "path": [prefix + i.path for i in found],
                    "is_dir": [i.type == pafs.FileType.Directory for i in found],
                    "size": [i.size or 0 for i in found],
                    "mtime_us": [(i.mtime_ns or 0) // 1000 for i in found],
                }
            )


def _read_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts of the listed files, in batches of bounded size; null with the reason where unread."""
    for batch in batches:
        start = held = 0
        texts: list[str | None] = []
        reasons: list[str | None] = []
        for i, (path, wanted, size) in enumerate(zip(batch["path"], batch["wanted"], batch["size"])):
            text, reason = None, NOT_READ
            if wanted:
                try:
                    filesystem, inner = pafs.FileSystem.from_uri(path)
                    with filesystem.open_input_file(inner) as handle:
                        text = handle.read().decode("utf-8", errors="replace")
                    reason = None
                except OSError as error:
                    reason = f"read error: {error}"
            texts.append(text)
            reasons.append(reason)
            held += size if wanted else 0
            if held >= _READ_BATCH_BYTES:
                yield batch.iloc[start : i + 1].assign(content=texts, unread=reasons)
                start, held, texts, reasons = i + 1, 0, [], []
        if texts:
            yield batch.iloc[start:].assign(content=texts, unread=reasons)


def list_tree(spark: SparkSession, folder: str, prune: Sequence[str] = ()) -> DataFrame:
    """All files below a folder, dot files and underscore names included.

    Spark's own file sources leave out names that start with a dot or an
    underscore (``.env``, ``.gitignore``, ``__init__.py``), so folders are
    listed level by level: each round is one job over all folders of a level,
    which splits even one very large project over all tasks. ``prune`` names
    folders that are not entered.
    """
    parallel = spark.sparkContext.defaultParallelism
    frontier = spark.createDataFrame([(folder.rstrip("/"),)], "path string")
    levels: list[DataFrame] = []
    while True:
        listing = partial(_list_folders, missing_ok=bool(levels))
        entries = stored(frontier.repartition(parallel).mapInPandas(listing, _ENTRIES))
        levels.append(entries.where(~F.col("is_dir")))
        frontier = entries.where(
            F.col("is_dir") & ~tx.path_name(F.col("path")).isin(*(prune or [""]))
        ).select("path")
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, levels).drop("is_dir")


def read_tree(
    spark: SparkSession,
    folder: str,
    project_depth: int = 1,
    root: str = "",
    prune: Sequence[str] = (),
    lanes: Sequence[str] = ("root", "source"),
) -> DataFrame:
    """Read a folder tree of projects into a ``files`` table.

    The first ``project_depth`` path parts below ``folder`` name the project;
    the rest is the path inside it. Texts are read for files of the named lanes
    (see :func:`lane_of`). The text of any other file, and of one that cannot be read,
    is null and ``unread`` names the reason; a scan that would look at it gives an error
    row. A missing folder raises. Reading many small files is slow: read a tree once,
    store it with :func:`write_files`, scan the table.
    """
    relative = F.split(F.substring("path", len(folder.rstrip("/")) + 2, 1 << 30), "/")
    listed = list_tree(spark, folder, prune).withColumn("_parts", relative)
    inside = F.array_join(F.slice("_parts", project_depth + 1, F.size("_parts")), "/")
    listed = listed.where(F.size("_parts") > project_depth).select(
        F.array_join(F.slice("_parts", 1, project_depth), "/").alias("project"),
        inside.alias("inner"), "path", "size", "mtime_us",
    )
    name = tx.path_name(F.col("inner"))
    lane = lane_of(F.col("inner"), name, tx.path_suffix(name))
    wanted = listed.withColumn("wanted", lane.isin(*lanes))
    schema = (
        "project string, inner string, path string, size bigint, mtime_us bigint, "
        "wanted boolean, content string, unread string"
    )
    texts = wanted.repartition(
        max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ).mapInPandas(_read_texts, schema)
    return texts.select(
        "project", F.lit(root).alias("root"), F.col("inner").alias("path"), "content",
        (F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(
            F.lit(0), F.lit(0), F.lit(0), F.col("mtime_us") / F.lit(1e6))).alias("mtime"),
        "unread",
    )


def lane_of(path: Column, name: Column, suffix: Column) -> Column:
    """Storage lane: project root files, sources, sources in usually skipped
    folders, everything else."""
    return (
        F.when(~path.contains("/"), "root")
        .when(is_source(name, suffix), F.when(in_skipped_dir(path), "skipped").otherwise("source"))
        .otherwise("other")
    )


def write_files(files: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """Store a ``files`` table so that later scans prune.

    Partitioned by lane: side-file lookups read the small ``root`` lane, scans
    skip what they never read. ``name`` and ``suffix`` are stored, so selections on them
    reach the parquet reader. Every task writes its own rows; no text is
    shuffled.
    """
    keyed = with_path_columns(files)
    lane = lane_of(F.col("path"), F.col("name"), F.col("suffix"))
    keyed.withColumn("lane", lane).write.mode(mode).partitionBy("lane").parquet(folder)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def root_only(files: DataFrame) -> DataFrame:
    """Files directly in a project's root folder."""
    if "lane" in files.columns:
        return files.where(F.col("lane") == "root")
    return files.where(~F.col("path").contains("/"))


def ignore_lines(files: DataFrame) -> DataFrame:
    """Active lines of every root ``.gitignore``: one row per line."""
    line = F.explode(F.transform(tx.split_lines(F.col("content")), tx.strip))
    return (
        root_only(files)
        .where(F.col("path") == ".gitignore")
        .select("project", line.alias("pattern"))
        .where((F.col("pattern") != "") & ~F.col("pattern").startswith("#"))
    )


def registry_configs(files: DataFrame) -> DataFrame:
    """Projects with a root ``.npmrc``."""
    return root_only(files).where(F.col("path") == ".npmrc").select("project")

