"""Which files are scanned: path columns, skip rules, eligibility, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake import catalog
from auditlake.functions import text as tx
from auditlake.functions.sql import array


def with_path_columns(files: DataFrame) -> DataFrame:
    """Add ``name`` and ``suffix`` unless the table already stores them."""
    if "name" not in files.columns:
        files = files.withColumn("name", tx.path_name(F.col("path")))
    if "suffix" not in files.columns:
        files = files.withColumn("suffix", tx.path_suffix(F.col("name")))
    return files


def in_skipped_dir(path: Column, dirs: Sequence[str] = tuple(catalog.SKIPPED_DIRS)) -> Column:
    """True if any path part, the file name included, is a skipped name."""
    return F.arrays_overlap(tx.path_parts(path), F.expr(array(dirs)))


def is_source(name: Column, suffix: Column) -> Column:
    return (
        suffix.isin(*catalog.SOURCE_SUFFIXES)
        | name.startswith(".env")
        | name.isin(*catalog.ALWAYS_SCANNED)
    )


def eligible_files(
    files: DataFrame, skipped_dirs: Sequence[str] = tuple(catalog.SKIPPED_DIRS)
) -> DataFrame:
    """Files the text and dependency rules read."""
    files = with_path_columns(files)
    if "lane" in files.columns:  # a stored table: prune partitions
        lanes = ["root", "source"]
        if not set(catalog.SKIPPED_DIRS) <= set(skipped_dirs):
            lanes.append("skipped")
        files = files.where(F.col("lane").isin(*lanes))
    name, suffix = F.col("name"), F.col("suffix")
    return files.where(
        is_source(name, suffix)
        & ~name.isin(*catalog.SKIPPED_NAMES)
        & ~in_skipped_dir(F.col("path"), skipped_dirs)
    )


def scanned_counts(files: DataFrame) -> DataFrame:
    """Scanned files per project (projects without any are absent)."""
    return (
        eligible_files(files).groupBy("project").agg(F.count("*").alias("scanned_files"))
    )


def is_dockerfile(name: Column) -> Column:
    low = F.lower(name)
    return (
        (low == "dockerfile") | low.startswith("dockerfile.") | low.endswith(".dockerfile")
    )
