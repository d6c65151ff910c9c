"""Building blocks that stay correct and even when one key is very hot.

* ``salted_lookup``: fact-to-dimension join that spreads a hot key over many
  tasks (dimension rows are replicated, fact rows are not).
* ``running_total``: exclusive running sum whose windows never hold more than a
  fixed number of rows, whatever the key distribution.
* ``stored``: cut a lineage that is used several times by writing a table.
* ``ordinals``: 1-based position of each row inside its group for a total
  order, without gathering the group in one task.
"""

from __future__ import annotations

import io
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Salts per key. Adaptive skew handling splits what is still too large.
SALT_BUCKETS = 16


def salted_lookup(
    facts: DataFrame,
    dim: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    how: str = "left",
    buckets: int = SALT_BUCKETS,
) -> DataFrame:
    """Join ``facts`` to ``dim`` on ``keys``, splitting each key ``buckets`` ways.

    ``dim`` should hold one row per key. ``spread_by`` names fact columns that
    vary inside a hot key. No broadcast is forced: when the dimension turns out
    small at run time, adaptive execution switches to a broadcast by itself.
    """
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(buckets)).cast("int")
    salts = F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))
    return (
        facts.withColumn("_salt", salt)
        .join(dim.withColumn("_salt", salts), [*keys, "_salt"], how)
        .drop("_salt")
    )


def salted_filter(
    facts: DataFrame,
    dim: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    anti: bool = False,
) -> DataFrame:
    """``left_semi`` / ``left_anti`` version of :func:`salted_lookup`."""
    how = "left_anti" if anti else "left_semi"
    return salted_lookup(facts, dim.select(*keys).distinct(), keys, spread_by, how)


def stored(df: DataFrame) -> DataFrame:
    """Write a result once to the shared checkpoint folder and read it back.

    For results that cost a scan of all texts and are used more than once. The
    table survives lost executors and keeps columnar pruning.
    """
    spark = df.sparkSession
    folder = scratch_folder(spark)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def storing(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """Like :func:`stored`, with a function that deletes the table when it was used."""
    spark = df.sparkSession
    folder = scratch_folder(spark)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder), lambda: remove_folder(spark, folder)


BLOCK_BITS = 16
SEQ_BITS = 48


def running_total(
    df: DataFrame,
    group: Sequence[str],
    seq: str,
    value: str,
    out: str,
    bits: int = SEQ_BITS,
) -> DataFrame:
    """Exclusive running sum of ``value`` by ascending non-negative ``seq``.

    ``seq`` is unique inside a group and below ``2**bits``. Rows are cut into
    blocks of 65,536 consecutive numbers; a row's total is the sum before it in
    its block plus the running total of the block sums, found the same way. No
    window partition and no join key ever covers more than one block, even if
    one group holds the whole table.
    """
    if bits <= BLOCK_BITS:
        w = Window.partitionBy(*group).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))
    block = f"_block{bits}"
    rows = df.withColumn(block, F.shiftright(F.col(seq).cast("bigint"), BLOCK_BITS))
    sums = rows.groupBy(*group, block).agg(F.sum(value).alias("_block_sum"))
    starts = running_total(
        sums, group, block, "_block_sum", "_block_start", bits - BLOCK_BITS
    ).drop("_block_sum")
    w = Window.partitionBy(*group, block).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("_inside", F.coalesce(F.sum(value).over(w), F.lit(0)))
    return inside.join(starts, [*group, block]).select(
        *df.columns, (F.col("_block_start") + F.col("_inside")).alias(out)
    )


def ordinals(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column | str],
    out: str = "ordinal",
    partitions: int | None = None,
) -> DataFrame:
    """Add each row's 1-based position inside its group.

    Rows are range-partitioned on (group, order), so a hot group spans many
    partitions. The partition number is frozen in a stored table (sampled range
    bounds may differ between two runs of one plan); each partition then
    numbers its own rows and adds the group's row count in the partitions
    before it.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    placed = stored(
        df.repartitionByRange(n, *[F.col(g) for g in group], *order_cols)
        .withColumn("_pid", F.spark_partition_id())
    )
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        placed.groupBy(*group, "_pid")
        .agg(F.count("*").alias("_n"))
        .select(*group, "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    )
    within = Window.partitionBy(*group, "_pid").orderBy(*order_cols)
    return (
        placed.withColumn("_rn", F.row_number().over(within))
        .join(offsets, [*group, "_pid"])
        .withColumn(out, (F.col("_off") + F.col("_rn")).cast("bigint"))
        .drop("_pid", "_off", "_rn")
    )


def top_n(
    df: DataFrame, group: Sequence[str], order: Sequence[Column | str], n: int, out: str = "rn"
) -> DataFrame:
    """First ``n`` rows per group.

    Written as ``row_number() <= n`` right above the window so that Spark keeps
    only ``n`` rows per group and input partition before the shuffle.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediate tables (``spark.checkpoint.dir``).

    Without that setting only a local session gets a folder of its own: on a
    cluster a driver-local folder would lose the executors' files, so the call
    fails there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if configured is None and current is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="auditlake-checkpoint-")
    if current is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured or current


def scratch_folder(spark: SparkSession, name: str = "table") -> str:
    """A new path in the shared folder; what is there goes when the session ends."""
    folder = f"{ensure_checkpoint_dir(spark)}/auditlake-{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)  # only what exists is noted for deletion
    fs.deleteOnExit(path)
    return f"{folder}/rows"


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a scratch folder that is no longer needed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver found it.

    The sources go as a zip through the shared folder, once a Spark context.
    """
    import auditlake

    context = spark.sparkContext
    root = Path(auditlake.__file__).parent
    if getattr(context, "_auditlake_shipped", False) or not root.is_dir():
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, f"auditlake/{source.relative_to(root)}")
    target = spark._jvm.org.apache.hadoop.fs.Path(
        scratch_folder(spark, "package").removesuffix("/rows"), "auditlake.zip"
    )
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    out.write(packed.getvalue())
    out.close()
    context.addPyFile(target.toString())
    context._auditlake_shipped = True
