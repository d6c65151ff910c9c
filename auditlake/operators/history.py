"""Run snapshots: health score, retention, latest runs and trend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.functions.scale import top_n
from auditlake.schemas import SNAPSHOTS
from auditlake.sinks.store import LogStore

MAX_SNAPSHOTS = 90
DEFAULT_LAST = 10


def health_score(critical: Column, high: Column, medium: Column, low: Column) -> Column:
    """10 minus 2 / 1 / 0.3 / 0.1 per finding, at least 0, in exact tenths."""
    tenths = F.lit(100) - critical * 20 - high * 10 - medium * 3 - low
    return F.greatest(tenths, F.lit(0)).cast("double") / F.lit(10.0)


def snapshots(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per run: counts, score, findings per domain, pass flag.

    ``findings`` needs (project, run_seq, domain, severity); ``runs`` lists the
    runs (project, run_seq, ts, scanned_files), clean ones included. Findings
    are counted per (run, domain) first, so what is gathered per run is at most
    one entry per domain.
    """
    per_domain = findings.groupBy("project", "run_seq", "domain").agg(
        F.count("*").alias("n"),
        *[
            F.count_if(F.col("severity") == s.upper()).alias(s)
            for s in ("critical", "high", "medium", "low")
        ],
    )
    per_run = per_domain.groupBy("project", "run_seq").agg(
        F.sum("n").alias("total_findings"),
        *[F.sum(s).alias(s) for s in ("critical", "high", "medium", "low")],
        F.map_from_entries(
            F.sort_array(F.collect_list(F.struct("domain", "n")))
        ).alias("domains"),
    )
    zero = F.lit(0).cast("bigint")
    joined = runs.join(per_run, ["project", "run_seq"], "left")
    counted = joined.select(
        "project", "run_seq", "ts", "scanned_files",
        *[
            F.coalesce(c, zero).alias(c)
            for c in ("total_findings", "critical", "high", "medium", "low")
        ],
        F.coalesce("domains", F.create_map().cast("map<string,bigint>")).alias("domains"),
    )
    score = health_score(*[F.col(c) for c in ("critical", "high", "medium", "low")])
    return counted.withColumn("health_score", score).withColumn(
        "passed", (F.col("critical") == 0) & (F.col("high") == 0)
    )


def read_history(lines: DataFrame) -> DataFrame:
    """Snapshots from JSON lines (project, run_seq, payload).

    Missing numbers become 0, a missing time null, missing domains an empty map; a
    history that cannot be read is empty.
    """
    schema = (
        "struct<timestamp string, domains map<string,bigint>, scanned_files bigint, total_findings bigint, critical bigint, high bigint, "
        "medium bigint, low bigint, health_score double, passed boolean>"
    )
    numbers = ["scanned_files", "total_findings", "critical", "high", "medium", "low"]
    zero = F.lit(0).cast("bigint")
    return (
        lines.where(F.try_parse_json("payload").isNotNull())
        .select("project", "run_seq", F.from_json("payload", schema).alias("s"))
        .select(
            "project", "run_seq",
            F.col("s.timestamp").try_cast("timestamp_ntz").alias("ts"),
            *[F.coalesce(f"s.{n}", zero).alias(n) for n in numbers],
            F.coalesce("s.health_score", F.lit(0.0)).alias("health_score"),
            F.coalesce("s.domains", F.create_map().cast("map<string,bigint>")).alias("domains"),
            F.coalesce("s.passed", F.lit(False)).alias("passed"),
        )
    )


def last_runs(history: DataFrame, n: int = DEFAULT_LAST) -> DataFrame:
    """Latest ``n`` runs per project by append order; ``age`` 1 is the latest."""
    return top_n(history, ["project"], [F.col("run_seq").desc()], n, out="age")


def retain(history: DataFrame, keep: int = MAX_SNAPSHOTS) -> DataFrame:
    return last_runs(history, keep).drop("age")


def trend(history: DataFrame) -> DataFrame:
    """Latest score against the one before: arrow text, empty with one run."""
    two = last_runs(history, 2)
    pair = two.groupBy("project").agg(
        F.max(F.when(F.col("age") == 1, F.col("health_score"))).alias("latest"),
        F.max(F.when(F.col("age") == 2, F.col("health_score"))).alias("previous"),
    )
    delta = F.col("latest") - F.col("previous")
    text = (
        F.when(delta.isNull(), "")
        .when(delta > 0.5, F.format_string("↑ +%.1f", delta))
        .when(delta < -0.5, F.format_string("↓ %.1f", delta))
        .otherwise("→ stable")
    )
    return pair.select("project", "latest", "previous", text.alias("trend"))


def history_store(spark: SparkSession, folder: str, keep: int = MAX_SNAPSHOTS, buckets: int = 16) -> LogStore:
    """Snapshots of which a project keeps its last ``keep``, on disk as well once compacted.

    Append order is ``run_seq``; a run that is appended again replaces itself.
    """

    def merge(base: DataFrame, delta: DataFrame) -> DataFrame:
        key = ["project", "run_seq"]
        fields = F.struct(*(c for c in delta.columns if c not in (*key, "_delta")))
        new = delta.groupBy(*key).agg(F.max_by(fields, "_delta").alias("run")).select(*key, "run.*")
        return retain(base.join(new.select(*key), key, "left_anti").unionByName(new), keep)

    return LogStore(spark, folder, T.StructType.fromDDL(SNAPSHOTS), ["project"], merge, buckets)
