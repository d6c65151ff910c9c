"""A failure boundary around each domain of a scan.

Every domain is its own Spark job, started from its own thread with its own job group
and scheduler pool, at most ``PARALLEL`` at a time. Its findings are stored as a table;
their numbers come from metrics that Spark observes while it writes, and the time is that
of the job. An exception fails that domain alone, whether it is raised while the plan is
built, inside a task or by the question whether the domain is available.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.scale import remove_folder, scratch_folder

PARALLEL = 4


@dataclass(frozen=True)
class DomainRun:
    """What became of one domain; ``found`` is its stored findings, None if it failed."""

    name: str
    found: DataFrame | None
    seconds: float = 0.0
    findings: int = 0
    bad: int = 0
    error: str | None = None


def reason(exc: Exception) -> str:
    """One line that says why a domain failed.

    An exception of a Python task comes with the worker's traceback, whose last line is the
    exception itself; one of the JVM starts with its own message.
    """
    lines = [line.strip() for line in str(exc).splitlines() if line.strip()]
    if any(line.startswith("Traceback") for line in lines):
        raised = [line for line in lines if re.match(r"[\w.]+(Error|Exception)\b", line)]
        return raised[-1] if raised else lines[-1]
    return lines[0] if lines else type(exc).__name__


def run_one(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DomainRun:
    """Builds, runs and stores one domain's findings; never raises."""
    context = spark.sparkContext
    group = f"domain-{name}-{uuid.uuid4().hex[:8]}"
    folder = None
    start = time.perf_counter()
    try:
        context.setJobGroup(group, f"scan domain {name}", interruptOnCancel=True)
        context.setLocalProperty("spark.scheduler.pool", f"domain-{name}")
        metrics = Observation(group)
        found = build()
        watched = found.observe(
            metrics,
            F.count(F.lit(1)).alias("findings"),
            F.count(F.when(F.col("sev_rank") <= 1, 1)).alias("bad"),
        )
        folder = scratch_folder(spark, "domain")
        watched.write.parquet(folder)
        counts = metrics.get
        return DomainRun(
            name, spark.read.schema(found.schema).parquet(folder), time.perf_counter() - start,
            int(counts["findings"]), int(counts["bad"]),
        )
    except Exception as exc:  # the boundary: any failure of a domain is a row of the result
        if folder is not None:
            remove_folder(spark, folder)  # what it wrote is not used
        return DomainRun(name, None, error=reason(exc))


def run_isolated(
    spark: SparkSession, domains: Mapping[str, Callable[[], DataFrame]], parallel: int = PARALLEL
) -> list[DomainRun]:
    """Runs of all domains, in the order given."""
    if not domains:
        return []
    with ThreadPoolExecutor(max_workers=min(parallel, len(domains))) as pool:
        # each thread inherits the session's local properties and keeps its own
        runs = [
            pool.submit(inheritable_thread_target(spark)(run_one), spark, name, build)
            for name, build in domains.items()
        ]
        return [r.result() for r in runs]
