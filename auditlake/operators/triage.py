"""Triage: likely false positives, risk level, actions, review packets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake import catalog
from auditlake.functions import text as tx
from auditlake.functions.scale import ordinals, stored, top_n
from auditlake.operators.lines import numbered_context
from auditlake.schemas import FINDING_ORDER

PACKET_SIZE = 30


def verdicts(findings: DataFrame) -> DataFrame:
    """Findings plus is_true_positive, confidence, explanation, suggested_fix.

    A file in test or example code is a likely false positive; a rule's known
    contexts (first listed word found in the path) override that; a critical
    finding that is still a true positive gets high confidence.
    """
    low = F.lower("file")
    in_tests = tx.contains_any(low, catalog.TEST_PATH_PARTS)
    context = F.lit(None).cast("string")
    for prefix, words in catalog.FALSE_POSITIVE_CONTEXTS.items():
        first = F.coalesce(*[F.when(low.contains(w), F.lit(w)) for w in words])
        context = F.when(F.col("rule_id").startswith(prefix), first).otherwise(context)
    out = findings.withColumn("_context", context).withColumn("_in_tests", in_tests)
    is_tp = F.col("_context").isNull() & ~F.col("_in_tests")
    sure = is_tp & (F.col("severity") == "CRITICAL")
    return (
        out.withColumn("is_true_positive", is_tp)
        .withColumn(
            "confidence",
            F.when(F.col("_context").isNotNull(), 0.6).when(F.col("_in_tests"), 0.7)
            .when(sure, 0.95).otherwise(0.8),
        )
        .withColumn(
            "explanation",
            F.when(
                F.col("_context").isNotNull(),
                F.concat(F.lit("Likely false positive: "), F.col("_context"), F.lit(" context")),
            )
            .when(F.col("_in_tests"), "Finding is in test/example code")
            .when(sure, "Critical severity finding — high confidence true positive")
            .otherwise(""),
        )
        .withColumn("suggested_fix", F.col("fix"))
        .drop("_context", "_in_tests")
    )


def split(triaged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(likely true positives, likely false positives)."""
    return (
        triaged.where(F.col("is_true_positive")),
        triaged.where(~F.col("is_true_positive")),
    )


def review(triaged: DataFrame, projects: DataFrame) -> DataFrame:
    """One row per project: counts, risk level, summary, actions joined by `` | ``."""
    tp = F.col("is_true_positive")
    counts = triaged.groupBy("project").agg(
        F.count("*").alias("total"),
        F.count_if(tp).alias("tp"),
        F.min(F.when(tp, F.col("sev_rank"))).alias("worst"),
        F.count_if(tp & (F.col("severity") == "HIGH")).alias("high"),
    )
    zero = F.lit(0).cast("bigint")
    out = projects.select("project").distinct().join(counts, "project", "left").select(
        "project", "worst", *[F.coalesce(c, zero).alias(c) for c in ("total", "tp", "high")]
    )
    fp = F.col("total") - F.col("tp")
    risk = (
        F.when(F.col("tp") == 0, "none").when(F.col("worst") == 0, "critical")
        .when(F.col("worst") == 1, "high").when(F.col("worst") == 2, "medium").otherwise("low")
    )
    summary = F.format_string(
        "%d likely true positive(s), %d likely false positive(s) out of %d total finding(s).",
        F.col("tp"), fp, F.col("total"),
    )
    actions = F.concat_ws(
        " | ",
        F.when(F.col("worst") == 0, "Fix CRITICAL findings immediately before merging"),
        F.when(F.col("high") > 0, "Review and fix HIGH-severity findings"),
        F.when(fp > 0, F.format_string("Consider suppressing %d likely false positive(s)", fp)),
    )
    return out.select(
        "project", "total", F.col("tp").alias("true_positives"), fp.alias("false_positives"),
        risk.alias("risk_level"), summary.alias("summary"), actions.alias("actions"),
    )


def review_packet(findings: DataFrame, files: DataFrame, size: int = PACKET_SIZE) -> DataFrame:
    """First findings per project with their code lines, as reviewer input."""
    first = stored(top_n(findings, ["project"], FINDING_ORDER, size, out="number"))
    first = first.withColumnRenamed("file", "path")
    context = numbered_context(first, files, 2, 3, numbered=False)
    joined = first.join(context, ["project", "path", "line"], "left")
    head = F.format_string(
        "[%d] %s %s: %s\n    File: %s:%d\n",
        F.col("number"), F.col("severity"), F.col("rule_id"), F.col("message"),
        F.col("path"), F.col("line"),
    )
    shown = F.when(
        F.coalesce("context", F.lit("")) != "",
        F.concat(F.lit("    Context:\n"), F.col("context"), F.lit("\n")),
    ).otherwise("")
    return joined.select(
        "project", "number", "rule_id", "path", "line", F.concat(head, shown).alias("packet")
    )


def merge_verdicts(triaged: DataFrame, external: DataFrame) -> DataFrame:
    """Overlay outside verdicts by 1-based finding number within the project.

    ``external`` has (project, id, tp, confidence, reason); null fields keep
    the heuristic value, unknown numbers are ignored, the last of several rows
    for one number (by ``seq``) that has a field wins.
    """
    last = external.groupBy("project", F.col("id").cast("bigint").alias("number")).agg(
        *[
            F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"_{c}")
            for c in ("tp", "confidence", "reason")
        ]
    )
    # stored first: range partitioning samples its input, which would scan all texts again
    numbered = ordinals(stored(triaged), ["project"], FINDING_ORDER, out="number")
    return (
        numbered.join(last, ["project", "number"], "left")
        .withColumn("is_true_positive", F.coalesce("_tp", "is_true_positive"))
        .withColumn("confidence", F.coalesce("_confidence", "confidence"))
        .withColumn("explanation", F.coalesce("_reason", "explanation"))
        .drop("_tp", "_confidence", "_reason")
    )
