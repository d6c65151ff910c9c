"""Token usage and cost: per call, totals, per provider, budget gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake import catalog
from auditlake.functions.scale import running_total

MONEY = "decimal(38,12)"


def _by_provider(field: int, as_type: str) -> Column:
    pairs = [F.lit(x) for p, v in catalog.PRICES.items() for x in (p, str(v[field]).lower())]
    return F.try_element_at(F.create_map(*pairs), F.col("provider")).cast(as_type)


def cost(usage: DataFrame) -> DataFrame:
    """Add ``cost_usd`` (double), ``cost_microdollars`` and an exact decimal cost.

    The price table has one entry per provider, so it is a literal map and
    costs no join. Sums use the decimal, which gives the same total in any
    order.
    """
    spent = F.col("input_tokens") / F.lit(1000.0) * _by_provider(1, "double") + F.col(
        "output_tokens"
    ) / F.lit(1000.0) * _by_provider(2, "double")
    exact = (
        F.col("input_tokens") * _by_provider(1, "decimal(12,6)")
        + F.col("output_tokens") * _by_provider(2, "decimal(12,6)")
    ) / F.lit(1000).cast("decimal(4,0)")
    micro = F.when(
        _by_provider(3, "boolean"), (F.col("cost_usd") * F.lit(1000000.0)).cast("bigint")
    ).otherwise(F.lit(0).cast("bigint"))
    return (
        usage.withColumn("cost_usd", spent)
        .withColumn("cost_microdollars", micro)
        .withColumn("cost_exact", exact.cast(MONEY))
    )


def _sums() -> list[Column]:
    return [
        F.count("*").alias("calls"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).cast("bigint").alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).cast("bigint").alias("output_tokens"),
    ]


def totals(costed: DataFrame) -> DataFrame:
    spent = F.round(F.coalesce(F.sum("cost_exact"), F.lit(0).cast(MONEY)), 6)
    return costed.groupBy("registry").agg(*_sums(), spent.cast("double").alias("cost_usd"))


def by_provider(costed: DataFrame) -> DataFrame:
    return costed.groupBy("registry", "provider").agg(
        *_sums(), F.sum("cost_exact").cast("double").alias("cost_usd")
    )


def budget_gate(costed: DataFrame, budget: float = 1.0) -> DataFrame:
    """Mark calls that are refused: money spent before the call reached the budget.

    Refused calls cost nothing, but everything after the first refusal is
    refused too, so the sum over all earlier calls decides the same way.
    """
    limit = F.lit(str(budget)).cast(MONEY)
    before = running_total(costed, ["registry"], "seq", "cost_exact", "spent_before")
    return before.withColumn("refused", F.col("spent_before") >= limit)
