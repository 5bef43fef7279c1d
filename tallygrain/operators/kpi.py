"""Key figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallygrain import constants as C
from tallygrain.functions.numeric import percent
from tallygrain.functions.timefn import within_last_hours


def upper_median(column: str) -> Column:
    """Middle value, the upper one of an even number; null when there is none."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column} DESC)").cast("long")


def kpi_columns(now: Column) -> list[Column]:
    status, amount = F.col("status"), F.col("amount_requested").cast("long")
    approved = status.isin("AI_APPROVED", "PAID")
    flagged = status.isin("AI_FLAGGED", "HUMAN_REVIEW")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, amount)), F.lit(0)).cast("long")

    return [
        F.count("*").alias("total"),
        F.count_if(within_last_hours(F.col("submitted_at"), now)).alias("claims_today"),
        F.count_if(approved).alias("auto_approved"),
        percent(F.count_if(approved), F.count("*")).alias("auto_approval_pct"),
        F.count_if(flagged).alias("flagged"),
        F.count_if(flagged).alias("flagged_locked"),
        total(status.isin(*C.LEAKAGE_STATUSES)).alias("leakage_prevented_inr"),
        total(status == "PAID").alias("paid_inr"),
    ]


def kpi_strip(claims: DataFrame, now: Column) -> DataFrame:
    return claims.agg(*kpi_columns(now), upper_median("duration_ms").alias("verification_p50_ms"))


def merged_kpi(parts: DataFrame) -> DataFrame:
    """The figures of ``kpi_columns`` over the rows behind several results of it."""
    names = [c for c in parts.columns if c != "auto_approval_pct"]
    sums = parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names])
    return sums.withColumn("auto_approval_pct", percent(F.col("auto_approved"), F.col("total"))).select(*parts.columns)


STEP = 10_000  # values of one stretch of a count table


def counted_median(counts: DataFrame, value: str, n: str) -> Column:
    """``upper_median`` from how often each value occurs, as a scalar.

    Stretches of values are summed first; single values are walked only in the one
    that holds the middle.
    """
    rows = counts.where(F.col(value).isNotNull()).withColumn("_stretch", F.floor(F.col(value) / STEP))
    above = W.partitionBy(F.lit(0)).orderBy(F.desc("_stretch"))
    sums = rows.groupBy("_stretch").agg(F.sum(n).alias("_size"))
    sums = sums.select(
        "_stretch", "_size", (F.sum("_size").over(above) - F.col("_size")).alias("_above"), F.sum("_size").over(W.partitionBy(F.lit(0))).alias("_all")
    )
    middle = sums.where((2 * F.col("_above") < F.col("_all")) & (2 * (F.col("_above") + F.col("_size")) >= F.col("_all")))
    down = W.partitionBy("_stretch").orderBy(F.desc(value)).rowsBetween(W.unboundedPreceding, W.currentRow)
    walked = rows.join(middle, "_stretch").withColumn("_down", F.sum(n).over(down) + F.col("_above"))
    return walked.where(2 * F.col("_down") >= F.col("_all")).agg(F.max(value).cast("long")).scalar()


def memory_statistics(memory: DataFrame) -> DataFrame:
    size, fraud = F.count("*"), F.count_if(F.col("label") == "fraud")
    return memory.agg(
        size.alias("size"),
        F.count_if(F.col("label") == "genuine").alias("genuine"),
        fraud.alias("fraud"),
        F.coalesce(percent(fraud, size), F.lit(0)).alias("fraud_share_pct"),
    )
