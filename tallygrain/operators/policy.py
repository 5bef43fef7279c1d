"""Policies named in a claim's papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallygrain import constants as C


def with_policy(df: DataFrame, policies: DataFrame, number: str) -> DataFrame:
    """Attach holder, limit and cover of the policy; unknown numbers stay."""
    known = policies.select(
        F.col("policy_number").alias(number),
        F.col("claimant").alias("policy_holder"),
        F.col("limit_inr").alias("policy_limit"),
        F.col("loss_types").alias("policy_losses"),
    )
    return df.join(known, number, "left")


def holder_differs(holder: Column, claimant: Column) -> Column:
    return (F.lower(holder) != F.lower(claimant)) & (holder != C.GENERIC_HOLDER)


def money(amount: Column) -> Column:
    """Whole rupees without a decimal point, paise only where there are some."""
    whole = amount.cast("double") == F.floor(amount.cast("double"))
    return F.concat(F.lit("₹"), F.when(whole, amount.cast("long").cast("string")).otherwise(amount.cast("string")))


def policy_reasons(
    number: Column, sum_insured: Column, bill_amount: Column, claimant: Column, amount: Column, loss: Column
) -> Column:
    """Reasons from policy_holder, policy_limit, policy_losses and the papers."""
    known, named = F.col("policy_holder").isNotNull(), number.isNotNull()
    holder, limit = F.col("policy_holder"), F.col("policy_limit")
    return F.array_compact(
        F.array(
            F.when(
                named & known & holder_differs(holder, claimant),
                F.concat(F.lit("name mismatch: policy="), holder, F.lit(" vs claim="), claimant),
            ),
            F.when(
                named & known & (amount > limit),
                F.concat(F.lit("amount "), money(amount), F.lit(" exceeds policy limit "), money(limit)),
            ),
            F.when(
                named & known & ~F.array_contains("policy_losses", loss),
                F.concat(F.lit("loss type "), loss, F.lit(" not covered by "), number),
            ),
            F.when(
                named & ~known & (amount > sum_insured),
                F.concat(F.lit("amount "), money(amount), F.lit(" exceeds policy sum insured "), money(sum_insured)),
            ),
            F.when(
                bill_amount > amount * 1.5,
                F.concat(F.lit("bill amount "), money(bill_amount), F.lit(" far exceeds requested "), money(amount)),
            ),
        )
    )
