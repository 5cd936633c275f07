"""Business rules on tenders: checklists, bid scores, budgets, lifecycle and change sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights and thresholds of the bid decision.
BID_WEIGHTS = {
    "compliance": 0.35, "timeline": 0.15, "penalty": 0.10,
    "criteria": 0.20, "competition": 0.10, "profitability": 0.10,
}
SCORE_DIGITS = 6


def checklist(requirements: DataFrame, profile: DataFrame, evidence: DataFrame) -> DataFrame:
    """Verdict per mandatory requirement of a tender.

    ``requirements``: (tender_code, requirement_id, description); ``profile``: what the company
    covers (requirement_id, covered boolean); ``evidence``: (requirement_id, chunk_id). A
    requirement the profile is silent on is unclear. Evidence is counted, its rows stay in
    ``evidence``.
    """
    supporting = evidence.groupBy("requirement_id").agg(
        F.count(F.lit(1)).alias("n_evidence"), F.min("chunk_id").alias("first_evidence"))
    status = (F.when(F.col("covered").isNull(), "unclear").when(F.col("covered"), "compliant")
              .otherwise("non_compliant"))
    advice = F.when(F.col("status") == "compliant", "OK").when(F.col("status") == "unclear", "CHECK").otherwise("KO")
    return (
        requirements.join(profile, "requirement_id", "left").join(supporting, "requirement_id", "left")
        .select("tender_code", "requirement_id", "description", status.alias("status"),
                F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), "first_evidence")
        .withColumn("recommendation", advice))


def checklist_summary(items: DataFrame) -> DataFrame:
    """Counts by status per tender; any non-compliant requirement is a NO-GO."""
    counted = items.groupBy("tender_code").agg(
        F.count(F.lit(1)).alias("total_requirements"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("compliant", "non_compliant", "unclear")])
    verdict = F.when(F.col("non_compliant") > 0, "NO-GO").when(F.col("unclear") > 0, "EVALUATE").otherwise("GO")
    return counted.withColumn("recommendation", verdict)


def bid_score(factors: DataFrame) -> DataFrame:
    """Weighted score of six 0–100 factor columns, to ``SCORE_DIGITS`` digits, and the decision.

    The decision is taken on the score as given: a sum of 70 that floating point makes a little more is not above 70.
    """
    overall = F.lit(0.0)
    for name, weight in BID_WEIGHTS.items():
        overall = overall + F.col(name) * weight
    scored = factors.withColumn("overall_score", F.round(overall, SCORE_DIGITS))
    compliance = F.col("compliance")
    decision = (
        F.when((F.col("overall_score") > 70) & (compliance > 80), "GO")
        .when((F.col("overall_score") < 40) | (compliance < 50), "NO-GO")
        .otherwise("EVALUATE"))
    return scored.withColumn("recommendation", decision)


def budget_check(tenders: DataFrame, lot_totals: DataFrame) -> DataFrame:
    """Tenders whose lots sum to more than the tender's own amount."""
    joined = tenders.select("code", "base_amount").join(lot_totals, F.col("code") == F.col("tender_code"))
    return joined.filter(F.col("total_lots_amount") > F.col("base_amount")).select(
        "code", "base_amount", "lot_count", "total_lots_amount",
        (F.col("total_lots_amount") - F.col("base_amount")).alias("excess"))


def change_set(old: DataFrame, new: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Added, removed and modified keys between two versions, with both values side by side."""
    before = old.select(F.col(key), F.struct(*values).alias("_old"), F.lit(True).alias("_had"))
    after = new.select(F.col(key), F.struct(*values).alias("_new"), F.lit(True).alias("_has"))
    joined = before.join(after, key, "full_outer")
    change = (F.when(F.col("_had").isNull(), "added").when(F.col("_has").isNull(), "removed")
              .when(~F.col("_old").eqNullSafe(F.col("_new")), "modified"))
    return joined.withColumn("change", change).filter("change is not null").select(
        key, "change", *[F.col(f"_old.{v}").alias(f"old_{v}") for v in values],
        *[F.col(f"_new.{v}").alias(f"new_{v}") for v in values])


def change_set_in_one(versions: DataFrame, key: str, version: str, old: object, new: object,
                      values: Sequence[str]) -> DataFrame:
    """``change_set`` of two versions kept in one table, which is read and grouped once.

    ``version`` names the column that tells them apart; a key has at most one row of each version.
    Rows of other versions count as absent.
    """
    def side(value: object) -> Column:
        return F.first(F.when(F.col(version) == F.lit(value), F.struct(*values)), ignorenulls=True)

    joined = versions.filter(F.col(version).isin(old, new)).groupBy(key).agg(side(old).alias("_old"), side(new).alias("_new"))
    change = (F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed")
              .when(~F.col("_old").eqNullSafe(F.col("_new")), "modified"))
    return joined.withColumn("change", change).filter("change is not null").select(
        key, "change", *[F.col(f"_old.{v}").alias(f"old_{v}") for v in values],
        *[F.col(f"_new.{v}").alias(f"new_{v}") for v in values])


def publish_error(status: Column, description: Column, deadline: Column, today: Column) -> Column:
    """Why a tender cannot be published, or null."""
    return (
        F.when(F.coalesce(status, F.lit("")) != "draft",
               F.concat(F.lit("Cannot publish tender with status: "), F.coalesce(status, F.lit("none"))))
        .when((F.coalesce(description, F.lit("")) == "") | deadline.isNull(),
              "Missing required fields for publication")
        .when(deadline < today, "Deadline must be in the future"))


def archive_error(status: Column) -> Column:
    return F.when(status.isin("published", "active"), "Cannot archive active tender")


def archive(tenders: DataFrame, lots: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Archive the given tenders that are not active, with their lots. A key given or stored more than
    once changes no number of rows."""
    wanted = keys.select(F.col("code").alias("_code")).distinct()
    free = archive_error(F.col("status")).isNull()
    # a tender's own row tells whether it may go, so the tenders meet the keys alone
    new_tenders = tenders.join(wanted, F.col("code") == F.col("_code"), "left")
    new_tenders = new_tenders.withColumn(
        "status", F.when(F.col("_code").isNotNull() & free, "archived").otherwise(F.col("status"))).drop("_code")
    allowed = tenders.filter(free).join(wanted, F.col("code") == F.col("_code"), "left_semi").select(F.col("code").alias("_code")).distinct()
    new_lots = lots.join(allowed, F.col("tender_code") == F.col("_code"), "left")
    new_lots = new_lots.withColumn("status", F.when(F.col("_code").isNotNull(), "archived").otherwise(F.col("status"))).drop("_code")
    return new_tenders, new_lots
