"""Profiles counted and compared with a reference configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwright import dims


def _ratio(current: str, reference: str) -> Column:
    return F.when(F.col(reference) != 0, F.round(F.col(current) / F.col(reference), 3))


def profile_counts(facts: DataFrame, by: list[str]) -> DataFrame:
    """count and weighted_count (rounded to three places) of each group and attribute."""
    return facts.groupBy(*by, "attribute_key").agg(F.count(F.lit(1)).alias("count"), F.round(F.sum(F.coalesce("confidence_weight", F.lit(0.0))), 3).alias("weighted_count"))


def profile_totals(counts: DataFrame, by: list[str]) -> DataFrame:
    """total_atomic_facts, confidence_weighted_total (a sum of rounded sums) and nonempty_attributes of each group."""
    return counts.groupBy(*by).agg(
        F.sum("count").alias("total_atomic_facts"), F.round(F.sum("weighted_count"), 3).alias("confidence_weighted_total"), F.count_if(F.col("count") > 0).alias("nonempty_attributes")
    )


def zero_filled(counts: DataFrame, by: list[str]) -> DataFrame:
    frame = counts.select(*by).distinct().withColumn("attribute_key", F.explode(dims.text_array([a[0] for a in dims.ATTRIBUTES])))
    return frame.join(counts, [*by, "attribute_key"], "left").fillna(0, ["count", "weighted_count"])


def against_reference(df: DataFrame, keys: list[str], label: str, reference: str, measures: list[str]) -> DataFrame:
    """Each row with delta and ratio (null over zero) of each measure to the row of the reference label of the same keys.
    Keys without a reference are left out."""
    ref = df.where(F.col(label) == reference).select(*keys, *[F.col(m).alias(f"_ref_{m}") for m in measures])
    j = df.join(ref, keys)
    out = [F.round(F.col(m) - F.col(f"_ref_{m}"), 3).alias(f"{m}_delta") for m in measures] + [_ratio(m, f"_ref_{m}").alias(f"{m}_ratio") for m in measures]
    return j.select(*keys, label, *measures, *out)


def dataset_summary(counts: DataFrame, sample: str, label: str) -> DataFrame:
    """Sums and averages of counts over samples, for each label and attribute of zero-filled counts."""
    return counts.groupBy(label, "attribute_key").agg(
        F.sum("count").alias("total_count"), F.round(F.avg("count"), 3).alias("average_count"),
        F.round(F.sum("weighted_count"), 3).alias("total_weighted_count"), F.round(F.avg("weighted_count"), 3).alias("average_weighted_count"),
    )


def preservation(totals: DataFrame, sample: str, label: str, reference: str) -> DataFrame:
    """For each label the number of samples that have it and the reference, and the mean over samples of the ratios of
    totals; samples whose reference total is zero have no ratio."""
    ref = totals.where(F.col(label) == reference).select(sample, F.col("total_atomic_facts").alias("rt"), F.col("confidence_weighted_total").alias("rw"))
    j = totals.join(ref, sample)
    return j.groupBy(label).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.round(F.avg(F.when(F.col("rt") != 0, F.col("total_atomic_facts") / F.col("rt"))), 3).alias("average_total_ratio"),
        F.round(F.avg(F.when(F.col("rw") != 0, F.col("confidence_weighted_total") / F.col("rw"))), 3).alias("average_weighted_total_ratio"),
    )
