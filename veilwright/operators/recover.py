"""Recoverability: decisions about facts, and their rates by sample, configuration, attribute and code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwright import dims
from veilwright.functions import text as T

COUNTS = ("total", "yes_count", "no_count", "unsure_count", "error_count")


def fact_configs(facts: DataFrame, texts: DataFrame, on: str = "transcript_id") -> DataFrame:
    """Each fact with each configuration that has a text of its sample."""
    return facts.join(texts.where(F.coalesce("text", F.lit("")) != ""), on)


def decision(claimed: Column, quote: Column, transcript: Column) -> Column:
    """One of the three decisions: a yes without a quote that the transcript supports is unsure, as is any other label."""
    return decided(claimed, T.quote_supported(transcript, quote))


def decided(claimed: Column, supported: Column) -> Column:
    """decision() where it is known whether the transcript supports the quote."""
    yes, no, unsure = (dims.DECISIONS[k] for k in ("yes", "no", "unsure"))
    return F.when((claimed == yes) & supported, yes).when(claimed == no, no).otherwise(unsure)


def supported_quotes(quotes: DataFrame, texts: DataFrame, on: list[str]) -> DataFrame:
    """The distinct (on, quote_key) of quotes that stand in their text (on, text). A text is normalised once and meets its
    different quotes in one row."""
    many = quotes.where(F.length("quote_key") >= 8).groupBy(*on).agg(F.collect_set("quote_key").alias("_q"))
    j = texts.select(*on, T.for_match(F.col("text")).alias("_t")).join(many, on)
    return j.select(*on, F.explode(F.filter("_q", lambda q: F.contains(F.col("_t"), q))).alias("quote_key")).distinct()


def _measures() -> list[Column]:
    ok = F.coalesce("error", F.lit("")) == ""
    is_ = {k: ok & (F.col("decision") == v) for k, v in dims.DECISIONS.items()}
    return [F.count(F.lit(1)).alias("total"), *[F.count_if(is_[k]).alias(f"{k}_count") for k in ("yes", "no", "unsure")], F.count_if(~ok).alias("error_count")]


def rate(yes: str = "yes_count", total: str = "total") -> Column:
    """Rounded to three places, half up on the decimal form; null of nothing."""
    return F.when(F.col(total) > 0, F.round(F.col(yes) / F.col(total), 3))


def rate_without_errors() -> Column:
    n = F.col("total") - F.col("error_count")
    return F.when(n > 0, F.round(F.col("yes_count") / n, 3))


def by_attribute(items: DataFrame, by: list[str], attributes: DataFrame) -> DataFrame:
    """The counts and the rate of each group and each attribute of the dimension, zeros where it has no item. Items of
    other attributes have no row here, but count in overall()."""
    got = items.groupBy(*by, "attribute_key").agg(*_measures())
    keys = [a[0] for a in dims.ATTRIBUTES]
    frame = items.select(*by).distinct().withColumn("attribute_key", F.explode(dims.text_array(keys)))
    out = frame.join(got, [*by, "attribute_key"], "left").fillna(0, list(COUNTS))
    return out.withColumn("recoverable_rate", rate()).join(F.broadcast(attributes.select(F.col("key").alias("attribute_key"), "display_name")), "attribute_key")


def overall(items: DataFrame, by: list[str], sample: str | None = None) -> DataFrame:
    """The counts and rates of each group; errors are in the total and nowhere else. In the yes, no and unsure counts
    of samples only base attributes count, as in their sums by attribute."""
    known = F.col("attribute_key").isin([a[0] for a in dims.ATTRIBUTES]) if "attribute_key" in items.columns else F.lit(True)
    ok = known & (F.coalesce("error", F.lit("")) == "")
    aggs = [F.count(F.lit(1)).alias("total")] + [F.count_if(ok & (F.col("decision") == v)).alias(f"{k}_count") for k, v in dims.DECISIONS.items()]
    aggs += [F.count_if(known & (F.coalesce("error", F.lit("")) != "")).alias("error_count")]
    aggs += [F.count_distinct(sample).alias("sample_count")] if sample else []
    return items.groupBy(*by).agg(*aggs).withColumn("recoverable_rate", rate()).withColumn("rate_excluding_errors", rate_without_errors())


def cube(items: DataFrame, sets: list[list[str]], sample: str = "sample") -> DataFrame:
    """The counts, the number of samples and the rate for each of several groupings at once, in one pass: level names
    the grouping's columns, the others are null."""
    cols = list(dict.fromkeys(c for s in sets for c in s))
    grouped = items.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in cols])
    out = grouped.agg(*_measures(), F.count_distinct(sample).alias("sample_count"), F.grouping_id().alias("_g"))
    bits = {sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in s): "+".join(s) or "all" for s in sets}
    level = F.element_at(F.create_map(*[F.lit(x) for kv in bits.items() for x in (int(kv[0]), kv[1])]), F.col("_g").cast("int"))
    return out.select(level.alias("level"), *cols, *COUNTS, "sample_count", rate().alias("recoverable_rate"))


def known_code(c: Column) -> Column:
    """A normalised id, UNKNOWN if it is empty."""
    return F.coalesce(F.nullif(T.normalize(c), F.lit("")), F.lit("UNKNOWN"))


def code_labels(items: DataFrame, id_col: str, label_col: str, pos: str) -> DataFrame:
    """The label of each code: that of its first item."""
    return items.groupBy(id_col).agg(F.min_by(label_col, pos).alias(label_col))


def code_overview(cubed: DataFrame) -> DataFrame:
    """From cube()'s (config, code_id) rows one row for each code: totals over configurations and a map of them."""
    per = cubed.where(F.col("level") == "config+code_id")
    sums = [F.sum(c).alias(f"overall_{c}") for c in COUNTS]
    entry = F.struct("config", F.struct("sample_count", *COUNTS, "recoverable_rate").alias("v"))
    out = per.groupBy("code_id").agg(*sums, F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("configs"))
    return out.withColumn("overall_recoverable_rate", rate("overall_yes_count", "overall_total"))
