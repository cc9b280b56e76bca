"""Masked templates of transcripts and their refilling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwright import dims
from veilwright.functions import text as T
from veilwright.functions.udfs import diff_to_masks

MASK_LIST = "array<struct<key:string,original:string,seed:string>>"


def mask_changes(df: DataFrame, original: str, rewritten: str, gap: int = 2, most_tokens: int | None = None) -> DataFrame:
    """df with template, masks and skipped: what the rewrite changes is masked."""
    out = df.withColumn("_m", diff_to_masks(F.col(original), F.col(rewritten), gap, most_tokens))
    return out.select(*df.columns, "_m.template", "_m.masks", "_m.skipped")


def mask_spans(text: Column, spans: Column) -> Column:
    """Struct of template and masks: the spans of an array, the longest first, each replaced wherever the text has it
    in any case. A span that the template no longer has gets no number."""
    ordered = F.transform(F.array_sort(F.transform(spans, lambda s, i: F.struct((-F.length(s)).alias("n"), i.alias("i"), s.alias("s")))), lambda x: x["s"])
    start = F.struct(text.alias("template"), F.array().cast(MASK_LIST).alias("masks"))

    def step(acc: Column, span: Column) -> Column:
        key = F.concat(F.lit("MASK_"), (F.size(acc["masks"]) + 1).cast("string"))
        quoted = F.concat(F.lit(r"(?iu)\Q"), F.replace(span, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E"))
        new = F.struct(
            F.regexp_replace(acc["template"], quoted, F.concat(F.lit("["), key, F.lit("]"))).alias("template"),
            F.array_append(acc["masks"], F.struct(key.alias("key"), span.alias("original"), F.lit("").alias("seed"))).alias("masks"),
        )
        return F.when((span != "") & F.contains(F.lower(acc["template"]), F.lower(span)), new).otherwise(acc)

    return F.aggregate(ordered, start, step)


def masked(df: DataFrame, original: str, rewritten: str, spans: str, gap: int = 2, most_tokens: int | None = None) -> DataFrame:
    """df with template, masks, was_masked and skipped: what the rewrite changes; the spans instead where it changes nothing
    or, as skipped tells, was not compared."""
    out = mask_changes(df, original, rewritten, gap, most_tokens).withColumn("_by_span", mask_spans(F.col(original), F.coalesce(F.col(spans), dims.text_array(()))))
    none = F.size("masks") == 0
    plain = F.transform("masks", lambda m: F.struct(m["key"].alias("key"), m["original"].alias("original"), m["seed"].alias("seed")))
    template = F.when(none, F.col("_by_span.template")).otherwise(F.col("template"))
    masks = F.when(none, F.col("_by_span.masks")).otherwise(plain)
    return out.select(*df.columns, template.alias("template"), masks.alias("masks"), (F.size(masks) > 0).alias("was_masked"), "skipped")


def assembled(template: Column, masks: Column, fills: Column) -> Column:
    """A template with the masks' values from a map of them; masks that it lacks keep their token."""
    given = F.filter(F.transform(masks, lambda m: F.struct(m["key"].alias("key"), F.try_element_at(fills, m["key"]).alias("value"))), lambda m: m["value"].isNotNull())
    return T.fill(template, given, "value")


def unrefilled(template: Column, masks: Column) -> Column:
    """The text where no variation came back: the rewrite's words for what it has words for; other tokens stay, as the
    words that were masked must not come back."""
    return T.fill(template, F.filter(masks, lambda m: F.coalesce(m["seed"], F.lit("")) != ""), "seed")


def restored(template: Column, masks: Column) -> Column:
    """The original again: the inverse of masking what a rewrite changes. There tokens stand once each and in order, so
    the template is cut at them once; where the original had such tokens of its own, masks are put back one by one."""
    parts = F.split(template, r"\[MASK_[0-9]+\]", -1)
    whole = F.array_join(F.zip_with(parts, F.transform(masks, lambda m: m["original"]), lambda p, o: F.concat(p, F.coalesce(o, F.lit("")))), "")
    by_one = F.aggregate(F.reverse(masks), template, lambda acc, m: F.replace(acc, F.concat(F.lit("["), m["key"], F.lit("]")), m["original"]))
    return F.when(F.size(parts) == F.size(masks) + 1, whole).otherwise(by_one)
