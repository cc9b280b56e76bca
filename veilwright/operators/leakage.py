"""Evidence spans and how much of them a rewrite still shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwright import dims
from veilwright.functions import text as T
from veilwright.functions.udfs import found_words
from veilwright.operators.selection import dedupe_keep_first

INFERENCES = "map<string, struct<inference:string, guesses:array<string>, certainty:string, evidence_spans:array<string>>>"


def evidence_spans(df: DataFrame, inferences: str, keys: Column | None = None, least: int = dims.CERTAINTY_LEAST, dedupe: bool = True) -> DataFrame:
    """A row for each evidence span of attributes that are certain enough: df's other columns, attribute, span, pos.

    keys is the order of the attributes (an array column; by default the base attributes); a certainty that is no
    number counts as 1; spans have 3 characters or more; of spans equal in any case the first stays.
    """
    rest = [c for c in df.columns if c != inferences]
    order = dims.text_array([a[0] for a in dims.ATTRIBUTES]) if keys is None else keys
    info = df.select(*rest, F.col(inferences).alias("_map"), F.posexplode(order).alias("_a", "attribute")).withColumn("_i", F.try_element_at("_map", F.col("attribute")))
    sure = info.where(F.coalesce(F.col("_i.certainty").try_cast("int"), F.lit(1)) >= least)
    spans = sure.select(*rest, "attribute", "_a", F.posexplode("_i.evidence_spans").alias("_s", "span")).withColumn("span", T.strip(F.col("span"))).where(F.length("span") >= 3)
    spans = spans.withColumn("pos", F.col("_a").cast("long") * (1 << 20) + F.col("_s")).drop("_a", "_s")
    if dedupe:
        got = spans.groupBy(*rest, F.lower("span").alias("_low")).agg(F.min_by(F.struct("attribute", "span", "pos"), "pos").alias("x"))
        spans = got.select(*rest, "x.attribute", "x.span", "x.pos")
    return spans


def report_spans(df: DataFrame, report: str, least: int = 3) -> DataFrame:
    """Evidence spans of a vulnerability report's attributes of a severity or more, its totals left out."""
    rest = [c for c in df.columns if c != report]
    kept = F.map_filter(report, lambda k, v: ~k.isin("total_severity", "SPAN_LEAKAGE") & (F.coalesce(v["severity"].try_cast("int"), F.lit(0)) >= least))
    return df.select(*rest, F.explode(kept).alias("attribute", "_v")).select(*rest, "attribute", F.explode("_v.evidence_spans").alias("span"))


def span_leakage(spans: DataFrame, texts: DataFrame, on: list[str]) -> DataFrame:
    """spans (on, pos, span) with span_norm, token_overlap, severity and reason against the rewrites (on, text).

    A document's spans are gathered as they are to meet its normalised text once, and all that is told of them is told
    there: what moves is each span and each text once, never a row for each word.
    """
    t = texts.select(*on, T.plain(F.col("text")).alias("_text"))
    rest = [c for c in spans.columns if c not in on]
    many = spans.groupBy(*on).agg(F.collect_list(F.struct(*rest)).alias("_spans")).join(t, on)
    many = many.select(*on, "_spans", "_text", F.transform("_spans", lambda s: T.plain(s["span"])).alias("_norms"))
    each = many.withColumn("_got", found_words("_norms", "_text")).select(*on, F.explode(F.arrays_zip("_spans", "_norms", "_got")).alias("_s"))
    out = each.select(*on, "_s._spans.*", F.col("_s._norms").alias("span_norm"), "_s._got.*")
    out = out.withColumn("_share", F.when(F.col("_n") > 0, F.col("_found") / F.col("_n")).otherwise(F.lit(0.0)))
    severity = T.leak_severity(F.col("span_norm"), F.col("_in"), F.col("_n"), F.col("_share"))
    out = out.withColumn("severity", severity).withColumn("token_overlap", F.round("_share", 3)).withColumn("reason", T.leak_reason(F.col("severity")))
    return out.select(*spans.columns, "span_norm", "severity", "token_overlap", "reason")


def leak_totals(leaks: DataFrame, on: list[str], documents: DataFrame | None = None) -> DataFrame:
    """source_span_count, num_span_leaks, total_span_severity and leaks[] of each document; zeros for documents
    without spans, if documents are given. Spans that normalise to nothing count as source spans only."""
    leak = F.when(F.col("severity") > 0, F.struct("pos", "span", "severity", "reason", "token_overlap"))
    out = leaks.groupBy(*on).agg(
        F.count(F.lit(1)).alias("source_span_count"), F.count_if(F.col("severity") > 0).alias("num_span_leaks"), F.sum("severity").alias("total_span_severity"),
        F.transform(F.array_sort(F.collect_list(leak)), lambda x: x.dropFields("pos")).alias("leaks"),
    )
    if documents is None:
        return out
    zero = {"source_span_count": 0, "num_span_leaks": 0, "total_span_severity": 0}
    return documents.select(*on).join(out, on, "left").fillna(zero)


def backmap(spans: DataFrame, texts: DataFrame, on: list[str]) -> DataFrame:
    """spans (on, span) with mapped: the place of the text that says the same. That is the span itself as the text
    writes it in any case, else the line with most of the span's words of 5 letters or more, if the span has two and
    the line half of them (the first of equals); null if there is none. An equi-join on the document."""
    quoted = F.concat(F.lit(r"(?iu)\Q"), F.replace(F.col("span"), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E"))
    j = spans.join(texts.select(*on, "text"), on).withColumn("_exact", F.when(F.col("span") != "", T.strip(F.regexp_substr("text", quoted))))
    lines = F.filter(F.transform(F.split("text", r"\r\n|[\n\r\x0B\f\x{85}\x{2028}\x{2029}\x{1C}-\x{1E}]"), T.strip), lambda x: F.length(x) >= 3)

    def once(value: Column, use) -> Column:  # a lambda's body is evaluated for each element, and what it names in full with it
        return F.get(F.transform(F.array(value), use), 0)

    def line_of(q: Column) -> Column:
        scored = F.transform(lines, lambda x, i: F.struct(F.size(F.array_intersect(q, T.long_words(F.lower(x), dims.MAP_WORD))).alias("n"), (-i).alias("i"), x.alias("line")))
        best = once(F.array_max(scored), lambda b: F.when((b["n"] > 0) & (b["n"] / F.size(q) >= 0.5), b["line"]))
        return F.when(F.size(q) >= 2, best)

    return j.withColumn("mapped", F.coalesce("_exact", once(T.long_words(F.lower("span"), dims.MAP_WORD), line_of))).drop("text", "_exact")


def feedback_spans(mapped: DataFrame, on: list[str], pos: str) -> DataFrame:
    """The mapped places, or the spans themselves where there is none, one of each."""
    return dedupe_keep_first(mapped.select(*on, pos, F.coalesce(F.nullif("mapped", F.lit("")), "span").alias("span")), on, "span", pos)


def total_severity(total: Column, attributes: Column, span_total: Column) -> Column:
    """The report's own total if it is a number, else the sum over attributes (array of strings) and leaked spans."""
    return F.coalesce(total.try_cast("int"), total_severity_strict(attributes, span_total))


def total_severity_strict(attributes: Column, span_total: Column) -> Column:
    parts = F.transform(F.coalesce(attributes, dims.text_array(())), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) + F.coalesce(span_total.cast("int"), F.lit(0))


def total_loss(total: Column, attributes: Column) -> Column:
    return total_severity(total, attributes, F.lit(0))


def specificity(df: DataFrame, claimed: str, dimensions: str) -> DataFrame:
    """The five dimensions of a specificity report (a map of too_specific, rationale, evidence_spans) in order, with
    defaults, and too_specific_count: those too specific, or the number claimed if that is greater."""

    def one(k: str) -> Column:
        d = F.try_element_at(F.col(dimensions), F.lit(k))
        spans = F.filter(F.transform(F.coalesce(d["evidence_spans"], dims.text_array(())), T.strip), lambda s: s != "")
        return F.struct(F.lit(k).alias("dimension"), F.coalesce(d["too_specific"], F.lit(False)).alias("too_specific"), T.strip(F.coalesce(d["rationale"], F.lit(""))).alias("rationale"), spans.alias("evidence_spans"))

    out = df.withColumn("dims", F.array(*map(one, dims.SPECIFICITY)))
    n = F.size(F.filter("dims", lambda d: d["too_specific"]))
    return out.withColumn("too_specific_count", F.greatest(n, F.coalesce(F.col(claimed).try_cast("int"), F.lit(0))))
