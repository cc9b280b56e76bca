"""Scopes: lists of privacy attributes, merged and capped per document. Lists are arrays of structs, so the
order-dependent rules are folds over an array and need no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwright import dims
from veilwright.functions import text as T

ATTRIBUTE = "struct<key:string,display_name:string,target_str:string,options:array<string>,note:string>"
LIST = f"array<{ATTRIBUTE}>"


def base_list() -> Column:
    def one(a: tuple) -> Column:
        return F.struct(
            F.lit(a[0]).alias("key"), F.lit(a[2]).alias("display_name"), F.lit(a[3]).alias("target_str"),
            (dims.text_array(a[4]) if a[4] else F.lit(None)).cast("array<string>").alias("options"), F.lit(a[5]).cast("string").alias("note"),
        )

    return F.array(*map(one, dims.ATTRIBUTES)).cast(LIST)


def distinct_options(options: Column) -> Column:
    """Normalised options, one of each in any case, or null if none is left."""
    clean = F.filter(F.transform(options, T.normalize_repr), lambda x: x != "")
    kept = F.aggregate(clean, dims.text_array(()), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.array_append(acc, x)))
    return F.when(F.size(kept) > 0, kept)


def coerce(raw: Column) -> Column:
    """An attribute from raw fields, normalised; null if key, name or target is missing."""
    key, name, target = T.attribute_key(F.coalesce(raw["key"], F.lit(""))), T.normalize(raw["display_name"]), T.normalize(raw["target_str"])
    made = F.struct(key.alias("key"), name.alias("display_name"), target.alias("target_str"), distinct_options(raw["options"]).alias("options"), F.nullif(T.normalize(raw["note"]), F.lit("")).alias("note"))
    return F.when((key != "") & (name != "") & (target != ""), made)


def coerce_all(raw: Column) -> Column:
    """coerce() of an array, without nulls and with the first of each key."""
    made = F.filter(F.transform(raw, coerce), lambda a: a.isNotNull())
    return F.aggregate(made, F.array().cast(LIST), lambda acc, a: F.when(F.exists(acc, lambda b: b["key"] == a["key"]), acc).otherwise(F.array_append(acc, a)))


def _same(a: Column, b: Column) -> Column:
    return (
        (F.upper(T.strip(a["key"])) == F.upper(T.strip(b["key"])))
        | (F.lower(T.strip(a["display_name"])) == F.lower(T.strip(b["display_name"])))
        | (F.lower(T.strip(a["target_str"])) == F.lower(T.strip(b["target_str"])))
    )


def merge(*lists: Column) -> Column:
    """The lists one after another, without attributes that share key, name or target with one kept before."""
    all_ = F.concat(*[F.coalesce(x, F.array().cast(LIST)) for x in lists])
    return F.aggregate(all_, F.array().cast(LIST), lambda acc, a: F.when(F.exists(acc, lambda b: _same(a, b)), acc).otherwise(F.array_append(acc, a)))


def added(existing: Column, candidates: Column, limit: int) -> Column:
    """The candidates that merge() would add to existing: the first `limit` of them, and one at least."""
    new = F.slice(merge(existing, candidates), F.size(merge(existing)) + 1, 1 << 30)
    return F.slice(new, 1, max(1, limit))


def capped(dynamic: Column, base: Column, most: int) -> Column:
    """The dynamic attributes that fit under a total of `most` beside the base."""
    return F.slice(dynamic, 1, F.greatest(F.lit(0), F.lit(max(0, most)) - F.size(base)))


def aliases(a: Column) -> Column:
    """Name, target and key, normalised, one of each in any case."""
    return F.coalesce(distinct_options(F.array(a["display_name"], a["target_str"], a["key"])), dims.text_array(()))


def scope(base: Column, dynamic: Column) -> Column:
    """A document's attributes: the base and those found for it."""
    return merge(base, dynamic)


def export(per_document: DataFrame, id_col: str, column: str) -> DataFrame:
    """One row: base_count, new_count, total_count and attributes, the union of the base and all documents' lists in
    order of their ids.

    An attribute that some document had before, with the same key, name and target, never changes the union. So only
    the first of each goes on, counted down before the shuffle, and what is folded in one place is as long as there
    are different attributes, not documents.
    """
    each = per_document.select(F.col(id_col).alias("id"), F.posexplode(column).alias("pos", "a"))
    same = [F.upper(T.strip(F.col("a.key"))), F.lower(T.strip(F.col("a.display_name"))), F.lower(T.strip(F.col("a.target_str")))]
    first = each.groupBy(*[c.alias(n) for c, n in zip(same, ("k", "n", "t"), strict=True)]).agg(F.min_by(F.struct("id", "pos", "a"), F.struct("id", "pos")).alias("x")).select("x.*")
    one = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "pos", "a"))), lambda x: x["a"]).cast(LIST).alias("found"))
    union, n = merge(base_list(), F.col("found")), len(dims.ATTRIBUTES)
    return one.select(F.lit(n).alias("base_count"), (F.size(union) - n).alias("new_count"), F.size(union).alias("total_count"), union.alias("attributes"))


def export_counts(per_document: DataFrame, id_col: str, column: str) -> DataFrame:
    """The number of attributes found for each document."""
    return per_document.select(id_col, F.size(column).alias("new_attributes"))
