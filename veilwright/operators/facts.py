"""Profile facts: expansion, merging by key, removal of overlaps, numbering."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwright import dims
from veilwright.functions import text as T


DEAL = 8


def candidate_indices(given: Column, valid: Column) -> Column:
    """The distinct whole numbers of an array of strings that are among the valid ones, sorted."""
    return F.array_sort(F.array_intersect(F.array_distinct(F.filter(F.transform(given, lambda x: x.try_cast("int")), lambda x: x.isNotNull())), valid))


def source_fields(given: Column, allowed: tuple[str, ...] = ("unified_description",)) -> Column:
    """The allowed ones of an array of fields, sorted; the first allowed if there are none."""
    got = F.array_sort(F.array_intersect(F.transform(F.coalesce(given, dims.text_array(())), T.normalize), dims.text_array(allowed)))
    return F.when(F.size(got) > 0, got).otherwise(dims.text_array(allowed[:1]))


def descriptions(names: Column, label: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.concat(names, F.array(label)), T.normalize), lambda x: x != ""))


def expand(df: DataFrame, attribute: str, fact: str) -> DataFrame:
    """A row for each atomic fact of a row's fact, with part, its place among them."""
    rest = [c for c in df.columns if c != fact]
    return df.select(*rest, F.posexplode(T.expand_fact(F.col(attribute), F.col(fact))).alias("part", fact))


def merge_by_key(df: DataFrame, by: list[str], fact: str = "fact", pos: str = "pos", weight: str | None = None, support: list[str] = ()) -> DataFrame:
    """One row for each key of facts in a group: the first wording, the greatest weight, the sorted union of each support
    array, and n, the number merged. Sums and minima are taken before the shuffle; where the wording isn't asked for, it isn't
    kept, and rows are hashed rather than sorted."""
    key = T.fact_key(F.col(fact))
    aggs = [F.min_by(fact, pos).alias("_fact"), F.min(pos).alias("_pos"), F.count(F.lit(1)).alias("n")]
    aggs += [F.max(weight).alias(weight)] if weight else []
    aggs += [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in support]
    out = df.withColumn("fact_key", key).where("fact_key <> ''").groupBy(*by, "fact_key").agg(*aggs)
    return out.select(*by, "fact_key", F.col("_fact").alias(fact), F.col("_pos").alias(pos), "n", *([weight] if weight else []), *support)


def confidences(given: Column) -> Column:
    """Distinct confidence labels, the most confident first (then in their order)."""
    c = F.array_distinct(F.filter(F.transform(given, T.for_match), lambda x: x != ""))
    keyed = F.transform(c, lambda x, i: F.struct((-T.confidence_rank(x)).alias("r"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda x: x["x"])


def overlap_pairs(df: DataFrame, by: list[str], idx: str = "idx", fact: str = "fact") -> DataFrame:
    """(by, left_idx, right_idx) of facts of a group whose core words overlap: one set holds the other.

    Facts of a group with the same core words are one set, so sets are compared once, however many facts have them. Candidates
    share the smaller set's rarest word within the group: the join is on the group and a word, and of each set only one word
    looks for the sets that hold it. Then pairs of sets become pairs of facts, which are as many as the result has rows.
    """
    w = df.select(*by, F.col(idx).alias("idx"), F.array_sort(T.core_words(F.col(fact))).alias("w")).where(F.size("w") > 0).distinct()
    sets = w.select(*by, "w").distinct()
    each = sets.select(*by, "w", F.explode("w").alias("word"))
    counts = each.groupBy(*by, "word").agg(F.count(F.lit(1)).alias("n"))
    rare = each.join(counts, [*by, "word"]).groupBy(*by, "w").agg(F.min(F.struct("n", "word"))["word"].alias("word")).withColumnRenamed("w", "small")
    found = rare.join(each, [*by, "word"]).where(F.size(F.array_except("small", "w")) == 0).select(*by, "small", "w")
    # facts of the larger set are dealt over DEAL keys, to each of which those of the smaller go: a pair of large sets is many tasks'
    left = w.select(*by, F.col("idx").alias("_a"), F.col("w").alias("small")).withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1))))
    right = w.select(*by, F.col("idx").alias("_b"), "w", F.pmod(F.xxhash64("idx"), F.lit(DEAL)).cast("int").alias("_d"))
    same = F.col("small") == F.col("w")
    pairs = found.join(left, [*by, "small"]).join(right, [*by, "w", "_d"]).where(F.when(same, F.col("_a") < F.col("_b")).otherwise(F.col("_a") != F.col("_b")))
    out = pairs.select(*by, F.least("_a", "_b").alias("left_idx"), F.greatest("_a", "_b").alias("right_idx"))
    return out


def group_is_valid(facts: Column) -> Column:
    """Whether each two facts of an array overlap (an array of one does)."""
    sets = F.transform(facts, lambda f, i: F.struct(i.alias("i"), T.core_words(f).alias("s")))
    return F.forall(sets, lambda a: F.forall(sets, lambda b: (a["i"] == b["i"]) | T.words_overlap(a["s"], b["s"])))


def _ranks(values: list[str]) -> list[str]:
    rank = {c: i for i, c in enumerate(dims.CONFIDENCE)}
    return sorted(dict.fromkeys(v for v in (" ".join((x or "").lower().split()) for x in values) if v), key=lambda v: -rank.get(v, -1))


def _keep_specific(rows: list[dict]) -> list[dict]:
    """Greedy: the most specific facts first; each later one that overlaps a kept one is merged into the first such."""
    kept: list[dict] = []
    for r in sorted(rows, key=lambda r: (-len(r["core"]), -len(" ".join(r["fact"].split())), -len(r["source_fields"]), r["pos"])):
        core = frozenset(r["core"])
        into = next((k for k in kept if core and k["set"] and (core <= k["set"] or k["set"] <= core)), None)
        if into is None:
            kept.append(r | {"set": core, "n": 1})
            continue
        into["n"] += 1
        into["confidence_weight"] = max(into["confidence_weight"], r["confidence_weight"])
        for c in ("supporting_candidates", "source_fields"):
            into[c] = sorted({*into[c], *r[c]})
        into["confidences"] = _ranks([*into["confidences"], *r["confidences"]])
    return kept


FACTS = "fact string, pos long, supporting_candidates array<int>, source_fields array<string>, confidences array<string>, confidence_weight double, n int"


def dedupe_overlapping(df: DataFrame, by: list[str]) -> DataFrame:
    """Facts of each group (fact, pos, supporting_candidates, source_fields, confidences, confidence_weight) without
    those that a more specific one covers, which takes over their support; n facts went into each, and rank orders them
    by falling weight, then text. The rule depends on the order and isn't transitive, so a group (a transcript's facts
    of an attribute, some tens) is folded in one place, its core words computed before.
    """
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by) + ", " + FACTS
    ready = df.withColumn("core", T.core_words(F.col("fact")))

    def fold(batches: Iterator[pa.RecordBatch]) -> pa.Table:
        t = pa.Table.from_batches(list(batches))
        rows = t.to_pylist()
        names = [c.split()[0] for c in FACTS.split(", ")]
        kept = _keep_specific(rows)
        types = {"fact": pa.string(), "pos": pa.int64(), "supporting_candidates": pa.list_(pa.int32()), "source_fields": pa.list_(pa.string()), "confidences": pa.list_(pa.string()), "confidence_weight": pa.float64(), "n": pa.int32()}
        return pa.table({c: pa.array([r[c] for r in kept], t.schema.field(c).type if c in by else types[c]) for c in [*by, *names]})

    out = ready.groupBy(*by).applyInArrow(lambda t: fold(iter(t.to_batches())), schema)
    w = Window.partitionBy(*by).orderBy(F.desc("confidence_weight"), F.lower("fact"), "pos")
    return out.withColumn("confidence_weight", F.round("confidence_weight", 3)).withColumn("rank", F.row_number().over(w))


def numbered(df: DataFrame, by: list[str], attribute: str, order: list) -> DataFrame:
    """df with fact_id: the attribute and a running number of two digits in each group."""
    n = F.row_number().over(Window.partitionBy(*by, attribute).orderBy(*order))
    return df.withColumn("fact_id", F.format_string("%s_%02d", F.col(attribute), n))


def renumbered(df: DataFrame, by: list[str]) -> DataFrame:
    """Merged facts (sort_index, attribute_key, fact) numbered anew in order of sort_index, attribute and text."""
    return numbered(df, by, "attribute_key", ["sort_index", "attribute_key", F.lower("fact"), "fact"])


def regroup(df: DataFrame, by: list[str], attributes: DataFrame) -> DataFrame:
    """facts[] and count for each group and each attribute of the dimension, in order of pos."""
    got = df.groupBy(*by, "attribute_key").agg(F.array_sort(F.collect_list(F.struct("pos", "fact"))).alias("f"))
    groups = df.select(*by).distinct().withColumn("attribute_key", F.explode(dims.text_array([a[0] for a in dims.ATTRIBUTES])))
    out = groups.join(got, [*by, "attribute_key"], "left").join(F.broadcast(attributes.select(F.col("key").alias("attribute_key"), "display_name")), "attribute_key")
    facts = F.coalesce(F.transform("f", lambda x: x["fact"]), dims.text_array(()))
    return out.select(*by, "attribute_key", "display_name", facts.alias("facts"), F.size(facts).alias("count"))


MERGED = "fact_ids array<string>, fact string, attribute_key string, source_attribute_keys array<string>, sort_index int"


def merge_groups(profile: DataFrame, proposals: DataFrame, by: list[str]) -> DataFrame:
    """Facts of a profile (by, fact_id, attribute_key, fact, pos) merged as proposed (by, group_pos, source_fact_ids,
    attribute_key, fact): a proposal takes its known ids that no accepted one before it took; it is accepted if all
    its facts overlap each other. Facts in no accepted group stay alone.

    Proposals depend on those before them only where they name a fact that another names too. The others are decided each by
    itself, by JVM expressions over its own facts; those that share facts, with these facts, are folded one after another,
    a profile's in one place.
    """
    keys = [a[0] for a in dims.ATTRIBUTES]
    ranked = profile.withColumn("_i", (F.row_number().over(Window.partitionBy(*by).orderBy("pos", "fact_id", "attribute_key", "fact")) - 1).cast("int"))
    # of an id that repeats the last fact counts
    known = ranked.groupBy(*by, "fact_id").agg(F.max_by(F.struct("_i", "attribute_key", "fact"), "_i").alias("f")).select(*by, "fact_id", "f.*")
    p = proposals.select(*by, "group_pos", F.col("attribute_key").alias("_key"), F.col("fact").alias("_fact"), "source_fact_ids")
    p = p.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("group_pos", "source_fact_ids", "_key", "_fact")))
    named = p.select(*by, "_n", F.posexplode("source_fact_ids").alias("_at", "_id")).select(*by, "_n", "_at", T.normalize(F.col("_id")).alias("fact_id"))
    named = named.groupBy(*by, "_n", "fact_id").agg(F.min("_at").alias("_at")).join(known, [*by, "fact_id"])
    named = named.withColumn("_shared", F.count(F.lit(1)).over(Window.partitionBy(*by, "fact_id")) > 1)
    core = F.array_sort(T.core_words(F.col("fact")))
    groups = named.groupBy(*by, "_n").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_at", "fact_id", "attribute_key", "fact", "_i"))), lambda x: x).alias("_f"),
        F.array_sort(F.collect_set(F.struct(F.size(core).alias("n"), core.alias("core")))).alias("_sets"), F.count(F.lit(1)).alias("_many"), F.max("_shared").alias("_contested"),
    ).join(p.select(*by, "_n", "group_pos", "_key", "_fact"), [*by, "_n"])
    # all hold one another if each holds the next smaller; an empty set holds nothing and is held by nothing
    chain = F.forall(F.sequence(F.lit(1), F.size("_sets") - 1), lambda i: F.size(F.array_except(F.get("_sets", i - 1)["core"], F.get("_sets", i)["core"])) == 0)
    chain = (F.size("_sets") == 1) | chain
    valid = (F.col("_many") == 1) | ((F.get("_sets", 0)["n"] > 0) & chain)
    ids = F.transform("_f", lambda x: x["fact_id"])
    longest = F.aggregate("_f", F.lit(""), lambda a, x: F.when(F.length(x["fact"]) > F.length(a), x["fact"]).otherwise(a))
    upper = F.upper(T.normalize(F.col("_key")))
    alone = groups.where(~F.col("_contested") & valid).select(
        *by, ids.alias("fact_ids"), F.coalesce(F.nullif(T.normalize(F.col("_fact")), F.lit("")), longest).alias("fact"), F.when(upper.isin(keys), upper).otherwise(F.get("_f", 0)["attribute_key"]).alias("attribute_key"),
        F.array_sort(F.array_distinct(F.transform("_f", lambda x: x["attribute_key"]))).alias("source_attribute_keys"), F.array_min(F.transform("_f", lambda x: x["_i"])).alias("sort_index"),
    )
    props = groups.where("_contested").select(*by, "_n", ids.alias("source_fact_ids"), F.col("_key").alias("attribute_key"), F.col("_fact").alias("fact"), "_f")
    facts = props.select(*by, F.explode("_f").alias("f")).select(*by, "f._i", "f.fact_id", "f.attribute_key", "f.fact").distinct()
    facts = facts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_i", "fact_id", "attribute_key", "fact", T.core_words(F.col("fact")).alias("core")))).alias("facts"))
    props = props.drop("_f").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_n", "source_fact_ids", "attribute_key", "fact"))).alias("props"))
    j = facts.join(props, by)
    schema = f"{', '.join(f'{c} {j.schema[c].dataType.simpleString()}' for c in by)}, {MERGED}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in (x for i in range(b.num_rows) for x in b.slice(i, 1).to_pylist()):
                known = {f["fact_id"]: (f["_i"], f) for f in row["facts"]}
                used: set[str] = set()
                for p in row["props"] or []:
                    ids = list(dict.fromkeys(x for x in (" ".join(str(y or "").split()) for y in p["source_fact_ids"] or []) if x in known and x not in used))
                    sets = [frozenset(known[x][1]["core"]) for x in ids]
                    if not ids or any(not (a and c and (a <= c or c <= a)) for i, a in enumerate(sets) for c in sets[i + 1 :]):
                        continue
                    key = " ".join((p["attribute_key"] or "").split()).upper()
                    fact = " ".join((p["fact"] or "").split()) or max((known[x][1]["fact"] for x in ids), key=len)
                    own = sorted({known[x][1]["attribute_key"] for x in ids})
                    out.append([row[c] for c in by] + [ids, fact, key if key in keys else known[ids[0]][1]["attribute_key"], own, min(known[x][0] for x in ids)])
                    used.update(ids)
            types = [b.schema.field(c).type for c in by] + [pa.list_(pa.string()), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32()]
            names = [*by, *[c.split()[0] for c in MERGED.split(", ")]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    merged = alone.unionByName(j.mapInArrow(run, schema))
    taken = merged.select(*by, F.explode("fact_ids").alias("fact_id"))
    rest = known.join(taken, [*by, "fact_id"], "left_anti").select(*by, F.array("fact_id").alias("fact_ids"), "fact", "attribute_key", F.array("attribute_key").alias("source_attribute_keys"), F.col("_i").alias("sort_index"))
    return renumbered(merged.unionByName(rest), by)
