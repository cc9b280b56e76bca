"""Filters, joins by id, ranking and top-k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwright import dims
from veilwright.functions import text as T

CANDIDATE = "interviewee_candidates array<string>, identity_label string, confidence string"


def last_wins(df: DataFrame, key: Column, pos: str = "pos") -> DataFrame:
    """One row for each key, with the values of the row of the highest pos at the place of the lowest."""
    rest = [c for c in df.columns if c != pos]
    got = df.withColumn("_key", key).groupBy("_key").agg(F.min(pos).alias("_pos"), F.max_by(F.struct(*rest), pos).alias("_row"))
    return got.select(F.col("_pos").alias(pos), *[F.col("_row")[c].alias(c) for c in rest])


def first_wins(df: DataFrame, key: Column, pos: str = "pos") -> DataFrame:
    rest = list(df.columns)
    return df.withColumn("_key", key).groupBy("_key").agg(F.min_by(F.struct(*rest), pos).alias("_row")).select(*[F.col("_row")[c].alias(c) for c in rest])


def requested_ids(df: DataFrame, ids: str) -> DataFrame:
    """The ids of a comma-separated list: req_pos, req_id; blanks stripped, empty ones left out."""
    one = df.sparkSession.range(1)
    return one.select(F.posexplode(F.split(F.lit(ids), ",")).alias("req_pos", "x")).select("req_pos", T.strip(F.col("x")).alias("req_id")).where("req_id <> ''")


def by_id_list(df: DataFrame, ids: str, id_col: str) -> DataFrame:
    """Rows of the ids in a list, with req_pos, the order asked for."""
    want = requested_ids(df, ids)
    return df.join(want, df[id_col].cast("string") == want["req_id"]).drop("req_id")


def missing_ids(df: DataFrame, ids: str, id_col: str) -> DataFrame:
    want = requested_ids(df, ids)
    return want.join(df, df[id_col].cast("string") == want["req_id"], "left_anti")


def pending(df: DataFrame, done: DataFrame, id_col: str, forced: DataFrame | None = None, case_sensitive: bool = False) -> DataFrame:
    """Rows whose id is not in done, or is in forced."""
    key = (lambda c: c) if case_sensitive else F.lower
    ids = done.select(key(F.col(id_col).cast("string")).alias("_done"))
    if forced is not None:
        again = forced.select(key(F.col(id_col).cast("string")).alias("_done"))
        ids = ids.join(again, "_done", "left_anti")
    return df.join(ids, key(df[id_col].cast("string")) == ids["_done"], "left_anti")


def pick_row(df: DataFrame, how: str = "first", id_: str | None = None, id_col: str = "transcript_id") -> DataFrame:
    """The row of an id in any case, or the first or the shortest text (the first of equals)."""
    if id_ is not None:
        return df.where(F.lower(id_col) == id_.lower()).orderBy("pos").limit(1)
    return df.orderBy(*([F.length("text")] if how == "shortest" else []), "pos").limit(1)


def shared_ids(df: DataFrame, id_col: str, label_col: str, labels: list[str]) -> DataFrame:
    """Ids that each of the labels has."""
    seen = df.where(F.col(label_col).isin(labels)).groupBy(id_col).agg(F.count_distinct(label_col).alias("_n"))
    return seen.where(F.col("_n") == len(set(labels))).select(id_col)


def missing_inputs(df: DataFrame, id_col: str, label_col: str, labels: list[str]) -> DataFrame:
    """(id, label) for each of the labels that an id lacks. The labels are few, so they are one array per id."""
    seen = df.groupBy(id_col).agg(F.collect_set(label_col).alias("_has"))
    return seen.select(id_col, F.explode(F.array_except(dims.text_array(labels), "_has")).alias(label_col))


def with_default(ids: DataFrame, found: DataFrame, id_col: str, column: str, default: Column) -> DataFrame:
    """All ids, with a column of found or the default."""
    return ids.join(found.select(id_col, column), id_col, "left").withColumn(column, F.coalesce(column, default))


def dedupe_keep_first(df: DataFrame, by: list[str], value: str, pos: str, least: int = 3) -> DataFrame:
    """Stripped values of `least` characters or more, one of each in any case per group: that at the lowest pos."""
    v = df.withColumn(value, T.strip(F.col(value))).where(F.length(value) >= least)
    return v.groupBy(*by, F.lower(value).alias("_low")).agg(F.min_by(value, pos).alias(value), F.min(pos).alias(pos)).drop("_low")


def top_n_values(df: DataFrame, by: list[str], value: str, pos: str, n: int, least: int = 3) -> DataFrame:
    """The first n of dedupe_keep_first() in each group."""
    d = dedupe_keep_first(df, by, value, pos, least)
    return d.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(pos))).where(F.col("rank") <= n)


def best_variation(df: DataFrame, by: list[str], cap: int = dims.TOO_SPECIFIC_MOST) -> DataFrame:
    """For each group of variations (idx, severity, loss, too_specific) the idx of the best: of those with no more than
    cap too specific dimensions, or of all if there are none, by too_specific (only then), severity, loss, idx.
    Missing scores count as 999. The minimum is taken before the shuffle, so a large group costs one row a task."""
    sev, loss, ts = (F.coalesce(c, F.lit(dims.MISSING_SCORE)) for c in ("severity", "loss", "too_specific"))
    within = ts <= cap
    order = F.struct((~within).cast("int").alias("late"), F.when(within, 0).otherwise(ts).alias("ts"), sev.alias("s"), loss.alias("l"), F.col("idx").alias("i"))
    return df.groupBy(*by).agg(F.min(order)["i"].alias("best_idx"), F.count(F.lit(1)).alias("n_variations"))


def specific_name(c: Column) -> Column:
    n = T.for_match(c)
    return (n != "") & ~reduce(lambda a, b: a | b, [F.contains(n, F.lit(x)) for x in dims.UNSPECIFIC])


def specific_identity(names: Column, label: Column) -> Column:
    """Whether any name, or the label, names somebody rather than nobody in particular."""
    return F.coalesce(F.exists(names, specific_name), F.lit(False)) | F.coalesce(specific_name(label), F.lit(False))


def clean_candidates(df: DataFrame) -> DataFrame:
    """Candidates with distinct non-empty names and normalised label and confidence; those with neither name nor label
    are left out. Either spelling of the column of names is read."""
    given = [F.col(c) for c in ("interviewee_candidates", "interviewee_candiates") if c in df.columns]
    names = F.array_distinct(F.filter(F.transform(F.coalesce(*given, dims.text_array(())), T.normalize), lambda n: n != ""))
    rest = [c for c in df.columns if c not in ("interviewee_candidates", "interviewee_candiates", "identity_label", "confidence")]
    out = df.select(*rest, names.alias("names"), T.normalize(F.col("identity_label")).alias("identity_label"), T.for_match(F.col("confidence")).alias("confidence"))
    return out.where((F.size("names") > 0) | (F.col("identity_label") != ""))


def rank_candidates(df: DataFrame, by: list[str], most: int | None = None) -> DataFrame:
    """clean_candidates() with candidate_index from 1 in each group: higher confidence first, then those with a label,
    then more names, then pos; `most` of them if given."""
    order = [F.desc(T.confidence_rank(F.col("confidence"))), F.desc(F.col("identity_label") != ""), F.desc(F.size("names")), F.asc("pos")]
    out = clean_candidates(df).withColumn("candidate_index", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out if not most else out.where(F.col("candidate_index") <= most)


def reidentified(df: DataFrame, by: list[str], threshold: str = "medium") -> DataFrame:
    """For each group with a specific candidate of the threshold's confidence or more: the most confident (the first of
    equals). An unknown threshold is medium."""
    low = threshold.lower()
    least = dims.CONFIDENCE.index(low) + 1 if low in dims.CONFIDENCE else 3
    rank = F.array_position(dims.text_array(dims.CONFIDENCE), F.lower(T.strip(F.coalesce("confidence", F.lit("")))))
    fit = df.withColumn("_rank", rank.cast("int")).where((F.col("_rank") >= least) & specific_identity(F.col("interviewee_candidates"), F.col("identity_label")))
    best = F.min_by(F.struct("identity_label", "confidence", "pos"), F.struct(-F.col("_rank"), F.col("pos")))
    return fit.groupBy(*by).agg(best.alias("_b")).select(*by, F.col("_b.identity_label").alias("identity_label"), F.col("_b.confidence").alias("confidence"), F.col("_b.pos").alias("pos"))


def evidence_for_prompt(candidates: Column, most: int = 3, names: int = 6, label_chars: int = 240, text_chars: int = 1600) -> Column:
    """The first candidates of an array, with few names and short texts, for a prompt."""

    def short(c: Column) -> Column:
        n = F.slice(F.filter(F.transform(F.coalesce(c["interviewee_candidates"], dims.text_array(())), T.normalize), lambda x: x != ""), 1, names)
        return F.struct(
            T.normalize(c["confidence"]).alias("confidence"), T.truncate(c["identity_label"], label_chars).alias("identity_label"), n.alias("interviewee_candidates"),
            T.truncate(c["matches_description"], text_chars).alias("matches_description"), T.truncate(c["mismatches_description"], text_chars).alias("mismatches_description"),
        )

    return F.transform(F.slice(candidates, 1, most), short)


def longest_first_text(df: DataFrame, by: list[str], value: str, pos: str) -> DataFrame:
    """The longest value of each group, the first of equals."""
    return df.groupBy(*by).agg(F.max_by(value, F.struct(F.length(value), -F.col(pos))).alias(value))


def collected_rewrites(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """final_text of each id; fails, naming none but their number, if an id has no text from a successful run."""
    out = ids.join(docs.select("transcript_id", "final_text", "status"), "transcript_id", "left")
    ok = (F.coalesce("final_text", F.lit("")) != "") & (F.col("status") == "success")
    checked = F.when(F.coalesce(ok, F.lit(False)), F.col("final_text")).otherwise(F.raise_error(F.concat(F.lit("no rewrite of "), F.col("transcript_id"))).cast("string"))
    return out.withColumn("final_text", checked).drop("status")
