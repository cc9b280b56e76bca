"""Transcripts, rewrites, re-identification results and facts from JSONL, CSV, JSON and Parquet.

Files have an order that matters where an id repeats. Spark reads splits in any order, so pos is the file's place
and the row's place in it: text files are read whole lines at a time and numbered by monotonically_increasing_id(),
which rises within a split and from split to split of a file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright import dims
from veilwright.functions import text as T
from veilwright.operators.selection import first_wins, last_wins
from veilwright.sources.jsonlists import elements

CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "encoding": "UTF-8"}
TRANSCRIPT = "conversation_id string, user_message string"
REID = (
    "transcript_id string, identifier_candidates array<struct<interviewee_candidates:array<string>,interviewee_candiates:array<string>,"
    "identity_label:string,platform_or_source:string,link:string,year:int,confidence:string,matches_description:string,mismatches_description:string>>"
)
FACT_FILE = (
    "transcript_id string, facts array<struct<category_id:string,category_label:string,code_id:string,code_label:string,code_definition:string,"
    "inclusion_criteria:string,exclusion_criteria:string,excerpt:string,fact:string>>"
)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.monotonically_increasing_id().alias("pos"))


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """transcript_id, text, pos of a JSONL file: blank lines skipped, both stripped, rows that lack either left out; of
    an id that repeats the last text counts, at the first place. A line that isn't JSON fails."""
    rows = _lines(spark, path).where(T.strip(F.col("value")) != "")
    r = rows.select("pos", F.from_json("value", TRANSCRIPT, {"mode": "FAILFAST"}).alias("r"))
    out = r.select(T.strip(F.coalesce("r.conversation_id", F.lit(""))).alias("transcript_id"), T.strip(F.coalesce("r.user_message", F.lit(""))).alias("text"), "pos")
    return last_wins(out.where("transcript_id <> '' and text <> ''"), F.col("transcript_id"))


def transcripts_as_written(spark: SparkSession, path: str) -> DataFrame:
    """transcripts(), but nothing is stripped and a blank line fails."""
    rows = _lines(spark, path)
    r = rows.select("pos", F.when(T.strip(F.col("value")) == "", F.raise_error(F.lit("a blank line")).cast("string")).otherwise(F.col("value")).alias("value"))
    r = r.select("pos", F.from_json("value", TRANSCRIPT, {"mode": "FAILFAST"}).alias("r")).select(F.col("r.conversation_id").alias("transcript_id"), F.col("r.user_message").alias("text"), "pos")
    return last_wins(r.where("transcript_id <> '' and text <> ''"), F.col("transcript_id"))


def transcript_rows(spark: SparkSession, path: str) -> DataFrame:
    """transcripts() with rows of a repeated id kept; fails if there are none."""
    rows = _lines(spark, path).where(T.strip(F.col("value")) != "").select("pos", F.from_json("value", TRANSCRIPT).alias("r"))
    out = rows.select(T.strip(F.col("r.conversation_id")).alias("transcript_id"), T.strip(F.col("r.user_message")).alias("text"), "pos").where("transcript_id <> '' and text <> ''")
    if out.isEmpty():
        raise ValueError(f"no transcripts in {path}")
    return out


def csv(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.options(**CSV).csv(path)
    return df.withColumn("pos", F.monotonically_increasing_id())


def text_map(df: DataFrame, id_col: str, text_col: str, epsilon: str | None = None) -> DataFrame:
    """transcript_id (lower case), text, pos of a table of rows with pos; epsilon keeps the rows whose column of that
    name is that very string. Empty ids and texts are left out and the last of an id wins."""
    if epsilon is not None:
        df = df.where(F.coalesce(T.strip(F.col("epsilon").cast("string")), F.lit("")) == epsilon)
    out = df.select(F.lower(T.strip(F.col(id_col).cast("string"))).alias("transcript_id"), T.strip(F.col(text_col)).alias("text"), "pos").where("transcript_id <> '' and text <> ''")
    return last_wins(out, F.col("transcript_id"))


def empty_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "pos bigint, transcript_id string, text string")


def csv_map(spark: SparkSession, path: str | None, pairs: Sequence[tuple[str, str]], epsilon: str | None = None) -> DataFrame:
    """text_map() of a CSV file by the first of several pairs of id and text column that it has; empty if it has none,
    or if there is no such file."""
    if not path or not exists(spark, path):
        return empty_map(spark)
    df = csv(spark, path)
    pair = next((p for p in pairs if set(p) <= set(df.columns)), None)
    return text_map(df, *pair, epsilon) if pair else empty_map(spark)


def rewrites(spark: SparkSession, path: str) -> DataFrame:
    """transcript_id (as written), text of a CSV file, which must have these columns."""
    df = csv(spark, path)
    if lacking := {"transcript_id", "text"} - set(df.columns):
        raise ValueError(f"{path} lacks the columns {sorted(lacking)}")
    out = df.select(T.strip(F.col("transcript_id")).alias("transcript_id"), T.strip(F.coalesce("text", F.lit(""))).alias("text"), "pos").where("transcript_id <> ''")
    return last_wins(out, F.col("transcript_id"))


def new_inputs(spark: SparkSession, path: str, done: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of a CSV file with id and text whose id, in its case, isn't in done."""
    df = csv(spark, path).select(T.strip(F.col(id_col)).alias("transcript_id"), T.strip(F.col(text_col)).alias("text"), "pos").where("transcript_id <> '' and text <> ''")
    return df.join(done.select("transcript_id"), "transcript_id", "left_anti")


def reid_rows(spark: SparkSession, path: str) -> DataFrame:
    """transcript_id (normalised), pos, identifier_candidates of a JSON file: a list, or an object with a list under
    results, rows or data. Candidates that aren't a list are none; the last of an id wins."""
    rows = elements(spark, path, ("results", "rows", "data"))
    got = rows.select("pos", F.from_json(F.to_json("r"), REID).alias("r"))
    out = got.select("pos", T.dataset_id(F.col("r.transcript_id")).alias("transcript_id"), F.coalesce("r.identifier_candidates", F.from_json(F.lit("[]"), REID.split(" ", 3)[3])).alias("identifier_candidates"))
    return last_wins(out.where("transcript_id <> ''"), F.col("transcript_id"))


def json_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a JSON file that holds a list, with pos; empty if there is no file or no list in it."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"pos bigint, {schema}")
    return elements(spark, path, ()).select("pos", F.from_json(F.to_json("r"), schema).alias("r")).select("pos", "r.*")


def fact_files(spark: SparkSession, root: str) -> DataFrame:
    """transcript_id, facts of a folder of JSON files but all_code_facts.json. The id is the file's, normalised, or its
    name; fails if there is none."""
    files = spark.read.text(root, wholetext=True, pathGlobFilter="*.json").select("value", F.col("_metadata.file_name").alias("name"))
    got = files.where("name <> 'all_code_facts.json'").select("name", F.from_json("value", FACT_FILE).alias("r"))
    own = F.coalesce(F.nullif(T.dataset_id(F.col("r.transcript_id")), F.lit("")), T.dataset_id(F.regexp_replace("name", r"\.json$", "")))
    out = got.select(own.alias("transcript_id"), F.col("r.facts").alias("facts"), "name")
    if out.isEmpty():
        raise ValueError(f"no facts under {root}")
    return out


def reference_profiles(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """The stored reference profiles (see sinks.write_profiles) of ids (transcript_id); fails if one has none."""
    got = spark.read.parquet(f"{path.rstrip('/')}/reference_profiles")
    lost = [r[0] for r in ids.select("transcript_id").join(got, "transcript_id", "left_anti").orderBy("transcript_id").limit(10).collect()]
    if lost:
        raise ValueError(f"no reference profile of {', '.join(map(str, lost))}" + (" and perhaps others" if len(lost) == 10 else ""))
    return got.join(ids.select("transcript_id").distinct(), "transcript_id")


def checked_ids(facts: DataFrame, asked: list[str] | None) -> DataFrame:
    """The ids asked for, normalised, each once, which must be there; all, sorted, if none is asked for."""
    if not asked:
        return facts.select("transcript_id").distinct().orderBy("transcript_id")
    want = facts.sparkSession.createDataFrame(list(enumerate(asked)), "pos int, transcript_id string").withColumn("transcript_id", T.dataset_id(F.col("transcript_id")))
    want = first_wins(want, F.col("transcript_id"))
    lost = [r[0] for r in want.join(facts, "transcript_id", "left_anti").select("transcript_id").collect()]
    if lost:
        raise ValueError(f"no facts of {sorted(lost)}")
    return want.orderBy("pos")


#: Columns of each configuration's file, and the value of `epsilon` that it keeps.
DEFAULT_PAIR = (("transcript_id", "text"),)
CONFIG_COLUMNS: dict[str, tuple[tuple[tuple[str, str], ...], str | None]] = {
    "anonymized_transcripts": ((("Dataset_ID", "Transcript"),), None),
    "presidio": ((("Dataset_ID", "rewritten_transcript_presidio"),), None),
    "rewritten_v1": ((("Dataset_ID", "rewritten transcript"), ("transcript_id", "text")), None),
    "rewritten_v2": ((("Dataset_ID", "rewritten transcript"), ("transcript_id", "text")), None),
    **{f"dpmlm_eps_{e}": ((("transcript_id", "rewritten_text"),), str(e)) for e in (10, 30, 50, 70)},
    **{f"dpmlm_eps_{e}": ((("Dataset_ID", "rewritten_transcript"),), str(e)) for e in (100, 120, 140)},
}


def config_sources(spark: SparkSession, paths: dict[str, str], only: Sequence[str] | None = None) -> DataFrame:
    """config, transcript_id, text, pos, source of the files given for configurations; those without texts have no row.
    `only` restricts them, and each of its names must be known and have texts."""
    names = list(only) if only else [c for c in dims.CONFIGS if c in paths]
    if unknown := [c for c in names if c not in dims.CONFIGS or c not in paths]:
        raise ValueError(f"no file for {unknown}")
    out = None
    for c in names:
        pairs, epsilon = CONFIG_COLUMNS.get(c, (DEFAULT_PAIR, None))
        one = csv_map(spark, paths[c], pairs, epsilon)
        if only and one.isEmpty():
            raise ValueError(f"no texts in {paths[c]}")
        one = one.select(F.lit(c).alias("config"), "transcript_id", "text", "pos", F.lit(paths[c]).alias("source"))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else empty_map(spark).select(F.lit("").alias("config"), "transcript_id", "text", "pos", F.lit("").alias("source"))


def in_config_order(df: DataFrame, column: str = "config") -> DataFrame:
    """The rows of known configurations, in their order."""
    d = dims.names(df.sparkSession, dims.CONFIGS, column).withColumnRenamed("pos", "config_pos")
    return df.join(F.broadcast(d), column).orderBy("config_pos")


def input_spec(spec: str, root: str = "") -> tuple[str, str]:
    """(label, path) of `label=path` or `path`: the label is a slug, of the path's last name if none is given."""
    import re

    label, eq, path = spec.partition("=")
    path = path if eq else label
    label = label if eq else path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
    slug = re.sub(r"[^a-zA-Z0-9]+", "_", label.strip()).strip("_").lower() or "run"
    absolute = path.startswith("/") or "://" in path
    return slug, path if absolute or not root else f"{root.rstrip('/')}/{path}"


def conversations_as_transcripts(df: DataFrame) -> DataFrame:
    """transcript_id, text of a table of turns: `role: text`, a line each, in order of turn."""
    line = F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("text", F.lit("")))
    turns = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return df.groupBy(F.col("conv_id").alias("transcript_id")).agg(F.array_join(F.transform(turns, lambda t: t["line"]), "\n").alias("text"))
