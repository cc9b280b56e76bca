"""Lines that several documents share: keep them in the first document only.

Lines are exploded with their position and keyed by 128 bits of their normalised form; documents are counted
per key, and what is left of each document is put together again by position. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwright.llm.runtime import Scratch, fresh

BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_ID = 2**63 - 1


def ascii_lower(c: Column) -> Column:
    """A-Z only: other letters keep their case."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _flags(dropped: Column) -> Column:
    """Up to the last of some positions (in rising order), whether each place is one of them. As long as the text has
    lines, whatever their number: it meets the lines one by one, so nothing is looked up in a list."""
    gap = lambda x, i: x - F.coalesce(F.get(dropped, i - 1), F.lit(-1)) - 1
    return F.flatten(F.transform(dropped, lambda x, i: F.concat(F.array_repeat(F.lit(False), gap(x, i)), F.array(F.lit(True)))))


def drop_repeated_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text (in place of columns of these names).

    A line whose key (ASCII white space stripped at both ends, A-Z lower-cased) has min_chars code points or
    more and is found in min_docs documents or more stays only in the smallest doc_id that has it, there as
    often as it occurs. The other lines stay as they are, joined by newlines. A null or empty text is one empty
    line, a null doc_id is one document that comes after all others, and repeated rows are one document that
    each row returns. An empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    o, t, d = fresh(docs, "ord", "text_id", "dropped")
    keyed = docs.withColumns({o: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), t: F.xxhash64("text")})
    lines = keyed.select(F.col(o).alias("o"), F.col(t).alias("t"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    lines = lines.select("o", "t", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    lines = scratch.keep(lines.select("o", "t", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2")), "lines")
    repeated = lines.groupBy("h1", "h2").agg(F.count_distinct("o").alias("n"), F.min("o").alias("first")).where(F.col("n") >= min_docs)
    # a table of its own: only a join of two plain exchanges can split the rows of a very common line
    repeated = scratch.keep(repeated, "repeated")
    gone = lines.join(repeated, ["h1", "h2"]).where("o <> first").groupBy("o", "t").agg(F.array_sort(F.collect_set("pos")).alias(d))
    gone = gone.select(F.col("o").alias(o), F.col("t").alias(t), d)
    text, own = F.col("text"), {"n_lines", "n_dropped", "kept_text"}
    joined = keyed.join(gone, [o, t], "left").select(
        *[c for c in docs.columns if c.lower() not in own],
        F.size(_lines(text)).cast("long").alias("n_lines"),
        F.coalesce(F.size(d), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col(d).isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.zip_with(_lines(text), _flags(F.col(d)), lambda line, gone_: F.when(~F.coalesce(gone_, F.lit(False)), line)), "\n")).alias("kept_text"),
    )
    return joined


def line_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of drop_repeated_lines()."""
    return drop_repeated_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
