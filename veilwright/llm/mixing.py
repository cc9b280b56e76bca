"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a share of the tokens. Complete epochs come first; the rest of the share is a weighted sample
without replacement: the key of a document is u^(1/w), the same order as exponential keys -ln(u)/w, with u a
hash of the document and w its quality weight. In falling key order the sizes are summed up to the rest.

Keys are dealt to fixed buckets. Sums per source and bucket show the one bucket in which a source's rest runs
out, and only that bucket is sorted, so a source with a third of all rows needs no large task. What comes out
is a small table of cuts; which rows are taken follows from it row by row. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwright.llm.runtime import Scratch, fresh

SHARE, CAP = 1.5, 2.0
WEIGHTS = (5.0, 2.0, 1.0)
BUCKETS = 1024
NO_ID = 2**63 - 1
BROADCAST_SOURCES = 10_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(id_: Column, text: Column) -> Column:
    """From above 0 to 1, the same in every run: 52 bits of the MD5 of the id (of the text where that is null)."""
    h = F.md5(F.coalesce(id_.cast("string"), F.md5(F.coalesce(text, F.lit("")))).cast("binary"))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("long") + 1) / F.lit(2.0**52)


def key(u: Column, weight: Column) -> Column:
    """u^(1/weight); weights 1 and 2 are exact."""
    return F.when(weight == 1, u).when(weight == 2, F.sqrt(u)).otherwise(F.pow(u, 1 / weight))


def source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def targets(sizes: DataFrame, share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """sizes (source, source_size) with target. Sources in code point order, null last, weigh weights, repeating,
    and share `share` times all sizes; none gets more than cap times its size, and what is over goes to the rest
    by weight until none is above. The table has a row per source; it alone is ranked in one task."""
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (number % len(weights) + 1).cast("int")))
    w = w.withColumn("most", F.col("source_size") * F.lit(cap))
    filled = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(filled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * F.lit(share)
    level = (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(after)
    w = w.withColumn("level", level).withColumn("full", F.col("level") * F.col("w") >= F.col("most"))
    # the sources that are full come first in this order; the first that isn't sets the level of all after it
    w = w.withColumn("open", F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(filled.rowsBetween(Window.unboundedPreceding, 0)))
    return w.select("source", "source_size", F.when(F.col("open").isNull(), F.col("most")).otherwise(F.least(F.col("open") * F.col("w"), F.col("most"))).alias("target"))


def cuts(rows: DataFrame, scratch: Scratch, buckets: int = BUCKETS) -> DataFrame:
    """For each source of rows (source, s, size, k, o): s, source_size, target, epochs (complete ones), and in the
    order of falling k, then rising o, the last row of the sample (cut_k, cut_o), and one row more (extra_k,
    extra_o) if its size brings the source nearer to its target than the sample alone does."""
    bucket = F.least(F.floor(F.col("k") * buckets), F.lit(buckets - 1)).cast("int")
    rows = rows.withColumn("b", bucket)
    sums = scratch.keep(rows.groupBy("s", "b").agg(F.max("source").alias("source"), F.sum("size").alias("n")), "sums")
    want = targets(sums.groupBy("s").agg(F.max("source").alias("source"), F.sum("n").alias("source_size")).select("source", "source_size"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    want = want.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    want = scratch.keep(want.withColumn("s", source_key(F.col("source"))), "want")
    down = Window.partitionBy("s").orderBy(F.desc("b"))
    at = sums.withColumn("before", F.coalesce(F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = at.join(want.select("s", "rest"), "s").where("before <= rest and before + n > rest and rest > 0").groupBy("s").agg(F.max(F.struct("b", "before", "rest")).alias("x"))
    at = scratch.keep(at.select("s", "x.*"), "at")
    inside = rows.join(at, ["s", "b"]).withColumn("sum", F.col("before") + F.sum("size").over(Window.partitionBy("s", "b").orderBy(F.desc("k"), "o").rowsBetween(Window.unboundedPreceding, 0)))
    inside = inside.where("sum <= rest").groupBy("s").agg(F.max("sum").alias("sum"), F.min(F.struct("k", (-F.col("o")).alias("o"))).alias("c"))
    # no row of the bucket fits: the sample ends with the bucket above, which begins at this key
    above = F.when(F.col("b") == buckets - 1, F.lit(2.0)).otherwise((F.col("b") + 1) / F.lit(float(buckets)))
    cut = at.join(inside, "s", "left").select(
        "s", F.struct("rest", F.coalesce("sum", "before").alias("sum"), F.coalesce(F.col("c.k"), above).alias("cut_k"), F.coalesce(-F.col("c.o"), F.lit(NO_ID)).alias("cut_o")).alias("cut")
    )
    cut = scratch.keep(cut, "cut")
    gap = F.col("cut.rest") - F.col("cut.sum")
    spare = rows.join(_small(cut), "s").where(~_chosen("k", "o", "cut")).where((F.col("size") > 0) & (F.abs(F.col("size") - gap) < gap))
    extra = spare.groupBy("s").agg(F.min(F.struct(F.abs(F.col("size") - gap).alias("d"), (-F.col("k")).alias("k"), "o")).alias("e"))
    out = want.join(cut.select("s", "cut.cut_k", "cut.cut_o"), "s", "left").join(extra, "s", "left")
    return scratch.keep(out.select("s", F.struct("source_size", "target", "epochs", "cut_k", "cut_o", (-F.col("e.k")).alias("extra_k"), F.col("e.o").alias("extra_o")).alias("cut")), "cuts")


def _chosen(k: str, o: str, cut: str) -> Column:
    c = F.col(cut)
    return (F.col(k) > c["cut_k"]) | ((F.col(k) == c["cut_k"]) & (F.col(o) <= c["cut_o"]))


def _small(t: DataFrame) -> DataFrame:
    """With the broadcast hint where t, a row per source, is counted and small; beyond that Spark joins by key."""
    return F.broadcast(t) if t.count() <= BROADCAST_SOURCES else t


def _times(k: str, o: str, cut: str) -> Column:
    c = F.col(cut)
    more = F.coalesce(_chosen(k, o, cut), F.lit(False)) | F.coalesce((F.col(k) == c["extra_k"]) & (F.col(o) == c["extra_o"]), F.lit(False))
    return F.least(c["epochs"] + more.cast("long"), F.lit(int(CAP)).cast("long"))


def label_weights(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, str]:
    """docs and the name of a new column: weight 2 for a document that labels (doc_id, quality) call good, else 1."""
    w, i = fresh(docs, "weight", "labelled_id")
    good = labels.groupBy(F.col("doc_id").cast("long").alias(i)).agg((F.coalesce(F.max("quality"), F.lit(0)) > 0).cast("int").alias(w)).where(F.col(w) == 1)
    joined = docs.join(good, docs["doc_id"].cast("long") == good[i], "left")
    return joined.select(*[docs[c] for c in docs.columns], (F.coalesce(good[w], F.lit(0)) + 1).alias(w)), w


def _narrow(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """doc_id, source, size, weight, s, k, o. Words are counted before rows meet labels, so only numbers are shuffled."""
    id_, text = F.col("doc_id"), F.col("text")
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(text).alias("size"), uniform(id_, text).alias("u"), F.lit(1).alias("weight"))
    weighed, w = (sized, "weight") if labels is None else label_weights(sized.drop("weight"), labels)
    return weighed.select("doc_id", "source", "size", F.col(w).alias("weight"), source_key(F.col("source")).alias("s"), key(F.col("u"), F.col(w)).alias("k"), F.coalesce(id_.cast("long"), F.lit(NO_ID)).alias("o"))


def mix_report(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One row for each row of docs (doc_id, text, source): doc_id, size (words), source_size, target (of its
    source), taken (words the mix takes: size times the number of times), weight, times.

    Documents are taken whole, twice at most. A null text has size 0 and is never counted; a null source is a
    source; a null doc_id draws its key from its text; without labels all weights are 1; rows that repeat a doc_id share its key and are taken
    together; an empty table gives none. Reruns agree, as nothing is drawn but hashes.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    rows = scratch.keep(_narrow(docs, labels), "rows")
    cut = cuts(rows, scratch)
    return rows.join(_small(cut), "s").select("doc_id", "size", "cut.source_size", "cut.target", (F.col("size") * _times("k", "o", "cut")).alias("taken"), "weight", _times("k", "o", "cut").alias("times"))


def mix(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The mix itself: each row of docs as often as mix_report() takes it, columns unchanged. The cuts, a row per source,
    meet the rows where they are. Most documents are taken as often with a good label as without one; only the others,
    about a quarter of a source at most, are shuffled to meet labels."""
    scratch = Scratch(docs.sparkSession, "mix")
    k, g, o, s, c, n = fresh(docs, "k", "good_k", "o", "s", "c", "n")
    text, id_ = F.col("text"), F.col("doc_id")
    u, plain = uniform(id_, text), F.lit(1)
    own = {k: key(u, plain), g: key(u, F.lit(2)), o: F.coalesce(id_.cast("long"), F.lit(NO_ID)), s: source_key(F.col("source").cast("string"))}
    rows = scratch.keep(_narrow(docs, labels).select("source", "size", "s", "k", "o"), "rows")
    cut = cuts(rows, scratch).select(F.col("s").alias(s), F.col("cut").alias(c))
    cut = _small(cut)
    keyed = docs.withColumns(own).join(cut, s)
    once, good = _times(k, o, c).cast("int"), _times(g, o, c).cast("int")
    if labels is None:
        taken = keyed.select(*docs.columns, once.alias(n))
    else:
        told = (once == good) | id_.isNull()
        met, w = label_weights(keyed.where(~told).select(*docs.columns, once.alias(k), good.alias(g)), labels)
        taken = keyed.where(told).select(*docs.columns, once.alias(n)).unionByName(met.select(*docs.columns, F.when(F.col(w) == 2, F.col(g)).otherwise(F.col(k)).alias(n)))
    return taken.where(F.col(n) > 0).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(n))).alias(k)).drop(k)
