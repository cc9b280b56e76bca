"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into segments of 22, 21 and 21 bits. Of two fingerprints that differ in four
bits or fewer, by pigeonhole either one segment agrees and another differs in two bits at most, or two
segments differ in one bit each and the third in two at most. Each segment is decoded to the Golay codewords
near it; in the first case the agreeing segment with a shared nearby codeword is a common key (33 or 34 bits), in
the second a codeword of each segment is (36 bits). Candidates that share a key are verified on all 64 bits, so the
links are exact.

A bucket's members are first tied to its smallest member and to their predecessor, which joins the large
groups without listing their pairs; then only members outside a bucket's largest component are compared with
the bucket. No link between components is lost, and links within a component aren't listed.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilwright.llm import golay
from veilwright.llm.graph import components
from veilwright.llm.runtime import Scratch, bitmap, fresh, in_bitmap, ship

SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))
MAX_DISTANCE = 4
NO_ID = 2**63 - 1  # stands for a null doc_id: one that comes after all others


def joined_words(text: bytes | None) -> bytes:
    """The words, lower-cased (A-Z only) and joined by blanks. A word is a run of bytes without ASCII white space."""
    return b" ".join(text.lower().split()) if text else b""


def shingle_hashes(text: bytes | None, width: int) -> tuple[bytes, np.ndarray]:
    """joined_words() and the XXH64 of each run of `width` words, repeats included. Fewer words are one shingle, no
    words are none."""
    words = text.lower().split() if text else []
    joined = b" ".join(words)
    if len(words) <= width:
        return joined, np.array([xxhash.xxh64_intdigest(joined, SEED)][: len(words)], np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    spans = zip((ends - lens)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    h, n = xxhash.xxh64_intdigest, len(words) - width + 1
    return joined, np.fromiter((h(joined[a:b], SEED) for a, b in spans), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """Unsigned 64 bits: those that are set in over half of the hashes. No hashes: zero."""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65536):
        part = hashes[i : i + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """The fingerprint of a whole text, unsigned."""
    return majority(shingle_hashes(text, width)[1])


def _fingerprints(batches):
    for b in batches:
        texts = b.column(1).cast(pa.large_binary()).to_pylist()
        fp = np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["id", "fp"])


def keys(fp: np.ndarray) -> np.ndarray:
    """(n, 234) keys of signed 64-bit fingerprints: 36 of an agreeing segment and a codeword, 66 of three codewords
    for each segment that may be the one that differs in two bits. About 190 of a row are different."""
    v = fp.view(np.uint64)
    seg = [((v >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    near = [golay.near_codewords(s) for s in seg]
    out = [(t << 40) | (seg[a][:, None] << 12) | near[b] for t, (a, b) in enumerate(permutations(range(3), 2))]
    at = [x << (12 * i) for i, x in enumerate(near)]
    for a, b in combinations(range(3), 2):
        close = np.concatenate([at[a] | at[b][:, :1], at[a][:, :1] | at[b][:, 1:]], axis=1)
        out.append(((6 << 40) | close[:, :, None] | at[3 - a - b][:, None, :]).reshape(len(v), -1))
    return np.concatenate(out, axis=1)


def _keyed(batches):
    for b in batches:
        whole = b.column(0).to_numpy()
        for i in range(0, len(whole), 2048):
            fp = whole[i : i + 2048]
            k = np.sort(keys(fp), axis=1)
            new = np.ones(k.shape, dtype=bool)
            new[:, 1:] = k[:, 1:] != k[:, :-1]
            yield pa.RecordBatch.from_arrays([pa.array(k[new]), pa.array(np.repeat(fp, new.sum(axis=1)))], names=["key", "fp"])


def _near(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MAX_DISTANCE


def buckets(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, fp, lo, prev) of the keys that several of the distinct fingerprints of fps (fp long) have."""
    by_key = Window.partitionBy("key")
    met = (
        fps.mapInArrow(_keyed, "key long, fp long")
        .select("key", "fp", F.count(F.lit(1)).over(by_key).alias("n"), F.min("fp").over(by_key).alias("lo"), F.lag("fp").over(by_key.orderBy("fp")).alias("prev"))
        .where("n > 1")
    )
    return scratch.keep(met.drop("n"), "buckets")


def close(met: DataFrame) -> DataFrame:
    """(a, b): fingerprints of buckets() with the bucket's smallest one, and with the one before, that are near."""
    first = met.where(_near("fp", "lo") & (F.col("fp") != F.col("lo"))).select(F.col("fp").alias("a"), F.col("lo").alias("b"))
    return first.unionByName(met.where(_near("fp", "prev")).select(F.col("fp").alias("a"), F.col("prev").alias("b")))


def fingerprint_labels(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """(fp, label) of each distinct fingerprint of fps (fp long) that isn't its component's label; the label is
    one fingerprint of the component."""
    by_key = Window.partitionBy("key")
    met = buckets(fps, scratch)
    ties = scratch.keep(components(close(met), scratch), "ties")
    at = met.select("key", "fp").join(ties.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    mixed = at.withColumns({"l0": F.min("label").over(by_key), "l1": F.max("label").over(by_key)}).where("l0 <> l1")
    mixed = mixed.select("key", "fp", "label", F.count(F.lit(1)).over(Window.partitionBy("key", "label")).alias("c"))
    mixed = scratch.keep(mixed.select("key", "fp", "label", F.max(F.struct("c", "label")).over(by_key)["label"].alias("major")), "mixed")
    few = mixed.where("label <> major").select("key", F.col("fp").alias("fp2"), F.col("label").alias("label2"))
    more = few.join(mixed.select("key", "fp", "label"), "key").where((F.col("label") != F.col("label2")) & _near("fp", "fp2"))
    over = components(more.select(F.col("label").alias("a"), F.col("label2").alias("b")), scratch)
    top = over.select(F.col("node").alias("label"), F.col("label").alias("top"))
    moved = ties.join(top, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    out = scratch.keep(moved.unionByName(over), "labels")
    for x in (met, mixed, ties):
        scratch.drop(x)
    return out.withColumnRenamed("node", "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, fp (signed 64 bits), component_id (the smallest doc_id that links
    reach, its own included), n_same (rows with its very fingerprint).

    Fingerprints link at four differing bits or fewer. A null or empty text, or one without words, has
    fingerprint zero and links like any other. A null doc_id comes after all others: it is a component_id only
    where the component has no other, and is null there too. Repeated rows each return a row. An empty table
    returns an empty one; other columns aren't read, so their names don't matter.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "simhash")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints, "id long, fp long")
    rows = scratch.keep(rows, "rows")
    fps = scratch.keep(rows.groupBy("fp").agg(F.min(F.coalesce("id", F.lit(NO_ID))).alias("first"), F.count(F.lit(1)).alias("n_same")), "fps")
    labels = fingerprint_labels(fps.select("fp"), scratch)
    whole = fps.join(labels, "fp", "left").select("fp", "first", "n_same", F.coalesce("label", "fp").alias("label"))
    least = whole.join(labels.select("label").distinct(), "label", "left_semi").groupBy("label").agg(F.min("first").alias("least"))
    classes = whole.join(least, "label", "left").select("fp", "n_same", F.coalesce("least", "first").alias("c"))
    classes = scratch.keep(classes.select("fp", "n_same", F.when(F.col("c") != NO_ID, F.col("c")).alias("component_id")), "classes")
    return rows.join(classes, "fp").select(F.col("id").alias("doc_id"), "fp", "component_id", "n_same")


def keep_one(docs: DataFrame, found: Callable[..., DataFrame] = near_duplicates) -> DataFrame:
    """docs with one document of each near-duplicate group that `found` tells, that with the smallest doc_id; columns
    unchanged.

    Groups are told by text, so rows that share a doc_id but not a group don't keep each other. Rows that repeat a
    doc_id and text collapse to one; of several texts that a group has under its smallest doc_id, one stays. A document
    without doc_id comes after all others and stays if its group has no other; of several such, one stays.

    What goes and what repeats is found on numbers alone. A bitmap of fixed size tells which rows may be among those; only
    they are shuffled to be told for certain, the others stay where they are.
    """
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "keep")
    kid, tid = fresh(docs, "kept_id", "text_id")
    keyed = docs.withColumns({kid: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), tid: F.xxhash64("text")})
    told = scratch.keep(found(keyed, id_col=tid).groupBy("doc_id").agg(F.min("component_id").alias("g"), F.count(F.lit(1)).alias("n")), "told")
    others = told.where("doc_id <> g")
    several = told.where("n > 1 or doc_id <> g").select(F.col("doc_id").alias(tid), "g").unionByName(others.select(F.col("g").alias(tid), "g"))
    several = scratch.keep(several.distinct(), "several")
    pairs = keyed.where(in_bitmap(bitmap(several.select(F.col(tid).alias("x"))), F.col(tid))).groupBy(kid, tid).agg(F.count(F.lit(1)).alias("n"))
    pairs = scratch.keep(pairs.join(several, tid), "pairs")
    first = pairs.groupBy("g").agg(F.min(F.struct(kid, tid)).alias("k")).select("k.*")
    gone = scratch.keep(pairs.select(kid, tid).join(first, [kid, tid], "left_anti"), "gone")
    slot = F.xxhash64(F.lit("kept"), F.col(kid), F.col(tid))
    may = in_bitmap(bitmap(gone.unionByName(pairs.where("n > 1").select(kid, tid)).select(slot.alias("x"))), slot)
    moved = keyed.where(may).join(gone, [kid, tid], "left_anti").dropDuplicates([kid, tid])
    return keyed.where(~may).select(*docs.columns).unionByName(moved.select(*docs.columns))
