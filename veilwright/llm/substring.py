"""Passages of words that repeat across documents, found level by level.

A window of min_words words that repeats contains windows of half its length that repeat. So half-length
windows are counted first, and not all of them: of the half-length windows in a window, the one with the
smallest hash speaks for it (winnowing), which is the same one wherever the window stands, so no repeat is
missed and few rows are shuffled. Where the chosen half repeats across documents, its windows are extended to
twice that length and counted again, by 128 bits; those that begin in a document with a smaller id are cut.

Documents with equal word sequences are collapsed to the first before that: all their windows repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwright.llm.runtime import Scratch, bitmap, in_bitmap, is_in, ship

NO_ID = 2**63 - 1
B1, B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
EMPTY = hashlib.sha256(b"").hexdigest()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * M1
    h = (h ^ (h >> np.uint64(27))) * M2
    return h ^ (h >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def _sums(values: np.ndarray, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of values[i] * base^i, and the powers of base's inverse: the hash of a stretch of any length is
    the difference of two sums, brought back to power 0."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _powers(base, len(values)), dtype=np.uint64)])
    return sums, _powers(_inverse(base), len(values) + 1)


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word (a run of bytes without ASCII white space), in order."""
    b = np.frombuffer(data, np.uint8)
    blank = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[1], blank.view(np.int8), [1]])))
    a, z = edge[::2], edge[1::2]
    sums, back = _sums(b.astype(np.uint64) + np.uint64(1), B1)
    return _mix((sums[z] - sums[a]) * back[a] + (z - a).astype(np.uint64))


def row_key(text: Column) -> Column:
    """128 bits that tell rows with one doc_id (all null ones are one) apart by their text."""
    return F.unhex(F.md5(F.coalesce(text.cast("binary"), F.lit(b""))))


def _texts(column: pa.Array) -> Iterator[bytes | None]:
    """A batch's texts one at a time; to_pylist() would hold all of them once more."""
    return (x.as_py() for x in column.cast(pa.large_binary()))


def _same_row(o: int, t: bytes, n: int) -> list[pa.Array]:
    return [pa.array(np.full(n, o)), pa.repeat(pa.scalar(t, pa.binary()), n)]


class Windows:
    """Hashes of all windows of a document."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        self.one, self.two = _sums(words, B1), _sums(_mix(words + B2), B2)

    def _of(self, x: tuple[np.ndarray, np.ndarray], starts: np.ndarray, length: int) -> np.ndarray:
        return _mix((x[0][starts + length] - x[0][starts]) * x[1][starts]).view(np.int64)

    def hashes(self, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        return self._of(self.one, starts, length), self._of(self.two, starts, length)

    def chosen(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For each window of `length` words the start of the half-length window that speaks for it; and the hashes of all half-length windows."""
        half = length // 2
        if self.n < length:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = self._of(self.one, np.arange(self.n - half + 1), half)
        spread, out = length - half + 1, np.empty(self.n - length + 1, np.int64)
        for i in range(0, len(out), 65536):
            part = h[i : i + 65536 + spread - 1]
            out[i : i + 65536] = np.lib.stride_tricks.sliding_window_view(part, spread).argmin(axis=1) + np.arange(i, min(i + 65536, len(out)))
        return out, h


def _first_level(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sha, at, hs = [], [], [], []
            for text in _texts(b.column(3)):
                words = (text or b"").split()
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                if len(words) >= min_words:
                    starts, h = Windows(word_hashes(text)).chosen(min_words)
                    starts = np.unique(starts)
                    at.append(starts.astype(np.int32))
                    hs.append(h[starts])
                else:
                    at.append(None)
                    hs.append(None)
            cols = [b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64()), pa.array(sha), pa.array(at, pa.list_(pa.int32())), pa.array(hs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "o", "t", "n", "sha", "at", "h"])

    return run


def _maybe_shared(bits: Broadcast):
    """A row for each half-length window whose hash may be in a bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 256):
                part = b.slice(i, 256)
                h = part.column(3).flatten().to_numpy(zero_copy_only=False)
                may = is_in(bits.value, h)
                row = pa.array(np.repeat(np.arange(len(part)), part.column(3).value_lengths().to_numpy(zero_copy_only=False))[may])
                yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), part.column(2).flatten().filter(pa.array(may)), pa.array(h[may])], names=["o", "t", "at", "h"])

    return run


def _second_level(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["w1", "w2", "o", "t", "start"]
        for b in batches:
            for o, t, text, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _texts(b.column(2)), b.column(3).to_pylist(), strict=True):
                w = Windows(word_hashes(text))
                chosen, _ = w.chosen(min_words)
                starts = np.flatnonzero(np.isin(chosen, np.array(at, dtype=np.int64)))
                for i in range(0, len(starts), 1 << 16):
                    s = starts[i : i + (1 << 16)]
                    one, two = w.hashes(s, min_words)
                    yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), *_same_row(o, t, len(s)), pa.array(s.astype(np.int32))], names=names)

    return run


def _all_windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for o, t, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _texts(b.column(2)), strict=True):
                w = Windows(word_hashes(text))
                for i in range(0, w.n - length + 1, 1 << 16):
                    s = np.arange(i, min(i + (1 << 16), w.n - length + 1))
                    one, two = w.hashes(s, length)
                    yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), *_same_row(o, t, len(s)), pa.array(s.astype(np.int32))], names=["w1", "w2", "o", "t", "start"])

    return run


def keep_mask(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of n words no window covers."""
    cover = np.zeros(n + 1, dtype=np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, np.minimum(starts + length, n), -1)
    return np.cumsum(cover)[:n] == 0


def _cut(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, removed = [], []
            for text, starts in zip(_texts(b.column(2)), b.column(3).to_pylist(), strict=True):
                words = text.split()
                keep = keep_mask(len(words), np.array(starts, dtype=np.int64), min_words)
                kept.append(b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k).decode())
                removed.append(int(len(words) - keep.sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["o", "t", "n_removed", "kept_text"])

    return run


def repeat_lengths(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """doc_id and longest, for each document with a window of min_words words that another document has too: the
    greatest length among min_words, twice it, four times it and so on at which one of its windows still repeats.

    Windows that repeat at one length are joined with those that follow on, which makes windows of twice the length
    by hashes alone, until none repeats. Here equal documents aren't collapsed: their windows repeat as well.
    """
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "lengths")
    o, t = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("o"), row_key(F.col("text")).alias("t")
    long = docs.where("text is not null").select(o, t, F.col("text").cast("string").alias("text")).mapInArrow(_all_windows(min_words), "w1 long, w2 long, o long, t binary, start int")
    found, length, now = None, min_words, scratch.keep(long, "all")
    while True:
        shared = scratch.keep(now.groupBy("w1", "w2").agg(F.min("o").alias("a"), F.max("o").alias("b")).where("a < b").select("w1", "w2"), "shared")
        last, now = now, scratch.keep(now.join(shared, ["w1", "w2"], "left_semi"), "repeated")
        scratch.drop(last)
        if now.isEmpty():
            break
        reached = scratch.keep(now.groupBy("o").agg(F.lit(length).alias("longest")), "reached")
        found = reached if found is None else found.unionByName(reached)
        after = now.select(F.col("w1").alias("x1"), F.col("w2").alias("x2"), "o", "t", (F.col("start") - length).alias("start"))
        twice = now.join(after, ["o", "t", "start"])
        last, now = now, scratch.keep(twice.select(F.xxhash64("w1", "x1").alias("w1"), F.xxhash64(F.lit("two"), "w2", "x2").alias("w2"), "o", "t", "start"), "twice")
        scratch.drop(last)
        length *= 2
    if found is None:
        found = docs.sparkSession.createDataFrame([], "o long, longest int")
    return found.groupBy("o").agg(F.max("longest").alias("longest")).select(F.when(F.col("o") != NO_ID, F.col("o")).alias("doc_id"), "longest")


def _levels(docs: DataFrame, min_words: int, scratch: Scratch, kept: Column) -> tuple[DataFrame, DataFrame]:
    """base: a row of doc_id, o, t, n, sha, first for each row of docs, where first is the smallest o with the same
    words; cut: o, t, n_removed and kept (of kept_text) of those first documents that lose words."""
    o, t = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("o"), row_key(F.col("text")).alias("t")
    text = F.col("text").cast("string").alias("text")
    level = docs.select(F.col("doc_id").cast("long").alias("doc_id"), o, t, text).mapInArrow(_first_level(min_words), "doc_id long, o long, t binary, n long, sha string, at array<int>, h array<long>")
    level = scratch.keep(level, "half")
    same = level.where(F.col("n") >= min_words).groupBy("sha").agg(F.min("o").alias("first"), F.max("o").alias("last")).where("first < last").select("sha", "first")
    # this and two more below are tables of their own: only a join of two plain exchanges can split the rows of a very
    # large group of copies, or of a very common passage
    same = scratch.keep(same, "same")
    # what a bitmap rules out doesn't move: documents without copies here; below, half-length windows that don't repeat,
    # which stay in arrays, a row a document, and texts without such windows
    copied = in_bitmap(bitmap(same.select(F.xxhash64("sha").alias("x"))), F.xxhash64("sha"))
    alone = level.where(~copied).withColumn("first", F.col("o"))
    base = alone.unionByName(level.where(copied).join(same, "sha", "left").withColumn("first", F.coalesce("first", "o")))
    own = [F.when(F.col("o") == F.col("first"), F.col(x)).alias(x) for x in ("at", "h")]
    # a table too, as a stage that asks two functions has twice the Python workers in memory
    base = scratch.keep(base.select("doc_id", "o", "t", "n", "sha", "first", *own), "base")
    halves = base.where("at is not null").select("o", "t", "at", "h")
    shared = halves.select("o", F.explode("h").alias("h")).groupBy("h").agg(F.min("o").alias("a"), F.max("o").alias("b")).where("a < b").select("h")
    shared = scratch.keep(shared, "shared")
    halves = halves.mapInArrow(_maybe_shared(bitmap(shared.select(F.col("h").alias("x")))), "o long, t binary, at int, h long")
    some = scratch.keep(halves.join(shared, "h", "left_semi").groupBy("o", "t").agg(F.collect_set("at").alias("at")), "some")
    row = F.xxhash64("o", "t")
    moved = docs.select(o, t, text).where(in_bitmap(bitmap(some.select(row.alias("x"))), row))
    whole = scratch.keep(moved.join(some, ["o", "t"]).select("o", "t", "text", "at"), "whole")
    windows = scratch.keep(whole.mapInArrow(_second_level(min_words), "w1 long, w2 long, o long, t binary, start int"), "windows")
    before = windows.groupBy("w1", "w2").agg(F.min("o").alias("a"), F.max("o").alias("b")).where("a < b").select("w1", "w2", "a")
    before = scratch.keep(before, "before")
    starts = windows.join(before, ["w1", "w2"]).where("o > a").groupBy("o", "t").agg(F.collect_set("start").alias("starts"))
    cut = whole.select("o", "t", "text").join(starts, ["o", "t"]).mapInArrow(_cut(min_words), "o long, t binary, n_removed long, kept_text string")
    cut = scratch.keep(cut.select("o", "t", "n_removed", kept), "cut")
    for x in (level, same, shared, some, windows, whole, before):
        scratch.drop(x)
    return base.select("doc_id", "o", "t", "n", "sha", "first"), cut


def repeat_digest(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of docs (doc_id, text), of its words without those
    under a window of min_words words whose sequence also begins in a document with a smaller doc_id.

    Words are runs without ASCII white space. A null text has none; a text with fewer than min_words words loses
    none; a null doc_id is one document that comes after all others; rows that repeat a doc_id are one document,
    each with its own result. An empty table gives an empty one; other columns aren't read.
    """
    ship(docs.sparkSession)
    base, cut = _levels(docs, min_words, Scratch(docs.sparkSession, "substring"), F.sha2("kept_text", 256).alias("cut_sha"))
    short = cut.dropDuplicates(["o", "t"])
    copy = F.col("o") > F.col("first")
    return base.join(short, ["o", "t"], "left").select(
        "doc_id",
        F.col("n").alias("n_words"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
    )


def drop_repeats(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc_id, kept_text, n_removed) for each row of docs: its kept words, joined by blanks where words were cut
    and as they stand in the text where none were. See repeat_digest() for the cases."""
    ship(docs.sparkSession)
    base, cut = _levels(docs, min_words, Scratch(docs.sparkSession, "substring"), F.col("kept_text"))
    firsts = base.groupBy("o", "t").agg(F.max(F.col("o") > F.col("first")).alias("copy"), F.max("n").alias("n"))
    o, t = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), row_key(F.col("text"))
    rows = docs.select("doc_id", "text", o.alias("o"), t.alias("t")).join(firsts, ["o", "t"]).join(cut.dropDuplicates(["o", "t"]), ["o", "t"], "left")
    return rows.select("doc_id", F.when(F.col("copy"), F.lit("")).otherwise(F.coalesce("kept_text", "text", F.lit(""))).alias("kept_text"), F.when(F.col("copy"), F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"))
