"""Token ids in packed rows: best-fit-decreasing with a segment tree over the free space.

Documents are tokenised where they are read and packed within blocks of their partition, so no token is
shuffled: memory is bounded by the block, one long document is split over rows without loss, and a lost task
is simply run again on the same split. A block holds thousands of rows, enough that hardly any space is left.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.llm.runtime import ship

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how byte_bpe_50k cuts a text into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PACKED = (
    "pack_id long, n_tokens int, doc_ids array<long>, parts array<int>, starts array<long>, "
    "cu_seqlens array<int>, input_ids binary, position_ids binary"
)


@dataclass(frozen=True)
class Params:
    """seq_len: ids in a row; block_tokens: ids packed together (and held by a task) at a time; end_id: closes
    each document, and fills rows; dtype: of the matrices, little-endian; cached: pieces of text whose ids a
    worker remembers."""

    seq_len: int = 2048
    block_tokens: int = 1 << 22
    end_id: int = 50256
    dtype: str = "<u2"
    cached: int = 200_000


class FreeSpace:
    """A segment tree over the capacities 0..most: which is the smallest one at or above a length that an open row has?"""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.n = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, at: int, d: int) -> None:
        at += self.size
        while at:
            self.n[at] += d
            at >>= 1

    def put(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        self._add(capacity, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """(capacity, row) of the best fit, which is no longer open; None if nothing fits."""
        at = length + self.size
        if not self.n[at]:
            while at > 1 and (at & 1 or not self.n[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.n[2 * at] else 2 * at + 1
        capacity = at - self.size
        self._add(capacity, -1)
        return capacity, self.rows[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, most: int) -> list[list[int]]:
    """Rows of indices into lengths, each with a sum of most or less. Longest first; equal lengths in their order."""
    space, rows = FreeSpace(most), []
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        found = space.take(n)
        if found is None:
            found = most, len(rows)
            rows.append([])
        capacity, row = found
        rows[row].append(i)
        if capacity > n:
            space.put(capacity - n, row)
    return rows


class _Pieces(dict):
    """The ids of a blank and a piece of text without blanks. The tokeniser's pattern always cuts before a blank
    that stands alone, so a text's ids are those of its pieces, one after another."""

    def __init__(self, encode: Callable[[str], list[int]], dtype: str, most: int):
        super().__init__()
        self.encode, self.dtype, self.most = encode, dtype, most

    def __missing__(self, piece: str) -> bytes:
        out = np.array(self.encode(" " + piece), dtype=self.dtype).tobytes()
        if len(self) < self.most and len(piece) < 64:
            self[piece] = out
        return out


def encoder(ranks: bytes, params: Params) -> Callable[[str], np.ndarray]:
    """Whole text to ids, for a tiktoken file's content."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
    plain = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
    pieces = _Pieces(plain, params.dtype, params.cached)

    def encode(text: str) -> np.ndarray:
        head, *rest = text.split(" ")
        if not head or "" in rest:
            return np.array(plain(text), dtype=params.dtype)
        head = np.array(plain(head), dtype=params.dtype).tobytes()
        return np.frombuffer(head + b"".join(map(pieces.__getitem__, rest)), dtype=params.dtype)

    return encode


def _pack(block: list[tuple[int | None, np.ndarray]], first: int, p: Params) -> tuple[pa.RecordBatch, int]:
    """Pack a block's documents. A document longer than a row is cut into full rows and a rest."""
    segments = [(d, k, at, ids[at : at + p.seq_len]) for d, ids in block for k, at in enumerate(range(0, len(ids), p.seq_len))]
    rows = best_fit_decreasing(np.array([len(s[3]) for s in segments], dtype=np.int64), p.seq_len)
    count = np.arange(p.seq_len, dtype=p.dtype)
    cols: list[list] = [[] for _ in range(8)]
    for k, row in enumerate(rows):
        held = [segments[i] for i in row]
        ids, at = np.full(p.seq_len, p.end_id, dtype=p.dtype), np.zeros(p.seq_len, dtype=p.dtype)
        ends = np.cumsum([0] + [len(s[3]) for s in held])
        for s, a, b in zip(held, ends[:-1], ends[1:], strict=True):
            ids[a:b], at[a:b] = s[3], count[: b - a]
        new = first + k, int(ends[-1]), [s[0] for s in held], [s[1] for s in held], [s[2] for s in held], ends.tolist(), ids.tobytes(), at.tobytes()
        for c, v in zip(cols, new, strict=True):
            c.append(v)
    kinds = pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()
    names = [x.split()[0] for x in PACKED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names), len(rows)


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, params: Params = Params()) -> DataFrame:
    """Packed rows of the whole texts of docs (doc_id, text); see PACKED.

    input_ids and position_ids are rows of seq_len numbers (params.dtype). Of each segment the row has the
    doc_id, the part (0 for a document's first), the offset of its first id in the document, and a bound in
    cu_seqlens, which begins with 0; positions begin anew at 0 with each segment. The row's tail is end_id at
    position 0 and belongs to no segment. Each document ends with end_id, so null and empty texts are one id.
    Repeated rows and null doc_ids are packed like any others; other columns aren't read. An empty table
    gives no row. pack_id is the input partition and a running number in it.
    """
    spark: SparkSession = docs.sparkSession
    ship(spark)
    ranks = spark.sparkContext.broadcast(Path(tokenizer).read_bytes())
    end = np.array([params.end_id], dtype=params.dtype)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, block, held = encoder(ranks.value, params), [], 0
        first = TaskContext.get().partitionId() << 40
        for b in batches:
            for d, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.concatenate([encode(text.as_py() or ""), end])
                block.append((d, ids))
                held += len(ids)
                if held >= params.block_tokens:
                    out, n = _pack(block, first, params)
                    yield from (out.slice(i, 256) for i in range(0, len(out), 256))
                    first, block, held = first + n, [], 0
        if block:
            out, _ = _pack(block, first, params)
            yield from (out.slice(i, 256) for i in range(0, len(out), 256))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(packed, PACKED)


def write_packs(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, params: Params = Params()) -> DataFrame:
    """pack(), written as Parquet to path; returns what was written."""
    pack(docs, tokenizer, params).write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.schema(PACKED).parquet(path)


def unpack(packs: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, part, start, ids binary) of each segment of packed rows, as pack() cut them."""
    ship(packs.sparkSession)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for r in b.to_pylist():
                ids, cu = np.frombuffer(r["input_ids"], params.dtype), r["cu_seqlens"]
                rows += [(d, k, s, ids[x:y].tobytes()) for d, k, s, x, y in zip(r["doc_ids"], r["parts"], r["starts"], cu, cu[1:], strict=False)]
            kinds = pa.int64(), pa.int32(), pa.int64(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds)], names=["doc_id", "part", "start", "ids"])

    return packs.mapInArrow(segments, "doc_id long, part int, start long, ids binary")
