"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are word sequences (lower case, letters and digits). A document meets an item
through a shared seed of min_match words; then running Karp-Rabin greedy string tiling marks the longest
matches that don't overlap, in falling length, and the share of the item's words under tiles tells whether the
item is in the document, in whatever order its passages stand there.

The benchmark is cut into blocks of bounded size; each is sent to the executors in turn and documents are read
where they are, so no document moves and a passage that many documents hold makes no task larger.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwright.llm.runtime import fresh, ship

WORD = re.compile(r"[^\W_]+")
BASE, MODULUS = 1_000_003, (1 << 61) - 1
MIX = np.uint64(0x9E3779B97F4A7C15)
FOUND = "array<struct<item_id:bigint,coverage:double,n_tiles:int,longest:int,tiles:array<struct<doc_start:int,item_start:int,n:int>>>>"


@dataclass(frozen=True)
class Params:
    """min_match: words of the shortest tile (an item with fewer words is found where it is the whole text); first_search: the length
    that tiling begins with; min_coverage: share of an item's words under tiles from which it counts as found;
    block_chars: of benchmark text that is sent to executors at a time."""

    min_match: int = 5
    first_search: int = 20
    min_coverage: float = 0.5
    block_chars: int = 4_000_000


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _rolling(ids: list[int], s: int) -> Iterator[tuple[int, int]]:
    """(start, Karp-Rabin hash) of each window of s ids."""
    if len(ids) < s:
        return
    top, h = pow(BASE, s - 1, MODULUS), 0
    for x in ids[:s]:
        h = (h * BASE + x) % MODULUS
    yield 0, h
    for i in range(s, len(ids)):
        h = ((h - ids[i - s] * top) * BASE + ids[i]) % MODULUS
        yield i - s + 1, h


def _runs(marked: np.ndarray) -> Iterator[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[1], marked.astype(np.int8), [1]])))
    yield from zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)


def tiles(text: list[int], item: list[int], min_match: int, first_search: int) -> list[tuple[int, int, int]]:
    """(text start, item start, length) of the tiles of item and text by running Karp-Rabin greedy string tiling."""
    tm, im = np.zeros(len(text), dtype=bool), np.zeros(len(item), dtype=bool)
    out, s = [], max(min_match, first_search)
    while True:
        table: dict[int, list[int]] = defaultdict(list)
        for a, b in _runs(tm):
            for i, h in _rolling(text[a:b], s):
                table[h].append(a + i)
        found, longest = defaultdict(list), 0
        for a, b in _runs(im):
            for i, h in _rolling(item[a:b], s):
                p = a + i
                for t in table.get(h, ()):
                    n = 0
                    while p + n < b and t + n < len(text) and not tm[t + n] and text[t + n] == item[p + n]:
                        n += 1
                    if n >= s:
                        found[n].append((p, t))
                        longest = max(longest, n)
            if longest > 2 * s:
                break
        if longest > 2 * s:
            s = longest
            continue
        for n in range(longest, s - 1, -1):
            # what an earlier tile has cut short waits in the list of the length that is left of it
            for p, t in sorted(found.pop(n, ()), key=lambda x: x[::-1]):
                free = 0
                while free < n and not im[p + free] and not tm[t + free]:
                    free += 1
                if free == n:
                    im[p : p + n] = tm[t : t + n] = True
                    out.append((t, p, n))
                elif free >= s:
                    found[free].append((p, t))
        if s <= min_match:
            return out
        s = max(min_match, s // 2) if s > 2 * min_match else min_match


@dataclass
class Block:
    """Part of a benchmark, ready for lookups: numbers of its words, ids of its items, and their seeds."""

    ids: list[int]
    items: list[list[int]]
    number: dict[str, int] = field(default_factory=dict)
    seeds: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    short: dict[tuple[str, ...], list[int]] = field(default_factory=dict)  # ids of items of fewer words than a seed
    sorted_seeds: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))

    @classmethod
    def of(cls, rows: list[tuple[int, str]], params: Params) -> Block:
        out = cls([], [])
        for item_id, text in rows:
            w = words(text)
            if len(w) >= params.min_match:
                out.ids.append(item_id)
                out.items.append([out.number.setdefault(x, len(out.number) + 1) for x in w])
            elif w:
                out.short.setdefault(tuple(w), []).append(item_id)
        seeds = defaultdict(list)
        for k, item in enumerate(out.items):
            for j, h in enumerate(_seed_hashes(np.array(item, dtype=np.uint64), params.min_match).tolist()):
                seeds[h].append((k, j))
        out.seeds, out.sorted_seeds = dict(seeds), np.array(sorted(seeds), dtype=np.uint64)
        return out


def _seed_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(max(0, len(ids) - n + 1), dtype=np.uint64)
    for k in range(n):
        h = (h ^ ids[k : k + len(h)]) * MIX
        h ^= h >> np.uint64(29)
    return h


def search(text: str | None, block: Block, params: Params) -> list[tuple[int, float, int, int, list[tuple[int, int, int]]]]:
    """The items of block that the whole text holds; the result's fields are those of FOUND."""
    w, n = words(text), params.min_match
    if len(w) < n:
        return [(i, 1.0, 1, len(w), [(0, 0, len(w))]) for i in sorted(block.short.get(tuple(w), ()))]
    if not len(block.sorted_seeds):
        return []
    ids = np.fromiter(map(block.number.get, w, (0,) * len(w)), dtype=np.uint64, count=len(w))
    gaps = np.concatenate([[0], np.cumsum(ids == 0)])
    starts = np.flatnonzero(gaps[n:] == gaps[:-n])
    if not len(starts):
        return []
    h = _seed_hashes(ids, n)[starts]
    at = np.minimum(np.searchsorted(block.sorted_seeds, h), len(block.sorted_seeds) - 1)
    hit = block.sorted_seeds[at] == h
    by_item: dict[int, set[int]] = defaultdict(set)
    for p, x in zip(starts[hit].tolist(), h[hit].tolist(), strict=True):
        for k, _ in block.seeds[x]:
            by_item[k].add(p)
    out = []
    for k, hits in by_item.items():
        # only words under seeds can be under tiles; runs of them are kept apart by numbers that no word has
        cover = np.zeros(len(w) + 1, dtype=np.int64)
        at = np.fromiter(hits, np.int64, len(hits))
        np.add.at(cover, at, 1)
        np.add.at(cover, at + n, -1)
        place, line = [], []
        inside = np.flatnonzero(np.cumsum(cover)[:-1] > 0).tolist()
        for a, b in zip([-2, *inside], inside, strict=False):
            if b != a + 1:
                place.append(-1)
                line.append(-len(line) - 1)
            place.append(b)
            line.append(int(ids[b]))
        found = [(place[t], p, m) for t, p, m in tiles(line, block.items[k], n, params.first_search)]
        share = sum(m for _, _, m in found) / len(block.items[k])
        if share >= params.min_coverage:
            out.append((block.ids[k], share, len(found), max(m for _, _, m in found), sorted(found)))
    return sorted(out)


def blocks(benchmark: DataFrame, params: Params = Params()) -> Iterator[Block]:
    """The benchmark's items, a bounded block at a time. Null ids and null texts are left out."""
    held, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).where("i is not null and t is not null").toLocalIterator():
        held.append((r["i"], r["t"]))
        size += len(r["t"])
        if size >= params.block_chars:
            yield Block.of(held, params)
            held, size = [], 0
    if held:
        yield Block.of(held, params)


def found_in(block: Block, text: Column, docs: DataFrame, params: Params = Params()) -> Column:
    """Items of a block that a text column holds, an array of structs; empty for null texts."""
    sent = docs.sparkSession.sparkContext.broadcast(block)

    @F.pandas_udf(FOUND)
    def tiled(texts: pd.Series) -> pd.Series:
        names = "item_id", "coverage", "n_tiles", "longest", "tiles"
        tile = "doc_start", "item_start", "n"
        return pd.Series([[dict(zip(names, (*x[:4], [dict(zip(tile, y, strict=True)) for y in x[4]]), strict=True)) for x in search(t, sent.value, params)] for t in texts], dtype=object)

    return tiled(text)


def contaminated(docs: DataFrame, benchmark: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest, tiles) for each document and benchmark item found in it.

    Null and empty texts hold nothing, nor does an empty benchmark; repeated rows and null doc_ids give rows of
    their own; items of one item_id are looked for one by one. Columns of docs but doc_id and text aren't read.
    """
    ship(docs.sparkSession)
    out = None
    for block in blocks(benchmark, params):
        x = docs.select(F.col("doc_id"), F.explode(found_in(block, F.col("text"), docs, params)).alias("x")).select("doc_id", "x.*")
        out = x if out is None else out.unionByName(x)
    if out is None:
        out = docs.select("doc_id", F.explode(F.lit(None).cast(FOUND)).alias("x")).select("doc_id", "x.*")
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, params: Params = Params()) -> DataFrame:
    """The rows of docs that hold no benchmark item, columns unchanged. Null and empty texts hold none and stay, repeated
    rows and rows without doc_id are told one by one, and an empty benchmark keeps all rows of docs."""
    ship(docs.sparkSession)
    for block in blocks(benchmark, params):
        (x,) = fresh(docs, "n_items")
        docs = docs.withColumn(x, F.size(found_in(block, F.col("text"), docs, params))).where(F.col(x) == 0).drop(x)
    return docs
