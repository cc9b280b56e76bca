"""Sharding, line and substring dedup, mixing, top-k: against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from veilwright.llm import linededup, mixing, sharding, substring, topk

DOCS = "doc_id long, text string, source string, lang string, n_lines string, shard string, h1 string, key long, s long, cut string, start long, taken int"


def table(spark, rows):
    return spark.createDataFrame([(d, t, s, None, "n", "s", "h", 1, 2, "c", 3, 4) for d, t, s in rows], DOCS)


def rows_of(n=120, seed=0):
    rng = random.Random(seed)
    lines = [f"Line number {i} of the Text" for i in range(30)]
    out = [(i, "\n".join(rng.choice(lines + [f"own {i} {j} line here" for j in range(9)]) for _ in range(rng.randrange(1, 12))), f"s{rng.choice('aaabc')}") for i in range(n)]
    out += [(5000, None, None), (5001, "", "sa"), (5002, "\n\n", "sb"), (5003, " \t short \r\n\x0bline number 3 OF the text\f\nÉé ligne répétée", "sé"), (5004, "éÉ LIGNE\nÉé LIGNE répétée", "sc"), (None, "line number 4 of the text\nnobody", None), (7, out[7][1], out[7][2])]
    return out


BLANK = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def test_line_dedup(spark):
    rows = rows_of()
    seen = {}
    for d, t, _ in rows:
        for line in (t or "").split("\n"):
            if len(k := lower(line.strip(BLANK))) >= 10:
                seen.setdefault(k, set()).add(2**63 - 1 if d is None else d)
    want = Counter()
    for d, t, _ in rows:
        lines = (t or "").split("\n")
        own = 2**63 - 1 if d is None else d
        kept = [x for x in lines if not (len(k := lower(x.strip(BLANK))) >= 10 and len(seen[k]) > 1 and min(seen[k]) != own)]
        want[(d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())] += 1
    assert Counter(map(tuple, linededup.line_digest(table(spark, rows)).collect())) == want
    full = linededup.drop_repeated_lines(table(spark, rows))
    assert set(full.columns) == {*table(spark, []).columns, "n_dropped", "kept_text"} and full.count() == len(rows)
    assert linededup.line_digest(table(spark, [])).collect() == []


def test_line_dedup_of_very_many_lines(spark):
    lines = [f"own line number {i}" if i % 3 else "the line that all have" for i in range(50_000)]
    rows = [(1, "the line that all have", None), (2, "\n".join(lines), None)]
    got = {r.doc_id: r for r in linededup.line_digest(table(spark, rows)).collect()}
    kept = [x for x in lines if x.startswith("own")]
    assert (got[2].n_lines, got[2].n_dropped, got[2].kept_sha256) == (50_000, 50_000 - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())


def test_substring_dedup_of_many_null_ids(spark):
    rows = [(None, f"{' '.join(f'w{i}x{j}' for j in range(6))} a b c d e f", None) for i in range(2000)] + [(3, "a b c d e f", None)]
    assert Counter(map(tuple, substring.repeat_digest(table(spark, rows), 5).collect())) == Counter(plain_repeats(rows, 5))


def plain_repeats(rows, n):
    docs = [(2**63 - 1 if d is None else d, [w for w in "".join(" " if c in BLANK else c for c in (t or "")).split(" ") if w]) for d, t, _ in rows]
    first = {}
    for d, w in docs:
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            first[k] = min(first.get(k, d), d)
    for (d, w), (own, *_) in zip(docs, rows):
        gone = {j for i in range(len(w) - n + 1) if first[tuple(w[i : i + n])] < d for j in range(i, i + n)}
        yield own, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()


@pytest.mark.parametrize("n", [4, 10, 50])
def test_substring_dedup(spark, n):
    rng = random.Random(n)
    word = lambda: f"w{rng.randrange(4000)}é"
    passage = [[word() for _ in range(k)] for k in (n - 1, n, n + 1, 2 * n, 5 * n)]
    rows = []
    for i in range(80):
        w = [word() for _ in range(rng.randrange(0, 3 * n))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passage)
            at = rng.randrange(len(w) + 1)
            w[at:at] = p[rng.randrange(2) :]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(w), None))
    rows += [(200, None, None), (201, "", None), (202, " \n ", None), (203, rows[5][1], None), (204, rows[5][1] + "  ", None), (5, rows[5][1], None), (None, " ".join(passage[4]), None), (205, "same " * (4 * n), None), (206, "same " * (4 * n + 1), None), (207, " ".join(word() for _ in range(20_000)), None)]
    got = Counter(map(tuple, substring.repeat_digest(table(spark, rows), n).collect()))
    assert got == Counter(plain_repeats(rows, n))
    texts = Counter((r.doc_id, r.n_removed, hashlib.sha256(" ".join(r.kept_text.split()).encode()).hexdigest()) for r in substring.drop_repeats(table(spark, rows), n).collect())
    assert texts == Counter((d, r, h) for d, _, r, h in plain_repeats(rows, n))
    assert substring.repeat_digest(table(spark, []), n).collect() == []


def test_substring_dedup_moves_no_half_window_that_does_not_repeat(spark, monkeypatch):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(400)), None) for i in range(30)]
    shared = " ".join(f"both{j}" for j in range(60))
    rows += [(100 + i, f"a{i} {shared} b{i}", None) for i in range(2)]
    written, keep = {}, substring.Scratch.keep

    def kept(self, df, name="t"):
        out = keep(self, df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(substring.Scratch, "keep", kept)
    assert Counter(map(tuple, substring.repeat_digest(table(spark, rows), 50).collect())) == Counter(plain_repeats(rows, 50))
    assert written["whole"] == 2
    assert all(n <= len(rows) for name, n in written.items() if name not in ("windows", "before"))


def test_repeat_lengths_double_until_none_survives(spark):
    a = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(a), None), (2, " ".join(["x", *a[10:57], "y", *a[100:110]]), None), (3, " ".join(a[190:]), None), (None, " ".join(a[:12]), None), (5, None, None), (6, "z " * 100, None)]
    got = sorted((r.doc_id or -1, r.longest) for r in substring.repeat_lengths(table(spark, rows), 5).collect())
    assert got == [(-1, 10), (1, 40), (2, 40), (3, 10)]
    assert substring.repeat_lengths(table(spark, []), 5).collect() == []


def test_rows_of_one_id_with_other_texts(spark):
    rows = [(1, "a b c d e f", None), (1, "z a b c d e", None), (2, "a b c d e q", None)]
    assert Counter(map(tuple, substring.repeat_digest(table(spark, rows), 4).collect())) == Counter(plain_repeats(rows, 4))


def test_sharding(spark):
    rows = rows_of(1500)
    got = sharding.shard_report(table(spark, rows)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    places, size = {}, Counter()
    for r in got:
        places.setdefault(r.shard, []).append(r.slot)
        size[r.shard] += r.size
    assert all(sorted(x) == list(range(len(x))) for x in places.values())
    assert set(places) == set(range(16)) and max(size.values()) - min(size.values()) <= 0.02 * max(size.values())
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    again = sharding.shard_report(table(spark, rows[::-1]).repartition(7)).collect()
    assert Counter((r.doc_id, r.size, r.shard) for r in again) == Counter((r.doc_id, r.size, r.shard) for r in got)
    whole = sharding.shard_documents(table(spark, rows))
    assert whole.columns == [*[c for c in table(spark, []).columns if c != "shard"], "virtual_slot", "shard"]
    assert Counter((r.doc_id, r.shard) for r in whole.collect()) == Counter((r.doc_id, r.shard) for r in got)
    assert sharding.shard_report(table(spark, [])).collect() == []


def test_rebalancing_edits_the_map(spark, tmp_path):
    rng = random.Random(1)
    sizes = [rng.randrange(1000) for _ in range(512)]
    old = sharding.balanced(sizes, 8)
    grown = sharding.grown(sizes, old, 9)
    assert all(a == b or b == 8 for a, b in zip(old, grown))
    total = Counter()
    for s, n in zip(grown, sizes):
        total[s] += n
    assert max(total.values()) - min(total.values()) <= 0.03 * sum(sizes) / 9
    fewer = sharding.rebalanced(sizes, old, 7)
    assert set(fewer) == set(range(7)) and sum(a != b for a, b in zip(old, fewer) if a < 7) <= 8
    path = f"file://{tmp_path}/map"
    sharding.store_map(spark, path, old, 1)
    sharding.store_map(spark, path, grown, 2)
    assert sharding.load_map(spark, path) == (2, grown) and sharding.load_map(spark, path, 1) == (1, old)


def test_documents_follow_the_stored_map(spark, tmp_path):
    rows = [(i, f"text {i} " * (1 + i % 5), None) for i in range(3000)] + [(9000 + i, "the same text", None) for i in range(800)]
    docs, path = table(spark, rows), f"file://{tmp_path}/map"
    shard = lambda n: {r.doc_id: (r.virtual_slot, r.shard) for r in sharding.shard_documents(docs, n, path=path).collect()}
    first, again, more = shard(4), shard(4), shard(5)
    assert first == again and sharding.load_map(spark, path)[0] == 2
    moved = {d for d in first if first[d] != more[d]}
    assert moved and all(more[d] == (first[d][0], 4) for d in moved) and len(moved) < 0.3 * len(rows)
    (_, old), (_, new) = sharding.load_map(spark, path, 1), sharding.load_map(spark, path, 2)
    assert {first[d][0] for d in moved} <= {i for i, (a, b) in enumerate(zip(old, new)) if a != b}
    assert len({first[9000 + i][1] for i in range(800)}) == 4  # equal texts don't share a shard
    assert {r.map_version for r in sharding.shard_report(docs, 5, path=path).collect()} == {2}


def water(sizes, share=1.5, weights=(5, 2, 1), cap=2):
    """Targets by the rule: share by weight, stop at the cap, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, rest = {}, share * sum(sizes.values())
    while open_ := [s for s in names if s not in out]:
        level = rest / sum(w[s] for s in open_)
        full = [s for s in open_ if level * w[s] >= cap * sizes[s]]
        if not full:
            return out | {s: level * w[s] for s in open_}
        for s in full:
            out[s] = cap * sizes[s]
            rest -= out[s]
    return out


def test_mixing(spark):
    rows = [(d, t, s) for d, t, s in rows_of(900)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 900, 3)] + [(3, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = mixing.mix_report(table(spark, rows), labels).collect()
    words = lambda t: len([w for w in "".join(" " if c in BLANK else c for c in (t or "")).split(" ") if w])
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, words(t)) for d, t, _ in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += words(t)
    want, by = water(sizes), {}
    source = {}
    for d, t, s in rows:
        source.setdefault((d, words(t)), s)
    taken = Counter()
    for r in got:
        s = source[(r.doc_id, r.size)]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * want[s]
        assert r.taken <= 2 * r.size and r.taken % max(1, r.size) == 0
        taken[s] += r.taken
        by.setdefault(s, set()).add(r.taken // r.size if r.size else None)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(40, 0.02 * want[s])
        assert len(by[s] - {None}) <= 2  # complete epochs, and the part of one more
    again = mixing.mix_report(table(spark, rows[::-1]).repartition(5), labels).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    for given in (labels, None):
        mixed = Counter(r.doc_id for r in mixing.mix(table(spark, rows), given).select("doc_id").collect())
        times = Counter()
        for r in mixing.mix_report(table(spark, rows), given).collect():
            times[r.doc_id] += r.times
        assert mixed == +times
    assert mixing.mix_report(table(spark, []), labels).collect() == [] == mixing.mix(table(spark, []), None).collect()


def test_good_documents_come_more_often(spark):
    rows = [(i, "a b c d", "only") for i in range(3000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(3000)], "doc_id long, quality int")
    got = mixing.mix_report(table(spark, rows), labels).collect()
    good, bad = (sum(r.times for r in got if r.doc_id % 2 == q) for q in (1, 0))
    assert good > 1.15 * bad and abs(sum(r.taken for r in got) - 1.5 * 12000) <= 4


def plain_top(vectors, every, k):
    ints = {}
    for i, v in vectors:
        if v is not None and None not in v and all(np.isfinite(v)):
            ints[i] = [int(np.floor(256 * float(x))) for x in v]
    for q in sorted(i for i in ints if i % every == 0):
        best = sorted((-sum(a * b for a, b in zip(ints[q], c)), i) for i, c in ints.items() if i != q)[:k]
        yield from ((q, n, i, -s) for n, (s, i) in enumerate(best, 1))


@pytest.mark.parametrize("params", [topk.Params(), topk.Params(pivots=3, sample=20, query_block=2, chunk=7)])
def test_top_k(spark, params):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    vectors = [(i, (centres[i % 6] + rng.normal(size=8) * 0.2).astype(np.float32).tolist()) for i in range(400)]
    vectors[10] = (10, vectors[0][1])
    vectors[11] = (11, vectors[0][1])
    vectors[20], vectors[21], vectors[22], vectors[23] = (20, None), (21, [None] * 8), (22, [float("nan")] * 8), (23, [float("inf")] + [0.0] * 7)
    vectors[50] = (50, [0.0] * 8)
    # other lengths, components of 8,192 and more, and scores beyond 53 bits
    vectors += [(900, [1.0]), (901, [9000.0, -3.0, *[0.5] * 9]), (902, [3e6] * 8), (950, [-4e6, 2e6]), (951, [1e4 + i for i in range(8)]), (1000, []), (1001, [16777216.0] * 8)]
    rows = [(*x, 1, "q") for x in vectors] + [(None, vectors[5][1], 0, "q")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, query_id string").repartition(5)
    assert sorted(map(tuple, topk.top_k(df, 50, 5, params).collect())) == sorted(plain_top(vectors, 50, 5))
    far = spark.createDataFrame([(0, [3e38, 1.0]), (1, [3e38, 2.0]), (2, [-3e38]), (3, [1e30]), (4, [-1e30])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.score) for r in topk.top_k(far, 50, 5, params).orderBy("rank").collect()] == [(1, 2**63 - 1), (3, 2**63 - 1), (4, -(2**63)), (2, -(2**63))]
    # norms beyond the doubles: nothing bounds these, and none may be left out; 256 * x of the last is beyond them itself
    huge = [(0, [1e160, 2.0]), (1, [1e170, 1.0]), (2, [-1e165, 0.5]), (3, [3.0, 4.0]), (4, [1e300, -1e300]), (5, [2e160, 1.0]), (50, [1.0, -1.0]), (51, [1e155, 0.0]), (52, [1e308, 0.0])]
    df_huge = spark.createDataFrame(huge, "vec_id long, embedding array<double>")
    got, want = topk.top_k(df_huge, 50, 5, params).collect(), plain_top(huge[:-1], 50, 5)
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == sorted((q, rank, v) for q, rank, v, _ in want)
    few = df.where("vec_id in (0, 1, 2)")
    assert sorted(map(tuple, topk.top_k(few, 50, 5, params).collect())) == sorted(plain_top(vectors[:3], 50, 5))
    assert topk.top_k(df.limit(0), 50, 5, params).collect() == []
