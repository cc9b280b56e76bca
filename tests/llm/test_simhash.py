import random
import re

import numpy as np
import pytest
import xxhash

from veilwright.llm import golay, graph, setjoin, simhash
from veilwright.llm.runtime import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, component_id string, Key string"


def reference_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    """doc_id -> (fingerprint, component) by comparing all pairs."""
    fps = [reference_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    comp = {}
    for i, (d, _) in enumerate(rows):
        comp.setdefault(find(i), []).append(d)
    return sorted((d, fps[i], min((x for x in comp[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows) if d is not None)


def table(spark, rows):
    return spark.createDataFrame([(d, t, None, None, 0, 1, "x", "y") for d, t in rows], DOCS)


def text(rng, n):
    return " ".join(rng.choice(["alpha", "Beta", "gamma", "délta", "x", "of", "the", "run"]) + str(rng.randrange(40)) for _ in range(n))


def test_golay_keys_meet():
    rng = np.random.default_rng(3)
    u = rng.integers(0, 1 << 23, 500)
    for d in range(3):
        v = u.copy()
        for i in range(len(v)):
            for b in rng.choice(23, d, replace=False):
                v[i] ^= 1 << int(b)
        k, m = golay.near_codewords(u), golay.near_codewords(v)
        assert all(set(a) & set(b) for a, b in zip(k.tolist(), m.tolist()))
        if d < 2:
            assert all(b[0] in a and a[0] in b for a, b in zip(k.tolist(), m.tolist()))


@pytest.mark.parametrize("d", range(5))
def test_fingerprints_within_four_bits_share_a_key(d):
    rng = np.random.default_rng(d)
    f = rng.integers(-(2**63), 2**63 - 1, 1000, dtype=np.int64)
    g = f.view(np.uint64).copy()
    for i in range(len(g)):
        for b in rng.choice(64, d, replace=False):
            g[i] ^= np.uint64(1) << np.uint64(b)
    assert all(set(a) & set(b) for a, b in zip(simhash.keys(f).tolist(), simhash.keys(g.view(np.int64)).tolist()))


@pytest.mark.parametrize("words", [0, 1, 3, 4, 5, 300])
def test_fingerprint(words):
    t = text(random.Random(words), words)
    assert simhash.fingerprint(t.encode()) == reference_fingerprint(t)


def test_brute_force_with_odd_rows(spark):
    rng = random.Random(5)
    base = [text(rng, n) for n in (400, 400, 60, 30, 8, 3, 1)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(60):
        words = base[i % 2].split()
        words[rng.randrange(len(words))] = f"new{i}"
        rows.append((100 + i, " ".join(words)))
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, base[2]), (203, base[2]), (204, base[0].upper()), (205, text(rng, 20_000)), (206, "É É É É"), (None, base[3]), (-7, base[5])]
    got = simhash.near_duplicates(table(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in got if r.doc_id is not None) == brute(rows)
    assert [r.component_id for r in got if r.doc_id is None] == [3]


def test_chains_are_joined(spark):
    rng = np.random.default_rng(1)
    chain = [int(rng.integers(0, 2**62))]
    for _ in range(150):
        x = chain[-1]
        for b in rng.choice(64, 4, replace=False):
            x ^= 1 << int(b)
        chain.append(x)
    far = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 200, dtype=np.int64)]
    values = sorted({int(np.array(x, dtype=np.uint64).view(np.int64)) for x in chain} | set(far))
    labels = dict(simhash.fingerprint_labels(spark.createDataFrame([(v,) for v in values], "fp long"), Scratch(spark, "t")).collect())
    whole = {v: labels.get(v, v) for v in values}
    for a in values:
        for b in values:
            if ((a ^ b) % 2**64).bit_count() <= 4:
                assert whole[a] == whole[b]
    assert len({whole[int(np.array(x, dtype=np.uint64).view(np.int64))] for x in chain}) == 1
    assert len(set(whole.values())) >= 150


def test_empty_table(spark):
    assert simhash.near_duplicates(table(spark, [])).collect() == []
    assert simhash.keep_one(table(spark, [])).collect() == []


def test_keep_one(spark):
    t = " ".join(f"w{i}" for i in range(500))
    rows = [(9, t), (4, t + " more"), (4, t + " more"), (5, "other words here now"), (None, "nobody knows this text"), (None, "nobody knows this text"), (None, t)]
    kept = simhash.keep_one(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    assert sorted((r.doc_id or -1, len(r.text)) for r in kept.collect()) == [(-1, 22), (4, len(t) + 5), (5, 20)]


@pytest.mark.parametrize("found", [simhash.near_duplicates, setjoin.near_duplicates])
def test_keep_one_of_each_group_whatever_ids_repeat(spark, found):
    a, b = (" ".join(f"{c}{i}" for i in range(500)) for c in "ab")
    rows = [(1, a), (2, a), (2, b), (3, b + " more"), (2, a + " more"), (1, a), (None, b), (None, "unlike")]
    kept = sorted((r.doc_id or 0, r.text) for r in simhash.keep_one(table(spark, rows), found).collect())
    assert kept == [(0, "unlike"), (1, a), (2, b)]
    one_id = [t for _, t in rows]
    kept = [r.text for r in simhash.keep_one(table(spark, [(7, t) for t in one_id]), found).collect()]
    assert sorted(t[0] for t in kept) == ["a", "b", "u"]


@pytest.mark.parametrize("broadcast_edges", [0, 1000])
def test_components(spark, broadcast_edges):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (7, 200), (300, 301), (301, 300), (None, 5)]
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), broadcast_edges=broadcast_edges).collect())
    assert got == {i: 0 for i in [*range(1, 41), 200]} | {301: 300}
