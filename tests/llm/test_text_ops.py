"""Language ID, packing, decontamination, licenses: against plain versions, round trips and held-out accuracy."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilwright.llm import decontam, langid, licenses, packing

DOCS = "doc_id long, text string, lang string, source string, Score string, lang_pred int, found string, x string"
WORDS = {"en": "the and of that with this house river water stone".split(), "de": "der und das nicht schön über straße wasser stein haus".split(), "fr": "le et que être où façade rivière pierre maison eau".split()}


def table(spark, rows):
    return spark.createDataFrame([(d, t, lang, None, "s", 1, "f", "x") for d, t, lang in rows], DOCS)


def corpus():
    rng = random.Random(1)
    return [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.choice([3, 20, 200]))), lang) for i, lang in enumerate(rng.choice(list(WORDS)) for _ in range(300))]


def test_language_accuracy_and_odd_rows(spark):
    rows = corpus() + [(900, None, "en"), (901, "", "de"), (902, "12 .. 3", "fr"), (903, "wasser " * 30_000, None), (None, "the water", None), (904, "漢字仮名交文章" * 20, None), (0, "the the", "en")]
    docs = table(spark, rows)
    got = langid.identify(docs, docs.where(~langid.held_out()))
    assert [c for c in got.columns if c not in docs.columns] == ["score", "accepted"]
    out = {r.doc_id: r for r in got.withColumn("held", langid.held_out()).collect()}
    held = [r for i, r in out.items() if i is not None and i < 300 and r.held]
    assert held and sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(r.accepted for i, r in out.items() if i is not None and i < 300)
    assert [out[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and not any(out[i].accepted for i in (900, 901, 902))
    assert out[903].lang_pred == "de" and out[None].lang_pred == "en" and not out[904].accepted
    assert all(0 <= r.score <= 1 for r in out.values())


def test_language_without_labels(spark):
    docs = table(spark, [(1, "the water", None)])
    assert langid.identify(docs, docs).collect()[0].lang_pred == "und"
    assert langid.identify(docs.limit(0), docs.limit(0)).collect() == []
    assert langid.keep_accepted(docs.limit(0), docs).collect() == []


def test_long_texts_of_unlearned_scripts_are_rejected(spark):
    rng = random.Random(11)
    learned = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    cyrillic, chinese, base64 = (lambda n, a=a, b=b: "".join(chr(rng.randrange(a, b)) for _ in range(n)) for a, b in ((0x430, 0x450), (0x4E00, 0x9FA0), (0x41, 0x5B)))
    rows = [" ".join(cyrillic(rng.randrange(2, 10)) for _ in range(n)) for n in (20, 100, 500, 5000)]
    rows += [chinese(n) for n in (100, 500, 5000, 25_000)]
    rows += ["".join(rng.choice((x, x.lower(), "7")) for x in base64(n)) for n in (400, 4000, 40_000)]
    odd = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    train = learned.where(~langid.held_out())
    got = {r.doc_id: r for r in langid.identify(odd, train).collect()}
    assert [i for i in got if got[i].accepted] == [], [(i, r.score) for i, r in sorted(got.items())]
    found = langid.identify(learned.where(langid.held_out() & F.col("text").rlike("[A-Za-z]")), train)
    assert found.where("not accepted").count() == 0 and found.where("lang_pred = lang").count() > 0.97 * found.count()


def test_counts_match_a_plain_version():
    at, n = langid.counts("Ab, c1d")
    assert n.sum() == 4 + 7 + 6  # ^ab^c^d^: letters, pairs, triples
    assert len(langid.counts("42")[0]) == 0 == len(langid.counts(None)[0])


@pytest.mark.parametrize("most", [1, 7, 64])
def test_best_fit_decreasing(most):
    rng = np.random.default_rng(most)
    lengths = rng.integers(1, most + 1, 300)
    rows = packing.best_fit_decreasing(lengths, most)
    assert sorted(i for r in rows for i in r) == list(range(300))
    assert all(lengths[r].sum() <= most for r in rows)
    free, want = [], 0  # the plain rule: into the fullest row that still has room
    for n in sorted(lengths.tolist(), reverse=True):
        fits = [i for i, f in enumerate(free) if f >= n]
        if fits:
            i = min(fits, key=lambda i: free[i])
            free[i] -= n
        else:
            free.append(most - n)
            want += 1
    assert len(rows) == want


def plain_grams(text):
    """Hashes of the runs of one to three letters, words bounded by one blank, one by one."""
    letters = [c if c.isalpha() else "\0" for c in text.lower()]
    line = [c for i, c in enumerate(["\0", *letters, "\0"]) if c != "\0" or i == 0 or ["\0", *letters, "\0"][i - 1] != "\0"]
    if not any(c != "\0" for c in line):
        return Counter()
    out, m, at = Counter(), 2**64, 0x110001
    for n in (1, 2, 3):
        for i in range(len(line) - n + 1):
            if n > 1 or line[i] != "\0":
                h = 0
                for c in line[i : i + n]:
                    h = (h * at + ord(c)) % m
                out[(h * 4 + n) % m * 0x9E3779B97F4A7C15 % m >> 64 - langid.SEEN_BITS] += 1
    return out


def plain_nearest(text, rows, model):
    """Language and cosine by dictionaries: TF-IDF from the rows that were learned, and the model's centroids."""
    seen, n = set(), Counter()
    for r in rows:
        grams = plain_grams(r)
        seen |= set(grams)
        n.update({x >> langid.SEEN_BITS - langid.BITS for x in grams})
    idf = lambda bucket: math.log((1 + len(rows)) / (1 + n[bucket])) + 1
    tf, new = Counter(), Counter()
    for gram, k in plain_grams(text).items():
        (tf if gram in seen else new)[gram >> langid.SEEN_BITS - langid.BITS] += k
    w = {b: (1 + math.log(k)) * idf(b) for b, k in tf.items()}
    unseen = math.log(1 + len(rows)) + 1
    norm = math.sqrt(sum(x * x for x in w.values()) + sum((unseen * (1 + math.log(k))) ** 2 for k in new.values()))
    scores = [sum(x * float(model.centroids[b, j]) for b, x in w.items()) / norm for j in range(len(model.of))]
    best = max(range(len(scores)), key=scores.__getitem__)
    return model.labels[model.of[best]], scores[best]


def test_language_against_plain_tf_idf(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(3, 60))), lang) for i, lang in enumerate(sorted(WORDS) * 12)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.labels == tuple(sorted(WORDS)) and len(model.of) > len(WORDS)
    texts = [t for _, t, _ in rows[:8]] + ["Ünd so, 3 w1", "zzz qqq", "a", "x-y  z\n\nq", " ".join(t for _, t, _ in rows)]
    for t in texts:
        assert Counter(langid._slots(t).tolist()) == plain_grams(t)
        lang, score, _ = langid.classify(t, model)
        want, plain = plain_nearest(t, [t for _, t, _ in rows], model)
        assert abs(score - min(1, max(0, plain))) < 1e-5 and (lang == want or abs(score - plain) < 1e-6)


def test_other_tongues_in_the_same_script_are_rejected(spark):
    """Long texts in letters that the sample knows, but put together as no language of it does."""
    rng = random.Random(13)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(20, 400))), lang) for i, lang in enumerate(sorted(WORDS) * 40)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    for n in (300, 3000):
        for _ in range(5):
            text = " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randrange(3, 9))) for _ in range(n))
            assert not langid.classify(text, model)[2]
    own = [langid.classify(r.text, model) for r in docs.collect()]
    assert sum(x[2] for x in own) >= 0.99 * len(own)


def test_every_label_is_learned_and_none_crowds_out_others(spark):
    rows = [(i, f"common words here number{i % 7}", "big") for i in range(3000)] + [(7, f"again and again {i}", "big") for i in range(3000)]
    rows += [(9000 + i, f"{'abcdefghijklmnopqrstuvwxyz'[i % 26] * 3} {'abcdefghijklmnopqrstuvwxyz'[i // 26] * 4} tongue", f"rare{i:03}") for i in range(260)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), langid.Params(per_language=20))
    assert set(model.labels) == {"big", *(f"rare{i:03}" for i in range(260))}


def test_pack_round_trip(spark):
    rng = random.Random(2)
    texts = ["", None, "a", "two  blanks", " lead", "tail ", "line\n\nbreak x\r\n y", "né " * 50, " ".join(rng.choice(WORDS["fr"]) for _ in range(9000)), "x" * 5000, "it's 3.5 <|endoftext|>"]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(None, "no id", None), (2, "a", None)]
    p = packing.Params(seq_len=128, block_tokens=4000)
    packs = packing.pack(table(spark, rows), params=p)
    got, ids = packs.collect(), {}
    assert len({r.pack_id for r in got}) == len(got)
    for r in got:
        x, pos = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(x) == len(pos) == 128 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 128
        for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]):
            assert pos[a:b].tolist() == list(range(b - a))
        assert not pos[r.n_tokens :].any() and set(x[r.n_tokens :].tolist()) <= {p.end_id}
    for r in packing.unpack(packs, p).orderBy("doc_id", "start").collect():
        ids.setdefault(r.doc_id, []).append((r.start, r.ids))
    ranks = {__import__("base64").b64decode(a): int(b) for a, b in map(bytes.split, open(packing.TOKENIZER, "rb"))}
    import tiktoken

    plain = tiktoken.Encoding("t", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, t in enumerate(texts):
        whole = np.frombuffer(b"".join(x for _, x in sorted(set(ids[i]))), "<u2").tolist()
        assert whole == [*plain.encode_ordinary(t or ""), p.end_id]
        assert plain.decode(whole[:-1]) == (t or "")
    assert packing.pack(table(spark, []), params=p).collect() == []


def plain_tiles(a, b, least):
    """Greedy string tiling by its definition: the longest unmarked matches first."""
    ma, mb, out = [0] * len(a), [0] * len(b), []
    while True:
        best = []
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not ma[i + n] and not mb[j + n]:
                    n += 1
                best.append((n, i, j))
        n = max((x[0] for x in best), default=0)
        if n < least:
            return out
        for m, i, j in best:
            if m == n and not any(ma[i : i + n]) and not any(mb[j : j + n]):
                ma[i : i + n] = mb[j : j + n] = [1] * n
                out.append((i, j, n))


def test_tiles_cover_what_greedy_tiling_covers():
    rng = random.Random(4)
    for k in range(600):
        item = [rng.randrange((3, 30, 6, 12)[k % 4]) for _ in range(40)]
        parts = [item[i : i + 8] for i in range(0, 40, 8)]
        rng.shuffle(parts)
        text = [x for p in parts for x in [*p, 99 - k % 3]]
        got, want = decontam.tiles(text, item, 4, 20), plain_tiles(text, item, 4)
        for t, p, n in got:
            assert text[t : t + n] == item[p : p + n] and n >= 4
        used = [p + i for _, p, n in got for i in range(n)]
        assert len(used) == len(set(used))
        assert sorted(got) == sorted(want)


def test_decontamination(spark):
    rng = random.Random(6)
    items = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(30))) for i in range(20)] + [(50, None), (51, "too short here"), (None, "w1 w2 w3 w4 w5 w6")]
    bench = spark.createDataFrame([(*x, "doc") for x in items], "item_id long, text string, doc_id string")
    noise = lambda n: " ".join(f"n{rng.randrange(900)}" for _ in range(n))
    w = items[3][1].split()
    shuffled = " ".join([*w[20:], noise(4), *w[10:20], noise(3), *w[:10]])
    rows = [
        (0, noise(50), None), (1, f"{noise(300)} {items[0][1]} {noise(40)}", None), (2, shuffled.upper(), None), (3, " ".join(w[:12]), None), (4, None, None), (5, "", None),
        (6, "too short here", None), (7, " ".join(f"{items[1][1]}. {noise(5)}" for _ in range(200)), None), (7, items[2][1], None), (None, items[4][1].replace(" ", ", "), None), (8, noise(40_000) + " " + items[5][1], None),
    ]
    docs = table(spark, rows)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.item_id) for r in decontam.contaminated(docs, bench).collect())
    # item 51 has fewer words than a seed: it is found where it is the whole text
    assert got == [(-1, 4), (1, 0), (2, 3), (6, 51), (7, 1), (7, 2), (8, 5)]
    small = decontam.Params(block_chars=200)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.item_id) for r in decontam.contaminated(docs, bench, small).collect()) == got
    kept = decontam.keep_clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 5]
    assert decontam.contaminated(docs, bench.limit(0)).collect() == [] and decontam.keep_clean(docs, bench.limit(0)).count() == len(rows)
    assert decontam.contaminated(docs.limit(0), bench).collect() == []


def test_patience_alignment():
    rng = random.Random(8)
    for _ in range(100):
        a = [rng.randrange(40) for _ in range(50)]
        b = [x for x in a if rng.random() < 0.9]
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    assert licenses.align(list("abcdef"), list("abcdef")) == [(i, i) for i in range(6)]
    assert licenses.align([], [1]) == []


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def test_patience_alignment_of_unique_words_is_the_longest():
    rng = random.Random(9)
    for _ in range(200):
        a, b = (rng.sample(range(60), rng.randrange(1, 50)) for _ in range(2))
        assert len(licenses.align(a, b)) == longest_common(a, b)


def test_edited_licenses_are_found_by_their_coverage(spark):
    """Every built-in wording with words left out and put in, against the longest common subsequence by all pairs."""
    rng, p = random.Random(10), licenses.Params()
    rows, want = [], []
    for i, (name, text) in enumerate(licenses.TEMPLATES):
        words = licenses.words(text)
        if len(words) < p.exact_words:
            continue
        for k, drop in enumerate((0.0, 0.05, 0.6)):
            kept = [w for w in words if rng.random() >= drop]
            edited = [y for w in kept for y in ((w, f"q{rng.randrange(99)}") if drop and rng.random() < 0.05 else (w,))]
            rows.append((100 * i + k, " ".join([*(f"n{j}" for j in range(50)), *edited, *(f"m{j}" for j in range(50))]), None))
            if longest_common(edited, words) >= p.min_coverage * len(words):
                want.append((100 * i + k, name))
    found = {(r.doc_id, r.license) for r in licenses.scan_licenses(table(spark, rows)).collect()}
    assert len(want) >= 2 * len(rows) / 3 - 1 and set(want) <= found
    assert {d for d, _ in found} == {d for d, _ in want}
    # an edited copy with a whole one right after it, and the other way round: both are told
    name, text = licenses.TEMPLATES[3 + 1]
    words = licenses.words(text)
    edited = [y for i, w in enumerate(words) for y in ((w, "qq") if i % 12 == 5 else (w,))]
    for both in (edited + words, words + edited):
        got = licenses.Scanner().scan(" ".join(["n"] * 30 + both + ["m"] * 30))
        assert [x[0] for x in got] == [name, name] and sum(x[4] for x in got) >= 1.9 * len(words)  # words that repeat may stay unaligned


def test_licenses(spark):
    mit, apache = licenses.TEMPLATES[2][1], licenses.TEMPLATES[3][1]
    noise = " ".join(f"n{i}" for i in range(200))
    rows = [
        (1, noise, None), (2, f"{noise}\n{apache}\n{noise}\n{apache}", None), (3, mit.upper().replace("software", "PROGRAM", 1), None), (4, None, None), (5, "", None), (6, "Licensed under", None),
        (7, "This work is licensed under the GNU General Public License, version 2.", None), (7, "Licensed under CC BY-NC 4.0.", None), (None, "Released under the MIT License.", None), (8, noise * 500 + " " + apache, None),
    ]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.license) for r in licenses.scan_licenses(table(spark, rows)).collect())
    assert got == [(-1, "MIT"), (2, "Apache-2.0"), (2, "Apache-2.0"), (3, "MIT"), (7, "CC-BY-NC-4.0"), (7, "GPL-2.0"), (8, "Apache-2.0")]
    assert licenses.scan_licenses(table(spark, [])).collect() == []
