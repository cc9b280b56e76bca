import math
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from veilwright import dims
from veilwright.functions import text as T
from veilwright.functions import udfs


def one(spark, col, **values):
    kinds = {str: "string", int: "int", float: "double", type(None): "string", bool: "boolean"}
    ddl = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else kinds[type(v)]}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], ddl).select(col.alias("r")).collect()[0].r


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (T.normalize, " a  \n b\t", "a b"), (T.normalize, None, ""), (T.normalize_repr, None, "None"), (T.strip, "  a b\x1c", "a b"),
        (T.plain, "Ünïque — Büro 7!", "n que b ro 7"), (T.plain, None, ""), (T.for_match, " A\nB ", "a b"), (T.fact_key, " The 3-D  Thing ", "the 3 d thing"),
        (T.slug, "__A b/c__", "a_b_c"), (T.slug, "!!", "run"), (T.sample_slug, " a/B.c-d ", "a_B.c-d"), (T.sample_slug, "//", "sample"), (T.file_prefix, None, "nobranch"),
        (T.attribute_key, " 9-lives & more lives here ", "A_9_LIVES_MORE_L"), (T.attribute_key, "--", ""), (T.confidence_rank, " Very  HIGH", 5), (T.confidence_rank, "so so", 0),
        (T.confidence_weight, "medium", 0.6), (T.certainty, "about 7 of 9", 5), (T.certainty, "0", 1), (T.certainty, None, 1), (T.without_thoughts, "<think>a\nb</think>\n x ", "x"),
        (T.without_thoughts, " x ", " x "), (T.label, "Place-of Birth!", "placeofbirth"), (T.max_tokens_for, "Org/QWEN-3", 81920), (T.max_tokens_for, None, 6000),
    ],
)
def test_scalars(spark, f, given, want):
    assert one(spark, f(F.col("c")), c=given) == want


def test_certainty_of_a_long_number(spark):
    assert one(spark, T.certainty(F.col("c")), c="99999999999999") == 1


@pytest.mark.parametrize(("raw", "want"), [("why\n# text\n# more", "text\n# more"), ("# text", "text"), ("text", "text"), ("why\n#\n", "why\n#"), (" ", "old"), (None, "old"), ("#", "#")])
def test_rewritten_part(spark, raw, want):
    assert one(spark, T.rewritten_part(F.col("c"), F.lit("old")), c=raw) == want


def test_truncate(spark):
    assert one(spark, T.truncate(F.col("c"), 30), c=" " + "a" * 30) == "a" * 30
    assert one(spark, T.truncate(F.col("c"), 30), c="a" * 10 + "  " + "b" * 30) == "a" * 10 + "\n...[truncated]"


def severity(spark, span, text):
    s, t = T.plain(F.col("s")), T.plain(F.col("t"))
    w = T.long_words(s, dims.LEAK_WORD, dims.LEAK_STOP)
    return one(spark, T.leak_severity(s, F.contains(t, s), F.size(w), T.overlap_share(w, F.array_distinct(T.words(t)))), s=span, t=text)


def test_leak_tiers(spark):
    five = "gardening microscope telescope volunteer orchestra"
    assert severity(spark, "My Age", "the manager: my agency") == 3
    assert severity(spark, "gardening microscope telescope volunteer", "volunteer with telescope, microscope; gardening") == 2
    assert severity(spark, five, "orchestra volunteer telescope") == 1
    assert severity(spark, five, "orchestra volunteer") == 0
    assert severity(spark, "gardening microscope telescope", "telescope microscope gardening") == 0
    assert severity(spark, "—!", "—!") == 0


def test_quotes(spark):
    q = lambda quote: one(spark, T.quote_supported(F.col("t"), F.col("q")), t="He said: I  went\nhome today", q=quote)
    assert q('"i went home"') and q("I went home") and not q("I went") and not q("") and not q("never said that")


def test_core_words(spark):
    core = lambda s: set(one(spark, T.core_words(F.col("c")), c=s))
    assert core("Publishes self-published books and stories") == {"self", "book", "story"}
    assert core("Self-published novels of the glass class") == {"novel", "glass", "class"}
    assert core("uses AI tools for the reviews") == {"review"}
    assert core("of the") == set() == core(None)


def test_overlap(spark):
    over = lambda a, b: one(spark, T.words_overlap(F.col("a"), F.col("b")), a=a, b=b)
    assert over(["x", "y"], ["y"]) and over(["y"], ["x", "y"]) and not over(["x"], ["y"]) and not over([], ["y"]) and not over(["x", "y"], ["y", "z"])


@pytest.mark.parametrize(
    ("attribute", "fact", "want"),
    [
        ("OCCP", "works on maps of towns of old", ["works on maps", "works on towns of old"]), ("OCCP", "works on maps", ["works on maps"]), ("OCCP", "uses AI tools for a, b and c", ["uses AI tools for a", "uses AI tools for b", "uses AI tools for c"]),
        ("LOC", "works on maps of towns", ["works on maps of towns"]), ("OCCP", " ", []), ("OCCP", "uses AI tools for ", ["uses AI tools for"]),
    ],
)
def test_expand(spark, attribute, fact, want):
    assert one(spark, T.expand_fact(F.col("a"), F.col("f")), a=attribute, f=fact) == want


def test_rounding_is_half_up_on_ratios(spark):
    assert one(spark, F.round(F.lit(1) / F.lit(16), 3)) == 0.063


def test_fill_in_order(spark):
    masks = F.array(F.struct(F.lit("MASK_1").alias("key"), F.lit("x [MASK_2]").alias("v")), F.struct(F.lit("MASK_2").alias("key"), F.lit("y").alias("v")))
    assert one(spark, T.fill(F.lit("[MASK_1] [MASK_10] [MASK_3]"), masks, "v")) == "x y [MASK_10] [MASK_3]"
    assert one(spark, T.residual_masks(F.lit("[MASK_1] [MASK_x] [MASK_22]"))) == 2


def test_merge_maps(spark):
    sql = "map('a', map('x', '1', 'y', '2'), 'b', map('z', '3'))", "map('a', map('y', '9'), 'c', map('w', '4'))"
    got = one(spark, T.merge_maps(F.expr(sql[0]), F.expr(sql[1])))
    assert got == {"a": {"x": "1", "y": "9"}, "b": {"z": "3"}, "c": {"w": "4"}}


def test_hash_depends_on_names_and_nulls(spark):
    h = lambda **k: one(spark, T.content_hash(**k))
    assert h(a=F.lit("x"), b=F.lit("y")) == h(b=F.lit("y"), a=F.lit("x")) != h(a=F.lit("y"), b=F.lit("x"))
    assert h(a=F.lit(None).cast("string")) != h(a=F.lit(""))


@pytest.mark.parametrize(
    ("raw", "want"),
    [('{"a": 1}', '{"a": 1}'), ('say {"a": "}"} end', '{"a": "}"}'), ('<think>{"b": 2}</think> {"a": [1]}', '{"a": [1]}'), ("so [1, 2] it is", "[1, 2]"), ('{"a": ', "{}"), (None, "{}"), ("", "{}"), ('x {"a": "\\"}"}', '{"a": "\\"}"}')],
)
def test_recover_json(raw, want):
    assert udfs.recover_json(raw) == want


@pytest.mark.parametrize(("raw", "want"), [('```json\n{"a": 1}\n```', '{"a": 1}'), ('{bad {"a": 1} {"b": 2}', '{"a": 1}'), ("[1]", None), ("", None), (None, None)])
def test_fenced_object(raw, want):
    assert udfs.fenced_object(raw) == want


def test_attribute_of():
    assert [udfs.attribute_of(x) for x in ("AGE", "Sex", "gender", "marital-status", "ocupation", "birth plce", "zzz", "", None)] == ["AGE", "SEX", "SEX", "REL", "OCCP", "POBP", None, None, None]


def test_parse_answer():
    got = udfs.parse_answer("Type: gender\nInference: maybe\nGuess: Male; Female; ; X; Y\nCertainty: 9\nnoise\n\nType: Locaton\nInferrence: a: b\nmore\nCertainty: none")
    assert got["SEX"] == {"type": "Sex", "inference": "maybe", "guess": ["Male", "Female", "X"], "certainty": 5}
    assert got["LOC"]["inference"] == "a: b\nmore" and got["LOC"]["certainty"] == 1
    assert got["AGE"] == {"type": "Age", "inference": "MISSING", "guess": [], "certainty": 1} and len(got) == 8
    assert len(udfs.parse_answer(None)) == 8
    colons = udfs.parse_answer("Type: age:\nGuess: x:\nInference:\nmore: of it::\nCertainty: 3:\nInference:: y")
    assert colons["AGE"] == {"type": "Age", "inference": ": y", "guess": ["x", "Inference"], "certainty": 3}


def test_diff_cases():
    keys = lambda a, b, **k: [(m["original"], m["seed"]) for m in udfs.diff(a, b, **k)["masks"]]
    assert keys("a b c", "a b c") == [] and keys("", "") == [] and keys("a b", "a x b") == []
    assert keys("a b c", "a X c") == [("b", "X")] and keys("a b c d e", "a e") == [("b c d", "")]
    assert keys("a b c d e f", "a X c d Y f") == [("b c d e", "X c d Y")]
    assert keys("a b c d e f g", "a X c d e Y g") == [("b", "X"), ("f", "Y")]
    assert udfs.diff("a b", "x y", most=1)["skipped"] and udfs.diff(None, "x")["template"] == ""


def test_diff_round_trip():
    rng = random.Random(0)
    for _ in range(200):
        a = "".join(rng.choice(["é", "b ", "c\n", " d", " e "]) for _ in range(60))
        b = " ".join(w if rng.random() < 0.8 else rng.choice(["X", ""]) for w in a.split())
        m = udfs.diff(a, b)
        t = m["template"]
        for x in reversed(m["masks"]):
            assert a[x["start"] : x["end"]] == x["original"]
            t = t.replace(f"[{x['key']}]", x["original"])
        assert t == a


def test_ratio(spark):
    assert math.isclose(one(spark, udfs.seq_ratio(F.lit("Relation"), F.lit("relations"))), SequenceMatcher(None, "relation", "relations").ratio())


def test_long_texts_are_compared():
    words = [f"w{i % 700}" if i % 3 else f"only{i}" for i in range(6000)]
    other = list(words)
    for i in range(50, 6000, 400):
        other[i] = "thing"
    got = udfs.diff(" ".join(words), " ".join(other), most=None)
    assert not got["skipped"] and [m["original"] for m in got["masks"]] == [words[i] for i in range(50, 6000, 400)]
    same = ["a", "b"] * 2000
    assert [x[:2] for x in udfs.edits(same, [*same[:1000], "x", *same[1001:]], 2)] == [(1000, 1001)]
    assert list(udfs.differing(words, other, plain=10)) == list(udfs.differing(words, other, plain=10**6))


def test_labels_are_compared_once_and_like_the_matcher(monkeypatch):
    """labels repeat, so they are compared once, and never with labels that can't be the most similar."""
    names = ["gendr", "Locaton", "ocupation", "x", "type", "birth plce", "agee", "incme", "zzzzzzzz"]
    for x in names:
        scored = max((SequenceMatcher(None, udfs.bare(x), y).ratio(), -i, k) for i, (k, y) in enumerate(udfs.LABELS))
        assert udfs.attribute_of(x) == (scored[2] if scored[0] >= 0.62 else None)
    made = []

    class Counted(SequenceMatcher):
        def __init__(self, *a, **k):
            made.append(1)
            super().__init__(*a, **k)

    answer = "Type: gendr:\nInferrence: {}\nGuess: a; b\nCertainty: 2\n\nType: Locaton\nInference: at: {}"
    udfs.parse_answer(answer)
    monkeypatch.setattr(udfs, "SequenceMatcher", Counted)
    got = [udfs.parse_answer(answer.format(i, i)) for i in range(50)]
    assert not made and got[7]["SEX"]["inference"] == "7" and got[7]["LOC"]["inference"] == "at: 7"


def test_blocks_are_the_matchers():
    """the blocks that are listed once are those that the sequence matcher searches again and again."""
    r = random.Random(5)
    for n in range(300):
        size = r.choice([30, 60, 200])
        a = [str(r.randrange(r.choice([3, 9, 60]) if size < 100 else 60)) for _ in range(size)]
        b = list(a) if n % 3 else [str(r.randrange(60)) for _ in a]
        for _ in range(size // 6):
            b[r.randrange(size)] = "thing"
        x, y = sorted((r.randrange(size), r.randrange(size)))
        b = b[x:y] + b if n % 2 else b
        want, merged = [tuple(m) for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()[:-1]], []
        for i, j, k in udfs.blocks(a, b):
            if merged and merged[-1][0] + merged[-1][2] == i and merged[-1][1] + merged[-1][2] == j:
                i, j, k = merged[-1][0], merged[-1][1], merged.pop()[2] + k
            merged.append((i, j, k))
        assert merged == want
