import pytest
from pyspark.sql import functions as F

from veilwright import dims
from veilwright.operators import attributes as A
from veilwright.operators import facts, leakage, masking, recover, selection


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_best_variation(spark):
    v = [("a", 0, 5, 1, 3), ("a", 1, 6, 0, 2), ("a", 2, 6, 0, 2), ("b", 0, 1, 1, 5), ("b", 1, 9, 9, 4), ("c", 0, None, None, None), ("c", 1, 998, None, 0)]
    df = spark.createDataFrame(v, "d string, idx int, severity int, loss int, too_specific int")
    assert rows(selection.best_variation(df, ["d"]), "d", "best_idx") == [("a", 1), ("b", 1), ("c", 1)]


def test_last_and_first_win(spark):
    df = spark.createDataFrame([("a", "1", 0), ("b", "2", 1), ("a", "3", 2)], "id string, text string, pos int")
    assert rows(selection.last_wins(df, F.col("id")), "id", "text", "pos") == [("a", "3", 0), ("b", "2", 1)]
    assert rows(selection.first_wins(df, F.col("id")), "id", "text", "pos") == [("a", "1", 0), ("b", "2", 1)]


def test_id_lists(spark):
    df = spark.createDataFrame([("A",), ("b",), ("c",)], "id string")
    assert rows(selection.by_id_list(df, "c, A,x,,c", "id"), "req_pos", "id") == [(0, "c"), (1, "A"), (4, "c")]
    assert rows(selection.missing_ids(df, "c, x", "id"), "req_id") == [("x",)]
    done = spark.createDataFrame([("a",), ("B",)], "id string")
    assert rows(selection.pending(df, done, "id"), "id") == [("c",)]
    assert rows(selection.pending(df, done, "id", spark.createDataFrame([("A",)], "id string")), "id") == [("A",), ("c",)]
    assert rows(selection.pending(df, done, "id", case_sensitive=True), "id") == [("A",), ("b",), ("c",)]


def test_pick_row(spark):
    df = spark.createDataFrame([("A", "long text", 0), ("b", "xx", 1), ("c", "yy", 2)], "transcript_id string, text string, pos int")
    assert [selection.pick_row(df, *a).collect()[0].transcript_id for a in ((), ("shortest",), ("first", "B"))] == ["A", "b", "b"]


CANDIDATE = "d string, pos int, interviewee_candidates array<string>, identity_label string, confidence string"


def test_candidates(spark):
    c = [("a", 0, ["Ann", " Ann "], "x", "Low"), ("a", 1, [], "", "high"), ("a", 2, ["B", "C"], "", "HIGH "), ("a", 3, ["B"], "y", "high"), ("a", 4, None, "z", None)]
    df = spark.createDataFrame(c, CANDIDATE)
    assert rows(selection.rank_candidates(df, ["d"]), "candidate_index", "pos") == [(1, 3), (2, 2), (3, 0), (4, 4)]
    assert rows(selection.rank_candidates(df, ["d"], 1), "pos") == [(3,)]
    misspelt = df.withColumnRenamed("interviewee_candidates", "interviewee_candiates")
    assert rows(selection.rank_candidates(misspelt, ["d"], 1), "pos") == [(3,)]


def test_reidentified(spark):
    c = [("a", 0, ["Unknown man"], "Anonymous", "very high"), ("a", 1, ["Ann"], "", "high"), ("a", 2, ["Bea"], "", "high"), ("b", 0, ["Cy"], "", "low"), ("c", 0, None, "the mayor", "medium"), ("d", 0, [], "likely non-public person", "high")]
    df = spark.createDataFrame(c, CANDIDATE)
    assert rows(selection.reidentified(df, ["d"]), "d", "pos") == [("a", 1), ("c", 0)]
    assert rows(selection.reidentified(df, ["d"], "low"), "d") == [("a",), ("b",), ("c",)]
    assert rows(selection.reidentified(df, ["d"], "whatever"), "d") == [("a",), ("c",)]


def test_evidence_spans(spark):
    inf = {"LOC": ("", [], "5", ["Rome ", "ab", "ROME", "Paris"]), "AGE": ("", [], "x", ["forty"]), "POBP": ("", [], "3", ["rome", "Oslo"]), "MORE": ("", [], "5", ["new"])}
    df = spark.createDataFrame([(1, inf), (2, {})], f"d int, i {leakage.INFERENCES}")
    assert [r.span for r in leakage.evidence_spans(df, "i").orderBy("pos").collect()] == ["Rome", "Paris", "Oslo"]
    assert [r.span for r in leakage.evidence_spans(df, "i", dedupe=False).orderBy("pos").collect()] == ["Rome", "ROME", "Paris", "rome", "Oslo"]
    assert [r.span for r in leakage.evidence_spans(df, "i", keys=F.array(F.lit("MORE"))).collect()] == ["new"]


def test_leak_totals(spark):
    spans = spark.createDataFrame([(1, "My age", 0), (1, "—", 1), (1, "nowhere", 2)], "d int, span string, pos int")
    texts = spark.createDataFrame([(1, "my age is"), (2, "x")], "d int, text string")
    got = {r.d: r for r in leakage.leak_totals(leakage.span_leakage(spans, texts, ["d"]), ["d"], texts).collect()}
    assert (got[1].source_span_count, got[1].num_span_leaks, got[1].total_span_severity) == (3, 1, 3)
    assert [(x.span, x.severity, x.reason) for x in got[1].leaks] == [("My age", 3, "exact_span_present")]
    assert (got[2].source_span_count, got[2].num_span_leaks) == (0, 0)


def test_backmap(spark):
    text = "first line\nthe orchestra of little gardens\n  orchestra gardens  \nlast (x) \\E"
    spans = [(1, "THE ORCHESTRA"), (1, "gardens orchestra nothing else"), (1, "orchestra"), (1, "(X) \\e"), (1, "zebra giraffe"), (1, "")]
    got = rows(leakage.backmap(spark.createDataFrame(spans, "d int, span string"), spark.createDataFrame([(1, text)], "d int, text string"), ["d"]), "span", "mapped")
    assert dict(got) == {"THE ORCHESTRA": "the orchestra", "gardens orchestra nothing else": "the orchestra of little gardens", "orchestra": "orchestra", "(X) \\e": "(x) \\E", "zebra giraffe": None, "": None}


def test_totals(spark):
    df = spark.createDataFrame([("7", ["1", "x", None], 3), ("bad", ["1", "2"], 3), (None, None, None)], "t string, a array<string>, s int")
    got = df.select(leakage.total_severity(F.col("t"), F.col("a"), F.col("s")).alias("x"), leakage.total_severity_strict(F.col("a"), F.col("s")).alias("y"), leakage.total_loss(F.col("t"), F.col("a")).alias("z")).collect()
    assert [tuple(r) for r in got] == [(7, 4, 7), (6, 6, 3), (0, 0, 0)]


def test_specificity(spark):
    ddl = "c string, d map<string,struct<too_specific:boolean,rationale:string,evidence_spans:array<string>>>"
    df = spark.createDataFrame([("1", {"OCCUPATION": (True, " r ", ["a ", " "]), "AI_USAGE": (True, None, None), "OTHER": (True, "", [])}), ("4", None), ("x", {})], ddl)
    got = leakage.specificity(df, "c", "d").collect()
    assert [r.too_specific_count for r in got] == [2, 4, 0]
    assert [x.dimension for x in got[0].dims] == list(dims.SPECIFICITY) and got[0].dims[0].rationale == "r" and got[0].dims[0].evidence_spans == ["a"]


def test_attribute_lists(spark):
    ddl = f"raw {A.LIST}"
    raw = [("job title", "Job ", "the job", ["Yes", "yes ", ""], " "), ("JOB_TITLE", "Other", "other", None, None), ("age", "x", "y", None, None), ("n", "Sex", "z", None, None), ("k", "kk", "occupation", None, None), ("", "a", "b", None, None), ("pet", "Pet", "pets", None, "note")]
    df = spark.createDataFrame([(raw,)], ddl).withColumn("c", A.coerce_all(F.col("raw")))
    base = A.base_list()
    r = df.select("c", A.scope(base, F.col("c")).alias("s"), A.added(base, F.col("c"), 0).alias("one"), A.added(base, F.col("c"), 5).alias("all"), A.capped(F.col("c"), base, 9).alias("cap"), A.capped(F.col("c"), base, 0).alias("none")).collect()[0]
    assert [x.key for x in r.c] == ["JOB_TITLE", "AGE", "N", "K", "PET"] and r.c[0].options == ["Yes"] and r.c[0].note is None
    assert [x.key for x in r.s][8:] == ["JOB_TITLE", "PET"] == [x.key for x in r.all]
    assert [x.key for x in r.one] == ["JOB_TITLE"] and len(r.cap) == 1 and r.none == []
    assert df.select(A.aliases(F.col("c")[0]).alias("a")).collect()[0].a == ["Job", "the job", "JOB_TITLE"]


def test_export_is_the_fold_over_all_documents(spark):
    a = lambda k, n, t: (k, n, t, None, None)
    docs = [("d2", [a("PET", "Pet", "pets"), a("CAR", "Car", "cars")]), ("d1", [a("X", "pet ", "other"), a("AGE", "q", "r")]), ("d3", [a("CAR", "Car", "cars"), a("Y", "y", "other"), a("Z", "z", "z")])]
    df = spark.createDataFrame(docs, f"d string, found {A.LIST}")
    r = A.export(df, "d", "found").collect()[0]
    assert [x.key for x in r.attributes][8:] == ["X", "CAR", "Z"] and (r.base_count, r.new_count, r.total_count) == (8, 3, 11)
    assert A.export(df.limit(0), "d", "found").collect()[0].new_count == 0
    assert rows(A.export_counts(df, "d", "found"), "d", "new_attributes") == [("d1", 2), ("d2", 2), ("d3", 3)]


FACT = "g string, fact string, pos long, supporting_candidates array<int>, source_fields array<string>, confidences array<string>, confidence_weight double"


def test_dedupe_is_greedy_and_not_transitive(spark):
    f = [
        ("g", "red house garden", 0, [2], ["a"], ["low"], 0.4), ("g", "house garden", 1, [1], ["b"], ["high"], 0.8), ("g", "garden pool", 2, [3], ["a"], [], 0.2), ("g", "garden", 3, [9], ["z"], [], 0.1), ("g", "of the", 4, [1], ["a"], [], 1.0), ("h", "garden", 0, [], [], [], 0.0),
    ]
    got = {(r.g, r.fact): r for r in facts.dedupe_overlapping(spark.createDataFrame(f, FACT), ["g"]).collect()}
    assert set(got) == {("g", "red house garden"), ("g", "garden pool"), ("g", "of the"), ("h", "garden")}
    top = got["g", "red house garden"]
    assert (top.n, top.supporting_candidates, top.source_fields, top.confidences, top.confidence_weight) == (3, [1, 2, 9], ["a", "b", "z"], ["high", "low"], 0.8)
    assert [x for x, _ in sorted(((k[1], r.rank) for k, r in got.items() if k[0] == "g"), key=lambda x: x[1])] == ["of the", "red house garden", "garden pool"]
    assert facts.dedupe_overlapping(spark.createDataFrame([], FACT), ["g"]).collect() == []


def test_overlap_pairs(spark):
    f = [("g", 0, "red house"), ("g", 1, "house"), ("g", 2, "Houses reds"), ("g", 3, "blue"), ("g", 4, "of"), ("h", 5, "house")]
    assert rows(facts.overlap_pairs(spark.createDataFrame(f, "g string, idx int, fact string"), ["g"]), "left_idx", "right_idx") == [(0, 1), (0, 2), (1, 2)]
    valid = spark.createDataFrame([(["red house", "house"],), (["red house", "house", "red"],), (["a b"],)], "f array<string>")
    assert [r.v for r in valid.select(facts.group_is_valid(F.col("f")).alias("v")).collect()] == [True, False, True]


def test_merge_groups(spark):
    p = [("t", "AGE_01", "AGE", "forty years", 0), ("t", "AGE_02", "AGE", "forty", 1), ("t", "LOC_01", "LOC", "Rome", 2), ("t", "LOC_02", "LOC", "old Rome", 3)]
    g = [("t", 0, ["AGE_01", "LOC_01"], "AGE", "no"), ("t", 1, ["AGE_02", "AGE_01", "AGE_01", "x"], "??", ""), ("t", 2, ["AGE_01", "LOC_02", "LOC_01"], "pobp", "Rome, old")]
    profile = spark.createDataFrame(p, "t string, fact_id string, attribute_key string, fact string, pos int")
    props = spark.createDataFrame(g, "t string, group_pos int, source_fact_ids array<string>, attribute_key string, fact string")
    got = {r.fact_id: (r.fact, r.fact_ids) for r in facts.merge_groups(profile, props, ["t"]).collect()}
    assert got == {"AGE_01": ("forty years", ["AGE_02", "AGE_01"]), "POBP_01": ("Rome, old", ["LOC_02", "LOC_01"])}
    alone = facts.merge_groups(profile, props.limit(0), ["t"]).collect()
    assert [r.fact_id for r in alone] == ["AGE_01", "AGE_02", "LOC_01", "LOC_02"] or sorted(r.fact_id for r in alone) == ["AGE_01", "AGE_02", "LOC_01", "LOC_02"]


def test_fact_fields(spark):
    df = spark.createDataFrame([(["2", "x", "1", "2", "9"], ["unified_description", "other"], ["low", "HIGH", "low", "?"])], "c array<string>, s array<string>, f array<string>")
    r = df.select(facts.candidate_indices(F.col("c"), F.array(F.lit(1), F.lit(2))).alias("c"), facts.source_fields(F.col("s")).alias("s"), facts.source_fields(F.array(F.lit("x"))).alias("d"), facts.confidences(F.col("f")).alias("f")).collect()[0]
    assert (r.c, r.s, r.d, r.f) == ([1, 2], ["unified_description"], ["unified_description"], ["high", "low", "?"])


def test_masks(spark):
    df = spark.createDataFrame([(1, "Ann of Rome, ANN of rome.", ["Ann", "Ann of Rome", "MASK", "x\\Ey", ""])], "d int, text string, spans array<string>")
    m = df.select(masking.mask_spans(F.col("text"), F.col("spans")).alias("m")).collect()[0].m
    assert m.template == "[[MASK_2]_1], [[MASK_2]_1]." and [x.original for x in m.masks] == ["Ann of Rome", "MASK"]
    both = spark.createDataFrame([(1, "a b c", "a X c", ["c"]), (2, "a b c", "a b c", ["b"]), (3, "a b", "a b", [])], "d int, o string, r string, spans array<string>")
    got = {r.d: r for r in masking.masked(both, "o", "r", "spans").collect()}
    assert [(got[i].template, got[i].was_masked) for i in (1, 2, 3)] == [("a [MASK_1] c", True), ("a [MASK_1] c", True), ("a b", False)]
    out = masking.masked(both, "o", "r", "spans").select("d", masking.unrefilled(F.col("template"), F.col("masks")).alias("u"), masking.restored(F.col("template"), F.col("masks")).alias("back")).collect()
    assert {r.d: (r.u, r.back) for r in out} == {1: ("a X c", "a b c"), 2: ("a [MASK_1] c", "a b c"), 3: ("a b", "a b")}


def test_decisions_and_rates(spark):
    y, n, u = dims.DECISIONS.values()
    df = spark.createDataFrame([(y, "I went home", "i went  home now"), (y, "short", "short"), (n, None, "x"), ("maybe", "i went home", "i went home"), (None, None, None)], "d string, q string, t string")
    assert [r.x for r in df.select(recover.decision(F.col("d"), F.col("q"), F.col("t")).alias("x")).collect()] == [y, u, n, u, u]
    items = [("c", "s1", "AGE", y, None), ("c", "s1", "AGE", n, None), ("c", "s2", "AGE", y, "timeout"), ("c", "s2", "ZZZ", y, None), ("d", "s1", "LOC", u, "")]
    df = spark.createDataFrame(items, "config string, sample string, attribute_key string, decision string, error string")
    by = {(r.config, r.attribute_key): r for r in recover.by_attribute(df, ["config"], dims.attributes(spark)).collect()}
    assert len(by) == 16 and (by["c", "AGE"].total, by["c", "AGE"].yes_count, by["c", "AGE"].error_count, by["c", "AGE"].recoverable_rate) == (3, 1, 1, 0.333)
    assert by["d", "AGE"].total == 0 and by["d", "AGE"].recoverable_rate is None
    o = {r.config: r for r in recover.overall(df, ["config"], "sample").collect()}
    assert (o["c"].total, o["c"].yes_count, o["c"].error_count, o["c"].sample_count, o["c"].recoverable_rate, o["c"].rate_excluding_errors) == (4, 1, 1, 2, 0.25, 0.333)
    assert o["d"].unsure_count == 1


def test_rewrites_are_complete(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "transcript_id string")
    docs = spark.createDataFrame([("a", "x", "success"), ("b", "y", "failed")], "transcript_id string, final_text string, status string")
    assert rows(selection.collected_rewrites(ids.limit(1), docs), "transcript_id", "final_text") == [("a", "x")]
    with pytest.raises(Exception, match="no rewrite of b"):
        selection.collected_rewrites(ids, docs).collect()


def test_leakage_moves_spans_and_texts_once(spark):
    """two exchanges, one of spans and one of texts; none of words. Repeated ids meet each of their texts."""
    spans = spark.createDataFrame([(1, 0, "wooden bridge crossing yonder"), (1, 1, "nothing"), (2, 0, "?!")], "d int, pos int, span string")
    texts = spark.createDataFrame([(1, "yonder bridge, wooden; crossing"), (1, "a wooden bridge crossing yonder."), (2, "x")], "d int, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = leakage.span_leakage(spans, texts, ["d"])
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 2
        got = sorted((r.d, r.pos, r.severity, r.token_overlap) for r in out.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == [(1, 0, 2, 1.0), (1, 0, 3, 1.0), (1, 1, 0, 0.0), (1, 1, 0, 0.0), (2, 0, 0, 0.0)]


def test_backmap_reads_the_span_once(spark):
    """a span's words aren't found anew for each line of the text."""
    spans = spark.createDataFrame([(1, "bridge wooden yonder")], "d int, span string")
    out = leakage.backmap(spans, spark.createDataFrame([(1, "other line\na wooden bridge here\nbridge")], "d int, text string"), ["d"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("lower(span") == 1
    assert rows(out, "mapped") == [("a wooden bridge here",)]


def test_equal_facts_are_one_set(spark):
    """F8: sets of words are compared, not their copies; all pairs of facts are there."""
    f = [("g", i, x) for i, x in enumerate(["red house", "houses red", "house", "blue door"] * 10)]
    out = facts.overlap_pairs(spark.createDataFrame(f, "g string, idx int, fact string"), ["g"])
    want = [(a, b) for a in range(40) for b in range(a + 1, 40) if (a % 4 == 3) == (b % 4 == 3)]
    assert sorted(rows(out, "left_idx", "right_idx")) == want
    assert "DEAL" in vars(facts) and "_d#" in out._jdf.queryExecution().optimizedPlan().toString()


def test_groups_are_folded_only_where_they_share_facts(spark):
    """other proposals are decided apart, by the same rule."""
    p = [("t", f"AGE_{i}", "AGE", x, i) for i, x in enumerate(["forty years", "forty", "of", "red house", "blue house", "house", "red", "red"])]
    g = [("t", 0, ["AGE_0", "AGE_1"], "sex", ""), ("t", 1, ["AGE_2"], None, "x"), ("t", 2, ["AGE_3", "AGE_4"], "", "no"), ("t", 3, ["AGE_5", "AGE_4"], "", "y"), ("t", 4, ["AGE_7", " AGE_6 ", "AGE_7", None], None, None)]
    out = facts.merge_groups(spark.createDataFrame(p, "t string, fact_id string, attribute_key string, fact string, pos int"), spark.createDataFrame(g, "t string, group_pos int, source_fact_ids array<string>, attribute_key string, fact string"), ["t"])
    got = sorted((r.sort_index, r.fact_ids, r.fact, r.attribute_key) for r in out.collect())
    assert got == [(0, ["AGE_0", "AGE_1"], "forty years", "SEX"), (2, ["AGE_2"], "x", "AGE"), (3, ["AGE_3"], "red house", "AGE"), (4, ["AGE_5", "AGE_4"], "y", "AGE"), (6, ["AGE_7", "AGE_6"], "red", "AGE")]
    assert "_contested" in out._jdf.queryExecution().optimizedPlan().toString()
