import json
import os
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilwright import dims
from veilwright.functions import text as T
from veilwright.functions import udfs
from veilwright.plans import models, workflows
from veilwright.streaming import resume


class Counting(models.RuleBackend):
    def answer(self, stage, model, system, user):
        if "BROKEN" in user:
            raise ValueError("broken")
        return super().answer(stage, model, system, user)


def reqs(spark, texts, stage="attack"):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")
    return models.requests(df, stage, "m", F.col("id"), F.col("text"))


def test_replay_and_errors(spark):
    r = reqs(spark, ["a 123456789", "BROKEN", "b"])
    assert r.select("cache_key").distinct().count() == 3 and r.columns[0] == "cache_key"
    got, new = models.answered(r, Counting())
    rows = {x.doc_key: x for x in got.collect()}
    assert rows["1"].error == "ValueError: broken" and rows["1"].raw is None and json.loads(rows["0"].raw)["LOC"]["certainty"] == 5
    recorded = spark.createDataFrame([tuple(x) for x in new.collect()], models.RESPONSE)
    again, asked = models.answered(r, models.ReplayBackend(), recorded)
    assert asked.count() == 1 and {x.doc_key for x in again.where("raw is not null").collect()} == {"0", "2"}
    assert again.where("doc_key = '1'").collect()[0].error.startswith("LookupError")
    assert sorted(x.hit for x in models.replayed(r, recorded.limit(0)).collect()) == [False] * 3
    other = models.requests(spark.createDataFrame([("0", "a 123456789")], "id string, text string"), "attack", "m", F.col("id"), F.col("text"), version="2")
    assert other.join(r, "cache_key").isEmpty()


def test_parsed(spark):
    df = spark.createDataFrame([('{"a": 1}',), ('x {"a": 2} y',), (None,), ("none",)], "raw string")
    assert [r.answer and r.answer.a for r in models.parsed(df, "a int").collect()] == [1, 2, None, None]
    trace = spark.createDataFrame([(["hm", '{"identifier_candidates": [{"a": 1}]}', '{"identifier_candidates": []}'],), (["{}"],)], "t array<string>")
    assert [r.c for r in trace.select(models.first_candidates(F.col("t")).alias("c")).collect()] == ['[{"a":1}]', "[]"]


def test_anonymize(spark):
    docs = spark.createDataFrame([("d1", "write to ann@example.org or 10.0.0.1 please"), ("d2", "nothing to hide"), ("d3", "BROKEN text 123456789")], "document_id string, text string")
    documents, iterations = workflows.anonymize(docs, Counting(), workflows.Options(rounds=2, variations=3))
    got = {r.document_id: r for r in documents.collect()}
    assert got["d1"].status == "success" and got["d1"].final_text == "write to a detail please" and got["d1"].was_masked
    assert got["d2"].final_text == "nothing to hide" and not got["d2"].was_masked and got["d2"].final_privacy_score == dims.MISSING_SCORE
    assert got["d3"].status == "failed" and got["d3"].final_text is None
    its = {r.document_id: r for r in iterations.collect()}
    assert its["d1"].template_text == "write to [MASK_1] please" and len(its["d1"].variations) == 3 and its["d1"].best_variation_idx == 0


class Counted(models.RuleBackend):
    """Writes a file for each call."""

    def __init__(self, folder):
        self.folder = folder

    def answer(self, stage, model, system, user):
        open(f"{self.folder}/{stage}-{uuid.uuid4().hex}", "w").close()
        return super().answer(stage, model, system, user)


def test_each_request_is_asked_once(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", f"write {i} to ann{i}@example.org please") for i in range(4)], "document_id string, text string")
    documents, iterations = workflows.anonymize(docs, Counted(str(tmp_path)), workflows.Options(rounds=2, variations=2))
    assert documents.count() == iterations.count() == 4 and documents.where("final_text like '%ann%'").isEmpty()
    calls = Counter(x.split("-")[0] for x in os.listdir(tmp_path))
    once, twice = ("privacy_inference", "topic_focus", "utility_summary", "fingerprints"), ("round_inference", "rewrite", "refill", "attack", "compare", "specificity", "keeper")
    assert calls == {x: 4 for x in once} | {x: 8 for x in twice}


class Street(models.RuleBackend):
    """Rewrites a street, which it doesn't list as evidence."""

    def answer(self, stage, model, system, user):
        if stage == "rewrite":
            return "#" + user.rpartition(f"{models.TEXT}\n")[2].replace("14 Elm Street", "a street")
        return super().answer(stage, model, system, user)


def test_long_transcripts_are_masked(spark):
    words = " ".join(f"word{i % 700}" for i in range(3000))
    docs = spark.createDataFrame([("long", f"{words} I live at 14 Elm Street now. {words}"), ("short", "at 14 Elm Street")], "document_id string, text string")
    o = workflows.Options(rounds=1, variations=1)
    got = {r.document_id: r for r in workflows.anonymize(docs, Street(), o)[0].collect()}
    assert all(r.was_masked and r.status == "success" and "Elm" not in r.final_text for r in got.values())
    assert got["long"].final_text.startswith(words) and got["long"].final_text.endswith(words)
    got = {r.document_id: r for r in workflows.anonymize(docs, Street(), workflows.Options(rounds=1, variations=1, most_tokens=100))[0].collect()}
    assert got["long"].status == "failed" and got["long"].final_text is None and got["short"].status == "success"


class Pets(models.RuleBackend):
    """Finds a pet where a request asks for it."""

    def answer(self, stage, model, system, user):
        context, _, text = user.rpartition(f"{models.TEXT}\n")
        if stage == "expand_attributes":
            return json.dumps({"attributes": [{"key": "pet", "display_name": "Pet", "target_str": "pets", "options": ["cat", "dog"], "note": "any animal"}]})
        if stage in ("privacy_inference", "attack"):
            found = [x for x in ("my dog Rex", "10.0.0.1") if x in text]
            said = {"inference": "", "guesses": [], "certainty": "5", "evidence_spans": found}
            return json.dumps({k: said for k in ("PET", "LOC") if f"{k} = " in context})
        if stage == "rewrite":
            return "#" + (text.replace("my dog Rex", "an animal") if "PET = Pet: pets. One of: cat; dog. any animal" in context else text)
        return super().answer(stage, model, system, user)


def test_scopes_act(spark):
    docs = spark.createDataFrame([("d1", "I walk my dog Rex by 10.0.0.1 daily"), ("d2", "nothing here")], "document_id string, text string")
    cand = spark.createDataFrame([("d1", [(["Ann"], "the mayor", "high", "m", "n")])], "document_id string, candidates array<struct<interviewee_candidates:array<string>,identity_label:string,confidence:string,matches_description:string,mismatches_description:string>>")
    small = {"rounds": 1, "variations": 1}

    def run(o):
        documents, _, scopes = workflows.expanded(docs, cand, Pets(), o)
        found = {r.document_id: r for r in documents.collect()}["d1"]
        return found, [a.key for a in found.scope]

    base, keys = run(workflows.Options(scope=workflows.Scope.BASE_ONLY, **small))
    assert "PET" not in keys and len(keys) == 8 and base.evidence_spans == ["my dog Rex", "10.0.0.1"] and base.fingerprints == ["10.0.0.1"]
    wide, keys = run(workflows.Options(**small))
    assert keys[-1] == "PET" and len(keys) == 9 and "Rex" not in wide.final_text
    pure, keys = run(workflows.pure_adaptive(**small))
    assert keys == ["PET"] and pure.evidence_spans == ["my dog Rex", "10.0.0.1"] and "Rex" not in pure.final_text
    with pytest.raises(ValueError):
        workflows.anonymize(docs, Pets(), workflows.pure_adaptive(**small))


def test_backends_and_prompts(spark):
    models.register("pets", Pets)
    assert isinstance(models.backend("pets"), Pets) and isinstance(models.backend("replay"), models.ReplayBackend)
    with pytest.raises(ValueError):
        models.backend("none")
    raw = 'so {"primary_topic": " maps ", "preserve_focus": ["a", " "], "secondary_context": null} ok'
    df = spark.createDataFrame([("text", raw, {"AGE": ("old", [], "4", [])}), ("t", "no", None)], f"text string, raw string, inf {workflows.INFERENCES}")
    df = models.parsed(df, workflows.TOPIC, out="t")
    got = df.select(models.prompt(F.col("text"), T.topic_text(F.col("t"))).alias("p"), models.prompt(F.col("text"), F.lit(None).cast("string")).alias("q"), T.inference_text(F.col("inf")).alias("i")).collect()
    assert got[0].p == f"Topic: maps\nKeep: a\n{models.TEXT}\ntext" and got[0].q == "text" and got[0].i == "AGE: old (certainty 4)"
    assert got[1].p == f"Topic: unknown\n{models.TEXT}\nt"
    objects = ['{"a": 1}', 'x {"a": {"b": "}"}} y', '{"a": 1} and {"b": 2}', "[1]", None]
    assert [udfs.outer_object(x) for x in objects] == ['{"a": 1}', '{"a": {"b": "}"}}', "{}", "{}", "{}"]
    assert [udfs.recover_json(x) for x in objects[2:]] == ['{"a": 1}', "[1]", "{}"]
    answers = spark.createDataFrame([(x,) for x in objects], "raw string")
    assert [r.j and r.j.a for r in models.parsed(answers, "a string", out="j", stage="judge_fact").collect()] == ["1", '{"b":"}"}', None, None, None]


class NoRefill(models.RuleBackend):
    def answer(self, stage, model, system, user):
        if stage == "refill":
            raise ValueError("no")
        return super().answer(stage, model, system, user)


def test_a_failed_refill_never_brings_the_words_back(spark):
    docs = spark.createDataFrame([("d1", "write to ann@example.org please")], "document_id string, text string")
    documents, _ = workflows.anonymize(docs, NoRefill(), workflows.Options(rounds=1, variations=1))
    assert documents.collect()[0].final_text == "write to a contact please"


class Facts(models.RuleBackend):
    def answer(self, stage, model, system, user):
        if stage == "extract_facts":
            return json.dumps({"OCCP": [{"fact": "works on maps of towns", "supporting_candidates": ["1"]}, {"fact": "works on maps"}], "ZZ": []} if "mayor" in user else {"AGE": [{"fact": "old", "supporting_candidates": [1, 7]}]})
        if stage == "attribute_summary":
            return json.dumps({"supported": "AGE" in user, "summary_description": "is old", "evidence_quote": "very old indeed"})
        if stage == "summary_facts":
            return json.dumps({"facts": ["is old", "is very old", "Is old."]})
        if stage == "expand_attributes":
            return json.dumps({"attributes": [{"key": "pet", "display_name": "Pet", "target_str": "pets"}, {"key": "age", "display_name": "x", "target_str": "y"}]})
        return super().answer(stage, model, system, user)


def test_reid_compare(spark):
    c = lambda label: [{"interviewee_candidates": ["Ann"], "identity_label": label, "confidence": "High"}]
    ddl = "transcript_id string, label string, identifier_candidates array<struct<interviewee_candidates:array<string>,identity_label:string,confidence:string>>"
    rows = [("s1", "original", c("the mayor")), ("s1", "masked", c("someone")), ("s2", "original", c("x"))]
    df = spark.createDataFrame([(a, b, [tuple(x.values()) for x in y]) for a, b, y in rows], ddl)
    out = workflows.reid_compare(df, "original", Facts())
    assert [tuple(r) for r in out["missing"].collect()] == [("s2", "masked")]
    assert {(r.label, r.attribute_key, r.fact) for r in out["facts"].collect()} >= {("masked", "AGE", "old")}
    totals = {r.label: r.total_atomic_facts for r in out["totals"].collect()}
    assert set(totals) == {"original", "masked"}
    assert "== preservation" in (said := workflows.report(out)) and "average_total_ratio" in said and "masked" in said
    p = {r.label: r for r in out["preservation"].collect()}
    assert p["original"].average_total_ratio == 1.0 and p["masked"].sample_count == 1


def test_reference_profiles_and_recoverability(spark):
    texts = spark.createDataFrame([("s1", "I am very old indeed."), ("s2", "hello")], "transcript_id string, text string")
    facts = workflows.reference_profiles(texts, Facts())
    got = [(r.transcript_id, r.fact_id, r.fact) for r in facts.collect()]
    assert got and {g[0] for g in got} == {"s1", "s2"} and all(g[1].startswith("AGE_") for g in got)
    configs = texts.withColumn("config", F.lit("original")).unionByName(spark.createDataFrame([("s1", "x", "masked"), ("s2", "", "masked")], "transcript_id string, text string, config string"))
    f = spark.createDataFrame([("s1", "AGE_01", "AGE", "very old indeed"), ("s2", "AGE_01", "AGE", "nothing said of this")], "transcript_id string, fact_id string, attribute_key string, fact string")
    out = workflows.profile_recoverability(f, configs, Facts())
    by = {r.config: r for r in out["by_config"].collect()}
    assert (by["original"].total, by["original"].yes_count, by["masked"].total, by["masked"].yes_count) == (2, 1, 1, 0)
    ddl = "transcript_id string, facts array<struct<category_id:string,category_label:string,code_id:string,code_label:string,code_definition:string,inclusion_criteria:string,exclusion_criteria:string,excerpt:string,fact:string>>"
    coded = spark.createDataFrame([("s1", [("", "c", " k1 ", "Old", "d", "", "", "", "very old indeed"), ("x", "c", None, "Old", "d", "", "", "", "no such thing")])], ddl)
    out = workflows.code_fact_recoverability(coded, configs, Facts())
    assert {(r.code_id, r.overall_total, r.overall_yes_count) for r in out["by_code"].collect()} == {("k1", 2, 1), ("UNKNOWN", 2, 0)}


def test_scopes_and_feedback(spark):
    docs = spark.createDataFrame([("d1", "text")], "document_id string, text string")
    cand = spark.createDataFrame([("d1", [(["Ann"], "the mayor", "high", "m", "n")])], "document_id string, candidates array<struct<interviewee_candidates:array<string>,identity_label:string,confidence:string,matches_description:string,mismatches_description:string>>")
    got = workflows.dynamic_scopes(docs, cand, Facts()).collect()[0]
    assert [x.key for x in got.found] == ["PET"] and len(got.scope) == 9
    assert workflows.dynamic_scopes(docs, cand, Facts(), workflows.Options(scope=workflows.Scope.BASE_ONLY)).collect()[0].found == []
    assert [x.key for x in workflows.dynamic_scopes(docs, cand, Facts(), workflows.pure_adaptive()).collect()[0].scope] == ["PET", "AGE"]
    scopes = workflows.dynamic_scopes(docs, cand, Facts(), workflows.Options(scope=workflows.Scope.BASE_ONLY)).select("document_id", "scope")
    final = spark.createDataFrame([("d1", "old"), ("d2", "keep")], "document_id string, final_text string")
    out = workflows.feedback(final, lambda d: cand, scopes, Facts(), workflows.Options(feedback_rounds=3), lambda d, s: d.withColumn("final_text", F.lit("new")))
    assert sorted(map(tuple, out.collect())) == [("d1", "new"), ("d2", "keep")]


def test_stream_answers_each_request_once(spark, tmp_path):
    where = [f"file://{tmp_path}/{x}" for x in ("requests", "responses", "checkpoint")]
    for texts in (["a", "b"], ["b", "c 123456789"]):
        reqs(spark, texts).write.mode("append").parquet(where[0])
        q = resume.answer_stream(spark, *where, models.RuleBackend())
        assert q.awaitTermination(120)
    got = resume.responses(spark, where[1])
    assert got.count() == got.select("cache_key").distinct().count() == 4


def test_status_stream(spark, tmp_path):
    docs = spark.sql("select timestamp'2024-01-01 00:01:00' + make_interval(0,0,0,0,0,i) as at, if(i % 3 = 0, 'failed', 'success') as status from (select explode(sequence(0, 11)) i)")
    docs.write.parquet(f"{tmp_path}/docs")
    stream = resume.status_stream(spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/docs"), "at")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("statuses").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {(r.window.start.minute, r.status): r["count"] for r in spark.table("statuses").collect()}
    assert got == {(0, "failed"): 2, (0, "success"): 2, (5, "failed"): 1, (5, "success"): 4, (10, "failed"): 1, (10, "success"): 2}


def test_health():
    assert models.health(None, models.RuleBackend(), "m") == "{}"


class ManyAtOnce:
    """Answers facts of a text together; writes a file for each text that it reads."""

    def __init__(self, folder):
        self.folder = folder

    def answer(self, stage, model, system, user):
        raise ValueError("one by one")

    def answer_many(self, stage, model, system, contexts, text):
        open(f"{self.folder}/{uuid.uuid4().hex}", "w").close()
        return models.RuleBackend().answer_many(stage, model, system, contexts, text)


def test_a_text_is_read_once_for_all_its_facts(spark, tmp_path):
    """40 facts of a text are asked with one text, long texts in a few pieces, and like one by one."""
    texts = spark.createDataFrame([("a", "s1", "Fact number 1 and fact number 3. " + "x" * 70_000), ("a", "s2", "nothing"), ("b", "s1", "fact number 22")], "config string, transcript_id string, text string")
    facts = spark.createDataFrame([(s, f"AGE_{i}", "AGE", f"fact number {i}") for s in ("s1", "s2") for i in range(40)], "transcript_id string, fact_id string, attribute_key string, fact string")
    got = {b: {(r.transcript_id, r.config, r.item_id): (r.decision, r.evidence_quote, r.error) for r in workflows.profile_recoverability(facts, texts, backend)["items"].collect()} for b, backend in (("many", ManyAtOnce(str(tmp_path))), ("one", Counting()))}
    assert got["many"] == got["one"] and len(got["one"]) == 120
    assert sum(x[0] == dims.DECISIONS["yes"] for x in got["one"].values()) == 4
    assert len(os.listdir(tmp_path)) == 4
    items = facts.withColumnRenamed("fact_id", "item_id").crossJoin(spark.sql("select 'a' as config"))
    one = workflows.judged(items, texts, "judge_fact", models.RuleBackend())
    key = models.key_about("judge_fact", "rules", F.concat_ws("#", "transcript_id", "config", "item_id"), F.col("fact"), F.sha2("text", 256))
    recorded = items.join(texts, ["config", "transcript_id"]).select(key.alias("cache_key"), F.lit('{"decision": "No, it cannot be recovered"}').alias("raw"), F.lit(None).cast("string").alias("error"))
    again = workflows.judged(items, texts, "judge_fact", models.ReplayBackend(), responses=recorded)
    assert one.count() == again.count() == 80 and again.where("error is not null").isEmpty()
    assert workflows.judged(items, texts, "judge_fact", models.ReplayBackend()).where("error like 'LookupError%'").count() == 80


def test_only_broken_answers_are_recovered(spark):
    """F16: an answer that parses isn't read again in Python."""
    df = models.parsed(spark.createDataFrame([('{"a": 1}',), ('x {"a": 2} y',)], "raw string"), "a int")
    assert "json_recover(CASE WHEN isnull(" in df._jdf.queryExecution().optimizedPlan().toString()
    assert [r.answer.a for r in df.collect()] == [1, 2]
