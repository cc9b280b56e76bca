import json

import pytest
from pyspark.sql import functions as F

from veilwright.sources import readers, sinks
from veilwright.sources.store import Store


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_jsonl(spark, tmp_path):
    lines = [{"conversation_id": " a ", "user_message": "one\r\n\r\ntwo "}, {"conversation_id": "b", "user_message": " "}, {"conversation_id": "c", "user_message": "x"}, {"conversation_id": "a", "user_message": "new"}, {"user_message": "y"}]
    path = write(tmp_path / "t.jsonl", "\n\n".join(map(json.dumps, lines)))
    got = readers.transcripts(spark, path).orderBy("pos").collect()
    assert [(r.transcript_id, r.text) for r in got] == [("a", "new"), ("c", "x")]
    assert [r.transcript_id for r in readers.transcript_rows(spark, path).orderBy("pos").collect()] == ["a", "c", "a"]
    with pytest.raises(Exception):
        readers.transcripts_as_written(spark, path).collect()
    plain = write(tmp_path / "p.jsonl", "\n".join(json.dumps(x) for x in lines[:1]))
    assert readers.transcripts_as_written(spark, plain).collect()[0].transcript_id == " a "
    with pytest.raises(ValueError):
        readers.transcript_rows(spark, write(tmp_path / "e.jsonl", "\n"))
    with pytest.raises(Exception):
        readers.transcripts(spark, write(tmp_path / "bad.jsonl", "{no json")).collect()


def test_csv_maps(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'Dataset_ID,rewritten_transcript,epsilon\nS1," say ""hi"",\n\nthere ",100\ns1,later,100\nS2,other,100.0\n,none,100\nS3,,100\n')
    got = readers.csv_map(spark, path, [("transcript_id", "text"), ("Dataset_ID", "rewritten_transcript")], "100").collect()
    assert [(r.transcript_id, r.text, r.pos) for r in got] == [("s1", "later", 0)]
    every = {r.transcript_id: r.text for r in readers.csv_map(spark, path, [("Dataset_ID", "rewritten_transcript")]).collect()}
    assert every == {"s1": "later", "s2": "other"}
    assert readers.csv_map(spark, path, [("x", "y")]).isEmpty() and readers.csv_map(spark, str(tmp_path / "none.csv"), [("x", "y")]).isEmpty() and readers.csv_map(spark, None, []).isEmpty()
    with pytest.raises(ValueError, match="lacks"):
        readers.rewrites(spark, path)
    ok = write(tmp_path / "b.csv", 'transcript_id,text\nA,"x\ny"\nb, z \n')
    assert sorted((r.transcript_id, r.text) for r in readers.rewrites(spark, ok).collect()) == [("A", "x\ny"), ("b", "z")]
    done = spark.createDataFrame([("a",), ("b",)], "transcript_id string")
    assert [r.transcript_id for r in readers.new_inputs(spark, ok, done, "transcript_id", "text").collect()] == ["A"]


def test_configs(spark, tmp_path):
    a = write(tmp_path / "o.csv", "transcript_id,text\ns1,one\ns2,two\n")
    b = write(tmp_path / "d.csv", "transcript_id,rewritten_text,epsilon\ns1,r1,10\ns1,r2,30\n")
    paths = {"dpmlm_eps_10": b, "original": a, "presidio": str(tmp_path / "none.csv")}
    got = readers.in_config_order(readers.config_sources(spark, paths)).select("config", "transcript_id", "text").collect()
    assert sorted(map(tuple, got[:2])) == [("original", "s1", "one"), ("original", "s2", "two")] and tuple(got[2]) == ("dpmlm_eps_10", "s1", "r1")
    for only in (["nobody"], ["presidio"]):
        with pytest.raises(ValueError):
            readers.config_sources(spark, paths, only)
    assert readers.config_sources(spark, {}).isEmpty()


def test_reid_rows(spark, tmp_path):
    rows = [{"transcript_id": " S1 ", "identifier_candidates": [{"interviewee_candiates": ["Ann"], "confidence": "High", "year": 2001}]}, {"transcript_id": "s2", "identifier_candidates": "none"}, {"transcript_id": "s1", "identifier_candidates": []}, {"x": 1}]
    for i, doc in enumerate((rows, {"results": rows}, {"data": rows}, {"rows": rows})):
        got = readers.reid_rows(spark, write(tmp_path / f"{i}.json", json.dumps(doc, indent=1))).collect()
        assert sorted((r.transcript_id, len(r.identifier_candidates)) for r in got) == [("s1", 0), ("s2", 0)]
    one = readers.reid_rows(spark, write(tmp_path / "one.json", json.dumps(rows[:1]))).collect()[0]
    assert one.identifier_candidates[0].interviewee_candiates == ["Ann"] and one.identifier_candidates[0].year == 2001
    assert readers.json_list(spark, str(tmp_path / "none.json"), "a int").isEmpty()
    assert readers.json_list(spark, write(tmp_path / "o.json", '{"a": 1}'), "a int").isEmpty()
    assert [r.a for r in readers.json_list(spark, write(tmp_path / "l.json", '[{"a": 1}, {"a": 2}]'), "a int").orderBy("pos").collect()] == [1, 2]


def test_fact_files(spark, tmp_path):
    root = tmp_path / "facts"
    root.mkdir()
    write(root / "S9.json", json.dumps({"facts": [{"code_id": "c1", "fact": "x"}]}))
    write(root / "b.json", json.dumps({"transcript_id": " S1", "facts": []}))
    write(root / "all_code_facts.json", json.dumps({"transcript_id": "zz"}))
    got = readers.fact_files(spark, str(root))
    assert sorted((r.transcript_id, len(r.facts)) for r in got.collect()) == [("s1", 0), ("s9", 1)]
    assert [r.transcript_id for r in readers.checked_ids(got, ["S9", "s9 ", "s1"]).collect()] == ["s9", "s1"]
    assert [r.transcript_id for r in readers.checked_ids(got, None).collect()] == ["s1", "s9"]
    with pytest.raises(ValueError, match="s7"):
        readers.checked_ids(got, ["s7"])


def test_sinks(spark, tmp_path):
    ids = spark.createDataFrame([("b", 0), ("a", 1)], "transcript_id string, pos int")
    texts = spark.createDataFrame([("a", 'x "q"\ny')], "transcript_id string, text string")
    out = sinks.rewritten(ids, texts)
    assert [tuple(r) for r in out.collect()] == [("b", ""), ("a", 'x "q"\ny')]
    sinks.write_csv(out.coalesce(1), str(tmp_path / "csv"))
    assert {r.transcript_id: r.text for r in readers.rewrites(spark, str(tmp_path / "csv")).collect()} == {"b": "", "a": 'x "q"\ny'}
    sinks.write_json(out, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    batch = spark.createDataFrame([("B", "failed", 1), ("a", "done", 0)], "transcript_id string, batch_status string, returncode int")
    outputs = spark.createDataFrame([("a", "success", 1.5, "t")], "transcript_id string, status string, final_privacy_score double, final_text string")
    assert [(r.transcript_id, r.status, r.final_privacy_score, r.output_exists) for r in sinks.batch_summary(batch, outputs).collect()] == [("a", "success", "1.5", True), ("B", "", "", False)]
    assert tuple(sinks.failures(batch).collect()[0]) == (1, True)
    assert [tuple(r) for r in sinks.aggregate(ids, outputs).collect()] == [("a", "t")]


def test_paths():
    assert sinks.run_path(["s1"], ["a", "b"]) == "s1__a_vs_b/comparison.json" and sinks.run_path(["x", "y"], ["a"]).startswith("2_samples__")
    assert sinks.export_paths("/out/", " my run! ")["rewritten"] == "/out/my_run__rewritten.csv" and sinks.export_paths("/out", None)["reid"].startswith("/out/nobranch_")
    assert readers.input_spec("My Run=x.json", "/d") == ("my_run", "/d/x.json") and readers.input_spec("/a/B c.json") == ("b_c", "/a/B c.json")


def test_store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    assert s.documents().isEmpty() and s.iterations().isEmpty()
    s.upsert(spark.createDataFrame([("a", "t1", "pending"), ("b", "t2", "pending")], "document_id string, original_text string, status string"))
    s.upsert(spark.createDataFrame([("a", None, "success"), ("c", "t3", "failed")], "document_id string, original_text string, status string"))
    s.upsert(spark.createDataFrame([("b", ["x"])], "document_id string, evidence_spans array<string>"))
    assert sorted((r.document_id, r.original_text, r.status) for r in s.documents().collect()) == [("a", "t1", "success"), ("b", "t2", "pending"), ("c", "t3", "failed")]
    assert s.document("b").collect()[0].evidence_spans == ["x"] and s.document("a").collect()[0].evidence_spans == [] and s.document("z").isEmpty()
    assert [r.document_id for r in s.documents("failed").collect()] == ["c"]
    assert {r.status: r["count"] for r in s.status_counts().collect()} == {"success": 1, "pending": 1, "failed": 1}
    for n in (2, 1):
        s.append_iterations(spark.createDataFrame([("a", n, "t")], "document_id string, iteration_num int, template_text string"))
    assert [r.iteration_num for r in s.iterations("a").collect()] == [1, 2] and s.iterations().select("id").distinct().count() == 2
    n = sinks.nested(s.documents(), s.iterations().drop("mask_map")).where("document_id = 'a'").collect()[0]
    assert [x.iteration_num for x in n.iterations] == [1, 2]
    counts = {r.transcript_id: r.iteration_count for r in sinks.samples(s.documents(), s.iterations()).collect()}
    assert counts == {"a": 2, "b": 0, "c": 0}
    s.reset()
    assert s.documents().isEmpty()


def test_conversations(spark):
    df = spark.createDataFrame([(1, 2, "assistant", "b"), (1, 1, "user", "a"), (2, 1, None, None)], "conv_id long, turn long, role string, text string")
    assert sorted((r.transcript_id, r.text) for r in readers.conversations_as_transcripts(df).select(F.col("transcript_id"), "text").collect()) == [(1, "user: a\nassistant: b"), (2, ": ")]


def test_reference_profiles_must_be_there(spark, tmp_path):
    f = spark.createDataFrame([("a", "AGE_01", "AGE", "old", 2), ("a", "SEX_01", "SEX", "male", 1), ("b", "AGE_01", "AGE", "young", 1)], "transcript_id string, fact_id string, attribute_key string, fact string, sort_index int")
    path = f"file://{tmp_path}/profiles"
    sinks.write_profiles(f, path, f.select("transcript_id", "fact"))
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "transcript_id string")
    got = readers.reference_profiles(spark, path, ids("a")).collect()
    assert len(got) == 1 and [x.fact for x in got[0].completed_profile] == ["male", "old"] and got[0].nonempty_attributes == 2
    assert spark.read.parquet(f"{path}/reference_summaries").count() == 3
    with pytest.raises(ValueError, match="c"):
        readers.reference_profiles(spark, path, ids("a", "c"))


def test_json_lists_are_read_in_pieces(spark, tmp_path):
    """whatever the layout; braces, brackets and quotes in strings; other elements than objects; files that aren't JSON."""
    from veilwright.sources.jsonlists import Scan

    rows = [{"a": i, "t": 'x"}]\\{,[ "' * (i % 3), "l": [{"b": [[]]}, "}", 1]} for i in range(7)] + [5, [{"c": {}}], None, "}", {}]
    want = [json.loads(json.dumps(r)) for r in rows]
    for i, doc in enumerate((rows, {"results": rows}, {"x": {}, "data": rows}, {"results": rows, "x": [{"y": []}]}, {"results": {}, "rows": rows})):
        for j, indent in enumerate((None, 2)):
            text = json.dumps(doc, indent=indent)
            got = readers.elements(spark, write(tmp_path / f"{i}-{j}.json", text + "\n" * j), ("results", "rows", "data")).orderBy("pos")
            assert [json.loads(r.v) for r in got.select(F.to_json("r").alias("v")).collect()] == want
    for i, text in enumerate(('[{"a": 1}', '[{"a": 1} {"a": 2}]', '[{"a": 1}]]', '[{"a": 1}, {"a": }]', "", '{"results": [{"a": 1}]', "nothing", '[{"a": "1}]')):
        assert readers.elements(spark, write(tmp_path / f"bad{i}.json", text), ("results",)).isEmpty(), text
    s, most = Scan(), 0
    for k in range(1000):
        assert s.feed(("[" if not k else ",") + '{"a": 1}')
        most = max(most, len("".join(s.kept)))
    assert s.feed("]") is None and s.at_end() == "list" and most == 0
