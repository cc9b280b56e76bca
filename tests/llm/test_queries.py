"""The registered queries and the pipeline on the smallest tables."""

from collections import Counter
from itertools import combinations

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_text_ops import plain_tiles
from veilwright.llm import decontam, mixing, sharding

DIR = "/root/testdata/sf0.001"


def test_registered():
    names = entry.queries()
    assert [n for n in names if n.startswith("op")] and {f"op{i}" for i in range(1, 11)} == {n.split("_")[0] for n in names if n.startswith("op")}
    assert "pipeline" in names and 4 <= len(corpus_pipeline.STAGES) <= 5


@pytest.mark.parametrize("name", ["op6_line_dedup", "op7_substring_dedup", "op8_mixing", "op9_top_k"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, DIR)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(want.project(", ".join(cols)).fetchall())


def similar_groups(texts):
    """id -> smallest id of its group, by comparing all pairs of sets of 5-word shingles: 0.8 alike or more are linked."""

    def shingles(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, label = {d: shingles(t) for d, t in texts.items()}, {d: d for d in texts}
    for a, b in combinations(sorted(sets), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            x, y = sorted((label[a], label[b]))
            label = {d: x if c == y else c for d, c in label.items()}
    return label


def holds(text, item):
    """Whether tiles of 5 words or more, longest first, cover half of the item's words: by the definition."""
    w, x = decontam.words(text), decontam.words(item)
    if len(x) < 5:
        return bool(x) and w == x
    if not {tuple(w[i : i + 5]) for i in range(len(w) - 4)} & {tuple(x[i : i + 5]) for i in range(len(x) - 4)}:
        return False
    return sum(n for *_, n in plain_tiles(w, x, 5)) >= 0.5 * len(x)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = corpus_pipeline.run(spark, DIR)
    assert out.columns == [*docs.columns, "virtual_slot", "shard"]
    language = corpus_pipeline.language_stage(spark, docs, DIR)
    assert language.columns == docs.columns and language.count() == docs.where("text rlike '[A-Za-z]'").count()
    group = similar_groups({r.doc_id: r.text for r in language.collect()})
    firsts = set(group.values())
    assert len(firsts) < len(group)
    one = corpus_pipeline.near_duplicate_stage(spark, language, DIR)
    assert {r.doc_id for r in one.collect()} == firsts and one.count() == len(firsts)
    items = [r.text for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    bad = {r.doc_id for r in one.collect() if len(decontam.words(r.text)) < 3000 and any(holds(r.text, t) for t in items)}
    clean = corpus_pipeline.decontamination_stage(spark, one, DIR)
    long = {r.doc_id for r in one.collect() if len(decontam.words(r.text)) >= 3000}
    assert bad and {r.doc_id for r in clean.collect()} - long == firsts - bad - long
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    times = {r.doc_id: r.times for r in mixing.mix_report(clean, labels).collect()}
    mixed = corpus_pipeline.mixing_stage(spark, clean, DIR)
    assert Counter(r.doc_id for r in mixed.select("doc_id").collect()) == +Counter(times) == Counter(r.doc_id for r in out.collect())
    size = [0] * 16
    for r in out.collect():
        size[r.shard] += len((r.text or "").encode()) + 1
    assert len({(r.doc_id, r.shard) for r in out.collect()}) == len({r.doc_id for r in out.collect()})
    assert sorted(r.shard for r in out.collect()) == sorted(r.shard for r in sharding.shard_documents(mixed).collect())


def odd_folder(spark, path, rows):
    """A folder of documents with columns that the stages might use themselves, and with nulls in every column."""
    ddl = "doc_id long, text string, lang string, source string, n_chars long, kept_id long, text_id string, n_items int, k double, s string, o long, weight int, found string, virtual string, dropped string"
    spark.createDataFrame([(*r, None, 1, "t", 2, 0.5, "s", 3, 4, "f", "v", "d") for r in rows], ddl).write.parquet(f"{path}/documents.parquet")
    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{DIR}/{t}.parquet").write.parquet(f"{path}/{t}.parquet")
    return f"file://{path}"


def test_pipeline_of_odd_rows(spark, tmp_path):
    prose = [r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").where("lang = 'en' and n_chars between 300 and 2000").orderBy("doc_id").collect()]
    rows = [(i, t, "en", None if i % 3 else "a") for i, t in enumerate(prose)]
    rows += [(900, None, "en", "a"), (901, "", None, "a"), (902, " \n", "en", None), (None, prose[0], None, None), (None, prose[1] + " end", "en", "a"), (3, prose[3], "en", "a"), (903, " ".join(prose) * 3, "en", "a")]
    folder = odd_folder(spark, f"{tmp_path}/odd", rows)
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == [*spark.read.parquet(f"{folder}/documents.parquet").columns, "virtual_slot", "shard"]
    got = {r.doc_id for r in out.collect()}
    assert got and got <= {d for d, t, *_ in rows if (t or "").strip()} and out.where("n_items <> 2 or kept_id <> 1").isEmpty()
    empty = odd_folder(spark, f"{tmp_path}/empty", [])
    assert corpus_pipeline.run(spark, empty).collect() == []


def test_mixing_stage_weighs_by_labels(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    report = mixing.mix_report(docs, spark.read.parquet(f"{DIR}/labels.parquet")).collect()
    assert {r.weight for r in report} == {1, 2}
    got = Counter(r.doc_id for r in corpus_pipeline.mixing_stage(spark, docs, DIR).select("doc_id").collect())
    assert got == +Counter({r.doc_id: r.times for r in report})
