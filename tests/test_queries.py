import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from veilwright import dims, queries

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DIR}/{f}'")
    return c


def plain(row):
    return tuple(round(x, 9) if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, con, name):
    want, got = con.sql(entry.oracle_sql()[name]), entry.queries()[name](spark, DIR)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(plain, got.select(*cols).collect()), key=key) == sorted(map(plain, want.project(", ".join(cols)).fetchall()), key=key)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_rows(spark, name):
    assert entry.queries()[name](spark, DIR).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_profile_recoverability_takes_every_document(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("trim(text) <> ''")
    want = {r.lang: r.n for r in docs.groupBy("lang").agg(F.countDistinct("doc_id").alias("n")).collect()}
    got = {r.config: r.sample_count for r in entry.queries()["profile_recoverability"](spark, DIR).collect()}
    assert got == want


def test_fuzzy_attribute_is_the_sequence_matcher(spark):
    from difflib import SequenceMatcher

    bare = lambda x: "".join(c for c in x.lower() if c.isalnum())
    names = {r.p_partkey: r.p_name for r in spark.read.parquet(f"{DIR}/part.parquet").collect()}
    every = [(a[0], bare(x)) for a in dims.ATTRIBUTES for x in (a[0], a[1], a[2], a[3], *a[6])]
    rows = entry.queries()["fuzzy_attribute"](spark, DIR).collect()
    assert len(rows) == len(names)
    for r in rows:
        assert abs(r.ratio - SequenceMatcher(None, bare(r.label), bare(names[r.p_partkey])).ratio()) < 1e-12
        score = {k: max(SequenceMatcher(None, bare(r.label), x).ratio() for y, x in every if y == k) for k, _ in every}
        assert r.attribute_key is None and max(score.values()) < 0.62 or score[r.attribute_key] == max(score.values()) >= 0.62


@pytest.mark.parametrize("name", ["parsed_answers", "fuzzy_attribute"])
def test_part_is_spread_for_python(spark, name):
    """a table of one row group isn't parsed by one task."""
    assert entry.queries()[name](spark, DIR).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["mask_diff", "mask_roundtrip", "masked_texts"])
def test_texts_are_spread_for_the_matcher(spark, name):
    """a table of one row group isn't compared by one task."""
    assert entry.queries()[name](spark, DIR).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_answer_parts_of_odd_texts(spark, tmp_path):
    """texts that have marks of an answer themselves, blank ones and nulls."""
    import duckdb

    texts = ["a\n# b\n#c", "# x", "#", "a\n#", " ", "", None, "\n\n", "plain\ntext", "##", "#\n#x ", "\n#\n# y"]
    rows = [(4 * i + k, t) for i, t in enumerate(texts) for k in range(4)] + [(None, "z")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = c.sql(entry.oracle_sql()["answer_parts"]).fetchall()
    got = [tuple(r) for r in entry.queries()["answer_parts"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_canonical_merge_keeps_no_wording(spark):
    """what isn't asked for isn't aggregated, so lines are hashed and not sorted."""
    plan = entry.queries()["canonical_merge"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
