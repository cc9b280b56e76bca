"""The operators over the tables of a folder, and their SQL where DuckDB can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.llm import decontam, langid, licenses, linededup, mixing, packing, sharding, simhash, substring, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs.select("doc_id", "text"), docs.where(~langid.held_out()))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "accepted")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_digest(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeat_digest(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_simhash, op2_language, op3_packing, op4_sharding, op5_decontamination, op6_line_dedup, op7_substring_dedup, op8_mixing, op9_top_k, op10_licenses)
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op6_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
        keyed AS (SELECT *, {_LOW.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM lines),
        repeated AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
        marked AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.first AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
        SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op7_substring_dedup": f"""
        WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        starts AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS s, w FROM docs WHERE len(w) >= 50),
        windows AS (SELECT doc_id, s, sha256(array_to_string(w[s : s + 49], ' ')) AS h FROM starts),
        firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)),
        gone AS (SELECT DISTINCT w.doc_id, unnest(range(w.s, w.s + 50)) AS pos FROM windows w JOIN firsts f ON w.h = f.h AND w.doc_id > f.first),
        words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM docs),
        marked AS (SELECT x.*, g.pos IS NOT NULL AS cut FROM words x LEFT JOIN gone g ON x.doc_id = g.doc_id AND x.pos = g.pos),
        per AS (SELECT doc_id, count(*) FILTER (cut) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT cut) AS kept FROM marked GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM docs d LEFT JOIN per p ON d.doc_id = p.doc_id""",
    "op8_mixing": f"""
        WITH good AS (SELECT doc_id, coalesce(max(quality), 0) > 0 AS good FROM labels GROUP BY doc_id),
        d AS (SELECT d.doc_id, source, len({_WORDS})::BIGINT AS size, CASE WHEN good THEN 2 ELSE 1 END AS weight,
            (('0x' || substr(md5(d.doc_id::VARCHAR), 1, 13))::BIGINT + 1) / 4503599627370496.0::DOUBLE AS u FROM documents d LEFT JOIN good g ON d.doc_id = g.doc_id),
        k AS (SELECT *, CASE WHEN weight = 2 THEN sqrt(u) ELSE u END AS k FROM d),
        s AS (SELECT source, sum(size)::BIGINT AS n FROM k GROUP BY source),
        w AS (SELECT source, n, 2.0::DOUBLE * n AS most, ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS w FROM s),
        l AS (SELECT *, (sum(n) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / sum(w) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
            WINDOW f AS (ORDER BY most / w, source ASC NULLS LAST)),
        o AS (SELECT *, first_value(CASE WHEN level * w < most THEN level END IGNORE NULLS) OVER (ORDER BY most / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open FROM l),
        t AS (SELECT source, n, CASE WHEN open IS NULL THEN most ELSE least(open * w, most) END AS target FROM o),
        e AS (SELECT *, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END::BIGINT AS epochs FROM t),
        c AS (SELECT k.*, n, target, epochs, target - epochs * n AS rest, sum(size) OVER (PARTITION BY k.source ORDER BY k DESC, doc_id) AS cum FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source),
        m AS (SELECT *, cum <= rest AND rest > 0 AS chosen, rest - coalesce(max(CASE WHEN cum <= rest THEN cum END) OVER (PARTITION BY source), 0) AS gap FROM c),
        x AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN NOT chosen AND rest > 0 AND size > 0 AND abs(size - gap) < gap THEN 0 ELSE 1 END, abs(size - gap), k DESC, doc_id) AS rn FROM m),
        y AS (SELECT *, least(epochs + CASE WHEN chosen OR (rn = 1 AND rest > 0 AND size > 0 AND abs(size - gap) < gap) THEN 1 ELSE 0 END, 2)::BIGINT AS times FROM x)
        SELECT doc_id, size, n AS source_size, target, (size * times)::BIGINT AS taken, weight::INTEGER AS weight, times FROM y""",
    "op9_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda x: x[1] * x[2]))::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
        ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored)
        SELECT * FROM ranked WHERE rank <= 5""",
}
