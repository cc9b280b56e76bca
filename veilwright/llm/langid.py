"""Language identification by nearest centroid.

A text becomes a vector of hashed letter n-grams (one to three, word boundaries included), weighted by
sublinear TF and IDF and normalised. Each language has several centroids, found by spherical k-means over a
bounded sample of labelled texts. The nearest centroid by cosine names the language; a text whose cosine
distance to it is too large is rejected. N-grams that no text of the sample has add to a text's norm only, so
collisions of hashes don't bring a long text of an unlearned script near; and how near a text must be is learned
by length, from texts of the sample that are scored by a model of the others.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwright.llm.runtime import fresh, ship

BITS = 13
SEEN_BITS = 22  # of the hashes that tell which n-grams the sample has
BANDS = 32  # lengths (numbers of n-grams) by their binary logarithm
UNDETERMINED = "und"


@dataclass(frozen=True)
class Params:
    """per_language: labelled texts expected in the sample of a language, which bounds what the driver gathers (no
    language gives more than twice that, and every language that has a label is learned); reject_distance: cosine distances above it are rejected, whatever the length; part, quantile, least: a text is also
    rejected if its cosine is below `part` of this quantile of held-out texts of about its length (a quarter to four
    times), where there are `least` of them."""

    per_language: int = 300
    centroids: int = 4
    rounds: int = 12
    reject_distance: float = 0.95
    part: float = 0.3
    quantile: float = 0.01
    least: int = 20


@dataclass(frozen=True)
class Model:
    labels: tuple[str, ...]
    of: np.ndarray  # language of each centroid
    centroids: np.ndarray  # (2^BITS, centroids)
    idf: np.ndarray
    seen: np.ndarray  # bitmap of 2^SEEN_BITS: the n-grams of the sample
    unseen_idf: float
    floors: np.ndarray  # the least cosine that is accepted, by length


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def _slots(text: str | None) -> np.ndarray:
    """Hashes of SEEN_BITS of each n-gram of the whole text. No letters: none."""
    none = np.zeros(0, np.int64)
    if not text:
        return none
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    c = np.where(_letters()[c], c, 0).astype(np.uint64)
    c = np.concatenate([np.zeros(1, np.uint64), c, np.zeros(1, np.uint64)])
    c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]
    if len(c) < 3:
        return none
    m, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - SEEN_BITS)
    two = c[:-1] * np.uint64(0x110001) + c[1:]
    three = two[:-1] * np.uint64(0x110001) + c[2:]
    return np.concatenate([((grams * np.uint64(4) + np.uint64(n)) * m >> shift).astype(np.int64) for n, grams in enumerate((c[c != 0], two, three), 1)])


def _buckets(slots: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    found = np.bincount(slots >> (SEEN_BITS - BITS), n, minlength=1 << BITS).astype(np.int64)
    at = np.nonzero(found)[0]
    return at, found[at]


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of the whole text, and how often each occurs. No letters: none."""
    return _buckets(_slots(text))


def _sampled(batches):
    for b in batches:
        langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        found = [np.unique(_slots(t), return_counts=True) for t in texts]
        at = [x[0].astype("<u4").tobytes() for x in found]
        n = [x[1].astype("<u4").tobytes() for x in found]
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(at, pa.binary()), pa.array(n, pa.binary())], names=["lang", "at", "n"])


def _clusters(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Centroids of spherical k-means, begun with the row nearest the mean and then the rows farthest from those taken."""
    mean = x.mean(axis=0)
    chosen = [int((x @ mean).argmax())]
    while len(chosen) < min(k, len(x)):
        near = (x @ x[chosen].T).max(axis=1)
        if near.min() > 1 - 1e-9:
            break
        chosen.append(int(near.argmin()))
    c = x[chosen]
    for _ in range(rounds):
        mine = (x @ c.T).argmax(axis=1)
        sums = np.stack([x[mine == j].sum(axis=0) if (mine == j).any() else c[j] for j in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c


def fit(docs: DataFrame, params: Params = Params(), text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """Learn from the rows of docs with a label and letters. The sample is drawn by a hash of the id against
    per_language over the label's count, so it is the same in every run and no label is gathered in one task; an id that
    repeats very often can't crowd out others, as each label gives 2 * per_language rows at most."""
    ship(docs.sparkSession)
    labelled = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id")).where("lang is not null and id is not null")
    n = labelled.groupBy("lang").count().collect()
    if not n:
        return _learned([], params)
    share = F.create_map(*[x for r in n for x in (F.lit(r["lang"]), F.lit(params.per_language / r["count"]))])
    drawn = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 40)) < share[F.col("lang")] * (1 << 40)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id", "text")))
    few = labelled.where(drawn).withColumn("place", place).where(F.col("place") <= 2 * params.per_language)
    rows = few.select("lang", "text").mapInArrow(_sampled, "lang string, at binary, n binary").where("length(at) > 0").collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["at"]), bytes(r["n"])))
    drawn = [(r["lang"], np.frombuffer(r["at"], "<u4").astype(np.int64), np.frombuffer(r["n"], "<u4")) for r in rows]
    first, second = _learned(drawn[::2], params), _learned(drawn[1::2], params)
    held = [(n.sum(), _nearest(at, n, m)[1]) for part, m in ((drawn[1::2], first), (drawn[::2], second)) if m.labels for _, at, n in part]
    return replace(_learned(drawn, params), floors=_floors(held, params))


def _learned(rows: list[tuple[str, np.ndarray, np.ndarray]], params: Params) -> Model:
    """The model of rows (language, hashes of n-grams, how often each occurs), without floors."""
    labels = tuple(sorted({r[0] for r in rows}))
    x = np.zeros((len(rows), 1 << BITS), dtype=np.float32)
    seen = np.zeros(1 << SEEN_BITS, dtype=bool)
    for i, (_, slots, n) in enumerate(rows):
        at, found = _buckets(slots, n)
        x[i, at] = 1 + np.log(found)
        seen[slots] = True
    idf = (np.log((1 + len(rows)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    y = np.array([labels.index(r[0]) for r in rows], dtype=np.int64)
    parts = [_clusters(x[y == j], params.centroids, params.rounds) for j in range(len(labels))]
    of = np.repeat(np.arange(len(labels)), [len(p) for p in parts])
    centroids = np.ascontiguousarray(np.concatenate(parts).T.astype(np.float32)) if parts else np.zeros((1 << BITS, 0), np.float32)
    return Model(labels, of, centroids, idf, np.packbits(seen, bitorder="little"), float(np.log(1 + len(rows)) + 1), np.zeros(BANDS))


def _band(n: int) -> int:
    return min(BANDS - 1, int(n).bit_length())


def _floors(held: list[tuple[int, float]], params: Params) -> np.ndarray:
    """The least cosine by length. Beyond the longest lengths that are known, theirs; below the shortest, none."""
    band, score = np.array([_band(n) for n, _ in held]), np.array([s for _, s in held])
    out, last = np.zeros(BANDS), 0.0
    for i in range(BANDS):
        near = score[np.abs(band - i) <= 1] if len(held) else score
        if len(near) >= params.least:
            last = params.part * float(np.quantile(near, params.quantile))
        out[i] = last
    return out


def _nearest(slots: np.ndarray, n: np.ndarray | None, model: Model) -> tuple[str, float]:
    known = (model.seen[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)
    at, found = _buckets(slots[known], None if n is None else n[known])
    _, new = _buckets(slots[~known], None if n is None else n[~known])
    w = (1 + np.log(found)).astype(np.float32) * model.idf[at]
    norm = np.sqrt(float(w @ w) + model.unseen_idf**2 * float(((1 + np.log(new)) ** 2).sum()))
    cos = (w / norm) @ model.centroids[at]
    best = int(cos.argmax())
    return model.labels[model.of[best]], float(min(1.0, max(0.0, cos[best])))


def classify(text: str | None, model: Model, params: Params = Params()) -> tuple[str, float, bool]:
    """Language, cosine, and whether that is accepted."""
    slots = _slots(text)
    if not len(slots) or not len(model.labels):
        return UNDETERMINED, 0.0, False
    lang, score = _nearest(slots, None, model)
    return lang, score, 1 - score <= params.reject_distance and score >= float(model.floors[_band(len(slots))])


def language(model: Model, text: Column, params: Params = Params()) -> Column:
    """struct<lang_pred string, score double, accepted boolean> of a text column.

    lang_pred is the nearest centroid's language, `und` where the text is null or has no letter (or nothing was
    learned); score is the cosine, from 0 to 1; accepted tells that lang_pred isn't `und`, that the distance
    1 - score is no more than params.reject_distance, and that score isn't below what texts of its length have.
    """

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def nearest(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([classify(t, model, params) for t in texts], columns=["lang_pred", "score", "accepted"])
        return out.astype({"lang_pred": object, "score": float, "accepted": bool})

    return nearest(text)


def identify(docs: DataFrame, train: DataFrame, params: Params = Params()) -> DataFrame:
    """docs with lang_pred, score and accepted (see language()) instead of any columns of these names; train has
    text, lang and doc_id. Empty tables give empty results; nothing but text decides a prediction."""
    model = fit(train, params)
    (tmp,) = fresh(docs, "found")
    own = {"lang_pred", "score", "accepted"}
    kept = [c for c in docs.columns if c.lower() not in own]
    return docs.withColumn(tmp, language(model, F.col("text"), params)).select(*kept, F.col(tmp)["lang_pred"].alias("lang_pred"), F.col(tmp)["score"].alias("score"), F.col(tmp)["accepted"].alias("accepted"))


def keep_accepted(docs: DataFrame, train: DataFrame, params: Params = Params()) -> DataFrame:
    """The rows of docs that identify() accepts, columns unchanged. Null texts, empty ones and those without letters go,
    as do all if train has no label; repeated rows and rows without doc_id are told one by one by their text; an empty
    table gives an empty one. Columns named like identify()'s are kept as they are."""
    ship(docs.sparkSession)
    return docs.where(language(fit(train, params), F.col("text"), params)["accepted"])


def held_out(id_col: str = "doc_id") -> Column:
    """True for the quarter of documents that the benchmark query never learns from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))
