"""The functions that no column expression can state: sequence matching, recovery of broken JSON, and a parser of
loosely structured answers. All take and return Arrow batches."""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache, wraps

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, MapType, StringType, StructField, StructType

from veilwright import dims

# types as objects: a DDL string needs a running session, and these functions are defined at import
MASK = StructType([StructField(n, t) for n, t in (("key", StringType()), ("original", StringType()), ("seed", StringType()), ("start", IntegerType()), ("end", IntegerType()))])
MASKS = StructType([StructField("template", StringType()), StructField("masks", ArrayType(MASK)), StructField("skipped", BooleanType())])
GUESS = StructType([StructField("type", StringType()), StructField("inference", StringType()), StructField("guess", ArrayType(StringType())), StructField("certainty", IntegerType())])
PARSED = MapType(StringType(), GUESS)
NON_SPACE = re.compile(r"\S+")
THOUGHTS = re.compile(r"<think>.*?</think>\s*", re.S)
FENCE = re.compile(r"```(?:json)?\s*\n?(.*?)```", re.S)


def bare(text: str | None) -> str:
    return "".join(c for c in (text or "").lower() if c.isalnum())


#: Answers about labels are kept for as many as this of up to so many characters: labels repeat, and memory stays bounded.
KEPT, SHORT = 1 << 14, 64


def short_kept(f):
    """f of texts, its results kept where the texts are short."""
    kept = lru_cache(KEPT)(f)

    @wraps(f)
    def short(*texts):
        return (kept if all(x is None or len(x) <= SHORT for x in texts) else f)(*texts)

    return short


@short_kept
def ratio(a: str | None, b: str | None) -> float:
    return SequenceMatcher(None, bare(a), bare(b)).ratio()


@F.pandas_udf(DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two labels, letters and digits only."""
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)])


def _balanced(text: str, pair: str) -> str | None:
    """The first stretch from an opening bracket to the one that closes it, strings respected."""
    start = text.find(pair[0])
    depth, quoted, i = 0, False, start
    while 0 <= i < len(text):
        c = text[i]
        if c == "\\":
            i += 2
            continue
        if c == '"':
            quoted = not quoted
        elif not quoted and c in pair:
            depth += 1 if c == pair[0] else -1
            if not depth:
                return text[start : i + 1]
        i += 1
    return None


def recover_json(raw: str | None) -> str:
    """The JSON in a model's answer, as text: the whole of it, else its first balanced object, else its first balanced
    list; {} if none parses."""
    text = raw or ""
    text = (THOUGHTS.sub("", text) if "<think>" in text else text).strip()
    for part in (text, _balanced(text, "{}"), _balanced(text, "[]")):
        try:
            return json.dumps(json.loads(part), ensure_ascii=False)
        except (TypeError, ValueError):
            continue
    return "{}"


@F.pandas_udf(StringType())
def json_recover(raw: pd.Series) -> pd.Series:
    return raw.map(recover_json)


def fenced_object(raw: str | None) -> str | None:
    """The first JSON object of an answer, as text: in a code fence if there is one; null if there is none."""
    text = (raw or "").strip()
    if m := FENCE.search(text):
        text = m[1].strip()
    decoder, at = json.JSONDecoder(), -1
    try:
        whole = json.loads(text)
        return json.dumps(whole, ensure_ascii=False) if isinstance(whole, dict) else None
    except ValueError:
        pass
    while (at := text.find("{", at + 1)) >= 0:
        try:
            return json.dumps(decoder.raw_decode(text, at)[0], ensure_ascii=False)
        except ValueError:
            continue
    return None


@F.pandas_udf(StringType())
def fill_json(raw: pd.Series) -> pd.Series:
    return raw.map(fenced_object)


def outer_object(raw: str | None) -> str:
    """The JSON object that an answer is, else what stands from its first to its last brace if that is one, else {}."""
    text = (raw or "").strip()
    for part in (text, text[text.find("{") : text.rfind("}") + 1]):
        try:
            if isinstance(found := json.loads(part), dict):
                return json.dumps(found, ensure_ascii=False)
        except ValueError:
            continue
    return "{}"


@F.pandas_udf(StringType())
def outer_json(raw: pd.Series) -> pd.Series:
    return raw.map(outer_object)


LABELS = tuple((a[0], bare(x)) for a in dims.ATTRIBUTES for x in (a[0], a[1], a[2], a[3], *a[6]))


def attribute_of(text: str | None, labels: tuple[tuple[str, str], ...] = LABELS, least: float = 0.62) -> str | None:
    """The attribute that a label means: the one that has it, else the one with the most similar label (the first of
    equals) if it is similar enough. Labels whose bounds (lengths, then letters in common) can't reach the best so far are
    not compared."""
    token = bare(text)
    if not token:
        return None
    same = [k for k, x in labels if x == token]
    if same:
        return same[-1]
    best, key = 0.0, None
    for k, x in labels:
        m = SequenceMatcher(None, token, x)
        if (most := m.real_quick_ratio()) < least or most <= best or (most := m.quick_ratio()) < least or most <= best:
            continue
        if (score := m.ratio()) >= least and score > best:
            best, key = score, k
    return key


@short_kept
def known_attribute(text: str | None) -> str | None:
    return attribute_of(text)


@F.pandas_udf(StringType())
def match_attribute(text: pd.Series) -> pd.Series:
    return text.map(known_attribute)


def _fields(answer: str) -> Iterator[tuple[str | None, str]]:
    """(name, value) of each line that isn't blank; the name is null where the line goes on with the field before it.
    A colon at the end of a line counts for nothing."""
    for line in answer.split("\n"):
        if line.strip():
            name, colon, value = line.removesuffix(":").partition(":")
            yield (name.strip().lower(), value.strip()) if colon else (None, name)


@short_kept
def _meaning(word: str) -> tuple[str, str | None]:
    """What a field's name says: that the name of an attribute follows, an attribute, a field of one, or nothing."""
    if ratio(word, "type") >= 0.82:
        return "type", None
    if word not in ("inference", "guess", "certainty") and (key := attribute_of(word)):
        return "attribute", key
    return "field", next((f for f in ("inference", "guess", "certainty") if ratio(word, f) >= 0.82), None)


def parse_answer(answer: str | None) -> dict[str, dict]:
    """Blocks of `Type / Inference / Guess / Certainty` lines, in any order and loosely spelled, by attribute. A line
    without a colon goes on with the field before it. Every attribute has an entry; guesses are three at most."""
    blocks: dict[str | None, dict] = {None: {}}
    block, fld = blocks[None], None
    for word, value in _fields(answer or ""):
        if word is None:
            if fld == "guess":
                block.setdefault(fld, []).append(value)
            elif fld:
                block[fld] = f"{block[fld]}\n{value}" if fld in block else value
            continue
        says, key = _meaning(word)
        if says == "type":
            block = blocks.setdefault(known_attribute(value), {})
        elif says == "attribute":
            block = blocks.setdefault(key, {})
        elif key:
            fld = key
            block[fld] = [v.strip() for v in value.split(";")] if fld == "guess" else value
    out = {}
    for key, _, name, *_ in dims.ATTRIBUTES:
        got = blocks.get(key, {"inference": "MISSING"})
        digits = re.search(r"\d+", got.get("certainty", "1"))
        guesses = [g.strip() for g in got.get("guess", []) if g.strip()]
        out[key] = {"type": name, "inference": got.get("inference", "").strip(), "guess": guesses[:3], "certainty": max(1, min(5, int(digits[0]) if digits else 1))}
    return out


@F.arrow_udf(PARSED)
def parse_inference(answer: pa.Array) -> pa.Array:
    return pa.array([list(parse_answer(x).items()) for x in answer.to_pylist()], to_arrow_type(PARSED))


def _anchors(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of tokens that both have once, as many as rise in both."""
    once_a, once_b = Counter(a), Counter(b)
    place = {x: j for j, x in enumerate(b) if once_b[x] == 1}
    found = [(i, place[x]) for i, x in enumerate(a) if once_a[x] == 1 and x in place]
    ends, tails, before = [], [], []
    for n, (_, j) in enumerate(found):
        at = bisect_left(ends, j)
        before.append(tails[at - 1] if at else -1)
        ends[at : at + 1], tails[at : at + 1] = [j], [n]
    out, n = [], tails[-1] if tails else -1
    while n >= 0:
        out.append(found[n])
        n = before[n]
    return out[::-1]


def blocks(a: list[str], b: list[str]) -> list[tuple[int, int, int]]:
    """The matching blocks (i, j, size) of the sequence matcher without junk, in order.

    The matcher takes the longest common run of a stretch of both (the first in a, then in b, of equals) and goes on with what
    lies before and after it, searching each stretch anew. Here equal pairs are listed once, as runs, and the longest is
    taken that still lies in one stretch; pairs outside of all stretches go, by arrays, whenever many runs are found cut. Where
    pairs are few, or too many to list, the matcher itself is faster or smaller.
    """
    if min(len(a), len(b)) < 2:
        i, j = (0, next((j for j, x in enumerate(b) if x == a[0]), -1)) if len(a) == 1 else (next((i for i, x in enumerate(a) if x in b), -1), 0)
        return [(i, j, 1)] if a and b and min(i, j) >= 0 else []
    once = Counter(b)
    pairs = sum(once[x] for x in a)
    if pairs < 200 or pairs > 1 << 22:
        return [tuple(x) for x in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()[:-1]]
    ids = {x: n for n, x in enumerate(once)}
    of_a, of_b = np.array([ids.get(x, -1) for x in a]), np.array([ids[x] for x in b])
    order = np.argsort(of_b, kind="stable")
    number = np.fromiter((*once.values(), 0), np.int64)
    n, low = number[of_a], (np.cumsum(number) - number)[of_a]
    ci = np.repeat(np.arange(len(a)), n)
    cj = order[np.arange(pairs) + np.repeat(low - np.cumsum(n) + n, n)]
    key = (cj - ci + len(a)) * (len(a) + 1) + ci
    by = np.argsort(key)
    ci, cj, key = ci[by], cj[by], key[by]
    # the stretch that each token is in; what is in none has numbers that differ between a and b
    in_a, in_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    stretches, out = [(0, len(a), 0, len(b))], []
    while len(ci):
        starts = np.flatnonzero(np.diff(key, prepend=-2) != 1)
        sizes = np.diff(starts, append=len(key))
        first = np.lexsort((cj[starts], ci[starts], -sizes))[:256]
        runs, least, cut = list(zip(ci[starts[first]].tolist(), cj[starts[first]].tolist(), sizes[first].tolist(), strict=True)), 0, 0
        for i, j, k in runs:
            if k <= least or cut > 32:
                break
            at = in_a[i : i + k] == in_b[j : j + k]
            if not at.all():
                cut += 1
                if at.any():  # what is left of it is shorter, and due before runs of that size
                    edges = np.flatnonzero(np.diff(at, prepend=False, append=False))
                    least = max(least, int((edges[1::2] - edges[::2]).max()))
                continue
            i1, i2, j1, j2 = stretches[in_a[i]]
            out.append((i, j, k))
            in_a[i1:i2], in_b[j1:j2] = -1, -2
            for x, x2, y, y2 in ((i1, i, j1, j), (i + k, i2, j + k, j2)):
                if x < x2 and y < y2:
                    in_a[x:x2] = in_b[y:y2] = len(stretches)
                    stretches.append((x, x2, y, y2))
        keep = in_a[ci] == in_b[cj]
        ci, cj, key = ci[keep], cj[keep], key[keep]
    return sorted(out)


def differing(a: list[str], b: list[str], plain: int = 1500) -> Iterator[tuple[int, int, int, int]]:
    """Ranges of a and of b that differ, in order. The sequence matcher finds them; beyond `plain` tokens, whose time it
    could square, common ends go first and the rest is split at tokens that both have once."""
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i2, j, j2 = todo.pop()
        if max(i2 - i, j2 - j) <= plain:
            points = []
        else:
            while i < i2 and j < j2 and a[i] == b[j]:
                i, j = i + 1, j + 1
            while i < i2 and j < j2 and a[i2 - 1] == b[j2 - 1]:
                i2, j2 = i2 - 1, j2 - 1
            points = _anchors(a[i:i2], b[j:j2]) if max(i2 - i, j2 - j) > plain else []
        if not points:
            at_a, at_b = i, j
            for x, y, k in [*blocks(a[i:i2], b[j:j2]), (i2 - i, j2 - j, 0)]:
                if at_a < i + x or at_b < j + y:
                    yield at_a, i + x, at_b, j + y
                at_a, at_b = i + x + k, j + y + k
            continue
        parts, at, bt = [], i, j
        for x, y in points:
            parts.append((at, i + x, bt, j + y))
            at, bt = i + x + 1, j + y + 1
        todo += [(x, x2, y, y2) for x, x2, y, y2 in [*parts, (at, i2, bt, j2)] if x < x2 or y < y2][::-1]


def edits(a: list[str], b: list[str], gap: int) -> list[tuple[int, int, int, int]]:
    """Ranges of a and of b that differ, joined where no more than `gap` equal tokens stand between."""
    out: list[list[int]] = []
    for i1, i2, j1, j2 in differing(a, b):
        if out and i1 - out[-1][1] <= gap:
            out[-1][1], out[-1][3] = i2, j2
        else:
            out.append([i1, i2, j1, j2])
    return [tuple(x) for x in out]


def diff(original: str | None, rewritten: str | None, gap: int = 2, most: int | None = None) -> dict:
    """Template and masks of what a rewrite changes: each changed stretch of the original becomes [MASK_i]. What the
    rewrite only adds has no mask. Texts of any length are compared; where `most` is given, those of more tokens are not and
    come back as skipped."""
    original, rewritten = original or "", rewritten or ""
    a, b = NON_SPACE.findall(original), NON_SPACE.findall(rewritten)
    if most is not None and max(len(a), len(b)) > most:
        return {"template": original, "masks": [], "skipped": True}
    parts, masks, at = [], [], 0
    changed = [x for x in edits(a, b, gap) if x[0] < x[1]] if a != b else []
    if changed:
        a, b = ([m.span() for m in NON_SPACE.finditer(t)] for t in (original, rewritten))
    for i1, i2, j1, j2 in changed:
        s, e = a[i1][0], a[i2 - 1][1]
        key = f"MASK_{len(masks) + 1}"
        seed = rewritten[b[j1][0] : b[j2 - 1][1]] if j1 < j2 else ""
        parts += [original[at:s], f"[{key}]"]
        masks.append({"key": key, "original": original[s:e], "seed": seed, "start": s, "end": e})
        at = e
    return {"template": "".join(parts) + original[at:], "masks": masks, "skipped": False}


def diff_to_masks(original: Column, rewritten: Column, gap: int = 2, most: int | None = None) -> Column:
    """diff() of two columns, a struct of template, masks (in order) and skipped."""

    @F.arrow_udf(MASKS)
    def masked(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([diff(x, y, gap, most) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], to_arrow_type(MASKS))

    return masked(original, rewritten)


FOUND = ArrayType(StructType([StructField("_in", BooleanType()), StructField("_n", IntegerType()), StructField("_found", IntegerType())]))


def _found_words(spans: list[str], text: str) -> list[dict]:
    have, out = set(text.split(" ")), []
    for s in spans:
        w = {x for x in s.split(" ") if len(x) >= dims.LEAK_WORD}.difference(dims.LEAK_STOP)
        out.append({"_in": s in text, "_n": len(w), "_found": len(w & have)})
    return out


@F.arrow_udf(FOUND)
def found_words(spans: pa.Array, text: pa.Array) -> pa.Array:
    """For each of an array of plain spans, whether the plain text has it (_in), its different long words (_n) and how many of
    those are words of the text (_found). The text's words are told apart once."""
    return pa.array([_found_words(s, t) for s, t in zip(spans.to_pylist(), text.to_pylist(), strict=True)], to_arrow_type(FOUND))
