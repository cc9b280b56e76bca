"""Model calls as data: a table of requests with content hashes, a table of responses, and a join between them.

What a response table has is replayed; only the rest goes to a backend, by mapInPandas, so calls run on executors and
their number at a time is the number of partitions. A request's key covers model, stage, schema version and all
inputs and nothing else, so replays are exact and a new version of the schema asks anew.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwright import dims
from veilwright.functions import text as T
from veilwright.functions.udfs import fill_json, json_recover, outer_json
from veilwright.session import stored

SCHEMA_VERSION = "1"
RESPONSE = "cache_key string, raw string, error string, created_at timestamp"

TEXT = "=== TEXT ==="  # the line between a request's context and its text


@dataclass(frozen=True)
class Stage:
    """A kind of request: its system prompt (our own wording; the answer's fields are the data contract) and how an answer
    that isn't JSON as it stands is read. recover: its first balanced object or list; fenced: the object in a code fence,
    else the first that parses; outer: what stands from the first to the last brace; text: not JSON."""

    system: str
    parse_mode: str = "recover"


STAGES = {
    "privacy_inference": Stage("Infer each listed attribute of the speaker from the transcript. Answer with JSON by attribute key: inference, guesses (three), certainty 1-5, evidence_spans."),
    "topic_focus": Stage("Name the topic of the transcript. Answer with JSON: primary_topic, secondary_context, preserve_focus, generalize_focus, rationale."),
    "utility_summary": Stage("Summarise what is useful in the transcript. Answer with JSON by dimension: attribute, summary, key_spans, richness 1-5."),
    "fingerprints": Stage("List five to ten phrases that could single out the speaker. Answer with JSON: fingerprints."),
    "round_inference": Stage("Say for each attribute: Type, Inference, Guess (three, by semicolons), Certainty 1-5, each on a line.", "text"),
    "rewrite": Stage("Generalise what gives attributes away and change nothing else. Explain, then put # on a line, then the text.", "text"),
    "refill": Stage("Fill each mask token with a general expression. Answer with JSON by token.", "fenced"),
    "attack": Stage("Infer each listed attribute of the speaker from the transcript. Answer with JSON by attribute key: inference, guesses (three), certainty 1-5, evidence_spans."),
    "compare": Stage("Compare inferences before and after. Answer with JSON by attribute key: leaked, certainty_delta, severity 0-5, evidence_spans, explanation; and total_severity."),
    "specificity": Stage("Judge five dimensions. Answer with JSON: dimensions by name with too_specific, rationale, evidence_spans; and too_specific_count."),
    "keeper": Stage("Judge what the rewrite keeps. Answer with JSON by dimension: preserved, loss_severity 0-5, lost_details; and total_loss."),
    "expand_attributes": Stage("Propose further attributes that the evidence shows. Answer with JSON: attributes with key, display_name, target_str, options, note."),
    "merge_descriptions": Stage("Unite descriptions of one candidate. Answer with JSON: unified_description.", "outer"),
    "extract_facts": Stage("Split descriptions into atomic facts. Answer with JSON by attribute key: lists of fact, supporting_candidates, source_fields.", "outer"),
    "attribute_summary": Stage("Summarise what the transcript says about one attribute. Answer with JSON: supported, summary_description, evidence_quote.", "outer"),
    "summary_sanity": Stage("Keep only what belongs to the attribute. Answer with JSON: summary_description.", "outer"),
    "summary_facts": Stage("Split a summary into atomic facts. Answer with JSON: facts.", "outer"),
    "merge_facts": Stage("Merge facts that say the same. Answer with JSON: merged_facts with primary_attribute_key, fact, source_fact_ids.", "outer"),
    "judge_fact": Stage("Can the fact be recovered from the transcript? Answer with JSON: decision, reasoning, evidence_quote.", "outer"),
    "judge_code_fact": Stage("Can the coded fact be recovered from the transcript? Answer with JSON: decision, reasoning, evidence_quote.", "outer"),
}


def prompt(text: Column, *context: Column) -> Column:
    """A request's text after its context, which may be null or empty."""
    head = F.concat_ws("\n", *[F.nullif(c, F.lit("")) for c in context]) if context else F.lit("")
    return F.when(head == "", text).otherwise(F.concat_ws("\n", head, F.lit(TEXT), text))


class Backend(Protocol):
    """Answers one request; raises if it can't. It may also have answer_many(stage, model, system, contexts, text), the answers
    to prompt(text, context) of each context, or null where it would rather be asked one by one."""

    def answer(self, stage: str, model: str, system: str, user: str) -> str: ...


class ReplayBackend:
    """Answers nothing: what isn't in the response table is an error."""

    def answer(self, stage: str, model: str, system: str, user: str) -> str:
        raise LookupError("no recorded response")


class RuleBackend:
    """A test double with fixed rules: e-mails, addresses and long numbers are personal, and are generalised. Its output
    says nothing about how well a model would do."""

    PERSONAL = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|\b\d{1,3}(?:\.\d{1,3}){3}\b|\d{6,}")

    def _spans(self, text: str) -> list[str]:
        return list(dict.fromkeys(self.PERSONAL.findall(text)))

    def _judged(self, fact: str, lower: str) -> str:
        found = bool(fact) and fact.lower() in lower
        return json.dumps({"decision": dims.DECISIONS["yes" if found else "no"], "reasoning": "", "evidence_quote": fact if found else ""})

    def answer_many(self, stage: str, model: str, system: str, contexts: list[str], text: str) -> list[str] | None:
        """answer() to the prompts of contexts with one text, which is read once; null where that isn't so."""
        if type(self).answer is not RuleBackend.answer or stage not in ("judge_fact", "judge_code_fact") or f"{TEXT}\n" in text:
            return None
        lower, facts = text.lower(), [c.partition("\n")[0] for c in contexts]
        got = {x: self._judged(x, lower) for x in dict.fromkeys(facts)}
        return [got[x] for x in facts]

    def answer(self, stage: str, model: str, system: str, user: str) -> str:
        context, _, user = user.rpartition(f"{TEXT}\n")
        if stage in ("judge_fact", "judge_code_fact"):
            return self._judged(context.partition("\n")[0], user.lower())
        spans = self._spans(user) if stage in ("fingerprints", "privacy_inference", "attack", "compare", "specificity") else []
        if stage == "fingerprints":
            return json.dumps({"fingerprints": spans})
        if stage in ("privacy_inference", "attack"):
            empty = {"inference": "", "guesses": [], "certainty": 1, "evidence_spans": []}
            return json.dumps({a[0]: empty for a in dims.ATTRIBUTES} | {"LOC": {"inference": "contact details", "guesses": [], "certainty": 5 if spans else 1, "evidence_spans": spans}})
        if stage == "rewrite":
            return "Contact details are generalised.\n#\n" + self.PERSONAL.sub("a contact", user)
        if stage == "refill":
            return json.dumps({k: "a detail" for k in dict.fromkeys(re.findall(r"MASK_\d+", user))})
        if stage == "compare":
            return json.dumps({"LOC": {"leaked": bool(spans), "severity": 3 if spans else 0, "evidence_spans": spans}})
        if stage == "specificity":
            return json.dumps({"dimensions": {k: {"too_specific": k == "REGION_TYPE" and bool(spans)} for k in dims.SPECIFICITY}})
        if stage == "keeper":
            return json.dumps({k: {"preserved": True, "loss_severity": 0} for k in dims.UTILITY} | {"total_loss": user.count("a detail")})
        if stage == "expand_attributes":
            labels = dict.fromkeys(c.get("identity_label", "") for c in json.loads(user.rpartition("\n")[2] or "[]"))
            return json.dumps({"attributes": [{"key": x, "display_name": x, "target_str": x} for x in labels if x]})
        if stage == "round_inference":
            return "\n".join(f"Type: {a[1]}\nInference: none\nGuess: a; b; c\nCertainty: 1" for a in dims.ATTRIBUTES)
        return "{}"


BACKENDS: dict[str, Callable[[], Backend]] = {"replay": ReplayBackend, "rules": RuleBackend}


def register(name: str, make: Callable[[], Backend]) -> None:
    """Make a backend known by a name. What make() returns goes to executors, so it has to be picklable."""
    BACKENDS[name] = make


def backend(name: str) -> Backend:
    """The backend of a name; fails for names that aren't known."""
    if name not in BACKENDS:
        raise ValueError(f"unknown backend {name!r}; known are {', '.join(sorted(BACKENDS))}")
    return BACKENDS[name]()


@dataclass(frozen=True)
class Calls:
    """tries and wait: attempts at a call, and seconds before the second, growing to 8; at_once: calls made at a time
    (partitions), 0 for as many as the requests have."""

    tries: int = 3
    wait: float = 0.0
    at_once: int = 0


def requests(df: DataFrame, stage: str, model: str, doc_key: Column, user: Column, version: str = SCHEMA_VERSION) -> DataFrame:
    """cache_key, stage, model, schema_version, doc_key, system, user for each row of df."""
    r = df.select(F.lit(stage).alias("stage"), F.lit(model).alias("model"), F.lit(version).alias("schema_version"), doc_key.cast("string").alias("doc_key"), F.lit(STAGES[stage].system if stage in STAGES else "").alias("system"), user.alias("user"))
    key = T.content_hash(**{c: F.col(c) for c in ("stage", "model", "schema_version", "doc_key", "system", "user")})
    return r.select(key.alias("cache_key"), *r.columns)


def replayed(reqs: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests with raw and error of their recorded response, and hit."""
    r = responses.select("cache_key", "raw", "error", F.lit(True).alias("hit")).dropDuplicates(["cache_key"])
    return reqs.join(r, "cache_key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def unanswered(reqs: DataFrame, responses: DataFrame, retry_errors: bool = True) -> DataFrame:
    """Requests without a recorded response (or with an error only)."""
    done = responses.where("error is null") if retry_errors else responses
    return reqs.join(done.select("cache_key"), "cache_key", "left_anti")


def _tried(call: Callable[[], str], calls: Calls) -> tuple[str | None, str | None]:
    """(answer, error) of a call; one that fails for good has no answer."""
    error = None
    for n in range(1, calls.tries + 1):
        try:
            return call(), None
        except Exception as e:  # noqa: BLE001  whatever a backend raises is that request's error
            error = f"{type(e).__name__}: {e}"
            if isinstance(e, LookupError):
                break
            time.sleep(min(calls.wait * n, 8))
    return None, error


def key_about(stage: str, model: str, doc_key: Column, context: Column, digest: Column, version: str = SCHEMA_VERSION) -> Column:
    """The cache key of a request that is one of many about a text: it has the text's digest in the text's place, so a text
    is hashed once."""
    parts = {"stage": F.lit(stage), "model": F.lit(model), "schema_version": F.lit(version), "system": F.lit(STAGES[stage].system)}
    return T.content_hash(**parts, doc_key=doc_key, context=context, text_sha256=digest)


def called_about(rows: DataFrame, stage: str, model: str, backend: Backend, calls: Calls = Calls()) -> DataFrame:
    """rows (text, items, an array of structs with context, and other columns) as one row for each item, with raw and error of
    the answer to prompt(text, context). A text goes to Python once for all its items, and nothing else holds a text for
    each."""
    system, rest = STAGES[stage].system, [f for f in rows.schema if f.name not in ("text", "items")]
    fields = rows.schema["items"].dataType.elementType.fields
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*rest, *fields]) + ", raw string, error string"

    def answers(contexts: list[str], text: str) -> list[tuple[str | None, str | None]]:
        if (many := getattr(backend, "answer_many", None)) and (got := _tried(lambda: many(stage, model, system, contexts, text), Calls(1))[0]) is not None:
            return [(x, None) for x in got]
        return [_tried(lambda: backend.answer(stage, model, system, f"{c}\n{TEXT}\n{text}" if c else text), calls) for c in contexts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("items")
            said: list[tuple[str | None, str | None]] = []
            for text, items in zip(b.column("text"), lists, strict=True):
                said += answers(items.values.field("context").to_pylist(), text.as_py())
            of, flat = pc.list_parent_indices(lists), dict(zip([f.name for f in lists.type.value_type], lists.flatten().flatten(), strict=True))
            cols = {f.name: b.column(f.name).take(of) for f in rest} | flat
            cols |= {n: pa.array([x[i] for x in said], pa.string()) for i, n in enumerate(("raw", "error"))}
            yield pa.RecordBatch.from_pydict(cols)

    return (rows.repartition(calls.at_once) if calls.at_once else rows).mapInArrow(run, schema)


def called(reqs: DataFrame, backend: Backend, calls: Calls = Calls()) -> DataFrame:
    """Responses of a backend to requests; a call that fails for good has its error and no text."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for r in p.itertuples(index=False):
                raw, error = _tried(lambda: backend.answer(r.stage, r.model, r.system, r.user), calls)  # noqa: B023  called at once
                out.append((r.cache_key, raw, error, pd.Timestamp.now("UTC")))
            yield pd.DataFrame(out, columns=["cache_key", "raw", "error", "created_at"])

    return (reqs.repartition(calls.at_once) if calls.at_once else reqs).mapInPandas(run, RESPONSE)


def answered(reqs: DataFrame, backend: Backend, responses: DataFrame | None = None, calls: Calls = Calls()) -> tuple[DataFrame, DataFrame]:
    """(requests with raw and error, new responses): recorded responses first, the backend for the rest. The new responses
    are stored before anything reads them, so each request is asked once and all readers see the same answer. reqs is
    computed more than once; what it is made from should be a table."""
    new = stored(called(reqs if responses is None else unanswered(reqs, responses), backend, calls), "responses")
    both = new.select("cache_key", "raw", "error")
    if responses is not None:
        both = responses.where("error is null").select("cache_key", "raw", "error").unionByName(both)
    return reqs.join(both.dropDuplicates(["cache_key"]), "cache_key", "left"), new


def parsed(df: DataFrame, schema: str, column: str = "raw", out: str = "answer", stage: str = "") -> DataFrame:
    """df with the answer's JSON as a struct, read in the stage's parse mode."""
    mode = STAGES[stage].parse_mode if stage in STAGES else "recover"
    if mode in ("fenced", "outer"):
        return df.withColumn(out, F.from_json((fill_json if mode == "fenced" else outer_json)(F.col(column)), schema))
    strict = F.from_json(F.when(F.try_parse_json(column).isNotNull(), F.col(column)), schema)
    # what parses goes to Python as a null, so that only the other answers are sent there and read again
    return df.withColumn(out, strict).withColumn(out, F.coalesce(out, F.from_json(json_recover(F.when(F.col(out).isNull(), F.col(column))), schema)))


def health(spark, backend: Backend, model: str) -> str:
    """The text of one call; fails if it is empty."""
    raw = backend.answer("smoke", model, "Answer with OK.", "OK?")
    if not (raw or "").strip():
        raise RuntimeError(f"{model} answered nothing")
    return raw


def first_candidates(trace: Column) -> Column:
    """identifier_candidates, as JSON, of the first message of a response trace (an array of texts) that has them."""
    found = F.filter(F.transform(trace, lambda t: F.to_json(F.try_variant_get(F.try_parse_json(t), "$.identifier_candidates", "array<variant>"))), lambda x: x.isNotNull())
    return F.coalesce(F.get(found, 0), F.lit("[]"))
