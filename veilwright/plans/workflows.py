"""The public workflows: anonymise transcripts, compare re-identification results, judge recoverability."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwright import dims
from veilwright.functions import text as T
from veilwright.functions.udfs import parse_inference
from veilwright.operators import attributes as A
from veilwright.operators import compare, facts, leakage, masking, recover, selection
from veilwright.plans.models import Backend, Calls, ReplayBackend, answered, called, called_about, key_about, parsed, prompt, requests, unanswered
from veilwright.session import checkpointed, stored

INFERENCES = leakage.INFERENCES
TOPIC = "primary_topic string, secondary_context string, preserve_focus array<string>, generalize_focus array<string>"
VULNERABILITY = "map<string,string>"
DIMENSIONS = "dimensions map<string,struct<too_specific:boolean,rationale:string,evidence_spans:array<string>>>, too_specific_count string"

#: A text of more than PIECE characters is sent with a share of its items to each of several tasks, PIECES at most.
PIECE, PIECES = 1 << 16, 8


class Scope(Enum):
    """Which attributes are looked at: the base and those found per document, the base only, or only those found."""

    ADAPTIVE = "adaptive"
    BASE_ONLY = "base"
    PURE = "pure"


@dataclass(frozen=True)
class Options:
    model: str = "rules"
    rounds: int = 5
    variations: int = 4
    too_specific_cap: int = dims.TOO_SPECIFIC_MOST
    certainty: int = dims.CERTAINTY_LEAST
    gap_words: int = 2
    most_tokens: int | None = None
    scope: Scope = Scope.ADAPTIVE
    max_new: int = 12
    max_total: int = 12
    feedback_rounds: int = 0
    reid_threshold: str = "medium"
    calls: Calls = field(default_factory=Calls)


def pure_adaptive(**changes) -> Options:
    """The options of runs that protect only what was found for each document."""
    return Options(**({"scope": Scope.PURE, "max_new": 4, "max_total": 12} | changes))


def _ask(df: DataFrame, stage: str, user: Column, key: Column, backend: Backend, o: Options, responses: DataFrame | None, keep: list[str]) -> DataFrame:
    """df's columns keep with raw and error of a stage's answers. The key names rows of df."""
    keyed = df.select(*keep, key.cast("string").alias("_key"), user.alias("_user"))
    got, _ = answered(requests(keyed, stage, o.model, F.col("_key"), F.col("_user")), backend, responses, o.calls)
    return keyed.join(got.select(F.col("doc_key").alias("_key"), "raw", "error"), "_key", "left").drop("_key", "_user")


def scoped(docs: DataFrame, scopes: DataFrame | None, o: Options = Options()) -> DataFrame:
    """docs with scope, the list of attributes that a document is protected for: what scopes (document_id, scope) says. The
    base stands for documents that it leaves out; in a pure run these have none."""
    if o.scope is Scope.PURE and scopes is None:
        raise ValueError("a pure run needs the scopes that were found for its documents")
    other = F.array().cast(A.LIST) if o.scope is Scope.PURE else A.base_list()
    if scopes is None or o.scope is Scope.BASE_ONLY:
        return docs.withColumn("scope", other)
    return docs.join(scopes.select("document_id", "scope"), "document_id", "left").withColumn("scope", F.coalesce("scope", other))


def _keys(scope: str | Column) -> Column:
    return F.transform(scope, lambda a: a["key"])


def initialized(docs: DataFrame, backend: Backend, o: Options = Options(), responses: DataFrame | None = None, scopes: DataFrame | None = None) -> DataFrame:
    """docs (document_id, text; one row a document) with scope, inferences, evidence_spans, topic_focus, insight_profile,
    fingerprints (ten at most) and status."""
    d = scoped(docs.select("document_id", "text"), scopes, o)
    inf = parsed(_ask(d, "privacy_inference", prompt(F.col("text"), T.scope_text(F.col("scope"))), F.col("document_id"), backend, o, responses, ["document_id", "text", "scope"]), INFERENCES, out="inferences")
    inf = inf.select("document_id", "text", "scope", F.coalesce("inferences", F.from_json(F.lit("{}"), INFERENCES)).alias("inferences"), "error")
    spans = leakage.evidence_spans(inf.select("document_id", "inferences", _keys("scope").alias("_k")), "inferences", F.col("_k"), o.certainty).drop("_k")
    spans = spans.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "span"))), lambda x: x["span"]).alias("evidence_spans"))
    topic = _ask(docs, "topic_focus", F.col("text"), F.col("document_id"), backend, o, responses, ["document_id", "text"]).select("document_id", "text", F.col("raw").alias("topic_focus"))
    profile = _ask(parsed(topic, TOPIC, "topic_focus", "_t"), "utility_summary", prompt(F.col("text"), T.topic_text(F.col("_t"))), F.col("document_id"), backend, o, responses, ["document_id"]).select("document_id", F.col("raw").alias("insight_profile"))
    out = inf.join(spans, "document_id", "left").join(topic.select("document_id", "topic_focus"), "document_id", "left").join(profile, "document_id", "left")
    out = out.join(fingerprints(docs, backend, o, responses), "document_id", "left")
    none = {c: F.coalesce(c, dims.text_array(())) for c in ("evidence_spans", "fingerprints")}
    return out.withColumns(none).withColumn("status", F.when(F.col("error").isNull(), "initialized").otherwise("failed"))


def fingerprints(docs: DataFrame, backend: Backend, o: Options = Options(), responses: DataFrame | None = None, most: int = 10) -> DataFrame:
    """document_id, fingerprints: the phrases that could single a speaker out, in the answer's order. Those of 3 characters
    or more, one of each in any case, `most` at most. A failed call gives none."""
    got = parsed(_ask(docs, "fingerprints", F.col("text"), F.col("document_id"), backend, o, responses, ["document_id"]), "fingerprints array<string>", out="f")
    each = got.select("document_id", F.posexplode("f.fingerprints").alias("pos", "phrase"))
    first = selection.top_n_values(each, ["document_id"], "phrase", "pos", most)
    return first.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "phrase"))), lambda x: x["phrase"]).alias("fingerprints"))


def converged(docs: DataFrame, backend: Backend, o: Options = Options(), responses: DataFrame | None = None, cut=None) -> DataFrame:
    """docs (document_id, text, scope) with rewritten after a fixed number of rounds; a round that fails keeps the text
    before. Requests name the base attributes and the document's own. Between rounds the lineage is cut by `cut` (by default
    a checkpoint in the shared folder)."""
    own = docs.withColumn("_lines", T.scope_text(A.merge(A.base_list(), F.col("scope"))))
    now = own.select("document_id", "text", "_lines", F.col("text").alias("rewritten"))
    rest = ["document_id", "text", "_lines", "rewritten"]
    for i in range(o.rounds):
        key = F.concat_ws("#", "document_id", F.lit(i))
        seen = _ask(now, "round_inference", prompt(F.col("rewritten"), F.col("_lines")), key, backend, o, responses, rest)
        seen = seen.select(*rest, F.coalesce("raw", F.lit("")).alias("inference"))
        new = _ask(seen, "rewrite", prompt(F.col("rewritten"), F.col("_lines"), F.col("inference")), key, backend, o, responses, [*rest, "inference"])
        now = new.select("document_id", "text", "_lines", T.rewritten_part(F.col("raw"), F.col("rewritten")).alias("rewritten"), parse_inference(F.col("inference")).alias("last_inference"))
        now = (cut or checkpointed)(now) if i + 1 < o.rounds else now
    return (now if o.rounds else now.withColumn("last_inference", parse_inference(F.lit("")))).drop("_lines")


def refilled(masked: DataFrame, backend: Backend, o: Options = Options(), responses: DataFrame | None = None) -> DataFrame:
    """masked (document_id, template, masks; topic_focus and insight_profile, if there are such) with idx and variation,
    o.variations rows each; failed ones are left out."""
    context = []
    if "topic_focus" in masked.columns:
        masked = parsed(masked, TOPIC, "topic_focus", "_t")
        context += [T.topic_text(F.col("_t")), T.strip(F.col("insight_profile"))]
    each = masked.where(F.size("masks") > 0).select("document_id", "template", "masks", F.concat_ws("\n", *context).alias("_context"), F.explode(F.sequence(F.lit(0), F.lit(o.variations - 1))).alias("idx"))
    user = prompt(F.concat_ws("\n", F.lit(0).cast("string"), "template", F.col("idx").cast("string")), F.col("_context"))
    got = _ask(each, "refill", user, F.concat_ws("#", "document_id", "idx"), backend, o, responses, ["document_id", "template", "masks", "idx"])
    got = parsed(got.where("error is null"), "map<string,string>", out="fills", stage="refill").where("fills is not null")
    return got.select("document_id", "idx", masking.assembled(F.col("template"), F.col("masks"), F.col("fills")).alias("variation"))


def evaluated(variations: DataFrame, docs: DataFrame, backend: Backend, o: Options = Options(), responses: DataFrame | None = None) -> DataFrame:
    """variations (document_id, idx, variation) with severity, loss and too_specific; a failed call gives null, which
    selection counts as 999."""
    on = ["document_id", "idx"]
    key = F.concat_ws("#", *on)
    scope = "scope" if "scope" in docs.columns else A.base_list()
    v = variations.join(docs.select("document_id", "text", F.col("inferences").alias("before"), F.transform(scope, lambda a: a).alias("scope")), "document_id")
    rest = [*on, "text", "before", "variation", "scope"]
    attack = parsed(_ask(v, "attack", prompt(F.col("variation"), T.scope_text(F.col("scope"))), key, backend, o, responses, rest), INFERENCES, out="after").drop("raw", "error")
    user = prompt(F.col("variation"), F.lit("Before"), T.inference_text(F.col("before")), F.lit("After"), T.inference_text(F.col("after")))
    compared = parsed(_ask(attack, "compare", user, key, backend, o, responses, rest), VULNERABILITY, out="report")
    compared = compared.select(*rest, "report", F.col("error").alias("compare_error"))
    spans = leakage.evidence_spans(compared.select(*on, "before", _keys("scope").alias("_k")), "before", F.col("_k"), o.certainty).drop("_k")
    leaks = leakage.leak_totals(leakage.span_leakage(spans, compared.select(*on, F.col("variation").alias("text")), on), on).select(*on, "total_span_severity", "num_span_leaks")
    spec = parsed(_ask(compared, "specificity", F.col("variation"), key, backend, o, responses, on), DIMENSIONS, out="spec")
    spec = leakage.specificity(spec.select(*on, "spec.too_specific_count", "spec.dimensions").withColumnRenamed("too_specific_count", "claimed"), "claimed", "dimensions").select(*on, "too_specific_count")
    kept = parsed(_ask(compared, "keeper", F.concat_ws("\n", "text", "variation"), key, backend, o, responses, on), VULNERABILITY, out="kept").select(*on, "kept", F.col("error").alias("keeper_error"))

    def field_of(column: str, name: str, keys: Column) -> Column:
        return F.transform(keys, lambda k: F.get_json_object(F.try_element_at(column, k), f"$.{name}"))

    j = compared.join(leaks, on, "left").join(spec, on, "left").join(kept, on, "left")
    sev = leakage.total_severity(F.try_element_at("report", F.lit("total_severity")), field_of("report", "severity", _keys("scope")), F.col("total_span_severity"))
    strict = leakage.total_severity_strict(field_of("report", "severity", _keys("scope")), F.col("total_span_severity"))
    loss = leakage.total_loss(F.try_element_at("kept", F.lit("total_loss")), field_of("kept", "loss_severity", dims.text_array(dims.UTILITY)))
    return j.select(
        *on, "variation", F.when(F.col("compare_error").isNull(), sev).alias("severity"), strict.alias("severity_strict"), F.coalesce("num_span_leaks", F.lit(0)).alias("num_span_leaks"),
        F.when(F.col("keeper_error").isNull(), loss).alias("loss"), F.col("too_specific_count").alias("too_specific"),
    )


def anonymize(docs: DataFrame, backend: Backend, o: Options = Options(), responses: DataFrame | None = None, cut=None, scopes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, iterations) of a run over docs (document_id, text; one row a document): all documents go through each
    stage together. scopes (document_id, scope) are the attributes that a document is protected for, by default the base.

    A document without masks ends as a success with its own text, score 999 and was_masked false; one without
    variations keeps its mask tokens wherever the rewrite has no words for them. One whose inference failed is failed, as is
    one whose rewrite was not compared (more tokens than o.most_tokens, where that is given).
    """
    cut = cut or checkpointed
    init = cut(initialized(docs, backend, o, responses, scopes))
    conv = converged(init.where("status = 'initialized'").select("document_id", "text", "scope"), backend, o, responses, cut)
    with_spans = conv.join(init.select("document_id", "evidence_spans", "topic_focus", "insight_profile"), "document_id")
    masked = cut(masking.masked(with_spans, "text", "rewritten", "evidence_spans", o.gap_words, o.most_tokens))
    scored = cut(evaluated(refilled(masked, backend, o, responses), init, backend, o, responses))
    best = selection.best_variation(scored, ["document_id"], o.too_specific_cap)
    chosen = best.join(scored.withColumnRenamed("idx", "best_idx"), ["document_id", "best_idx"], "left")
    out = init.select("document_id", "text", "scope", "evidence_spans", "fingerprints", "status").join(masked.select("document_id", "template", "masks", "was_masked", "skipped"), "document_id", "left").join(chosen, "document_id", "left")
    final = F.when(~F.col("was_masked"), F.col("text")).otherwise(F.coalesce("variation", masking.unrefilled(F.col("template"), F.col("masks"))))
    failed = (F.col("status") == "failed") | F.coalesce("skipped", F.lit(False))
    documents = out.select(
        "document_id", F.col("text").alias("original_text"), "evidence_spans", F.when(~failed, final).alias("final_text"),
        F.coalesce(F.col("severity"), F.lit(dims.MISSING_SCORE)).cast("double").alias("final_privacy_score"), F.when(failed, "failed").otherwise("success").alias("status"),
        F.coalesce("was_masked", F.lit(False)).alias("was_masked"), "scope", "fingerprints",
    )
    texts = scored.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "variation"))), lambda x: x["variation"]).alias("variations"))
    iterations = masked.join(texts, "document_id", "left").join(best.select("document_id", "best_idx"), "document_id", "left").select(
        "document_id", F.lit(1).alias("iteration_num"), F.col("template").alias("template_text"),
        F.transform("masks", lambda m: F.struct(m["key"].alias("key"), m["original"].alias("original"))).alias("mask_map"), "variations", F.col("best_idx").alias("best_variation_idx"),
    )
    return documents, iterations


def expanded(docs: DataFrame, candidates: DataFrame, backend: Backend, o: Options = Options(), responses: DataFrame | None = None, probe=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, iterations, scopes) of a run whose documents are protected for the attributes that a model finds in their
    re-identification candidates (document_id, candidates), as o.scope says: besides the base, or only for these; a run for
    the base only asks for none. With probe and o.feedback_rounds, feedback() follows."""
    if o.scope is Scope.BASE_ONLY:
        scopes = docs.select("document_id", F.array().cast(A.LIST).alias("found"), A.base_list().alias("scope"))
    else:
        scopes = stored(dynamic_scopes(docs, candidates, backend, o, responses), "scopes")
    documents, iterations = anonymize(docs, backend, o, responses, scopes=scopes)
    if probe is not None and o.feedback_rounds:
        again = lambda d, more: anonymize(d.select("document_id", F.col("original_text").alias("text")), backend, o, responses, scopes=more)[0]
        documents = feedback(stored(documents, "documents"), probe, scopes, backend, o, again)
    return documents, iterations, scopes


def dynamic_scopes(docs: DataFrame, candidates: DataFrame, backend: Backend, o: Options = Options(), responses: DataFrame | None = None) -> DataFrame:
    """document_id, found, scope: attributes that a model proposes from a document's candidates (an array), less those
    in the base, capped; and the document's attributes with them. A failed call proposes none."""
    base = A.base_list() if o.scope is not Scope.PURE else F.array().cast(A.LIST)
    j = docs.join(candidates, "document_id", "left")
    user = F.concat_ws("\n", T.truncate(F.col("text"), 7000), F.to_json(selection.evidence_for_prompt(F.col("candidates"))))
    got = _ask(j, "expand_attributes", user, F.col("document_id"), backend, o, responses, ["document_id"])
    got = parsed(got, f"attributes {A.LIST}", out="p")
    found = A.capped(A.added(base, A.coerce_all(F.coalesce("p.attributes", F.array().cast(A.LIST))), o.max_new), base, o.max_total)
    found = found if o.scope is not Scope.BASE_ONLY else F.array().cast(A.LIST)
    return got.select("document_id", found.alias("found"), A.scope(base, found).alias("scope"))


def feedback(docs: DataFrame, probe, scopes: DataFrame, backend: Backend, o: Options, rewrite) -> DataFrame:
    """Rounds of feedback: results of probe(documents) (document_id, candidates) flag documents that are still
    identified; those for which further attributes are found are rewritten (rewrite(documents, scopes)) and take the
    place of the old. Ends when none is flagged, none is added, or after o.feedback_rounds."""
    now = docs
    for _ in range(o.feedback_rounds):
        found = probe(now)
        each = found.select("document_id", F.posexplode("candidates").alias("pos", "c")).select("document_id", "pos", "c.*")
        flagged = selection.reidentified(each, ["document_id"], o.reid_threshold)
        if flagged.isEmpty():
            break
        todo = now.join(flagged.select("document_id"), "document_id", "left_semi")
        more = dynamic_scopes(todo.select("document_id", F.col("final_text").alias("text")), found, backend, o)
        more = more.join(scopes.select("document_id", F.col("scope").alias("old")), "document_id").select("document_id", A.merge(F.col("old"), F.col("found")).alias("scope"), "old")
        more = more.where(F.size("scope") > F.size("old")).select("document_id", "scope")
        if more.isEmpty():
            break
        new = rewrite(now.join(more.select("document_id"), "document_id", "left_semi"), more)
        now = now.join(new.select("document_id"), "document_id", "left_anti").unionByName(new)
        scopes = scopes.join(more.select("document_id"), "document_id", "left_anti").unionByName(more, allowMissingColumns=True)
    return now


def reid_compare(rows: DataFrame, reference: str, backend: Backend = ReplayBackend(), o: Options = Options(), responses: DataFrame | None = None, most: int | None = None) -> dict[str, DataFrame]:
    """Compares profiles read off re-identification results.

    rows: transcript_id, label, identifier_candidates. The samples that every label has are ranked, described, split
    into facts by a model, merged and counted; each label is compared with the reference. A candidate with one
    description needs no call to unite it.
    """
    labels = [r[0] for r in rows.select("label").distinct().collect()]
    shared = selection.shared_ids(rows, "transcript_id", "label", labels)
    each = rows.join(shared, "transcript_id").select("transcript_id", "label", F.posexplode("identifier_candidates").alias("pos", "c")).select("transcript_id", "label", "pos", "c.*")
    on = ["transcript_id", "label"]
    ranked = selection.rank_candidates(each, on, most).withColumn("descriptions", facts.descriptions(F.col("names"), F.col("identity_label")))
    many = ranked.where(F.size("descriptions") > 1)
    united = parsed(_ask(many, "merge_descriptions", F.array_join("descriptions", "\n"), F.concat_ws("#", *on, "candidate_index"), backend, o, responses, [*on, "candidate_index", "descriptions"]), "unified_description string", out="u", stage="merge_descriptions")
    longest = lambda d: F.reduce(d, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    united = united.select(*on, "candidate_index", F.coalesce(F.nullif(T.normalize(F.col("u.unified_description")), F.lit("")), longest(F.col("descriptions"))).alias("description"))
    described = ranked.join(united, [*on, "candidate_index"], "left").withColumn("description", F.coalesce("description", F.get("descriptions", 0), F.lit("")))
    conf = described.groupBy(*on).agg(F.map_from_entries(F.collect_list(F.struct("candidate_index", "confidence"))).alias("conf"), F.to_json(F.array_sort(F.collect_list(F.struct("candidate_index", "confidence", "description")))).alias("user"))
    raw = parsed(_ask(conf, "extract_facts", F.col("user"), F.concat_ws("#", *on), backend, o, responses, [*on, "conf"]), "map<string,array<struct<fact:string,supporting_candidates:array<string>,source_fields:array<string>>>>", out="p", stage="extract_facts")
    found = raw.select(*on, "conf", F.explode("p").alias("attribute_key", "items")).select(*on, "conf", "attribute_key", F.posexplode("items").alias("pos", "f"))
    found = found.where(F.col("attribute_key").isin([a[0] for a in dims.ATTRIBUTES])).select(
        *on, "attribute_key", F.col("pos").cast("long").alias("pos"), F.col("f.fact").alias("fact"), facts.candidate_indices(F.coalesce("f.supporting_candidates", dims.text_array(())), F.map_keys("conf")).alias("supporting_candidates"),
        facts.source_fields(F.col("f.source_fields")).alias("source_fields"), "conf",
    )
    found = facts.expand(found, "attribute_key", "fact").withColumn("pos", F.col("pos") * 64 + F.col("part")).drop("part")
    confs = F.transform("supporting_candidates", lambda i: F.try_element_at("conf", i))
    found = found.withColumn("confidences", confs).withColumn("confidence_weight", F.coalesce(F.array_max(F.transform("confidences", T.confidence_weight)), F.lit(0.0))).drop("conf")
    by = [*on, "attribute_key"]
    merged = facts.merge_by_key(found, by, weight="confidence_weight", support=["supporting_candidates", "source_fields", "confidences"])
    kept = facts.dedupe_overlapping(merged, by)
    counts = compare.zero_filled(compare.profile_counts(kept, on), on)
    totals = compare.profile_totals(counts, on)
    return {
        "missing": selection.missing_inputs(rows, "transcript_id", "label", labels), "candidates": described, "facts": kept, "counts": counts, "totals": totals,
        "by_attribute": compare.against_reference(counts, ["transcript_id", "attribute_key"], "label", reference, ["count", "weighted_count"]),
        "by_sample": compare.against_reference(totals, ["transcript_id"], "label", reference, ["total_atomic_facts", "confidence_weighted_total"]),
        "summary": compare.dataset_summary(counts, "transcript_id", "label"), "preservation": compare.preservation(totals, "transcript_id", "label", reference),
    }


def reference_profiles(texts: DataFrame, backend: Backend, o: Options = Options(), responses: DataFrame | None = None) -> DataFrame:
    """Facts of the original transcripts (transcript_id, text): a summary for each attribute, kept if its quote is in
    the transcript, cleaned, split into facts, and merged where a model proposes it and the rule allows it."""
    each = texts.select("transcript_id", "text", F.explode(A.base_list()).alias("a")).select("transcript_id", "text", F.col("a.key").alias("attribute_key"), T.scope_text(F.array("a")).alias("about"))
    on = ["transcript_id", "attribute_key"]
    key = F.concat_ws("#", *on)
    s = parsed(_ask(each, "attribute_summary", prompt(F.col("text"), F.col("about")), key, backend, o, responses, [*on, "text", "about"]), "supported boolean, summary_description string, evidence_quote string", out="s", stage="attribute_summary")
    s = s.select(*on, "about", F.coalesce("s.supported", F.lit(False)).alias("supported"), T.normalize(F.col("s.summary_description")).alias("summary"), F.when(T.quote_supported(F.col("text"), F.col("s.evidence_quote")), F.col("s.evidence_quote")).otherwise("").alias("evidence_quote"))
    s = s.where("supported and summary <> ''")
    clean = parsed(_ask(s, "summary_sanity", prompt(F.col("summary"), F.col("about")), key, backend, o, responses, [*on, "about", "summary", "evidence_quote"]), "summary_description string", out="c", stage="summary_sanity")
    clean = clean.select(*on, "about", "evidence_quote", F.coalesce(F.nullif(T.normalize(F.col("c.summary_description")), F.lit("")), "summary").alias("summary_description"))
    f = parsed(_ask(clean, "summary_facts", prompt(F.col("summary_description"), F.col("about")), key, backend, o, responses, [*on, "summary_description"]), "facts array<string>", out="f", stage="summary_facts")
    f = f.select(*on, F.posexplode("f.facts").alias("pos", "fact"))
    f = facts.expand(f, "attribute_key", "fact").withColumn("pos", F.col("pos").cast("long") * 64 + F.col("part")).drop("part")
    first = facts.merge_by_key(f, on)
    ready = first.select(*on, "fact", "pos", F.array().cast("array<int>").alias("supporting_candidates"), F.array(F.lit("attribute_summary")).alias("source_fields"), dims.text_array(()).alias("confidences"), F.lit(0.0).alias("confidence_weight"))
    kept = facts.dedupe_overlapping(ready, on)
    order = dims.attributes(texts.sparkSession).select(F.col("key").alias("attribute_key"), F.col("pos").alias("attribute_pos"))
    ided = facts.numbered(kept.join(F.broadcast(order), "attribute_key"), ["transcript_id"], "attribute_key", ["rank"]).withColumn("pos", F.col("attribute_pos") * 10_000 + F.col("rank"))
    user = ided.groupBy("transcript_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("pos", "fact_id", "attribute_key", "fact")))).alias("user"))
    p = parsed(_ask(user, "merge_facts", F.col("user"), F.col("transcript_id"), backend, o, responses, ["transcript_id"]), "merged_facts array<struct<primary_attribute_key:string,fact:string,source_fact_ids:array<string>>>", out="m", stage="merge_facts")
    p = p.select("transcript_id", F.posexplode("m.merged_facts").alias("group_pos", "g")).select("transcript_id", "group_pos", "g.source_fact_ids", F.col("g.primary_attribute_key").alias("attribute_key"), "g.fact")
    return facts.merge_groups(ided.select("transcript_id", "fact_id", "attribute_key", "fact", "pos"), p, ["transcript_id"])


def judged(items: DataFrame, texts: DataFrame, stage: str, backend: Backend, o: Options = Options(), responses: DataFrame | None = None, extra: list[str] = ()) -> DataFrame:
    """items (transcript_id, config, item_id, fact) with decision, evidence_quote, reasoning, error. Each is one request with
    its configuration's whole text (config, transcript_id, text). A text meets its items in a row, or, if it is long, in up to
    PIECES rows, so what is moved, hashed and normalised is a text and its items, never a text for each item."""
    on = ["config", "transcript_id"]
    t = texts.select(*on, "text", (F.least(F.length("text") / F.lit(PIECE), F.lit(PIECES - 1)).cast("int") + 1).alias("_pieces"))
    context = F.concat_ws("\n", *[F.nullif(F.col(c), F.lit("")) for c in ("fact", *extra)])
    j = items.join(t.select(*on, "_pieces", F.sha2("text", 256).alias("_digest")), on)
    j = j.select(*items.columns, context.alias("context"), F.pmod(F.xxhash64("item_id"), "_pieces").cast("int").alias("_piece"), "_digest")
    key = key_about(stage, o.model, F.concat_ws("#", "transcript_id", "config", "item_id"), F.col("context"), F.col("_digest"))
    j = j.withColumn("cache_key", key).drop("_digest")
    asked = j if responses is None else unanswered(j, responses)
    rest = [c for c in asked.columns if c not in (*on, "_piece")]
    rows = asked.groupBy(*on, "_piece").agg(F.collect_list(F.struct(*rest)).alias("items"))
    rows = rows.join(t.select(*on, "text", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)).alias("_piece")), [*on, "_piece"]).drop("_piece")
    got = stored(called_about(rows, stage, o.model, backend, o.calls), "responses").select(*items.columns, "raw", "error")
    if responses is not None:
        old = responses.where("error is null").select("cache_key", "raw", "error").dropDuplicates(["cache_key"])
        got = got.unionByName(j.join(old, "cache_key").select(*items.columns, "raw", "error"))
    got = parsed(got, "decision string, reasoning string, evidence_quote string", out="j", stage=stage)
    got = stored(got.select(*items.columns, "j.decision", "j.evidence_quote", "j.reasoning", "error", T.quote_key(F.col("j.evidence_quote")).alias("quote_key")), "answers")
    held = recover.supported_quotes(got.where(F.col("decision") == dims.DECISIONS["yes"]), texts, on).withColumn("_held", F.lit(True))
    d = recover.decided(F.col("decision"), F.coalesce("_held", F.lit(False)))
    got = got.join(held, [*on, "quote_key"], "left")
    return got.select(*items.columns, F.when(F.col("error").isNull(), d).otherwise(dims.DECISIONS["unsure"]).alias("decision"), "evidence_quote", "reasoning", "error")


def profile_recoverability(facts_: DataFrame, texts: DataFrame, backend: Backend, o: Options = Options(), responses: DataFrame | None = None) -> dict[str, DataFrame]:
    """items, by_attribute, by_sample, by_config: whether facts (transcript_id, fact_id, attribute_key, fact) can be
    recovered from the configurations' texts (config, transcript_id, text)."""
    each = recover.fact_configs(facts_.withColumnRenamed("fact_id", "item_id"), texts.select("config", "transcript_id", "text"))
    items = stored(judged(each.select("transcript_id", "config", "item_id", "attribute_key", "fact"), texts, "judge_fact", backend, o, responses), "items")
    dim = dims.attributes(facts_.sparkSession)
    return {
        "items": items, "by_attribute": recover.by_attribute(items, ["config"], dim), "by_sample": recover.overall(items, ["config", "transcript_id"]),
        "by_config": recover.overall(items, ["config"], "transcript_id"),
    }


def code_fact_recoverability(facts_: DataFrame, texts: DataFrame, backend: Backend, o: Options = Options(), responses: DataFrame | None = None) -> dict[str, DataFrame]:
    """items, cube, by_code: the same for coded facts (transcript_id, facts array), by code and category."""
    flat = facts_.select("transcript_id", F.posexplode("facts").alias("item_id", "f")).select("transcript_id", "item_id", "f.*")
    flat = flat.withColumn("code_id", recover.known_code(F.col("code_id"))).withColumn("category_id", recover.known_code(F.col("category_id")))
    each = recover.fact_configs(flat, texts.select("config", "transcript_id", "text"))
    cols = ["transcript_id", "config", "item_id", "code_id", "category_id", "code_label", "category_label", "code_definition", "fact"]
    items = stored(judged(each.select(*cols), texts, "judge_code_fact", backend, o, responses, extra=["code_label", "code_definition"]), "items")
    cubed = recover.cube(items, [["config"], ["config", "code_id"], ["config", "category_id"], ["code_id"]], "transcript_id")
    return {"items": items, "cube": cubed, "by_code": recover.code_overview(cubed), "labels": recover.code_labels(items, "code_id", "code_label", "item_id")}


def todo(reqs: DataFrame, responses: DataFrame, backend: Backend, o: Options = Options()) -> DataFrame:
    """New responses to the requests that have none."""
    return called(unanswered(reqs, responses), backend, o.calls)


def report(results: dict[str, DataFrame], rows: int = 40) -> str:
    """The first rows of each of a workflow's tables, as text for a console."""
    return "\n".join(f"== {name}\n{df.limit(rows).toPandas().to_string(index=False)}\n" for name, df in results.items())
