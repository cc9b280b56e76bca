"""Scalar text functions as column expressions. They stay in the JVM and inside whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilwright import dims

#: All Unicode white space, in a form that both Java's and RE2's patterns read alike.
SPACE = r"[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{001C}-\x{001F}]"


#: The same characters, one by one.
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(BLANKS))


def normalize(c: Column) -> Column:
    """White space collapsed to single blanks and stripped; null is ''."""
    return F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), f"{SPACE}+", " "))


def normalize_repr(c: Column) -> Column:
    """normalize(), but null is 'None'."""
    return normalize(F.coalesce(c, F.lit("None")))


def plain(c: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as single blanks, stripped; null is ''."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def for_match(c: Column) -> Column:
    return F.lower(normalize(c))


def dataset_id(c: Column) -> Column:
    return F.lower(normalize(c))


def fact_key(c: Column) -> Column:
    """plain(): white space needs no pass of its own, as it goes with all else that is no letter or digit."""
    return plain(c)


def slug(c: Column) -> Column:
    s = F.lower(F.btrim(F.regexp_replace(c, "[^a-zA-Z0-9]+", "_"), F.lit("_")))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("run"))


def sample_slug(c: Column) -> Column:
    s = F.btrim(F.regexp_replace(strip(F.coalesce(c, F.lit("None"))), "[^A-Za-z0-9_.-]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("sample"))


def file_prefix(c: Column, default: str = "nobranch") -> Column:
    s = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), "[^a-zA-Z0-9_.-]+", "_")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(default))


def attribute_key(c: Column) -> Column:
    k = F.btrim(F.regexp_replace(F.upper(strip(F.coalesce(c, F.lit("None")))), "[^A-Z0-9]+", "_"), F.lit("_"))
    return F.substring(F.when(k.rlike("^[0-9]"), F.concat(F.lit("A_"), k)).otherwise(k), 1, 16)


def type_name(target: Column, fallback: Column) -> Column:
    t = F.btrim(F.regexp_replace(F.lower(strip(target)), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.substring(F.coalesce(F.nullif(t, F.lit("")), F.lower(strip(fallback))), 1, 36)


def truncate(c: Column, most: int) -> Column:
    s = strip(F.coalesce(c, F.lit("")))
    head = F.rtrim(F.substring(s, 1, most - 18), F.lit(BLANKS))
    return F.when(F.length(s) <= most, s).otherwise(F.concat(head, F.lit("\n...[truncated]")))


def confidence_rank(c: Column) -> Column:
    """1 to 5; 0 for other labels."""
    return F.array_position(dims.text_array(dims.CONFIDENCE), for_match(c)).cast("int")


def confidence_weight(c: Column) -> Column:
    return F.round(confidence_rank(c) / F.lit(5.0), 3)


def certainty(c: Column) -> Column:
    """The first run of digits, from 1 to 5; 1 without any."""
    n = F.nullif(F.regexp_extract(F.coalesce(c.cast("string"), F.lit("1")), "([0-9]+)", 1), F.lit("")).try_cast("int")
    return F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(n, F.lit(1))))


def without_thoughts(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("<think>")), strip(F.regexp_replace(c, rf"(?s)<think>.*?</think>{SPACE}*", ""))).otherwise(c)


def rewritten_part(raw: Column, fallback: Column) -> Column:
    """What follows the first line that begins with '#', or a leading '#'; the whole if nothing does; the fallback
    if there is no text."""
    s = strip(F.coalesce(raw, F.lit("")))
    first = strip(F.regexp_extract(s, r"(?s)^.*?\n#(.*)$", 1))
    lead = strip(F.regexp_extract(s, r"(?s)^#(.*)$", 1))
    return F.when(s == "", fallback).otherwise(F.coalesce(F.nullif(first, F.lit("")), F.nullif(lead, F.lit("")), s))


def label(c: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def words(c: Column) -> Column:
    """The runs of a-z and 0-9 in a text that is lower case already; an empty array if none."""
    return F.regexp_extract_all(c, F.lit("([a-z0-9]+)"), F.lit(1))


def long_words(c: Column, least: int, stop: tuple[str, ...] = ()) -> Column:
    w = F.filter(words(c), lambda x: F.length(x) >= least)
    return F.array_except(w, dims.text_array(stop)) if stop else F.array_distinct(w)


def overlap_share(needle: Column, hay: Column) -> Column:
    """Share of the words of needle, which are distinct, that hay has; 0 if needle is empty."""
    return F.when(F.size(needle) > 0, F.size(F.array_intersect(needle, hay)) / F.size(needle)).otherwise(F.lit(0.0))


def leak_severity(span: Column, held: Column, n_words: Column, share: Column) -> Column:
    """3 if the plain span stands in the plain text (held), else 2 or 1 by its number of long words and the share of them
    found; 0 otherwise."""
    out = F.when((span != "") & held, 3)
    for severity, least, part in dims.LEAK_TIERS:
        out = out.when((span != "") & (n_words >= least) & (share >= part), severity)
    return out.otherwise(0)


def leak_reason(severity: Column) -> Column:
    return F.when(severity == 3, "exact_span_present").when(severity == 2, "high_token_overlap").when(severity == 1, "partial_token_overlap")


def quote_key(quote: Column) -> Column:
    """A quote as it is looked for: normalised, lower case, without quotes and blanks around it."""
    return F.btrim(for_match(quote), F.lit("\"' "))


def quote_supported(transcript: Column, quote: Column) -> Column:
    """Whether a quote of 8 characters or more, without quotes and blanks around it, stands in the transcript."""
    q = quote_key(quote)
    return (F.length(q) >= 8) & F.contains(for_match(transcript), q)


def overlap_word(w: Column) -> Column:
    w = F.coalesce(F.try_element_at(dims.text_map(dims.FACT_LEMMAS), w), w)
    return (
        F.when(F.endswith(w, F.lit("ies")) & (F.length(w) > 4), F.regexp_replace(w, "ies$", "y"))
        .when(F.endswith(w, F.lit("s")) & (F.length(w) > 3) & ~F.endswith(w, F.lit("ss")), F.regexp_replace(w, "s$", ""))
        .otherwise(w)
    )


def core_words(fact: Column) -> Column:
    """The distinct words that tell what a fact is about, in order of their first use."""
    t = F.replace(for_match(fact), F.lit("self-published"), F.lit("self published"))
    t = F.regexp_replace(t, f"^({'|'.join(dims.FACT_PREFIXES)})", "")
    return F.array_except(F.transform(words(t), overlap_word), dims.text_array(dims.FACT_STOP))


def words_overlap(a: Column, b: Column) -> Column:
    """Whether one of two sets of core words holds the other and neither is empty."""
    both = F.size(F.array_intersect(a, b))
    return (F.size(a) > 0) & (F.size(b) > 0) & ((both == F.size(a)) | (both == F.size(b)))


def _segments(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ",| and "), normalize), lambda s: s != "")


def expand_fact(attribute: Column, fact: Column) -> Column:
    """The atomic facts of a fact: more than itself only for occupations that join several in a known way."""
    f = normalize(fact)
    low = F.lower(f)
    edge = F.lit(" ,;")

    def variants(prefix: str, parts: Column) -> Column:
        made = F.transform(parts, lambda p: F.btrim(normalize(F.concat(F.lit(prefix), p)), edge))
        return F.array_distinct(F.filter(made, lambda v: v != ""))

    work = normalize(F.regexp_replace(normalize(F.substring(f, 10, 1 << 30)), r"(?i)\s*\((?:e\.g\.,?|for example)[^)]+\)\s*", ""))
    halves = F.split(work, " of ", 2)
    works = F.when(F.startswith(low, F.lit("works on ")) & (F.size(halves) == 2), variants("works on ", halves))
    tail = normalize(F.substring(f, 19, 1 << 30))
    uses = F.when(F.startswith(low, F.lit("uses ai tools for ")) & (tail != ""), variants("uses AI tools for ", _segments(tail)))
    own = F.when(f == "", dims.text_array(())).otherwise(F.array(f))
    return F.when(attribute == "OCCP", F.coalesce(works, F.when(F.size(uses) > 0, uses), own)).otherwise(own)


def content_hash(**parts: Column) -> Column:
    """SHA-256 of the named parts as JSON in order of their names."""
    return F.sha2(F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)]), {"ignoreNullFields": "false"}), 256)


def fill(template: Column, masks: Column, field: str) -> Column:
    """A template with each mask's token replaced by a field of the mask, one mask after another in array order."""
    return F.aggregate(masks, template, lambda acc, m: F.replace(acc, F.concat(F.lit("["), m["key"], F.lit("]")), F.coalesce(m[field], F.lit(""))))


def residual_masks(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\[MASK_\d+\]"))


def max_tokens_for(model: Column) -> Column:
    name, out = F.lower(F.coalesce(model, F.lit(""))), None
    for needle, n in dims.MODEL_MAX_TOKENS:
        hit = F.contains(name, F.lit(needle))
        out = out.when(hit, n) if out is not None else F.when(hit, n)
    return out.otherwise(dims.MODEL_MAX_TOKENS_ELSE)


def merge_maps(default: Column, given: Column) -> Column:
    """A map<string, map<string, string>> with given's entries over default's, one level down as well."""
    keys = F.array_union(F.map_keys(default), F.map_keys(given))

    def one(k: Column) -> Column:
        a, b = F.try_element_at(default, k), F.try_element_at(given, k)
        kept = F.map_filter(a, lambda x, _: ~F.array_contains(F.map_keys(b), x))
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.map_concat(kept, b))

    return F.map_from_arrays(keys, F.transform(keys, one))


def joined(lines: Column) -> Column:
    """Prompt context from an array of lines: one a line, blank ones left out."""
    return F.array_join(F.filter(F.transform(lines, strip), lambda x: x != ""), "\n")


def options_text(options: Column, display: Column, target: Column, note: Column) -> Column:
    """A prompt's line about an attribute: its name, target, allowed answers and note."""
    return F.concat(
        display, F.lit(": "), target,
        F.coalesce(F.concat(F.lit(". One of: "), F.array_join(options, "; ")), F.lit("")),
        F.coalesce(F.concat(F.lit(". "), note), F.lit("")),
    )


def scope_text(scope: Column) -> Column:
    """A prompt's lines about the attributes of a scope."""
    return joined(F.transform(scope, lambda a: F.concat(a["key"], F.lit(" = "), options_text(a["options"], a["display_name"], a["target_str"], a["note"]))))


def inference_text(inferences: Column) -> Column:
    """A prompt's lines about what was inferred, by attribute."""
    said = lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"]["inference"], F.lit("")), F.lit(" (certainty "), F.coalesce(e["value"]["certainty"], F.lit("1")), F.lit(")"))
    return joined(F.transform(F.array_sort(F.map_entries(inferences)), said))


def topic_text(t: Column) -> Column:
    """A prompt's lines about the topic of a transcript (a struct with the fields of its answer)."""
    listed = lambda name, x: F.when(F.size(x) > 0, F.concat(F.lit(name), F.array_join(F.filter(F.transform(x, strip), lambda y: y != ""), "; ")))
    one = lambda name, x: F.when(strip(x) != "", F.concat(F.lit(name), strip(x)))
    found = F.array(
        one("Topic: ", t["primary_topic"]), one("Context: ", t["secondary_context"]),
        listed("Keep: ", t["preserve_focus"]), listed("Generalise: ", t["generalize_focus"]),
    )
    return F.coalesce(F.nullif(joined(F.filter(found, lambda x: x.isNotNull())), F.lit("")), F.lit("Topic: unknown"))
