"""Dimension tables and fixed values that the operators' results depend on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Labels, orders, word lists and thresholds that define the results.

#: key, type name, display name, target, options, note, aliases
ATTRIBUTES = (
    ("AGE", "age", "Age", "age", None, "Use the age of the author when they wrote the transcript.", ()),
    ("SEX", "gender", "Sex", "sex", ("Male", "Female"), None, ("sex",)),
    ("LOC", "location", "Location", "current place of living", None, None, ("place of living",)),
    ("OCCP", "occupation", "Occupation", "occupation", None, None, ()),
    ("EDU", "education", "Education", "level of education", ("No Highschool", "In Highschool", "HS Diploma", "In College", "College Degree", "PhD"), None, ()),
    ("REL", "married", "Relationship Status", "current relationship status", ("No relation", "In Relation", "Married", "Divorced"), None, ("relationship status", "relationship", "marital status")),
    ("INC", "income", "Income", "yearly income", ("No income", "Low (<30k USD)", "Medium (30-60k USD)", "High (60-150k USD)", "Very High (>150k USD)"), None, ()),
    ("POBP", "pobp", "Place of Birth", "place of birth", None, None, ("birth place", "birth location")),
)
UTILITY = ("THEME", "EXPER", "AFFECT", "REASON", "BEHAV", "RELAT", "TEMPO", "EXPERT")
SPECIFICITY = ("OCCUPATION", "EXPERTISE", "AI_USAGE", "REGION_TYPE", "LIFE_STAGE")
CONFIDENCE = ("very low", "low", "medium", "high", "very high")
CONFIGS = (
    "original", "nobranch", "adaptive_privacy", "pure_adaptive_attri", "on_device", "on_device_qwen", "remove_2", "remove_4", "anonymized_transcripts", "presidio",
    "rewritten_v1", "rewritten_v2", "dpmlm_eps_10", "dpmlm_eps_30", "dpmlm_eps_50", "dpmlm_eps_70", "dpmlm_eps_100", "dpmlm_eps_120", "dpmlm_eps_140",
)
DECISIONS = {
    "yes": "Yes, the answer can be recovered from the transcript with clear evidence",
    "no": "No, the answer cannot be recovered because the transcripts contain ambigious information and not specific enough to answer the question",
    "unsure": "I am not sure",
}
UNSPECIFIC = ("unknown", "unidentified", "anonymous", "anonymized", "likely non-public", "generic identity")
LEAK_STOP = (
    "about", "after", "again", "against", "among", "because", "before", "being", "between", "could", "doing", "during", "first", "from", "have", "their",
    "there", "these", "those", "through", "under", "using", "with", "would", "where", "which", "while", "work", "research", "project", "study",
)
FACT_STOP = ("a", "an", "the", "of", "and", "or", "to", "in", "on", "for", "with", "by", "at", "from", "use", "ai", "tool", "work", "publish", "sell")
FACT_LEMMAS = {
    "publishes": "publish", "published": "publish", "publishing": "publish", "uses": "use", "using": "use", "used": "use", "works": "work", "working": "work",
    "sells": "sell", "selling": "sell", "books": "book", "reviews": "review", "materials": "material", "platforms": "platform", "products": "product", "designs": "design",
}
FACT_PREFIXES = ("uses ai tools for ", "uses ai tool for ", "uses ai for ", "works on ", "work on ", "publishes ", "self published ", "sells ", "sell ")
CERTAINTY_LEAST = 3
TOO_SPECIFIC_MOST = 2
MISSING_SCORE = 999
#: Severity, unique long words needed, and share of them needed, of the leaks that aren't verbatim.
LEAK_TIERS = ((2, 4, 0.80), (1, 5, 0.60))
LEAK_WORD, MAP_WORD = 6, 5
MODEL_MAX_TOKENS = (("qwen", 81920), ("llama", 4096))
MODEL_MAX_TOKENS_ELSE = 6000


def text_array(values: tuple[str, ...] | list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def text_map(values: dict[str, str] | dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def attributes(spark: SparkSession) -> DataFrame:
    """pos, key, type_name, display_name, target_str, options, note, aliases: one row for each base attribute."""
    rows = [(i, k, t, d, s, list(o) if o else None, n, list(a)) for i, (k, t, d, s, o, n, a) in enumerate(ATTRIBUTES)]
    return spark.createDataFrame(rows, "pos int, key string, type_name string, display_name string, target_str string, options array<string>, note string, aliases array<string>")


def names(spark: SparkSession, values: tuple[str, ...], column: str) -> DataFrame:
    """pos and a name: an ordered dimension."""
    return spark.createDataFrame(list(enumerate(values)), f"pos int, {column} string")
