"""Text measures as column expressions over whole texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from marketlab.functions.columns import clip, col, flag, lit

# fixed values: phrases of rule ambiguity
AMBIGUITY_PHRASES = (
    "official source",
    "if and only if",
    "unless",
    "dispute",
    "clarification",
    "at discretion",
    "invalidated",
    "or equivalent",
    "as determined by",
)
# fixed values: hedging words and resolution sources of the rule score
HEDGES = ("official", "reported", "declared", "according to", "confirmed", "if announced", "if approved", "unless", "deemed")
SOURCES = ("ap", "reuters", "associated press", "official website", "sec", "federal reserve", "court", "cdc", "who", "election board")
# fixed values: date patterns
LOOSE_DATE = r"\b\d{4}\b|\bjan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec\b"
WORD_DATE = r"\b(?:\d{4}|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\b"
DATE_HINT = r"\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?\s+\d{1,2}(?:,\s*\d{4})?\b|\b\d{4}-\d{2}-\d{2}\b"
# fixed values: words a question stem leaves out
STEM_WORDS = ("will", "who", "which", "the", "a", "an", "be", "is", "to", "win", "wins")


def normal_text(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(x), F.lit(""))), r"\s+", " "))


def words(x: Column | str) -> Column:
    """Distinct lower-case ASCII words and numbers."""
    return F.array_distinct(F.regexp_extract_all(col(x), F.lit("[a-z0-9]+"), F.lit(0)))


def occurrences(text: Column, phrase: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / lit(len(phrase))


def _sum(parts: Sequence[Column]) -> Column:
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def ambiguity_score(text: Column | str) -> Column:
    low = F.lower(F.coalesce(col(text), F.lit("")))
    hits = _sum([occurrences(low, p) for p in AMBIGUITY_PHRASES])
    marks = _sum([occurrences(low, p) for p in (";", ":", "(")])
    return F.length(low) / lit(400) + 0.8 * hits + 0.2 * marks


def rule_scores(question: Column | str, description: Column | str, whole_words: bool = False) -> dict[str, Column]:
    """Risk, clarity and lag of a rule text, and its number of hedges.

    ``whole_words`` counts sources and dates only as separate words.
    """
    text = F.trim(F.concat(normal_text(question), F.lit(" "), normal_text(description)))
    hedges = _sum([F.contains(text, F.lit(p)).cast("double") for p in HEDGES])
    if whole_words:
        sources = _sum([F.rlike(text, F.lit(rf"\b{p}\b")).cast("double") for p in SOURCES])
    else:
        sources = _sum([F.contains(text, F.lit(p)).cast("double") for p in SOURCES])
    anchor = flag(sources > 0)
    dated = flag(F.rlike(text, F.lit(WORD_DATE if whole_words else LOOSE_DATE)))
    return {
        "rule_risk_score": clip(0.15 * hedges + 0.10 * (1.0 - anchor) + 0.05 * (1.0 - dated), 0.0, 1.0),
        "rule_clarity_score": clip(0.30 * anchor + 0.20 * dated + 0.05 * F.greatest(lit(0), 6.0 - hedges), 0.0, 1.0),
        "resolution_lag_risk": clip(0.15 * hedges + 0.10 * flag(sources > 1), 0.0, 1.0),
        "ambiguous_term_hits": hedges,
    }


def question_stem(question: Column | str) -> Column:
    """All sorted words without stop words; the bare text if there are none."""
    bare = F.regexp_replace(normal_text(question), r"\b(?:" + "|".join(STEM_WORDS) + r")\b", " ")
    bare = F.trim(F.regexp_replace(bare, r"\s+", " "))
    toks = F.array_sort(words(bare))
    return F.when(F.size(toks) > 0, F.array_join(toks, " ")).otherwise(bare)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / union).otherwise(lit(0))
