"""Decision ladders and small normalisers as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wordings that give investment advice.
ADVICE = (
    r"\b(?:investors?|traders?|shareholders?|readers?|buyers?|you|one)\s+(?:should|must|ought\s+to|need\s+to|may\s+want\s+to|would\s+do\s+well\s+to)\s+(?:consider\s+)?(?:buy|sell|short|hold|invest|divest|exit|enter|accumulate|book|add|reduce|avoid|switch)\b",
    r"\b(?:should|must)\s+(?:consider\s+)?(?:buy|sell|short|accumulate|book\s+profits\s+in)\s+(?:the\s+|these\s+|its\s+)?(?:stock|shares|scrip|dip|rally)\b",
    r"\b(?:we|i|our\s+\w+)\s+(?:recommend|advise|suggest\s+(?:buying|selling))\b",
    r"\brecommend(?:s|ed|ation)?\s+(?:to\s+)?(?:buy|sell|short|hold|avoid)\b",
    r"\b(?:strong\s+buy|strong\s+sell|table\s+pounding)\b",
    r"\b(?:price|target)\s+target\b",
    r"\bfair\s+value\s+of\s+(?:rs\.?|₹|\$|usd|inr)\s?[\d,]",
    r"\b(?:guaranteed|assured|risk[-\s]free)\s+(?:returns?|profits?|gains?)\b",
    r"\b(?:buy|sell)\s+(?:the\s+)?(?:dip|rally|stock|shares|scrip)\b",
    r"\bgood\s+time\s+to\s+(?:buy|sell|enter|exit)\b",
    r"\b(?:add|book)\s+(?:it\s+)?(?:to|in)\s+your\s+portfolio\b",
)
# Words for nothing.
NULL_WORDS = ("none", "null", "n/a", "na")


def depth_hint(sources: Column, facts: Column) -> Column:
    return F.when((sources >= 4) | (facts >= 5), "deep").when((sources >= 2) | (facts >= 2), "standard").otherwise("brief")


def agreement(credibility: Column) -> Column:
    return F.when(credibility >= 85, "very high").when(credibility >= 70, "high").when(credibility >= 55, "fair").when(credibility >= 40, "mixed").otherwise("low")


def direction(change: Column) -> Column:
    return F.when(change > 0, "up").when(change < 0, "down").when(change == 0, "flat")


def without_null_words(text: Column) -> Column:
    """Trimmed text of 40 characters at most; empty for words that mean nothing."""
    return F.when(F.lower(F.trim(text)).isin(*NULL_WORDS), "").otherwise(F.substring(F.trim(text), 1, 40))


def number_in(text: Column) -> Column:
    """The first number in free text, thousands separators removed."""
    return F.regexp_replace(F.regexp_extract(text, r"-?\d[\d,]*(?:\.\d+)?", 0), ",", "").try_cast("double")


def snake(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def advice_in(text: Column) -> Column:
    """The first wording of advice, null if there is none."""
    return F.coalesce(*[F.nullif(F.regexp_extract(F.lower(text), p, 0), F.lit("")) for p in ADVICE])


def verdicts(notes: Column) -> list[Column]:
    """Counts of verdicts by their beginnings."""
    low = lambda v: F.lower(F.trim(v))
    agree, dispute = F.size(F.filter(notes, lambda v: low(v).startswith("corrob"))), F.size(F.filter(notes, lambda v: low(v).startswith("disput")))
    return [agree.alias("verified"), dispute.alias("disputed"), (F.size(notes) - agree - dispute).alias("unverified")]


def spread(positions: Column) -> list[Column]:
    """How far positions within -1 and 1 lie apart: span and wide, moderate or narrow; null below two."""
    clamped = F.transform(positions, lambda p: F.least(F.lit(1.0), F.greatest(F.lit(-1.0), p)))
    span = F.when(F.size(positions) >= 2, F.round(F.array_max(clamped) - F.array_min(clamped), 4))
    return [span.alias("span"), F.when(span >= 1, "wide").when(span >= 0.5, "moderate").when(span.isNotNull(), "narrow").alias("framing")]
