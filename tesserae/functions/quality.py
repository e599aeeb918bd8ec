"""Page quality as array expressions: cleaning, the 0-100 score, assembled content, gates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import fixed

_HEADING = r"(?i)^(" + "|".join(fixed.BOILERPLATE_HEADINGS) + r")$"
_PARAGRAPH = r"(?i)(" + "|".join(fixed.BOILERPLATE_PARAGRAPHS) + r")"
_CTA = r"(?i)\b(" + "|".join(fixed.CALLS_TO_ACTION) + r")\b"


def clean_paragraphs(column: Column) -> Column:
    """F3."""
    return F.filter(F.transform(column, F.trim), lambda p: (F.length(p) >= 15) & ~p.rlike(_PARAGRAPH))


def clean_headings(column: Column) -> Column:
    """F4."""
    return F.filter(F.transform(column, F.trim), lambda h: F.length(h).between(2, 120) & ~h.rlike(_HEADING) & ~h.rlike("(?i)^https?://"))


def clean_code(column: Column) -> Column:
    """of (snippet, language, context)."""
    kept = F.filter(column, lambda c: F.length(F.trim(c["snippet"])) >= 10)
    return F.transform(kept, lambda c: F.struct(F.substring(c["snippet"], 1, 5000).alias("snippet"), F.lower(F.coalesce(c["language"], F.lit("unknown"))).alias("language"), F.substring(F.coalesce(c["context"], F.lit("")), 1, 300).alias("context")))


def _words(p: Column) -> Column:
    return F.size(F.split(F.trim(p), r"\s+"))


def score(paragraphs: Column, headings: Column, code_count: Column, links: Column, title: Column, description: Column, url: Column) -> Column:
    """0 to 100 from cleaned parts; 0 where links outnumber paragraphs by more than eight to one."""
    n = F.greatest(F.size(paragraphs), F.lit(1))
    ratio = links / n
    has = F.size(paragraphs) > 0
    words = F.aggregate(paragraphs, F.lit(0), lambda a, p: a + _words(p)) / n
    chars = F.aggregate(paragraphs, F.lit(0), lambda a, p: a + F.length(p))
    whole = F.array_join(paragraphs, "\n")
    cta = F.size(F.filter(paragraphs, lambda p: p.rlike(_CTA))) / n
    parts = F.size(F.filter(F.split(F.lower(url), "/"), lambda x: x != "")) - 2
    title_words = F.size(F.filter(F.split(F.trim(title), r"\s+"), lambda x: x != ""))
    points = (
        F.when(ratio < 1, 15).when(ratio < 3, 10).when(ratio < 6, 4).otherwise(0)
        + F.when(n >= 20, 25).when(n >= 10, 18).when(n >= 5, 10).when(n >= 2, 5).otherwise(0)
        + F.when(has & (words >= 40), 15).when(has & (words >= 20), 8).when(has & (words < 12), -10).otherwise(0)
        + F.when(chars >= 3000, 15).when(chars >= 1000, 8).when(chars >= 300, 3).otherwise(0)
        + F.when(F.size(headings) >= 3, 10).when(F.size(headings) >= 1, 4).otherwise(0)
        + F.when(code_count >= 1, F.least(6 * code_count, F.lit(20))).otherwise(0)
        + F.when(whole.rlike("(?m)" + fixed.CODE_MARK), 8).otherwise(0)
        + F.when(whole.rlike(fixed.TECHNICAL), 5).otherwise(0)
        + F.when(has & (cta > 0.5), -20).when(has & (cta > 0.25), -8).otherwise(0)
        + F.when(F.lower(url).rlike(fixed.DOC_URL), 12).otherwise(0)
        + F.when(parts >= 2, 5).when(parts == 1, 2).otherwise(0)
        + F.when(F.lower(title).rlike(fixed.DOC_TITLE), 10).otherwise(0)
        + F.when(title_words.between(1, 2), -5).otherwise(0)
        + F.when(F.length(description) > 50, 4).otherwise(0)
    )
    return F.when(ratio > 8, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), points))).cast("int")


def content(paragraphs: Column, headings: Column, description: Column) -> Column:
    """description if over 30 characters, 30 headings, 200 paragraphs, joined by empty lines."""
    parts = F.concat(
        F.when(F.length(description) > 30, F.array(description)).otherwise(F.array().cast("array<string>")),
        F.transform(F.slice(headings, 1, 30), lambda h: F.concat(F.lit("## "), h)),
        F.slice(paragraphs, 1, 200),
    )
    return F.substring(F.array_join(parts, "\n\n"), 1, 50_000)


def snippet(text: Column, most: int = 350) -> Column:
    """Cut at a word's end."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, most), r"\s+\S*$", ""), F.lit("...")))


def _phrases(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in words)


def useful_a(text: Column) -> Column:
    """F9."""
    return F.coalesce((F.length(text) >= 200) & ~F.lower(text).rlike(_phrases(fixed.BAD_PHRASES_A)), F.lit(False))


def useful_b(text: Column) -> Column:
    """F10."""
    return F.coalesce((F.length(F.trim(text)) >= 300) & ~F.lower(text).rlike(_phrases(fixed.BAD_PHRASES_B)), F.lit(False))


def worth_saving(text: Column, has_code: Column) -> Column:
    """50 characters, and code or 20 words."""
    tidy = F.lower(F.trim(text))
    return F.coalesce((F.length(tidy) >= 50) & (has_code | (_words(tidy) >= 20)), F.lit(False))


def cleaned(pages: DataFrame) -> DataFrame:
    """the pages with clean paragraphs and headings."""
    return pages.withColumn("paragraphs", clean_paragraphs(F.col("paragraphs"))).withColumn("headings", clean_headings(F.col("headings")))


def judged(pages: DataFrame, *, least_score: int = 20, least_chars: int = 80) -> DataFrame:
    """F1, F2: cleaned pages (url, title, description, paragraphs, headings, code_count, links_count) that pass, with score and content."""
    scored = pages.withColumn("quality", score(F.col("paragraphs"), F.col("headings"), F.col("code_count"), F.col("links_count"), F.col("title"), F.col("description"), F.col("url")))
    built = scored.filter(F.col("quality") >= least_score).withColumn("content", content(F.col("paragraphs"), F.col("headings"), F.col("description")))
    return built.filter(F.length("content") >= least_chars)


def process(pages: DataFrame, *, least_score: int = 20, least_chars: int = 80) -> DataFrame:
    """F1, F2 in one plan; to write what is cleaned in between, call the two parts."""
    return judged(cleaned(pages), least_score=least_score, least_chars=least_chars)


def truthy(content: Column) -> Column:
    """whether a document holds anything to speak of."""
    return F.coalesce(F.length(content) > 50, F.lit(False))
