"""Filters, quality funnel and order-preserving distinct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import class_ratio, contains_any, script_class, strip

#: Navigation texts at the start of a paragraph.
NAVIGATION = r"(?i)^(next|previous|index|contents?|back|forward|home|wisdomlib|copyright|all rights|return to|buy (this|now)|let'?s grow|support|donate|patreon|newsletter|already donated|read more)\b"
#: Whole paragraphs and parts of paragraphs that page loaders take as boilerplate.
PAGE_BOILERPLATE = [
    "Disclaimer: These are translations of Sanskrit texts and are not necessarily approved by everyone associated with the traditions connected to these texts. Consult the source and original scripture in case of doubt.",
    "I humbly request your help to keep doing what I do best: provide the world with unbiased sources, definitions and images. Your donation direclty influences the quality and quantity of knowledge, wisdom and spiritual insight the world is exposed to.",
    "Let's make the world a better place together!",
]
PAGE_FRAGMENTS = ["humbly request your help to keep doing what i do best", "your donation direclty influences the quality", "isbn-10:", "isbn-13:", "words | isbn"]
BOILERPLATE = ["all rights reserved", "copyright", "privacy policy", "terms of use", "click here", "cookie policy", "javascript is disabled"]
#: Names of textloom.functions.text.SCRIPTS that the loader's and the chunker's language filters reject.
LOADER_SCRIPTS = ["devanagari", "bengali", "gurmukhi", "gujarati", "oriya", "ta", "telugu", "kannada", "malayalam"]
CHUNKER_SCRIPTS = ["devanagari", "ta", "telugu", "kannada", "malayalam"]
REASONS = ["too_short", "boilerplate", "non_english", "duplicate", "passed"]


def is_navigation(text: Column) -> Column:
    return text.rlike(NAVIGATION)


def is_boilerplate(text: Column, fragments: list[str] | None = None, exact: list[str] | None = None) -> Column:
    out = contains_any(F.lower(text), BOILERPLATE if fragments is None else fragments)
    return out | text.isin(exact) if exact else out


def is_link_dense(text: Column, link_chars: Column, share: float = 0.75) -> Column:
    return link_chars > share * F.length(text)


def is_foreign(text: Column, char_class: str | None = None, most: float = 0.05) -> Column:
    return class_ratio(text, char_class or script_class(CHUNKER_SCRIPTS)) >= most


def first_reason(text: Column, min_chars: int = 30, fragments: list[str] | None = None, char_class: str | None = None) -> Column:
    """The first test that a stripped text fails, or null; duplicates are found among what is left."""
    return F.when(F.length(text) < min_chars, "too_short").when(is_boilerplate(text, fragments), "boilerplate").when(is_foreign(text, char_class), "non_english")


def funnel(df: DataFrame, order: str, text: str = "text", **tests) -> DataFrame:
    """df with reason: exactly one of REASONS for each row; of equal stripped texts the first in order passes.

    Only a digest of the text is dealt out to find duplicates, and of each digest only the smallest order is kept
    before the shuffle, so a text that many rows share stays cheap.
    """
    rows = _tested(df, text, tests)
    firsts = rows.where("_key IS NOT NULL").groupBy("_key").agg(F.min(order).alias(order)).select(order, F.lit(True).alias("_first"))
    out = rows.join(firsts, order, "left")
    reason = F.coalesce("_reason", F.when(F.col("_first"), "passed").otherwise("duplicate"))
    return out.select(*df.columns, reason.alias("reason"))


def _tested(df: DataFrame, text: str, tests: dict) -> DataFrame:
    """df with _reason (null if all tests are passed) and then _key, a digest of the stripped text."""
    # An explode of one value: Spark does not put the expression in place of the column wherever that is used.
    rows = df.withColumn("_text", F.explode_outer(F.array(strip(F.coalesce(text, F.lit(""))))))
    rows = rows.withColumn("_reason", F.explode_outer(F.array(first_reason(F.col("_text"), **tests))))
    return rows.withColumn("_key", F.when(F.col("_reason").isNull(), F.sha2("_text", 256))).drop("_text")


def funnel_counts(df: DataFrame, text: str = "text", **tests) -> DataFrame:
    """reason and n of the funnel, from one scan: of each digest one row passes and the others are duplicates."""
    keys = _tested(df.select(text), text, tests).groupBy("_reason", "_key").agg(F.count("*").alias("n"))
    rest = F.when(F.col("_reason").isNull(), F.col("n") - 1).otherwise(F.lit(0))
    parts = F.array(F.struct(F.coalesce("_reason", F.lit("passed")).alias("reason"), (F.col("n") - rest).alias("n")), F.struct(F.lit("duplicate").alias("reason"), rest.alias("n")))
    return keys.select(F.explode(parts).alias("x")).select("x.*").where("n > 0").groupBy("reason").agg(F.sum("n").alias("n"))


def distinct_first(df: DataFrame, key: Column, order: str, *within: str) -> DataFrame:
    """Of rows with one key (within the given columns) the first in order.

    A group-wise minimum of (order, row) combines before the shuffle; unlike a window it never sorts a whole group.
    """
    row = F.struct(F.col(order).alias("_order"), F.struct(*df.columns).alias("_row"))
    picked = df.groupBy(*within, key.alias("_key")).agg(F.min_by(row, F.col(order)).alias("_x"))
    return picked.select("_x._row.*")


def canonical_url(url: Column) -> Column:
    """Lower-case, without query and trailing slashes."""
    return F.regexp_replace(F.substring_index(F.lower(url), "?", 1), "/+$", "")


