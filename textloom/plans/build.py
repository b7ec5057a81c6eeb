"""Corpus build: raw segments to the chunk table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.config import Domain
from textloom.functions.text import first_of, strip
from textloom.operators import chunk, clean, enrich


@dataclass(frozen=True)
class Build:
    """A domain's parameters and rules; rules that stay empty do nothing."""

    domain: Domain
    labels: dict[str, str] = field(default_factory=dict)
    parts: dict[str, str] = field(default_factory=dict)
    preambles: list[tuple[str, str]] = field(default_factory=list)
    synonyms: list[tuple[list[str], str]] = field(default_factory=list)
    quality: bool = False
    enrich: bool = True


def merge_sections(*sections: DataFrame) -> DataFrame:
    """Section files of all languages, in the order given, with the place of each in ``source_no``."""
    out = None
    for n, s in enumerate(sections):
        own = s.withColumn("source_no", F.lit(n))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def clean_rows(raw: DataFrame, build: Build) -> DataFrame:
    """Rows with text; with quality also without short, boilerplate, foreign and repeated ones. ``pos`` is unique and gives the order."""
    rows = raw.where(strip(F.coalesce("text", F.lit(""))) != "")
    if build.quality:
        rows = clean.funnel(rows, "pos").where("reason = 'passed'").drop("reason")
    return rows


def build_chunks(raw: DataFrame, build: Build) -> DataFrame:
    """id, text, book, pitaka, source, religion, language, embed_text of raw rows (pos, text, section, language).

    ids are dense and follow (pos, window). English chunks are embedded with preamble, heading and synonyms; others
    with the heading alone; without ``enrich`` the chunk itself is.
    """
    d = build.domain
    rows = clean_rows(raw, build)
    section = first_of(F.col("section"), F.lit("unknown"))
    rows = rows.select("pos", "text", section.alias("section"), first_of(F.col("language"), F.lit("en")).alias("language"))
    windows = chunk.word_windows(rows, d.chunk_words, d.overlap_words, d.min_chars)
    numbered = chunk.dense_ids(windows, "pos", "chunk_no")
    book = enrich.label(F.col("section"), build.labels, "") if build.labels else F.lit("")
    book = first_of(book, F.col("section"))
    part = enrich.label(F.col("section"), build.parts, "Unknown") if build.parts else F.lit("Unknown")
    heading = F.concat(F.lit("Scripture: "), book, F.lit("."))
    full = enrich.embed_text(enrich.longest_key_rule(F.col("section"), build.preambles), heading, F.col("chunk"), enrich.expand_synonyms(F.col("chunk"), build.synonyms))
    embedded = F.when(F.col("language") == "en", full).otherwise(F.concat_ws(" ", heading, "chunk")) if build.enrich else F.col("chunk")
    return numbered.select("id", F.col("chunk").alias("text"), book.alias("book"), part.alias("pitaka"), F.col("section").alias("source"), F.lit(d.name).alias("religion"), "language", embedded.alias("embed_text"))
