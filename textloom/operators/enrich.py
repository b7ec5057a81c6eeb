"""Labels, rule joins and the text that is embedded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import contains_any, script_class, strip
from textloom.operators.clean import LOADER_SCRIPTS, is_foreign

Rules = list[tuple]


def label(key: Column, table: dict[str, str], default: str) -> Column:
    """Value of a lookup table for a key; the default for others and for null."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default)) if pairs else F.lit(default)


def label_join(df: DataFrame, table: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """The same for a table of labels, one row a key; Spark broadcasts it where it is small."""
    return df.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def merge_lookups(*tables: DataFrame, key: str) -> DataFrame:
    """Tables with one row a key as one; of a key in several the last table's row counts."""
    out = tables[0]
    for table in tables[1:]:
        out = out.join(table.select(key), key, "left_anti").select(out.columns).unionByName(table)
    return out


def classify(known: Column, member: Column, groups: dict[str, list[str]], unknown: str = "Unknown") -> Column:
    """The group that holds member, where what is known says nothing."""
    out = known
    for name, members in reversed(groups.items()):
        out = F.when((known == unknown) & member.isin(members), name).otherwise(out)
    return out


def rule_table(spark: SparkSession, rules: Rules, schema: str) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rules)], f"rule_no int, {schema}")


def first_range_rule(book: Column, chapter: Column, rules: list[tuple[str, int, int, str]]) -> Column:
    """Text of the first rule (book, first chapter, last chapter, text) that holds; '' if none. No shuffle."""
    if not rules:
        return F.lit("")
    return F.coalesce(*[F.when((book == b) & chapter.between(lo, hi), text) for b, lo, hi, text in rules], F.lit(""))


def longest_key_rule(section: Column, rules: list[tuple[str, str]]) -> Column:
    """Text of the longest key that section contains (case does not count); of equally long the first; '' if none."""
    ranked = sorted(rules, key=lambda r: -len(r[0]))  # stable: the first of equally long stays first
    if not ranked:
        return F.lit("")
    low = F.lower(section)
    return F.coalesce(*[F.when(low.contains(k.lower()), text) for k, text in ranked], F.lit(""))


def expand_synonyms(text: Column, rules: list[tuple[list[str], str]]) -> Column:
    """Expansions of all rules with a trigger in the text, in rule order, joined by blanks; triggers are substrings."""
    low = F.lower(text)
    return F.concat_ws(" ", *[F.when(contains_any(low, triggers), expansion) for triggers, expansion in rules])


def book_heading(book: Column, testament: Column, genre: Column, language: Column) -> Column:
    """The heading of a chunk of the Christian domain; only English ones have the genre."""
    start = F.concat(F.lit("Book: "), book, F.lit(". Testament: "), testament, F.lit("."))
    return F.when(language == "en", F.concat(start, F.lit(" Genre: "), genre, F.lit("."))).otherwise(start)


def scripture_heading(section: Column, category: Column, religion: str = "Hinduism") -> Column:
    return F.concat(F.lit("Scripture: "), section, F.lit(". Category: "), category, F.lit(f". Religion: {religion}."))


def verse_line(chapter: Column, verse: Column, text: Column) -> Column:
    return F.concat(F.lit("Chapter "), chapter.cast("string"), F.lit(", Verse "), verse.cast("string"), F.lit(": "), text)


def embed_text(preamble: Column, heading: Column, chunk: Column, synonyms: Column) -> Column:
    """The parts that aren't empty, joined by blanks."""
    return F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in (preamble, heading, chunk, synonyms)])


def best_version(rows: DataFrame, key: str, order: str, preferred: Column) -> DataFrame:
    """One row a key: the last preferred one, else the first."""
    rank = F.struct(preferred.alias("p"), F.when(preferred, F.col(order)).otherwise(-F.col(order)).alias("o"))
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), rank).alias("_x")).select(key, "_x.*")


def is_english_row(language: Column, text: Column) -> Column:
    """Whether a translation counts as English: by its language, if it names one, and by its script; blank texts don't."""
    low = F.lower(F.coalesce(language, F.lit("")))
    named = (low == "") | low.contains("english") | low.isin("en", "1")
    return named & (strip(F.coalesce(text, F.lit(""))) != "") & ~is_foreign(F.coalesce(text, F.lit("")), script_class(LOADER_SCRIPTS))


def in_verse_order(rows: DataFrame, chapter: str = "chapter", verse: str = "verse") -> DataFrame:
    return rows.orderBy(F.col(chapter).cast("int"), F.col(verse).cast("int"))


def verse_join(translations: DataFrame, verses: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Inner join on ids compared as stripped strings; in_verse_order puts the result in order."""
    a = translations.withColumn("_id", strip(F.col(left_id).cast("string")))
    b = verses.withColumn("_id", strip(F.col(right_id).cast("string")))
    return a.join(b, "_id").drop("_id")


def assemble_verses(translations: DataFrame, verses: DataFrame, preferred: Column) -> DataFrame:
    """chapter, verse, line of verses (id, chapter, verse) with an English translation (pos, id, language, text), in order.

    Of a verse's translations the last ``preferred`` one counts, else the first.
    """
    english = translations.where(is_english_row(F.col("language"), F.col("text"))).withColumn("id", strip(F.col("id").cast("string")))
    best = best_version(english, "id", "pos", preferred)
    joined = verse_join(best.select("id", strip("text").alias("text")), verses.select(F.col("id").alias("verse_id"), "chapter", "verse"), "id", "verse_id")
    return in_verse_order(joined.select("chapter", "verse", verse_line(F.col("chapter"), F.col("verse"), F.col("text")).alias("line")))
