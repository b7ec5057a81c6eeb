"""A line-oriented hymn text to verses, by carry-forward windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import collapse, roman_value, strip

#: Patterns of headings, verses and lines that belong to none. The numeral of a heading may read as nothing.
BOOK = r"(?i)^\s*BOOK\s+(I{1,3}V?|V?I{0,3}|\d+)\b"
HYMN = r"(?i)^\s*HYMN\s+(I{1,4}V?|VI{0,4}|V?I{0,4}X?|\d+)\.?\s*(.*)"
VERSE = r"^\s*(\d+)\.\s+(.+)"
ASIDE = r"^(\[|\bPage\b|\bNote\b)"


def hymn_verses(lines: DataFrame, work: str = "Rig Veda", key: str = "path", order: str = "line_no", text: str = "text", least: int = 20) -> DataFrame:
    """key, pos, text as "work book.hymn.verse (title): words" of texts over ``least`` characters.

    Headings are lines "BOOK numeral" and "HYMN numeral. title"; "k. words" begins a verse and other lines of more than
    three characters that begin as no aside continue it. A heading that reads no numeral ends the verse but keeps book,
    hymn and title; the book is 1 until a heading names another. Lines before the first hymn, and before the first verse
    of a hymn, are left out. Each file is a window of its own.
    """
    by = Window.partitionBy(key).orderBy(order)
    line = strip(F.coalesce(text, F.lit("")))
    verse = F.regexp_extract("line", VERSE, 1)
    is_book = F.col("line").rlike(BOOK)
    is_hymn = ~is_book & F.col("line").rlike(HYMN)

    def number(pattern: str) -> Column:
        read = F.regexp_extract("line", pattern, 1)
        return F.coalesce(roman_value(F.nullif(read, F.lit(""))), F.nullif(F.nullif(F.regexp_extract(read, r"^\d+$", 0), F.lit("")).cast("int"), F.lit(0)))

    rows = lines.select(key, order, line.alias("line"))
    continues = (F.length("line") > 3) & ~F.col("line").rlike(ASIDE)
    rows = rows.where(F.col("line").rlike(BOOK) | F.col("line").rlike(HYMN) | F.col("line").rlike(VERSE) | continues)
    hymn = F.when(is_hymn, number(HYMN))
    rows = rows.select(
        "*",
        is_book.alias("is_book"),
        is_hymn.alias("is_hymn"),
        F.when(is_book, number(BOOK)).alias("book_read"),
        hymn.alias("hymn_read"),
        F.when(hymn.isNotNull(), F.rtrim(F.regexp_extract("line", HYMN, 2), F.lit("."))).alias("title_read"),
        F.when(~is_book & ~is_hymn & (verse != ""), verse.cast("int")).alias("verse_read"),
    )
    starts = F.col("is_book") | F.col("is_hymn") | F.col("verse_read").isNotNull()
    rows = rows.select(
        "*",
        F.coalesce(F.last("book_read", ignorenulls=True).over(by), F.lit(1)).alias("book"),
        F.last("hymn_read", ignorenulls=True).over(by).alias("hymn"),
        F.last("title_read", ignorenulls=True).over(by).alias("title"),
        F.sum(starts.cast("int")).over(by).alias("part"),
    )
    words = F.when(F.col("verse_read").isNotNull(), F.regexp_extract("line", VERSE, 2)).otherwise(F.col("line"))
    parts = rows.groupBy(key, "part").agg(
        F.min(order).alias("at"),
        F.max("verse_read").alias("verse"),
        F.min_by("book", order).alias("book"),
        F.min_by("hymn", order).alias("hymn"),
        F.min_by("title", order).alias("title"),
        collapse(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), words.alias("words")))), lambda x: x["words"]), " ")).alias("words"),
    )
    found = parts.where(F.col("verse").isNotNull() & F.col("hymn").isNotNull() & (F.length("words") > least))
    label = F.format_string(f"{work} %d.%d.%d", "book", "hymn", "verse")
    titled = F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit(" ("), "title", F.lit(")"))).otherwise("")
    pos = F.row_number().over(Window.partitionBy(key).orderBy("at")) - 1
    return found.select(key, pos.alias("pos"), F.concat(label, titled, F.lit(": "), "words").alias("text"))
