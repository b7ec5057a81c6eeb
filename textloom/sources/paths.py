"""Names and addresses of source files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of language codes.
LANGUAGES = {"english": "en", "sinhala": "si", "tamil": "ta"}


def language_code(name: Column) -> Column:
    """The code of a language's name; codes and unknown names stay as they are."""
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(name)), name)


def verse_url(template: str, book: Column, chapter: Column) -> Column:
    """template with {book} (blanks as +) and {chapter} filled in."""
    out = F.replace(F.lit(template), F.lit("{book}"), F.replace(book, F.lit(" "), F.lit("+")))
    return F.replace(out, F.lit("{chapter}"), chapter.cast("string"))


def locate_chapters(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """language, book, chapter, path of the wanted chapters' files, null where there is none.

    First <language>/<book>/<chapter>.htm, then <language>/<book><chapter>.htm (both case aside), then any file of that
    number below a folder named as the book; of several the first by name. Joins are on names and number, cut from the
    paths, so no key has more rows than a book's chapter.
    """
    known = files.select("path", F.regexp_extract("path", r"(?i)([^/]+)\.html?$", 1).alias("name"), F.split("path", "/").alias("parts")).where("name != ''")
    known = known.select("path", "name", F.reverse(F.slice("parts", 1, F.size("parts") - 1)).alias("folders"), F.regexp_extract("name", r"(\d+)$", 1).alias("digits"))
    known = known.where("digits != ''")
    # Each way to read the last digits of a name as a book's own and a chapter's.
    at = F.explode(F.sequence(F.lit(1), F.length("digits")))
    read = known.withColumn("n", at).select("path", "folders", F.expr("lower(left(name, length(name) - n))").alias("head"), F.expr("right(name, n)").alias("tail"))
    folder = lambda i: F.lower(F.get("folders", F.lit(i)))
    named = F.when(F.col("head") == "", F.struct(F.lit(0).alias("place"), folder(1).alias("_language"), folder(0).alias("_book")))
    named = named.otherwise(F.struct(F.lit(1).alias("place"), folder(0).alias("_language"), F.col("head").alias("_book")))
    exact = read.select("path", named.alias("x"), F.expr("try_cast(tail AS int)").alias("chapter")).select("path", "x.*", "chapter")
    below = known.select("path", F.expr("try_cast(digits AS int)").alias("chapter"), F.explode(F.array_distinct("folders")).alias("book"))

    asked = wanted.select("language", "book", "chapter").distinct()
    lower = asked.withColumns({"_language": F.lower("language"), "_book": F.lower("book")})
    first = lower.join(exact, ["_language", "_book", "chapter"]).select("language", "book", "chapter", "place", "path")
    other = asked.join(below, ["book", "chapter"]).select("language", "book", "chapter", F.lit(2).alias("place"), "path")
    best = first.unionByName(other).groupBy("language", "book", "chapter").agg(F.min(F.struct("place", "path")).alias("x"))
    return wanted.join(best.select("language", "book", "chapter", F.col("x.path").alias("path")), ["language", "book", "chapter"], "left").select("language", "book", "chapter", "path")


def tree_entries(files: DataFrame, prefix: str) -> DataFrame:
    """path and uid (name without ending) of the JSON files below a prefix."""
    found = files.where(F.col("path").contains(prefix) & F.col("path").endswith(".json"))
    return found.select("path", F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("uid"))
