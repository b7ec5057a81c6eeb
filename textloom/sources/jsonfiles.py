"""Scans of JSON section files, corpora, verse lists and nested documents."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.text import strip


def read_whole(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """path and text of each file below path, none where there is no such path; unreadable bytes become U+FFFD."""
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, text string")
    return found.select("path", decode_text(F.col("content")).alias("text"))


def encoding_of(content: Column) -> Column:
    """UTF-16 or UTF-8 by a byte order mark, UTF-8 where the bytes are, else ISO-8859-1."""
    mark = F.substring(F.hex(content), 1, 4)
    return F.when(mark.isin("FFFE", "FEFF"), "UTF-16").when(F.is_valid_utf8(content.cast("string")), "UTF-8").otherwise("ISO-8859-1")


@F.pandas_udf(T.StringType())
def _utf16(content: pd.Series) -> pd.Series:
    return content.map(lambda x: None if x is None else bytes(x).decode("utf-16", errors="replace"))


def decode_text(content: Column, encoding: Column | None = None) -> Column:
    """The text of bytes, without a byte order mark. Broken bytes become U+FFFD.

    ``encoding`` names each row's own (UTF-8, UTF-16 or ISO-8859-1, case aside); where it is null or not given the bytes
    tell it (encoding_of).
    """
    known = encoding_of(content) if encoding is None else F.coalesce(F.upper(encoding), encoding_of(content))
    utf8 = F.make_valid_utf8(content.cast("string"))
    latin = F.decode(F.when(known == "ISO-8859-1", content), "ISO-8859-1")
    text = F.when(known == "UTF-16", _utf16(F.when(known == "UTF-16", content))).when(known == "ISO-8859-1", latin).otherwise(utf8)
    return F.regexp_replace(text, "^\\uFEFF", "")


def keyed_records(files: DataFrame, keys: dict[str, list[str]], instead: dict[str, tuple[str, list[str]]] | None = None, text: str = "text") -> DataFrame:
    """path, pos and a text column for each of ``keys``, of files that hold JSON arrays of objects.

    Which field stands for a column is decided by each file's first object: the first of the column's candidates that
    it has. ``instead`` (column: other column, candidates) chooses anew where a column would take the other's field.
    Items that aren't objects and files that aren't arrays have no rows; a missing field is null.
    """
    is_object = lambda x: F.schema_of_variant(x).startswith("OBJECT")
    items = F.filter(F.try_variant_get(F.try_parse_json(text), "$", "array<variant>"), is_object)
    parsed = files.select("path", F.transform(items, lambda x: x.cast("map<string,variant>")).alias("_items"))
    found = parsed.withColumn("_names", F.map_keys(F.get("_items", F.lit(0))))
    first_present = lambda options: F.coalesce(*[F.when(F.array_contains("_names", c), c) for c in options])
    found = found.withColumns({f"_key_{name}": first_present(options) for name, options in keys.items()})
    for name, (other, options) in (instead or {}).items():
        found = found.withColumn(f"_key_{name}", F.when(F.col(f"_key_{name}") == F.col(f"_key_{other}"), first_present(options)).otherwise(F.col(f"_key_{name}")))
    rows = found.select("path", *[f"_key_{name}" for name in keys], F.posexplode("_items").alias("pos", "_item"))
    return rows.select("path", "pos", *[F.try_element_at("_item", F.col(f"_key_{name}")).cast("string").alias(name) for name in keys])


#: Fields that may stand for the columns of verse and translation files.
VERSE_KEYS = {"id": ["verse_id", "id", "slok_id", "shloka_id"], "chapter": ["chapter_number", "chapter_id", "chapter", "ch"], "verse": ["verse_number", "verse_id", "verse", "sl"]}
VERSE_INSTEAD = {"verse": ("id", ["verse_number", "verse", "sl", "shloka"])}
TRANSLATION_KEYS = {"id": ["verse_id", "id", "slok_id", "shloka_id", "verseId"], "language": ["language", "lang", "language_id"], "text": ["description", "translation", "meaning", "text", "verse_meaning", "purport"]}


def section_of(path: Column) -> tuple[Column, Column]:
    """Section and language in a file's name: ``section`` (English) or ``section__language``, underscores for blanks."""
    name = F.regexp_extract(path, r"([^/]+)\.json$", 1)
    language = F.when(name.contains("__"), F.substring_index(name, "__", -1)).otherwise("en")
    return F.replace(F.substring_index(name, "__", 1), F.lit("_"), F.lit(" ")), language


def sections(files: DataFrame, language: str | None = None) -> DataFrame:
    """section, language, pos, text of files that hold arrays of strings; a corrupt file has no rows."""
    section, own = section_of(F.col("path"))
    parsed = files.select(section.alias("section"), (F.lit(language) if language else own).alias("language"), F.from_json("text", "array<string>").alias("items"))
    return parsed.select("section", "language", F.posexplode("items").alias("pos", "text"))


def corpus(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of objects with an explicit schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def verses(documents: DataFrame, text: str = "text") -> DataFrame:
    """path, pos, verse text as "number words" of {"verses": [{"verse": .., "text": ..}]}; blank verses go."""
    parsed = documents.select("path", F.from_json(text, "verses array<struct<verse:int,text:string>>").alias("x"))
    rows = parsed.select("path", F.posexplode("x.verses").alias("pos", "v"))
    words = strip(F.coalesce("v.text", F.lit("")))
    return rows.where(words != "").select("path", "pos", F.concat_ws(" ", F.col("v.verse").cast("string"), words).alias("text"))


def harvest(raw: str | None, least: int = 15) -> list[str]:
    """The text of every object at any depth, stripped, once, of ``least`` characters or more, in document order."""
    try:
        root = json.loads(raw or "")
    except ValueError:
        return []
    found: dict[str, None] = {}
    pending = [root]
    while pending:
        node = pending.pop()
        if isinstance(node, dict):
            text = node.get("text")
            if isinstance(text, str) and len(text := text.strip()) >= least:
                found.setdefault(text)
            pending += [v for v in reversed(node.values()) if isinstance(v, dict | list)]
        elif isinstance(node, list):
            pending += reversed(node)
    return list(found)


def harvest_texts(documents: DataFrame, text: str = "text", least: int = 15) -> DataFrame:
    """documents' other columns, pos and text; JSON has no fixed depth, so this part is an Arrow-batched function."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: harvest(x, least))

    keep = [c for c in documents.columns if c != text]
    return documents.select(*keep, F.posexplode(run(text)).alias("pos", "text"))
