"""Schemas, and the read view over chunk tables of different shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RAW = "text string, section string, language string"
CHUNKS = "id long, text string, book string, pitaka string, source string, religion string, language string"
HITS = "query_id long, rank int, id long, score double"
ANSWER = "answer string, sources array<string>, scores array<double>, flagged boolean, low_confidence boolean, warnings array<string>"

#: For each column of the view, the columns that may stand for it, first present wins.
STANDS_FOR = {
    "book": ["book", "title", "scripture", "section"],
    "pitaka": ["pitaka", "testament", "section"],
    "source": ["source"],
    "religion": ["religion"],
    "language": ["language"],
}


def normalize_chunks(chunks: DataFrame, religion: str) -> DataFrame:
    """id, text and the view's columns; the choice is by column, not by row."""
    default = {"religion": religion, "language": "en"}
    out = []
    for name, options in STANDS_FOR.items():
        found = next((c for c in options if c in chunks.columns), None)
        value = F.lit(default.get(name, "")) if found is None else F.col(found)
        if name == "pitaka" and found not in (None, "pitaka"):
            value = F.coalesce(value, F.lit(""))
        out.append(value.alias(name))
    return chunks.select("id", "text", *out)
