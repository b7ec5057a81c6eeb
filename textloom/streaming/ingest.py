"""Resumable ingest: new section files once each, by a stream that stops when all are read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.ingest import read_sections
from textloom.sources.jsonfiles import decode_text, section_of, sections


def ingest_sections(spark: SparkSession, source: str, target: str, checkpoint: str) -> None:
    """Reads the files below source that earlier runs haven't read and appends their rows to the Parquet table target.

    Each file is read once (the checkpoint knows which); a batch that is repeated after a failure replaces its own
    folder, so rows come once.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load(source)

    def write(batch: DataFrame, number: int) -> None:
        rows = sections(batch.select("path", decode_text(F.col("content")).alias("text")))
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _replace(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("section", "language").parquet(path)


def ingest_with_progress(spark: SparkSession, source: str, target: str, progress: str, checkpoint: str, files_at_once: int = 1000, before_commit: Callable[[int], None] | None = None) -> None:
    """Reads new section files into the table target, where a file replaces its section and language, and keeps progress.

    progress has section, language, n, ok (whether any text was found) and batch. Both tables are replaced partition by
    partition, rows first: a batch that stops in between and runs again gives the same tables, and what progress names
    is in the target. Of several files of a section and language in one batch the last path counts. before_commit is
    called between the two writes.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_at_once)

    def write(batch: DataFrame, number: int) -> None:
        section, language = section_of(F.col("path"))
        files = batch.select(section.alias("section"), language.alias("language"), F.struct("path", decode_text(F.col("content")).alias("text")).alias("file"))
        last = files.groupBy("section", "language").agg(F.max("file").alias("file"))
        items = last.select("section", "language", F.from_json("file.text", "array<string>").alias("items"))
        rows = items.select("section", "language", F.posexplode("items").alias("pos", "text"))
        _replace(rows, target)
        if before_commit is not None:
            before_commit(number)
        found = items.select("section", "language", F.coalesce(F.size("items"), F.lit(0)).alias("n"))
        _replace(found.withColumns({"ok": F.col("n") > 0, "batch": F.lit(number)}), progress)

    stream.load(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def reset_sections(spark: SparkSession, progress: str, language: str) -> DataFrame:
    """Progress without a language, as ingest.reset_progress has it for keys with that suffix."""
    return read_sections(spark, progress).where(F.col("language") != language)


def read_ingested(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).drop("batch")
