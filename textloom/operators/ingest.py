"""Progress tables, section upserts, repair checks and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.storage import cut


def pending(expected: DataFrame, completed: DataFrame, key: str, alternate: str | None = None) -> DataFrame:
    """Expected work without what is completed under its key or its alternate name."""
    out = expected.join(completed.select(key).distinct(), key, "left_anti")
    if alternate:
        done = completed.select(F.col(key).alias(alternate)).distinct()
        out = out.join(done, alternate, "left_anti")
    return out.select(expected.columns)


def upsert_section(existing: DataFrame, new: DataFrame, section: str = "section") -> DataFrame:
    """existing without the sections of new, then new."""
    return existing.join(new.select(section).distinct(), section, "left_anti").select(existing.columns).unionByName(new)


def write_sections(df: DataFrame, path: str, section: str = "section") -> None:
    """Replaces only the sections (partitions) that df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(section).parquet(path)


def upsert_progress(progress: DataFrame, changes: DataFrame, key: str = "key") -> DataFrame:
    return upsert_section(progress, changes, key)


def reset_progress(progress: DataFrame, key: str = "key", suffix: str | None = None, name: str | None = None, empty: bool = False, keep: str | None = None) -> DataFrame:
    """Progress after a reset: of a language (key suffix), of one key, of all that found nothing but ``keep``, or of all."""
    if suffix is not None:
        return progress.where(~F.col(key).endswith(suffix))
    if name is not None:
        return progress.where(F.col(key) != name)
    if empty:
        return progress.where((F.col("n") > 0) | F.col(key).eqNullSafe(keep))
    return progress.limit(0)


def similar_keys(progress: DataFrame, name: str, key: str = "key") -> DataFrame:
    """Keys that contain a name or are contained in it, as suggestions."""
    low = F.lower(key)
    return progress.where(low.contains(name.lower()) | F.contains(F.lit(name.lower()), low)).select(key)


def stats(items: DataFrame, key: str, ok: Column, n: Column) -> DataFrame:
    return items.groupBy(key).agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("warn"), F.sum(n).alias("count"))


def repair(progress: DataFrame, group: Column, expected: DataFrame, key: str = "key") -> DataFrame:
    """Groups whose completed keys found nothing at all, and keys below their expected number."""
    empty = progress.groupBy(group.alias("name")).agg(F.count("*").alias("completed"), F.sum("n").alias("n")).where("completed > 0 AND n = 0")
    short = progress.join(expected, key).where("n < expected").select(F.col(key).alias("name"), F.lit(1).cast("long").alias("completed"), "n")
    return empty.withColumn("problem", F.lit("empty")).unionByName(short.withColumn("problem", F.lit("short")))


def feedback_rows(rows: DataFrame, most: int = 2000) -> DataFrame:
    """Question, answer and comment cut to ``most`` characters; an empty rating is null."""
    cut = {c: F.substring(F.coalesce(c, F.lit("")), 1, most) for c in ("question", "answer", "comment")}
    return rows.withColumns(cut | {"rating": F.nullif("rating", F.lit(""))})


def write_chunks(chunks: DataFrame, path: str) -> None:
    """The chunk table, without the text that was embedded, in partitions that searches prune."""
    chunks.drop("embed_text").write.mode("overwrite").partitionBy("religion", "language").parquet(path)


def read_sections(spark: SparkSession, path: str, section: str = "section") -> DataFrame:
    """A table of write_sections, with its section as text whatever the names look like."""
    found = spark.read.parquet(path).schema
    return spark.read.schema(T.StructType([T.StructField(f.name, T.StringType() if f.name == section else f.dataType) for f in found])).parquet(path)


def clean_in_place(spark: SparkSession, path: str, keep: Column, section: str = "section") -> DataFrame:
    """Removes rows that fail ``keep`` from a table of write_sections; section, before, removed of the sections that lose rows.

    Only those sections' partitions are written again, from rows that are staged in the shared folder first; the files
    of all others stay as they are. A section without rows left goes. A failure before the last step leaves the table
    as it was, one within it some sections cleaned and some not: a second call ends the work.
    """
    table = read_sections(spark, path, section)
    kept = F.coalesce(keep, F.lit(False))
    lost = table.groupBy(section).agg(F.count("*").alias("before"), F.count_if(~kept).alias("removed"), F.min("_metadata.file_path").alias("_file")).where("removed > 0")
    lost = cut(lost, "clean-sections")
    staged = cut(table.join(lost.where("removed < before").select(section), section, "left_semi").where(kept).select(table.columns), "clean-rows")
    if staged.take(1):
        write_sections(staged, path, section)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for row in lost.where("removed = before").select("_file").toLocalIterator():
        folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(row["_file"])).getParent()
        folder.getFileSystem(conf).delete(folder, True)
    return lost.select(section, "before", "removed")


def table_totals(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """name, n_files, n_bytes, n_rows of Parquet tables, from file listings and footers: no column is read."""
    out = None
    for name, path in paths.items():
        files = spark.read.parquet(path).groupBy("_metadata.file_path").agg(F.max("_metadata.file_size").alias("n"), F.count("*").alias("n_rows"))
        own = files.agg(F.lit(name).alias("name"), F.count("*").alias("n_files"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_bytes"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"))
        out = own if out is None else out.unionByName(own)
    return out
