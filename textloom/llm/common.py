"""Helpers that the training-data operators share."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.storage import cut, scratch, shared_dir

__all__ = ["attach_groups", "cut", "let_go", "map_texts", "partitions", "scratch", "shared_dir", "slices", "text_or_empty", "worker_cache", "worker_tool"]

#: A group is hot when it holds more than 1/HOT_SHARE of all rows, so there are
#: fewer than HOT_SHARE hot groups whatever the input: the bound of every
#: broadcast below.
HOT_SHARE = 1024
#: Texts that are taken from an Arrow batch at once.
TEXTS_AT_ONCE = 512


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, for loaded models and vocabularies."""
    return sys.modules.setdefault("_textloom_worker_cache", types.ModuleType("_textloom_worker_cache")).__dict__


def worker_tool(key: object, make: Callable[[], object]) -> object:
    """What make() gives, kept for this key by the Python worker, which holds one tool at a time: workers outlive their
    jobs, so those of several steps would add up."""
    cache = worker_cache()
    if cache.get("tool", (None,))[0] != key:
        let_go()
        cache["tool"] = (key, make())
    return cache["tool"][1]


def let_go() -> None:
    """Drops the worker's tool; for tasks that need memory for something else."""
    worker_cache().pop("tool", None)


def slices(batches: Iterable, rows: int = TEXTS_AT_ONCE) -> Iterator:
    """Arrow batches in slices of so many rows. What earlier batches took goes back to the system: Arrow's pool would
    keep it, several batches of 10,000 texts in each worker."""
    import pyarrow as pa

    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)
        del whole
        pa.default_memory_pool().release_unused()


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def map_texts(rows: DataFrame, make: Callable[[], Callable[[list], list]], fields: str, text: str = "text") -> DataFrame:
    """rows without the text column, with the columns ``fields`` (DDL) that a function gives for lists of texts.

    make() returns that function in each task; it returns a list of values for each field. All other columns, such as
    ids, stay the Arrow arrays they are: nulls and integers of 64 bits never pass through pandas.
    """
    kept = [f for f in rows.schema if f.name != text]
    added = T.StructType.fromDDL(fields)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        function, names = make(), [f.name for f in (*kept, *added)]
        kinds = [to_arrow_type(f.dataType) for f in added]
        for b in slices(batches):
            found = function(b.column(text).to_pylist())
            arrays = [b.column(f.name) for f in kept] + [pa.array(c, k) for c, k in zip(found, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return rows.mapInArrow(run, T.StructType([*kept, *added]))


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, spread: Column, weight: str) -> DataFrame:
    """rows left join groups on key, safe for a key that holds any share of the rows.

    groups has one row per key and in ``weight`` the number of rows of that key; it is read twice, so pass a table
    that was cut. Groups above 1/HOT_SHARE of the total weight are fewer than HOT_SHARE and go by broadcast; the
    others by a shuffle in which no key is hot. ``spread`` deals the rows that need no partner over all tasks.
    Keys that are null match nothing. Helper columns have names of their own, whatever columns rows has.
    """
    tag = uuid.uuid4().hex[:12]
    hot_key, hot, cold_key, cold, cold_salt, row_key, row_salt = (f"_{n}_{tag}" for n in ("hot_key", "hot", "cold_key", "cold", "cold_salt", "row_key", "row_salt"))
    total = groups.agg(F.sum(weight)).first()[0] or 0
    values = [c for c in groups.columns if c != key]
    packed = groups.select(F.col(key).alias(cold_key), F.struct(*values).alias(cold))
    is_hot = F.col(f"{cold}.{weight}") * HOT_SHARE > total
    few = packed.where(is_hot).select(F.col(cold_key).alias(hot_key), F.col(cold).alias(hot))
    many = packed.where(~is_hot).withColumn(cold_salt, F.lit(0).cast("long"))
    out = rows.join(F.broadcast(few), F.col(key) == F.col(hot_key), "left").drop(hot_key)
    lone = F.col(hot).isNotNull() | F.col(key).isNull()
    out = out.withColumns({row_key: F.when(~lone, F.col(key)), row_salt: F.when(lone, F.xxhash64(spread)).otherwise(F.lit(0).cast("long"))})
    out = out.join(many, (F.col(row_key) == F.col(cold_key)) & (F.col(row_salt) == F.col(cold_salt)), "left")
    found = F.coalesce(hot, cold)
    return out.select(*rows.columns, *[found[c].alias(c) for c in values])
