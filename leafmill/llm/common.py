"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.storage import new_path, stored

__all__ = ["new_path", "stored"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside hands at most so many rows at once to Python; afterwards the session is as before."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def lean(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """function for mapInArrow, in a worker that gives memory back: large arrays are mapped, not kept in the heap, and what is free at the end is returned, for workers live on."""

    def run(batches: Iterator) -> Iterator:
        import ctypes

        import pyarrow as pa

        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):
            libc.mallopt(-3, 1 << 22)  # M_MMAP_THRESHOLD
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)

    return run


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, as new names: pick(df, id="doc_id"). What else the table has can't clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def replaced(df: DataFrame, new: dict[str, Column]) -> list[Column]:
    """The columns of df but those that new names, then new's."""
    low = {k.lower() for k in new}
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in low] + [v.alias(k) for k, v in new.items()]


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


#: Bits of a filter that is broadcast: at most FILTER_BITS / 64 rows, whatever it is made from.
FILTER_BITS = 1 << 24
_BITS = (f"pmod(`{{0}}`, {FILTER_BITS})", f"pmod(shiftrightunsigned(`{{0}}`, 32), {FILTER_BITS})")


def filter_of(keys: DataFrame, key: str) -> DataFrame:
    """slot, set: a Bloom filter of two bits for each key (a 64-bit hash)."""
    bits = keys.select(F.explode(F.array(*[F.expr(b.format(key)) for b in _BITS])).alias("bit"))
    one = F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("one")
    return bits.select(F.expr("bit div 64").alias("slot"), one).groupBy("slot").agg(F.bit_or("one").alias("set"))


def may_hold(rows: DataFrame, key: str, filter_: DataFrame) -> DataFrame:
    """The rows whose key is in the filter: all that were put in, and a few others."""
    columns = rows.columns
    for b in _BITS:
        rows = _asked(rows, key, filter_, b, "inner").where("__in").select(*columns)
    return rows


def _asked(rows: DataFrame, key: str, filter_: DataFrame, bit: str, how: str) -> DataFrame:
    """rows with __in: whether the bit of their key is set in the filter."""
    asked = rows.withColumn("__bit", F.expr(bit.format(key))).withColumn("__slot", F.expr("__bit div 64"))
    slots = filter_.select(F.col("slot").alias("__s"), F.col("set").alias("__set"))
    found = asked.join(F.broadcast(slots), F.col("__slot") == F.col("__s"), how)
    return found.withColumn("__in", F.expr("coalesce(shiftrightunsigned(__set, cast(__bit % 64 as int)) & 1L = 1L, false)")).drop("__bit", "__slot", "__s", "__set")


def without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows (stored) whose key (a 64-bit hash or number) is none of gone's one column: only those that a filter takes for gone are moved by a join."""
    named = gone.toDF("__gone")
    filter_ = stored(filter_of(named, "__gone"), "without-filter")
    told = rows
    for k, b in enumerate(_BITS):
        told = _asked(told, key, filter_, b, "left").withColumnRenamed("__in", f"__in{k}")
    may = F.expr(" and ".join(f"__in{k}" for k in range(len(_BITS))))
    some = told.where(may).join(named, F.col(f"`{key}`") == F.col("__gone"), "left_anti")
    return told.where(~may).unionByName(some).select(*[F.col(f"`{c}`") for c in rows.columns])
