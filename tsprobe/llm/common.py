"""What several operators share: texts as columns, blocks of documents, sliced running sums, cut lineage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tsprobe.session import scratch_dir

#: Bytes of the white space that parts words; everything else belongs to a word.
SPACES = " \\t\\n\\u000B\\f\\r"
WORD = f"[^{SPACES}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(column: str = "text") -> Column:
    """The text; a null is the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words(value: Column) -> Column:
    """The words of a text as an array."""
    return F.filter(F.split(value, f"[{SPACES}]+"), lambda w: w != "")


def count_words(value: Column) -> Column:
    return F.regexp_count(value, F.lit(WORD)).cast("long")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def saved(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet below the shared folder that the session names, and read back: cut lineage, by column."""
    path = scratch_dir(df.sparkSession, "llm")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_blocks(docs: DataFrame, columns: list[Column], block_bytes: int = 16 << 20) -> tuple[DataFrame, int]:
    """Documents dealt by ``doc_id`` into blocks of about ``block_bytes`` of text, each in one partition; and their number.

    The table has the given columns and ``block``, and is partitioned by ``block``: grouping by it moves nothing more,
    and plans that use it twice read the same shuffle.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text()))).first()[0] or 0
    n = max(shuffle_partitions(spark), -(-size // block_bytes))
    block = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(n)).cast("int").alias("block")
    return docs.select(*columns, block).repartition(n, "block"), n


def give_back() -> None:
    """Freed memory goes back to the system: a worker outlives its task, and the next stages need the room beside it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(f: Callable) -> Callable:
    """``f`` of a group, of a key and a group, or of a key and two groups; afterwards the worker gives back its memory."""

    def done(*args):
        try:
            return f(*args)
        finally:
            give_back()

    return {1: lambda a: done(a), 2: lambda a, b: done(a, b), 3: lambda a, b, c: done(a, b, c)}[f.__code__.co_argcount]


def running(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, slice_rows: int = 5_000) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows before this one among those with equal keys.

    Rows are ordered by a hash slice and then by ``order``. Only a slice is sorted in one task; the table of slice
    sums has one row per key and slice. A hot key has as many slices as its rows fill.
    """
    counts = df.groupBy(*keys).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / slice_rows)).alias("_n"))
    nulls = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    on = nulls[0]
    for c in nulls[1:]:
        on = on & c
    sliced = df.alias("a").join(counts.alias("b"), on, "left").select("a.*", F.pmod(F.xxhash64(*[F.col(f"a.{c}") for c in order]), F.col("_n")).alias("_slice"), value.alias("_v"))
    sums = sliced.groupBy(*keys, "_slice").agg(F.sum("_v").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = sliced.withColumn("_local", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    on = F.col("a._slice") == F.col("b._slice")
    for c in nulls:
        on = on & c
    total = (F.col("a._local") + F.col("b._before")).cast("long")
    return local.alias("a").join(sums.alias("b"), on).select(*[F.col(f"a.{c}") for c in df.columns], total.alias(name))
