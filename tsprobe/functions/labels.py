"""Label maps: remapping, dense ids, letters, lookups and option blocks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tsprobe.operators.ordering import null_safe_join, positions


def numeric_first(c: Column | str) -> list[Column]:
    """Sort keys that put integers before text, each in its own order."""
    c = F.col(c) if isinstance(c, str) else c
    number = c.cast("string").try_cast("bigint")
    return [number.isNull(), number, c.cast("string")]


def remap(df: DataFrame, label: str, mapping: Mapping[int, int]) -> DataFrame:
    """Replace labels and drop the rows whose label is not in ``mapping`` (a constant map, no join)."""
    pairs = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    return df.where(F.col(label).isin(list(mapping))).withColumn(label, F.try_element_at(pairs, F.col(label)))


def zero_base(df: DataFrame, label: str, split: str) -> DataFrame:
    """Subtract the smallest train label from every split."""
    low = df.where(F.col(split) == "train").agg(F.min(label)).scalar()
    return df.withColumn(label, F.col(label) - low)


def dense_index(train: DataFrame, df: DataFrame, label: str, name: str = "y") -> DataFrame:
    """Dense 0-based ids from the train labels; a label that train never saw is an error."""
    codes = positions(train.select(label).distinct(), [], [label], name)
    out = df.join(codes, label, "left")
    message = F.concat(F.lit("label not in train: "), F.coalesce(F.col(label).cast("string"), F.lit("NULL")))
    return out.withColumn(name, F.when(F.col(name).isNull(), F.raise_error(message).cast("bigint")).otherwise(F.col(name)))


def letter(rank: Column) -> Column:
    """1 -> A ... 26 -> Z, 27 -> AA ...: as many letters as a BIGINT rank needs, 14 at most."""
    steps = F.sequence(F.lit(1), F.lit(14))
    start = F.struct(rank.cast("bigint").alias("left"), F.lit("").alias("text"))

    def add(done: Column, _: Column) -> Column:
        last = F.char((F.lit(65) + (done["left"] - 1) % 26).cast("int"))
        longer = F.struct(F.floor((done["left"] - 1) / F.lit(26)).alias("left"), F.concat(last, done["text"]).alias("text"))
        return F.when(done["left"] > 0, longer).otherwise(done)

    return F.aggregate(steps, start, add, lambda done: done["text"])


def with_letters(names: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Option letters for a label table, integers first, per ``keys``."""
    ordered = names
    parts = ["_o0", "_o1", "_o2"]
    for part, c in zip(parts, numeric_first(label)):
        ordered = ordered.withColumn(part, c)
    ordered = ordered.withColumn("_o0", F.col("_o0").cast("int"))
    return positions(ordered, keys, parts, "_r").withColumn("letter", letter(F.col("_r") + 1)).drop(*parts)


def option_block(lettered: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """The fixed header ``Your options are:`` followed by one ``[A] name`` line per label."""
    tagged = F.struct("_r", F.concat(F.lit("["), F.col("letter"), F.lit("] "), F.col(name)).alias("line"))
    lines = F.sort_array(F.collect_list(tagged))["line"]
    # fixed value: the header of an option block
    text = F.concat(F.lit("Your options are:\n\t"), F.array_join(lines, "\n\t"))
    return lettered.groupBy(*keys).agg(text.alias("block"))


def attach_labels(df: DataFrame, label: str, maps: DataFrame) -> DataFrame:
    """Name and letter of an integer or text label id."""
    keyed = df.withColumn("_id", F.col(label).cast("string"))
    right = maps.select(F.col("label").cast("string").alias("_id"), "name", "letter")
    return null_safe_join(keyed, right, ["_id"], "left").drop("_id")


def numeric_order(df: DataFrame, key: str, name: str = "pos") -> DataFrame:
    """0-based position of each key with numbers before text."""
    parts = ["_o0", "_o1", "_o2"]
    keyed = df.withColumns(dict(zip(parts, numeric_first(key))))
    return positions(keyed.withColumn("_o0", F.col("_o0").cast("int")), [], parts, name).drop(*parts)
