"""Assertions and summaries as tables: coverage, alignment, validity, dataset statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tsprobe.operators.ordering import null_safe_join

#: The kinds of input a run may name.
INPUT_KINDS = ["ust", "vis", "ts", "lets"]


def class_coverage(train: DataFrame, test: DataFrame, label: str, enforce: bool = False) -> DataFrame:
    """Every label with its presence in both splits; ``enforce`` turns a gap into an error."""
    left = train.select(F.col(label).alias("_a")).distinct()
    right = test.select(F.col(label).alias("_b")).distinct()
    both = left.join(right, F.col("_a") == F.col("_b"), "full_outer")
    out = both.select(
        F.coalesce("_a", "_b").alias(label), F.col("_a").isNotNull().alias("in_train"), F.col("_b").isNotNull().alias("in_test")
    ).withColumn("ok", F.col("in_train") & F.col("in_test"))
    if enforce:
        message = F.concat(F.lit("class on one side only: "), F.col(label).cast("string"))
        out = out.withColumn("ok", F.when(F.col("ok"), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
    return out


def row_alignment(rows: DataFrame, vectors: DataFrame, idx: str, vec: str, label: str | None = None) -> DataFrame:
    """One row: rows on both sides, unmatched rows, distinct vector sizes, disagreeing labels."""
    left = rows.select(F.col(idx).alias("_l"), (F.col(label) if label else F.lit(0)).alias("_ly"))
    right = vectors.select(F.col(idx).alias("_r"), F.size(vec).alias("_d"), (F.col(label) if label else F.lit(0)).alias("_ry"))
    joined = left.join(right, F.col("_l") == F.col("_r"), "full_outer")
    return joined.agg(
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("n_rows"),
        F.count_if(F.col("_r").isNull()).alias("only_left"),
        F.count_if(F.col("_l").isNull()).alias("only_right"),
        F.countDistinct("_d").alias("n_dims"),
        F.count_if(F.col("_ly") != F.col("_ry")).alias("label_mismatch"),
    )


def layer_alignment(embeddings: DataFrame) -> DataFrame:
    """Per layer: rows and vector sizes of both splits, and whether they agree."""
    per = embeddings.groupBy("layer").agg(
        F.count_if(F.col("split") == "train").alias("n_train"),
        F.count_if(F.col("split") == "test").alias("n_test"),
        F.countDistinct(F.size("vec")).alias("n_dims"),
    )
    return per.withColumn("ok", (F.col("n_train") > 0) & (F.col("n_test") > 0) & (F.col("n_dims") == 1))


def valid_kinds(kinds: Column) -> Column:
    """Does this comma-separated text name two or three different kinds, ``ust`` among them and only one kind of series text?"""
    named = F.split(kinds, ",")
    known = F.size(F.array_except(named, F.array(*map(F.lit, INPUT_KINDS)))) == 0
    different = F.size(F.array_distinct(named)) == F.size(named)
    one_series_text = ~(F.array_contains(named, "ts") & F.array_contains(named, "lets"))
    return known & different & F.size(named).between(2, 3) & F.array_contains(named, "ust") & one_series_text


def same_kinds(a: Column, b: Column) -> Column:
    """Order-free comparison of two kind strings (comma or hyphen separated)."""

    def norm(c: Column) -> Column:
        return F.array_sort(F.split(F.replace(c, F.lit("-"), F.lit(",")), ","))

    return norm(a) == norm(b)


def cross_dataset(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """Train rows of one dataset with test rows of another under a new name."""
    both = a.where(F.col("split") == "train").unionByName(b.where(F.col("split") == "test"))
    return both.withColumn("dataset", F.lit(name))


def dataset_statistics(df: DataFrame, split: str, label: str, x: str, subject: str | None = None) -> DataFrame:
    """Rows, sample sizes, shapes, subjects, classes and the class histogram (JSON text) per split.

    ``x`` is an array of values (one channel) or an array of channels. ``n_steps`` is the longest sample, ``n_shapes`` the number
    of different (channels, steps). Rows are counted per (class, subject, shape) first; what is distinct is counted on those.
    """
    nested = df.schema[x].dataType.elementType.typeName() == "array"
    steps, channels = (F.size(F.col(x)[0]), F.size(x)) if nested else (F.size(x), F.lit(1))
    cells = df.groupBy(split, F.col(label).alias("_l"), (F.col(subject) if subject else F.lit(None).cast("int")).alias("_s"), steps.alias("_t"), channels.alias("_k")).agg(F.count(F.lit(1)).alias("_c"))
    sizes = cells.groupBy(split).agg(
        F.sum("_c").alias("n_rows"), F.min("_t").alias("least_steps"), (F.sum(F.col("_t") * F.col("_c")) / F.sum("_c")).alias("mean_steps"), F.max("_t").alias("n_steps"),
        F.countDistinct("_t", "_k").alias("n_shapes"), F.max("_k").alias("n_channels"), F.countDistinct("_s").alias("n_subjects"),
    )
    pairs = F.sort_array(F.collect_list(F.struct(F.col("_l").alias("l"), F.col("_c").alias("c"))))
    text = F.transform(pairs, lambda p: F.concat(F.lit('"'), p["l"].cast("string"), F.lit('":'), p["c"].cast("string")))
    classes = cells.groupBy(split, "_l").agg(F.sum("_c").alias("_c")).groupBy(split).agg(F.count("_l").alias("n_classes"), F.concat(F.lit("{"), F.array_join(text, ","), F.lit("}")).alias("histogram"))
    return null_safe_join(sizes, classes, [split])
