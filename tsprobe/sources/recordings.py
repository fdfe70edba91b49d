"""Raw recordings: time-series text files, sensor logs, label files, plain CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tsprobe.functions import series as fs
from tsprobe.operators.ordering import positions
from tsprobe.session import materialise


#: Where a text line lies: its file, the block of the file that was read, and its place in the block.
LINE_PLACE = ["_file", "_block", "_line"]


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with ``LINE_PLACE``; the order does not depend on which task reads which block."""
    read = spark.read.text(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    return read.withColumn("_line", F.monotonically_increasing_id())  # grows inside a block, which one task reads


def with_line_order(lines: DataFrame, name: str = "idx") -> DataFrame:
    """Dense 0-based index in order of ``LINE_PLACE``; the lines are written out first, so that every pass sees the same places."""
    return positions(materialise(lines), [], LINE_PLACE, name).drop(*LINE_PLACE)


def parse_ts(lines: DataFrame, text: str = "value") -> DataFrame:
    """``.ts`` lines (channels split by ``:``, values by ``,``, label last) to ``x`` (T, C) and ``y``."""
    body = lines.where(~F.trim(text).startswith("@") & ~F.trim(text).startswith("#") & (F.trim(text) != ""))
    parts = body.withColumn("_p", F.split(text, ":")).withColumn("_n", F.size("_p"))
    channels = F.transform(
        F.slice("_p", 1, F.col("_n") - 1), lambda c: F.transform(F.split(F.trim(c), ","), lambda v: F.trim(v).try_cast("double"))
    )
    cols = [c for c in lines.columns if c != text]
    return parts.select(*cols, fs.transpose(channels).alias("x"), F.trim(F.element_at("_p", -1)).try_cast("int").alias("y"))


def read_ts(spark: SparkSession, path: str) -> DataFrame:
    """A ``.ts`` file as ``idx``, ``x``, ``y``."""
    body = placed_lines(spark, path).where(~F.trim("value").startswith("@") & (F.trim("value") != ""))
    return parse_ts(with_line_order(body))


def _number_text(v: Column, precision: int) -> Column:
    """Fixed decimals without trailing zeros and trailing point."""
    text = F.bround(v.cast("double").cast(f"decimal(38,{min(18, precision + 8)})"), precision).cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def format_ts(df: DataFrame, x: str, y: str, precision: int = 6) -> DataFrame:
    """One text line per case."""
    channels = F.transform(fs.transpose(F.col(x)), lambda ch: F.array_join(F.transform(ch, lambda v: _number_text(v, precision)), ","))
    return df.withColumn("value", F.concat(F.array_join(channels, " : "), F.lit(" : "), F.col(y).cast("string")))


def ts_header(df: DataFrame, x: str, y: str, name: str) -> DataFrame:
    """Header lines from aggregates; series of different lengths are an error."""
    s = df.agg(
        F.min(F.size(x)).alias("lo"), F.max(F.size(x)).alias("hi"), F.max(F.size(F.element_at(F.col(x), 1))).alias("c"),
        F.array_sort(F.collect_set(F.col(y))).alias("labels"),
    )
    length = F.when(F.col("lo") == F.col("hi"), F.col("hi")).otherwise(F.raise_error(F.lit("series lengths differ")).cast("int"))
    lines = F.array(
        F.lit(f"@problemName {name}"), F.lit("@timestamps false"),
        F.concat(F.lit("@univariate "), F.when(F.col("c") == 1, "true").otherwise("false")), F.lit("@equalLength true"),
        F.concat(F.lit("@seriesLength "), length.cast("string")), F.lit("@missing false"),
        F.concat(F.lit("@classLabel true "), F.array_join(F.col("labels").cast("array<string>"), " ")), F.lit("@data"),
    )
    return s.select(F.explode(lines).alias("value"))


def write_ts(df: DataFrame, x: str, y: str, path: str, name: str, precision: int = 6) -> None:
    """Cases under ``path/cases`` in parallel part files, the header under ``path/header``."""
    format_ts(df, x, y, precision).select("value").write.mode("errorifexists").text(f"{path}/cases")
    ts_header(df, x, y, name).coalesce(1).write.mode("errorifexists").text(f"{path}/header")


def parse_sensor_log(lines: DataFrame, n_columns: int, text: str = "value", file_name: str = "file_name") -> DataFrame:
    """Whitespace-separated numbers, label last; subject from the digits of the file name. A wrong width is an error."""
    parts = lines.where(F.trim(text) != "").withColumn("_p", F.split(F.trim(text), r"\s+"))
    message = F.concat(F.col(file_name), F.lit(" has "), F.size("_p").cast("string"), F.lit(f" columns, expected {n_columns}"))
    checked = F.when(F.size("_p") == n_columns, F.col("_p")).otherwise(F.raise_error(message).cast("array<string>"))
    parts = parts.withColumn("_p", checked)
    cols = [c for c in lines.columns if c not in (text, file_name)]
    return parts.select(
        *cols, F.regexp_extract(file_name, r"(\d+)\D*$", 1).cast("bigint").alias("subject_id"),
        F.transform(F.slice("_p", 1, n_columns - 1), lambda v: v.cast("double")).alias("ch"),
        F.element_at("_p", -1).cast("double").cast("int").alias("label"),
    )


def parse_label_csv(lines: DataFrame, text: str = "value") -> DataFrame:
    """``filename,label`` lines to ``stem`` and ``y``: 0/1 as they are, 2 becomes 1, others are an error; header skipped."""
    cells = lines.where(F.trim(text) != "").withColumn("_c", F.split(text, ",")).where(F.size("_c") >= 2)
    name, raw = F.trim(F.get("_c", F.lit(0))), F.trim(F.get("_c", F.lit(1)))
    number = F.floor(raw.try_cast("double")).cast("int")
    body = cells.where(~(number.isNull() & F.lower(F.concat(name, raw)).rlike("file|label")))
    message = F.concat(F.lit("unexpected label "), raw, F.lit(" for "), name)
    y = F.when(number.isin(0, 1), number).when(number == 2, 1).otherwise(F.raise_error(message).cast("int"))
    cols = [c for c in lines.columns if c != text]
    return body.select(*cols, F.regexp_replace(F.regexp_replace(name, "^.*/", ""), r"(?<=.)\.[^.]+$", "").alias("stem"), y.alias("y"))


def label_recordings(recordings: DataFrame, labels: DataFrame) -> DataFrame:
    """Recordings with a label, by stem; the others are skipped."""
    return recordings.join(labels.select("stem", "y"), "stem", "inner")


def unlabelled(recordings: DataFrame, labels: DataFrame) -> DataFrame:
    return recordings.join(labels.select("stem"), "stem", "left_anti")


def read_series_csv(spark: SparkSession, path: str, schema: T.StructType, time: str, value: str) -> DataFrame:
    """One series from a CSV: ``pos`` by time order and ``v`` (NULL where the text is no number)."""
    rows = spark.read.schema(schema).option("header", "true").csv(path)
    return positions(rows.select(F.col(time).alias("time"), F.col(value).cast("string").try_cast("double").alias("v")), [], ["time"])


def read_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Text files of a folder, whole, with their numeric rank."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    return rank_variants(files.select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text")))


def rank_variants(files: DataFrame) -> DataFrame:
    """Rank by the first number in the name (files without one last), then by name."""
    digits = F.nullif(F.regexp_extract("name", r"(\d+)", 1), F.lit(""))
    keyed = files.withColumn("_none", digits.isNull().cast("int")).withColumn("_n", digits.try_cast("decimal(38,0)"))
    return positions(keyed, [], ["_none", "_n", "name"], "rank").drop("_none", "_n")


def zip_equal(left: DataFrame, right: DataFrame, place: str) -> DataFrame:
    """Rows of both tables with the same ``place``; a row without a partner is an error, so equal lengths are enforced."""
    a = left.withColumn("_a", F.lit(1))
    b = right.withColumnRenamed(place, "_place").withColumn("_b", F.lit(1))
    both = a.join(b, F.col(place) == F.col("_place"), "full_outer")
    message = F.concat(F.lit("no partner at place "), F.coalesce(place, "_place").cast("string"))
    checked = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.col(place)).otherwise(F.raise_error(message).cast(left.schema[place].dataType))
    return both.withColumn(place, checked).drop("_a", "_b", "_place")


def pair_variants(systems: DataFrame, questions: DataFrame, strict: bool = False) -> DataFrame:
    """i-th system text with the i-th question text; the longer list is cut, or an error if ``strict``."""
    left, right = systems.select("rank", F.col("text").alias("system")), questions.select("rank", F.col("text").alias("question"))
    both = zip_equal(left, right, "rank") if strict else left.join(right, "rank")
    return both.withColumn("variant", F.col("rank") + 1)


def trial_samples(df: DataFrame, keys: Sequence[str], order: Sequence[str], channels: Sequence[str], label: str | None = None) -> DataFrame:
    """Any sensor table to positioned samples: keys, ``t``, ``ch``, ``label``."""
    ch = F.array(*[F.col(c).cast("double") for c in channels])
    lab = F.col(label) if label else F.lit(None).cast("int")
    return positions(df.select(*keys, *order, ch.alias("ch"), lab.alias("label")), keys, order, "t")
