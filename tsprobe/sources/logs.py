"""Prediction logs and result tables: JSON lines, TSV in its ragged variants, run directories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tsprobe.functions import paths
from tsprobe.operators.results import upsert
from tsprobe.sources.recordings import placed_lines


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Strict scan: a malformed line stops the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_lines(spark: SparkSession, path: str | list[str], recursive: bool = False, glob: str | None = None) -> DataFrame:
    """Text lines with the file they come from: ``value``, ``file_path``, ``file_name``."""
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    lines = reader.text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name"))


def parse_jsonl(lines: DataFrame, schema: T.StructType, text: str = "value") -> DataFrame:
    """Every line with ``line_status`` blank, torn or valid and the parsed ``row`` (NULL unless valid)."""
    bad = "_corrupt"
    tolerant = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    parsed = lines.withColumn("_row", F.from_json(text, tolerant, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}))
    status = F.when(F.trim(text) == "", "blank").when(F.col("_row").isNull() | F.col(f"_row.{bad}").isNotNull(), "torn").otherwise("valid")
    out = parsed.withColumn("line_status", status)
    row = F.struct(*[F.col(f"_row.{f.name}").alias(f.name) for f in schema.fields])
    return out.withColumn("row", F.when(F.col("line_status") == "valid", row)).drop("_row")


def valid_rows(parsed: DataFrame) -> DataFrame:
    kept = [c for c in parsed.columns if c not in ("value", "line_status", "row")]
    return parsed.where("line_status = 'valid'").select(*kept, "row.*")


def line_counts(parsed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Total, valid and torn lines (per file or run)."""
    return parsed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("lines_total"), F.count_if(F.col("line_status") == "valid").alias("lines_valid"),
        F.count_if(F.col("line_status") == "torn").alias("lines_torn"),
    )


def write_jsonl(df: DataFrame, path: str, append: bool = True) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """TSV with a header, all columns text."""
    return spark.read.option("sep", "\t").option("header", "true").option("inferSchema", "false").csv(path)


def parse_ragged(lines: DataFrame, header: Sequence[str], text: str = "value", sep: str = "\t") -> DataFrame:
    """Exactly the header's columns: short rows padded with '', long rows cut, blank and header lines dropped.

    ``repaired`` marks the rows whose width was wrong.
    """
    n = len(header)
    rows = lines.where((F.trim(text) != "") & (F.col(text) != sep.join(header)))
    rows = rows.withColumn("_p", F.split(text, sep)).withColumn("repaired", F.size("_p") != n)
    return rows.select(*[F.coalesce(F.get("_p", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(header)], "repaired")


def read_ragged_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Ragged TSV; the first line of each file names the columns, and files that name others are an error."""
    placed = placed_lines(spark, path)
    first = placed.groupBy("_file").agg(F.min_by("value", F.struct("_block", "_line")).alias("header"))
    headers = sorted(r[0] for r in first.select("header").distinct().limit(2).collect())
    if len(headers) != 1:
        raise ValueError(f"files with different headers: {headers}" if headers else "no lines")
    return parse_ragged(placed.select("value"), headers[0].split("\t"))


def ragged_counts(lines: DataFrame, header: Sequence[str], text: str = "value") -> DataFrame:
    """How many lines were repaired and how many blank ones were dropped."""
    blank = F.trim(text) == ""
    wrong = ~blank & (F.size(F.split(text, "\t")) != len(header))
    return lines.agg(F.count_if(wrong).alias("repaired"), F.count_if(blank).alias("dropped"))


def parse_auto(lines: DataFrame, header_line: str, text: str = "value") -> DataFrame:
    """Tab- or space-separated rows by what the header uses; a time split by a space is joined again."""
    if "\t" in header_line:
        return parse_ragged(lines, header_line.split("\t"), text).drop("repaired")
    header = header_line.split()
    wide = [c + suffix for c in header for suffix in (("", ".1") if c == "timestamp" else ("",))]
    squeezed = lines.where(F.col(text) != header_line).withColumn(text, F.regexp_replace(F.trim(text), r"\s+", " "))
    rows = parse_ragged(squeezed, wide, text, " ").drop("repaired")
    if "timestamp" in header:
        joined = F.trim(F.concat_ws(" ", "timestamp", F.col("`timestamp.1`")))
        rows = rows.withColumn("timestamp", joined).drop("timestamp.1")
    return rows


def append_results(df: DataFrame, path: str) -> None:
    """Append result rows to the Parquet results table (a header is never needed)."""
    df.write.mode("append").parquet(path)


def export_tsv(df: DataFrame, path: str) -> None:
    """Results as TSV with a header per part file."""
    df.write.mode("overwrite").option("sep", "\t").option("header", "true").csv(path)


def upsert_snapshot(spark: SparkSession, existing: str | None, new: DataFrame, out: str, key: str = "pred_path", ts: str = "timestamp") -> DataFrame:
    """Write existing + new rows, latest per key, to a new snapshot folder (the old one stays readable)."""
    if existing == out:
        raise ValueError("write the snapshot to a new folder")
    old = spark.read.parquet(existing) if existing else new.limit(0)
    upsert(old, new, key, ts).write.mode("errorifexists").parquet(out)
    return spark.read.parquet(out)


def scan_predictions(spark: SparkSession, root: str, schema: T.StructType, style: str = "underscore") -> DataFrame:
    """All prediction files below ``root`` with their run keys; files inside ``best_params`` folders are left out."""
    lines = read_lines(spark, root, recursive=True, glob="*.jsonl").where(~F.col("file_path").contains("/best_params/"))
    return paths.run_keys(valid_rows(parse_jsonl(lines, schema)), "file_path", style)


def scan_layers(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """Probe predictions: only ``layer<N>.jsonl`` files."""
    lines = read_lines(spark, root, recursive=True, glob="layer*.jsonl").where(~F.col("file_path").contains("/best_params/"))
    return paths.run_keys(valid_rows(parse_jsonl(lines, schema)), "file_path", "hyphen")


def scan_variants(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """Variant logs with variant number, kinds and reasoning flag from the file name."""
    lines = read_lines(spark, root, recursive=True, glob="*.jsonl")
    rows = valid_rows(parse_jsonl(lines, schema)).withColumn("_k", paths.parse_variant_file(F.col("file_name")))
    return rows.select("*", "_k.*").drop("_k")
