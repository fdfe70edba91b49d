"""Split folders, artifacts and QA documents."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from tsprobe.functions.labels import attach_labels
from tsprobe.operators.scaling import znorm_windows
from tsprobe.schema import QA_DOCUMENT, SERIES_WINDOWS


def write_split(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Windows partitioned by dataset and split; an existing folder is only replaced when asked."""
    df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("dataset", "split").parquet(path)


def load_windows(
    spark: SparkSession,
    path: str,
    dataset: str,
    split: str | None = None,
    normalise: bool = False,
    on_constant: str = "raise",
    label_map: DataFrame | None = None,
) -> DataFrame:
    """Windows of one dataset (partition-pruned), optionally z-normalised and with label names."""
    rows = spark.read.schema(SERIES_WINDOWS).parquet(path).where(F.col("dataset") == dataset)
    if split is not None:
        if split not in ("train", "test", "dev"):
            raise ValueError(f"unknown split {split!r}")
        rows = rows.where(F.col("split") == split)
    if normalise:
        rows = znorm_windows(rows, "x", on_constant)
    return attach_labels(rows, "y", label_map) if label_map is not None else rows


def _whole_text(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.text(path, wholetext=True)
    except AnalysisException:
        warnings.warn(f"missing artifact {path}")
        return None


def parse_class_shots(text: DataFrame, col: str = "value") -> DataFrame:
    """``{"0": [7, 9]}`` to (label, rank, idx)."""
    parsed = text.select(*[c for c in text.columns if c != col], F.from_json(col, "map<string,array<bigint>>").alias("_m"))
    keep = [c for c in parsed.columns if c != "_m"]
    rows = parsed.select(*keep, F.explode("_m").alias("label", "idxs"))
    return rows.select(*keep, F.col("label").cast("int").alias("label"), F.posexplode("idxs").alias("rank", "idx")).withColumn("rank", F.col("rank") + 1)


def parse_label_maps(text: DataFrame, col: str = "value") -> DataFrame:
    """``{"id_to_letter": {...}, "id_to_name": {...}}`` to (label, letter, name)."""
    schema = "letter_to_id map<string,string>, id_to_letter map<string,string>, id_to_name map<string,string>"
    parsed = text.select(*[c for c in text.columns if c != col], F.from_json(col, schema).alias("_m"))
    keep = [c for c in parsed.columns if c != "_m"]
    rows = parsed.select(*keep, "_m", F.explode("_m.id_to_name").alias("label", "name"))
    return rows.select(*keep, "label", F.try_element_at("_m.id_to_letter", F.col("label")).alias("letter"), "name")


def load_artifacts(spark: SparkSession, folder: str) -> dict[str, DataFrame | None]:
    """class_shots, label_map and question tables; a missing file warns and gives None."""
    shots = _whole_text(spark, f"{folder}/class_shots.json")
    maps = _whole_text(spark, f"{folder}/label_maps.json")
    question = _whole_text(spark, f"{folder}/general_question.txt")
    return {
        "class_shots": None if shots is None else parse_class_shots(shots),
        "label_map": None if maps is None else parse_label_maps(maps),
        "question": None if question is None else question.select(F.trim("value").alias("question")),
    }


def artifact_texts(shots: DataFrame, labels: DataFrame, question: str) -> dict[str, DataFrame]:
    """One-row texts to be written beside a split: shots per class and label maps as JSON."""
    per_class = shots.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("rank", "idx")))["idx"].alias("idxs"))
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("label").cast("string").alias("k"), "idxs"))))
    pairs = lambda a, b: F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(a).cast("string").alias("k"), F.col(b).cast("string").alias("v")))))
    maps = F.struct(
        pairs("letter", "label").alias("letter_to_id"), pairs("label", "letter").alias("id_to_letter"), pairs("label", "name").alias("id_to_name")
    )
    return {
        "class_shots.json": per_class.agg(F.to_json(entries).alias("value")),
        "label_maps.json": labels.agg(F.to_json(maps).alias("value")),
        "general_question.txt": labels.sparkSession.createDataFrame([(question,)], "value string"),
    }


def check_channels(meta: DataFrame) -> DataFrame:
    """``names`` must have ``n_channels`` entries."""
    message = F.concat(F.lit("channel names do not match n_channels of "), F.col("dataset"))
    ok = F.size("names") == F.col("n_channels")
    return meta.withColumn("names", F.when(ok, F.col("names")).otherwise(F.raise_error(message).cast("array<string>")))


def read_qa(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """QA documents to one row per record: ``index``, ``summaries``, ``qa_pairs``; unknown keys are ignored."""
    docs = spark.read.schema(QA_DOCUMENT).option("multiLine", "true").json(path)
    return docs.select(F.explode("dataset").alias("r")).select(F.col("r.index").cast("bigint").alias("index"), "r.summaries", "r.qa_pairs")


def write_qa(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """QA records as JSON lines."""
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)
