"""A corpus pipeline over ``documents``: classify, join near duplicates, cut repeats, mix sources, pack.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of
the documents. Null and empty texts are judged bad by the first stage; where a later stage meets them it keeps one
document without text (near duplicates), leaves it as it is (repeats), gives it no share (mixing) or packs an end
alone (packing). Repeated rows are one document to the second and fourth stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsprobe.llm.common import WORD, saved, table
from tsprobe.llm.mixing import whole_documents
from tsprobe.llm.ngram_join import keep_one
from tsprobe.llm.packing import best_fit_pack
from tsprobe.llm.quality_model import fit, judged
from tsprobe.llm.suffix_dedup import dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    return judged(docs, fit(docs)).where("quality.kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id."""
    return keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that a document with a smaller id has; one of which no word is left goes."""
    new = {c: c if c in ("doc_id", "text") else f"in_{i}" for i, c in enumerate(docs.columns)}  # no name can clash with a result
    done = dedup(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in new.items()]), list(new.values()), with_text=True)
    changed = F.col("repeats.n_removed") > 0
    cut = done.withColumn("cut", F.when(changed, F.col("repeats.kept_text")).otherwise(F.col("text"))).where(~changed | F.col("cut").rlike(WORD))
    made = {"text": F.col("cut")} | ({"n_chars": F.when(changed, F.length("cut").cast("long")).otherwise(F.col(new["n_chars"]))} if "n_chars" in new else {})
    return cut.select(*[made.get(c, F.col(n)).alias(c) for c, n in new.items()])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return whole_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    return best_fit_pack(docs, public_tokenizers.path("byte_bpe_50k.json"), ranks=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeats),
    ("mixing sources", mix),
    ("best-fit packing", pack),
]

#: SQL expresses neither the fitted classifier nor the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
