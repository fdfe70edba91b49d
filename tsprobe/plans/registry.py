"""Query registry: each entry is a Spark callable and, where SQL can say it, a DuckDB oracle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
_REF = re.compile(r"\{(" + "|".join(TABLES) + r")\}")


def query(name: str, oracle: str | None = None):
    """Register a query; ``{table}`` in the oracle names a test table."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = _REF.sub(r"\1", oracle).strip()
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run SQL that both engines understand, reading ``{table}`` from ``sf_dir``."""
    names = set(_REF.findall(sql))
    escaped = _REF.sub(r"\0\1\0", sql).replace("{", "{{").replace("}", "}}")
    escaped = re.sub("\0(\\w+)\0", r"{\1}", escaped)
    return spark.sql(escaped, **{n: table(spark, sf_dir, n) for n in names})
