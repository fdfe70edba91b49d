"""Deterministic hash keys used wherever a random draw is needed.

The key depends only on the seed and the row's own id columns, so results do not
change with partitioning, retries or lost executors.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HASH_RANGE = 1 << 32


def hash_key(seed, *cols: Column | str) -> Column:
    """Unsigned 32-bit key of ``seed|col|col...`` as BIGINT."""
    text = F.concat_ws(
        "|",
        F.lit(str(seed)) if not isinstance(seed, Column) else seed.cast("string"),
        *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols],
    )
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
