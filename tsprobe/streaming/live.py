"""Growing logs and live samples with Structured Streaming.

All sinks are idempotent per batch id, so a restarted query or a lost executor
repeats a batch without repeating its effect.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tsprobe.operators.metrics import correct_flag
from tsprobe.operators.results import upsert


TORN = "_torn"


def read_log_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """JSON-lines directory as a stream with the file time as ``ingested_at`` and the text of torn lines in ``_torn``.

    A file source reads a file once: writers add whole files (write elsewhere, then move in) and never append to one.
    ``whole_lines`` and ``torn_lines`` part the stream; both can be counted.
    """
    marked = T.StructType([*schema.fields, T.StructField(TORN, T.StringType())])
    reader = spark.readStream.option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    parsed = F.from_json("value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": TORN})
    rows = reader.text(path).where(F.trim("value") != "").select(parsed.alias("_row"), F.col("_metadata.file_modification_time").alias("ingested_at"))
    return rows.select("_row.*", "ingested_at")


def whole_lines(stream: DataFrame) -> DataFrame:
    return stream.where(F.col(TORN).isNull()).drop(TORN)


def torn_lines(stream: DataFrame) -> DataFrame:
    """The torn lines with the time of their file; a count of them belongs beside every figure of the log."""
    return stream.where(F.col(TORN).isNotNull()).select(F.col(TORN).alias("line"), "ingested_at")


def live_accuracy(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows seen, right answers and accuracy per run; use output mode update or complete."""
    hit = correct_flag(F.col("gt"), F.col("pred"))
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("seen"), F.sum(hit).alias("right"), F.avg(hit).alias("accuracy"))


def exactly_once(stream: DataFrame, keys: Sequence[str], ingested: str, delay: str) -> DataFrame:
    """First row per key within ``delay``; the state of older keys is dropped."""
    return stream.withWatermark(ingested, delay).dropDuplicatesWithinWatermark(list(keys))


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink: each batch owns the folder ``batch_id=<n>`` and replaces it when repeated."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, folder = _folder(spark, path)
    return sorted(str(s.getPath().getName()) for s in fs.listStatus(folder)) if fs.exists(folder) else []


def _manifests(spark: SparkSession, path: str) -> list[int]:
    """Batches whose manifest is complete: what a batch wrote counts from then on."""
    found = [n for n in _names(spark, path) if n.startswith("manifest-")]
    return sorted(int(n.split("-")[1]) for n in found if "_SUCCESS" in _names(spark, f"{path}/{n}"))


def _versions(spark: SparkSession, path: str, batch_id: int) -> dict[int, int]:
    """Bucket to the batch that wrote it last, as of a batch."""
    return {r["bucket"]: r["version"] for r in spark.read.schema("bucket int, version long").json(f"{path}/manifest-{batch_id}").collect()}


def _read_buckets(spark: SparkSession, path: str, versions: dict[int, int], schema: T.StructType) -> DataFrame:
    places = [f"{path}/version={v}/bucket={b}" for b, v in sorted(versions.items())]
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)


def upsert_writer(path: str, key: str, ts: str, tie: Sequence[str] = (), buckets: int = 64, keep: int = 2) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink: latest row per key. A batch rewrites the buckets of its keys, and no others.

    Keys are hashed into ``buckets``, a number that stays as it is for a path. A batch merges its rows with the buckets it
    touches, writes them as a version of its own and then a manifest that names the version of every bucket: readers see
    all of a batch or nothing of it. A repeated batch starts again from the manifest before it. Versions that the
    last ``keep`` manifests don't name are deleted, so that a reader of the one before is not cut off.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        place = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        older = [n for n in _manifests(spark, path) if n < batch_id]
        versions = _versions(spark, path, older[-1]) if older else {}
        touched = sorted(r[0] for r in batch.select(place.alias("b")).distinct().collect())  # at most ``buckets`` numbers
        base = _read_buckets(spark, path, {b: versions[b] for b in touched if b in versions}, batch.schema)
        merged = upsert(base, batch, key, ts, tie).withColumn("bucket", place)
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/version={batch_id}")
        versions |= dict.fromkeys(touched, batch_id)
        spark.createDataFrame(list(versions.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").json(f"{path}/manifest-{batch_id}")
        _collect(spark, path, [*older, batch_id], keep)

    return write


def _collect(spark: SparkSession, path: str, manifests: list[int], keep: int) -> None:
    """Delete manifests but the last ``keep``, and versions of buckets that none of these names; later batches are left alone."""
    fs, _ = _folder(spark, path)
    named = {(v, b) for n in manifests[-keep:] for b, v in _versions(spark, path, n).items()}
    for n in manifests[:-keep]:
        fs.delete(_folder(spark, f"{path}/manifest-{n}")[1], True)
    for version in [n for n in _names(spark, path) if n.startswith("version=") and int(n.split("=")[1]) <= manifests[-1]]:
        held = [n for n in _names(spark, f"{path}/{version}") if n.startswith("bucket=")]
        old = [b for b in held if (int(version.split("=")[1]), int(b.split("=")[1])) not in named]
        for place in [version] if len(old) == len(held) else [f"{version}/{b}" for b in old]:
            fs.delete(_folder(spark, f"{path}/{place}")[1], True)


def latest_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table as of the last complete batch."""
    done = _manifests(spark, path)
    return _read_buckets(spark, path, _versions(spark, path, done[-1]) if done else {}, schema)


def stream_windows(
    stream: DataFrame, keys: Sequence[str], pos: str, value: str, label: str, width: int, stride: int, time: str, delay: str, min_chunk: int = 1024
) -> DataFrame:
    """Sliding count windows of live samples; the same windows as the batch operator on the same rows.

    State is kept per (keys, position chunk): a busy recording is spread over its chunks, and rows may arrive in any order
    and more than once within ``delay`` of event time ``time``. Once its last window is out, a chunk's state holds no rows, and
    a repeated row changes nothing. When the watermark passes a chunk's latest sample by ``delay``, the state is dropped,
    finished or not; later rows are too late for the stream and open no new one. Output: keys, ``start``, ``values``, ``labels``.
    """
    keys = list(keys)
    size = stride * max(1, -(-max(min_chunk, 4 * width) // stride))
    p = F.col(pos)
    timed = stream.select(*keys, p.alias("p"), F.col(value).cast("double").alias("v"), F.col(label).cast("string").alias("label"), F.col(time).cast("timestamp").alias("at"))
    p, first = F.col("p"), F.greatest(F.lit(0), F.floor((F.col("p") - max(0, width - stride)) / size))
    spread = timed.withWatermark("at", delay).select(
        "*", F.explode(F.sequence(first, F.floor(p / size))).alias("chunk"),
    )
    out = T.StructType(
        [spread.schema[k] for k in keys]
        + [T.StructField("start", T.LongType()), T.StructField("values", T.ArrayType(T.DoubleType())), T.StructField("labels", T.ArrayType(T.StringType()))]
    )
    state_type = T.StructType([
        T.StructField("next", T.LongType()), T.StructField("until", T.LongType()), T.StructField("p", T.ArrayType(T.LongType())),
        T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("label", T.ArrayType(T.StringType())),
    ])

    def advance(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        chunk = int(key[-1])
        start, until, held = (state.get[0], state.get[1], dict(zip(state.get[2], zip(state.get[3], state.get[4])))) if state.exists else (chunk * size, 0, {})
        for frame in frames:
            held.update(zip(frame["p"].tolist(), zip(frame["v"].tolist(), frame["label"].tolist())))
            until = max(until, int(frame["at"].max().timestamp() * 1000) + 1)
        starts, end = [], (chunk + 1) * size
        while start < end and all(i in held for i in range(start, start + width)):
            starts.append(start)
            start += stride
        kept = sorted(i for i in held if start <= i) if start < end else []
        state.update((start, until, kept, [held[i][0] for i in kept], [held[i][1] for i in kept]))
        # the watermark is ``delay`` behind the latest sample; a state that it has passed already goes with the next batch
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        if starts:
            rows = [[held[i] for i in range(at, at + width)] for at in starts]
            frame = pd.DataFrame({"start": starts, "values": [np.array([r[0] for r in w]) for w in rows], "labels": [[r[1] for r in w] for w in rows]})
            for i, k in enumerate(keys):
                frame.insert(i, k, [key[i]] * len(frame))
            yield frame

    return spread.groupBy(*keys, "chunk").applyInPandasWithState(advance, out, state_type, "append", GroupStateTimeout.EventTimeTimeout)


def run_to_end(query_writer, checkpoint: str) -> list[dict]:
    """Process everything available, then stop; the progress of each batch."""
    query = query_writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return list(query.recentProgress)
