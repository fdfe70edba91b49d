"""Run keys from prediction paths and file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# File and folder name patterns of the run layout.
LAYER_STEM = r"^layer(\d+)$"
LAYER_FILE = r"^layer(\d+)\.jsonl$"
SHOT_STYLE = r"^(.+?)_(\d+)-shot(?:_(Direct|CoT))?$"
STYLE_ONLY = r"^(.+?)(?:_(Direct|CoT))?$"
VARIANT_FILE = r"^sys(\d{3})_gq(\d{3})_(.+)_cot(\d*)\.jsonl$"
ROOT = "sample_generations"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match, NULL instead of '' when nothing matched."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def stem(name: Column) -> Column:
    """File name without its last suffix; NULL stays NULL."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def normalise_embedding(emb: Column, style: str = "underscore", force_ust: bool = True) -> Column:
    """Trim, use underscores (or keep hyphens), optionally end in ``ust``; empty becomes NULL."""
    sep = "_" if style == "underscore" else "-"
    text = F.trim(emb)
    if style == "underscore":
        text = F.replace(text, F.lit("-"), F.lit("_"))
    if force_ust:
        text = F.regexp_replace(text, f"^(?=.)(.*?)({sep}ust)?$", f"$1{sep}ust")
    return F.nullif(text, F.lit(""))


def strip_ust(emb: Column) -> Column:
    return F.regexp_replace(emb, r"[-_]ust$", "")


def _below_root(path: str) -> list[Column]:
    """Parts 1 to 5 below the root folder, '' where missing.

    Plain string functions, named as rarely as possible below: Spark inlines these
    expressions into the filters it pushes down.
    """
    rooted = F.concat(F.lit("/"), F.trim(path))
    at = F.instr(rooted, f"/{ROOT}/")
    rest = F.when(at > 0, F.substr(rooted, at + len(ROOT) + 2)).otherwise("")
    return [F.split_part(rest, F.lit("/"), F.lit(k)) for k in range(1, 6)]


def run_keys(df: DataFrame, path: str = "pred_path", style: str = "underscore") -> DataFrame:
    """Add the run keys of ``.../sample_generations/<model>/<dataset>/<method>/...``.

    ``underscore``: names with underscores ending in ``_ust``; ``hyphen``: names as
    written, shots read from the run folder, prompting without shots counts as 0.
    """
    if style not in ("underscore", "hyphen"):
        raise ValueError(f"unknown path style {style!r}")
    columns = list(df.columns)
    out = df.withColumns({f"_p{k}": c for k, c in enumerate(_below_root(path), 1)})
    method, a, b = F.col("_p3"), F.col("_p4"), F.col("_p5")
    is_random, is_probe, is_prompt = (method == m for m in ("random", "logistic_regression", "visual_prompting"))
    out = out.withColumn("_name", F.when(is_probe, b).when(is_random | is_prompt, a).otherwise(""))
    out = out.withColumn("_stem", stem(F.col("_name")))
    # the text that carries embedding, shots and style
    out = out.withColumn("_run", F.when(is_probe, a).when(is_prompt, F.col("_stem")).otherwise(""))
    name, stem_, run = F.col("_name"), F.col("_stem"), F.col("_run")
    empty = F.lit("")
    keys = [F.nullif(F.col(f"_p{k}"), empty).alias(n) for k, n in ((1, "model"), (2, "dataset"), (3, "method"))]
    if style == "underscore":
        prompt_emb = F.regexp_extract(run, SHOT_STYLE, 1)
        probe_emb = F.regexp_extract(run, STYLE_ONLY, 1)
        emb = F.when(is_probe, probe_emb).when(is_prompt, prompt_emb).otherwise(a)
        keys += [
            F.when(is_random, F.nullif(stem_, empty)).otherwise(normalise_embedding(emb)).alias("embedding_type"),
            F.when(is_probe, _found(run, STYLE_ONLY, 2)).when(is_prompt, _found(run, SHOT_STYLE, 3)).alias("style"),
            F.when(is_random, F.nullif(stem_, empty)).alias("variant"),
            F.when(is_probe, _found(stem_, LAYER_STEM).cast("int")).alias("layer"),
            F.when(is_prompt, _found(run, SHOT_STYLE, 2).cast("int")).alias("shots"),
            F.nullif(stem_, empty).alias("pred_file_stem"),
        ]
    else:
        shot = run.rlike(SHOT_STYLE)
        emb = F.regexp_extract(run, STYLE_ONLY, 1)
        shot_emb = F.regexp_extract(run, SHOT_STYLE, 1)
        keys += [
            F.when(is_random, F.nullif(stem_, empty)).otherwise(normalise_embedding(F.when(shot, shot_emb).otherwise(emb), "hyphen", False)).alias("embedding_type"),
            F.when(shot, _found(run, SHOT_STYLE, 3)).otherwise(_found(run, STYLE_ONLY, 2)).alias("style"),
            F.when(shot, F.regexp_extract(run, SHOT_STYLE, 2).cast("int")).when(is_prompt & (run != ""), 0).alias("shots"),
            F.when(is_probe, _found(name, LAYER_FILE).cast("int")).alias("layer"),
            F.when(is_random, F.nullif(stem_, empty)).alias("variant"),
            F.nullif(name, empty).alias("pred_file"), F.nullif(stem_, empty).alias("pred_stem"),
            F.when(is_probe, F.nullif(a, empty)).alias("run_dir"),
        ]
    return out.select(*columns, *keys)


def run_keys_from_right(df: DataFrame, path: str = "pred_path") -> DataFrame:
    """Keys from the last five path parts; shorter paths are dropped. Style defaults to Direct, layer and shots to 0."""
    columns = [c for c in df.columns]
    out = df.withColumn("_parts", F.split(F.trim(path), "/")).where(F.size("_parts") >= 5)
    out = out.withColumns({f"_r{k}": F.element_at("_parts", -k) for k in range(1, 6)})
    out = out.withColumn("_bits", F.split("_r2", "_"))
    out = out.withColumn("_raw", F.replace(F.get("_bits", F.lit(1)), F.lit("-shot"), F.lit("")))
    shots = F.when(F.replace(F.col("_raw"), F.lit("."), F.lit("")).rlike(r"^\d+$"), F.col("_raw").try_cast("double"))
    return out.select(
        *columns,
        F.col("_r5").alias("model"), F.col("_r4").alias("dataset"), F.col("_r3").alias("method"), F.get("_bits", F.lit(0)).alias("embedding_type"),
        F.coalesce(F.get("_bits", F.lit(2)), F.lit("Direct")).alias("style"), F.coalesce(shots, F.lit(0.0)).alias("shots"),
        F.coalesce(_found(F.col("_r1"), r"layer(\d+)").cast("int"), F.lit(0)).alias("layer"), F.col("_r2").alias("variant"),
        F.col("_r1").alias("pred_file"), F.replace(F.col("_r1"), F.lit(".jsonl"), F.lit("")).alias("pred_stem"), F.col("_r2").alias("run_dir"),
    )


def run_modality(df: DataFrame, path: str = "pred_path") -> DataFrame:
    """Add model, dataset, method, modality, style flag, shots and layer; '' / 0 / -1 where missing."""
    columns = list(df.columns)
    model, dataset, method, run, _ = _below_root(path)
    # the first underscore-separated token that reads <k>-shot
    shot = r"(?i)^(.*?)(?:^|_)(\d+)-shot(?:_.*)?$"
    out = df.withColumns({"model": model, "dataset": dataset, "method": method, "_run": run})
    return out.select(
        *columns, "model", "dataset", "method",
        F.regexp_replace("_run", shot, "$1").alias("modality"), F.lower("_run").contains("cot").cast("int").alias("style"),
        F.coalesce(_found(F.col("_run"), shot, 2).cast("int"), F.lit(-1)).alias("shots"),
        F.coalesce(_found(F.col(path), r"(?i)(?:^|/)layer(\d+)\.jsonl$").cast("int"), F.lit(-1)).alias("layer"),
    )


def parse_variant_file(name: Column) -> Column:
    """Variant keys of ``sysNNN_gqNNN_<kinds>_cot<N>.jsonl``; differing numbers are an error."""
    sys_no, gq_no = (_found(name, VARIANT_FILE, g).cast("int") for g in (1, 2))
    message = F.concat(F.lit("sys/gq mismatch in "), name)
    return F.struct(
        F.when(sys_no == gq_no, sys_no).when(sys_no.isNotNull(), F.raise_error(message).cast("int")).alias("variant"),
        _found(name, VARIANT_FILE, 3).alias("kinds"),
        F.when(_found(name, VARIANT_FILE, 4) == "1", 1).otherwise(0).alias("cot"),
    )


def run_dir(embedding: Column, shots: Column, style: Column, method: Column) -> Column:
    """``<embedding>_<k>-shot_<style>`` for probe runs, '' otherwise; empty pieces are left out."""
    pieces = F.array(
        F.nullif(F.trim(embedding), F.lit("")),
        F.concat(shots.cast("int").cast("string"), F.lit("-shot")),
        F.nullif(F.trim(style), F.lit("")),
    )
    return F.when(method == "logistic_regression", F.array_join(pieces, "_")).otherwise("")


def modality_bucket(embedding: Column, keep_visual: bool = False) -> Column:
    """d, dv (and v when ``keep_visual``) from the kinds named in the embedding; '' otherwise."""
    text = F.lower(embedding)
    lets, vis = text.contains("lets"), text.contains("vis")
    out = F.when(lets & vis, "dv").when(lets, "d")
    if keep_visual:
        out = out.when(vis, "v")
    return F.coalesce(out, F.lit(""))


def modality_label(embedding: Column) -> Column:
    """Legend label: d, v, d+v, or the embedding itself."""
    text = F.lower(embedding)
    lets, vis = text.contains("lets"), text.contains("vis")
    return F.when(lets & vis, "d+v").when(lets, "d").when(vis, "v").otherwise(embedding)


def activity_id(text: Column, names: list[str], file: Column | None = None) -> Column:
    """Activity number from a number, a name (space, hyphen or underscore) or the file name ``a<id>t<n>``."""
    clean = F.regexp_replace(F.lower(F.trim(text)), "[ -]", "_")
    table = F.create_map(*[F.lit(v) for i, n in enumerate(names, 1) for v in (n, i)])
    found = F.coalesce(clean.try_cast("int"), F.try_element_at(table, clean))
    if file is not None:
        found = F.coalesce(found, _found(file, r"^a(\d+)t\d+").cast("int"))
    return found
