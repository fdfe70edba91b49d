"""Text in, values out, and back: answers, numbers, digit codes, JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The answer patterns, tried in this order, and the bracketed fallback.
ANSWER_PATTERNS = (
    r"[Tt]he answer is\s*\[([^\[\]]+)\]",
    r"[Ff]inal answer\s*[:\-]?\s*\[([^\[\]]+)\]",
    r"[Aa]nswer\s*[:\-]?\s*\[([^\[\]]+)\]",
)
BRACKETED = r"\[([^\[\]]+)\]"
NO_LETTER = "no valid letter found"
NUMBER = r"[-+]?\d*\.\d+|\d+"
_SPACE = " \t\n\r\f\x0b"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACE))


def extract_letter(df: DataFrame, text: str, letters: Column | dict[str, int]) -> DataFrame:
    """Add ``letter`` and ``pred`` from a model answer.

    ``letters`` maps option letters to label ids: a MAP column (joined from the
    label map) or a dictionary. Unreadable answers get -1.
    """
    table = F.create_map(*[F.lit(v) for kv in letters.items() for v in kv]) if isinstance(letters, dict) else letters
    out = df.withColumn("_map", table)
    known = lambda t: F.map_contains_key("_map", t)
    tries = {f"_a{i}": strip(F.regexp_extract(text, p, 1)) for i, p in enumerate(ANSWER_PATTERNS)}
    out = out.withColumns(tries)
    found = F.lit(None).cast("string")
    tokens = F.transform(F.regexp_extract_all(text, F.lit(BRACKETED), 1), strip)
    last = F.try_element_at(F.filter(tokens, known), F.lit(-1))
    for name in reversed(list(tries)):
        found = F.when(known(F.col(name)), F.col(name)).otherwise(last if name == list(tries)[-1] else found)
    out = out.withColumn("letter", found).withColumn("pred", F.coalesce(F.try_element_at("_map", F.col("letter")), F.lit(-1)))
    return out.withColumn("letter", F.coalesce("letter", F.lit(NO_LETTER))).drop("_map", *tries)


def last_number(text: Column) -> Column:
    """Last number in the text (a sign only counts together with a decimal point); NULL without one."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(NUMBER), 0), F.lit(-1)).try_cast("double")


def parse_forecast(df: DataFrame, text: str, horizon: int, decimals: int = 3) -> DataFrame:
    """Add ``analysis``, ``forecast``, ``status`` and ``error`` from the outermost JSON object in the text."""
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    out = df.withColumn("_j", F.from_json(body, "analysis string, forecast array<string>", {"mode": "PERMISSIVE"}))
    out = out.withColumn("_f", F.transform("_j.forecast", lambda v: v.try_cast("double")))
    ok = F.coalesce(
        F.col("_j.analysis").isNotNull() & (F.size("_f") == horizon) & F.forall("_f", lambda v: v.isNotNull()), F.lit(False)
    )
    out = out.withColumn("_ok", ok)
    return out.select(
        *df.columns,
        F.when(F.col("_ok"), F.col("_j.analysis")).alias("analysis"),
        F.when(F.col("_ok"), F.transform("_f", lambda v: F.round(v, decimals))).alias("forecast"),
        F.when(F.col("_ok"), "success").otherwise("failed").alias("status"),
        F.when(~F.col("_ok"), "no valid forecast of the requested length").alias("error"),
    )


def strip_header(text: Column) -> Column:
    """Drop a first line that starts with ``assistant`` (any case); trim the rest."""
    head = F.lower(F.ltrim(text)).startswith("assistant")
    left = F.ltrim(text)
    rest = F.when(F.instr(left, "\n") > 0, F.substr(left, F.instr(left, "\n") + 1)).otherwise("")
    return F.when(head, strip(rest)).otherwise(strip(text))


def spaced(text: Column) -> Column:
    return F.regexp_replace(text, "(.)(?!$)", "$1 ")


def digit_text(values: Column, precision: int = 3) -> Column:
    """Fixed decimals, point removed, characters spaced, values joined by `` , ``; the minus is a token."""
    scale = 10 ** precision

    def one(v: Column) -> Column:
        n = F.abs(F.rint(v.cast("double") * scale)).cast("bigint")
        whole = F.floor(n / scale).cast("string")
        frac = F.lpad((n % scale).cast("string"), precision, "0")
        return spaced(F.concat(F.when(v < 0, "-").otherwise(""), whole, frac))

    return F.array_join(F.transform(values, one), " , ")


def scaled_digit(v: Column, precision: int = 4) -> Column:
    """rint(v * 10^precision) digit by digit, with tokens for sign, NaN and infinity."""
    d = v.cast("double")
    n = F.rint(d * 10 ** precision)
    finite = F.concat(F.when(n < 0, "- ").otherwise(""), spaced(F.abs(n).cast("decimal(38,0)").cast("string")))
    inf = F.lit(float("inf"))
    return F.when(F.isnan(d), "n a n").when(d == inf, "i n f").when(d == -inf, "- i n f").otherwise(finite)


def scaled_digit_text(x: Column, precision: int = 4, matrix: bool = False, step_sep: str = " ,", channel_sep: str = " |") -> Column:
    """Digit code of a series (T) or a matrix (T, C)."""
    if not matrix:
        return F.array_join(F.transform(x, lambda v: scaled_digit(v, precision)), step_sep)
    steps = F.transform(x, lambda row: F.array_join(F.transform(row, lambda v: scaled_digit(v, precision)), channel_sep))
    return F.array_join(steps, step_sep)


def float_text(v: Column) -> Column:
    """A DOUBLE as JSON writes it: plain digits below 1e16, at least one decimal."""
    plain = F.regexp_replace(v.cast("decimal(38,6)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when((F.abs(v) >= 1e7) & (F.abs(v) < 1e16), plain).otherwise(v.cast("string"))


def json_text(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(values, float_text), ", "), F.lit("]"))


def space_text(values: Column) -> Column:
    return F.array_join(F.transform(values, float_text), " ")


def serialize_series(df: DataFrame, x: str, out: str = "text", max_chars: int = 24_000, decimals: int = 3, as_float32: bool = False) -> DataFrame:
    """(T, C) windows as JSON text of at most ``max_chars`` characters.

    Values are rounded half-even. A longer text keeps every k-th entry of the longer
    axis, k being the smallest factor from ceil(length / max_chars) that fits or
    leaves at most two entries. Also adds ``factor``.
    """
    scale = 10 ** decimals

    def shorten(v: Column) -> Column:
        r = F.rint(v.cast("double") * scale) / scale
        return float_text(r.cast("float").cast("double") if as_float32 else r)

    cols = df.columns
    work = df.withColumn("_t", F.transform(x, lambda row: F.transform(row, shorten)))
    work = work.withColumn("_rows", F.size("_t")).withColumn("_cols", F.size(F.element_at("_t", 1)))
    work = work.withColumn("_by_row", F.col("_rows") >= F.col("_cols"))
    lengths = lambda cells: F.aggregate(cells, F.lit(0), lambda a, s: a + F.length(s))
    by_col = F.transform(
        F.sequence(F.lit(0), F.col("_cols") - 1), lambda c: lengths(F.transform("_t", lambda row: F.get(row, c)))
    )
    work = work.withColumn("_w", F.when(F.col("_by_row"), F.transform("_t", lengths)).otherwise(by_col))

    def text_length(k: Column) -> Column:
        kept = F.transform(F.sequence(F.lit(0), F.size("_w") - 1, k), lambda i: F.get("_w", i))
        n = F.size(kept)
        rows = F.when(F.col("_by_row"), n).otherwise(F.col("_rows"))
        width = F.when(F.col("_by_row"), F.col("_cols")).otherwise(n)
        return F.aggregate(kept, F.lit(0), lambda a, w: a + w) + rows * width * 2 + rows * 2

    work = work.withColumn("_full", text_length(F.lit(1)))
    first = F.ceil(F.col("_full") / max_chars).cast("int")
    fits = F.filter(
        F.sequence(F.least(first, F.size("_w")), F.size("_w")),
        lambda k: (text_length(k) <= max_chars) | (F.ceil(F.size("_w") / k) <= 2),
    )
    work = work.withColumn("factor", F.when(F.col("_full") <= max_chars, 1).otherwise(F.element_at(fits, 1)))
    every = lambda cells: F.filter(cells, lambda _, i: i % F.col("factor") == 0)
    kept = F.when(F.col("_by_row"), every(F.col("_t"))).otherwise(F.transform("_t", every))
    rows = F.transform(kept, lambda row: F.concat(F.lit("["), F.array_join(row, ", "), F.lit("]")))
    return work.select(*cols, F.concat(F.lit("["), F.array_join(rows, ", "), F.lit("]")).alias(out), "factor")


def numbered_options(names: Column) -> Column:
    """``1. name.`` lines."""
    return F.array_join(F.transform(names, lambda n, i: F.concat((i + 1).cast("string"), F.lit(". "), n, F.lit("."))), "\n")


def inline_options(letters: Column, names: Column) -> Column:
    """``[A] name, [B] name``"""
    return F.array_join(F.zip_with(letters, names, lambda a, n: F.concat(F.lit("["), a, F.lit("] "), n)), ", ")


def question_text(task: Column, block: Column) -> Column:
    """Task description followed by the option block; the block alone without a task."""
    task = strip(task)
    return F.when(task != "", F.concat(task, F.lit(" "), block)).otherwise(block)


def markdown_table(header: list[str], rows: Column) -> Column:
    """A markdown table from an array of cell arrays."""
    head = "| " + " | ".join(header) + " |\n" + "|---" * len(header) + "|"
    lines = F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |")))
    return F.array_join(F.concat(F.array(F.lit(head)), lines), "\n")
