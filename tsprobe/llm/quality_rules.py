"""Line-first cleaning with built-in column functions only.

Every line is judged by itself. A line fails as *unpunctuated* (no sentence ends in it), as *noisy*
(more than a tenth of its characters are markup symbols, or it has doubled exclamation marks at every third word),
as *navigation* (two or more menu separators, or a bare menu label) or as *boilerplate* (up to 300 characters with one
of the fixed phrases). Failing lines go; the document is rejected if they held more than ``most_lost`` of its word
characters, or if it fails the base rules (under 50 words, or over half of the words in repeated 3-word windows).

A null text has no words and is rejected; so is an empty one. Lines without words are kept and count nowhere. Repeated
rows and null ids are judged row by row; other columns pass through ``clean`` unchanged. Arrays of words and windows
are as long as the text; every word is read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsprobe.llm.common import SPACES, WORD, text, words

#: Fixed phrases of boilerplate lines, in lower case.
BOILERPLATE = [
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "use cookies", "enable javascript",
    "subscribe to our newsletter", "click here", "read more", "sign up for", "log in to", "powered by", "share this", "lorem ipsum",
    "licensed under", "released under the", "general public license",
]
#: Fixed labels that make a navigation line when they stand alone.
MENU = ["home", "menu", "about", "about us", "contact", "contact us", "login", "log in", "sign in", "search", "next", "previous", "back", "share", "more", "skip to content"]
SENTENCE_END = r"[.!?:;…][\"'”’»)\]]*(?:\s|$)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where the body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_window_words(ws: Column) -> Column:
    """Words that lie in a 3-word window found at least twice in the array."""

    def of_windows(grams: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(grams) - 1)

        def covered(ordered: Column) -> Column:
            same = lambda x, i, step: F.coalesce(F.get(ordered, i + step)["g"] == x["g"], F.lit(False))
            twice = F.filter(ordered, lambda x, i: same(x, i, -1) | same(x, i, 1))
            starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
            return let(starts, lambda s: F.aggregate(
                F.transform(s, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(s, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x,
            ))

        by_gram = F.sort_array(F.transform(at, lambda i: F.struct(F.get(grams, i).alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(by_gram, covered))

    def of_hashes(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - 3)
        return let(F.transform(starts, lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2))), of_windows)

    return F.when(F.size(ws) < 4, F.lit(0)).otherwise(let(F.transform(ws, lambda w: F.xxhash64(w)), of_hashes))


def line_verdict(line: Column) -> Column:
    """The first rule that a line fails, or null."""
    bare = F.regexp_replace(line, f"[{SPACES}]+$", "")
    label = F.lower(F.trim(bare))
    noisy = (F.regexp_count(line, F.lit(r"[#*$%&|<>]")) * 10 > F.length(line)) | (F.regexp_count(line, F.lit("!!")) * 3 > F.regexp_count(line, F.lit(WORD)))
    menu = (F.regexp_count(line, F.lit("[|»›•·]")) >= 2) | label.isin(MENU)
    known = (F.length(line) <= 300) & let(label, lambda low: F.exists(F.array(*map(F.lit, BOILERPLATE)), lambda p: F.contains(low, p)))
    open_ended = ~line.rlike(SENTENCE_END)
    return F.when(~line.rlike(WORD), None).when(noisy, "noisy").when(menu, "navigation").when(known, "boilerplate").when(open_ended, "unpunctuated")


def clean(docs: DataFrame, most_lost: float = 0.5) -> DataFrame:
    """All rows with ``rules``: the base counts, lines failed by rule, base_failed, kept; and ``clean_text``.

    Columns of ``docs`` pass through whatever their names; those two take the place of columns so named.
    """
    t = F.col("_t")
    chars = lambda x: F.length(x) - F.regexp_count(x, F.lit(f"[{SPACES}]"))
    judged = docs.select(F.struct("*").alias("row"), text().alias("_t")).withColumn("_judged", F.transform(F.split(t, "\n"), lambda x: F.struct(x.alias("line"), line_verdict(x).alias("failed"))))
    lines = lambda keep: F.transform(F.filter("_judged", keep), lambda x: x["line"])
    count = lambda rule: F.size(F.filter("_judged", lambda x: x["failed"] == rule)).cast("long")
    failed = F.aggregate(lines(lambda x: x["failed"].isNotNull()), F.lit(0), lambda a, x: a + chars(x))
    with_words = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    base = let(words(t), lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), repeated_window_words(ws).cast("long").alias("n_repeat_words")))
    rules = F.struct(
        base.alias("base"), chars(t).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(with_words, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        failed.cast("long").alias("lost_chars"),
        *[count(r).alias(f"n_{r}") for r in ("unpunctuated", "noisy", "navigation", "boilerplate")],
    )
    base_failed = (F.col("_r.base.n_words") < 50) | (F.col("_r.base.n_repeat_words") * 100 > F.col("_r.base.n_words") * 50)
    names = ["word_chars", "n_symbols", "n_dup_lines", "lost_chars", "n_unpunctuated", "n_noisy", "n_navigation", "n_boilerplate"]
    out = F.struct(
        F.col("_r.base.n_words").alias("n_words"), F.col("_r.base.n_repeat_words").alias("n_repeat_words"), *[F.col(f"_r.{c}").alias(c) for c in names],
        base_failed.alias("base_failed"), (~base_failed & (F.col("_r.lost_chars") <= most_lost * F.col("_r.word_chars"))).alias("kept"),
    )
    return judged.withColumn("_r", rules).select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in ("rules", "clean_text")], out.alias("rules"), F.array_join(lines(lambda x: x["failed"].isNull()), "\n").alias("clean_text"))
