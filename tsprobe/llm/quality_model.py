"""Weak-label quality classifier: EM over overlapping heuristic labellers, then a hashed linear scorer.

Each labeller votes good, bad or nothing on a document. The votes of one document form a pattern, and there are at most
``3 ** len(LABELLERS)`` patterns; their counts over the whole corpus are all that expectation-maximisation needs, so it
runs on the driver on that bounded table, exactly as over all documents. It estimates, for each labeller and class, how
often it votes which way when it votes, starting from the majority of votes. The posterior of a pattern is the soft label of its
documents. About ``train_rows`` documents (a documented bound, chosen by hashing) train a logistic scorer on hashed
words, word endings and a mark for each word that repeats its predecessor; every document is scored.

A null text is empty; a text without words gets no votes, score 0 and is not kept. Repeated rows are judged alike. A null
id changes nothing but that it is one value to the hash that draws the training rows. An empty table gives no rows.
Words of the whole text count, however long. Columns of the input pass through whatever their names; ``quality`` is one
struct, and takes the place of an input column of that name.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsprobe.llm.common import text, words

GOOD, BAD, NONE = "1", "0", "-"
#: Fixed list: frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = [
    "the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "with", "as", "was", "on", "by", "der", "die", "das", "und", "den", "von", "zu", "ist", "nicht", "ein",
    "eine", "le", "la", "les", "de", "des", "et", "un", "une", "dans", "que", "du", "el", "los", "las", "en", "y", "una", "se", "del", "con", "no",
]


def vote(good: Column, bad: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(NONE)


def measures() -> Column:
    """What the labellers look at, of the columns ``_t`` and ``_w``."""
    w, t = F.col("_w"), F.col("_t")
    n = F.size(w)
    follow = F.zip_with(F.slice(w, 2, F.greatest(n - 1, F.lit(0))), F.slice(w, 1, F.greatest(n - 1, F.lit(0))), lambda a, b: a == b)
    plain = F.array(*map(F.lit, FUNCTION_WORDS))
    lines = F.split(t, "\n")
    return F.struct(
        n.alias("n"), F.length(t).alias("chars"), F.size(F.array_distinct(w)).alias("distinct"), F.size(F.filter(follow, lambda x: x)).alias("same"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>{}=\\^~]")).alias("symbols"), F.regexp_count(t, F.lit("!!")).alias("shouts"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).alias("upper"), F.size(F.filter(w, lambda x: F.array_contains(plain, F.lower(x)))).alias("plain"),
        (F.size(lines) - F.size(F.array_distinct(lines))).alias("again"), F.size(lines).alias("lines"),
    )


def labellers() -> list[Column]:
    """The votes, from ``_m``; each sees another trait, and all abstain where their trait says nothing."""
    m = lambda c: F.col(f"_m.{c}")
    n = m("n")
    some = n >= 20
    return [
        vote(m("symbols") == 0, m("symbols") * 10 > n),
        vote(some & (m("same") * 20 < n), m("same") * 5 > n),
        vote(some & (m("distinct") * 2 > n), some & (m("distinct") * 10 < n * 3)),
        vote(some & (m("upper") * 10 < m("chars")), m("upper") * 2 > m("chars")),
        vote(some & (m("plain") * 12 > n), some & (m("plain") * 50 < n)),
        vote((m("shouts") == 0) & some, m("shouts") * 10 > n),
        vote((m("again") * 5 < m("lines")) & (m("lines") > 2), (m("again") * 2 > m("lines")) & (m("lines") > 2)),
        vote(some & (m("chars").between(4 * n, 8 * n)), (n > 0) & ~m("chars").between(3 * n, 14 * n)),
    ]


N_LABELLERS = 8


def with_votes(docs: DataFrame) -> DataFrame:
    """``_w`` (words) and ``_votes``, a letter for each labeller, of the texts of all rows."""
    seen = docs.select(text().alias("_t")).withColumn("_w", words(F.col("_t")))
    return seen.withColumn("_m", measures()).withColumn("_votes", F.when(F.size("_w") == 0, F.lit(NONE * N_LABELLERS)).otherwise(F.concat(*labellers())))


def fit_votes(patterns: dict[str, int], rounds: int = 100) -> tuple[dict[str, float], np.ndarray, float]:
    """Posterior of good for each pattern, each labeller's vote rates by class (bad, good) and the share of good."""
    keys = sorted(patterns)
    counts = np.array([patterns[k] for k in keys], dtype=float)
    votes = np.array([[(GOOD, BAD, NONE).index(v) for v in k] for k in keys]).reshape(len(keys), -1)
    hot = np.eye(3)[votes][:, :, :2]  # pattern, labeller, vote; not to vote says nothing
    for_, against = hot[:, :, 0].sum(1), hot[:, :, 1].sum(1)
    good = (for_ + 1.0) / (for_ + 3.0 * against + 2.0)  # a vote against says more: most documents are unremarkable
    rates, share = np.zeros((2, votes.shape[1], 2)), 0.5
    for _ in range(rounds):
        mass = np.stack([counts * (1 - good), counts * good])
        share = (mass[1].sum() + 1) / (counts.sum() + 2)
        rates = np.einsum("cp,plv->clv", mass, hot) + 0.5
        rates /= rates.sum(2, keepdims=True)
        logs = np.einsum("clv,plv->cp", np.log(rates), hot) + np.log([[1 - share], [share]])
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return dict(zip(keys, good.tolist(), strict=True)), rates, float(share)


def features(w: Column) -> Column:
    """Tokens that are hashed: words in lower case, their last three characters, and a mark for a repeated word."""
    n = F.size(w)
    same = F.zip_with(F.slice(w, 2, F.greatest(n - 1, F.lit(0))), F.slice(w, 1, F.greatest(n - 1, F.lit(0))), lambda a, b: F.when(a == b, F.lit("\n=")))
    return F.concat(F.transform(w, lambda x: F.lower(x)), F.transform(w, lambda x: F.concat(F.lit("\n"), F.right(x, F.lit(3)))), F.filter(same, lambda x: x.isNotNull()))


def hashed(df: DataFrame, dimensions: int) -> DataFrame:
    counted = HashingTF(numFeatures=dimensions, inputCol="_tokens", outputCol="_tf").transform(df.withColumn("_tokens", features(F.col("_w"))))
    return Normalizer(p=2.0, inputCol="_tf", outputCol="_x").transform(counted)


def fit(docs: DataFrame, train_rows: int = 10_000, dimensions: int = 1 << 15) -> LogisticRegressionModel | None:
    """EM over all documents' votes, then the scorer on about ``train_rows`` of them; None without any words."""
    patterns = {r["_votes"]: r["n"] for r in with_votes(docs).groupBy("_votes").agg(F.count("*").alias("n")).collect()}
    patterns.pop(NONE * N_LABELLERS, None)
    if not patterns:
        return None
    posterior, _, _ = fit_votes(patterns)
    spark = docs.sparkSession
    soft = spark.createDataFrame(list(posterior.items()), "_votes string, _good double")
    every = max(1, math.ceil(sum(patterns.values()) / train_rows))
    sample = with_votes(docs.where(F.pmod(F.xxhash64(F.lit("train"), F.col("doc_id")), F.lit(every)) == 0))
    rows = hashed(sample.join(F.broadcast(soft), "_votes"), dimensions)
    sides = F.array(F.struct(F.lit(1.0).alias("label"), F.col("_good").alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("_good")).alias("weight")))
    # the few training rows of all scan tasks go to as many partitions as there are cores: each iteration is a job
    dealt = rows.select("_x", sides.alias("_s")).repartition(spark.sparkContext.defaultParallelism)
    train = dealt.select("_x", F.explode("_s").alias("_s")).select("_x", "_s.*").where("weight > 0.0001").cache()
    try:
        return LogisticRegression(featuresCol="_x", labelCol="label", weightCol="weight", maxIter=60, regParam=1e-6, standardization=False).fit(train)
    finally:
        train.unpersist()


def judged(docs: DataFrame, model: LogisticRegressionModel | None, least: float = 0.5) -> DataFrame:
    """``row`` (a struct of the whole input row) and ``quality``: n_words, score (probability of good) and kept."""
    if model is None:
        quality = F.struct(F.lit(0).cast("long").alias("n_words"), F.lit(0.0).alias("score"), F.lit(False).alias("kept"))
        return docs.select(F.struct("*").alias("row"), quality.alias("quality"))
    rows = hashed(docs.select(F.struct("*").alias("row"), words(text()).alias("_w")), model.numFeatures)
    out = model.setProbabilityCol("_p").setRawPredictionCol("").setPredictionCol("").transform(rows)
    n = F.size("_w").cast("long")
    score = F.when(n > 0, vector_to_array("_p")[1]).otherwise(0.0)
    return out.select("row", F.struct(n.alias("n_words"), score.alias("score"), ((n > 0) & (score >= least)).alias("kept")).alias("quality"))


def classify(docs: DataFrame, model: LogisticRegressionModel | None, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with ``quality``, in place of a column of that name."""
    return judged(docs, model, least).select(*[F.col(f"row.`{c}`") for c in docs.columns if c != "quality"], "quality")
