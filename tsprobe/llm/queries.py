"""The queries of the numbered operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tsprobe.llm.common import table
from tsprobe.llm.imatch import fingerprints
from tsprobe.llm.mixing import dealt
from tsprobe.llm.ngram_join import near_duplicates
from tsprobe.llm.ngram_join_sql import JOIN_SQL
from tsprobe.llm.packing import best_fit_pack
from tsprobe.llm.prefix_trie import prefix_trie, shared_starts
from tsprobe.llm.prefix_trie_sql import TRIE_SQL
from tsprobe.llm.quality_model import classify, fit
from tsprobe.llm.quality_rules import clean
from tsprobe.llm.quality_rules_sql import RULES_SQL
from tsprobe.llm.simhash import near_documents
from tsprobe.llm.suffix_dedup import dedup
from tsprobe.llm.suffix_tree import score
from tsprobe.llm.token_counts import count_tokens
from tsprobe.llm.treap_search import ranked_search
from tsprobe.llm.treap_search_sql import SEARCH_SQL
from tsprobe.llm.warc import derive, responses

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op3_ngram_join": JOIN_SQL, "op6_quality_rules": RULES_SQL, "op12_prefix_trie": TRIE_SQL, "op13_treap_search": SEARCH_SQL}


def bpe() -> dict[str, str]:
    """The byte-level vocabulary, as both libraries read it."""
    return {"vocabulary": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, fit(docs)).select("doc_id", "quality.*")


@query
def op2_suffix_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


@query
def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), **bpe())


@query
def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "repeats.*")


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "rules.*")


@query
def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(responses(table(spark, sf_dir, "pages")))


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(table(spark, sf_dir, "documents"), **bpe())


@query
def op9_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


@query
def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


@query
def op11_simhash_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents(table(spark, sf_dir, "documents"))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"), shared_starts).drop("key", "parent_key")


@query
def op13_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
