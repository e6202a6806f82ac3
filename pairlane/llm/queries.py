"""One registered query per operator of this subpackage, and the pipeline; SQL where SQL expresses the rows."""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, functions as F

from . import decontaminate, fingerprints, jaccard, packing, pages, prefix_trie, secret_scan, sharding, spelling, substrings, suffix_dedup, token_counts, toxicity
from .common import table
from .queries_sql import ORACLES

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_file(name: str) -> str:
    """A public tokenizer's file, from the package that holds them or the folder in TOKENIZER_DIR."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers
    return str(public_tokenizers.path(name))


def token_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


@query
def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    return pages.extract_main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))


@query
def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))


@query
def op4_packing(spark, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_file("word_bpe_49k.json"))


@query
def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.withColumn("containment", F.col("n_common") / F.col("n_item"))


@query
def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents", "doc_id", "text"), k=3, threshold=90)


#: Uncompressed text bytes a shard may hold.
SHARD_BYTES = 64 << 20


@query
def op7_sharding(spark, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents", "doc_id", "text"), SHARD_BYTES, ["doc_id"])


@query
def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return secret_scan.scan(docs, secret_scan.train(docs))


@query
def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    kept = substrings.dedup_substrings(table(spark, sf_dir, "documents", "doc_id", "text"), width=35)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "source", "text")
    return token_counts.count_tokens(docs, tokenizer_file("byte_bpe_50k.tiktoken"), token_pattern(), ["lang", "source", "text"], body="text")


@query
def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


@query
def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op13_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.dedup_bytes(table(spark, sf_dir, "documents", "doc_id", "text"), width=200)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


__all__ = ["QUERIES", "ORACLES"]
