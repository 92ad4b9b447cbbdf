"""The queries opN_<name>: each applies its operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, scratch_dir, space_words
from .decontaminate import decontaminate
from .jaccard_join import jaccard_join
from .license_scan import license_scan
from .line_dedup import line_dedup
from .mixing import mix
from .quality_rules import quality_rules
from .secret_scan import secret_scan, written
from .sql import SQL
from .token_counts import CountRules, token_counts
from .token_files import TokenRules, read_tokens, write_tokens
from .warc import read_warc, write_warc


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine, and on the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines per document, lines dropped, and the digest of the text that stays."""
    out = line_dedup(read(spark, sf_dir, "documents"), columns=["doc_id"])
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License mentions of each document."""
    out = license_scan(read(spark, sf_dir, "documents"), columns=["doc_id"])
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of each document's ids, read back from the token files."""
    rules = TokenRules(tokenizer=tokenizer_path("word_bpe_49k.json"))
    folder, manifest = write_tokens(read(spark, sf_dir, "documents"), rules)
    return read_tokens(spark, folder, manifest)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that stand in windows of benchmark items."""
    out = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), columns=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of each document; copies are linked too."""
    return jaccard_join(read(spark, sf_dir, "documents"), columns=["doc_id"]).select("doc_id", "class_id", "n_links")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets per document, base findings counted and hashed."""
    found = secret_scan(read(spark, sf_dir, "documents"), columns=["doc_id"])

    def count(k: int):
        return F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")

    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("findings")).alias("spans"),
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    docs = read(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", F.size(space_words(F.col("text"))).cast("long").alias("size"))
    return mix(sized).select("doc_id", "size", "source_size", "target", "taken")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of the quality rules per document."""
    out = quality_rules(read(spark, sf_dir, "documents"), columns=["doc_id"])
    q = "quality."
    return out.select("doc_id", *[F.col(q + c).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")], "kept")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document, through a cache that starts empty."""
    rules = CountRules(tokenizer=tokenizer_path("byte_bpe_50k.json"), cache=scratch_dir(spark, "counts"))
    return token_counts(read(spark, sf_dir, "documents"), rules, columns=["doc_id"])


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all pages, found again through the capture index."""
    pages = read(spark, sf_dir, "pages")
    return read_warc(spark, write_warc(pages), pages)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_license_scan": op2_license_scan,
        "op3_token_files": op3_token_files,
        "op4_decontaminate": op4_decontaminate,
        "op5_jaccard_join": op5_jaccard_join,
        "op6_secret_scan": op6_secret_scan,
        "op7_mixing": op7_mixing,
        "op8_quality_rules": op8_quality_rules,
        "op9_token_counts": op9_token_counts,
        "op10_warc": op10_warc,
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
