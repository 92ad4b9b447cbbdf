"""Token counts through a digest cache: only distinct contents that the cache lacks are encoded.

The cache is a Parquet folder of (digest, version, n_tokens): the SHA-256 of the content and the digest
of the tokenizer's file and settings.  Runs append to it; nothing is rewritten.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few_rows, others, ship, stored, utf8, whole_row
from .tokens import ByteCounts, kept

#: A content is hot above this many rows, and above one row in so many of all: so at most HOT_SHARE are.
HOT_ROWS, HOT_SHARE = 256, 100_000

CACHE = "digest binary, version string, n_tokens long"


@dataclass(frozen=True)
class CountRules:
    tokenizer: str
    #: Folder of the cache, shared by all machines.
    cache: str
    limit: int = 1024


def tokenizer_version(path: str) -> str:
    """Digest of a tokenizer's file and of how it is applied."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read() + b"|no special tokens added").hexdigest()


def cached_counts(spark: SparkSession, rules: CountRules, version: str) -> DataFrame:
    """Stored counts of one tokenizer version; none where there is no cache yet."""
    try:
        found = spark.read.schema(CACHE).parquet(rules.cache)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = spark.createDataFrame([], CACHE)
    return found.filter(F.col("version") == version).select("digest", "n_tokens")


def _distinct_texts(batches):
    """Map side: each content of the task once, with its digest."""
    seen: set[bytes] = set()
    for batch in few_rows(batches):
        digests, texts = [], []
        for text in batch.column(0).to_pylist():
            d = hashlib.sha256(utf8(text)).digest()
            if d not in seen:
                seen.add(d)
                digests.append(d)
                texts.append(text or "")
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(texts, pa.string())], names=["digest", "text"])


def _encoded(path: str):
    def run(batches):
        count, seen = kept(ByteCounts, path), set()
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                digests, texts = batch.column(0).slice(k, 1024), batch.column(1).slice(k, 1024)
                new = []
                for i, d in enumerate(digests.to_pylist()):
                    if d not in seen:
                        seen.add(d)
                        new.append(i)
                yield pa.RecordBatch.from_arrays([digests.take(pa.array(new, pa.int64())), pa.array(count(texts.take(pa.array(new, pa.int64()))))], names=["digest", "n_tokens"])

    return run


def fill_cache(docs: DataFrame, contents: DataFrame, rules: CountRules, version: str, text: str) -> None:
    """Encode the distinct contents that the cache lacks and append them."""
    spark = docs.sparkSession
    misses = stored(contents.select("digest").join(cached_counts(spark, rules, version), "digest", "left_anti"), "misses")
    if misses.isEmpty():
        return
    texts = docs.select(F.col(text).alias("text")).mapInArrow(_distinct_texts, "digest binary, text string")
    wanted = texts.join(misses.hint("shuffle_hash"), "digest", "left_semi")
    counts = wanted.mapInArrow(_encoded(rules.tokenizer), "digest binary, n_tokens long").dropDuplicates(["digest"])
    counts.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(rules.cache)


def token_counts(docs: DataFrame, rules: CountRules, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """docs (or the named columns) with n_bytes, n_tokens and over_limit.

    Null text is empty: 0 bytes, 0 tokens.  Equal contents are encoded once, whatever their rows.  Special
    strings in texts are as the library treats them by default; a text of any length is cut and encoded in
    fragments.  Rows that repeat an id each keep their own count.  An empty table gives an empty one; other
    columns stay, those named like results (in any case) are replaced.

    Contents with more than one row in HOT_SHARE of all rows (at most HOT_SHARE contents, by count) meet their
    rows by broadcast, so no content's rows gather in one task; all others by a shuffle on the digest.
    """
    spark = docs.sparkSession
    ship(spark)
    version = tokenizer_version(rules.tokenizer)
    keep = others(docs if columns is None else columns, ("n_bytes", "n_tokens", "over_limit"))
    filled = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(whole_row(keep), F.octet_length(filled).cast("long").alias("n_bytes"), F.unhex(F.sha2(filled, 256)).alias("digest"))
    rows = stored(rows, "digests")
    contents = stored(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")), "contents")
    fill_cache(docs, contents, rules, version, text)
    counts = cached_counts(spark, rules, version).dropDuplicates(["digest"])
    hot = contents.filter(F.col("n") > max(HOT_ROWS, rows.count() // HOT_SHARE)).select("digest")
    known = stored(hot.join(counts, "digest"), "hot")
    often = rows.join(F.broadcast(known), "digest")
    seldom = rows.join(F.broadcast(known.select("digest")), "digest", "left_anti").join(counts, "digest", "left")
    names = ["_row", "n_bytes", "n_tokens"]
    both = often.select(*names).unionByName(seldom.select(*names))
    return both.select("_row.*", "n_bytes", "n_tokens", (F.col("n_tokens") > rules.limit).alias("over_limit"))
