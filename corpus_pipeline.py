"""Corpus pipeline: documents to token files in five stages.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents.  A stage's
docs are a written table: it starts by removing what the stage before left in the shared folder, so a
stage's disk is its own.

Null and empty texts have no words and go at the first stage, as do other texts that are too short.  Null ids and
sources stay; rows that repeat an id are documents of their own, and equal ones are copies.  A text of any
length is read whole.  Empty tables, and stages that leave nothing, give empty tables.  Other columns of
documents pass through whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitlake.llm.common import read, release, scratch_paths, space_words, stored, whole_row
from sitlake.llm.decontaminate import LeakRules, decontaminate
from sitlake.llm.jaccard_join import jaccard_join
from sitlake.llm.mixing import mix
from sitlake.llm.quality_rules import quality_rules
from sitlake.llm.queries import tokenizer_path
from sitlake.llm.token_files import TokenRules, read_tokens, write_tokens


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Scratch folders of the stage before, by run and tables: runs never remove each other's.
_left: dict[tuple[str, str], set[str]] = {}
_run: ContextVar[str] = ContextVar("run", default="")


def stage(step: Stage) -> Stage:
    """A step that first removes what the stage before left."""

    @wraps(step)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = (_run.get(), sf_dir)
        release(_left.pop(key, set()))
        before = scratch_paths()
        out = step(spark, docs, sf_dir)
        _left[key] = scratch_paths() - before
        return out

    return run


def carried(docs: DataFrame, *names: str) -> DataFrame:
    """Whole documents as one column, _doc, beside the columns that a stage reads."""
    return docs.select(whole_row(docs.columns, "_doc"), *names)


@stage
def passing_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts go, a null source is a host of its own."""
    return quality_rules(carried(docs, "text", "source"), columns=["_doc"]).filter("kept").select("_doc.*")


@stage
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near-duplicates: of the least id, then the least text; texts without words all stay."""
    return jaccard_join(carried(docs, "doc_id", "text"), columns=["_doc"]).filter("first_of_class").select("_doc.*")


@stage
def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; from others the benchmark's windows are cut, and n_chars follows.  Texts without hits stay as they are."""
    out = decontaminate(carried(docs, "text"), read(spark, sf_dir, "benchmark"), rules=LeakRules(cut=True), columns=["_doc"]).filter("NOT contaminated")
    cut, own = F.col("n_hit") > 0, F.col("_doc")
    doc = own.withField("text", F.when(cut, F.col("clean_text")).otherwise(own["text"]))
    size = F.length("clean_text").cast(docs.schema["n_chars"].dataType)
    return out.select(doc.withField("n_chars", F.when(cut, size).otherwise(own["n_chars"])).alias("_doc")).select("_doc.*")


@stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document stands in it as often as it is taken; texts without words are never taken."""
    sized = carried(docs, "doc_id", "source", F.size(space_words(F.col("text"))).cast("long").alias("size"))
    out = mix(sized).filter("copies > 0 AND size > 0").select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return out.select("_doc.*")


@stage
def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, length and checksum of each document's ids, read back from the token files; null texts are the end id alone."""
    folder, manifest = write_tokens(docs, TokenRules(tokenizer=tokenizer_path("word_bpe_49k.json")))
    return read_tokens(spark, folder, manifest)


STAGES = [
    ("quality rules", passing_quality),
    ("n-gram jaccard join", one_of_each_group),
    ("benchmark decontamination", without_leaks),
    ("mixing sources", mixed),
    ("token files", token_files),
]

#: Tokenizing is not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written and read again; a stage's table goes once the next is written."""
    mark = _run.set(uuid.uuid4().hex)
    try:
        docs, table = read(spark, sf_dir, "documents"), set()
        for name, step in STAGES[:-1]:
            out = step(spark, docs, sf_dir)
            before = scratch_paths()
            docs = stored(out, f"stage-{name.replace(' ', '-')}")
            release(table)
            table = scratch_paths() - before
        out = STAGES[-1][1](spark, docs, sf_dir)
        release(table)
        return out
    finally:
        _run.reset(mark)
