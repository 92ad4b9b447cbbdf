"""Stages of the pipeline over odd rows and extra columns, each against plain versions."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from sitlake.llm.common import read, scratch_dir, scratch_paths, stored

from ..conftest import DATA
from . import brute
from .test_operators import LONG, WORDS

PLAIN = " ".join(WORDS[:60])
#: Null, empty and blank texts; null ids and sources; repeated ids, ties and rows; very long texts.
ROWS = [
    (1, None, "a"), (2, "", "a"), (3, " \n\t", None), (4, LONG, "b"), (5, LONG, "b"), (6, PLAIN, None), (6, PLAIN, None), (7, PLAIN + " more", "a"), (None, " ".join(WORDS[60:120]), "a"),
    (None, " ".join(WORDS[120:180]), None), (8, "short", "a"), (9, " ".join(WORDS[200:240]), "c"), (9, " ".join(WORDS[240:290]), "c"),
]
#: Names that stages and operators use for themselves.
EXTRA = ["kept", "quality", "_doc", "n_hit", "clean_text", "contaminated", "copies", "taken", "class_id", "first_of_class", "_row", "SIZE", "_text"]
STAGES = dict(pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in ROWS]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return stored(df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(EXTRA)]), "odd")


def texts(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_quality_rules(spark, docs):
    out = STAGES["quality rules"](spark, docs, DATA)
    assert out.columns == docs.columns and texts(out) == sorted(((i, t) for i, t, _ in ROWS if not brute.quality(t)[-1]), key=repr)


def test_jaccard_join(spark, docs):
    out = STAGES["n-gram jaccard join"](spark, docs, DATA)
    rows = [(i, t) for i, t, _ in ROWS]
    classes = {root for root, _ in brute.jaccard(rows)}
    assert out.columns == docs.columns and out.count() == len(classes)
    assert {(4, LONG), (1, None), (2, "")} <= set(texts(out)) and (5, LONG) not in texts(out)


def test_decontamination(spark, docs):
    items = [tuple(r) for r in read(spark, DATA, "benchmark").select("item_id", "text").collect()]
    more = docs.unionByName(docs.limit(1).withColumn("text", F.lit(PLAIN + " " + " ".join(brute.words(items[0][1])))).withColumn("doc_id", F.lit(77).cast("long")))
    out = STAGES["benchmark decontamination"](spark, more, DATA)
    dirty = {t for _, t, *_ in texts_of(more) if brute.leaks([(0, t)], items)[0][-1]}
    assert out.columns == docs.columns and out.count() == sum(t not in dirty for _, t in texts_of(more))
    assert out.filter("n_chars IS NOT NULL AND n_chars <> length(text)").isEmpty()


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_mix(spark, docs):
    out = STAGES["mixing sources"](spark, docs, DATA)
    assert out.columns == docs.columns and set(texts(out)) <= {(i, t) for i, t, _ in ROWS if brute.words(t)}
    assert all(texts(out).count(x) <= 2 * texts(docs).count(x) for x in set(texts(out)))


def test_token_files(spark, docs):
    out = STAGES["token files"](spark, docs, DATA).collect()
    assert sorted((r["doc_id"] for r in out), key=repr) == sorted((i for i, *_ in ROWS), key=repr)
    known = sorted((r["start"], r["n_tokens"]) for r in out)
    assert all(a + n == b for (a, n), (b, _) in zip(known, known[1:], strict=False)) and known[0][0] == 0


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_tables(spark, docs, name):
    out = STAGES[name](spark, docs.filter("false"), DATA)
    assert out.isEmpty()


def test_a_stage_removes_only_what_its_own_run_left(spark, docs):
    mark = scratch_dir(spark, "other")
    STAGES["mixing sources"](spark, docs, DATA)
    left = set(pipeline._left[("", DATA)])
    token = pipeline._run.set("another")
    try:
        STAGES["quality rules"](spark, docs, DATA)
    finally:
        pipeline._run.reset(token)
    assert left <= scratch_paths()
    STAGES["quality rules"](spark, docs, DATA)
    assert not left & scratch_paths() and mark in scratch_paths()
