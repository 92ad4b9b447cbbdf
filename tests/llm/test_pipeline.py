"""The pipeline's stages against the brute-force versions of their decisions."""

from collections import Counter

import corpus_pipeline as p
import pytest
from sitlake.llm.common import read

from ..conftest import DATA
from . import brute


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Rows before the first and after each stage, written and read again."""
    at = tmp_path_factory.mktemp("steps")
    docs = read(spark, DATA, "documents")
    out = [docs.collect()]
    for k, (_, stage) in enumerate(p.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        out.append(docs.collect())
    return out


def test_columns_stay(steps):
    assert all(r.__fields__ == steps[0][0].__fields__ for rows in steps[:-1] for r in rows)


def test_quality_keeps_no_base_failure(steps):
    failed = {r["doc_id"] for r in steps[0] if brute.quality(r["text"])[-1]}
    kept = {r["doc_id"] for r in steps[1]}
    assert not failed & kept and len(kept) > 0.5 * len(steps[0])


def test_one_document_of_each_group(steps):
    rows = sorted((r["doc_id"], r["text"]) for r in steps[1])
    assert {r["doc_id"] for r in steps[2]} == {rows[root][0] for root, _ in brute.jaccard(rows)}


def test_no_benchmark_window_stays(spark, steps):
    items = [tuple(r) for r in read(spark, DATA, "benchmark").select("item_id", "text").collect()]
    dirty = {r[0] for r in brute.leaks([(r["doc_id"], r["text"]) for r in steps[2]], items) if r[-1]}
    assert {r["doc_id"] for r in steps[3]} == {r["doc_id"] for r in steps[2]} - dirty
    assert not any(r[2] for r in brute.leaks([(r["doc_id"], r["text"]) for r in steps[3]], items))


def test_mix_takes_no_document_three_times(steps):
    times = Counter(r["doc_id"] for r in steps[4])
    assert set(times) <= {r["doc_id"] for r in steps[3]} and max(times.values()) <= 2


def test_all_rows_reach_the_files(steps):
    assert Counter(r["doc_id"] for r in steps[5]) == Counter(r["doc_id"] for r in steps[4])


def test_run_gives_the_same_rows(spark, steps):
    assert sorted(map(tuple, p.run(spark, DATA).collect())) == sorted(map(tuple, steps[5]))
