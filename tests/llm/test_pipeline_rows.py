"""Rows of the pipeline's last stages against a plain mix and the tokenizers library."""

from collections import Counter

import corpus_pipeline as p
import pytest
from sitlake.llm.common import read

from ..conftest import DATA
from . import brute
from .plain_mix import plain_mix
from .test_operators import check_tokens


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Rows before and after the mix, and of the token files."""
    at = tmp_path_factory.mktemp("rows")
    docs, out = read(spark, DATA, "documents"), []
    for k, (_, stage) in enumerate(p.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        out.append(docs.collect())
    return out[-3:]


def test_mix_is_the_plain_order(steps):
    before, after, _ = steps
    ids = [r["doc_id"] for r in before]
    assert len(set(ids)) == len(ids)
    copies = plain_mix([(r["doc_id"], r["source"], len(brute.NOT_SPACE.findall(r["text"] or ""))) for r in before])
    rows = {r["doc_id"]: tuple(r) for r in before}
    assert Counter(map(tuple, after)) == Counter({rows[i]: n for i, n in copies.items() if n})


def test_token_rows_are_the_library_s(steps):
    _, after, files = steps
    check_tokens([(r["doc_id"], r["text"]) for r in after], [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in files])


def test_the_plain_order_tells_a_short_mix(steps):
    before, after, _ = steps
    copies = plain_mix([(r["doc_id"], r["source"], len(brute.NOT_SPACE.findall(r["text"] or ""))) for r in before])
    short = Counter(r["doc_id"] for r in after[: len(after) // 2])
    assert set(short) <= set(copies) and max(short.values()) <= 2 and short != Counter({i: n for i, n in copies.items() if n})
