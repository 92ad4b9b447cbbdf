"""Buckets of the Pareto order: their sizes, and the mix against a plain order."""

import random

import pytest
from pyspark.sql import functions as F

from sitlake.llm import mixing
from sitlake.llm.mixing import MixRules, mix

from .plain_mix import plain_mix

N, BUCKET = 6000, 100


@pytest.mark.parametrize(
    "sizes, weights, share",
    [
        ((60, 10), (1.0, 1.0), 0.9), ((60, 10), (1.0, 1.0), 0.002), ((60, 10), (1.0, 1.0), 1.0), ((60, 10), (1.0, 100.0), 1.5), ((60, 10), (9.0, 1.0), 1.99),
        ((60, 60), (1.0, 1.0), 0.999), ((10, 10), (1.0, 2.0), 1.3),
    ],
)
def test_buckets_of_a_hot_source_are_even(spark, monkeypatch, sizes, weights, share):
    rng = random.Random(7)
    rows = [(i, "b" if i % 6 == 0 else "a", rng.choice(sizes) + rng.randrange(3)) for i in range(N)]
    seen, head = [], mixing.head

    def watched(ranked, whole):
        if whole:
            seen.extend(ranked.groupBy("src", "_bucket").agg(F.count(F.lit(1)).alias("n")).collect())
        return head(ranked, whole)

    monkeypatch.setattr(mixing, "head", watched)
    got = mix(spark.createDataFrame(rows, "doc_id long, source string, size long"), rules=MixRules(weights=weights, share=share, bucket_rows=BUCKET)).collect()
    want = plain_mix(rows, weights, share)
    assert {r["doc_id"]: r["copies"] for r in got} == want and len(set(want.values())) > 1
    assert sum(r["n"] for r in seen) == N and max(r["n"] for r in seen) <= 1.6 * BUCKET
