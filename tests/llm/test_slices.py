"""Plans and bounds that must hold beyond one slice, block or broadcast."""

import random

import numpy as np
from pyspark.sql import functions as F

from sitlake.llm.common import scratch_paths
from sitlake.llm.decontaminate import LeakRules, decontaminate, loaded, window_slices
from sitlake.llm.jaccard_join import JoinRules, jaccard_join

from . import brute
from .test_operators import WORDS, multiset, near_copies


def bench(spark, same=0):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(WORDS, k=40))) for i in range(30)] + [(1000 + k, " ".join(WORDS[:13])) for k in range(same)]
    return spark.createDataFrame(rows, "item_id long, text string"), rows


def test_many_slices_take_one_counting_pass(spark):
    items, rows = bench(spark)
    texts = [(i, rows[i % 30][1] + f" own {i}") for i in range(60)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame(texts, "doc_id long, text string").mapInArrow(counted, "doc_id long, text string")
    rules = LeakRules(slice_windows=40)
    slices = window_slices(docs.select("text"), items, rules, "text", "item_id")
    assert len(slices) >= 20 and read.value == len(texts)
    out = decontaminate(docs, items, rules=rules)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2  # the counter above and the join
    got = out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert multiset(got) == multiset(brute.leaks(texts, rows))


def test_a_window_of_many_items_is_split(spark):
    items, rows = bench(spark, same=400)
    slices = window_slices(spark.createDataFrame([(rows[-1][1],)], "text string"), items, LeakRules(slice_windows=50), "text", "item_id")
    sizes = [sum(map(len, loaded(s)[0].values())) for s in slices]
    assert max(sizes) <= 100 and sum(sizes) >= 400


def test_a_large_group_moves_each_set_once(spark):
    rows = near_copies(300, 120)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    before = scratch_paths()
    got = {r["doc_id"]: r["n_links"] for r in jaccard_join(df, rules=JoinRules(block=20, strip=16)).collect()}
    want = brute.jaccard(rows)
    assert got == {i: n for (i, _), (_, n) in zip(rows, want, strict=True)}
    filled = [p for p in scratch_paths() - before if "-filled-" in p]
    classes = len({t for _, t in rows})
    moved = spark.read.parquet(filled[0])
    # a set goes once to each group that it is in, however many blocks the group has
    assert moved.groupBy("pivot", "class").count().filter("count > 1").isEmpty() and moved.filter("large").count() >= classes
    assert np.mean([r["n"] for r in moved.groupBy("pivot").agg(F.countDistinct("level", "sub").alias("n")).orderBy(F.col("n").desc()).limit(1).collect()]) > 10
