"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions alone.

Each source's target gives whole copies of every document for certain, and a rest of words.  The rest
is a fixed-size sample, its size in words as targets are: documents are ranked by random odds over
inclusion odds, and the head of that order is taken that fits the rest; what the next document is too
long for goes to the documents after it that are not.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import others, range_count, stored, whole_row, with_small


@dataclass(frozen=True)
class MixRules:
    #: Weights of the sources in order of code point, repeating; null comes last.
    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    #: Words of the mix over words of all documents.
    share: float = 1.5
    #: Most copies of a document, and of a source.
    most: int = 2
    #: Documents with at least so many words are twice as likely to give the extra copy.
    long_words: int = 50
    #: About so many documents are ranked in one window.
    bucket_rows: int = 4096
    seed: str = "mix-1"


def in_order(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with the sums of the rows before each in an order, and its place (_nth, from 0).

    Rows are dealt out by ranges of the order, so no task holds them all; each range starts from the sums of
    the ranges before it, one row a range.
    """
    spark, n = rows.sparkSession, rows.count()
    dealt = stored(rows.repartitionByRange(range_count(spark, n, 65_536), *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = sums | {"_nth": F.lit(1)}
    parts = dealt.groupBy(F.col("_part").alias("_of")).agg(*[F.sum(c).alias(f"{name}_own") for name, c in sums.items()])
    ahead = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    parts = parts.select("_of", *[F.coalesce(F.sum(f"{name}_own").over(ahead), F.lit(0)).alias(f"{name}_ahead") for name in sums])
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = [(F.col(f"{name}_ahead") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(name) for name, c in sums.items()]
    return dealt.join(F.broadcast(parts), F.col("_part") == F.col("_of")).select(*rows.columns, *own)


def source_targets(sizes: DataFrame, source: str, rules: MixRules) -> DataFrame:
    """Rows (source, size, n, weight, target) from a table of sources' sizes.

    Targets are lambda * weight, at most ``most`` times the size.  In order of bound over weight the sources
    that reach their bound come first, so lambda is what the first that does not would give: one aggregate
    over the sources, whatever their number.
    """
    size, bound = F.col("size"), F.col("size") * float(rules.most)
    numbered = in_order(sizes, [F.col(source).asc_nulls_last()], {})
    weight = F.element_at(F.array(*[F.lit(w) for w in rules.weights]), (F.pmod(F.col("_nth"), F.lit(len(rules.weights))) + 1).cast("int"))
    rows = stored(numbered.withColumn("weight", weight).drop("_nth"), "sources")
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight")).first()
    ranked = in_order(rows, [bound / F.col("weight"), F.col(source).asc_nulls_last()], {"held": bound, "used": F.col("weight")})
    scale = (rules.share * float(total["size"]) - F.col("held")) / (float(total["weight"]) - F.col("used"))
    ranked = ranked.withColumn("scale", scale).filter(F.col("weight") * F.col("scale") < bound)
    first = ranked.agg(F.min_by("scale", "_nth").alias("scale")).first()["scale"] or 0.0
    return rows.withColumn("target", F.least(F.col("weight") * first, bound))


def uniform(*parts: Column, seed: str) -> Column:
    """A number in (0, 1) from the md5 of the parts: the same in every run and engine."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def mix(sized: DataFrame, doc_id: str = "doc_id", source: str = "source", size: str = "size", rules: MixRules = MixRules()) -> DataFrame:
    """sized with source_size, target, copies and taken.

    sized holds a document's id, source and size; other columns stay.  copies is how often the mix
    takes the document; taken is copies times size.  Null sources are one source, the last.  Null or
    repeated ids: such rows with equal sizes tie in the order and either may be taken, so their multiset
    is the same in each run.  Size 0 (empty texts) is taken for nothing; a size of any length may be taken if
    it fits.  An empty table gives an empty one.  Other columns keep their values whatever their names; those
    named like results (in any case) are replaced.

    The extra copies follow Pareto order; what the first document that does not fit leaves open, less than its
    length in words, is filled in order by shorter ones, so these are a little likelier than their odds.
    """
    new = ("source_size", "target", "copies", "taken")
    keep = others(sized, new)
    rows = stored(
        sized.select(
            whole_row(keep), F.col(doc_id).alias("_id"), F.col(source).alias("_source"), F.col(size).cast("long").alias("_size"),
            F.monotonically_increasing_id().alias("_no"),
        ), "sized",
    )
    docs = rows.drop("_row")
    sizes = docs.groupBy(F.col("_source").alias("src")).agg(F.sum("_size").alias("size"), F.count(F.lit(1)).alias("n"))
    targets = source_targets(sizes, "src", rules).withColumnRenamed("size", "source_size")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    sure = F.least(F.floor(ratio + 1e-12), F.lit(rules.most)).cast("long")
    rest = F.greatest(F.col("target") - sure * F.col("source_size"), F.lit(0.0))
    targets = stored(targets.withColumn("sure", sure).withColumn("rest", rest), "targets")
    targets = stored(inclusion_factors(docs, targets, rules), "inclusion")

    docs = with_small(docs, targets, F.col("_source").eqNullSafe(F.col("src")))
    p = inclusion(level(rules))
    u = uniform(F.col("_id"), F.col("_size"), seed=rules.seed)
    q = F.when(p >= 1.0, F.lit(0.0)).when(p <= 0.0, F.lit(1e300)).otherwise((u / (1 - u)) / (p / (1 - p)))
    bucket = F.floor(F.least(place() / F.col("n"), F.lit(1.0 - 1e-12)) * F.ceil(F.col("n") / rules.bucket_rows))
    ranked = docs.withColumn("_u", u).withColumn("_q", q).withColumn("_bucket", bucket)
    ranked = ranked.select("_no", "src", "_id", "_size", "_q", "_bucket", "rest", "sure", "source_size", "target")
    first = stored(ranked.withColumn("_rest", F.col("rest")).transform(head, True).drop("_rest"), "first")
    # what the first document that does not fit leaves open goes to the next ones in order that do
    gaps = first.groupBy(F.col("src").alias("_gs")).agg((F.max("rest") - F.sum(F.when(F.col("_in"), F.col("_size")).otherwise(0))).alias("_rest"))
    left = with_small(first.filter(~F.col("_in")).drop("_in"), stored(gaps, "gaps"), F.col("src").eqNullSafe(F.col("_gs")), "inner")
    second = left.filter((F.col("_size") > 0) & (F.col("_size") <= F.col("_rest"))).transform(head, False).filter("_in").select(F.col("_no").alias("_also"))
    both = first.join(second, F.col("_no") == F.col("_also"), "left")
    extra = F.when(F.col("_in") & (F.col("rest") > 0) | F.col("_also").isNotNull(), 1).otherwise(0)
    copies = F.least(F.col("sure") + extra, F.lit(rules.most)).cast("long")
    chosen = both.withColumn("copies", copies).select(F.col("_no").alias("_at"), "source_size", "target", "copies", (F.col("copies") * F.col("_size")).alias("taken"))
    return rows.select("_row", "_no").join(chosen, F.col("_no") == F.col("_at")).select("_row.*", *new)


def head(ranked: DataFrame, whole: bool) -> DataFrame:
    """ranked with _in: whether a row is in the head of its source's order whose words reach _rest.

    whole: only rows that end within _rest; else also one whose middle does.  Words of the buckets before
    come from sums of buckets, so a source is ordered in tasks of about a bucket each.
    """
    sums = ranked.groupBy(F.col("src").alias("_bs"), F.col("_bucket").alias("_bb")).agg(F.sum("_size").alias("_sum"))
    ahead = Window.partitionBy("_bs").orderBy("_bb").rowsBetween(Window.unboundedPreceding, -1)
    sums = stored(sums.select("_bs", "_bb", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead")), "buckets")
    rows = with_small(ranked, sums, F.col("src").eqNullSafe(F.col("_bs")) & (F.col("_bucket") == F.col("_bb")), "inner")
    within = Window.partitionBy("src", "_bucket").orderBy("_q", F.col("_id").asc_nulls_first(), "_size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_ahead") + F.coalesce(F.sum("_size").over(within), F.lit(0))
    part = F.col("_size") if whole else F.col("_size") / 2.0
    return rows.withColumn("_in", start + part <= F.col("_rest")).drop("_bs", "_bb", "_ahead")


def level(rules: MixRules) -> Column:
    return F.when(F.col("_size") >= rules.long_words, F.lit(2.0)).otherwise(F.lit(1.0))


def inclusion(lev: Column | float) -> Column:
    """Probability that a document of a level gives an extra copy."""
    return F.least(F.greatest(F.col("factor") * lev, F.lit(0.0)), F.lit(1.0))


def place() -> Column:
    """A row's expected place in its source's order: grows with _q, and uniform over the source's rows.

    It is the number of rows that _q is expected to pass in each level.  Rows that are taken in any order,
    or in none, are spread by _u.
    """
    n_long, s_long = F.col("n_long"), F.col("s_long")
    levels = ((inclusion(2.0), n_long, s_long), (inclusion(1.0), F.col("n") - n_long, F.col("source_size") - s_long))

    def passed(p: Column) -> Column:
        x = F.col("_q") * (p / (1 - p))
        return F.when(p >= 1.0, F.lit(1.0)).when(p <= 0.0, F.lit(0.0)).otherwise(x / (1 + x))

    def whole(of: int) -> Column:
        return sum((F.when(level[0] >= 1.0, level[of]).otherwise(F.lit(0)) for level in levels), F.lit(0))

    # all rows with _q = 0 fit, whatever their order, but for rounding
    first = F.when(whole(2) <= F.col("rest"), whole(1) * F.col("_u")).otherwise(F.lit(0.0))
    ordered = sum((n * passed(p) for p, n, _ in levels), F.lit(0.0))
    return F.when(F.col("rest") <= 0, F.col("n") * F.col("_u")).when(F.col("_q") == 0.0, first).otherwise(ordered)


def inclusion_factors(docs: DataFrame, targets: DataFrame, rules: MixRules) -> DataFrame:
    """targets with ``factor``: an extra copy has the inclusion probability min(1, factor * level).

    Solved from the sums of each (source, level), heaviest level first: a level whose probability
    would pass 1 is taken whole, and the rest is shared by the lighter ones.  n_long and s_long are
    the documents of the heavier level and their words.
    """
    levels = docs.groupBy("_source", level(rules).alias("lev")).agg(F.sum("_size").alias("s"), F.count(F.lit(1)).alias("m"))
    levels = levels.join(targets.select("src", "rest"), F.col("_source").eqNullSafe(F.col("src")))
    heavier = Window.partitionBy("src").orderBy(F.col("lev").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("src")
    held = F.coalesce(F.sum("s").over(heavier), F.lit(0))
    weighted = F.col("s") * F.col("lev")
    free = F.sum(weighted).over(whole) - F.coalesce(F.sum(weighted).over(heavier), F.lit(0.0))
    levels = levels.withColumn("f", F.when(free > 0, (F.col("rest") - held) / free).otherwise(F.lit(0.0)))
    fits = F.when(F.col("f") * F.col("lev") <= 1.0, F.col("f"))
    long = [F.coalesce(F.sum(F.when(F.col("lev") > 1.0, F.col(c))), F.lit(0)).alias(name) for c, name in (("m", "n_long"), ("s", "s_long"))]
    factors = levels.groupBy(F.col("src").alias("src_f")).agg(F.coalesce(F.max(fits), F.max("f"), F.lit(0.0)).alias("factor"), *long)
    return targets.join(factors, F.col("src").eqNullSafe(F.col("src_f"))).drop("src_f")
