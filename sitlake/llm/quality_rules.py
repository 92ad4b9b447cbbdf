"""Quality rules with host-level verdicts, in DataFrame functions alone.

Each document is measured in one narrow pass (no shuffle of texts or words).  Rule failures are
summed by host, each host's rate is shrunk with a beta prior that is fitted to all hosts by moments,
and the host's verdict is joined back to its documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, free_name, space_words, stored, with_small


@dataclass(frozen=True)
class QualityLimits:
    """Limits of the rules; a document fails a rule beyond them."""

    min_words: int = 10
    max_repeat_share: float = 0.20
    max_symbols_per_word: float = 0.25
    max_dup_line_share: float = 0.50
    #: A host goes as a whole if its shrunk failure rate is above this.
    max_host_rate: float = 0.80
    window: int = 5


def repeat_words(words: Column, n: int) -> Column:
    """Words that stand in an n-word window found twice or more in the array.

    Hashes of all windows are sorted as primitives; only arrays with equal neighbours go on to the
    sort of (hash, position) pairs.  O(n log n) in a document's words.
    """
    count = F.size(words) - (n - 1)

    def windows(each: Column) -> Column:  # each word is hashed once, each window from its words' hashes
        return F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.xxhash64(*[F.get(each, i + (k - 1)) for k in range(n)]))

    hashes = F.when(count > 1, _let(F.transform(words, lambda w: F.xxhash64(w)), windows)).otherwise(F.array().cast("array<bigint>"))

    def of_pairs(hs: Column) -> Column:
        pairs = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def again(ps: Column) -> Column:
            near = F.filter(ps, lambda p, k: (p["h"] == F.get(ps, k - 1)["h"]) | (p["h"] == F.get(ps, k + 1)["h"]))
            return F.sort_array(F.transform(near, lambda p: p["i"]))

        def covered(at: Column) -> Column:
            gaps = F.zip_with(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(n)))
            return F.when(F.size(at) == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(n), lambda s, g: s + g))

        return _let(_let(pairs, again), covered)

    def repeated(hs: Column) -> Column:
        differ = F.size(F.array_distinct(hs)) == F.size(hs)
        return F.when(differ, F.lit(0)).otherwise(of_pairs(hs))

    return _let(hashes, repeated).cast("long")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def measures(text: Column, limits: QualityLimits = QualityLimits()) -> Column:
    """Struct of a text's measures: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    filled = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(filled, "\n", -1), lambda x: x.rlike(NOT_SPACE))
    return _let(
        space_words(text),
        lambda ws: F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            F.regexp_count(filled, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            repeat_words(ws, limits.window).alias("n_repeat_words"),
            _let(lines, lambda ls: F.struct((F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("dup"), F.size(ls).cast("long").alias("n"))).alias("lines"),
        ),
    )


def base_failed(n_words: Column, n_repeat: Column, limits: QualityLimits) -> Column:
    return (n_words < limits.min_words) | (100 * n_repeat > F.lit(int(100 * limits.max_repeat_share)) * n_words)


def host_verdicts(scored: DataFrame, host: str, failed: str, limits: QualityLimits) -> DataFrame:
    """One row per host (_host): n, fails, rate (shrunk), host_rejected.

    The beta prior's mean m and weight s come from the moments of all hosts' raw rates.  Sums are
    partial per task, so one host with most rows is no hot spot; only one row reaches the driver.
    """
    hosts = stored(scored.groupBy(F.col(host).alias("_host")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(failed).cast("long")).alias("fails")), "hosts")
    p = F.col("fails") / F.col("n")
    row = hosts.agg(
        (F.sum("fails") / F.sum("n")).alias("mean"), F.var_pop(p).alias("var"), F.avg(1 / F.col("n")).alias("inv_n"), F.count(F.lit(1)).alias("hosts")
    ).first()
    mean = min(max(row["mean"] or 0.0, 1e-6), 1 - 1e-6)
    noise = mean * (1 - mean) * (row["inv_n"] or 0.0)
    between = max((row["var"] or 0.0) - noise, 1e-9)
    weight = min(max(mean * (1 - mean) / between - 1, 2.0), 1e6)
    rate = (F.col("fails") + mean * weight) / (F.col("n") + weight)
    return hosts.withColumn("rate", rate).withColumn("host_rejected", F.col("rate") > limits.max_host_rate)


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", limits: QualityLimits = QualityLimits(), columns: list[str] | None = None) -> DataFrame:
    """docs (or just the named columns of it) with a struct column ``quality`` and a boolean ``kept``.

    A document is kept if it passes the base rules (words, repeated windows), the symbol and
    repeated-line rules, and its host is not rejected.  Null and empty texts: no words, so they fail.  A text
    of any length is measured whole.  Null host: a host of its own.  A rate at the bound is kept.  Equal rows
    get equal verdicts; no row is dropped; an empty table stays empty.  Columns of docs keep their values
    whatever their names; those named quality or kept (in any case) are replaced.
    """
    spare = free_name(docs, "_q")
    m = F.col(spare)
    words = F.greatest(m["n_words"], F.lit(1))
    base = base_failed(m["n_words"], m["n_repeat_words"], limits)
    own = (m["n_symbols"] > limits.max_symbols_per_word * words) | (m["lines"]["dup"] > limits.max_dup_line_share * F.greatest(m["lines"]["n"], F.lit(1)))
    hidden = free_name(docs, "_host")
    scored = (
        docs.drop("quality", "kept")
        .withColumn(spare, measures(F.col(text), limits))
        .withColumn(
            "quality",
            F.struct(
                m["n_words"].alias("n_words"), m["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"), m["lines"]["dup"].alias("n_dup_lines"),
                m["n_repeat_words"].alias("n_repeat_words"), base.alias("base_failed"), own.alias("own_failed"),
            ),
        )
        .drop(spare)
    )
    if columns is not None:
        scored = scored.select(*dict.fromkeys([*columns, host]), "quality")
    scored = stored(scored, "quality")
    hosts = host_verdicts(scored.select(F.col(host).alias("_h"), (F.col("quality.base_failed") | F.col("quality.own_failed")).alias("_fails")), "_h", "_fails", limits)
    verdict = hosts.select(F.col("_host").alias(hidden), F.col("host_rejected").alias(f"{hidden}_no"))
    out = with_small(scored, verdict, F.col(host).eqNullSafe(F.col(hidden)))
    kept = ~(F.col("quality.base_failed") | F.col("quality.own_failed") | F.coalesce(F.col(f"{hidden}_no"), F.lit(False)))
    return out.withColumn("kept", kept).drop(hidden, f"{hidden}_no")
