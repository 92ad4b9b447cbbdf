"""Secret scans with multipart credential linking, in DataFrame functions alone.

Strong findings are matches of the base patterns.  Weak parts (opaque tokens, key ids without a known
prefix, endpoints) are reported only when a complementary part stands in the same scope: an interval
join of parts, done as an as-of search over each text's parts in order of start, so no pairs are made.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import others, stored, whole_row
from .quality_rules import _let

# The base patterns, and the least length of what counts.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # runs of 18 and more: a maximal run that is too short holds no longer one
HEX = r"[0-9a-f]{16,}"
ASSIGN_VALUE = 12
KINDS = ("assign", "access", "hex", "ident", "opaque", "endpoint")
BASE = 3

#: Weak parts: an identifier, an opaque secret, an endpoint.
IDENT = r"""(?i:client_?id|account|user(?:name)?|login|access_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{4,}"""
OPAQUE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}"  # whole runs, which must hold each of OPAQUE_HOLDS
OPAQUE_HOLDS = ("[0-9]", "[A-Z]", "[a-z]")
ENDPOINT = r"(?i:https?|jdbc:[a-z0-9]{2,12}|amqps?|mongodb|redis|postgres(?:ql)?)://[^\s\"'<>]{4,}"
#: Kinds that may stand for each part of a credential, as numbers in KINDS.
SECRETS, IDENTIFIERS, STRONG = (0, 2, 4), (1, 3), (0, 1)
SPAN = "array<struct<s:int,k:int,e:int>>"


@dataclass(frozen=True)
class ScopeRules:
    #: Most code points between two parts of one credential.
    scope: int = 400
    #: Lengths are summed in chunks of so many matches, so a text full of matches costs n**1.5.
    chunk: int = 256


def running(lengths: Column, chunk: int) -> Column:
    """Exclusive running sums of array<int>, in chunks."""

    def add(at: Column, xs: Column) -> Column:
        start = F.struct(at.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(xs, start, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def summed(chunks: Column) -> Column:
        sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x))
        return F.flatten(F.zip_with(chunks, add(F.lit(0), sums), lambda c, at: add(at, c)))

    n = F.size(lengths)
    return _let(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int")), lambda c: F.slice(lengths, c * chunk + 1, chunk)), summed)


def spans(text: Column, pattern: str, kind: int, rules: ScopeRules, keep=None) -> Column:
    """Leftmost non-overlapping matches as array<struct<s,k,e>>: start, kind, end (exclusive) in code points.

    The pattern cuts the text, and running sums of the lengths of gaps and matches give the places.
    keep(match) drops failing matches afterwards, so what they consumed stays consumed.
    """
    none = F.array().cast(SPAN)

    def placed(found: Column) -> Column:
        gaps = F.slice(F.transform(F.split(text, pattern, -1), lambda x: F.length(x)), 1, F.size(found))
        both = F.zip_with(gaps, found, lambda gap, m: gap + F.length(m))
        out = F.zip_with(
            F.zip_with(running(both, rules.chunk), gaps, lambda at, gap: at + gap), found,
            lambda s, m: F.struct(s.alias("s"), F.lit(kind).alias("k"), (s + F.length(m)).alias("e"), (F.lit(True) if keep is None else keep(m)).alias("ok")),
        )
        return F.transform(F.filter(out, lambda x: x["ok"]), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return _let(found, lambda f: F.when(F.size(f) > 0, placed(f)).otherwise(none)).cast(SPAN)


def gated(gate: Column, found: Column) -> Column:
    """Spans of texts that pass the gate; none of others."""
    return F.when(gate, found).otherwise(F.array().cast(SPAN))


def neighbours(parts: DataFrame, key: str, classes: dict[str, Column]) -> DataFrame:
    """parts with, for each class, the nearest end before (_lo), nearest start after (_hi) and overlapping parts, itself too (_n).

    One pass over the starts and ends of each text's parts, in order.
    """
    ends = F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("opens")), F.struct(F.col("e").alias("at"), F.lit(0).alias("opens")))
    marks = parts.withColumn("m", F.explode(ends)).select(*parts.columns, "m.*")
    before = Window.partitionBy(key).orderBy("at", "opens").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(key).orderBy("at", "opens").rowsBetween(1, Window.unboundedFollowing)
    opens = F.col("opens") == 1
    found = []
    for name, own in classes.items():
        marks = marks.withColumns({
            f"{name}_lo": F.max(F.when(own & ~opens, F.col("at"))).over(before), f"{name}_hi": F.min(F.when(own & opens, F.col("at"))).over(after),
            f"{name}_n": F.when(opens, -F.count(F.when(own & ~opens, 1)).over(before)).otherwise(F.count(F.when(own & opens, 1)).over(before)),
        })
        found += [F.max(F.when(opens, F.col(f"{name}_lo"))).alias(f"{name}_lo"), F.max(F.when(~opens, F.col(f"{name}_hi"))).alias(f"{name}_hi"), F.sum(f"{name}_n").alias(f"{name}_n")]
    return marks.groupBy(*parts.columns).agg(*found)


def linked_parts(parts: DataFrame, key: str, rules: ScopeRules) -> DataFrame:
    """Interval join within scopes: of rows (key, s, k, e), the weak ones with a complementary part near.

    The value of an identifier is no secret beside it; weak parts that overlap a base finding are left to
    it.  An endpoint needs a strong finding, or an identifier and a secret that complement each other.
    """
    k, yes = F.col("k"), F.lit(True)

    def left(name: str) -> Column:
        return F.coalesce(F.col("s") - F.col(f"{name}_lo") <= rules.scope, ~yes)

    def right(name: str) -> Column:
        return F.coalesce(F.col(f"{name}_hi") - F.col("e") <= rules.scope, ~yes)

    def near(name: str) -> Column:
        return left(name) | right(name)

    names = {"base": (0, 1, 2), "secret": SECRETS, "ident": IDENTIFIERS, "strong": STRONG}
    parts = neighbours(parts, key, {name: k.isin(*kinds) for name, kinds in names.items()})
    pair = (left("ident") & right("secret")) | (left("secret") & right("ident"))
    pair |= ((F.col("ident_n") > 0) & near("secret")) | ((F.col("secret_n") > 0) & near("ident"))
    weak = ((k == 3) & near("secret")) | ((k == 4) & near("ident")) | ((k == 5) & (near("strong") | pair))
    own = (k.isin(*SECRETS) & near("ident")) | (k.isin(*IDENTIFIERS) & near("secret"))
    parts = parts.select(key, "s", "k", "e", own.alias("linked"), (weak & (F.col("base_n") == 0)).alias("weak"), (F.col("base_n") > 0).alias("over"))
    # an identifier and a secret on the same side of an endpoint and near it are near each other
    parts = neighbours(parts, key, {"secret": k.isin(*SECRETS) & F.col("linked"), "ident": k.isin(*IDENTIFIERS) & F.col("linked")})
    both = (near("secret") | (F.col("secret_n") > 0)) & (near("ident") | (F.col("ident_n") > 0))
    return parts.filter(F.col("weak") | ((k == 5) & both & ~F.col("over"))).select(key, "s", "k", "e")


def secret_scan(docs: DataFrame, text: str = "text", rules: ScopeRules = ScopeRules(), columns: list[str] | None = None) -> DataFrame:
    """docs (or the named columns) with ``base`` and ``findings``: array<struct<s,k,e>> sorted by start and kind.

    k is the number of the kind in KINDS.  base holds the base findings; findings holds those and the
    linked weak parts.  A null text is empty; an empty one has none; a text of any length is scanned whole.
    Parts of one place tie by kind and are all reported.  Texts that are equal are linked once; equal rows get
    equal findings, every row stays, and an empty table gives an empty one.  Other columns stay whatever their
    names; those named base or findings (in any case) are replaced.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    pairs = t.contains(":") | t.contains("=")  # cheap gates: strings that every match holds
    found = {
        0: gated(pairs, spans(t, ASSIGN, 0, rules, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_VALUE)),
        1: gated(t.contains("AKIA"), spans(t, ACCESS, 1, rules)),
        2: spans(t, HEX, 2, rules),
        3: gated(pairs, spans(t, IDENT, 3, rules)),
        5: gated(t.contains("://"), spans(t, ENDPOINT, 5, rules)),
    }
    spare = {k: f"_span{k}" for k in range(len(KINDS))}
    key, extra = "_key", "_linked"
    keep = others(docs if columns is None else columns, ("base", "findings"))
    out = docs.select(whole_row(keep), F.col(text).alias("text"))
    for k, c in found.items():
        out = out.withColumn(spare[k], c)
    some = (F.size(spare[1]) > 0) | (F.size(spare[3]) > 0)
    out = out.withColumn(spare[4], F.when(some, spans(t, OPAQUE, 4, rules, lambda m: m.rlike(OPAQUE_HOLDS[0]) & m.rlike(OPAQUE_HOLDS[1]) & m.rlike(OPAQUE_HOLDS[2]))).otherwise(F.array().cast(SPAN)))
    weak = F.concat(*[F.col(spare[k]) for k in (3, 4, 5)])
    base = F.sort_array(F.concat(*[F.col(spare[k]) for k in range(BASE)]))
    out = out.select("_row", base.alias("base"), weak.alias(extra), F.when(F.size(weak) > 0, F.sha2(t, 256)).alias(key))
    out = stored(out, "secrets")
    parts = out.filter(F.col(key).isNotNull()).groupBy(key).agg(F.first("base").alias("base"), F.first(extra).alias(extra))
    parts = parts.select(key, F.explode(F.concat("base", extra)).alias("p")).select(key, "p.*")
    linked = linked_parts(parts, key, rules).groupBy(key).agg(F.collect_list(F.struct("s", "k", "e")).alias(f"{extra}_on"))
    out = out.join(linked.withColumnRenamed(key, f"{key}_r"), F.col(key) == F.col(f"{key}_r"), "left")
    findings = F.sort_array(F.concat("base", F.coalesce(F.col(f"{extra}_on").cast(SPAN), F.array().cast(SPAN))))
    return out.select("_row.*", "base", findings.alias("findings"))


def written(found: Column) -> Column:
    """kind:start:end of each finding, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
