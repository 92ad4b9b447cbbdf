"""N-gram Jaccard join with Bayesian candidate pruning.

1. Whole texts become sets of word 5-gram hashes.  Documents with equal sets are one class; each class
   is joined once, however many copies it has.
2. MinHash bands name candidate pairs.  A bucket's first member, in an order of hashes, is its pivot;
   the members of all of a pivot's buckets form its group.  Two classes are compared in the group of the
   smallest pivot that they share, so in one place only.
3. A group within a block's bounds is compared in one task.  A larger one is cut into blocks by size level and
   hash; each block goes once to a file in the shared folder, so what is shuffled grows with the group, not
   with its pairs.  A unit is a block and the list of those that it is held against: they are read one after
   the other, and blocks whose sizes cannot reach the threshold never meet.
4. In a comparison MinHash values are compared step by step; a pair is dropped when the posterior
   probability that its Jaccard reaches the threshold falls below the tolerance; the rest is verified
   on the whole sets.  Out come counts of links and a spanning forest, never the pairs themselves.
5. Forests merge into connected classes by rounds of star contraction on stored tables.

Signatures are made once for each class and travel with its set.  A pair at the threshold is missed by all 32
bands of 4 values with a probability of 5e-8, and dropped in one of the eight steps with one of 9e-6 (the
tolerance bounds the posterior of a step, not the loss); pairs above it are lost far less often.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, NOT_WORD, ascii_lower, held, lean, others, range_count, scratch_dir, shared_fs, ship, stored, whole_row


@dataclass(frozen=True)
class JoinRules:
    words: int = 5
    threshold: float = 0.8
    bands: int = 32
    rows: int = 4
    #: Posterior probability below which a candidate pair is dropped.
    tolerance: float = 1e-6
    #: MinHash values compared in a step.
    step: int = 16
    #: A block holds about so many bytes of sets, and about so many classes at most.
    block_bytes: int = 1 << 20
    block: int = 1024
    #: Classes of a block that are compared with another block at a time.
    strip: int = 128
    seed: int = 20231


def loss_at(similarity: float, rules: JoinRules = JoinRules()) -> float:
    """The probability that a pair of this similarity is dropped before it is verified: an exact sum over the steps."""
    from math import comb

    alive, total = {0: 1.0}, rules.bands * rules.rows
    for least in least_matches(rules.threshold, rules.tolerance, rules.step, total):
        after: dict[int, float] = {}
        for m, p in alive.items():
            for k in range(rules.step + 1):
                if m + k >= least:
                    after[m + k] = after.get(m + k, 0.0) + p * comb(rules.step, k) * similarity**k * (1 - similarity) ** (rules.step - k)
        alive = after
    return 1.0 - sum(alive.values())


@lru_cache(maxsize=8)
def least_matches(threshold: float, tolerance: float, step: int, total: int) -> tuple[int, ...]:
    """For each number of compared values, the matches below which a pair is dropped.

    With a uniform prior the posterior of the similarity is Beta(m + 1, n - m + 1); its tail above the
    threshold is a binomial sum.
    """
    from math import comb

    out = []
    for n in range(step, total + 1, step):
        terms = [comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k) for k in range(n + 2)]
        m = 0
        while m <= n and sum(terms[: m + 1]) < tolerance:  # P(similarity >= threshold | m of n)
            m += 1
        out.append(m)
    return tuple(out)


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of n consecutive words; fewer words, but some, are one shingle."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    n = min(n, len(hashes))
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = (out ^ hashes[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _multipliers(rules: JoinRules) -> np.ndarray:
    return np.random.default_rng(rules.seed).integers(1, 1 << 63, rules.bands * rules.rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minhash(grams: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The top 32 bits of the least product with each multiplier."""
    out = np.full(len(by), np.iinfo(np.uint64).max, np.uint64)
    size = max(1, 65_536 // len(by))
    for k in range(0, len(grams), size):
        np.minimum(out, (grams[k : k + size, None] * by[None, :]).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def _word_lists(column: pa.Array) -> list[np.ndarray]:
    values = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    edges = column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def _digest(grams: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _classes(rules: JoinRules, names: list[str]):
    """Each document's class, the digest of its set (null without words); its band values where the task meets the class first."""

    def run(batches):
        by, seen, at = _multipliers(rules), set(), len(names)
        for batch in batches:
            digests, bands, sizes = [], [], []
            for words in _word_lists(batch.column(at)):
                g = shingles(words, rules.words)
                d = _digest(g) if len(g) else None
                digests.append(d)
                sizes.append(len(g))
                bands.append(None if d is None or d in seen else _bands(g, by, rules))
                seen.add(d)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(at)], pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sizes, pa.int64())],
                names=[*names, "class", "bands", "size"],
            )

    return run


def _bands(grams: np.ndarray, by: np.ndarray, rules: JoinRules) -> np.ndarray:
    """One 64-bit value per band, mixed with the band's number."""
    values = minhash(grams, by).reshape(rules.bands, rules.rows).astype(np.uint64)
    mixed = np.arange(1, rules.bands + 1, dtype=np.uint64)
    for k in range(rules.rows):
        mixed = (mixed ^ values[:, k]) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
    return mixed.view(np.int64)


def _grams_of(rules: JoinRules):
    """Of each class once per task: its whole set and its signature."""

    def run(batches):
        by, seen = _multipliers(rules), set()
        for batch in batches:
            rows, signs = {}, []
            for w in _word_lists(batch.column(0)):
                g = shingles(w, rules.words)
                d = _digest(g)
                if d not in seen:
                    seen.add(d)
                    rows[d] = g.tobytes()
                    signs.append(minhash(g, by).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.binary()), pa.array(list(rows.values()), pa.binary()), pa.array(signs, pa.binary())], names=["class", "grams", "sign"])

    return run


def overlaps(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of pairs of sets.

    Many pairs of few sets share their hashes: those that one set alone holds are left out, and the
    others make a 0/1 matrix, in slabs of a bounded width.
    """
    if len(pairs) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in pairs], np.int64)
    _, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    slot = np.where(count > 1, np.cumsum(count > 1) - 1, -1)
    width, edges = int((count > 1).sum()), np.cumsum([0, *map(len, sets)])
    columns = [slot[inverse[a:b]] for a, b in zip(edges, edges[1:], strict=False)]
    total = np.zeros((len(sets), len(sets)))
    slab = max(256, (1 << 22) // len(sets))
    for lo in range(0, width, slab):
        hi = min(lo + slab, width)
        matrix = np.zeros((len(sets), hi - lo), np.float32)
        for k, own in enumerate(columns):
            matrix[k, own[(own >= lo) & (own < hi)] - lo] = 1
        total += matrix @ matrix.T
    return np.rint(total[pairs[:, 0], pairs[:, 1]]).astype(np.int64)


class Forest:
    """Union-find over small numbers; edges() is a spanning forest."""

    def __init__(self, n: int):
        self.up, self.kept = list(range(n)), []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.kept.append((i, j))


class Block:
    """Members of a group: names, copies, pivots, sets and signatures."""

    def __init__(self, table: pa.Table):
        self.names = table.column("class").to_pylist()
        self.copies = np.array(table.column("copies").to_pylist(), np.int64)
        self.pivots = [np.array(p, np.int64) for p in table.column("pivots").to_pylist()]
        self.grams = [np.frombuffer(g, np.uint64) for g in table.column("grams").to_pylist()]
        self.sizes = np.array([len(g) for g in self.grams], np.int64)
        self.sign = np.frombuffer(b"".join(table.column("sign").to_pylist()), np.uint32).reshape(len(self.names), -1)


def linked(rules: JoinRules, pivot: int, a: Block, b: Block) -> np.ndarray:
    """Pairs (i, j) of places in two blocks, or i < j in one, that reach the threshold and are compared in this group."""
    found = []
    lower_a, lower_b = (np.array([p[0] < pivot for p in x.pivots], bool) for x in (a, b))
    for start in range(0, len(a.names), rules.strip):
        i = np.arange(start, min(start + rules.strip, len(a.names)))
        i, j = np.repeat(i, len(b.names)), np.tile(np.arange(len(b.names)), len(i))
        # sizes bound the Jaccard; then values are compared step by step
        lo, hi = np.minimum(a.sizes[i], b.sizes[j]), np.maximum(a.sizes[i], b.sizes[j])
        alive = lo >= rules.threshold * hi - 1e-9
        if a is b:
            alive &= i < j
        i, j = i[alive], j[alive]
        matched = np.zeros(len(i), np.int32)
        for k, least in enumerate(least_matches(rules.threshold, rules.tolerance, rules.step, a.sign.shape[1])):
            own = slice(k * rules.step, (k + 1) * rules.step)
            matched += (a.sign[i, own] == b.sign[j, own]).sum(axis=1, dtype=np.int32)
            alive = matched >= least
            i, j, matched = i[alive], j[alive], matched[alive]
        # compared here only if this is the smallest pivot they share
        mine = ~(lower_a[i] & lower_b[j])
        for k in np.flatnonzero(~mine):
            mine[k] = np.intersect1d(a.pivots[i[k]], b.pivots[j[k]])[0] == pivot
        i, j = i[mine], j[mine]
        if not len(i):
            continue
        left, at_left = np.unique(i, return_inverse=True)
        right, at_right = np.unique(j, return_inverse=True)
        sets = [a.grams[x] for x in left] + [b.grams[x] for x in right]
        both = overlaps(sets, np.stack([at_left, at_right + len(left)], axis=1))
        there = both >= rules.threshold * (a.sizes[i] + b.sizes[j] - both) - 1e-9
        found.append(np.stack([i[there], j[there]], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


LINKS = "class binary, other binary, n_links long"


def link_rows(a: Block, b: Block, pairs: np.ndarray) -> pa.Table:
    """Rows (class, other, n_links): counts of classes' links (other null), and edges of a spanning forest."""
    counts: dict[bytes, int] = {}
    for block, own, other, places in ((a, 0, b, 1), (b, 1, a, 0)):
        links = np.zeros(len(block.names), np.int64)
        np.add.at(links, pairs[:, own], other.copies[pairs[:, places]])
        for x in np.flatnonzero(links).tolist():
            counts[block.names[x]] = counts.get(block.names[x], 0) + int(links[x])
    shift = 0 if a is b else len(a.names)
    names, forest = a.names if a is b else a.names + b.names, Forest(len(a.names) if a is b else len(a.names) + len(b.names))
    for x, y in pairs.tolist():
        forest.join(x, y + shift)
    return pa.table(
        {
            "class": pa.array([*counts, *(names[x] for x, _ in forest.kept)], pa.binary()), "other": pa.array([*[None] * len(counts), *(names[y] for _, y in forest.kept)], pa.binary()),
            "n_links": pa.array([*counts.values(), *[0] * len(forest.kept)], pa.int64()),
        }
    )


def _compared(rules: JoinRules):
    """A group within a block's bounds, as one table."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        held("")
        block = Block(table)
        return link_rows(block, block, linked(rules, key[0].as_py(), block, block))

    return run


def _block_files(folder: str):
    """Rows sorted by block to one file of blocks; gives each block's place: (pivot, level, sub, path, at, n)."""

    def run(batches):
        import uuid

        from pyspark import TaskContext

        fs, root = shared_fs(folder)
        fs.create_dir(root, recursive=True)
        path = f"{root}/blocks-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.arrows"
        at, key, held, places = 0, None, [], []
        with fs.open_output_stream(path, compression=None) as out:

            def flush():
                nonlocal at, held
                table = pa.Table.from_batches(held)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema) as writer:
                    writer.write_table(table)
                data = sink.getvalue()
                out.write(data)
                places.append((*key, path, at, data.size))
                at, held = at + data.size, []

            for batch in batches:
                keys = list(zip(*(batch.column(c).to_pylist() for c in ("pivot", "level", "sub")), strict=True))
                edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
                for lo, hi in zip(edges, edges[1:], strict=False):
                    if lo == hi:
                        continue
                    if held and keys[lo] != key:
                        flush()
                    key = keys[lo]
                    held.append(batch.slice(lo, hi - lo))
            if held:
                flush()
        if not places:
            fs.delete_file(path)
        columns = list(zip(*places, strict=True)) or [()] * 6
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["pivot", "level", "sub", "path", "at", "n"])

    return run


def _met(rules: JoinRules, folder: str):
    """Units (pivot, own, others): a block against each on its list, read one after the other."""

    def run(batches):
        fs, _ = shared_fs(folder)

        def block(place: dict) -> Block:
            with fs.open_input_file(place["path"]) as file:
                file.seek(place["at"])
                return Block(pa.ipc.open_stream(file.read(place["n"])).read_all())

        for batch in batches:
            for pivot, own, others_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a = block(own)
                for place in others_:
                    b = a if place == own else block(place)
                    yield from link_rows(a, b, linked(rules, pivot, a, b)).to_batches()

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the connected components of edges (a, b): root is the least node.

    Rounds of large-star and small-star contraction; each round's edges are stored.
    """
    both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    now, before = stored(both, "edges"), None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state["n"]:
            break
        before = state
        # large star: every neighbour above a node moves to the node's least neighbour
        around = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = around.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        # small star: a node and its lower neighbours move to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stored(moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def jaccard_join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rules: JoinRules = JoinRules(), columns: list[str] | None = None) -> DataFrame:
    """docs (or the named columns) with copy_class, class_id, n_links and first_of_class.

    copy_class names the documents with the same set of shingles; class_id is the smallest doc_id of the
    documents connected by links (Jaccard of 0.8 or more, copies included); n_links counts the documents
    linked to this one, its copies included and itself not; first_of_class is true for one document of
    each class: the smallest id and, among rows that repeat it, the smallest text.

    Texts without words (null, empty) link to nothing: class_id is their own id, copy_class null.  Null ids
    are above all others in a class.  Texts of fewer than five words are one shingle; a text of any length is
    one set, of all its shingles.  Equal rows are copies.  An empty table gives an empty one; other columns stay
    whatever their names, those named like results (in any case) are replaced.
    """
    ship(docs.sparkSession)
    new = ("copy_class", "class_id", "n_links", "first_of_class")
    keep = others(docs if columns is None else columns, new)
    names = ["_row", "_id", "_text", "_no"]
    source = docs.select(
        whole_row(keep), F.col(doc_id).cast("long").alias("_id"), F.xxhash64(F.col(text)).alias("_text"),
        F.monotonically_increasing_id().alias("_no"), word_hashes(F.col(text)).alias("_words"),
    )
    schema = T.StructType([*source.drop("_words").schema.fields, T.StructField("class", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("size", T.LongType())])
    rows = stored(source.mapInArrow(lean(_classes(rules, names)), schema), "classes")
    known = rows.filter(F.col("class").isNotNull())
    classes = stored(known.groupBy("class").agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.max("size").alias("size")), "copies")
    bands = known.filter(F.col("bands").isNotNull()).select(F.xxhash64("class").alias("h"), F.explode("bands").alias("band")).distinct()
    texts = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"))
    links = class_links(texts, classes, candidate_groups(bands), rules)

    counts = links.filter(F.col("other").isNull()).groupBy("class").agg(F.sum("n_links").alias("n_links"))
    roots = components(links.filter(F.col("other").isNotNull()).select(F.col("class").alias("a"), F.col("other").alias("b")))
    named = classes.join(roots, F.col("class") == F.col("node"), "left").select("class", "first", "copies", F.coalesce("root", "class").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("class_id"))
    found = named.join(least, "root").join(counts, "class", "left")
    found = stored(found.select("class", "root", "class_id", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "found")

    slim = stored(rows.select("_no", "_id", "_text", "class").join(found, "class", "left"), "slim")
    order = F.struct(F.coalesce("_id", F.lit((1 << 63) - 1)).alias("i"), F.col("_text").alias("t"), F.col("_no").alias("no"))
    firsts = slim.filter(F.col("class").isNotNull()).groupBy("root").agg(F.min(order).alias("one")).select(F.col("one.no").alias("_one"))
    slim = slim.join(firsts, F.col("_no") == F.col("_one"), "left").select(
        F.col("_no").alias("_at"), F.lower(F.hex("class")).alias("copy_class"), F.when(F.col("class").isNull(), F.col("_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.col("class").isNull() | F.col("_one").isNotNull()).alias("first_of_class"),
    )
    return rows.select("_row", "_no").join(slim, F.col("_no") == F.col("_at")).select("_row.*", *new)


def word_hashes(text: Column) -> Column:
    """Hashes of a text's lower-cased words."""
    split = F.split(ascii_lower(F.coalesce(text, F.lit(""))), f"{NOT_WORD}+", -1)
    return F.transform(F.filter(split, lambda w: w != ""), lambda w: F.xxhash64(w))


def candidate_groups(bands: DataFrame) -> DataFrame:
    """Stored rows (h, pivots) from rows (h, band): the pivots whose groups a class is in.

    Buckets are reduced to their least member by partial sums and joined back, so a bucket of any size
    is no group in one task; AQE splits its partition in the join.
    """
    pivots = bands.groupBy("band").agg(F.min("h").alias("pivot"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", "pivot")
    return stored(bands.join(pivots, "band").groupBy("h").agg(F.sort_array(F.collect_set("pivot")).alias("pivots")), "pivots")


def class_links(texts: DataFrame, classes: DataFrame, groups: DataFrame, rules: JoinRules) -> DataFrame:
    """Stored rows (class, other, n_links): counts of a class's links (other null), to be summed, and edges."""
    members = stored(classes.join(groups, F.xxhash64("class") == F.col("h")).select("class", "first", "copies", "size", "pivots"), "members")
    wanted = members.select(F.col("first").alias("_first")).distinct()
    near = texts.join(F.broadcast(wanted) if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else wanted, F.col("_id").eqNullSafe(F.col("_first")), "left_semi")
    sets = near.select(word_hashes(F.col("_text")).alias("_words")).mapInArrow(lean(_grams_of(rules)), "class binary, grams binary, sign binary")
    # sizes that can reach the threshold together are of the same level or of neighbouring ones
    level = F.floor(F.log(F.col("size").cast("double")) / math.log((1 + 1e-6) / rules.threshold)).cast("int")
    each = members.select("class", level.alias("level"), "size", F.explode("pivots").alias("pivot"))

    def blocks(*keys: str) -> DataFrame:
        by_bytes, by_count = F.ceil(F.sum(F.col("size") * 8) / rules.block_bytes), F.ceil(F.count(F.lit(1)) / rules.block)
        return each.groupBy(*keys).agg(F.greatest(by_bytes, by_count).cast("int").alias("blocks"))

    groups_ = blocks("pivot").select("pivot", (F.col("blocks") > 1).alias("large"))
    placed = each.join(groups_, "pivot").join(blocks("pivot", "level"), ["pivot", "level"])
    sub = F.pmod(F.xxhash64("class", F.lit(rules.seed)), F.col("blocks")).cast("int")
    placed = placed.select("class", "pivot", "large", "level", sub.alias("sub"))
    filled = members.select("class", "copies", "pivots").join(sets.dropDuplicates(["class"]), "class").join(placed, "class")
    filled = stored(filled.select("pivot", "large", "level", "sub", "class", "copies", "pivots", "grams", "sign"), "filled")
    small = filled.filter("NOT large").drop("large", "level", "sub").groupBy("pivot").applyInArrow(_compared(rules), LINKS)
    large = filled.filter("large").drop("large")
    folder = scratch_dir(texts.sparkSession, "blocks")
    keys = ["pivot", "level", "sub"]
    files = large.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lean(_block_files(folder)), "pivot long, level int, sub int, path string, at long, n long")
    places = stored(files, "places").select("pivot", "level", "sub", F.struct("path", "at", "n").alias("place"))
    with_ = places.select("pivot", F.col("level").alias("level_"), F.col("sub").alias("sub_"), F.col("place").alias("place_"))
    met = places.join(with_, "pivot").filter((F.abs(F.col("level") - F.col("level_")) <= 1) & (F.struct("level", "sub") <= F.struct(F.col("level_").alias("level"), F.col("sub_").alias("sub"))))
    turned = F.pmod(F.xxhash64("pivot", "level", "sub", "level_", "sub_"), F.lit(2)) == 0  # either block may hold the pair: units are even
    units = met.select("pivot", F.when(turned, F.col("place")).otherwise(F.col("place_")).alias("own"), F.when(turned, F.col("place_")).otherwise(F.col("place")).alias("other"))
    units = stored(units.groupBy("pivot", "own").agg(F.collect_list("other").alias("others")), "units")
    n = units.count()
    spread = units.repartition(range_count(units.sparkSession, n, 4, 1)) if n else units
    compared = small.unionByName(spread.mapInArrow(lean(_met(rules, folder)), LINKS)) if n else small
    return stored(compared, "links")
