"""Line dedup with two Bloom filters: only suspected repeats shuffle for exact confirmation.

1. Map tasks hash their lines' keys and store each distinct hash once.  The hashes are counted, and that
   count gives the number of slices of the hash space, so a slice's filters have the same size at any scale.
   A slice streams its hashes through a once-seen filter; what was there already goes into a twice-seen filter.
2. While all twice-seen filters fit the bound of a broadcast, documents are held against them where they are
   read, and keys that may be twice-seen are grouped by their text: that confirms them exactly and chooses
   the document that keeps them.  Beyond it nothing is broadcast: each task combines its keys to (digest,
   documents, largest id) and sends them to their slice, where the filter lets through the suspects; those are
   confirmed by 128-bit digests.
3. Confirmed keys are applied to whole texts: all by a broadcast within a checked bound; beyond it the hot
   ones by a broadcast, the rest by a join of each document with its own drops.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_CHARS, few_rows, others, ship, stored, whole_row


#: Stands for a null id among digests.
NULL_ID = -(1 << 63)


@dataclass(frozen=True)
class LineRules:
    #: Code points of a key that counts.
    least: int = 20
    #: Documents that must hold a key.
    documents: int = 3
    #: Hashes of a slice, about; the slice's two filters have bits_per_hash each.
    slice_hashes: int = 1 << 21
    bits_per_hash: int = 12
    #: Bytes of all twice-seen filters that may be broadcast.
    filter_bytes: int = 64 << 20
    #: Distinct hashes that a map task holds before it stores or sends them.
    flush: int = 500_000
    #: Confirmed keys that may be broadcast, 24 bytes each; and the share of documents above which a key is hot.
    broadcast_keys: int = 2_000_000
    hot_share: int = 100_000


def line_keys(text: str | None, least: int) -> tuple[list[str], list[bytes | None]]:
    """Lines of a text and their keys as UTF-8; None for keys that are too short to count."""
    lines = (text or "").split("\n")
    keys: list[bytes | None] = []
    for line in lines:
        key = line.strip(SPACE_CHARS)
        keys.append(key.encode("utf-8", "surrogatepass").lower() if len(key) >= least else None)
    return lines, keys


def distinct_keys(text: str | None, least: int) -> set[bytes]:
    return {k for k in line_keys(text, least)[1] if k is not None}


class Bloom:
    """A Bloom filter of four probes over 64-bit hashes, vectorised."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    @classmethod
    def sized(cls, n_bytes: int) -> Bloom:
        return cls(np.zeros(n_bytes, np.uint8))

    def _at(self, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = (hashes >> np.uint64(17)) | np.uint64(1)
        for i in range(4):
            spot = (hashes + np.uint64(i) * step) & self.mask
            yield spot >> np.uint64(3), (np.uint8(1) << (spot & np.uint64(7)).astype(np.uint8))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at, bit in self._at(hashes):
            out &= (self.bits[at] & bit) != 0
        return out

    def add(self, hashes: np.ndarray) -> None:
        for at, bit in self._at(hashes):
            np.bitwise_or.at(self.bits, at, bit)


def _digests(keys: list[bytes]) -> np.ndarray:
    """128-bit digests as rows of two words; the first is the hash that filters see."""
    import xxhash

    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(k) for k in keys]), ">u8").astype(np.uint64).reshape(-1, 2)


def slice_of(hashes: np.ndarray, slices: int) -> np.ndarray:
    """The slice that the high bits of each hash name."""
    return ((hashes >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int32)


def _by_slice(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(slice, places of its items) for the slices that have some."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    named, edges = np.unique(part[order], return_index=True)
    yield from zip(named.tolist(), np.split(order, edges[1:]), strict=True)


def _own_hashes(rules: LineRules):
    """Map side: rows (once, twice, n) of packed hashes, each distinct hash of the task's flush once."""

    def row(seen: dict[bytes, bool]) -> pa.RecordBatch:
        hashes = np.frombuffer(b"".join(seen), ">u8").astype(np.uint64)
        many = np.fromiter(seen.values(), bool, len(seen))
        return pa.RecordBatch.from_arrays([pa.array([hashes[~many].tobytes()], pa.binary()), pa.array([hashes[many].tobytes()], pa.binary()), pa.array([len(seen)], pa.int64())], names=["once", "twice", "n"])

    def run(batches):
        import xxhash

        seen: dict[bytes, bool] = {}
        for batch in few_rows(batches):
            for text in batch.column(0).to_pylist():
                for key in distinct_keys(text, rules.least):
                    h = xxhash.xxh3_128_digest(key)[:8]
                    seen[h] = h in seen
                if len(seen) >= rules.flush:
                    yield row(seen)
                    seen = {}
        if seen:
            yield row(seen)

    return run


def _sent_hashes(slices: int):
    """Rows (slice, once, twice) from stored ones."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                packed: dict[int, list[bytes]] = {}
                for c in range(2):
                    hashes = np.frombuffer(batch.column(c)[row].as_py(), np.uint64)
                    for s, at in _by_slice(slice_of(hashes, slices)):
                        packed.setdefault(s, [b"", b""])[c] = hashes[at].tobytes()
                columns = [pa.array(list(packed), pa.int32()), *[pa.array([x[c] for x in packed.values()], pa.binary()) for c in range(2)]]
                yield pa.RecordBatch.from_arrays(columns, names=["slice", "once", "twice"])

    return run


def _slice_filters(size: int):
    """Reduce side: a stream of hashes through their slice's once-seen filter; gives the twice-seen filters."""

    def run(batches):
        filters: dict[int, tuple[Bloom, Bloom]] = {}
        for batch in few_rows(batches, 16):
            for s, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first, second = filters.setdefault(s, (Bloom.sized(size), Bloom.sized(size)))
                hashes = np.frombuffer(once, np.uint64)  # distinct within a row
                second.add(hashes[first.has(hashes)])
                first.add(hashes)
                hashes = np.frombuffer(twice, np.uint64)
                first.add(hashes)
                second.add(hashes)
        for s, (_, second) in filters.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([second.bits.tobytes()], pa.binary())], names=["slice", "bits"])

    return run


def _suspects(rules: LineRules, filters, slices: int):
    """Rows (doc_id, key): each document's distinct keys that may be in several documents."""

    def run(batches):
        bloom = {s: Bloom(np.frombuffer(b, np.uint8)) for s, b in filters.value.items()}
        for batch in few_rows(batches):
            ids, keys = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = distinct_keys(text, rules.least)
                ids += [doc_id] * len(own)
                keys += own
            at = _digests(keys)[:, 0]
            may = np.zeros(len(at), bool)
            for s, own in _by_slice(slice_of(at, slices)):
                may[own] = bloom[s].has(at[own])
            chosen = np.flatnonzero(may)
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in chosen], pa.int64()), pa.array([keys[i] for i in chosen], pa.binary())], names=["doc_id", "key"])

    return run


_SENT = np.dtype([("h", "<u8"), ("g", "<u8"), ("n", "<i8"), ("keep", "<i8")])


def _sent_keys(rules: LineRules, slices: int):
    """Map side beyond the broadcast: rows (slice, bits null, keys), packed (digest, documents, largest id) of the task's keys."""

    def rows(seen: dict[bytes, list[int]]) -> pa.RecordBatch:
        packed = np.zeros(len(seen), _SENT)
        both = np.frombuffer(b"".join(seen), ">u8").reshape(-1, 2)
        packed["h"], packed["g"] = both[:, 0], both[:, 1]
        packed["n"], packed["keep"] = np.array(list(seen.values()), np.int64).reshape(-1, 2).T
        own = list(_by_slice(slice_of(packed["h"], slices)))
        columns = [pa.array([s for s, _ in own], pa.int32()), pa.nulls(len(own), pa.binary()), pa.array([packed[at].tobytes() for _, at in own], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["slice", "bits", "keys"])

    def run(batches):
        import xxhash

        seen: dict[bytes, list[int]] = {}
        for batch in few_rows(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                doc_id = NULL_ID if doc_id is None else doc_id
                for key in distinct_keys(text, rules.least):
                    own = seen.setdefault(xxhash.xxh3_128_digest(key), [0, doc_id])
                    own[0] += 1
                    own[1] = max(own[1], doc_id)
                if len(seen) >= rules.flush:
                    yield rows(seen)
                    seen = {}
        if seen:
            yield rows(seen)

    return run


def _let_through(batches):
    """A slice's filter comes first, then its keys: those that may be twice-seen go on as rows (h, g, n, keep)."""
    blooms: dict[int, Bloom] = {}
    for batch in few_rows(batches, 16):
        for s, bits, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bits is not None:
                blooms[s] = Bloom(np.frombuffer(bits, np.uint8))
                continue
            own = np.frombuffer(keys, _SENT)
            own = own[blooms[s].has(own["h"])]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(own[c]).view(np.int64)) for c in ("h", "g", "n", "keep")], names=["h", "g", "n", "keep"])


def _key_digests(batches):
    for batch in batches:
        at = _digests(batch.column(0).to_pylist()).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1]), batch.column(1), batch.column(2)], names=["h", "g", "n", "keep"])


def _document_digests(rules: LineRules):
    """Rows (doc_id, h, g): the digests of each document's distinct keys; a null id is NULL_ID."""

    def run(batches):
        for batch in few_rows(batches):
            ids, keys = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = distinct_keys(text, rules.least)
                ids += [NULL_ID if doc_id is None else doc_id] * len(own)
                keys += own
            at = _digests(keys).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at[:, 0]), pa.array(at[:, 1])], names=["doc_id", "h", "g"])

    return run


def _applied(rules: LineRules, table, with_drops: bool):
    """Whole texts without the lines that go: by the broadcast table of digests, and by each row's own drops."""

    def run(batches):
        known, lasts = table.value
        for batch in few_rows(batches):
            ids, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            drops = batch.column(3).to_pylist() if with_drops else [None] * len(ids)
            kept, n_lines, n_dropped = [], [], []
            cut = [line_keys(t, rules.least) for t in texts]
            own = [[*{k for k in keys if k is not None}] for _, keys in cut]
            at = _digests([k for ks in own for k in ks])
            where = np.zeros(len(at), np.int64)
            hit = np.zeros(len(at), bool)
            if len(known):
                pairs = at.view(_PAIR).ravel()
                where = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
                hit = known[where] == pairs
            last, k = lasts[where] if len(known) else where, 0
            for doc_id, ks, dropped, (lines, keys) in zip(ids, own, drops, cut, strict=True):
                doc_id = NULL_ID if doc_id is None else doc_id
                out = {key for j, key in enumerate(ks, k) if hit[j] and last[j] != doc_id}
                if dropped:
                    named = {(x["h"], x["g"]) for x in dropped}
                    out |= {key for key, pair in zip(ks, at[k : k + len(ks)].view(np.int64).tolist(), strict=True) if tuple(pair) in named}
                k += len(ks)
                left = [x for x, key in zip(lines, keys, strict=True) if key not in out] if out else lines
                kept.append("\n".join(left))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], names=["_row", *RESULTS])

    return run


RESULTS = ("n_lines", "n_dropped", "kept_text")
_PAIR = np.dtype([("h", "<u8"), ("g", "<u8")])


def _table(keys: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted digests and the ids that keep them, of a bounded number of confirmed keys."""
    found = keys.select("h", "g", "keep").toArrow()
    pairs = np.zeros(found.num_rows, _PAIR)
    pairs["h"], pairs["g"] = (found.column(c).to_numpy().view(np.uint64) for c in ("h", "g"))
    order = np.argsort(pairs, order=("h", "g"))
    return pairs[order], found.column("keep").fill_null(NULL_ID).to_numpy()[order]


def confirmed_keys(texts: DataFrame, rules: LineRules) -> DataFrame:
    """Stored rows (h, g, n, keep): the digests of keys of enough documents, their number, and the largest id."""
    spark = texts.sparkSession
    hashes = stored(texts.select("text").mapInArrow(_own_hashes(rules), "once binary, twice binary, n long"), "hashes")
    n = hashes.agg(F.sum("n")).first()[0] or 0
    slices = max(1, -(-n // rules.slice_hashes))
    size = 1 << max(6, (int(n / slices * rules.bits_per_hash / 8) - 1).bit_length())
    sent = hashes.select("once", "twice").mapInArrow(_sent_hashes(slices), "slice int, once binary, twice binary")
    filters = sent.repartitionById(slices, "slice").mapInArrow(_slice_filters(size), "slice int, bits binary")
    if slices * size <= rules.filter_bytes:
        shared = spark.sparkContext.broadcast({r["slice"]: bytes(r["bits"]) for r in filters.collect()})  # at most filter_bytes
        suspects = texts.mapInArrow(_suspects(rules, shared, slices), "doc_id long, key binary")
        found = suspects.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep")).filter(F.col("n") >= rules.documents)
        return stored(found.mapInArrow(_key_digests, "h long, g long, n long, keep long"), "lines")
    filters = stored(filters, "filters").select("slice", "bits", F.lit(None).cast("binary").alias("keys"))
    keys = texts.mapInArrow(_sent_keys(rules, slices), "slice int, bits binary, keys binary")
    dealt = filters.unionAll(keys).repartitionById(slices, "slice").sortWithinPartitions(F.col("bits").isNull())
    suspects = dealt.mapInArrow(_let_through, "h long, g long, n long, keep long")
    found = suspects.groupBy("h", "g").agg(F.sum("n").alias("n"), F.max("keep").alias("keep"))
    return stored(found.filter(F.col("n") >= rules.documents), "lines")


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rules: LineRules = LineRules(), columns: list[str] | None = None) -> DataFrame:
    """docs (or the named columns) with n_lines, n_dropped and kept_text.

    Keys found in at least ``documents`` rows lose all their lines but in the rows with the largest id.
    Null text: one empty line; an empty one likewise.  Null ids are below all others and equal to each other.
    Rows that repeat an id each count as a document, and all keep the lines if that id is the largest.  A text
    of any length is read whole; its distinct keys are held by one task at a time.  An empty table gives an
    empty one; other columns stay whatever their names, those named like results (in any case) are replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    keep = others(docs if columns is None else columns, RESULTS)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    confirmed = confirmed_keys(texts, rules)
    rows = docs.select(whole_row(keep), F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["_row"], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.StringType())])
    few = confirmed.limit(rules.broadcast_keys + 1).count() <= rules.broadcast_keys
    often = confirmed
    if not few:  # at most hot_share keys are in so many documents, or a few times that with long documents
        most = max(256, docs.select(doc_id).count() // rules.hot_share)
        often = confirmed.filter(F.col("n") > most).orderBy(F.col("n").desc(), "h", "g").limit(rules.broadcast_keys)
        often = stored(often, "often")
        seldom = confirmed.join(F.broadcast(often.select("h", "g")), ["h", "g"], "left_anti") if rules.broadcast_keys else confirmed
        own = texts.mapInArrow(_document_digests(rules), "doc_id long, h long, g long")
        last = F.coalesce("keep", F.lit(NULL_ID))
        drops = own.join(seldom, ["h", "g"]).filter(F.col("doc_id") != last).groupBy("doc_id").agg(F.collect_set(F.struct("h", "g")).alias("drops"))
        drops = drops.withColumnRenamed("doc_id", "at")
        rows = rows.join(drops, F.coalesce("id", F.lit(NULL_ID)) == F.col("at"), "left").select("_row", "id", "text", "drops")
    table = spark.sparkContext.broadcast(_table(often))
    return rows.mapInArrow(_applied(rules, table, not few), schema).select("_row.*", *RESULTS)
