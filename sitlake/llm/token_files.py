"""Token-ID files: documents in ascending order of id, ids in Simple-8b words.

Texts are encoded where they are read, once, and only packed ids move.  The ranges that files cover come
first, from a sort of the keys alone; an encoding task names each row's range, so rows go straight to it.
A task sorts its range, packs it and writes one file of segments to the shared folder.  Each attempt writes
a file of its own name and hands back a manifest row, so a retried task leaves at most a file that no
manifest names.  Starts come from the manifest's sums: one row per file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few_rows, lean, range_count, scratch_dir, shared_fs, ship, stored
from .simple8b import decode, encode
from .tokens import HOLDER, WordIds, kept

MAGIC = b"SIM8B\x00\x01\n"
_HEAD = struct.Struct("<4Q")  # documents, ids, blocks, words of a segment
ENCODED = "range int, doc_id long, hash long, wide boolean, ids binary"
MANIFEST = "path string, part int, n_docs long, n_ids long, n_bytes long, first_id long"


@dataclass(frozen=True)
class TokenRules:
    #: A file of the tokenizers library, on every machine.
    tokenizer: str
    #: Appended to each document.
    end_id: int | None = 2
    #: Ids of a segment, about; a longer document is one segment.
    segment: int = 131_072
    #: Rows of a file at most, about.
    file_rows: int = 65_536


def segment_bytes(ids: list[int | None], lengths: list[int], values: np.ndarray) -> bytes:
    """A segment: counts, ids of documents and whether they are null, lengths, blocks' offsets, words."""
    words, firsts, escaped = encode(values)
    known = np.array([i is not None for i in ids], np.uint8)
    return b"".join(
        [
            _HEAD.pack(len(ids), len(values), len(firsts), len(words)), np.array([i or 0 for i in ids], np.int64).tobytes(), known.tobytes(),
            np.array(lengths, np.uint32).tobytes(), firsts.tobytes(), escaped.astype(np.uint8).tobytes(), words.tobytes(),
        ]
    )


def read_segments(file):
    """(ids of documents, lengths, token ids) of each segment of an open file."""
    if file.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token file")
    while head := file.read(_HEAD.size):
        n, n_ids, n_blocks, n_words = _HEAD.unpack(head)

        def column(kind, count):
            return np.frombuffer(file.read(count * np.dtype(kind).itemsize), kind)

        ids, known, lengths = column(np.int64, n), column(np.uint8, n), column(np.uint32, n)
        firsts, escaped, words = column(np.uint32, n_blocks), column(np.uint8, n_blocks).astype(bool), column(np.uint64, n_words)
        values = decode(words, firsts, escaped)
        if len(values) != n_ids or int(lengths.sum()) != n_ids:
            raise ValueError("a segment's counts disagree")
        yield [int(i) if k else None for i, k in zip(ids, known, strict=True)], lengths, values.astype("<u4")


class Ranges:
    """The ranges of (doc_id, hash) that files cover, by their first keys in order; null ids come first."""

    def __init__(self, firsts: list[tuple[int | None, int]]):
        self.nulls = np.array([h for i, h in firsts if i is None], np.int64)
        self.ids = np.array([i for i, _ in firsts if i is not None], np.int64)
        self.hashes = np.array([h for i, h in firsts if i is not None], np.int64)

    def of(self, ids: pa.Array, hashes: pa.Array) -> pa.Array:
        """The range of each key."""
        known, own, at = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(), hashes.to_numpy()
        lo, hi = np.searchsorted(self.ids, own, "left"), np.searchsorted(self.ids, own, "right")
        out = len(self.nulls) + lo
        for k in np.flatnonzero(known & (lo < hi)).tolist():  # ids at which a range starts
            out[k] += np.searchsorted(self.hashes[lo[k] : hi[k]], at[k], "right")
        out[~known] = np.searchsorted(self.nulls, at[~known], "right")
        return pa.array(np.maximum(out - 1, 0).astype(np.int32))


def ranges(keys: DataFrame, count: int) -> Ranges:
    """About so many even ranges of rows (doc_id, hash); one row per range reaches the driver."""
    dealt = keys.repartitionByRange(max(1, count), *keys.columns)
    firsts = dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct(*keys.columns)).alias("first"))
    return Ranges([tuple(r["first"]) for r in firsts.orderBy("part").collect()])


def _encoder(rules: TokenRules, dealt: Ranges):
    """Rows (range, doc_id, hash, wide, ids): ids are little-endian, of four bytes where wide and else of two."""

    def run(batches):
        tokenize = kept(WordIds, rules.tokenizer)
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                own = tokenize(part.column(2))
                if rules.end_id is not None:
                    own = [np.append(ids, np.uint32(rules.end_id)) for ids in own]
                wide = [bool(len(ids)) and int(ids.max()) > 0xFFFF for ids in own]
                raw = [(ids if w else ids.astype("<u2")).tobytes() for ids, w in zip(own, wide, strict=True)]
                at = dealt.of(part.column(0), part.column(1))
                yield pa.RecordBatch.from_arrays([at, part.column(0), part.column(1), pa.array(wide, pa.bool_()), pa.array(raw, pa.binary())], names=["range", "doc_id", "hash", "wide", "ids"])

    return run


def _writer(folder: str, rules: TokenRules):
    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, root = shared_fs(folder)
        fs.create_dir(root, recursive=True)
        path = f"{root}/part-{part:06d}-{uuid.uuid4().hex[:8]}.s8b"
        ids, lengths, raw, held = [], [], [], 0
        n_docs = n_ids = n_bytes = 0
        first = None
        with fs.open_output_stream(path, compression=None) as out:
            out.write(MAGIC)

            def flush():
                nonlocal n_docs, n_ids, n_bytes
                data = segment_bytes(ids, lengths, np.concatenate(raw))
                out.write(data)
                n_docs, n_ids, n_bytes = n_docs + len(ids), n_ids + sum(lengths), n_bytes + len(data)

            for batch in few_rows(batches):
                for doc_id, wide, own in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                    own = np.frombuffer(own, "<u4" if wide else "<u2").astype("<u4")
                    first = doc_id if not n_docs and not ids else first
                    ids.append(doc_id)
                    lengths.append(len(own))
                    raw.append(own)
                    held += len(own)
                    if held >= rules.segment:
                        flush()
                        ids, lengths, raw, held = [], [], [], 0
            if ids:
                flush()
        if n_docs:
            yield pa.RecordBatch.from_arrays(
                [pa.array([path]), pa.array([part], pa.int32()), *[pa.array([x], pa.int64()) for x in (n_docs, n_ids, n_bytes, first)]],
                names=["path", "part", "n_docs", "n_ids", "n_bytes", "first_id"],
            )
        else:
            fs.delete_file(path)

    return run


def _reader(folder: str):
    def run(batches):
        fs, _ = shared_fs(folder)
        for batch in batches:
            for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(path, compression=None) as file:
                    for ids, lengths, values in read_segments(file):
                        ends = np.cumsum(lengths.astype(np.int64))
                        starts = ends - lengths
                        view = memoryview(values.tobytes())
                        crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids, pa.int64()), pa.array(starts + at), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                        at += int(ends[-1])

    return run


def write_tokens(docs: DataFrame, rules: TokenRules, text: str = "text", doc_id: str = "doc_id", folder: str | None = None) -> tuple[str, DataFrame]:
    """Write the files; returns their folder and the stored manifest, one row per file.

    Null text is empty: its document is the end id alone.  Null ids come first; rows that repeat an id
    (or have none) are in order of a hash of their texts, so they spread over files, and then of their ids.
    A text of any length is cut and encoded in fragments.  An empty table gives no file and an empty manifest;
    other columns of docs, whatever their names, have no effect.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or scratch_dir(spark, "tokens")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    dealt = ranges(rows.select("doc_id", "hash"), range_count(spark, docs.select(doc_id).count(), rules.file_rows))
    ids = rows.mapInArrow(lean(_encoder(rules, dealt), HOLDER), ENCODED)
    files = max(1, len(dealt.nulls) + len(dealt.ids))
    ranged = ids.repartitionById(files, "range").sortWithinPartitions("doc_id", "hash", "ids").select("doc_id", "wide", "ids")
    return folder, stored(ranged.mapInArrow(lean(_writer(folder, rules)), MANIFEST), "manifest")


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) from the files that a manifest names."""
    ship(spark)
    files = manifest.select("part", "path", "n_ids").orderBy("part").collect()  # one row per file
    starts = np.cumsum([0, *[f["n_ids"] for f in files]]).tolist()
    rows = [(f["path"], at) for f, at in zip(files, starts, strict=False)]
    paths = spark.createDataFrame(rows, "path string, start long").repartition(max(1, len(rows)))
    return paths.mapInArrow(lean(_reader(folder)), "doc_id long, start long, n_tokens long, ids_crc32 long")
