"""Benchmark decontamination by a prefix-filtered set join.

Items are cut into windows of item words, the shingles.  Words are ordered by their count over all documents,
and that orders shingles too: a window's necessary prefix, for exact containment, is its rarest word (a
window stands where all its words do, so where its rarest does).  A document's words join those prefixes; the
place of the prefix word in its window and the window's length bound where the window can start and end; what
is left is compared word by word.

Documents are never shuffled, and read twice: once to count the words of all windows, once to be held against
them.  Windows lie in slices of a bounded number of (item, window) rows, so a window of many items is split.
A worker holds one slice at a time: it gathers documents of a bounded size and loads slice after slice.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import few_rows, held, lean, others, scratch_dir, shared_fs, ship, stored, whole_row, with_small, words_of


#: The kind of work that keeps a slice of windows.
SLICE = "slice"


@dataclass(frozen=True)
class LeakRules:
    #: Words of a window; an item with fewer, but not none, is one window.
    window: int = 13
    #: Rows (item, window) of a slice, about 300 bytes each in a worker.
    slice_windows: int = 100_000
    #: Bytes of texts that a worker holds against all slices at a time; a longer text goes alone.
    held_bytes: int = 32 << 20
    #: Words of windows that may be broadcast to count them alone; beyond, all words are counted.
    vocabulary: int = 500_000
    #: A document is contaminated if this times its hit words reach its words.
    hit_factor: int = 20
    #: Whether clean_text, the text without its hits, is wanted; else it is null.
    cut: bool = False


def _windows(rules: LeakRules):
    def run(batches):
        for batch in few_rows(batches):
            ids, grams = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                n = min(rules.window, len(words))
                own = {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()
                ids += [item] * len(own)
                grams += [g.decode("utf-8", "surrogatepass") for g in own]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(grams, pa.string())], names=["item", "gram"])

    return run


def _counts(vocabulary, most: int):
    """Map side of the counts of words over all documents: one row per word and flush."""

    def rows(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "surrogatepass") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    def run(batches):
        known, total = None if vocabulary is None else vocabulary.value, Counter()
        for batch in few_rows(batches):
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                total.update(words if known is None else filter(known.__contains__, words))
            if len(total) > most:
                yield rows(total)
                total = Counter()
        yield rows(total)

    return run


def word_counts(texts: DataFrame, words: DataFrame, rules: LeakRules) -> DataFrame:
    """Rows (word, n): how often stored words stand in all documents, in one pass over them."""
    spark = texts.sparkSession
    vocabulary = None
    if words.limit(rules.vocabulary + 1).count() <= rules.vocabulary:
        vocabulary = spark.sparkContext.broadcast(frozenset(w.encode("utf-8", "surrogatepass") for w in words.toArrow().column(0).to_pylist()))
    counted = texts.mapInArrow(lean(_counts(vocabulary, rules.vocabulary)), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return stored(counted if vocabulary is not None else counted.join(words, "word", "left_semi"), "counts")


def window_slices(texts: DataFrame, benchmark: DataFrame, rules: LeakRules, text: str, item: str) -> list[str]:
    """Folders of slices with rows (gram, item, place of its rarest word, its length in words).

    Windows with a word of no document occur nowhere and are left out.
    """
    spark = texts.sparkSession
    named = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    grams = stored(named.mapInArrow(lean(_windows(rules)), "item string, gram string").distinct(), "windows")
    n = grams.count()
    if not n:
        return []
    places = grams.select("gram").distinct().select("gram", F.posexplode(F.split("gram", " ", -1)).alias("place", "word"))
    counts = word_counts(texts, stored(places.select("word").distinct(), "words"), rules)
    ranked = with_small(places, counts, "word").groupBy("gram").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "place")).alias("least"), F.count(F.lit(1)).cast("int").alias("length"))
    prefixed = grams.join(ranked.filter("least.n > 0").select("gram", F.col("least.place").alias("place"), "length"), "gram")
    slices = -(-n // rules.slice_windows)
    folder = scratch_dir(spark, "slices")
    part = F.pmod(F.xxhash64("gram", "item"), F.lit(slices)).cast("int")
    prefixed.select("gram", "item", "place", "length", part.alias("part")).repartition(slices, "part").write.partitionBy("part").parquet(folder)
    return [f"{folder}/part={k}" for k in range(slices)]


def prefixes(grams: dict[bytes, tuple[int, int]]) -> dict[bytes, list[tuple[int, int]]]:
    """For each window's prefix word: its places in windows and those windows' lengths."""
    out: dict[bytes, set[tuple[int, int]]] = {}
    for gram, (place, length) in grams.items():
        out.setdefault(gram.split(b" ")[place], set()).add((place, length))
    return {w: sorted(places) for w, places in out.items()}


def loaded(folder: str) -> tuple[dict, dict]:
    """(windows with their items, prefixes) of a slice; the worker keeps the last one it has loaded."""
    last = held(SLICE)
    if folder not in last:
        last.clear()
        from pyarrow import fs as pafs
        from pyarrow import parquet

        fs, root = shared_fs(folder)
        grams: dict[bytes, list[str]] = {}
        at: dict[bytes, tuple[int, int]] = {}
        for info in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if not info.path.endswith(".parquet"):
                continue
            rows = parquet.ParquetFile(fs.open_input_file(info.path)).read()
            for gram, item, place, length in zip(*(rows.column(c).to_pylist() for c in ("gram", "item", "place", "length")), strict=True):
                gram = gram.encode("utf-8", "surrogatepass")
                grams.setdefault(gram, []).append(item)
                at[gram] = (place, length)
        last[folder] = grams, prefixes(at)
    return last[folder]


def hits(words: list[bytes], prefix: dict, grams: dict[bytes, list]) -> tuple[list[tuple[int, int]], set]:
    """Verified windows in a document, as (start, end), and their items."""
    n, spans, items = len(words), [], set()
    for p in [i for i, w in enumerate(words) if w in prefix]:
        for k, length in prefix[words[p]]:
            start = p - k
            if start >= 0 and start + length <= n:
                found = grams.get(b" ".join(words[start : start + length]))
                if found is not None:
                    spans.append((start, start + length))
                    items.update(found)
    return spans, items


def without_spans(text: str, spans: list[dict]) -> str:
    """A text without the words of spans and what stands between them."""
    words = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    out, at = [], 0
    for s in spans:
        out.append(text[at : words[s["start"]][0]])
        at = words[s["end"] - 1][1]
    return "".join([*out, text[at:]])


def merged(spans: list[tuple[int, int]]) -> list[dict]:
    """Sorted spans that neither meet nor overlap, over the same words."""
    out: list[dict] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], end)
        else:
            out.append({"start": start, "end": end})
    return out


def _held(batches, most: int) -> Iterator[pa.RecordBatch | pa.Table]:
    """Batches joined to about so many bytes."""
    own: list[pa.RecordBatch] = []
    for batch in few_rows(batches):
        if own and sum(b.nbytes for b in own) + batch.nbytes > most:
            yield pa.Table.from_batches(own).combine_chunks()
            own = []
        own.append(batch)
    if own:
        yield pa.Table.from_batches(own).combine_chunks()


def _joined(slices: list[str], rules: LeakRules):
    """Whole documents (_row, text) against all slices, one after the other."""
    import hashlib

    def run(batches):
        for rows in _held(batches, rules.held_bytes) if len(slices) > 1 else few_rows(batches):
            texts = rows.column(1).to_pylist()
            spans: list[list[tuple[int, int]]] = [[] for _ in texts]
            items: list[set[str]] = [set() for _ in texts]
            n_words = [0] * len(texts)
            for folder in slices or [None]:
                grams, prefix = loaded(folder) if folder else ({}, {})
                for i, text in enumerate(texts):
                    words = words_of(text)
                    n_words[i] = len(words)
                    found, own = hits(words, prefix, grams)
                    spans[i] += found
                    items[i] |= own
            flat = [merged(x) for x in spans]
            n_hit = [sum(s["end"] - s["start"] for s in x) for x in flat]
            named = [sorted(x) for x in items]
            digest = [hashlib.sha256(",".join(x).encode("utf-8", "surrogatepass")).hexdigest() for x in named]
            dirty = [h > 0 and rules.hit_factor * h >= n for h, n in zip(n_hit, n_words, strict=True)]
            clean = [without_spans(t, m) if m else t for t, m in zip(texts, flat, strict=True)] if rules.cut else [None] * len(flat)
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            row = rows.column(0)
            results = [
                row if isinstance(row, pa.Array) else row.combine_chunks(), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in named], pa.int64()),
                pa.array(digest, pa.string()), pa.array(dirty, pa.bool_()), pa.array(flat, span), pa.array(named, pa.list_(pa.string())), pa.array(clean, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(results, names=["_row", *RESULTS])

    return run


RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans", "item_ids", "clean_text")
_RESULT_TYPES = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_spans array<struct<start:int,end:int>>, item_ids array<string>, clean_text string"


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, doc_text: str = "text", item_text: str = "text", item: str = "item_id", rules: LeakRules = LeakRules(), columns: list[str] | None = None
) -> DataFrame:
    """docs (or the named columns) with n_words, n_hit, n_items, items_sha256, contaminated, hit_spans, item_ids, clean_text.

    Null and empty texts have no words and no windows; a text of any length is read whole.  A null item id
    counts as the id ''.  Items that repeat an id count once; equal items all count.  Equally rare words of a
    window tie by the word and its place, which changes no result.  Equal rows get equal results; an empty
    table on either side is no error.  Other columns stay whatever their names; those named like results (in
    any case) are replaced.
    """
    ship(docs.sparkSession)
    keep = others(docs if columns is None else columns, RESULTS)
    rows = docs.select(whole_row(keep), F.col(doc_text).alias("text"))
    slices = window_slices(rows.select("text"), benchmark, rules, item_text, item)
    schema = T.StructType([rows.schema["_row"], *T._parse_datatype_string(_RESULT_TYPES).fields])
    return rows.mapInArrow(lean(_joined(slices, rules), SLICE), schema).select("_row.*", *RESULTS)
