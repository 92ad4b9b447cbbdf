"""License scans by ordered signature rules.

A text's words, lower-cased and joined by single spaces, pass one automaton of all rules' keywords; only
rules whose keyword is there try their pattern.  Detections are resolved by priority: one that lies
within a detection of a higher priority, or within a longer one of its own, is suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Sequence
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import few_rows, others, ship, whole_row, words_of
from .license_rules import HINT, PHRASES, RULES, Rule


class Detection(NamedTuple):
    #: Words from 0, end exclusive.
    start: int
    end: int
    label: str
    priority: int
    score: float


class Matcher:
    """Compiled rules and the automaton of their keywords."""

    def __init__(self, rules: Sequence[Rule] = RULES):
        import ahocorasick

        self.by_keyword: dict[str, list[tuple[int, Rule, re.Pattern]]] = {}
        for k, rule in enumerate(rules):
            self.by_keyword.setdefault(rule.keyword, []).append((k, rule, re.compile(rf"(?<![^ ])(?:{rule.pattern})(?![^ ])")))
        self.automaton = ahocorasick.Automaton()
        for word in {*self.by_keyword, *PHRASES}:
            self.automaton.add_word(word, word)
        self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], list[Detection]]:
        """(places of base phrases with their labels, detections that stand)."""
        joined = b" ".join(words).decode("utf-8", "replace")
        present = {k for _, k in self.automaton.iter(joined)}
        if not present:
            return [], []
        starts = [0, *(m.end() for m in re.finditer(" ", joined))]
        at = {s: i for i, s in enumerate(starts)}
        base = sorted((at[m.start()], label) for phrase, label in PHRASES.items() if phrase in present for m in re.finditer(rf"(?<![^ ]){phrase}(?![^ ])", joined))
        found = [
            (k, Detection(at[m.start()], bisect_right(starts, m.end() - 1), rule.label, rule.priority, rule.score))
            for word in present
            for k, rule, pattern in self.by_keyword.get(word, ())
            for m in pattern.finditer(joined)
        ]
        return base, resolve([d for _, d in sorted(found, key=lambda x: (x[0], x[1].start))])


def resolve(found: list[Detection]) -> list[Detection]:
    """Detections that no earlier level or longer one of their own level holds; of equal ones the first rule's."""
    stand: list[Detection] = []
    for level in sorted({d.priority for d in found}):
        higher = sorted((d.start, d.end) for d in stand)
        firsts, reach, most = [s for s, _ in higher], [], -1
        for _, e in higher:
            most = max(most, e)
            reach.append(most)
        longest = -1
        for d in sorted((d for d in found if d.priority == level), key=lambda d: (d.start, -d.end)):
            k = bisect_right(firsts, d.start)
            if d.end > longest and not (k and reach[k - 1] >= d.end):
                stand.append(d)
                longest = d.end
    return sorted(stand)


@lru_cache(maxsize=1)
def _matcher() -> Matcher:
    return Matcher()


RESULTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")
_TYPES = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<start:long,end:long,label:string,score:double>>"
_DETECTION = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("score", pa.float64())]))


def _scanned():
    def run(batches):
        scan = _matcher().scan
        for batch in few_rows(batches):
            rows = []
            for text in batch.column(1):
                words = words_of(text.as_py())
                base, found = scan(words)
                own = {label for _, label in base}
                named = {d.label for d in found if d.priority < HINT}
                score = max([d.score for d in found] + [0.8] * bool(base), default=0.0)
                rows.append((len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(own)), ",".join(sorted(own | named)), score, [{"start": d.start, "end": d.end, "label": d.label, "score": d.score} for d in found]))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), _DETECTION]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["_row", *RESULTS])

    return run


def license_scan(docs: DataFrame, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """docs (or the named columns) with n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    Base phrases are counted at all their places and never suppressed; labels adds those of the detections
    that stand, hints left out; score is that of the surest detection, 0 for none.  Null and empty texts have
    no words; a text of any length is scanned whole.  Of detections that tie in place and priority the first
    rule's stands; equal rows get equal results; an empty table gives an empty one.  Other columns stay whatever
    their names, those named like results (in any case) are replaced.  One narrow pass: nothing is shuffled,
    and no row waits for another.
    """
    ship(docs.sparkSession)
    keep = others(docs if columns is None else columns, RESULTS)
    rows = docs.select(whole_row(keep), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["_row"], *T._parse_datatype_string(_TYPES).fields])
    return rows.mapInArrow(_scanned(), schema).select("_row.*", *RESULTS)
