"""Public tokenizers in Python workers: whole batches of bytes are cut at once, distinct pieces encoded once.

A text is cut at places where the tokenizer's own rules always cut, so the pieces' ids, joined, are the
text's ids.  Cutting is arithmetic on the bytes of many texts; a batch's distinct pieces are looked up in
a memo of a bounded size in bytes, and what it lacks is encoded by the library.  Chunks with anything but
plain ASCII go to the library whole, as do texts with special strings.
"""

from __future__ import annotations

import codecs
import os.path
import re
import struct
import sys
from array import array
from collections.abc import Callable, Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import held

#: Bytes of text that are cut at once, about; a longer text is cut in fragments.
SLICE = 1 << 21
#: Bytes of a memo's two generations together, and the longest piece that enters it.
MEMO_BYTES, MEMO_PIECE = 56 << 20, 256

#: Places of a memo's table of marks, a byte each.
MARKS = 1 << 21
#: Of an entry beside its key and value: their heads and its place in the table.
ENTRY = 130

# Kinds of bytes: white space, letters, digits, other ASCII, and what only the library can judge.
_SPACE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[list(b" \t\n\x0b\x0c\r")] = _SPACE
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and c != 39]] = _OTHER  # an apostrophe may start a contraction
_BLANKS = b" \t\n\x0b\x0c\r"
_KINDS, _LOWER = _KIND.tobytes(), bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: A run of non-space with the one space before it, or space as the byte-level rule cuts it.
_BYTE_LEVEL = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Latin but the dotted capital I, whose lower case is a letter and a mark, Greek but the sigma that has a final form,
#: Cyrillic, kana, ideographs, Hangul syllables.
_LETTERS = "A-Za-z\u00c0-\u012f\u0131-\u024f\u0386-\u03a1\u03a4-\u03ce\u0400-\u0481\u048a-\u0523\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_SETTLED = re.compile(f"[{_LETTERS}]+")
#: Settled letters beside digits and other printed ASCII but the apostrophe, and how the word rule cuts them.
_MIXED = re.compile(f"[{_LETTERS}0-9!-&(-~]+")
_RUNS = re.compile(f"[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")
#: Bytes that do not show themselves stand at 256 and after it, in order.
_HIDDEN = [*range(33), *range(127, 161), 173]
_SHOWN = "".join(chr(256 + _HIDDEN.index(c)) if c in _HIDDEN else chr(c) for c in range(256))
#: White space of Python's str that is none for the tokenizers' \s.
_ODD_SPACE = re.compile("[\x1c-\x1f]")


def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Memo:
    """Values by key in two generations of a bounded size: a full one becomes the old one, and what is used again moves up.

    A key enters when it is met a second time, as far as a table of marks can tell, so the many that come once
    take no place.
    """

    def __init__(self, make: Callable, value_bytes: Callable, most: int = MEMO_BYTES):
        self.make, self.value_bytes, self.most = make, value_bytes, most // 2
        self.new: dict = {}
        self.old: dict = {}
        self.held = 0
        self.marks, self.marked = bytearray(MARKS), 0

    def many(self, keys: list) -> list:
        found = list(map(self.new.get, keys))
        missing = [i for i, v in enumerate(found) if v is None]
        make, marks = self.make, self.marks
        for i, value in zip(missing, list(map(self.old.get, map(keys.__getitem__, missing))), strict=True):
            key = keys[i]
            if value is None:
                found[i] = value = make(key)
                mark = hash(key) % MARKS
                if not marks[mark]:
                    marks[mark] = 1
                    self.marked += 1
                    continue
            found[i] = value
            if len(key) <= MEMO_PIECE:
                if self.held > self.most:
                    self.old, self.new, self.held = self.new, {}, 0
                self.new[key] = value
                self.held += len(key) + self.value_bytes(value) + ENTRY
        if self.marked > MARKS // 2:
            marks[:], self.marked = bytes(MARKS), 0
        return found


def fragments(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, edges, rows) of about SLICE bytes each: fragment k is bytes[edges[k]:edges[k+1]] of text rows[k].

    A text is cut only before a run of white space; null texts have no fragment.
    """
    texts = texts.cast(pa.string())
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    whole = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    valid = texts.is_valid().to_numpy(zero_copy_only=False)
    starts, rows = [], []

    def cut(end: int):
        edges = np.array([*starts, end], np.int64)
        return whole[edges[0] : end], edges - edges[0], np.array(rows, np.int64)

    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if starts and (b - starts[0] > SLICE or not valid[row]):
            yield cut(a)
            starts, rows = [], []
        while valid[row] and b - a > 2 * SLICE:
            space = _KIND[whole[a + SLICE - 1 : b]] == _SPACE  # from the last byte of this fragment on
            at = np.flatnonzero(space[1:] & ~space[:-1])
            if not len(at):
                break
            starts, rows = [a], [row]
            a += SLICE + int(at[0])
            yield cut(a)
            starts, rows = [], []
        if valid[row] and b > a:
            starts.append(a)
            rows.append(row)
    if starts:
        yield cut(int(offsets[-1]))


def pieces(data: np.ndarray, edges: np.ndarray, byte_level: bool) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(pieces of fragments, the first piece of each fragment and their number).

    Words: letters, single digits or other characters in a row, without white space and lower-cased.  Byte
    level: letters, digits or others in a row with the one space before them, and runs of white space.
    Odd bytes stay with both neighbours, as the library alone can tell where to cut there.
    """
    n, raw = len(data), data.tobytes()
    kind = np.frombuffer(raw.translate(_KINDS), np.uint8)
    first = np.zeros(n, bool)
    first[edges[:-1]] = True
    before = np.empty(n, np.uint8)  # the kind of the byte before, white space at the start
    before[0], before[1:] = _SPACE, kind[:-1]
    before[first] = _SPACE
    space = kind == _SPACE
    turn = (kind != before) | (False if byte_level else kind == _DIGIT)
    glued = (kind == _ODD) & (before != _SPACE) | (before == _ODD)
    begins = turn & ~glued & ~space
    if byte_level:
        blank = np.zeros(n, bool)  # after one blank of the same fragment
        blank[1:] = data[:-1] == 32
        begins &= ~blank | first
        last = np.zeros(n, bool)  # the last of a run of white space before a word
        last[:-1] = ~space[1:] & ~first[1:]
        begins |= space & (turn | first | last)
        kept, places = np.frombuffer(raw, np.uint8), np.flatnonzero(begins)
        ends = places
    else:
        places = np.flatnonzero(begins)
        spaces = np.cumsum(space, dtype=np.int32)  # bytes that go, up to each
        kept = np.frombuffer(bytearray(raw.translate(_LOWER, _BLANKS)), np.uint8)
        at = np.flatnonzero((kind[1:] == _ODD) & (kind[:-1] == _LETTER) & ~first[1:])  # a mark may compose with this letter: its case stays
        kept[at - spaces[at]] = data[at]
        ends = places - spaces[places]
    ends = np.append(ends, len(kept)).astype(np.int32)
    found = pa.BinaryArray.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(ends), pa.py_buffer(kept)])
    return found.dictionary_encode(), np.searchsorted(places, edges)


def plain(text: str) -> bool:
    """Whether a piece holds no byte of the odd kind."""
    return text.isascii() and "'" not in text and text.isprintable()


def letters(text: str) -> bool:
    """Whether a text is letters alone, of blocks that have been settled for long, whose lower case needs no context."""
    return _SETTLED.fullmatch(text) is not None and text.isalpha()


def settled_runs(text: str) -> list[str] | None:
    """A piece cut by the word rule, if it is all settled letters and printed ASCII without an apostrophe."""
    if _MIXED.fullmatch(text) is None or not is_normalized("NFC", text):
        return None
    if text.isalpha():
        return [text]
    runs = _RUNS.findall(text)
    return runs if all(r.isalpha() or r.isascii() for r in runs) else None  # there are signs among the letters' blocks


def shown(piece: bytes) -> str:
    """Bytes as the characters that stand for them in byte-level vocabularies."""
    return codecs.charmap_decode(piece, "strict", _SHOWN)[0]


def has_any(texts: pa.Array, strings: list[str]) -> np.ndarray:
    """Which texts hold one of some strings; their common start is looked for in all bytes first."""
    out = np.zeros(len(texts), bool)
    texts = texts.cast(pa.string())
    start, buffer = os.path.commonprefix(strings).encode(), texts.buffers()[2]
    if not strings or buffer is None or start not in buffer.to_pybytes():
        return out
    for s in strings:
        out |= pc.match_substring(texts, s).fill_null(False).to_numpy(zero_copy_only=False)
    return out


def odd_space(data: np.ndarray) -> bool:
    """Whether UTF-8 bytes hold white space that is not ASCII."""
    at = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
    if not len(at):
        return False
    full = np.concatenate([data, np.zeros(2, np.uint8)])
    a, b, c = full[at], full[at + 1], full[at + 2]
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    thin = (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F)
    return bool((two | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE2) & thin | (a == 0xE3) & (b == 0x80) & (c == 0x80)).any())


class _Texts:
    """What both kinds of tokenizers share: the library's tokenizer, its special strings and a memo."""

    byte_level: bool

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo = Memo(self.made, len if not self.byte_level else lambda n: 0)

    def cut(self, data: np.ndarray, edges: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
        """(values of distinct pieces, which of them each piece is, the first piece of each fragment and their number)."""
        cut, bounds = pieces(data, edges, self.byte_level)
        return self.memo.many(cut.dictionary.to_numpy(zero_copy_only=False).tolist()), cut.indices.to_numpy(), bounds


class WordIds(_Texts):
    """Ids by a tokenizer that lower-cases and drops white space."""

    byte_level = False

    def made(self, piece: bytes) -> bytes:
        text = piece.decode("utf-8", "surrogatepass")
        if piece.isalpha() or plain(text):
            ids = [t.id for t in self.model.tokenize(text)]
        elif (runs := settled_runs(text)) is not None:
            ids = [t.id for run in runs for t in self.model.tokenize(shown(run.lower().encode()))]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes() if sys.byteorder == "little" else struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; a null text has none."""
        out: list[list[np.ndarray]] = [[] for _ in range(len(texts))]
        whole = has_any(texts, self.special)
        for data, edges, rows in fragments(texts):
            values, which, bounds = self.cut(data, edges)
            flat = np.frombuffer(b"".join(values), "<u4")
            sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
            begins = np.cumsum(sizes) - sizes
            counts = sizes[which]
            ends = np.concatenate([[0], np.cumsum(counts)])
            ids = flat[np.repeat(begins[which] - ends[:-1], counts) + np.arange(ends[-1])]
            at = ends[bounds].tolist()
            for k, row in enumerate(rows.tolist()):
                out[row].append(ids[at[k] : at[k + 1]])
        none = np.zeros(0, "<u4")
        joined = [none if not x else x[0] if len(x) == 1 else np.concatenate(x) for x in out]
        for row in np.flatnonzero(whole).tolist():
            joined[row] = np.array(self.tokenizer.encode(texts[row].as_py(), add_special_tokens=False).ids, "<u4")
        return joined


class ByteCounts(_Texts):
    """Numbers of tokens by a byte-level tokenizer."""

    byte_level = True

    def __init__(self, path: str):
        super().__init__(path)
        self.chunks = Memo(self.made, lambda n: 0, MEMO_BYTES // 4)

    def made(self, piece: bytes | str) -> int:
        if isinstance(piece, bytes):
            text = piece.decode("utf-8", "surrogatepass")
            own = text.removeprefix(" ")
            if own.isalpha() and own.isascii() or plain(own) or letters(own):
                return len(self.model.tokenize(shown(piece)))
            piece = text
        return sum(len(self.model.tokenize(p)) for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(piece))

    def __call__(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; a null text has none."""
        out = np.zeros(len(texts), np.int64)
        whole = has_any(texts, self.special)
        mixed = np.zeros(len(texts), bool)
        for data, edges, rows in fragments(texts):
            values, which, bounds = self.cut(data, edges)
            ends = np.concatenate([[0], np.cumsum(np.array(values, np.int64)[which])])
            np.add.at(out, rows, np.diff(ends[bounds]))
            if odd_space(data):
                for k, row in enumerate(rows.tolist()):
                    mixed[row] |= odd_space(data[edges[k] : edges[k + 1]])
        for row in np.flatnonzero(mixed | whole).tolist():
            text = texts[row].as_py()
            if whole[row] or _ODD_SPACE.search(text):
                out[row] = len(self.tokenizer.encode(text, add_special_tokens=False).ids)
            else:  # white space that is not ASCII: the rule's cuts depend on it
                out[row] = sum(self.chunks.many(_BYTE_LEVEL.findall(text)))
        return out


#: The kind of work that keeps a tokenizer.
HOLDER = "tokenizer"


def kept(kind: type, path: str):
    """One tokenizer of a kind and path for as long as a worker tokenizes."""
    cache = held(HOLDER)
    key = (kind.__name__, path)
    if key not in cache:
        cache.clear()
        cache[key] = kind(path)
    return cache[key]
