"""Properties of the pure parts, on generated inputs."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sitlake.llm.common import words_of
from sitlake.llm.decontaminate import hits, prefixes, without_spans
from sitlake.llm.jaccard_join import shingles
from sitlake.llm.license_scan import Detection, resolve
from sitlake.llm.line_dedup import line_keys
from sitlake.llm.queries import tokenizer_path
from sitlake.llm.simple8b import decode, encode
from sitlake.llm import tokens
from sitlake.llm.tokens import ByteCounts, Memo, WordIds
from sitlake.llm.warc import capture_key, surt

from . import brute

TEXT = st.text(alphabet=st.one_of(st.sampled_from("aAbB zé'.,-\n\t 09İΣßﬁ<|>🙂\x1c "), st.characters(blacklist_categories=("Cs",))), max_size=60)


@given(st.lists(st.integers(0, (1 << 64) - 1) | st.integers(0, 70_000), max_size=1500))
@settings(deadline=None, max_examples=60)
def test_simple8b(values):
    v = np.array(values, np.uint64)
    assert (decode(*encode(v)) == v).all()


#: Texts for tokenizers: contractions, marks that compose, white space of all kinds, special strings, several scripts.
HOSTILE = st.lists(
    st.text(alphabet=st.one_of(st.sampled_from("aAsSjJtT'' \n\t  09.,;<|>=-éßΣςİ\u0301\u030c\u0338\u00a0\u3000\u0085\x1c\x00日本カ한Яж—…🙂"), st.sampled_from("az 1"), st.characters(blacklist_categories=("Cs",))), max_size=50)
    | st.sampled_from(["<|endoftext|>", "it's <|startoftext|> I'LL", "", " ", "J\u030c k", "'s'S 're", "a \u00a0 b", "x" * 60 + " " + "y" * 60]) | st.none(),
    max_size=6,
)


@pytest.fixture(scope="module")
def tokenizers():
    return WordIds(tokenizer_path("word_bpe_49k.json")), ByteCounts(tokenizer_path("byte_bpe_50k.json"))


@pytest.mark.parametrize("size", [tokens.SLICE, 8])
def test_pieces_give_the_library_ids(tokenizers, monkeypatch, size):
    words, counts = tokenizers
    monkeypatch.setattr(tokens, "SLICE", size)

    @given(HOSTILE, st.integers(0, 2))
    @settings(deadline=None, max_examples=400)
    def check(texts, skip):
        array = pa.array(texts, pa.string()).slice(skip)
        own = array.to_pylist()
        assert [x.tolist() for x in words(array)] == [words.tokenizer.encode(t or "", add_special_tokens=False).ids for t in own]
        assert counts(array).tolist() == [len(counts.tokenizer.encode(t or "", add_special_tokens=False).ids) for t in own]

    check()


def test_each_character_of_settled_blocks_gives_the_library_ids(tokenizers):
    words, counts = tokenizers
    blocks = [*range(1, 0x600), *range(0x1E00, 0x2100), *range(0x3040, 0x3100), *range(0x4E00, 0x9FB0, 37), *range(0xAC00, 0xD7A4, 53)]
    texts = [f"a{c}b {c}, {c}9 ,{c}{c.upper()}A. Z{c} {c}'s.{c}" for c in map(chr, blocks)]
    array = pa.array(texts)
    assert [x.tolist() for x in words(array)] == [words.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts(array).tolist() == [len(counts.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def test_memo_is_bounded_and_right():
    made = []
    memo = Memo(lambda k: made.append(k) or k.upper(), len, most=20 * tokens.ENTRY)
    for k in range(200):
        keys = [b"%d" % (k % 50), b"often", b"x" * 1000]
        assert memo.many(keys) == [x.upper() for x in keys]
        assert len(memo.new) + len(memo.old) <= 22
    assert made.count(b"often") == 2 and made.count(b"x" * 1000) == 200


@given(TEXT)
@settings(deadline=None, max_examples=200)
def test_words(text):
    assert [w.decode() for w in words_of(text)] == brute.words(text)


@given(TEXT)
@settings(deadline=None, max_examples=200)
def test_line_keys(text):
    lines, keys = line_keys(text, 3)
    assert lines == text.split("\n") and len(keys) == len(lines)
    assert all(k is None or len(k.decode()) >= 3 for k in keys)


@given(st.lists(st.sampled_from("abcd"), max_size=60), st.lists(st.lists(st.sampled_from("abcd"), min_size=1, max_size=6), min_size=1, max_size=6))
@settings(deadline=None, max_examples=200)
def test_prefix_join_finds_every_window(doc, items):
    words = [w.encode() for w in doc]
    grams = {" ".join(i).encode(): [str(k)] for k, i in enumerate(items)}
    rarest = {g: min(range(len(g.split())), key=lambda i: words.count(g.split()[i])) for g in grams}
    spans, _ = hits(words, prefixes({g: (k, len(g.split())) for g, k in rarest.items()}), grams)
    want = {(p, p + len(g.split())) for g in grams for p in range(len(words)) if words[p : p + len(g.split())] == g.split()}
    assert set(spans) == want


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(1, 6), st.integers(1, 3)), max_size=12))
@settings(deadline=None, max_examples=200)
def test_nothing_that_stands_is_held_by_a_higher_priority(found):
    given_ = [Detection(s, s + n, f"l{s}", p, 1.0) for s, n, p in found]
    stand = resolve(given_)
    for d in stand:
        assert not any(o.priority < d.priority and o.start <= d.start and o.end >= d.end for o in stand)
    for d in given_:
        assert any(o.priority <= d.priority and o.start <= d.start and o.end >= d.end for o in stand)


@given(TEXT)
@settings(deadline=None, max_examples=200)
def test_cutting_all_words_leaves_none(text):
    n = len(words_of(text))
    assert not words_of(without_spans(text, [{"start": 0, "end": n}])) if n else without_spans(text, []) == text


@given(st.lists(st.integers(0, 50), max_size=40))
@settings(deadline=None, max_examples=100)
def test_shingles_are_sorted_and_distinct(words):
    g = shingles(np.array(words, np.uint64), 5)
    assert (np.diff(g.astype(object)) > 0).all() and len(g) == len({tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(1, len(words))))})


@given(TEXT, st.integers(-(1 << 63), (1 << 63) - 1), st.integers(-(1 << 63), (1 << 63) - 1))
@settings(deadline=None, max_examples=200)
def test_capture_keys_sort_by_page_within_a_url(url, a, b):
    assert re.fullmatch(r"[\x21-\x7e]+", surt(url))
    assert (capture_key(url, a) < capture_key(url, b)) == (a < b)
