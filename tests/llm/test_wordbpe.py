"""Word BPE against the file's own library, and its parts against merging in rank order."""

import hashlib
import unicodedata

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from pressdesk.llm import wordbpe
from pressdesk.llm.queries import QUERIES

FILE = public_tokenizers.path("word_bpe_49k.json")
VOCABULARY = wordbpe.load(FILE)
OTHER = tokenizers.Tokenizer.from_file(FILE)
CODEC = wordbpe.Codec(VOCABULARY)
PIECES = st.sampled_from([
    "the", "river", " ", "  ", "\n", "\x1c", "\x85", "\u200b", "'s", "'LL", "''", "Σ", "İ", "ǅ", "é", "e\u0301", "=\u0338",
    "<|endoftext|>", "<|startoftext|>", "<|", "12", "²½", "日本", "👍", "\U00010d50", "\ua7ce", "\u1c89", "!!", "aaaa", "\x00",
])
SYLLABLES = st.lists(st.sampled_from(["th", "in", "er", "an", "o", "a", "e", "n", "s", "t"]), max_size=14).map("".join)


def expected(text):
    ids = OTHER.encode(text, add_special_tokens=False).ids
    return ids, OTHER.decode(ids, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(PIECES, max_size=25).map("".join), SYLLABLES))
def test_any_text(text):
    ids = CODEC.encode([text])[0]
    assert (ids.tolist(), CODEC.decode(ids).decode()) == expected(text)


def test_every_character():
    many = ("CJK UNIFIED", "HANGUL SYLLABLE", "TANGUT", "EGYPTIAN", "CUNEIFORM")
    chars = [chr(c) for c in range(0x33480) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")
             and not unicodedata.name(chr(c), "").startswith(many)]
    chars += [chr(int(c, 16)) for r in wordbpe.NEWER.split() for c in r.split("-")]
    chars += [chr(c) for a, b, _ in wordbpe.LOWER for c in range(a, b + 1)]
    texts = ["".join(f"a{c}b {c} " for c in chars[i : i + 500]) for i in range(0, len(chars), 500)]
    for text, ids in zip(texts, CODEC.encode(texts)):
        assert ids.tolist() == expected(text)[0]


def test_every_token_and_pairs():
    """Words made of one and of two tokens: many proposals fail here and must be merged."""
    place = {c: b for b, c in enumerate(wordbpe.letters())}
    tokens = [s.decode().removesuffix(wordbpe.END) for n, s in enumerate(VOCABULARY.strings) if n < 49406]
    raw = [bytes(place[c] for c in t).decode("utf-8", "ignore") for t in tokens]
    words = raw + [raw[i] + raw[-i * 7919 % len(raw)] for i in range(len(raw))]
    text = " ".join(words)
    assert CODEC.encode([text])[0].tolist() == expected(text)[0]


@pytest.mark.parametrize("word", ["a" * 50_000, "ab" * 3000, "understandings" * 40, "é" * 999, "x" * 48, "x" * 49])
def test_long_words(word):
    assert CODEC.encode([word])[0].tolist() == expected(word)[0]


def test_unsound_tokens_are_not_proposed():
    """``ab`` takes the letters of ``abc = a + bc`` first: the longest match would be wrong."""
    single = {c: n for n, c in enumerate([x + e for x in wordbpe.letters() for e in ("", wordbpe.END)])}
    merges = [("a", "b"), ("b", "c</w>"), ("a", "bc</w>")]
    tokens = single | {a + b: len(single) + k for k, (a, b) in enumerate(merges)}
    codec = wordbpe.Codec(wordbpe.Vocabulary(tokens, merges, {}))
    assert codec.encode(["abc"])[0].tolist() == [tokens["ab"], tokens["c</w>"]]
    with pytest.raises(ValueError):
        wordbpe.Vocabulary(tokens, merges[1:][::-1] + merges[:1], {})


def test_forgetting(monkeypatch):
    monkeypatch.setattr(wordbpe, "MEMO", 300)
    monkeypatch.setattr(wordbpe, "SLOTS", 4)
    codec = wordbpe.Codec(VOCABULARY)
    for text in ["the river runs past seven mills", "the river", "it meets the sea", "the " * 50 + "river"]:
        assert codec.encode([text])[0].tolist() == expected(text)[0]


def test_odd_rows(odd, none):
    wanted = []
    for r in odd.collect():
        ids, decoded = expected(r.text or "")
        wanted.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                       hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(tuple, wordbpe.round_trip(odd, VOCABULARY).collect()), key=repr) == sorted(wanted, key=repr)
    assert wordbpe.round_trip(none, VOCABULARY).count() == 0


def test_encode_then_decode(odd, spark):
    some = odd.filter("length(text) < 1000 or text is null")
    decoded = wordbpe.decode(wordbpe.encode(some, VOCABULARY), VOCABULARY)
    assert sorted(map(tuple, decoded.collect()), key=repr) == sorted(
        ((r.doc_id, expected(r.text or "")[1]) for r in some.collect()), key=repr
    )
    rows = spark.createDataFrame([(1, [320, -5, None, 10**6, 343]), (2, None)], "doc_id bigint, ids array<int>")
    assert dict(map(tuple, wordbpe.decode(rows, VOCABULARY).collect())) == {1: "a</w> x</w>", 2: ""}


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op11_word_bpe"](spark, sf_dir).collect():
        ids, decoded = expected(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(decoded.encode()).hexdigest())
