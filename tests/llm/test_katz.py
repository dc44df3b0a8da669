"""Scores against the formulas, computed token by token."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressdesk.llm import katz as K


def reference(train, texts, vocabulary):
    tok = lambda t: (t or "").encode().lower().split() + [b""]
    words, pairs = Counter(), Counter()
    for t in train:
        words.update(tok(t))
    n, v = sum(words.values()), len(words)
    least = max(K.DISCOUNTED + 1, math.ceil(vocabulary * n), 1)
    cls = lambda w: w if words[w] >= least else None
    for t in train:
        seen = ["<s>"] + [cls(w) for w in tok(t)]
        pairs.update(zip(seen, seen[1:]))
    times = lambda c: [sum(x == r for x in c.values()) for r in range(1, K.DISCOUNTED + 2)]
    dw, dp = K.discounts(times(words)), K.discounts(times(pairs))
    cut = lambda c, d: c * d[c] if c <= K.DISCOUNTED else c
    classes = {w for w in words if cls(w) is not None}
    shared = n - sum(words[w] for w in classes) + 1
    p1 = {w: words[w] / (n + 1) for w in classes} | {None: shared / (n + 1)}
    seen_mass = sum(cut(words[w], dw) for w in words if w not in classes)
    n1, n2 = times(words)[:2]
    unseen = (shared - seen_mass) / max(1, n1 * (n1 - 1) / (2 * n2 + 2))
    after = {}
    for (h, k), c in pairs.items():
        after.setdefault(h, {})[k] = c

    def given(k, h):
        if h not in after:
            return p1[k]
        events = {x: cut(c, dp) for x, c in after[h].items()}
        total = sum(events.values()) if len(events) == len(p1) else sum(after[h].values()) + 1
        if k in events:
            return events[k] / total
        left = 1 - sum(events.values()) / total
        return left * p1[k] / (1 - sum(p1[x] for x in events))

    for h in [*after, "other"]:
        assert abs(sum(given(k, h) for k in p1) - 1) < 1e-9
    out = []
    for t in texts:
        toks, h, base, score = tok(t), "<s>", 0.0, 0.0
        for w in toks:
            base += math.log10((words[w] + 1) / (n + v + 1))
            k = cls(w)
            inside = 1 if k is not None else (cut(words[w], dw) if words[w] else unseen) / shared
            score += math.log10(given(k, h) * inside)
            h = k
        out.append((len(toks), sum(words[w] > 0 for w in toks), n, base, score))
    return out


def check(spark, rows, monkeypatch, frequent, vocabulary):
    monkeypatch.setattr(K, "FREQUENT", frequent)
    monkeypatch.setattr(K, "VOCABULARY", vocabulary)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    learn = F.col("doc_id") % 7 != 2
    model, words, rare = K.fit(docs.filter(learn))
    got = K.score(docs, F.coalesce(~learn, F.lit(False)), model, words, rare).collect()
    train = [t for i, t in rows if i is not None and i % 7 != 2]
    expected = [(i, *r) for (i, _), r in zip(rows, reference(train, [t for _, t in rows], vocabulary))]
    assert len(got) == len(expected)
    key = lambda r: (repr(r[0]), r[1], round(r[4], 6), round(r[5], 6))
    mine = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    for a, b in zip(mine, sorted(expected, key=key)):
        assert a[:4] == b[:4]
        assert np.allclose(a[4:], b[4:], rtol=1e-9, atol=1e-9)


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(60).collect()
    return [(r.doc_id, r.text) for r in docs]


@pytest.mark.parametrize("frequent, vocabulary", [(1e-6, 5e-5), (1e-3, 2e-3), (3e-4, 3e-4)])
def test_scores(spark, rows, monkeypatch, frequent, vocabulary):
    """With all entries in place, and with most words and bigrams joined."""
    check(spark, rows, monkeypatch, frequent, vocabulary)


def test_odd_rows(spark, odd, monkeypatch):
    rows = [(r.doc_id, r.text) for r in odd.collect() if len(r.text or "") < 1000]
    check(spark, rows, monkeypatch, 1e-6, 5e-5)


def test_nothing_to_learn_from(spark, none):
    model, words, rare = K.fit(none)
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    got = K.score(docs, F.lit(False), model, words, rare).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(3, 0, 0, 0, 0), (1, 0, 0, 0, 0)]
    assert K.score(none, F.lit(False), model, words, rare).count() == 0


def test_discounts():
    assert np.allclose(K.discounts([0] * 6)[1:], [(r - 0.5) / r for r in range(1, 6)])
    katz = K.discounts([1000, 400, 220, 140, 100, 75])
    common = 6 * 75 / 1000
    assert np.isclose(katz[1], (2 * 400 / 1000 - common) / (1 - common))


def whole(train, texts):
    """Scores where every word is itself in every bigram."""
    tok = lambda t: (t or "").encode().lower().split() + [b""]
    words, after = Counter(), {}
    for t in train:
        words.update(tok(t))
        for h, w in zip([None, *tok(t)], tok(t)):
            after.setdefault(h, Counter())[w] += 1
    pairs = [c for seen in after.values() for c in seen.values()]
    times = lambda cs: [sum(c == r for c in cs) for r in range(1, K.DISCOUNTED + 2)]
    dw, dp = K.discounts(times(words.values())), K.discounts(times(pairs))
    cut = lambda c, d: c * d[c] if c <= K.DISCOUNTED else c
    n = sum(words.values())
    p1 = {w: cut(c, dw) / (n + 1) for w, c in words.items()}
    n1, n2 = times(words.values())[:2]
    kinds = max(1, n1 * (n1 - 1) / (2 * n2 + 2))
    unseen = (1 - sum(p1.values())) / kinds
    weight = {None: 1.0}
    for h, seen in after.items():
        left = 1 - sum(cut(c, dp) for c in seen.values()) / (seen.total() + 1)
        weight[h] = left / (1 - sum(p1[w] for w in seen))

    def given(w, h):
        if w in after.get(h, ()):
            return cut(after[h][w], dp) / (after[h].total() + 1)
        return weight.get(h, 1.0) * p1.get(w, unseen)

    for h in [*list(after)[:20], "other"]:
        assert abs(sum(given(w, h) for w in p1) + kinds * given("unseen", h) - 1) < 1e-9
    return [sum(math.log10(given(w, h)) for h, w in zip([None, *tok(t)], tok(t))) for t in texts]


@pytest.mark.parametrize("frequent", [1e-6, 1e-3])
def test_every_word_has_bigrams(spark, rows, monkeypatch, frequent):
    monkeypatch.setattr(K, "FREQUENT", frequent)
    learn = F.col("doc_id") % 7 != 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in K.score(docs, F.lit(False), *K.fit(docs.filter(learn))).collect()}
    expected = whole([t for i, t in rows if i % 7 != 2], [t for _, t in rows])
    assert np.allclose([got[i] for i, _ in rows], expected, rtol=1e-9, atol=1e-9)


def test_rare_words_know_the_word_before(spark):
    """Far below any share of the tokens that bounds a vocabulary, a seen bigram beats its reverse."""
    rows = [(i, f"left{i} right{i} " + "and so on it went " * 2000) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "left7 right7"), (2, "right7 left7")], "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in K.score(asked, F.lit(True), *K.fit(docs)).collect()}
    assert got[1] > got[2] + 1


@pytest.mark.parametrize("frequent", [1e-6, 1e-3, 1.0])
def test_training_and_scoring_at_once(spark, rows, odd, monkeypatch, frequent):
    """The same scores, whichever words have numbers."""
    monkeypatch.setattr(K, "FREQUENT", frequent)
    some = rows + [(r.doc_id, r.text) for r in odd.collect() if len(r.text or "") < 1000]
    docs = spark.createDataFrame(some, "doc_id bigint, text string").repartition(3, "doc_id")
    got = K.fit_and_score(docs, F.col("doc_id") % 7 == 2).collect()
    train = [t or "" for i, t in some if i is not None and i % 7 != 2]
    expected = [(i, i is not None and i % 7 == 2, *r[:4], s) for (i, _), r, s in zip(
        some, reference(train, [t for _, t in some], 1e-9), whole(train, [t or "" for _, t in some]))]
    key = lambda r: (repr(r[0]), r[2], round(r[5], 6), round(r[6], 6))
    assert len(got) == len(expected)
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(expected, key=key)):
        assert a[:5] == b[:5]
        assert np.allclose(a[5:], b[5:], rtol=1e-9, atol=1e-9)


def test_nothing_to_learn_from_at_once(spark, none):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    got = K.fit_and_score(docs, F.lit(True)).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(3, 0, 0, 0, 0), (1, 0, 0, 0, 0)]
    assert K.fit_and_score(none, F.lit(False)).count() == 0


def test_pairs_travel_packed():
    """Numbers of any sign and size come back, and most pairs of frequent words take a few bytes."""
    some = np.array([0, -1, 5, 2**63 - 1, -(2**63)])
    assert (K._opened(K._squeezed(some), 5) == some).all()
    rng = np.random.default_rng(0)
    keys = np.sort(rng.integers(0, 60_000, 50_000) ** 2)
    assert len(K._squeezed(keys >> 16)) + len(K._squeezed(keys & 0xFFFF)) < 5 * len(keys)


def test_a_chunk_states_its_pairs_in_a_fixed_order(monkeypatch):
    """Each distinct pair once, in the part of its word before, or in few parts if that word is very frequent."""
    rng = np.random.default_rng(1)
    words = K.mix(np.arange(1, 301, dtype=np.uint64))
    tokens, sizes = words[(300 * rng.random(5000) ** 3).astype(int)], np.array([1000, 1, 3999])
    often = np.sort(words[:40].view(np.int64))
    m = {"often": often, "parts": 64, "spread": np.ones(42, np.int64)}
    before, own = K._bigrams(tokens, sizes, None)
    _, found = K._pairs(tokens, sizes, m)
    names = np.append(often, K.START.astype(np.int64)).view(np.uint64)
    seen = set()
    for kind, (at, a, b, part, which) in enumerate(found):
        left, right = (a if kind & 2 else names[a]).view(np.uint64), (b if kind & 1 else names[b]).view(np.uint64)
        assert (left[which] == before[at]).all() and (right[which] == own[at]).all()
        assert (np.diff(part) >= 0).all() and len(set(zip(left, right))) == len(left)
        for word in set(left):
            assert len(set(part[left == word])) == 1
        seen.update(at.tolist())
    assert len(seen) == 5000
    m["spread"][:40] = 8
    _, found = K._pairs(tokens, sizes, m)
    _, a, _, part, _ = found[0]
    assert all(1 < len(set(part[a == word])) <= 8 for word in set(a) if (a == word).sum() > 30 and word < 40)


def test_chunks_of_many_pieces(spark, rows, monkeypatch):
    """Scores don't depend on where chunks and their pieces end."""
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    whole_chunks = {r.doc_id: r.score for r in K.fit_and_score(docs, F.col("doc_id") % 7 == 2).collect()}
    monkeypatch.setattr(K, "_PIECE", 50)
    monkeypatch.setattr(K, "_GROUP", 100)
    monkeypatch.setattr(K, "_SHARE", 10)
    found = {r.doc_id: r.score for r in K.fit_and_score(docs, F.col("doc_id") % 7 == 2).collect()}
    assert found.keys() == whole_chunks.keys()
    assert all(np.isclose(found[i], whole_chunks[i], rtol=1e-12) for i in found)
