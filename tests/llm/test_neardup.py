"""Near-duplicates against a comparison of all pairs."""

import random

import numpy as np
import pytest

from pressdesk.llm import neardup as N


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    width = min(width, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(rows, width):
    sets = [shingles(t, width) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            usable = rows[i][0] is not None and rows[j][0] is not None
            if a and b and usable and 100 * len(a & b) >= 80 * len(a | b):
                label[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    out = []
    for i, (doc_id, _) in enumerate(rows):
        component = None if doc_id is None else least[find(i)]
        out.append((doc_id, len(sets[i]), component, doc_id is None or doc_id == component))
    return sorted(out, key=repr)


def answer(df, width):
    return sorted((tuple(r) for r in N.near_duplicates(df, width).collect()), key=repr)


@pytest.mark.parametrize("width", [2, 5])
def test_odd_rows(odd, width):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert answer(odd, width) == brute(rows, width)


def test_empty(none):
    assert answer(none, 5) == []


def test_diffuse_group(spark):
    """Copies at all distances from one text: many are linked, some only by way of others."""
    random.seed(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(260):
        words = list(base)
        for _ in range(random.randint(0, 14)):
            words[random.randrange(120)] = f"n{random.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"z{random.randrange(400)}" for _ in range(60))) for i in range(100)]
    block, N.BLOCK = N.BLOCK, 16
    try:
        assert answer(spark.createDataFrame(rows, "doc_id bigint, text string"), 2) == brute(rows, 2)
    finally:
        N.BLOCK = block


def test_components_of_a_path(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    assert {r.node: r.label for r in N.components(df).collect()} == {
        **{i: 0 for i in range(41)}, 100: 100, 101: 100
    }


def test_posterior_bounds():
    """A pair at the threshold is dropped with the stated probability, unlike ones nearly always."""
    needed = N.least_matches(0.8, 1e-5)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, (4000, N.VALUES)).astype(np.uint8)

    def other(similarity):
        fresh = rng.integers(0, 256, base.shape).astype(np.uint8)
        return np.where(rng.random(base.shape) < similarity, base, fresh)

    assert len(N.survivors(base, other(0.8), needed)) >= 3998
    assert len(N.survivors(base, other(0.5), needed)) == 0
