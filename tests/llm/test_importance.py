"""Importance resampling against counting every feature of every text, on odd rows and tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from pressdesk.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def buckets(text):
    w = WORD.findall((text or "").translate(UPPER))
    found = w + [f"{a} {b}" for a, b in zip(w, w[1:])]
    return len(w), [zlib.crc32(f.encode()) % 10_000 for f in found]


def plain(rows, target):
    docs = [(i, *buckets(t)) for i, t in rows]
    s = Counter(b for _, _, f in docs for b in f)
    t = Counter(b for text in target for b in buckets(text)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in s}
    out = []
    for i, n, f in docs:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None, n])
    may = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(may[: 25 * len(may) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=repr)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "x", "x") for i, t in rows],
                                 "doc_id bigint, text string, line string, bucket string, `a.b` string").repartition(3)


def result(spark, rows, target):
    found = importance.resample(docs(spark, rows), docs(spark, [(1, t) for t in target]))
    return sorted(map(tuple, found.collect()), key=repr)


TEXTS = [
    "The river\nruns past\n\n  seven\tmills. " * 4, "the RIVER runs Past seven mills\n" * 5, "a\nb\nc\n" * 9,
    "Ünïcode wörter\r\nÜber alles 日本 ok\x00no " * 6, "12 34\n5a6 ### \n" * 8, "one\x85two\u2028three " * 9,
]


@pytest.mark.parametrize("portion, memo", [(1 << 22, 1 << 15), (200, 3)])
def test_against_plain_counting(spark, monkeypatch, portion, memo):
    monkeypatch.setattr(importance, "PORTION", portion)
    monkeypatch.setattr(importance, "MEMO", memo)
    rows = [(i, TEXTS[i % len(TEXTS)] + " tail" * (i % 7)) for i in range(60)] + [(100, None), (101, ""), (102, "\n \n")]
    rows += [(103, "few words"), (104, " ".join(f"w{k % 997}" for k in range(20_000))), (None, TEXTS[0]), (5, TEXTS[0])]
    target = [TEXTS[1], None, "seven mills\nby the river"]
    assert result(spark, rows, target) == plain(rows, target)


def test_common_line_counts_with_its_occurrences(spark):
    """Features of one line on all documents, times 40, with those of each one's own line and the pairs between."""
    rows = [(i, f"the common line stands here\nown {i}") for i in range(40)]
    counts = importance.corpus_counts(docs(spark, rows))
    assert counts.sum() == 40 * (5 + 4 + 2 + 1 + 1)
    assert counts[zlib.crc32(b"common line") % 10_000] >= 40 and counts[zlib.crc32(b"here own") % 10_000] >= 40


def test_ties_and_repeated_rows(spark):
    rows = [(7, TEXTS[0])] * 30 + [(8, TEXTS[1])] * 10
    found = importance.resample(docs(spark, rows), docs(spark, [])).collect()
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, 11))
    best = max(r.score for r in found)
    assert all(r.score == best for r in found if r["rank"])


def test_empty_tables(spark):
    assert result(spark, [], ["x"]) == []
    rows = [(i, TEXTS[0]) for i in range(3)]
    assert result(spark, rows, []) == plain(rows, [])


def test_numbers_follow_the_order(spark):
    rows = spark.range(1000).selectExpr("id", "id % 7 as v")
    places = {r.id: r.place for r in importance.numbered(rows, "v", "id").collect()}
    assert [i for i, _ in sorted(places.items(), key=lambda x: x[1])] == sorted(range(1000), key=lambda i: (i % 7, i))
    assert sorted(places.values()) == list(range(1, 1001))
