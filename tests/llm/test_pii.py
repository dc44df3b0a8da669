"""Base spans against the patterns as they are written down, in Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from pressdesk.llm import pii

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def holds(kind, value):
    number = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 14 <= len(number) <= 19 and luhn(number)
    return kind == "email" or 10 <= len(number) <= 15


def spans(text):
    found = [(m.start(), rank, m.end(), kind) for rank, (kind, p) in enumerate(PATTERNS)
             for m in re.finditer(p, text or "") if holds(kind, m.group())]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


TEXTS = [
    "mail a.b@c.de or a@b@c.d e@f.g_h@i.j. +49 (30) 1234-5678 x 1.2.3.4.5.6.7.8 4111 1111 1111 1111",
    "é a@b.c, ünï 👍 256.1.1.1 01.002.3.255 +1 (269) 555-3296 4524132264652876", "4111-1111-1111-1111-1 1.2.3", "+1", "@", "",
    None, "1" * 30_000 + " " + "a" * 30_000 + "@x.y" + " 1.1.1.1" * 2000, "a" * 200_000, "+ +1 +12345678901234 5",
    "x_y@z.q_w@e.r", "1.1.1.1@1.1.1.1.", "5500 0000 0000 0004 5500000000000004",
]


@pytest.fixture(scope="module")
def report(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    return {r.doc_id: r for r in pii.report(docs).collect()}


@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_base_spans(report, i):
    expected = spans(TEXTS[i])
    assert report[i].spans == expected
    assert report[i].base_sha256 == hashlib.sha256(expected.encode()).hexdigest()
    kinds = [s.split(":")[0] for s in expected.split(",")]
    assert [report[i][f"n_{k}"] for k, _ in PATTERNS] == [kinds.count(k) for k, _ in PATTERNS]


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in pii.report(docs).collect():
        assert r.base_sha256 == hashlib.sha256(spans(texts[r.doc_id]).encode()).hexdigest()


def test_odd_rows(odd, none):
    expected = sorted(((r.doc_id, spans(r.text)) for r in odd.collect()), key=repr)
    assert sorted(((r.doc_id, r.spans) for r in pii.report(odd).collect()), key=repr) == expected
    assert pii.report(none).count() == 0
    clean = pii.sanitise(odd)
    assert clean.columns == odd.columns
    assert sorted(map(tuple, clean.collect()), key=repr) == sorted(
        (tuple(r[:1]) + (r.text or "",) + tuple(r[2:]) for r in odd.collect()), key=repr
    )


def test_no_python_on_the_path(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for df in (pii.report(docs), pii.sanitise(docs)):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def corpus():
    """An address that one name always stands beside, and that many other words stand beside once."""
    rows = [(i, f"Please ask {w} Quillon about it, write to head@firm.example for {w}ish terms today")
            for i, w in enumerate(["alpha", "bravo", "charlie", "delta", "echo", "foxtrot"])]
    rows += [(100 + i, f"please ask about terms and write for today, item {i}") for i in range(400)]
    return rows + [(900, "Quillon was seen; QUILLON left")]


def test_revealing_terms(spark):
    docs = spark.createDataFrame(corpus(), "doc_id bigint, text string")
    chosen = pii.disclosures(pii.keyed(docs))
    terms = {r.term: r.action for r in chosen.collect()}
    assert set(terms) == {"quillon"}
    both, n, holders, own = 6, 407, 6, 7
    import math

    disclosure = math.log2(both / own * n / holders) / math.log2(n / holders)
    assert terms["quillon"] == ("remove" if disclosure >= pii.REMOVE else "generalise")
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "uillon" not in clean[0] and "[EMAIL]" in clean[0] and "QUILLON" not in clean[900]
    assert clean[105] == corpus()[11][1]


def test_copies_support_nothing(spark):
    rows = [(i, "Please ask Quillon, write to head@firm.example") for i in range(50)]
    rows += [(100 + i, f"please write {i}") for i in range(50)]
    chosen = pii.disclosures(pii.keyed(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert chosen.count() == 0


def test_running_sums(spark):
    df = spark.range(1).select(F.sequence(F.lit(1).cast("bigint"), F.lit(1000).cast("bigint")).alias("x"))
    got = df.select(pii.running(F.col("x")).alias("s")).first().s
    assert got == [i * (i + 1) // 2 for i in range(1000)]


def test_terms_anywhere_in_the_document(spark):
    """A name in the heading of every document with an address in its signature, six words or more apart."""
    filler = "please ask about terms and write for today since nothing else was said about them here "
    rows = [(i, f"Marlowe reports on {w}ish things\n{filler * 8}\nhead@firm.example")
            for i, w in enumerate(["alpha", "bravo", "charlie", "delta"])]
    rows += [(10 + i, f"{w}ish Marlowe head@firm.example {filler}") for i, w in enumerate(["echo", "foxtrot", "golf"])]
    rows += [(100 + i, f"{filler} reports on things, item {i}") for i in range(400)]
    chosen = pii.disclosures(pii.keyed(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert {r.term: r.action for r in chosen.collect()} == {"marlowe": "remove"}


def test_copies_count_as_documents(spark):
    """Three texts, one of them in fifty copies: each copy is a document with both."""
    rows = [(i, "please ask Quillon, write to head@firm.example") for i in range(50)]
    rows += [(50, "Quillon wrote, head@firm.example"), (51, "from head@firm.example to Quillon")]
    rows += [(100 + i, f"please ask and write {i}") for i in range(100)]
    docs = pii.keyed(spark.createDataFrame(rows, "doc_id bigint, text string"))
    texts = pii.holding(docs)
    entities = pii._counted(texts.select("copies", F.explode("entities").alias("entity")), "entity")
    assert [tuple(r) for r in entities.collect()] == [("email:head@firm.example", 52)]
    assert {(r.term, r.both) for r in pii.candidates(texts, entities).collect()} == {("quillon", 52)}
    assert [r.term for r in pii.disclosures(docs).collect()] == ["quillon"]
