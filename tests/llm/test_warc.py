import hashlib

from pyspark.sql import functions as F

from pressdesk.llm import warc as M

PAGES = "page_id bigint, url string, html string, idx string, digest string"


def records(spark, pages):
    df = spark.createDataFrame([(*p, "x", "x") for p in pages], PAGES)
    return df.select(
        "page_id", M.file_of(F.col("page_id"), F.concat_ws(" ", "url", "html")).alias("file_no"),
        M.record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"),
    )


def found(one, other):
    return sorted(((r.page_id, r.status) for r in M.audit(one, other).collect()), key=repr)


PAGES_A = [(i, f"http://x/{i}", f"<p>page {i}</p>" * (i % 7)) for i in range(5000)]


def test_damage_is_located(spark):
    changed = [(i, u, h.replace("p", "q", 1) if i in (0, 78, 4999) else h) for i, u, h in PAGES_A if i not in (1023, 4097)]
    a, b = records(spark, PAGES_A), records(spark, [p for p in changed if p[0] <= 4097 or p[0] > 4500])
    got = found(a, b)
    places = {(i, s) for i, s in got}
    assert {(78, "changed"), (1023, "missing")} <= places
    assert all(i in (78, 1023) or i >= 4097 for i, _ in got)


def test_equal_replicas(spark):
    a = records(spark, PAGES_A[:300])
    assert found(a, records(spark, PAGES_A[:300][::-1])) == []


def test_extra_empty_and_odd(spark):
    odd = [(1, None, None), (1, "u", "h"), (2, "", ""), (2, "", ""), (None, "u", "x" * 100_000), (None, None, None)]
    a = records(spark, odd)
    none = a.limit(0)
    assert len(found(a, none)) == 6 and {s for _, s in found(a, none)} == {"missing"}
    assert {s for _, s in found(none, a)} == {"extra"}
    assert found(none, none) == [] and found(a, a) == []


def test_only_mismatching_branches_are_read(spark):
    a = M.leaves([M.manifest(records(spark, PAGES_A))])[0]
    levels = M.tree(a, 4)
    assert [x.count() for x in levels][1:] == [313, 20, 2, 1]
    one = levels[1].orderBy("idx").first()
    children = [f"{r.idx}:{r.start}:{r.length}:{r.digest}" for r in a.filter("idx < 16").orderBy("idx").collect()]
    assert one.digest == hashlib.sha256(",".join(children).encode()).hexdigest()


def test_ids_of_64_bits_and_clashing_columns(spark):
    ids = [1 << 62, -(1 << 62), (1 << 63) - 1, -(1 << 63), 0, None]
    pages = [(i, f"u{i}", "h") for i in ids]
    assert found(records(spark, pages), records(spark, pages)) == []
    other = [(i, u, "g" if i == -(1 << 62) else h) for i, u, h in pages if i != (1 << 63) - 1]
    clashing = records(spark, other).selectExpr("*", "0 AS n", "0 AS part", "0 AS place", "'x' AS digest")
    assert found(records(spark, pages), clashing) == sorted([((1 << 63) - 1, "missing"), (-(1 << 62), "changed")], key=repr)


def test_one_id_and_one_record_with_very_many_copies(spark):
    """Places and offsets are those of all records in order, copies next to each other."""
    pages = [(5, "u", "same")] * 9000 + [(5, "u", f"own {i}") for i in range(500)] + [(i, "v", "x") for i in range(300)]
    df = records(spark, pages)
    got = sorted((r.file_no, r.place, r.start, r.page_id, r.length, r.digest) for r in M.manifest(df).collect())
    rows = sorted((r.file_no, r.page_id, hashlib.sha256(r.record.encode()).hexdigest(), len(r.record)) for r in df.collect())
    start, expected = 0, []
    for place, (file_no, page_id, digest, length) in enumerate(rows):
        expected.append((file_no, place, start, page_id, length, digest))
        start += length
    assert got == expected
