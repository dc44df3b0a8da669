"""Fixity of WARC replicas: hash trees over records and offset ranges, compared from the root.

Records stand in their file in order, each at an offset. A leaf is a record's SHA-256. An inner
node covers ``FANOUT`` consecutive places and hashes its children's places, offset ranges and
hashes. Equal roots end the audit. Otherwise only the children of nodes that differ are compared,
level by level, so what is read after the trees are made grows with the damage and not with the
replicas. Every level is a written table; payloads are hashed where they are read and never moved.
Files are numbered densely over all replicas, so ids may be any 64-bit numbers. Places and offsets
come from running sums over ranges of (file, id, hash), with equal records counted before they are
placed, so neither an id nor a record with very many copies stays in one task.

Defined cases: null url or html is empty; rows without page id form records in files of their
own; rows with equal id, url and html are records of their own at places of their own; two empty
replicas are equal; a replica without any record misses all of the other's; other columns are
left alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import keep

BITS = 4
FANOUT = 1 << BITS
PER_FILE = 1 << 10
RUN = 1 << 12  # copies placed at once
LEAF = "idx bigint, page_id bigint, file_no bigint, start bigint, length bigint, digest string"


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A page as one WARC record."""
    payload = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(payload).cast("string"),
        F.lit("\r\n\r\n"),
        payload,
        F.lit("\r\n\r\n"),
    )


def file_of(page_id: Column, other: Column) -> Column:
    """Files hold ranges of ids; rows without id are spread over 2^20 files below the others."""
    spread = -(F.lit(2) + F.pmod(F.xxhash64(other), F.lit(1 << 20)))
    return F.coalesce(F.shiftright(page_id.cast("bigint"), PER_FILE.bit_length() - 1), spread.cast("bigint"))


def _ranged(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` in ranges of ``order``, numbered by ``part`` and written, as a range exchange samples anew each time."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keep(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranges")


def manifest(records: DataFrame) -> DataFrame:
    """``page_id, file_no, record`` -> leaves with place and offset. Only numbers and hashes move."""
    hashed = records.select(
        F.col("page_id").cast("bigint"), "file_no",
        F.octet_length("record").cast("bigint").alias("length"), F.sha2("record", 256).alias("digest"),
    )
    equal = hashed.groupBy("page_id", "file_no", "length", "digest").agg(F.count(F.lit(1)).alias("n"))
    equal = _ranged(equal, "file_no", "page_id", "digest")
    size = F.col("n") * F.col("length")
    # A row per file and range.
    sums = equal.groupBy("file_no", "part").agg(F.sum("n").alias("n"), F.sum(size).alias("size"))
    earlier = W.partitionBy("file_no").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("file_no", "part", _sum("n", earlier).alias("places"), _sum("size", earlier).alias("offset"))
    before = W.partitionBy("file_no", "part").orderBy("page_id", "digest").rowsBetween(W.unboundedPreceding, -1)
    placed = equal.select("*", _sum("n", before).alias("place"), _sum(size, before).alias("start")).join(
        sums, ["file_no", "part"]
    )
    last = F.col("n") - 1
    many = placed.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor(last / RUN).cast("bigint"))))
    upto = F.least(last, (F.col("run") + 1) * RUN - 1)
    each = many.withColumn("copy", F.explode(F.sequence(F.col("run") * RUN, upto)))
    return each.select(
        "page_id", "file_no",
        (F.col("place") + F.col("places") + F.col("copy")).alias("place"),
        (F.col("start") + F.col("offset") + F.col("copy") * F.col("length")).alias("start"),
        "length", "digest",
    )


def _sum(column: Column | str, over) -> Column:
    return F.coalesce(F.sum(column).over(over), F.lit(0)).cast("bigint")


def _file_numbers(manifests: list[DataFrame]) -> DataFrame:
    """``file_no, file_idx``: the files of all replicas, numbered from 0."""
    files = reduce(DataFrame.unionAll, [m.select("file_no") for m in manifests]).distinct()
    files = _ranged(files, "file_no")
    # A row per range.
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = files.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", _sum("n", earlier).alias("before"))
    at = F.row_number().over(W.partitionBy("part").orderBy("file_no"))
    return files.withColumn("at", at).join(sums, "part").select(
        "file_no", (F.col("before") + F.col("at") - 1).cast("bigint").alias("file_idx")
    )


def leaves(manifests: list[DataFrame]) -> list[DataFrame]:
    """Manifests with one number per place, the same in all replicas, written."""
    kept = [keep(m, "manifest") for m in manifests]
    ends = [m.agg(F.max("place")).first()[0] for m in kept]
    width = max([PER_FILE, *(end + 1 for end in ends if end is not None)])
    width = 1 << (width - 1).bit_length()
    files = keep(_file_numbers(kept), "files")
    idx = F.col("file_idx") * F.lit(width) + F.col("place")
    return [
        keep(m.join(files, "file_no").select(idx.alias("idx"), "page_id", "file_no", "start", "length", "digest"), "leaves")
        for m in kept
    ]


def _above(level: DataFrame) -> DataFrame:
    """Nodes over at most ``FANOUT`` children each."""
    child = F.struct("idx", "start", "length", "digest")
    grouped = level.groupBy(F.shiftright("idx", BITS).alias("idx")).agg(
        F.sort_array(F.collect_list(child)).alias("children")
    )
    told = F.transform("children", lambda c: F.concat_ws(":", c.idx, c.start, c.length, c.digest))
    first, last = F.element_at("children", 1), F.element_at("children", -1)
    return grouped.select(
        "idx", first.start.alias("start"), last.length.alias("length"),
        F.sha2(F.concat_ws(",", told), 256).alias("digest"),
    )


def tree(leaf: DataFrame, height: int) -> list[DataFrame]:
    """Levels from the leaves to the root, each written."""
    levels = [leaf]
    for _ in range(height):
        levels.append(keep(_above(levels[-1].select("idx", "start", "length", "digest")), "tree"))
    return levels


def _different(a: DataFrame, b: DataFrame) -> DataFrame:
    """Places whose nodes differ or stand in one replica only."""
    a = a.select("idx", F.col("digest").alias("digest_a"))
    b = b.select("idx", F.col("digest").alias("digest_b"))
    return a.join(b, "idx", "full").filter(~F.col("digest_a").eqNullSafe(F.col("digest_b")))


def audit(one: DataFrame, other: DataFrame) -> DataFrame:
    """Records of replica ``one`` or ``other`` that differ.

    Both are ``page_id, file_no, record``. Returns ``page_id, file_no, start, length, status,
    digest``: ``changed`` and ``missing`` with place and hash in ``one``, ``extra`` in ``other``.
    """
    a, b = leaves([manifest(one), manifest(other)])
    top = max(x.agg(F.max("idx")).first()[0] or 0 for x in (a, b))
    height = -(-top.bit_length() // BITS)
    levels = list(zip(tree(a, height), tree(b, height)))
    bad = None
    for x, y in reversed(levels):
        if bad is not None:
            below = bad.select(F.col("idx").alias("above"))
            x, y = (
                s.join(below, F.shiftright(s["idx"], BITS) == F.col("above"), "left_semi") for s in (x, y)
            )
        bad = keep(_different(x, y), "different")
        if bad.isEmpty():
            break
    changed = bad.filter("digest_a is not null").select(
        "idx", F.when(F.col("digest_b").isNull(), "missing").otherwise("changed").alias("status")
    )
    extra = bad.filter("digest_a is null").select("idx", F.lit("extra").alias("status"))
    found = a.join(changed, "idx").unionByName(b.join(extra, "idx"))
    return found.select("page_id", "file_no", "start", "length", "status", "digest")
