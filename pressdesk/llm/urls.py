"""URL filters: host and path rules, then a list of blocked canonical URLs.

The list goes into a blocked Bloom filter: a URL's hash picks one block of 512 bits, and eight
six-bit parts of a second hash pick a bit in each of its eight words. Spark builds the blocks
with ``bit_or``. The filter is a table of at most ``MAX_BLOCKS`` rows of 72 bytes, whatever the
length of the list, so it may be broadcast. URLs that hit all eight bits are joined with the list
itself, which removes false positives; a filter that is too small only passes more of them on.

Defined cases: null and a text without ``://`` have an empty host and path and no canonical
form, and are allowed; an empty list blocks nothing; equal URLs get equal verdicts, once per
row; other columns are left alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
QUERY = r"(?s)^.*?://[^?#]*\?([^#]*)"

# Parameters that track a visit and host labels of the same site.
TRACKING = r"(^|&)(utm_[a-z]+|ref)=[^&]*"
SAME_SITE = r"^(www|m)\."

MAX_BLOCKS = 1 << 17
KEYS_PER_BLOCK = 32  # 16 bits a key
LANES = 8

Rule = tuple[str, str, str]  # verdict, host, start of path


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www or m, path without a slash at its end, query without tracking; else null."""
    query = F.regexp_replace(F.regexp_extract(url, QUERY, 1), TRACKING, "")
    query = F.regexp_replace(query, "^&", "")
    site = F.regexp_replace(host(url), SAME_SITE, "")
    page = F.regexp_replace(path(url), "/+$", "")
    whole = F.concat(site, page, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(site != "", whole)


def fits(rule: Rule, host: Column, path: Column) -> Column:
    _, name, start = rule
    return ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))


def rule_for(rules: list[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits, as ``struct(rule, verdict)``; null without one.

    The list of rules is a parameter of a run and travels as literals.
    """
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    named = [
        F.when(fits(r, host, path), F.struct(F.lit(r[1] + r[2]).alias("rule"), F.lit(r[0]).alias("verdict")))
        for r in longest
    ]
    return F.coalesce(*named) if named else F.lit(None).cast("struct<rule:string,verdict:string>")


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), key), F.lit(blocks))


def _bit(key: Column, lane: int) -> Column:
    place = F.shiftright(F.xxhash64(F.lit(2), key), 6 * lane).bitwiseAND(F.lit(63).cast("bigint"))
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place.cast("int"))


def bloom_filter(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """``block, lane_0 .. lane_7`` over the keys of a list; at most ``blocks`` rows."""
    bits = [F.bit_or(_bit(F.col(key), i)).alias(f"lane_{i}") for i in range(LANES)]
    return listed.groupBy(_block(F.col(key), blocks).alias("block")).agg(*bits)


def block_count(keys: int) -> int:
    return max(1, min(MAX_BLOCKS, -(-keys // KEYS_PER_BLOCK)))


def probe(rows: DataFrame, key: str, blooms: DataFrame, blocks: int) -> DataFrame:
    """``rows`` with a column ``_maybe``: false only for keys that are not in the filter.

    ``blooms`` is broadcast: it has no more than ``MAX_BLOCKS`` rows of nine numbers.
    """
    asked = rows.withColumn("_block", _block(F.col(key), blocks))
    asked = asked.join(F.broadcast(blooms), F.col("_block") == F.col("block"), "left")
    hit = reduce(
        lambda a, b: a & b,
        [F.col(f"lane_{i}").bitwiseAND(_bit(F.col(key), i)) != 0 for i in range(LANES)],
    )
    maybe = F.coalesce(hit & F.col(key).isNotNull(), F.lit(False))
    return asked.select(*rows.columns, maybe.alias("_maybe"))


def listed_hits(rows: DataFrame, key: str, listed: DataFrame, listed_key: str, blocks: int) -> DataFrame:
    """``rows`` with a column ``listed``: filter first, exact join for what it lets through.

    ``listed_key`` is unique in ``listed``. A null key is not listed.
    """
    names = rows.columns
    asked = probe(rows, key, bloom_filter(listed, listed_key, blocks), blocks)
    known = listed.select(F.col(listed_key).alias("_key"), F.lit(True).alias("_found"))
    sure = asked.filter(~F.col("_maybe")).select(*names, F.lit(False).alias("listed"))
    checked = asked.filter("_maybe").join(known, F.col(key) == F.col("_key"), "left")
    return sure.unionByName(checked.select(*names, F.coalesce("_found", F.lit(False)).alias("listed")))


def judge(pages: DataFrame, rules: list[Rule], listed: DataFrame, blocks: int) -> DataFrame:
    """``page_id, host, path, rule, verdict``: a rule's verdict, else that of the list ``canonical``."""
    parts = pages.select(
        "page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"),
        canonical(F.col("url")).alias("_canonical"),
    ).withColumn("_rule", rule_for(rules, F.col("host"), F.col("path")))
    ruled = parts.filter(F.col("_rule").isNotNull()).select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.col("_rule.verdict").alias("verdict")
    )
    asked = parts.filter(F.col("_rule").isNull()).select("page_id", "host", "path", "_canonical")
    by_list = listed_hits(asked, "_canonical", listed, "canonical", blocks)
    verdict = F.when(F.col("listed"), "block").otherwise("allow")
    return ruled.unionByName(
        by_list.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), verdict.alias("verdict"))
    )


def fetched_twice(pages: DataFrame) -> DataFrame:
    """A list: canonical URLs that were fetched under two or more addresses."""
    address = F.xxhash64("url")
    return (
        pages.select(canonical(F.col("url")).alias("canonical"), address.alias("address"))
        .filter(F.col("canonical").isNotNull())
        .groupBy("canonical").agg(F.min("address").alias("one"), F.max("address").alias("other"))
        .filter(F.col("one") != F.col("other")).select("canonical")
    )
