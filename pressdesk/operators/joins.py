"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_per_key(rows: DataFrame, per_key: DataFrame, key: str, how: str = "inner",
                   spread: int = 16) -> DataFrame:
    """Join rows to a side with few small rows per key, each key split over ``spread`` parts.

    The small side is repeated once per part. Its measured size decides how Spark joins: it
    is broadcast below the session's threshold, else both sides are shuffled, and then a
    key's rows go to ``spread`` tasks rather than one. Adaptive execution splits further.
    """
    salted = rows.withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.lit(spread)))
    last = F.lit(spread - 1).cast("bigint")
    repeated = per_key.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    return salted.join(repeated, [key, "_part"], how).drop("_part")
