"""Where records go. Every sink writes in parallel and lets Spark even out hot keywords.

Pass stored records: each sink first looks whether there is any, then reads them to write.

``write_once`` writes a table in named steps that can be repeated: a step's rows go to a folder of
their own, and a manifest of one line, made when they are complete, names it. Readers take what
manifests name, so a step that broke off, or was done twice, counts as nothing, or once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sheet_key
from ..operators.report import last_runs

NO_KEY = "_"


def write_contacts_csv(records: DataFrame, path: str, order: Sequence[str] = (),
                       mode: str = "errorifexists") -> str | None:
    """CSV with a header line, quotes doubled; nothing is written when there is no record.

    ``order`` sorts what is written; whether there is a record is asked of ``records`` itself.
    """
    if records.isEmpty():
        return None
    ordered = records.orderBy(*order) if order else records
    ordered.write.mode(mode).csv(
        path,
        header=True,
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )
    return path


def write_contacts_by_keyword(records: DataFrame, path: str, mode: str = "errorifexists") -> str | None:
    """One folder per keyword's sheet key, from the last run of each keyword.

    The rebalance hint gathers a keyword's rows in few files and splits a keyword that is
    too large for one. Keywords that share a sheet key share a folder; ``keyword`` tells
    them apart. An empty sheet key, which no folder can be named after, becomes ``NO_KEY``.
    """
    if records.isEmpty():
        return None
    key = sheet_key(F.col("keyword"))
    keyed = last_runs(records).withColumn("sheet_key", F.when(key == "", NO_KEY).otherwise(key))
    keyed.hint("rebalance", "sheet_key").write.partitionBy("sheet_key").mode(mode).parquet(path)
    return path


def write_contacts_table(records: DataFrame, path: str) -> str | None:
    """All records in one table."""
    if records.isEmpty():
        return None
    records.write.mode("errorifexists").parquet(path)
    return path


def _manifest(spark: SparkSession, path: str, label: str):
    """A step's manifest as its file system, its path and its line, empty when the step isn't done."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/committed/{quote(label, safe='')}")
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return files, at, ""
    stream = files.open(at)
    try:
        line = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return files, at, line if line.endswith("\n") else ""


def write_once(df: DataFrame, path: str, label: str) -> bool:
    """Add ``df`` to the table at ``path`` as step ``label``; nothing is computed if that is done.

    Returns whether it was added. What an attempt that broke off has left is never read. Two
    attempts at once leave one manifest, of one of them.
    """
    spark = df.sparkSession
    files, at, line = _manifest(spark, path, label)
    if line:
        return False
    folder = f"data/{quote(label, safe='')}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    stream = files.create(at, True)
    try:
        stream.write(bytearray(f"{folder}\n", "UTF-8"))
    finally:
        stream.close()
    return True


def read_committed(spark: SparkSession, path: str, schema) -> DataFrame:
    """All steps of the table at ``path`` that are done; none is an empty table.

    Folder names come to the driver, one per step.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/committed")
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return spark.createDataFrame([], schema)
    whole = spark.read.text(f"{path}/committed", wholetext=True).filter(F.endswith("value", F.lit("\n")))
    folders = [f"{path}/{r.value.strip()}" for r in whole.collect()]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders)


def committed_batches(path: str, label: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch of a stream is a step, so a repeated one adds nothing."""

    def add(df: DataFrame, batch: int) -> None:
        write_once(df, path, f"{label}-{batch:012d}")

    return add
