"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A page of a kilobyte takes about a millisecond through all rules.
ROWS_PER_TASK = 20_000


def build(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings these jobs rely on; on a cluster they come from outside."""
    builder = (
        SparkSession.builder.appName("pressdesk")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # A parsed page takes several times the memory of its HTML in a Python worker.
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    )
    if master is not None:
        builder = builder.master(master).config("spark.driver.memory", "12g")
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder named by ``spark.checkpoint.dir``.

    A machine-local folder is used only in local mode, where every task sees it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="pressdesk-")
    return os.path.join(folder, f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to a shared path and read back: computed once, safe to re-read."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """Deal rows out so that every core has some and no task much more than ``ROWS_PER_TASK``.

    Parsing costs far more than reading, and a file cannot be split below a row group, whatever the
    bytes of its splits. Rows are counted by split, without reading a column; a scan whose largest
    split holds at most twice a task's share is left as it is.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    sizes = rows.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"))
    total, largest = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    tasks = max(2 * cores, -(-total // ROWS_PER_TASK))
    if largest * tasks <= 2 * total:
        return rows
    return rows.repartition(tasks)
