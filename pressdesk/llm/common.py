"""What the corpus operators share: words as numbers, kernels over Arrow batches, scratch tables.

A word is a run of bytes other than the six ASCII blanks, with A-Z lower-cased where an
operator says so. ``bytes.split`` and ``bytes.lower`` do just that on UTF-8.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, stored

MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read back: lineage ends there."""
    return stored(df, scratch_path(df.sparkSession, name))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed(docs: DataFrame, *plain: str) -> DataFrame:
    """The columns ``plain``, and all others in a struct ``row``, where no name can clash."""
    others = [F.col(quoted(c)) for c in docs.columns if c not in plain]
    return docs.select(*plain, F.struct(*(others or [F.lit(0).alias("none")])).alias("row"))


def unpacked(rows: DataFrame, docs: DataFrame, *plain: str) -> DataFrame:
    """The columns of ``docs``, those of ``plain`` as they are in ``rows`` now."""
    return rows.select(*[
        F.col(c) if c in plain else F.col("row").getField(c).alias(c) for c in docs.columns
    ])


def remainder(doc_id: int | None, by: int) -> int | None:
    """crc32 of the id as text, modulo ``by``; None for a row without id."""
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % by


def remainder_column(doc_id: Column, by: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null reads as empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return [b or b"" for b in column.cast(pa.large_binary() if wide else pa.binary()).to_pylist()]


def portions(column: pa.Array, size: int) -> Iterator[tuple[int, list[str]]]:
    """Runs of a text column as strings, each of about ``size`` bytes or of one text; null reads as empty.

    Yields where the run begins and its texts, so a batch is never held as strings at once.
    """
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, at = np.cumsum(lengths), 0
    while at < len(lengths):
        reached = upto[at] - lengths[at] + size
        stop = max(at + 1, int(np.searchsorted(upto, reached, "right")))
        yield at, [t or "" for t in column.slice(at, stop - at).to_pylist()]
        at = stop


def kernel(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]],
           schema: str) -> DataFrame:
    """Run ``function`` over the Arrow batches of each partition."""
    return df.mapInArrow(function, schema)


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


class Known(dict):
    """A bounded memo: what is missing is computed, and all is forgotten at the limit."""

    def __init__(self, compute: Callable, limit: int = 1 << 19, longest: int = 64):
        super().__init__()
        self.compute, self.limit, self.longest = compute, limit, longest

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


class WordHashes:
    """64-bit hashes of words."""

    def __init__(self, seed: int = 0, limit: int = 1 << 19):
        self._known = Known(lambda word: xxhash.xxh3_64_intdigest(word, seed), limit)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self._known.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose result bits all depend on all bits of ``x``."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash per run of ``width`` words; with fewer words, one for the whole sequence."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(width, n)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out = mix(out + hashes[k : n - width + 1 + k])
    return out


def seeds(n: int, key: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    steps = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(steps + np.uint64(key & MASK))
