"""Target-distribution importance resampling with counts made once per distinct line.

Features of a text are its words and pairs of neighbouring words, hashed into buckets. Newlines
separate words and cut a text into lines, so a text's features are those of its lines and the pairs
across lines. The corpus is counted from its distinct lines: each line's features are counted once
and multiplied by its occurrences, wherever they stand, and the pairs across lines are added. A
bucket's gain is the log ratio of its shares in the target and in the corpus; a document's weight
is its features' mean gain, and Gumbel noise on it draws without replacement.

Ranks come from one range exchange: rows are numbered within sorted ranges, and the counts of the
ranges, as many as shuffle partitions, give each range's first rank. What goes to every task is
the gains, as many as buckets, and those range counts.

Defined cases: null text has no words and weight 0; without a target or corpus all gains are those
of no counts; rows are drawn each for itself, with equal rows in any order; a null id is hashed as
the empty text and comes after all ids; texts and lines may be of any length; other columns are
left alone; a table without rows gives none.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, kernel, portions

BUCKETS = 10_000
LEAST_WORDS = 20
SHARE = 25
SEED = 7
PORTION = 1 << 22
MEMO = 1 << 15
NEWLINE = 10

# Word bytes are digits, letters and all beyond ASCII; A-Z are lower-cased, newlines stay.
_FOLDED = bytes(
    b + 32 if 65 <= b <= 90 else b if b == NEWLINE or b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)


def folded(text: str) -> list[bytes]:
    """Lines with only word bytes and blanks."""
    return text.encode("utf-8", "replace").translate(_FOLDED).split(b"\n")


def pair_bucket(left: bytes, right: bytes) -> int:
    return zlib.crc32(left + b" " + right) % BUCKETS


def features(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features within the lines, the line of each, and the words per line."""
    cut = [line.split() for line in lines]
    words = [w for some in cut for w in some]
    counts = np.fromiter(map(len, cut), np.int64, len(cut))
    of = np.repeat(np.arange(len(cut)), counts)
    single = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
    within = of[1:] == of[:-1]
    pairs = map(zlib.crc32, map(b" ".join, zip(words, words[1:])))
    double = np.fromiter(pairs, np.int64, max(len(words) - 1, 0))[within]
    return np.concatenate([single, double]) % BUCKETS, np.concatenate([of, of[1:][within]]), counts


def edges(lines: list[bytes]) -> list[int]:
    """Buckets of the pairs of a text's words that stand on different lines."""
    out, last = [], None
    for line in lines:
        first = line.split(None, 1)
        if first:
            if last is not None:
                out.append(pair_bucket(last, first[0]))
            last = line.rsplit(None, 1)[-1]
    return out


def corpus_counts(docs: DataFrame) -> np.ndarray:
    """Features per bucket over all texts, by way of their distinct lines."""

    def cut(batches):
        across = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for _, texts in portions(b.column(0), PORTION):
                found: Counter[bytes] = Counter()
                for text in texts:
                    lines = folded(text)
                    found.update(lines)
                    np.add.at(across, edges(lines), 1)
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.keys(), pa.binary()), pa.nulls(n, pa.int32()), pa.array(found.values(), pa.int64())],
                    ["line", "bucket", "n"],
                )
        buckets = np.flatnonzero(across)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(buckets), pa.binary()), pa.array(buckets, pa.int32()), pa.array(across[buckets])],
            ["line", "bucket", "n"],
        )

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            n = b.column(2).to_numpy(zero_copy_only=False)
            bucket = b.column(1).fill_null(-1).to_numpy(zero_copy_only=False)
            np.add.at(total, bucket[bucket >= 0], n[bucket >= 0])
            size, rows = 0, []
            for k, line in enumerate(b.column(0)):
                if (line := line.as_py()) is not None:
                    rows.append((line, k))
                    size += len(line)
                if rows and (size > PORTION or k == len(n) - 1):
                    found, of, _ = features([line for line, _ in rows])
                    np.add.at(total, found, n[[k for _, k in rows]][of])
                    size, rows = 0, []
        buckets = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(total[buckets])], ["bucket", "n"])

    lines = kernel(docs.select("text"), cut, "line binary, bucket int, n bigint")
    lines = lines.groupBy("line", "bucket").agg(F.sum("n").alias("n"))
    counted = kernel(lines, count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in counted.collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket 1000 times the log ratio of its smoothed shares, floored."""
    s_all, t_all = int(corpus.sum()), int(target.sum())
    return np.array([
        math.floor(1000 * math.log(float(t + 1) * float(s_all + BUCKETS) / (float(s + 1) * float(t_all + BUCKETS))))
        for s, t in zip(corpus.tolist(), target.tolist())
    ], np.int64)


def noise(doc_id: int | None) -> int:
    """Gumbel noise by the id, in thousandths."""
    h = int(hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score``; a line's sums are remembered for the next time."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        gain, known = shared.value, {}
        for b in batches:
            for at, texts in portions(b.column(1), PORTION):
                lines = [folded(text) for text in texts]
                new = [*set().union(*lines).difference(known)]
                if len(known) + len(new) > MEMO:
                    known, new = {}, [*set().union(*lines)]
                found, of, words = features(new)
                total = np.zeros(len(new), np.int64)
                np.add.at(total, of, gain[found])
                known.update(zip(new, zip(words.tolist(), total.tolist())))
                ids = b.column(0).slice(at, len(texts))
                rows = []
                for doc_id, some in zip(ids.to_pylist(), lines):
                    counted = [known[line] for line in some]
                    n = sum(c for c, _ in counted)
                    features_n = max(2 * n - 1, 0)
                    total_gain = sum(g for _, g in counted) + int(gain[edges(some)].sum())
                    weight = total_gain // features_n if features_n else 0
                    rows.append((n, features_n, weight, weight + noise(doc_id)))
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array(c, pa.int64()) for c in zip(*rows))],
                    ["doc_id", "n_words", "n_features", "weight", "score"],
                )

    return kernel(docs.select(F.col("doc_id").cast("bigint"), "text"), run,
                  "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")


def numbered(rows: DataFrame, *order) -> DataFrame:
    """``rows`` with ``place``, counted from 1 in the order given, over all partitions of a range exchange."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = rows.columns

    def count(batches):
        at = 0
        for b in batches:
            places = np.arange(at + 1, at + 1 + b.num_rows)
            at += b.num_rows
            part = pa.array(np.full(b.num_rows, TaskContext.get().partitionId()), pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, part, pa.array(places)], [*names, "part", "place"])

    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    in_order = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    held = keep(kernel(in_order, count, f"{schema}, part int, place bigint"), "numbered")
    # A row per partition of the exchange.
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = held.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("b"))
    return held.join(F.broadcast(offsets), "part").withColumn("place", F.col("place") + F.col("b")).drop("part", "b")


def resample(docs: DataFrame, target: DataFrame) -> DataFrame:
    """Documents with weight, score and, where drawn, rank. ``target`` has the texts to be like."""
    gain = gains(corpus_counts(docs), corpus_counts(target))
    weighed = weigh(docs, gain).withColumn("_row", F.monotonically_increasing_id())
    weighed = keep(weighed, "weighed")
    eligible = F.col("n_words") >= LEAST_WORDS
    drawn = SHARE * weighed.filter(eligible).count() // 100
    order = (F.desc("_eligible"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_row"))
    placed = numbered(weighed.withColumn("_eligible", eligible), *order)
    return placed.select(
        "doc_id", "n_features", "weight", "score",
        F.when(F.col("place") <= drawn, F.col("place")).alias("rank"), "n_words",
    )
