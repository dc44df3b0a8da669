"""Quality rules whose thresholds come from quantile sketches per language and source.

A sketch is a histogram over logarithmic buckets: two sketches merge by adding counts, so one
aggregation makes those of all groups, and summing these gives the ones per language and for
the whole corpus. A bucket's width bounds the relative error of a quantile.

A measure's fence lies beyond a group's outer quantile (one in ``TAIL`` documents) by ``SPREADS``
times that quantile's distance from the median, all in buckets. Fences shrink to those of the
language, and these to the corpus', as if ``PRIOR`` documents stood there: there is no size at which a
group changes over. A document is out only if its value lies beyond the fence by more than chance
allows in a text of its length: ``ERRORS`` standard errors of a count, or of a sum of word lengths
that vary as much as their mean. So a single symbol in a group that has none condemns no text.

Defined cases: null text has no words and fails the base rules; a null language or source is a
group like any other; a row without id is judged like any other; repeated rows count and are
answered once each; other columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WordHashes, keep, kernel, raw, windows

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 10
MAX_REPEATED = 20  # per cent of words

GAMMA = 1.02
TAIL = 10
SPREADS = 2
PRIOR = 100
ERRORS = 2.0
# Measure: numerator, denominator, the scale near zero.
MEASURES = {
    "mean_word": ("word_chars", "n_words", 1.0),
    "symbols": ("n_symbols", "n_words", 0.05),
    "repeated": ("n_repeat_words", "n_words", 0.05),
    "dup_lines": ("n_dup_lines", "n_lines", 0.05),
}
LOWER = ("mean_word",)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_BLANKS = b" \t\n\r\x0b\x0c"
_COUNTED = (
    "doc_id bigint, lang string, source string, n_words bigint, word_chars bigint, "
    "n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint"
)


def _repeated(hashes: np.ndarray) -> int:
    """Words that lie in a 5-word window which the text holds more than once."""
    if len(hashes) < 6:
        return 0
    _, at, times = np.unique(windows(hashes, 5), return_inverse=True, return_counts=True)
    twice = np.flatnonzero(times[at] > 1)
    edges = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + 5, -1)
    return int((edges.cumsum() > 0).sum())


def _line_counts(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those among them that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip(_BLANKS)]
    return len(lines), len(lines) - len(set(lines))


def counts(docs: DataFrame) -> DataFrame:
    """The base counts of each document."""

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            rows = []
            for text in raw(b.column(3)):
                words = text.split()
                characters = len(b"".join(words).decode("utf-8", "replace"))
                lines, twice = _line_counts(text)
                symbols = len(text) - len(text.translate(None, SYMBOLS))
                rows.append((len(words), characters, symbols, twice, _repeated(hashes(words)), lines))
            columns = np.array(rows, np.int64).reshape(-1, 6).T
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], *map(pa.array, columns)],
                ["doc_id", "lang", "source", *COUNTS, "n_lines"],
            )

    picked = docs.select(F.col("doc_id").cast("bigint"), "lang", "source", "text")
    return kernel(picked, run, _COUNTED)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEATED) * F.col("n_words")
    )


def _bucket(value: Column, step: float) -> Column:
    """Bucket of a value; each is ``GAMMA`` times as wide as the one before."""
    return F.floor(F.log(value / F.lit(step) + F.lit(1.0)) / F.log(F.lit(GAMMA))).cast("bigint")


def _error(measure: str) -> Column:
    """``ERRORS`` standard errors of a measure's numerator."""
    over, under, _ = MEASURES[measure]
    if measure in LOWER:
        return F.lit(ERRORS) * F.col(over) / F.sqrt(F.greatest(F.col(under), F.lit(1)).cast("double"))
    return F.lit(ERRORS) * F.sqrt(F.col(over).cast("double"))


def bucket(measure: str, errors: int = 0) -> Column:
    """Bucket of a measure's value, or of the least (-1) or greatest (1) that chance allows for."""
    over, under, step = MEASURES[measure]
    count = F.col(over).cast("double")
    if errors:
        count = F.greatest(count + F.lit(errors) * _error(measure), F.lit(0.0))
    return _bucket(count / F.greatest(F.col(under), F.lit(1)).cast("double"), step)


def sketches(counted: DataFrame) -> DataFrame:
    """``lang, source, measure, bucket, n`` of the documents that pass the base rules."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), bucket(m).alias("bucket")) for m in MEASURES])
    return (
        counted.filter(~base_failed())
        .select("lang", "source", F.explode(pairs).alias("m"))
        .groupBy("lang", "source", "m.measure", "m.bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _fences(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Fences per group ``by``: at most one row per bucket of a group meets in a window."""
    key = [*by, "measure"]
    merged = sketch.groupBy(*key, "bucket").agg(F.sum("n").alias("n"))
    ranked = merged.withColumns({
        "upto": F.sum("n").over(W.partitionBy(*key).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)),
        "total": F.sum("n").over(W.partitionBy(*key)),
    })
    at = lambda part: F.min(F.when(TAIL * F.col("upto") >= part * F.col("total"), F.col("bucket")))
    quantiles = ranked.groupBy(*key).agg(
        at(1).alias("first"), at(TAIL // 2).alias("middle"), at(TAIL - 1).alias("last"), F.max("total").alias("total")
    )
    flat = quantiles.withColumns({
        "low": F.col("first") - SPREADS * (F.col("middle") - F.col("first")),
        "high": F.col("last") + SPREADS * (F.col("last") - F.col("middle")),
    })
    of = lambda column, m: F.max(F.when(F.col("measure") == m, F.col(column)))
    wide = [of(side, m).alias(f"{side}_{m}") for m in MEASURES for side in ("low", "high")]
    return flat.groupBy(*by).agg(F.max("total").alias("total"), *wide)


def _shrunk(own: Column, total: Column, above: Column) -> Column:
    weighed = (total * own).cast("double") + F.lit(PRIOR).cast("double") * above
    return weighed / (total + PRIOR).cast("double")


def fences(sketch: DataFrame) -> DataFrame:
    """``lang, source`` with the fences that hold there; none means nothing is out of bounds."""
    columns = [f"{side}_{m}" for m in MEASURES for side in ("low", "high")]
    own, lang = _fences(sketch, ["lang", "source"]), _fences(sketch, ["lang"])
    corpus = _fences(sketch.withColumn("corpus", F.lit(0)), ["corpus"]).first()
    if corpus is None:
        corpus = dict.fromkeys(columns)
    lang = lang.select(F.col("lang").alias("l_lang"), *[
        _shrunk(F.col(c), F.col("total"), F.lit(corpus[c]).cast("double")).alias(f"l_{c}") for c in columns
    ])
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")))
    return joined.select(
        F.col("lang").alias("f_lang"), F.col("source").alias("f_source"),
        *[_shrunk(F.col(c), F.col("total"), F.col(f"l_{c}")).alias(c) for c in columns],
    )


def judge(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """Join each document with its group's fences; a group without any has no passing document."""
    inside = F.lit(True)
    for m in MEASURES:
        inside &= F.coalesce(bucket(m, -1) <= F.col(f"high_{m}"), F.lit(True))
        if m in LOWER:
            inside &= F.coalesce(bucket(m, 1) >= F.col(f"low_{m}"), F.lit(True))
    same = F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source"))
    return counted.join(limits, same, "left").select(
        "doc_id", *COUNTS, base_failed().alias("base_failed"), (~base_failed() & inside).alias("kept")
    )


def apply_rules(docs: DataFrame) -> DataFrame:
    """Counts, base verdict and final verdict of each document."""
    counted = keep(counts(docs), "counts")
    return judge(counted, keep(fences(sketches(counted)), "fences"))
