"""Language-model scoring with Katz backoff over word bigrams.

Tokens are a text's words and one end. Every word is itself in every bigram, by its 64-bit hash.
A word has its Good-Turing discounted count; what the discounts and one extra event leave is for
unseen words, in equal parts for as many as Chao's estimate says there are:
n1 (n1 - 1) / (2 n2 + 2), at least one.

    P(word)          = d(c) * c(word) / (tokens + 1)
    P(word | before) = d(c) * c(before, word) / (c(before) + 1)    for a bigram seen c times
                     = weight(before) * P(word)                    else

``weight(before)`` spreads what the discounts and the one extra event leave over the words not seen
after ``before`` in proportion to P(word), so the probabilities add up to one exactly; it is one
after a word never seen. Counts 1 to 5 are discounted by Katz's formula, or by one half where the
counts of counts don't allow it. With ``VOCABULARY`` above zero, words below that share of the
training tokens are one class in bigrams; nothing sets it but tests.

All counts are Spark tables that grow with the corpus: words, bigrams, and the sums over each word
before. A score is a sum over tokens of log10 P(word) and log10 weight(word) towards the next, plus
over seen bigrams of what they gain over backing off, so a text asks each table by one key. Words and
bigrams above ``FREQUENT`` of the tokens, of which there are at most 1 / ``FREQUENT``, travel to the
tasks, which look them up in place; the rest is joined, and no key of such a join is frequent in the
training rows.

Defined cases: null text is empty and has the end as its only token; rows without id teach
nothing and are scored; without training rows the whole probability is the unseen word's; rows
that share an id are scored each; other columns are left alone; texts may be of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, keep, kernel, mix, raw

VOCABULARY = 0.0
FREQUENT = 1e-6
DISCOUNTED = 5
# No word is empty or has blanks.
END, START, SHARED = (np.uint64(xxhash.xxh3_64_intdigest(b)) for b in (b"", b" ", b"  "))

_CHUNK = 1 << 19
_PIECE = 1 << 17  # tokens of a chunk's texts in one row
PARTS = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, "
    "words array<bigint>, pairs array<bigint>"
)


def _chunks(batches, text_at: int, hashed: bool = True):
    """(rows, hashes of all tokens, tokens per row) in pieces of bounded size; without hashes zeros stand for them."""
    hashes = WordHashes(limit=1 << 17)
    for b in batches:
        texts, start, parts, size = raw(b.column(text_at)), 0, [], 0
        for at, text in enumerate(texts):
            words = text.lower().split()
            parts.append(np.append(hashes(words), END) if hashed else np.zeros(len(words) + 1, np.uint8))
            size += len(parts[-1])
            if size >= _CHUNK or at == len(texts) - 1:
                yield b.slice(start, at + 1 - start), np.concatenate(parts), np.array([len(p) for p in parts])
                start, parts, size = at + 1, [], 0


def _counted(keys: np.ndarray) -> pa.RecordBatch:
    found, times = np.unique(keys, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times.astype(np.int64))], ["key", "c"])


def word_counts(train: DataFrame) -> DataFrame:
    """``key, c``: occurrences of each word and of the end, counted in each task first."""

    def run(batches):
        for _, tokens, _ in _chunks(batches, 0):
            yield _counted(tokens)

    return kernel(train.select("text"), run, "key bigint, c bigint").groupBy("key").agg(F.sum("c").alias("c"))


def counts_of_counts(counted: DataFrame) -> tuple[int, int, list[int]]:
    """Sum, number, and how many keys occur 1, 2, .. times."""
    times = [F.count_if(F.col("c") == r).alias(f"n{r}") for r in range(1, DISCOUNTED + 2)]
    row = counted.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("all"), F.count(F.lit(1)).alias("kinds"), *times).first()
    return row["all"], row["kinds"], list(row)[2:]


def discounts(n: list[int]) -> np.ndarray:
    """Discount of counts 0 to 5 (entry 0 is unused); larger counts have none."""
    out = np.ones(DISCOUNTED + 1)
    common = (DISCOUNTED + 1) * n[DISCOUNTED] / n[0] if n[0] else 1.0
    for r in range(1, DISCOUNTED + 1):
        turing = (r + 1) * n[r] / n[r - 1] if n[r - 1] else 0.0
        katz = (turing / r - common) / (1 - common) if common < 1 else 0.0
        out[r] = katz if 0 < katz < 1 else (r - 0.5) / r
    return out


def discounted(c: Column, by: np.ndarray) -> Column:
    value = c.cast("double")
    for r in range(1, DISCOUNTED + 1):
        value = F.when(c == r, F.lit(float(by[r] * r))).otherwise(value)
    return value


def _collected(rows: DataFrame, *names: str) -> list[np.ndarray]:
    """Columns of a table of bounded size, ordered by the first."""
    table = rows.select(*names).toPandas().sort_values(names[0])
    return [table[n].to_numpy() for n in names]


@dataclass
class Model:
    """What every task needs; no part has more than 1 / ``FREQUENT`` or 1 / ``VOCABULARY`` entries."""

    tokens: int
    kinds: int
    classes: np.ndarray | None  # words that are themselves in bigrams, sorted; None if all are
    words: np.ndarray  # frequent words, sorted by hash, their counts and values
    word_c: np.ndarray
    word_v: np.ndarray
    unseen: float  # value of an unseen word
    start: float  # log10 weight of the start
    pairs: np.ndarray  # frequent bigrams, sorted by key, and their log10 gain over backing off
    pair_gain: np.ndarray


def _bigrams(tokens: np.ndarray, sizes: np.ndarray, classes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The word before each token and the token, as bigrams have them."""
    own = tokens
    if classes is not None:
        own = np.where(_find(classes, tokens.view(np.int64), -1) < 0, SHARED, tokens)
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[np.cumsum(sizes) - sizes] = START
    return before, own


_TURN = 23


def _pair_keys(before: np.ndarray, own: np.ndarray) -> np.ndarray:
    return own ^ ((before << np.uint64(_TURN)) | (before >> np.uint64(64 - _TURN)))


def _pair_key() -> Column:
    turned = F.shiftleft("before", _TURN).bitwiseOR(F.shiftrightunsigned("before", 64 - _TURN))
    return F.col("own").bitwiseXOR(turned)


def _signed(key: np.uint64) -> Column:
    return F.lit(int(key.astype(np.int64))).cast("bigint")


def _find(among: np.ndarray, keys: np.ndarray, missing: int) -> np.ndarray:
    """Place of each key in a sorted array."""
    if len(among) == 0:
        return np.full(len(keys), missing, np.int64)
    at = np.searchsorted(among, keys)
    at[at == len(among)] = 0
    return np.where(among[at] == keys, at, missing)


def _per_row(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, np.cumsum(sizes) - sizes)


def _lists(values: np.ndarray, chosen: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(_per_row(chosen.astype(np.int64), sizes))])
    return pa.ListArray.from_arrays(ends.astype(np.int32), values[chosen].astype(np.int64))


def _share(n: int, share: float) -> int:
    return max(1, int(np.ceil(share * n)))


def _joined(rows: DataFrame, facts: DataFrame, on: str) -> DataFrame:
    """``rows`` with the ``facts`` of their key, one row per key: those of frequent keys (``often``) are broadcast."""
    head = rows.join(F.broadcast(facts.filter("often")), on, "left")
    new = [c for c in facts.columns if c != on]
    rest = head.filter(F.col("often").isNull()).drop(*new).join(facts.filter(~F.col("often")), on)
    return head.filter("often").unionByName(rest).drop("often")


def fit(train: DataFrame) -> tuple[Model, DataFrame, DataFrame]:
    """Model, words ``key, c, value``, and rare bigrams ``key, gain`` over backing off (log10).

    A word's value is log10 P(word) and the log10 weight it gives to the next word's backing off.
    """
    counted = keep(word_counts(train), "counted")
    tokens, kinds, times = counts_of_counts(counted)
    by_word = discounts(times)
    least = _share(tokens, FREQUENT)
    own_p = discounted(F.col("c"), by_word) / F.lit(tokens + 1.0)
    left = 1.0 + sum(r * times[r - 1] * (1 - by_word[r]) for r in range(1, DISCOUNTED + 1))
    unseen = left / max(1.0, times[0] * (times[0] - 1) / (2 * times[1] + 2)) / (tokens + 1)
    if VOCABULARY:
        big = F.col("c") >= max(DISCOUNTED + 1, _share(tokens, VOCABULARY))
        classes, classes_c = _collected(counted.filter(big), "key", "c")
        shared = train.sparkSession.range(1).select(
            _signed(SHARED).alias("own"), F.lit((tokens - classes_c.sum() + 1.0) / (tokens + 1)).alias("p"),
        )
        p = counted.filter(big).select(F.col("key").alias("own"), own_p.alias("p")).unionByName(shared)
        p = p.withColumn("often", F.lit(True))
        as_before = F.when(big, F.col("key")).otherwise(_signed(SHARED))
        n_classes = len(classes) + 1
    else:
        classes, as_before, n_classes = None, F.col("key"), kinds + 1
        p = counted.select(F.col("key").alias("own"), own_p.alias("p"), (F.col("c") >= least).alias("often"))
    pairs = keep(pair_counts(train, classes), "pairs")
    by_pair = discounts(counts_of_counts(pairs)[2])
    split = keep(_joined(pairs, p, "own"), "split").withColumn("events", discounted(F.col("c"), by_pair))
    sums = split.groupBy("before").agg(
        F.sum("c").alias("c"), F.sum("events").alias("events"), F.sum("p").alias("p"), F.count(F.lit(1)).alias("k")
    )
    # After a word that all classes follow, nothing backs off.
    full = F.col("k") == n_classes
    divisor = F.when(full, F.col("events")).otherwise(F.col("c") + 1.0)
    weight = (1 - F.col("events") / (F.col("c") + 1.0)) / F.greatest(1 - F.col("p"), F.lit(1e-300))
    facts = keep(sums.select(
        "before", F.log10(divisor).alias("divisor"), F.when(full, 0.0).otherwise(F.log10(weight)).alias("weight"),
        (F.col("c") >= least).alias("often"),
    ), "facts")
    gain = F.log10("events") - F.col("divisor") - F.col("weight") - F.log10("p")
    gains = keep(_joined(split, facts, "before").select(_pair_key().alias("key"), "c", gain.alias("gain")), "gains")
    weights = facts.select("before", "weight")
    words = counted.withColumn("before", as_before).join(
        F.broadcast(weights) if VOCABULARY else weights, "before", "left"  # one row per class, or per word
    )
    towards = F.when(F.col("key") == _signed(END), 0.0).otherwise(F.coalesce("weight", F.lit(0.0)))
    words = keep(words.select("key", "c", (F.log10(own_p) + towards).alias("value")), "words")
    given = {r["before"]: r["weight"] for r in weights.filter(F.col("before").isin(
        *[int(k.astype(np.int64)) for k in (START, SHARED)])).collect()}
    often = F.col("c") >= least
    model = Model(
        tokens, kinds, classes, *_collected(words.filter(often), "key", "c", "value"),
        float(np.log10(unseen)) + given.get(int(SHARED.astype(np.int64)), 0.0),
        given.get(int(START.astype(np.int64)), 0.0), *_collected(gains.filter(often), "key", "gain"),
    )
    return model, words, gains.filter(~often).select("key", "gain")


def pair_counts(train: DataFrame, classes: np.ndarray | None) -> DataFrame:
    """``before, own, c`` of bigrams, counted in each task first."""
    shared = train.sparkSession.sparkContext.broadcast(classes)

    def run(batches):
        for _, tokens, sizes in _chunks(batches, 0):
            before, own = _bigrams(tokens, sizes, shared.value)
            _, at, times = np.unique(_pair_keys(before, own), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(before[at].view(np.int64)), pa.array(own[at].view(np.int64)), pa.array(times.astype(np.int64))],
                ["before", "own", "c"],
            )

    found = kernel(train.select("text"), run, "before bigint, own bigint, c bigint")
    return found.groupBy("before", "own").agg(F.sum("c").alias("c"))


def _parts(docs: DataFrame, held_out: Column, model: Model) -> DataFrame:
    """Per document what the frequent entries give, and the words and bigrams still to be joined."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches):
        m = Model(**shared.value)
        for rows, tokens, sizes in _chunks(batches, 2):
            keys = _pair_keys(*_bigrams(tokens, sizes, m.classes)).view(np.int64)
            at = _find(m.pairs, keys, -1)
            rare_pair = at < 0
            place = _find(m.words, tokens.view(np.int64), -1)
            rare_word = place < 0
            c = np.where(rare_word, 0, m.word_c[place] if len(m.words) else 0)
            score = np.where(rare_word, 0.0, m.word_v[place] if len(m.words) else 0.0)
            score[~rare_pair] += m.pair_gain[at[~rare_pair]]
            score[np.cumsum(sizes) - sizes] += m.start
            yield pa.RecordBatch.from_arrays(
                [*rows.columns[:2], pa.array(sizes.astype(np.int64)),
                 pa.array(_per_row((~rare_word).astype(np.int64), sizes)),
                 pa.array(_per_row(np.log10(c + 1.0), sizes)), pa.array(_per_row(score, sizes)),
                 _lists(tokens.view(np.int64), rare_word, sizes), _lists(keys, rare_pair, sizes)],
                ["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "words", "pairs"],
            )

    picked = docs.select(F.col("doc_id").cast("bigint"), held_out.alias("held_out"), "text")
    return kernel(picked, run, PARTS)


def score(docs: DataFrame, held_out: Column, model: Model, words: DataFrame, rare: DataFrame) -> DataFrame:
    """Each document's token counts and log10 probabilities under add-one unigrams and the model."""
    parts = keep(_parts(docs, held_out, model).withColumn("row", F.monotonically_increasing_id()), "parts")
    few = words.filter(F.col("c") < _share(model.tokens, FREQUENT))
    asked = parts.select("row", F.explode("words").alias("key")).join(few, "key", "left")
    by_word = asked.groupBy("row").agg(
        F.count("c").alias("known"), F.sum(F.log10(F.coalesce(F.col("c"), F.lit(0)) + 1.0)).alias("word_base"),
        F.sum(F.coalesce("value", F.lit(model.unseen))).alias("word_score"),
    )
    by_pair = (
        parts.select("row", F.explode("pairs").alias("key")).join(rare, "key")
        .groupBy("row").agg(F.sum("gain").alias("pair_score"))
    )
    none = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    joined = parts.drop("words", "pairs").join(by_word, "row", "left").join(by_pair, "row", "left")
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + none("word_base")
         - F.col("n_tokens") * F.log10(F.lit(float(model.tokens + model.kinds + 1)))).alias("base_score"),
        (F.col("score") + none("word_score") + none("pair_score")).alias("score"),
    )


# Training and scoring over one table: ``fit_and_score``.

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
PAIRS, WORDS = range(4), 4  # kinds of rows; a pair's kind is 2 (the word before is rare) + (the own word is rare)
_GROUP = 1 << 20  # tokens whose pairs are counted together
_SHARE = 1 << 18  # occurrences of a word whose pairs stay together
_ID_BITS = 20  # words above FREQUENT, and the start, have numbers below 2^20
ASKED = "part bigint, chunk bigint, kind int, n int, before binary, own binary, times binary, words array<bigint>"
TIMES = [f"n{r}" for r in range(1, DISCOUNTED + 2)]
ANSWERED = (
    "chunk bigint, part bigint, kind int, n int, data binary, words array<bigint>, before bigint, own bigint, c bigint, p double, "
    + ", ".join(f"{n} bigint" for n in TIMES)
)
SCORED = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
)
_CODEC = "zstd"


@contextmanager
def _short_lived_shuffles(spark) -> Iterator[None]:
    """Shuffle files of a written table go as soon as it is written, not when the driver collects garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def _numbered(batches, learn_at: int, text_at: int, hashed: bool = True):
    """Chunks that hold only documents to learn from, or none: (number, learnt from, rows, tokens, sizes).

    A chunk's number is made of the task's and its place in the task.
    """
    first, at = TaskContext.get().partitionId() << 32, 0
    for b in batches:
        for learn in (True, False):
            chosen = b.filter(b.column(learn_at) if learn else pc.invert(b.column(learn_at)))
            for rows, tokens, sizes in _chunks([chosen], text_at, hashed):
                yield first + at, learn, rows, tokens, sizes
                at += 1


def _squeezed(values: np.ndarray) -> bytes:
    """Longs as bytes, those of one place in a number side by side."""
    planes = values.astype(np.int64).view(np.uint8).reshape(-1, 8).T
    return pa.Codec(_CODEC).compress(planes.tobytes(), asbytes=True)


def _opened(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec(_CODEC).decompress(data, 8 * n, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(np.int64).ravel()


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct key stands once, in order of keys, and which of them each key is."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.append(np.ones(min(1, len(keys)), bool), ordered[1:] != ordered[:-1])
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def _keys(kind: int, before: np.ndarray, own: np.ndarray) -> np.ndarray:
    """One long per pair: of frequent words their numbers, else mixed with a hash."""
    if kind == 0:
        return before << _ID_BITS | own
    return _pair_keys(before.view(np.uint64), own.view(np.uint64)).view(np.int64)


def _pairs(tokens: np.ndarray, sizes: np.ndarray, m: dict) -> tuple[np.ndarray, list[tuple]]:
    """The words' places among the frequent ones, and by kind the chunk's distinct pairs in a fixed order.

    Of a kind: the tokens that end such a pair; words before, own words and parts of the distinct pairs, ordered by
    part; and which of these each token ends. Frequent words are their numbers, others their hashes. A word's pairs
    are in one part, those of a very frequent word in one for each ``_SHARE`` of its occurrences.
    """
    often, parts = m["often"], m["parts"]
    before, own = (x.view(np.int64) for x in _bigrams(tokens, sizes, None))
    place = _find(often, own, -1)
    previous = np.empty_like(place)
    previous[1:] = place[:-1]
    previous[np.cumsum(sizes) - sizes] = len(often)
    kinds, found = 2 * (previous < 0) + (place < 0), []
    for kind in PAIRS:
        at = np.flatnonzero(kinds == kind)
        a, b = (before if kind & 2 else previous)[at], (own if kind & 1 else place)[at]
        first, which = _distinct(_keys(kind, a, b))
        a, b, spread = a[first], b[first], m["spread"][previous[at[first]]].astype(np.uint64)
        part = mix(mix(a.view(np.uint64)) + mix(b.view(np.uint64)) % spread) % np.uint64(parts)
        order = np.argsort(part.astype(np.uint16 if parts <= 1 << 16 else np.int64), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        found.append((at, a[order], b[order], part[order].astype(np.int64), rank[which]))
    return place, found


def _sum_of(tokens: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(tokens).astype(np.int64))


def _asked(rows: DataFrame, m: dict) -> DataFrame:
    """What each chunk asks and teaches: by part its distinct pairs and their times (null if not learnt from), its rare words.

    The row of the words comes first, and its last entry is the checksum of the tokens.
    """
    shared = rows.sparkSession.sparkContext.broadcast(m)
    schema = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("kind", pa.int32()), ("n", pa.int32()), ("before", pa.binary()),
                        ("own", pa.binary()), ("times", pa.binary()), ("words", pa.list_(pa.int64()))])

    def run(batches):
        for number, learn, _, tokens, sizes in _numbered(batches, 1, 0):
            place, pairs = _pairs(tokens, sizes, shared.value)
            words = np.append(np.unique(tokens.view(np.int64)[place < 0]), _sum_of(tokens))
            yield pa.RecordBatch.from_pylist([{"part": ~number, "chunk": number, "kind": WORDS, "words": words}], schema)
            for kind, (_, before, own, part, which) in zip(PAIRS, pairs):
                times = np.bincount(which, minlength=len(part)) if learn else None
                starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
                yield pa.RecordBatch.from_pylist([
                    {"part": part[i], "chunk": number, "kind": kind, "n": j - i, "before": _squeezed(before[i:j]),
                     "own": _squeezed(own[i:j]), "times": _squeezed(times[i:j]) if learn else None}
                    for i, j in zip(starts, [*starts[1:], len(part)])
                ], schema)

    return kernel(rows.select("text", "learn"), run, ASKED)


def _counted_part(rows: pa.Table, names: np.ndarray, p: np.ndarray) -> pa.Table:
    """To each chunk how often its pairs of one part occur in all, in the chunk's order; sums over what follows a word.

    Rows without chunk are for sums: with an own word where its probability is still to be joined.
    """
    types = {"kind": pa.int32(), "n": pa.int32(), "data": pa.binary(), "words": pa.list_(pa.int64()), "p": pa.float64()}
    schema = pa.schema([(c.split()[0], types.get(c.split()[0], pa.int64())) for c in ANSWERED.split(", ")])
    found = []

    def add(size: int, **columns) -> None:
        found.append(pa.table([columns.get(f.name, pa.nulls(size, f.type)) for f in schema], schema=schema))

    for kind in (*PAIRS, WORDS):
        mine = rows.filter(pc.equal(rows["kind"], kind))
        if mine.num_rows == 0:
            continue
        if kind == WORDS:
            add(mine.num_rows, **{c: mine[c] for c in ("chunk", "part", "kind", "words")})
            continue
        sizes = mine["n"].to_pylist()
        before, own = (np.concatenate([_opened(d, n) for d, n in zip(mine[c].to_pylist(), sizes)]) for c in ("before", "own"))
        times = np.concatenate([
            np.zeros(n, np.int64) if d is None else _opened(d, n) for d, n in zip(mine["times"].to_pylist(), sizes)])
        first, which = _distinct(_keys(kind, before, own))
        c = np.bincount(which, times).astype(np.int64)
        ends = np.cumsum(sizes)
        told = [_squeezed(x) for x in np.split(c[which], ends[:-1])]
        add(mine.num_rows, data=pa.array(told, pa.binary()), **{x: mine[x] for x in ("chunk", "part", "kind", "n")})
        first, c = first[c > 0], c[c > 0]
        before, own = before[first], own[first]
        if kind < 2:
            before = names[before]
        known = np.zeros(len(own)) if kind & 1 else p[own]
        at, which = _distinct(before)
        add(len(at), before=pa.array(before[at]), c=pa.array(np.bincount(which, c, len(at)).astype(np.int64)),
            p=pa.array(np.bincount(which, known, len(at))),
            **{t: pa.array(np.bincount(which, c == r, len(at)).astype(np.int64)) for r, t in enumerate(TIMES, 1)})
        if kind & 1:
            add(len(own), before=pa.array(before), own=pa.array(own))
    return pa.concat_tables(found)


def _answered(asked: DataFrame, m: dict) -> DataFrame:
    shared = asked.sparkSession.sparkContext.broadcast((np.append(m["often"], START.astype(np.int64)), m["p"]))
    return asked.groupBy("part").applyInArrow(lambda rows: _counted_part(rows, *shared.value), ANSWERED)


def _scores(texts: pa.Table, told: pa.Table, m: dict) -> pa.Table:
    """A chunk's documents by what its pairs and rare words were answered."""
    of_kind = {k: told.filter(pc.equal(told["kind"], k)) for k in (*PAIRS, WORDS)}
    pieces = [pa.ipc.open_stream(d.as_buffer()).read_all() for d in texts.sort_by("piece")["data"]]
    rows = pa.concat_tables(pieces).combine_chunks() if pieces else None
    parts = [(tokens, sizes) for _, tokens, sizes in _chunks(rows.to_batches() if pieces else [], 0)]
    tokens, sizes = (np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.uint64), None)
    if [_sum_of(tokens)] != of_kind[WORDS]["checksum"].to_pylist() or not parts:
        raise ValueError("the rows were dealt out otherwise when they were read again")
    often, word_c, word_w = m["often"], m["c"], m["weight"]
    place, pairs = _pairs(tokens, sizes, m)
    words = told.filter(pc.is_valid(told["key"]))
    rare, rare_c, rare_w = (words[n].to_numpy() for n in ("key", "c", "weight"))
    order = np.argsort(rare)
    rare, rare_c, rare_w = rare[order], rare_c[order], rare_w[order]
    all_c, all_w = np.concatenate([word_c, rare_c, [0]]), np.concatenate([word_w, rare_w, [0.0]])
    asked = _find(rare, tokens.view(np.int64), -1)
    # A word never seen has the last entry: no occurrence and the weight one.
    own_at = np.where(place >= 0, place, np.where(asked >= 0, len(often) + asked, len(all_c) - 1))
    own_c = all_c[own_at]
    before_w, before_c = np.empty(len(tokens)), np.empty(len(tokens))
    before_w[1:], before_c[1:] = all_w[own_at][:-1], own_c[:-1]
    starts = np.cumsum(sizes) - sizes
    before_w[starts], before_c[starts] = m["start"], m["start_c"]
    pair_c = np.zeros(len(tokens), np.int64)
    for kind, (at, _, _, _, which) in zip(PAIRS, pairs):
        answers = of_kind[kind].sort_by("part")
        counts = [_opened(d, n) for d, n in zip(answers["data"].to_pylist(), answers["n"].to_pylist())]
        pair_c[at] = np.concatenate([*counts, np.empty(0, np.int64)])[which]
    cut = lambda n, by: n * by[np.where(n <= DISCOUNTED, n, 0)]
    by_word, by_pair = np.append(1.0, m["by_word"][1:]), np.append(1.0, m["by_pair"][1:])
    with np.errstate(divide="ignore"):
        seen = np.log10(cut(pair_c, by_pair)) - np.log10(before_c + 1.0)
        p = np.where(own_c > 0, np.log10(cut(own_c, by_word)) - np.log10(m["tokens"] + 1.0), m["unseen"])
    score = np.where(pair_c > 0, seen, before_w + p)
    base = _per_row(np.log10(own_c + 1.0), sizes) - sizes * np.log10(m["tokens"] + m["kinds"] + 1.0)
    return pa.table([
        rows.column(2), rows.column(3), pa.array(sizes.astype(np.int64)), pa.array(_per_row((own_c > 0).astype(np.int64), sizes)),
        pa.array(np.full(len(sizes), m["tokens"], np.int64)), pa.array(base), pa.array(_per_row(score, sizes)),
    ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def _written(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=_CODEC)) as stream:
        stream.write_batch(rows)
    return sink.getvalue().to_pybytes()


def fit_and_score(docs: DataFrame, held_out: Column) -> DataFrame:
    """The scores that a model of the rows where ``held_out`` is false gives to all rows.

    The same model as ``fit``, but no pair is moved twice: chunks of documents (about ``_CHUNK`` tokens) state their
    distinct pairs once, packed by part; a part's pairs are counted together, and each chunk is told the counts in the
    order in which it stated the pairs, which it makes again from its texts.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("bigint"), F.coalesce(~held_out, F.lit(False)).alias("learn"), "text",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
    )
    with _short_lived_shuffles(spark):
        counted = keep(word_counts(rows.filter("learn")), "counted")
        tokens, kinds, times = counts_of_counts(counted)
        by_word = discounts(times)
        least = _share(tokens, FREQUENT)
        own_p = discounted(F.col("c"), by_word) / F.lit(tokens + 1.0)
        left = 1.0 + sum(r * times[r - 1] * (1 - by_word[r]) for r in range(1, DISCOUNTED + 1))
        unseen = left / max(1.0, times[0] * (times[0] - 1) / (2 * times[1] + 2)) / (tokens + 1)
        often, p, c = _collected(counted.filter(F.col("c") >= least).select("key", own_p.alias("p"), "c"), "key", "p", "c")
        often, ends = often.astype(np.int64), c[often == END.astype(np.int64)]
        m = {
            "often": often, "p": p.astype(np.float64), "parts": -(-tokens // _GROUP) or 1,
            # The start occurs as often as the end; the last entry is for rare words.
            "spread": np.concatenate([c, ends[:1] if len(ends) else [0], [0]]).astype(np.int64) // _SHARE + 1,
        }
        answers = keep(_answered(_asked(rows, m), m), "answers")
        sums = answers.filter("chunk is null")
        rest = sums.filter("own is not null").join(counted.select(F.col("key").alias("own"), own_p.alias("q")), "own")
        sums = sums.filter("own is null").select("before", "c", "p", *TIMES)
        sums = sums.unionByName(rest.select("before", F.col("q").alias("p")), allowMissingColumns=True)
        sums = keep(sums.groupBy("before").agg(*[
            F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("c", "p", *TIMES)
        ]), "sums")
        found = sums.agg(*[F.coalesce(F.sum(n), F.lit(0)) for n in TIMES]).first()
        by_pair = discounts(list(found))
        lost = sum((F.col(f"n{r}") * float(r * (1 - by_pair[r])) for r in range(1, DISCOUNTED + 1)), F.lit(0.0))
        share = (F.col("c") - lost) / (F.col("c") + 1.0)
        weights = sums.select(
            F.col("before").alias("key"), F.col("c").alias("start_c"),
            F.log10((1 - share) / F.greatest(1 - F.col("p"), F.lit(1e-300))).alias("weight"),
        )
        start = weights.filter(F.col("key") == _signed(START)).first()
        facts = keep(counted.join(weights.drop("start_c"), "key", "left").select(
            "key", "c", F.coalesce("weight", F.lit(0.0)).alias("weight")), "facts")
        few = facts.filter(F.col("c") < least)
        asked = answers.filter(F.col("kind") == WORDS)
        stated = F.explode(F.slice("words", 1, F.size("words") - 1)).alias("key")
        words = asked.select("chunk", stated).join(few, "key").select("chunk", "key", "c", "weight")
        told = answers.filter("kind is not null").select(
            "chunk", "part", "kind", "n", "data", F.element_at("words", -1).alias("checksum"))
        names, word_c, word_w = _collected(facts.filter(F.col("c") >= least), "key", "c", "weight")
    shared = spark.sparkContext.broadcast({
        **m, "often": names.astype(np.int64), "c": word_c.astype(np.int64), "weight": word_w.astype(np.float64),
        "tokens": tokens, "kinds": kinds, "by_word": by_word, "by_pair": by_pair, "unseen": float(np.log10(unseen)),
        "start": start["weight"] if start else 0.0, "start_c": start["start_c"] if start else 0,
    })

    def dealt(batches):
        for number, _, found, _, sizes in _numbered(batches, 1, 0, hashed=False):
            starts = np.flatnonzero(np.diff(np.cumsum(sizes) // _PIECE, prepend=-1))
            pieces = [_written(found.slice(i, j - i)) for i, j in zip(starts, [*starts[1:], len(sizes)])]
            for piece, data in enumerate(pieces):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.array([piece]), pa.array([data], pa.binary())], ["chunk", "piece", "data"])

    texts = kernel(rows.select("text", "learn", "doc_id", "held_out"), dealt, "chunk bigint, piece bigint, data binary")
    told = told.unionByName(words, allowMissingColumns=True)
    return texts.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(lambda a, b: _scores(a, b, shared.value), SCORED)
