"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every word slot has a sparse random index vector. A slot's context vector is the sum of the index
vectors of the words within ``REACH`` places of its occurrences, over the whole corpus. Words share
``SLOTS`` slots by hash, so the table of vectors has a fixed size; words of a telling shape
(symbols, capitals, the word before once more) have slots by shape. A document is the mean of its
words' vectors. A network of one hidden layer is trained with numpy on about ``SAMPLE`` labelled
documents at most, and a temperature fitted on a fifth of them that it has not seen calibrates it.

Defined cases: null and empty texts have the zero vector and are scored like others; rows without
id or label teach nothing; without any label, or with one class, the score is the share of label 1
(0.5 without labels); rows that share an id are scored each; other columns are left alone.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Known, keep, kernel, raw, seeds

SLOTS = 1 << 13
DIM = 64
NONZERO = 4
REACH = 2
SAMPLE = 20_000
HIDDEN = 32
CUT = 0.7

# Slots by shape; the words' own slots come after them.
START, SYMBOL, CAPITALS, AGAIN = range(4)
_OWN = 4
_SYMBOLS = re.compile(rb"[#*$%&|<>]")
_CHUNK = 1 << 20


def _slot(word: bytes) -> int:
    if _SYMBOLS.search(word):
        return SYMBOL
    core = word.strip(b".,;:!?\"'()")
    if len(core) > 1 and core.isupper():
        return CAPITALS
    return _OWN + xxhash.xxh3_64_intdigest(core.lower()) % (SLOTS - _OWN)


def index_vectors() -> np.ndarray:
    """``NONZERO`` entries of +1 or -1 per slot."""
    out = np.zeros((SLOTS, DIM), np.int8)
    picks = seeds(SLOTS * NONZERO, 11).reshape(SLOTS, NONZERO)
    for column in picks.T:
        at = (column % np.uint64(DIM)).astype(int)
        out[np.arange(SLOTS), at] = np.where(column >> np.uint64(63), 1, -1)
    return out


def _chunks(batches, text_at: int):
    """(rows, slots of all words, words per row); a repeat of the word before has its own slot."""
    slot = Known(_slot)
    for b in batches:
        texts, start, parts, size = raw(b.column(text_at)), 0, [], 0
        for at, text in enumerate(texts):
            words = text.split()
            slots = np.fromiter(map(slot.__getitem__, words), np.int64, len(words))
            own = slots >= _OWN
            slots[1:][own[1:] & (slots[1:] == slots[:-1])] = AGAIN
            parts.append(slots)
            size += len(slots)
            if size >= _CHUNK or at == len(texts) - 1:
                yield b.slice(start, at + 1 - start), np.concatenate(parts), np.array([len(p) for p in parts])
                start, parts, size = at + 1, [], 0


def context_vectors(docs: DataFrame) -> np.ndarray:
    """Context vectors of all slots. Each task sends its sums once: ``SLOTS`` rows at most."""
    names = [f"v{i}" for i in range(DIM)]

    def run(batches):
        index = index_vectors().astype(np.int32)
        sums, seen = np.zeros((SLOTS, DIM), np.int64), np.zeros(SLOTS, bool)
        places = [np.flatnonzero(index[s]) for s in range(SLOTS)]
        width = max(map(len, places))
        where = np.array([np.resize(p, width) for p in places])
        sign = np.take_along_axis(index, where, 1)
        for s, p in enumerate(places):
            sign[s, len(p) :] = 0
        for _, slots, sizes in _chunks(batches, 0):
            seen[slots] = True
            row = np.repeat(np.arange(len(sizes)), sizes)
            for step in range(1, REACH + 1):
                together = np.flatnonzero(row[step:] == row[:-step])
                left, right = slots[together], slots[together + step]
                for a, b in ((left, right), (right, left)):
                    for j in range(width):
                        flat = np.bincount(a * DIM + where[b, j], sign[b, j], SLOTS * DIM)
                        sums += flat.reshape(SLOTS, DIM).astype(np.int64)
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found.astype(np.int32)), *[pa.array(np.ascontiguousarray(c)) for c in sums[found].T]],
            ["slot", *names],
        )

    parts = kernel(docs.select("text"), run, "slot int, " + ", ".join(f"{n} bigint" for n in names))
    summed = parts.groupBy("slot").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    out = np.zeros((SLOTS, DIM))
    if len(summed):
        out[summed["slot"].to_numpy()] = summed[names].to_numpy(float)
    return out


def word_vectors(contexts: np.ndarray) -> np.ndarray:
    """Unit context vectors, with the slot's own index vector added."""
    size = np.linalg.norm(contexts, axis=1, keepdims=True)
    unit = contexts / np.where(size > 0, size, 1)
    return (unit + index_vectors() / np.sqrt(NONZERO)).astype(np.float32)


def features(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """The other columns of ``docs`` with ``features``, the mean vector of the text's words."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    others = [c for c in docs.columns if c != "text"]
    schema = docs.select(*others).schema.add("features", "binary")

    def run(batches):
        for rows, slots, sizes in _chunks(batches, len(others)):
            means = np.zeros((len(sizes), DIM), np.float32)
            filled = np.flatnonzero(sizes)
            starts = (np.cumsum(sizes) - sizes)[filled]
            if len(filled):
                for d in range(DIM):
                    means[filled, d] = np.add.reduceat(shared.value[slots, d], starts) / sizes[filled]
            yield pa.RecordBatch.from_arrays(
                [*rows.columns[:-1], pa.array([m.tobytes() for m in means], pa.binary())],
                [*others, "features"],
            )

    return docs.select(*others, "text").mapInArrow(run, schema)


class Network:
    """Standardised features, one hidden layer of rectifiers, one output, a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, epochs: int = 40):
        self.constant = None
        if len(y) == 0 or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return
        rng = np.random.default_rng(5)
        order = rng.permutation(len(y))
        x, y = x[order].astype(float), y[order].astype(float)
        held = max(1, len(y) // 5)
        self.mean, self.spread = x[held:].mean(0), x[held:].std(0) + 1e-6
        x = (x - self.mean) / self.spread
        self.parts = [
            rng.normal(0, np.sqrt(2 / DIM), (DIM, HIDDEN)), np.zeros(HIDDEN),
            rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1),
        ]
        first = [np.zeros_like(p) for p in self.parts]
        second = [np.zeros_like(p) for p in self.parts]
        step = 0
        for _ in range(epochs):
            for rows in np.array_split(held + rng.permutation(len(y) - held), max(1, (len(y) - held) // 128)):
                step += 1
                for p, g, m, v in zip(self.parts, self._gradients(x[rows], y[rows]), first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        # The temperature that makes the unseen fifth likeliest.
        logits = self._logits(x[:held])
        losses = {t: np.logaddexp(0, -np.where(y[:held] > 0, 1, -1) * logits / t).mean()
                  for t in np.geomspace(0.25, 8, 61)}
        self.temperature = min(losses, key=losses.get)

    def _logits(self, x: np.ndarray) -> np.ndarray:
        w, b, u, c = self.parts
        return np.maximum(x @ w + b, 0) @ u + c

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        w, b, u, c = self.parts
        hidden = np.maximum(x @ w + b, 0)
        error = (1 / (1 + np.exp(-np.clip(hidden @ u + c, -30, 30))) - y) / len(y)
        back = np.outer(error, u) * (hidden > 0)
        return [x.T @ back + 1e-4 * w, back.sum(0), hidden.T @ error + 1e-4 * u, error.sum(keepdims=True)]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        logits = self._logits((x - self.mean) / self.spread) / self.temperature
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(-1, DIM)


def fit(featured: DataFrame, labels: DataFrame, learn: Column) -> Network:
    """Train on about ``SAMPLE`` labelled documents at most, picked by the hashes of their ids.

    The share to pick follows from the number of labels, so no task sends more than its share. An
    id counts once: of several labels the greatest, of several texts the one with the smallest hash.
    """
    known = labels.filter(learn & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    share = min(1.0, SAMPLE / max(1, known.count()))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))
    picked = known.filter(place < F.lit(int(share * (1 << 32))))
    texts = featured.select("doc_id", "features").join(picked, "doc_id")
    one = F.min_by("features", F.struct(F.xxhash64("features"), F.col("features"))).alias("features")
    sample = texts.groupBy("doc_id", "quality").agg(one).toPandas()
    sample = sample.sort_values(["doc_id", "features", "quality"])
    return Network(_matrix(sample["features"]), sample["quality"].to_numpy(float))


def predict(featured: DataFrame, network: Network) -> DataFrame:
    """The columns of ``featured`` but the features, with ``score`` and ``predicted``."""
    others = [c for c in featured.columns if c != "features"]
    schema = featured.select(*others).schema.add("score", "double").add("predicted", "integer")

    def run(batches):
        for b in batches:
            score = network(_matrix(b.column(len(others)).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(score), pa.array((score >= CUT).astype(np.int32))],
                [*others, "score", "predicted"],
            )

    return featured.select(*others, "features").mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """The columns of ``docs`` but the text, with ``score`` and ``predicted``."""
    featured = keep(features(docs, word_vectors(context_vectors(docs))), "features")
    return predict(featured, fit(featured, labels, learn))
