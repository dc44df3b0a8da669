"""Language ID with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. An n-gram's vector binds (multiplies) its
letters' vectors, each permuted once more the further it stands from the last. A text's vector
bundles (adds) those of its n-grams, a language's prototype those of its texts; a text is given
the language whose prototype has the largest cosine.

Only sums of n-gram counts times fixed vectors are needed, so a batch counts its n-grams first,
in blocks of n-grams that bound both the counts and the vectors, however many letters a script has.
A prototype is a sum of integers: the same whatever the partitioning or order of rows.

Defined cases: a text that is null or has no letter is ``und`` with score 0; a cosine below 0
counts as 0; among equal cosines the first language name wins; rows without id, language or
text teach nothing; without any prototype all is ``und``; a text of any length is counted in
segments; repeated rows count, and are answered, once each; other columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kernel, quoted, seeds

DIM = 1024
UNKNOWN = "und"
MAX_LANGUAGES = 10_000

_SEGMENT = 1 << 17
_GROUP = 1 << 19
_DENSE = 1 << 23
_BLOCK = 1 << 13  # trigrams with vectors at a time
_CELLS = 1 << 22  # counts at a time


_known: dict = {}  # tables that a worker makes once


def _letters() -> np.ndarray:
    if "letters" not in _known:
        _known["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _known["letters"]


def _orders(dim: int) -> list[np.ndarray]:
    """The permutation, applied twice, once and not at all."""
    once = np.argsort(seeds(dim, 7))
    return [once[once], once, np.arange(dim)]


def _letter_vector(code: int, dim: int) -> np.ndarray:
    bits = np.unpackbits(seeds(dim // 64, (code + 1) * 0xD6E8FEB86659FD93).view(np.uint8))
    return bits.astype(np.float32) * 2 - 1


def _segments(texts: list[str | None]) -> list[tuple[int, str]]:
    """(row, lower-cased part); parts overlap so that each trigram is in exactly one of them."""
    out = []
    for row, text in enumerate(texts):
        text = (text or "").lower()
        for at in range(0, len(text), _SEGMENT):
            # One blank on both sides marks the ends of words.
            ahead = text[at - 1] if at else " "
            out.append((row, ahead + text[at : at + _SEGMENT + 1].ljust(min(len(text) - at, _SEGMENT) + 1)))
    return out


def _groups(segments: list[tuple[int, str]]):
    group, size = [], 0
    for segment in segments:
        if group and size + len(segment[1]) > _GROUP:
            yield group
            group, size = [], 0
        group.append(segment)
        size += len(segment[1])
    if group:
        yield group


def _counts(group: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigrams around each letter: the segment and number of each occurrence, and the trigrams' letters.

    A letter's neighbours are letters or the mark 0 for anything else.
    """
    parts = [np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32) for _, part in group]
    codes = np.concatenate(parts)
    where = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    present = np.zeros(0x110000, bool)
    present[codes] = True
    letters = np.flatnonzero(present & _letters())
    number = np.zeros(0x110000, np.int64)
    number[letters] = np.arange(1, len(letters) + 1)
    x, k = number[codes], len(letters) + 1
    inside = np.flatnonzero((x[1:-1] > 0) & (where[:-2] == where[2:]))
    grams = (x[inside] * k + x[inside + 1]) * k + x[inside + 2]
    if k**3 <= _DENSE:
        seen = np.zeros(k**3, bool)
        seen[grams] = True
        kinds = np.flatnonzero(seen)
        column = np.zeros(k**3, np.int64)
        column[kinds] = np.arange(len(kinds))
        columns = column[grams]
    else:
        kinds, columns = np.unique(grams, return_inverse=True)
    alphabet = np.concatenate([[-1], letters])
    return where[inside], columns, np.stack([kinds // k // k, kinds // k % k, kinds % k]), alphabet


def _gram_vectors(grams: np.ndarray, alphabet: np.ndarray, dim: int) -> np.ndarray:
    used, grams = np.unique(grams, return_inverse=True)
    letters = np.stack([_letter_vector(int(code), dim) for code in alphabet[used]])
    out = None
    for row, order in zip(grams.reshape(3, -1), _orders(dim)):
        bound = letters[:, order][row]
        out = bound if out is None else out * bound
    return out


def _bundles(texts: list[str | None], rows: np.ndarray, n: int, dim: int) -> np.ndarray:
    """Vectors of ``n`` bundles; text ``i`` goes to bundle ``rows[i]``."""
    out = np.zeros((n, dim))
    for group in _groups(_segments(texts)):
        where, columns, grams, alphabet = _counts(group)
        kinds = grams.shape[1]
        used, local = np.unique(rows[[row for row, _ in group]], return_inverse=True)
        size = min(_BLOCK, max(1, _CELLS // len(used)))
        if kinds > size:
            order = np.argsort(columns, kind="stable")
            where, columns = where[order], columns[order]
        for low in range(0, kinds, size):
            wide = min(size, kinds - low)
            # All occurrences of one block; they are in order where there are several.
            part = slice(*np.searchsorted(columns, [low, low + wide])) if kinds > size else slice(None)
            cells = local[where[part]] * wide + columns[part] - low
            table = np.bincount(cells, minlength=len(used) * wide).reshape(len(used), wide)
            out[used] += table.astype(np.float32) @ _gram_vectors(grams[:, low : low + wide], alphabet, dim)
    return out


def prototypes(docs: DataFrame, learn: Column, dim: int = DIM) -> list[tuple[str, np.ndarray]]:
    """Prototype per language of the rows for which ``learn`` holds, by name.

    Each task sends one vector per language, summed by Spark; what reaches the driver has as
    many rows as there are languages, of which more than ``MAX_LANGUAGES`` are refused.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & learn)

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            names, at = np.unique(np.array(b.column(0).to_pylist(), object), return_inverse=True)
            for name, vector in zip(names, _bundles(b.column(1).to_pylist(), at, len(names), dim)):
                sums[name] = sums.get(name, 0) + vector
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()),
             pa.array([v.astype(np.int64) for v in sums.values()], pa.list_(pa.int64()))],
            ["lang", "vector"],
        )

    parts = kernel(rows.select("lang", "text"), run, "lang string, vector array<bigint>")
    summed = (
        parts.select("lang", F.posexplode("vector").alias("at", "value"))
        .groupBy("lang", "at").agg(F.sum("value").alias("value"))
        .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("vector"))
        .select("lang", "vector.value")
    )
    found = summed.limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return sorted((r[0], np.array(r[1], float)) for r in found if any(r[1]))


def predict(docs: DataFrame, profiles: list[tuple[str, np.ndarray]]) -> DataFrame:
    """The columns of ``docs`` with ``lang_pred`` and ``score`` added; no shuffle."""
    names = np.array([name for name, _ in profiles] + [UNKNOWN], object)
    dim = len(profiles[0][1]) if profiles else DIM
    unit = np.array([v / np.linalg.norm(v) for _, v in profiles]).reshape(-1, dim)
    fields = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    text = [f.name for f in fields].index("text")
    schema = docs.select(*[quoted(f.name) for f in fields]).schema
    schema = schema.add("lang_pred", "string").add("score", "double")

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                texts = part.column(text).to_pylist()
                own = _bundles(texts, np.arange(len(texts)), len(texts), dim)
                size = np.linalg.norm(own, axis=1)
                if len(unit):
                    cosines = np.round(own @ unit.T / np.where(size > 0, size, 1)[:, None], 12)
                    best, score = cosines.argmax(1), np.clip(cosines.max(1), 0, 1)
                else:
                    best, score = np.zeros(len(texts), int), np.zeros(len(texts))
                best = np.where(size > 0, best, len(unit))
                score = np.where(size > 0, score, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(names[best], pa.string()), pa.array(score, pa.float64())],
                    [*part.schema.names, "lang_pred", "score"],
                )

    return docs.select(*[quoted(f.name) for f in fields]).mapInArrow(run, schema)
