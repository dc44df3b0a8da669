"""Benchmark decontamination over templates.

Numbers, quantities, units and names become typed placeholders, a run of names or of numbers in a sentence one,
so a question with new numbers or names has the template of the old one. Windows of ``WIDTH`` template tokens
are hash-joined with those of the benchmark. Along one alignment of a document and an item, a value of the
item stands for its most frequent partner in the document; a partner that stands for two values counts only
where it equals the item's. Windows with any other pair are left out, but those whose values are equal
always count. Beside the templates, windows of ``WIDTH`` plain words find copies in any letter case.

A document is contaminated if alignments of templates or of plain words cover at least ``COVERED`` of an
item's windows of that kind, or if plain windows make a passage of ``PASSAGE`` words or more.

A capital makes a word a name within a sentence; at its start only if the word is a name elsewhere in the
text and never stands there in lower case. Titles such as "Mr." end no sentence. Words all in capitals
are no names.

A bitmap of fixed size, with two bits per benchmark window, keeps other windows from being sent to
the join. Template windows need ``LITERAL`` literal tokens, or they would fit any list of names or numbers;
an item shorter than a window is one window, and one of fewer than ``LITERAL`` words is found only as a
whole document.

Defined cases: null and empty texts have no window and are clean; items with one id are told apart by
their text; rows that share an id are judged each by its text; other columns are left alone; texts may
be of any length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Known, keep, kernel, mix, packed, raw, unpacked, windows
from .urls import block_count, bloom_filter, probe

WIDTH = 8
LITERAL = 4
COVERED = 0.5
PASSAGE = 13

# Units of measure, money and time.
UNITS = frozenset(
    b"mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t oz lb lbs pound pounds "
    b"ml l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hr hour hours "
    b"day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents "
    b"percent degree degrees c f k".split()
)
# Number words and titles.
NUMBER_WORDS = frozenset(
    b"zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
    b"seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million "
    b"billion".split()
)
TITLES = frozenset(b"mr. mrs. ms. dr. prof. st.".split())
_NUMBER = re.compile(rb"[+-]?[$]?\d+(?:[.,:/]\d+)*%?\Z")
_QUANTITY = re.compile(rb"[$]?\d+(?:[.,]\d+)*[a-zA-Z]{1,4}\Z")
_TRIM = b".,;:!?()[]{}\"'"

# Low bits of a coded word: its kind, whether it begins with a capital or a small letter, whether it ends a sentence.
_NUMBERS, _QUANTITIES, _UNITS, _NAMES = 1, 2, 3, 4
_KIND, _CAPITAL, _SMALL, _STOP = 7, 8, 16, 32
_HASH = np.uint64(~63 & (1 << 64) - 1)
_PLACEHOLDERS = np.array([0] + [xxhash.xxh3_64_intdigest(b"<%d>" % k) for k in range(1, 5)], np.uint64)
PLAIN, TEMPLATE = 0, 1
_BITS = (8, 27)
_PORTION = 1 << 20


def _code(word: bytes) -> int:
    core = word.strip(_TRIM)
    head = core.decode("utf-8", "replace")
    low = head.lower().encode()
    kind = 0
    if core[:1].isdigit() or core[1:2].isdigit():
        kind = _NUMBERS if _NUMBER.match(core) else _QUANTITIES if _QUANTITY.match(core) else 0
    elif low in UNITS:
        kind = _UNITS
    elif low in NUMBER_WORDS or b"-" in low and all(part in NUMBER_WORDS for part in low.split(b"-")):
        kind = _NUMBERS
    flags = kind
    if word[-1:] in b".!?" and word.lower() not in TITLES:
        flags |= _STOP
    if not kind and head[:1].isupper() and not (head.isupper() and len(head) > 1):
        flags |= _CAPITAL
    elif head[:1].islower():
        flags |= _SMALL
    return xxhash.xxh3_64_intdigest(low) & ~63 | flags


class _Tokens:
    """Plain words and template tokens of some texts, one after the other."""

    def __init__(self, texts: list[bytes], codes: Known):
        split = [text.split() for text in texts]
        self.sizes = np.array([len(words) for words in split], np.int64)
        self.words = [word for words in split for word in words]
        coded = np.fromiter(map(codes.__getitem__, self.words), np.uint64, len(self.words))
        self.where = np.repeat(np.arange(len(texts)), self.sizes)
        self.plain = coded & _HASH
        flags = (coded & np.uint64(63)).astype(np.int64)
        kind = flags & _KIND
        starts = np.ones(len(flags), bool)
        starts[1:] = ((flags[:-1] & _STOP) > 0) | (self.where[1:] != self.where[:-1])
        kind[self._names(flags, starts)] = _NAMES
        runs = starts.copy()
        runs[1:] |= (kind[1:] != kind[:-1]) | ((kind[1:] != _NUMBERS) & (kind[1:] != _NAMES))
        self.first = np.flatnonzero(runs)
        self.slot = kind[self.first] > 0
        self.template = np.where(self.slot, _PLACEHOLDERS[kind[self.first]], self.plain[self.first])

    def _names(self, flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
        capital = (flags & _CAPITAL) > 0
        names = capital & ~starts
        at = np.flatnonzero(capital & starts)
        keys = self.plain ^ mix(self.where.astype(np.uint64) + np.uint64(1))
        known = np.unique(keys[names])
        at = at[np.isin(keys[at], known)]
        if len(at):
            asked, small = np.unique(keys[at]), keys[(flags & _SMALL) > 0]
            place = np.minimum(np.searchsorted(asked, small), len(asked) - 1)
            common = np.zeros(len(asked), bool)
            common[place[asked[place] == small]] = True
            names[at[~common[np.searchsorted(asked, keys[at])]]] = True
        return names

    def windows(self, kind: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all runs of ``width``, where they begin and which of them are windows."""
        hashes, where = (self.plain, self.where) if kind == PLAIN else (self.template, self.where[self.first])
        if len(hashes) < width:
            return hashes[:0], where[:0], np.zeros(0, bool)
        good = where[width - 1 :] == where[: len(where) - width + 1]
        if kind == TEMPLATE:
            literal = np.concatenate([[0], np.cumsum(~self.slot)])
            good &= literal[width:] - literal[:-width] >= LITERAL
        elif width < LITERAL:
            good &= self.sizes[where[: len(good)]] == width
        return windows(hashes, width), where[: len(good)], good

    def begins(self, kind: int) -> np.ndarray:
        """Where each text begins."""
        where = self.where if kind == PLAIN else self.where[self.first]
        return np.searchsorted(where, np.arange(len(self.sizes)))

    def slots(self, kind: int, at: int, width: int) -> list[str]:
        """Values of the placeholders of a window."""
        if kind == PLAIN:
            return []
        ends = [*self.first[at + 1 : at + width + 1].tolist(), len(self.words)]
        return [
            b" ".join(w.strip(_TRIM) for w in self.words[self.first[at + k] : ends[k]]).decode("utf-8", "replace").lower()
            for k in range(width) if self.slot[at + k]
        ]


def _portions(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of about ``_PORTION`` bytes together, or one of more."""
    start, size = 0, 0
    for at, text in enumerate(texts):
        if at > start and size + len(text) > _PORTION:
            yield start, texts[start:at]
            start, size = at, 0
        size += len(text)
    if start < len(texts):
        yield start, texts[start:]


def item_windows(items: DataFrame) -> DataFrame:
    """Windows of the items, ``n`` of each kind; ``item`` numbers id and text."""

    def run(batches):
        codes = Known(_code)
        for b in batches:
            out = []
            for item, item_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), raw(b.column(2))):
                tokens = _Tokens([text], codes)
                for kind in (PLAIN, TEMPLATE) if tokens.words else ():
                    width = min(WIDTH, len(tokens.words if kind == PLAIN else tokens.first))
                    hashes, _, good = tokens.windows(kind, width)
                    keys, places = hashes.view(np.int64), np.flatnonzero(good)
                    out += [(item, item_id, kind, width, len(places), int(keys[p]), int(p), tokens.slots(kind, p, width))
                            for p in places]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)],
                ["item", "item_id", "kind", "width", "n", "hash", "place", "slots"],
            )

    named = items.select(
        F.xxhash64("item_id", "text").alias("item"), F.col("item_id").cast("bigint"), "text"
    ).distinct()
    return kernel(named, run, "item bigint, item_id bigint, kind int, width int, n bigint, hash bigint, place bigint, "
                              "slots array<string>")


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    down = np.uint64(64 - bits)
    return hashes >> down, mix(hashes) >> down


def bitmap(of_items: DataFrame) -> np.ndarray:
    """Bits of all window hashes: 512 a window, at least 2^8 and at most 2^27 in all (16 MB)."""
    n = of_items.count()
    bits = min(_BITS[1], max(_BITS[0], (512 * n).bit_length()))

    def run(batches):
        for b in batches:
            found = np.concatenate(_places(b.column(0).to_numpy().view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays(
                [pa.array((found >> np.uint64(6)).view(np.int64)), pa.array((found & np.uint64(63)).view(np.int64))],
                ["word", "bit"],
            )

    single = kernel(of_items.select("hash"), run, "word bigint, bit bigint")
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit").cast("int"))
    rows = single.groupBy("word").agg(F.bit_or(one).alias("bits")).toPandas()
    out = np.zeros(max(1, (1 << bits) >> 6), np.int64)
    if len(rows):
        out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint64)


def _in(map_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bits = (len(map_) * 64).bit_length() - 1
    hit = np.ones(len(hashes), bool)
    for at in _places(hashes, bits):
        hit &= (map_[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0
    return hit


def possible_windows(docs: DataFrame, map_: np.ndarray, asked: list[tuple[int, int]]) -> DataFrame:
    """Other columns of ``docs`` and ``found``: windows of the ``asked`` kinds and widths whose bits are all set."""
    shared = docs.sparkSession.sparkContext.broadcast(map_)
    others = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.select(*others).dtypes)
    schema += ", found array<struct<hash:bigint,place:bigint,kind:int,width:int,slots:array<string>>>"
    types = pa.list_(pa.struct([
        ("hash", pa.int64()), ("place", pa.int64()), ("kind", pa.int32()), ("width", pa.int32()),
        ("slots", pa.list_(pa.string())),
    ]))

    def run(batches):
        codes = Known(_code)
        for b in batches:
            found = [[] for _ in range(b.num_rows)]
            for at, texts in _portions(raw(b.column(len(others)))):
                tokens = _Tokens(texts, codes)
                for kind, width in asked:
                    hashes, where, good = tokens.windows(kind, width)
                    begins = tokens.begins(kind)
                    hits = np.flatnonzero(good)
                    hits = hits[_in(shared.value, hashes[hits])]
                    keys = hashes.view(np.int64)
                    for p in hits.tolist():
                        found[at + where[p]].append({
                            "hash": int(keys[p]), "place": int(p - begins[where[p]]), "kind": kind, "width": width,
                            "slots": tokens.slots(kind, p, width),
                        })
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, types)], [*others, "found"])

    return kernel(docs.select(*others, "text"), run, schema)


def _trusted(pairs: list[tuple[str, str]]) -> set[tuple[str, str]]:
    """Of all pairs along an alignment those that hold: each item value with its most frequent partner."""
    own: dict[str, str] = {}
    votes = Counter(pairs)
    for mine, theirs in sorted(votes, key=lambda x: (-votes[x], x[0] != x[1], x)):
        own.setdefault(mine, theirs)
    stands_for = Counter(own.values())
    return {(mine, theirs) for mine, theirs in own.items() if mine == theirs or stands_for[theirs] == 1}


def _longest(seen: list[dict]) -> int:
    """Words of the longest passage that windows cover without a gap."""
    begin = end = best = 0
    for place, width in sorted((w["place"], w["width"]) for w in seen):
        begin, end = begin if place <= end else place, place + width
        best = max(best, end - begin)
    return best


def _consistent(seen: list[dict]) -> list[int]:
    """Places of the windows of one alignment whose pairs are equal or all hold."""
    pairs = [list(zip(w["slots"], w["theirs"])) for w in seen]
    own = _trusted([x for of_window in pairs for x in of_window])
    return [
        w["place"] for w, of_window in zip(seen, pairs)
        if all(x in own for x in of_window) or all(mine == theirs for mine, theirs in of_window)
    ]


def alignments(found: DataFrame, of_items: DataFrame) -> DataFrame:
    """``row, item, item_id, kind, n, places, passage`` of alignments of a document and an item.

    An alignment has at most one window per place of its item.
    """
    asked = found.select("row", F.explode("found").alias("w")).select(
        "row", "w.hash", "w.kind", "w.width", F.col("w.place").alias("at"), F.col("w.slots").alias("theirs")
    )
    names = ["row", "item", "item_id", "kind", "n"]
    grouped = asked.join(of_items, ["hash", "kind", "width"]).groupBy(
        *names, (F.col("at") - F.col("place")).alias("shift")
    ).agg(F.collect_list(F.struct("place", "width", "slots", "theirs")).alias("seen"))

    def run(batches):
        for b in batches:
            kinds, every = b.column(3).to_pylist(), b.column(5).to_pylist()
            places = [_consistent(seen) for seen in every]
            passages = [_longest(seen) if kind == PLAIN else 0 for kind, seen in zip(kinds, every)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(places, pa.list_(pa.int64())), pa.array(passages, pa.int64())],
                [*names, "places", "passage"],
            )

    return kernel(grouped.select(*names, "seen"), run,
                  "row bigint, item bigint, item_id bigint, kind int, n bigint, places array<bigint>, passage bigint")


def coverage(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All documents with a row number, and ``row, item_id, covered, passage`` of each item and kind they hold."""
    of_items = keep(item_windows(items), "items")
    asked = [tuple(r) for r in of_items.select("kind", "width").distinct().collect()]  # two kinds, 1 to WIDTH
    found = possible_windows(docs, bitmap(of_items), sorted(asked))
    found = keep(found.withColumn("row", F.monotonically_increasing_id()), "found")
    covered = (
        alignments(found, of_items)
        .groupBy("row", "item", "item_id", "kind", "n")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("k"), F.max("passage").alias("passage"))
        .select("row", "item_id", (F.col("k") / F.col("n")).alias("covered"), "passage")
    )
    return found.drop("found"), covered


def judge(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The columns of ``docs`` but the text, with ``contaminated``, and the item covered most."""
    rows, covered = coverage(docs, items)
    best = covered.groupBy("row").agg(
        F.max(F.struct("covered", (-F.col("item_id")).alias("first"))).alias("best"),
        F.max("passage").alias("passage"),
    )
    long = F.coalesce(F.col("passage") >= PASSAGE, F.lit(False))
    share = F.coalesce("best.covered", F.lit(0.0))
    return rows.join(best, "row", "left").select(
        *[c for c in rows.columns if c != "row"], ((share >= COVERED) | long).alias("contaminated"),
        F.when(share > 0, -F.col("best.first")).alias("item_id"), share.alias("covered"),
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated; only rows that may be are moved."""
    keyed = packed(docs, "doc_id", "text").withColumn("_key", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    judged = judge(keyed.select("_key", "text"), items)
    bad = keep(judged.filter("contaminated").select("_key").distinct(), "contaminated")
    return unpacked(without(keyed, bad), docs, "doc_id", "text")


def without(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows whose ``_key`` is not in ``listed``, which a Bloom filter of bounded size decides for most."""
    blocks = block_count(listed.count())
    asked = probe(rows, "_key", bloom_filter(listed, "_key", blocks), blocks)
    sure = asked.filter(~F.col("_maybe"))
    return sure.unionByName(asked.filter("_maybe").join(listed, "_key", "left_anti")).drop("_maybe")
