"""Near-duplicate documents: banded MinHash, sequential Bayesian pruning, exact check, components.

1. A document's shingle set gives 64-bit hashes, ``BANDS`` band keys of ``ROWS`` MinHash values
   and a signature with a byte of each value. Documents with equal sets are one node.
2. Nodes that share a band key form a bucket; buckets with the same nodes are one bucket. Each
   node is compared with its bucket's smallest node: a bucket of m nodes makes m - 1 pairs.
3. Pairs are compared signature batch by signature batch. With m matches in k values and a
   uniform prior, the posterior probability of a similarity of at least the threshold is the
   binomial tail P(Bin(k + 1, t) <= m); a pair is dropped once it falls below ``MISS``.
4. What is left is checked on the full sets. Linked nodes get a common label.
5. In a bucket that still holds several labels, the nodes outside its largest label are compared
   with all nodes of other labels, in blocks of about ``BLOCK`` against ``BLOCK`` nodes inside a
   task: signatures first, then the full sets. Nodes with one label need no more comparing, and
   one link to a label is enough: no link between labels is lost, no task holds a whole bucket,
   and no pair is sent on that is not linked.

Chance of missing a link at exactly the threshold of 0.8 in all bands: (1 - 0.8^7)^48 = 1.2e-5.

Defined cases: null or empty text and text without words has no shingle and is linked with
nothing; with fewer words than a shingle the whole sequence is the one shingle; a row without
id has no component and is kept; rows that share an id are judged each by its text; other
columns are left alone; a text of any length is one set.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, keep, kernel, mix, raw, seeds, windows
from .urls import block_count, bloom_filter, probe

BANDS, ROWS = 48, 7
VALUES = BANDS * ROWS
WIDTH = 5
THRESHOLD = 80  # per cent
MISS = 1e-5
BATCH = 48
BLOCK = 256

SKETCH = "doc_id bigint, n_shingles bigint, node bigint, proof bigint, bands array<bigint>"
FULL = "node bigint, signature binary, text binary"


class Shingler:
    """Sets of shingle hashes, sorted."""

    def __init__(self, width: int):
        self.width, self.hashes = width, WordHashes()

    def __call__(self, text: bytes) -> np.ndarray:
        return np.unique(windows(self.hashes(text.lower().split()), self.width))


class MinHash:
    """The smallest value of a set under each of ``VALUES`` permutations of 32-bit numbers."""

    def __init__(self):
        self.flip = (seeds(VALUES, 1) >> np.uint64(32)).astype(np.uint32)[:, None]
        self.times = (seeds(VALUES, 2) >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)
        self.room = np.empty((VALUES, 256), np.uint32)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        values = (mix(shingles) >> np.uint64(32)).astype(np.uint32)
        least = np.full(VALUES, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(values), 256):
            part = values[at : at + 256]
            room = self.room[:, : len(part)]
            np.bitwise_xor(part, self.flip, out=room)
            np.multiply(room, self.times, out=room)
            np.minimum(least, room.min(axis=1), out=least)
        return least


def node_of(shingles: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit hashes of a set."""
    one = mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    two = mix(shingles ^ np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
    return tuple(int(x) for x in mix(np.array([one, two])).view(np.int64))


def band_keys(least: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = mix(key + column.astype(np.uint64))
    return key.view(np.int64)


def sketch(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        shingler, minhash = Shingler(width), MinHash()
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                rows, keys, ends = [], [], [0]
                for text in raw(part.column(1)):
                    shingles = shingler(text)
                    rows.append((len(shingles), *node_of(shingles)))
                    if len(shingles):
                        keys.append(band_keys(minhash(shingles)))
                    ends.append(len(keys) * BANDS)
                columns = np.array(rows, np.int64).reshape(-1, 3).T
                flat = np.concatenate([*keys, np.empty(0, np.int64)])
                bands = pa.ListArray.from_arrays(np.array(ends, np.int32), flat)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *map(pa.array, columns), bands],
                    ["doc_id", "n_shingles", "node", "proof", "bands"],
                )

    return kernel(docs.select(F.col("doc_id").cast("bigint"), "text"), run, SKETCH)


def nodes_of(sketched: DataFrame) -> DataFrame:
    """One row per set. Two sets with one node number would stop the job."""
    same = F.min("proof") == F.max("proof")
    return (
        sketched.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
        .groupBy("node")
        .agg(
            F.when(same, F.min("doc_id"))
            .otherwise(F.raise_error(F.lit("two shingle sets have one hash")).cast("bigint")).alias("doc_id"),
            F.first("bands").alias("bands"),
        )
    )


def bucket_members(banded: DataFrame) -> DataFrame:
    """``key, node, centre, n`` for one bucket of each group of nodes that share a band key."""
    rows = banded.select("node", F.explode("bands").alias("key"))
    buckets = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("node").alias("centre"),
        F.bit_xor(F.xxhash64("node")).alias("one"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("two"),
    )
    different = (
        buckets.filter("n > 1").groupBy("n", "centre", "one", "two").agg(F.min("key").alias("key"))
        .select("key", "centre", "n")
    )
    return rows.join(different, "key")


def full_texts(docs: DataFrame, banded: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """``node, signature, text`` of the nodes in buckets.

    A blocked Bloom filter of bounded size keeps the texts of most other documents in place.
    """
    wanted = members.select("node").distinct()
    chosen = keep(banded.select("node", "doc_id").join(wanted, "node"), "chosen")
    blocks = block_count(chosen.count())
    held = probe(docs.select(F.col("doc_id").cast("bigint"), "text"), "doc_id",
                 bloom_filter(chosen, "doc_id", blocks), blocks)

    def run(batches):
        shingler, minhash = Shingler(width), MinHash()
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                texts = raw(b.column(1).slice(at, 1024))
                sets = [shingler(text) for text in texts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([node_of(s)[0] for s in sets], pa.int64()),
                     pa.array([minhash(s).astype(np.uint8).tobytes() for s in sets], pa.binary()),
                     pa.array(texts, pa.binary())],
                    ["node", "signature", "text"],
                )

    found = kernel(held.filter("_maybe").select("doc_id", "text"), run, FULL)
    one = found.groupBy("node").agg(F.first("signature").alias("signature"), F.first("text").alias("text"))
    return one.join(chosen.select("node"), "node")


def least_matches(threshold: float, miss: float) -> list[tuple[int, int]]:
    """(values compared, matches needed) after each batch."""
    same = threshold + (1 - threshold) / 256  # a byte also agrees by chance
    out = []
    for k in range(BATCH, VALUES + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += comb(k + 1, m) * same**m * (1 - same) ** (k + 1 - m)
        out.append((k, m))
    return out


def survivors(a: np.ndarray, b: np.ndarray, needed: list[tuple[int, int]]) -> np.ndarray:
    """Numbers of the pairs ``a[i], b[i]`` that no batch has ruled out."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    done = 0
    for k, least in needed:
        matches = matches + (a[alive, done:k] == b[alive, done:k]).sum(axis=1)
        alive, matches, done = alive[matches >= least], matches[matches >= least], k
    return alive


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, VALUES)


def pruned(pairs: DataFrame, full: DataFrame, threshold: int) -> DataFrame:
    """The pairs ``a, b`` whose signatures don't rule out a link."""
    needed = least_matches(threshold / 100, MISS)
    of = lambda name: full.select(F.col("node").alias(name), F.col("signature").alias(f"{name}_signature"))

    def run(batches):
        for b in batches:
            left = survivors(_signatures(b.column(2)), _signatures(b.column(3)), needed)
            yield b.select(["a", "b"]).take(pa.array(left))

    joined = pairs.join(of("b"), "b").join(of("a"), "a")
    return kernel(joined.select("a", "b", "a_signature", "b_signature"), run, "a bigint, b bigint")


def linked(pairs: DataFrame, full: DataFrame, width: int, threshold: int) -> DataFrame:
    """The pairs ``a, b`` that are linked by their full sets."""
    of = lambda name: full.select(F.col("node").alias(name), F.col("text").alias(f"{name}_text"))

    def run(batches):
        shingler, last, mine = Shingler(width), None, None
        for batch in batches:
            links = []
            for a, b, a_text, b_text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if a != last:
                    last, mine = a, shingler(a_text)
                other = shingler(b_text)
                common = len(np.intersect1d(mine, other, assume_unique=True))
                if 100 * common >= threshold * (len(mine) + len(other) - common):
                    links.append((a, b))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"]
            )

    joined = pairs.join(of("b"), "b").join(of("a"), "a")
    return kernel(joined.select("a", "b", "a_text", "b_text"), run, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """``node, label``: the smallest node that can be reached, for all nodes with a link.

    Each round takes the smallest label next door, then the label of that label.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = keep(both, "edges")
    labels = keep(
        edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels"
    )
    while True:
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a")).select(
            "node", "label", F.least("label", "near").alias("near")
        )
        ahead = labels.select(F.col("node").alias("at"), F.col("label").alias("far"))
        moved = lower.join(ahead, F.col("near") == F.col("at"), "left").select(
            "node", F.least("near", F.coalesce("far", "near")).alias("label"), F.col("label").alias("before")
        )
        moved = keep(moved, "labels")
        if moved.filter(F.col("label") != F.col("before")).isEmpty():
            return moved.select("node", "label")
        labels = moved.select("node", "label")


def _role(block: int, n: str) -> tuple:
    """Own block and number of blocks of a node among ``n``."""
    blocks = F.ceil(F.col(n) / F.lit(block)).cast("bigint")
    return F.pmod(F.xxhash64("node"), blocks), F.sequence(F.lit(0).cast("bigint"), blocks - 1)


def across_labels(members: DataFrame, labels: DataFrame, full: DataFrame, width: int, threshold: int) -> DataFrame:
    """Links ``a, b`` between nodes of one bucket that have different labels.

    A node that is linked to a label needs no second link to it, so in each block one is given.
    """
    # In a bucket of two, the one pair has been compared.
    named = members.filter("n > 2").select("key", "node", "n").join(labels, "node", "left").withColumn(
        "label", F.coalesce("label", "node")
    )
    sizes = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("size"))
    mixed = (
        sizes.groupBy("key").agg(
            F.max(F.struct("size", "label")).alias("largest"), F.sum("size").alias("all"), F.count(F.lit(1)).alias("k")
        )
        .filter("k > 1")
        .select("key", F.col("largest.label").alias("main"), (F.col("all") - F.col("largest.size")).alias("outside"))
    )
    rows = named.join(mixed, "key")
    own, every = _role(BLOCK, "n")
    own_out, every_out = _role(BLOCK, "outside")
    asked = rows.select(
        "key", "node", "label", F.lit(False).alias("asks"), own.alias("block"), F.explode(every_out).alias("row")
    ).unionByName(
        rows.filter(F.col("label") != F.col("main")).select(
            "key", "node", "label", F.lit(True).alias("asks"), F.explode(every).alias("block"), own_out.alias("row")
        )
    )
    whole = asked.join(full, "node").withColumn("group", F.xxhash64("key", "block", "row"))
    # Groups are small, so whole ones are dealt out and each task runs through its groups.
    dealt = whole.select("group", "node", "label", "asks", "signature", "text").repartition("group")
    dealt = dealt.sortWithinPartitions("group")

    def run(batches):
        compare = BlockComparison(width, threshold)
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            # A batch may end within a group: that group waits for the next batch.
            groups = batch.column(0).to_numpy()
            open_at = int(np.argmax(groups == groups[-1]))
            if open_at or (held and held[-1].column(0)[0] != batch.column(0)[0]):
                yield compare(pa.Table.from_batches([*held, batch.slice(0, open_at)]))
                held = [batch.slice(open_at)]
            else:
                held.append(batch)
        if held:
            yield compare(pa.Table.from_batches(held))

    return kernel(dealt, run, "a bigint, b bigint").distinct()


class BlockComparison:
    """Links in blocks of askers and others that arrive as the rows of a group."""

    def __init__(self, width: int, threshold: int):
        self.shingler, self.threshold = Shingler(width), threshold
        self.needed = least_matches(threshold / 100, MISS)

    def __call__(self, rows: pa.Table) -> pa.RecordBatch:
        groups, self.node, self.label, asks = (rows.column(i).to_numpy() for i in range(4))
        self.signature, self.text = _signatures(rows.column(4)), rows.column(5)
        cuts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1], [True]]))
        links = []
        for start, stop in zip(cuts[:-1], cuts[1:]):
            self.sets: dict[int, np.ndarray] = {}
            others = start + np.flatnonzero(~asks[start:stop])
            for one in start + np.flatnonzero(asks[start:stop]):
                links += self._links(one, others[self.label[others] != self.label[one]])
        return pa.RecordBatch.from_arrays(
            [pa.array([f(x) for x in links], pa.int64()) for f in (min, max)], ["a", "b"]
        )

    def _set(self, row: int) -> np.ndarray:
        found = self.sets.get(row)
        if found is None:
            found = self.sets[row] = self.shingler(self.text[row].as_py())
        return found

    def _links(self, one: int, rest: np.ndarray) -> list[tuple[int, int]]:
        alike = survivors(
            np.broadcast_to(self.signature[one], (len(rest), VALUES)), self.signature[rest], self.needed
        )
        rest = rest[alike]
        if len(rest) == 0:
            return []
        mine, sets = self._set(int(one)), [self._set(int(r)) for r in rest]
        sizes = np.array([len(x) for x in sets])
        every = np.concatenate(sets)
        at = np.searchsorted(mine, every)
        at[at == len(mine)] = 0
        common = np.add.reduceat((mine[at] == every).astype(np.int64), np.cumsum(sizes) - sizes)
        rest = rest[100 * common >= self.threshold * (len(mine) + sizes - common)]
        _, first = np.unique(self.label[rest], return_index=True)
        return [(int(self.node[one]), int(self.node[r])) for r in rest[first]]


def near_duplicates(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``."""
    sketched = keep(sketch(docs, width), "sketch")
    banded = keep(nodes_of(sketched), "nodes")
    members = keep(bucket_members(banded), "members")
    full = keep(full_texts(docs, banded, members, width), "full")
    stars = members.filter(F.col("node") != F.col("centre")).select(
        F.col("centre").alias("a"), F.col("node").alias("b")
    ).distinct()
    links = keep(linked(keep(pruned(stars, full, threshold), "pairs"), full, width, threshold), "links")
    labels = components(links)
    rest = keep(across_labels(members, labels, full, width, threshold), "links")
    if not rest.isEmpty():
        labels = components(links.unionByName(rest))
    return _answer(sketched, banded, labels)


def _answer(sketched: DataFrame, banded: DataFrame, labels: DataFrame) -> DataFrame:
    ids = banded.select("node", "doc_id").join(labels, "node", "left").withColumn(
        "label", F.coalesce("label", "node")
    )
    smallest = ids.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    by_node = ids.join(smallest, "label").select("node", "component_id")
    plain = sketched.select("doc_id", "n_shingles", "node")
    some = plain.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).join(by_node, "node")
    none = plain.filter((F.col("n_shingles") == 0) | F.col("doc_id").isNull()).withColumn(
        "component_id", F.col("doc_id")
    )
    return some.unionByName(none.select(*some.columns)).select(
        "doc_id", "n_shingles", "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
