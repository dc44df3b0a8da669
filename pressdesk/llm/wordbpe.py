"""BPE with word ends by speculation: longest matches are proposed, then checked pair by pair.

A text is cut at white space into chunks and these into words, as the vocabulary file's rules say
(NFC, lower case, letters, single digits, the rest; special tokens first). For all words of a
portion of text that are not known yet:

1. *Speculate.* Each word is covered from left to right by the longest token that matches. Only
   tokens that come out of their own letters as one token are proposed.
2. *Verify.* All pairs of neighbours are checked at once. A pair stays apart if no merge joins the
   two while they are built up: the tokens that stand at the border at any time, with the ranks of
   the merges that make them and take them up, decide that. If all pairs of a word stay apart,
   merging in rank order gives just these tokens.
3. *Merge.* The other words, and only they, are merged in rank order.

Decoding joins the tokens' strings by blanks, which is what a file without a decoder asks for.

Defined cases: null text is empty; an empty or blank text has no ids and the digests of nothing; a
text or word may be of any length (a portion holds one text at least, and merging takes n log n);
rows with equal or null ids are encoded each for itself; ids outside the vocabulary decode to
nothing, as do null ids; other columns are left alone. Of a table without rows comes one without.
What a task remembers is bounded by ``MEMO`` characters.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kernel, portions

END = "</w>"

# Code points that got their class after the Unicode version of the file's library.
NEWER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD-A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 "
    "10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 "
    "16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 "
    "1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED "
    "1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
# Lower case of letters newer than Python's tables (first, last, lower case of the first).
LOWER = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B),
    (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)
# A capital sigma is lowered without regard to its place in the word.
LOWERED = {ord("Σ"): "σ"} | {a + k: chr(low + k) for a, b, low in LOWER for k in range(b - a + 1)}

_NEWER = "".join(f"\\U{a:0>8}-\\U{b:0>8}" for a, b in ((r.split("-") * 2)[:2] for r in NEWER.split()))
_LETTER, _NUMBER = rf"[\p{{L}}--[{_NEWER}]]", rf"[\p{{N}}--[{_NEWER}]]"
# Fixed value: the file's splitting pattern.
WORDS = regex.compile(
    rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{_LETTER}+|{_NUMBER}"
    rf"|[^\p{{White_Space}}{_LETTER}{_NUMBER}]+"
)
# ``str.split`` also cuts at these four, which are no white space here.
SEPARATORS = "\x1c\x1d\x1e\x1f"
CHUNKS = regex.compile(r"\P{White_Space}+")

PORTION = 1 << 21
MEMO = 1 << 25
SLOTS = 1 << 18
WIDTHS = (8, 16, 48)
ROWS = 1 << 15
NEVER = 2**31 - 1
ENCODED = "doc_id bigint, n_tokens bigint, ids array<int>"
DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def letters() -> list[str]:
    """The printable character that stands for each byte: its own where it has one, else the next from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Tokens, merges, and for each token those at its edges while it is built up."""

    def __init__(self, tokens: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]):
        self.special = special
        self.strings = [b""] * (max([*tokens.values(), *special.values()]) + 1)
        for token, number in {**tokens, **special}.items():
            self.strings[number] = token.encode()
        pairs = [(tokens[a], tokens[b], tokens[a + b]) for a, b in merges]
        self.rank_of = {a << 32 | b: rank for rank, (a, b, _) in enumerate(pairs)}
        self.made = np.array([c for _, _, c in pairs], np.int64)
        self.rank = np.full(len(self.strings), -1, np.int32)
        self.rank[self.made] = np.arange(len(pairs))
        if len(np.unique(self.made)) < len(pairs) or any(max(self.rank[a], self.rank[b]) >= r for r, (a, b, _) in enumerate(pairs)):
            raise ValueError("each token must come from one merge, of tokens that come earlier")
        keys = np.array(sorted(self.rank_of), np.int64)
        self.keys, self.key_ranks = keys, np.array([self.rank_of[k] for k in keys.tolist()], np.int32)
        self.left, self.right = self._edges(pairs, 0), self._edges(pairs, 1)
        whole = self._sound(np.array(pairs, np.int64).reshape(-1, 3))
        self._tree(tokens, whole)
        self.inside = {t: n for t, n in tokens.items() if not t.endswith(END) and whole[n]}
        self.at_end = {t.removesuffix(END): n for t, n in tokens.items() if t.endswith(END) and whole[n]}
        self.longest = max(map(len, (*self.inside, *self.at_end)))
        self.inner_letter, self.last_letter = self._singles(tokens)

    def _edges(self, pairs: list[tuple], side: int) -> np.ndarray:
        """By step and token: the part at that edge, from the single letter up to the token; -1 after it."""
        chains = {}
        for token in range(len(self.strings)):
            chains[token] = [token]
        for pair in pairs:
            chains[pair[2]] = [*chains[pair[side]], pair[2]]
        out = np.full((max(map(len, chains.values())), len(chains)), -1, np.int32)
        for token, chain in chains.items():
            out[: len(chain), token] = chain
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, ``NEVER`` where there is none."""
        if not len(self.keys):
            return np.full(len(a), NEVER, np.int32)
        wanted = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.key_ranks[at], NEVER)

    def joined(self, left: np.ndarray, right: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether a merge crosses the border of each pair, with ``before`` one of a lower rank than that.

        The merge happens if both sides still stand at its rank. At equal ranks the leftmost goes
        first: the left side must outlast the merge, the right one must not be taken up earlier.
        """
        limit = np.full(len(left), NEVER, np.int32) if before is None else before
        out = np.zeros(len(left), bool)
        for i, edge in enumerate(self.right):
            a = edge[left]
            on = np.flatnonzero((a >= 0) & ~out)
            if not len(on):
                break
            next_a = self.right[i + 1][left[on]] if i + 1 < len(self.right) else np.full(len(on), -1)
            a, a_gone = a[on], np.where(next_a < 0, NEVER, self.rank[next_a])
            for j, edge_b in enumerate(self.left):
                b = edge_b[right[on]]
                some = np.flatnonzero(b >= 0)
                if not len(some):
                    break
                next_b = self.left[j + 1][right[on[some]]] if j + 1 < len(self.left) else np.full(len(some), -1)
                b_gone = np.where(next_b < 0, NEVER, self.rank[next_b])
                rank = self._ranks(a[some], b[some])
                met = (rank < limit[on[some]]) & (rank < a_gone[some]) & (rank <= b_gone)
                out[on[some[met]]] = True
        return out

    def _sound(self, pairs: np.ndarray) -> np.ndarray:
        """Which tokens come out as one token when their own letters are merged."""
        sound = np.ones(len(self.strings), bool)
        early = self.joined(pairs[:, 0], pairs[:, 1], np.arange(len(pairs), dtype=np.int32))
        for (a, b, made), crossed in zip(pairs.tolist(), early.tolist()):
            sound[made] = sound[a] and sound[b] and not crossed
        return sound

    def _tree(self, tokens: dict[str, int], whole: np.ndarray) -> None:
        """The tree of what may be proposed: steps by node and letter, and the token that ends at each node."""
        after: dict[int, int] = {}
        inner, last = [-1], [-1]
        for token, number in tokens.items():
            if not whole[number]:
                continue
            ends = token.endswith(END)
            node = 0
            for letter in token.removesuffix(END):
                node = after.setdefault(node << 16 | ord(letter), len(inner))
                if node == len(inner):
                    inner.append(-1)
                    last.append(-1)
            (last if ends else inner)[node] = number
        self.steps = np.array(sorted(after), np.int64)
        self.reached = np.array([after[k] for k in self.steps.tolist()], np.int64)
        self.token_inside, self.token_at_end = np.array(inner), np.array(last)

    @staticmethod
    def _singles(tokens: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of single letters, within a word and at its end."""
        out = np.full((2, 512), -1, np.int64)
        for letter in letters():
            out[:, ord(letter)] = tokens[letter], tokens[letter + END]
        return out[0], out[1]

    def propose(self, text: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest matches from left to right, for all words (rows of letters) at once.

        All words take a step through the tree together; a word that can't go on gives out the
        last token it passed and starts anew behind it. Single letters are tokens, so it always can.
        """
        out, counts = np.full(text.shape, -1, np.int64), np.zeros(len(text), np.int64)
        rows = np.flatnonzero(lengths > 0)
        node, at, best, behind = (np.zeros(len(rows), np.int64) for _ in range(4))
        while len(rows):
            ends = lengths[rows]
            step = node << 16 | text[rows, np.minimum(at, ends - 1)]
            found = np.minimum(np.searchsorted(self.steps, step), len(self.steps) - 1)
            on = (self.steps[found] == step) & (at < ends)
            at = at + on
            node = np.where(on, self.reached[found], node)
            token = np.where(at == ends, self.token_at_end[node], self.token_inside[node])
            hit = on & (token >= 0)
            best, behind = np.where(hit, token, best), np.where(hit, at, behind)
            stop = np.flatnonzero(~on)
            out[rows[stop], counts[rows[stop]]] = best[stop]
            counts[rows[stop]] += 1
            at[stop], node[stop] = behind[stop], 0
            left = np.ones(len(rows), bool)
            left[stop] = at[stop] < ends[stop]
            rows, node, at, best, behind = rows[left], node[left], at[left], best[left], behind[left]
        return out, counts

    def propose_long(self, word: str) -> np.ndarray:
        """The same for one long word."""
        out, at = [], 0
        while at < len(word):
            token = self.at_end.get(word[at:]) if len(word) - at <= self.longest else None
            stop = len(word) if token is not None else min(len(word) - 1, at + self.longest)
            while token is None and (token := self.inside.get(word[at:stop])) is None:
                stop -= 1
            out.append(token)
            at = stop
        return np.array(out, np.int64)

    def merge_rows(self, text: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges in rank order, the leftmost first, one merge in every word (row of letters) per round."""
        n, width = text.shape
        places = np.arange(width)
        parts = np.where(places < lengths[:, None] - 1, self.inner_letter[text], self.last_letter[text])
        ranks = np.full((n, width), NEVER, np.int32)
        row, at = np.nonzero(places < lengths[:, None] - 1)
        ranks[row, at] = self._ranks(parts[row, at], parts[row, at + 1])
        lengths, rows = lengths.copy(), np.arange(n)
        while True:
            at = ranks[rows].argmin(1)
            best = ranks[rows, at]
            some = best < NEVER
            rows, at, best = rows[some], at[some], best[some]
            if not len(rows):
                return parts, lengths
            behind = np.minimum(places + (places > at[:, None]), width - 1)
            moved = np.take_along_axis(parts[rows], behind, 1)
            moved[np.arange(len(rows)), at] = self.made[best]
            lengths[rows] -= 1
            behind = np.minimum(places + (places >= at[:, None]), width - 1)
            pairs = np.take_along_axis(ranks[rows], behind, 1)
            pairs[:, -1] = NEVER
            for side in (at - 1, at):
                on = np.flatnonzero((side >= 0) & (side < lengths[rows] - 1))
                pairs[on, side[on]] = self._ranks(moved[on, side[on]], moved[on, side[on] + 1])
            parts[rows], ranks[rows] = moved, pairs

    def merge(self, word: np.ndarray) -> np.ndarray:
        """The same for one long word, by a heap over linked places."""
        parts = [*self.inner_letter[word[:-1]].tolist(), int(self.last_letter[word[-1]])]
        n, rank_of, made = len(parts), self.rank_of, self.made.tolist()
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := rank_of.get(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j < 0 or rank_of.get(parts[i] << 32 | parts[j]) != rank:
                continue
            parts[i], parts[j], after[i] = made[rank], -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := rank_of.get(parts[a] << 32 | parts[b])) is not None:
                    heapq.heappush(heap, (r, a))
        return np.array([p for p in parts if p >= 0], np.int64)


def load(path: str) -> Vocabulary:
    """The vocabulary of a tokenizer file; one that asks for other rules is refused."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = spec["model"]
    if model["type"] != "BPE" or model["end_of_word_suffix"] != END or spec["decoder"] is not None:
        raise ValueError("not a BPE vocabulary with word ends and no decoder")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return Vocabulary(model["vocab"], merges, {t["content"]: t["id"] for t in spec["added_tokens"]})


def _size(chunks: set[str]) -> int:
    return sum(map(len, chunks)) + 64 * len(chunks)


class Codec:
    """Encoder and decoder of one task."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._letters = dict(enumerate(letters()))
        names = sorted(vocabulary.special, key=len, reverse=True)
        self._special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self._chunks: dict[str, bytes] = {}
        self._size = 0
        self._pairs, self._joined = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, bool)

    def _parts(self, chunk: str) -> list[str | int]:
        """Words of a chunk, and the numbers of special tokens between them."""
        if chunk.isascii() and chunk.isalpha():
            return [chunk.lower()]
        if self._special is None or "<" not in chunk:
            return WORDS.findall(self._normal(chunk))
        out, at = [], 0
        for found in self._special.finditer(chunk):
            out += WORDS.findall(self._normal(chunk[at : found.start()]))
            out.append(self.vocabulary.special[found.group()])
            at = found.end()
        return out + WORDS.findall(self._normal(chunk[at:]))

    @staticmethod
    def _normal(chunk: str) -> str:
        if chunk.isascii():
            return chunk.lower()
        return unicodedata.normalize("NFC", chunk).translate(LOWERED).lower()

    def _spelt(self, word: str) -> str:
        """The word's bytes as the vocabulary's characters."""
        if word.isascii() and word.isprintable():
            return word
        return word.encode().decode("latin-1").translate(self._letters)

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the tokens of each pair stay apart; verdicts are kept in a table of fixed size."""
        pairs, back = np.unique(left << 32 | right, return_inverse=True)
        slots = (pairs * 0x9E3779B1 >> 13) % SLOTS
        joined = self._joined[slots]
        unknown = np.flatnonzero(self._pairs[slots] != pairs)
        if len(unknown):
            joined[unknown] = self.vocabulary.joined(pairs[unknown] >> 32, pairs[unknown] & 0xFFFFFFFF)
            self._pairs[slots[unknown]], self._joined[slots[unknown]] = pairs[unknown], joined[unknown]
        return ~joined[back]

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of words as bytes: proposed and verified together, merged where that fails."""
        spelt = list(map(self._spelt, words))
        lengths = np.fromiter(map(len, spelt), np.int64, len(spelt))
        flat = np.frombuffer("".join(spelt).encode("utf-16-le"), np.uint16)
        begins = np.cumsum(lengths) - lengths
        out: list[bytes] = [b""] * len(words)
        for low, width in zip((0, *WIDTHS), WIDTHS):
            group = np.flatnonzero((lengths > low) & (lengths <= width))
            for at in range(0, len(group), ROWS):
                rows = group[at : at + ROWS]
                text = np.zeros((len(rows), width), np.int64)
                inside = np.arange(width) < lengths[rows, None]
                text[inside] = flat[(begins[rows, None] + np.arange(width))[inside]]
                for k, ids in zip(rows.tolist(), self._rows(text, lengths[rows])):
                    out[k] = ids
        for k in np.flatnonzero(lengths > WIDTHS[-1]).tolist():
            ids = self.vocabulary.propose_long(spelt[k])
            if not self._apart(ids[:-1], ids[1:]).all():
                ids = self.vocabulary.merge(flat[begins[k] : begins[k] + lengths[k]])
            out[k] = ids.astype("<u4").tobytes()
        return out

    def _rows(self, text: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        ids, counts = self.vocabulary.propose(text, lengths)
        row, at = np.nonzero(np.arange(text.shape[1] - 1) < counts[:, None] - 1)
        wrong = np.unique(row[~self._apart(ids[row, at], ids[row, at + 1])])
        if len(wrong):
            ids[wrong], counts[wrong] = self.vocabulary.merge_rows(text[wrong], lengths[wrong])
        data = ids[np.arange(text.shape[1]) < counts[:, None]].astype("<u4").tobytes()
        ends = (4 * np.cumsum(counts)).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def _learn(self, chunks: set[str]) -> None:
        self._size += _size(chunks)
        parts = {c: self._parts(c) for c in chunks}
        words = [w for w in set().union(*parts.values()) if isinstance(w, str)]
        known = dict(zip(words, self.words(words)))
        known.update((n, n.to_bytes(4, "little")) for n in self.vocabulary.special.values())
        for c, some in parts.items():
            self._chunks[c] = known[some[0]] if len(some) == 1 else b"".join(map(known.__getitem__, some))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text of a portion."""
        cut = [CHUNKS.findall(t) if any(s in t for s in SEPARATORS) else t.split() for t in texts]
        chunks = set().union(*cut)
        unknown = chunks.difference(self._chunks)
        if self._size + _size(unknown) > MEMO:
            self._chunks.clear()
            self._size, unknown = 0, chunks
        self._learn(unknown)
        return [np.frombuffer(b"".join(map(self._chunks.__getitem__, some)), "<u4") for some in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the tokens' strings, joined by blanks."""
        strings = self.vocabulary.strings
        return b" ".join(filter(None, map(strings.__getitem__, ids[ids < len(strings)].tolist())))


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Documents -> ``doc_id, n_tokens, ids``. The vocabulary, fixed in size, goes to every task."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        gc.disable()  # the tables hold no cycles, and scanning them takes most of the time
        codec = Codec(shared.value)
        for b in batches:
            for at, texts in portions(b.column(1), PORTION):
                ids = [i.astype(np.int32) for i in codec.encode(texts)]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(texts)), pa.array(np.diff(ends), pa.int64()),
                     pa.ListArray.from_arrays(ends, np.concatenate(ids))],
                    ["doc_id", "n_tokens", "ids"],
                )

    return kernel(docs.select(F.col("doc_id").cast("bigint"), "text"), run, ENCODED)


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id, ids`` -> ``doc_id, text``."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        codec = Codec(shared.value)
        for b in batches:
            texts = [codec.decode(np.array([i for i in ids or () if i is not None and i >= 0], np.int64)).decode()
                     for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return kernel(encoded.select(F.col("doc_id").cast("bigint"), "ids"), run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Encode each text and decode its ids: counts and digests of ids and of decoded text."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        gc.disable()  # the tables hold no cycles, and scanning them takes most of the time
        codec = Codec(shared.value)
        for b in batches:
            for at, texts in portions(b.column(1), PORTION):
                ids = codec.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(texts)), pa.array(map(len, ids), pa.int64()),
                     pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                     pa.array([hashlib.sha256(codec.decode(i)).hexdigest() for i in ids], pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return kernel(docs.select(F.col("doc_id").cast("bigint"), "text"), run, DIGESTS)
