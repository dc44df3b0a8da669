"""Byte-level BPE by a finite-state transducer that is determinised while it runs.

Merges are applied in rank order, so a token of one piece is fixed once no longer token can
still reach back over it. A state of the transducer is the last fixed token, the bytes that
are still open, and the token that ends at each of them; it is made when first reached, and
its step by one byte is then a table entry. Lookahead is bounded by the longest token.

A worker keeps its states and the ids of parts it has met from task to task, up to fixed limits.

Decoding runs the bytes of the ids through a state machine that holds back the bytes of a
character that is not complete yet, so text can be given out chunk by chunk.

Defined cases: null text is empty; an empty text has no ids and the digests of nothing; a
text may be of any length; rows with equal or null ids are encoded each for itself; other
columns of the input are left alone.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import struct
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Known, kernel

# Fixed value: the public splitting pattern, with white space as Unicode defines it.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)

MAX_STATES = 1 << 18
MAX_PAIRS = 1 << 16
WIDE = 16
ENCODED = "doc_id bigint, n_tokens bigint, ids array<int>"
DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def load_ranks(path: str) -> dict[bytes, int]:
    """Tokens by rank file: one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Transducer:
    """Pieces of text to token ranks.

    ``room`` is the share of the limits on states, judged pairs and parts that may be kept; results don't depend on it.
    """

    def __init__(self, ranks: dict[bytes, int], room: float = 1.0):
        self.ranks, self.room = ranks, room
        self.tokens = [b""] * (max(ranks.values()) + 1)
        # A tree of the tokens' bytes: the node after each byte, and the token that ends there.
        self.after: dict[int, int] = {}
        self.token_at, self.inner = [-1], [True]
        for token, rank in ranks.items():
            self.tokens[rank] = token
            node = 0
            for byte in token:
                self.inner[node] = True
                node = self.after.setdefault(node << 8 | byte, len(self.token_at))
                if node == len(self.token_at):
                    self.token_at.append(-1)
                    self.inner.append(False)
            self.token_at[node] = rank
        self.children: dict[int, list[int]] = {}
        for step, node in self.after.items():
            self.children.setdefault(step >> 8, []).append(node)
        self.lengths = [len(token) for token in self.tokens]
        self._below: dict[int, list[int]] = {}
        self._lives: dict[int, tuple] = {}
        self._apart: dict[int, bool] = {}
        self.codec: Codec | None = None
        self.reset()

    def reset(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.steps: dict[int, tuple] = {}
        self.ends: list[tuple | None] = []
        self._state(-1, b"", (), (1,), ())

    def _state(self, before: int, pending: bytes, ending: tuple, borders: tuple, live: tuple) -> int:
        """Number of a state: the last fixed token and the open bytes.

        The token is left out (-1) where no later token could fail to fit after it.
        ``ending[i]`` is the token that ends after ``i + 1`` open bytes, and ``borders[i]`` has
        a bit for each place where a token ends on the way to open byte ``i``. ``live`` holds
        the places at which a longer token may have begun, with the node reached since.
        """
        key = (before, pending)
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append((before, pending, ending, borders, live))
            self.ends.append(None)
        return number

    def _tokens_below(self, node: int) -> list[int]:
        """Tokens that go on from a node, but no more than ``WIDE`` + 1 of them."""
        found = self._below.get(node)
        if found is None:
            found, nodes = [], list(self.children.get(node, ()))
            while nodes and len(found) <= WIDE:
                at = nodes.pop()
                if self.token_at[at] >= 0:
                    found.append(self.token_at[at])
                nodes.extend(self.children.get(at, ()))
            self._below[node] = found
        return found

    def _fits(self, left: int, right: int) -> bool:
        pair = left << 32 | right
        fits = self._apart.get(pair)
        if fits is None:
            if len(self._apart) >= MAX_PAIRS * self.room:  # asked only while states are made
                self._apart.clear()
            fits = self._apart[pair] = self._may_follow(left, right)
        return fits

    def _matters(self, before: int, live: tuple) -> bool:
        """Whether the last fixed token can keep a later token from forming."""
        if before < 0 or not live or live[0][0] > 0:
            return False
        below = self._tokens_below(live[0][1])
        return len(below) > WIDE or not all(self._fits(before, token) for token in below)

    def _parts(self, token: bytes) -> list[bytes]:
        """The two tokens whose merge makes ``token``."""
        pieces = [token[i : i + 1] for i in range(len(token))]
        while len(pieces) > 2:
            merges = [(self.ranks.get(a + b, sys.maxsize), i) for i, (a, b) in enumerate(zip(pieces, pieces[1:]))]
            rank, i = min(merges)
            if rank == sys.maxsize:
                raise ValueError(f"no merges lead to {token!r}")
            pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]
        return pieces

    def _edge_lives(self, rank: int) -> tuple[list[tuple], list[tuple]]:
        """Tokens that stand at the left and at the right edge while a token is built up.

        Each with the rank of the merge that makes it and of the one that takes it up.
        """
        known = self._lives.get(rank)
        if known is None:
            token = self.tokens[rank]
            whole = (token, rank if len(token) > 1 else -1, sys.maxsize)
            sides = ([], [])
            if len(token) > 1:
                for side, part in enumerate(self._parts(token)):
                    inner = self._edge_lives(self.ranks[part])[side]
                    sides[side].extend([*inner[:-1], (*inner[-1][:2], rank)])
            known = self._lives[rank] = ([*sides[0], whole], [*sides[1], whole])
        return known

    def _may_follow(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart: no merge joins them while they are built up.

        A merge over the border happens if both its sides are there at its rank. At equal
        rank the leftmost place goes first.
        """
        get = self.ranks.get
        for a, a_born, a_gone in self._edge_lives(left)[1]:
            for b, b_born, b_gone in self._edge_lives(right)[0]:
                rank = get(a + b)
                if rank is not None and a_born < rank > b_born and rank < a_gone and rank <= b_gone:
                    return False
        return True

    def _step(self, state: int, byte: int) -> tuple[int, tuple]:
        """The state after one more byte, and the tokens that are fixed by then."""
        before, pending, ending, borders, live = self.states[state]
        after, token_at, inner = self.after, self.token_at, self.inner
        n, found, still = len(pending) + 1, -1, []
        shared = -1
        for start, node in (*live, (n - 1, 0)):
            node = after.get(node << 8 | byte)
            if node is None:
                continue
            token = token_at[node]
            if found < 0 <= token:
                ahead = ending[start - 1] if start else before
                if ahead < 0 or self._fits(ahead, token):
                    found, begun = token, start
            if inner[node]:
                # A later token may start here, so what is fixed must lead here.
                still.append((start, node))
                shared &= borders[start]
        if found < 0:
            raise ValueError(f"no token ends {pending + bytes((byte,))!r}")
        pending += bytes((byte,))
        ending = (*ending, found)
        border = borders[begun] | 1 << n
        borders = (*borders, border)
        fixed = (shared & border).bit_length() - 1
        out = ()
        if fixed:
            out, before = self._tokens(ending, fixed), ending[fixed - 1]
            pending, ending = pending[fixed:], ending[fixed:]
            borders = tuple([b >> fixed for b in borders[fixed:]])
            still = [(start - fixed, node) for start, node in still]
        live = tuple(still)
        if not self._matters(before, live):
            before = -1
        moved = self._state(before, pending, ending, borders, live)
        result = self.steps[state << 8 | byte] = (moved, out)
        return result

    def _tokens(self, ending: tuple, at: int) -> tuple:
        """The tokens that lead to byte ``at`` of the open bytes."""
        out = []
        while at > 0:
            out.append(ending[at - 1])
            at -= self.lengths[ending[at - 1]]
        return tuple(out[::-1])

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > MAX_STATES * self.room:
            self.reset()
        state, out, known = 0, [], self.steps.get
        for byte in piece:
            step = known(state << 8 | byte) or self._step(state, byte)
            state = step[0]
            if step[1]:
                out += step[1]
        ended = self.ends[state]
        if ended is None:
            _, pending, ending, _, _ = self.states[state]
            ended = self.ends[state] = self._tokens(ending, len(pending))
        out += ended
        return out


class Utf8Stream:
    """Text from bytes that come in chunks: a character is given out when its last byte is in."""

    def __init__(self):
        self.held = b""

    @staticmethod
    def _open_bytes(data: bytes) -> int:
        """Bytes at the end that begin a character but don't complete it."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 == 0x80:
                continue
            needs = 4 if byte >= 0xF0 else 3 if byte >= 0xE0 else 2 if byte >= 0xC0 else 1
            return back if needs > back else 0
        return 0

    def feed(self, data: bytes, last: bool = False) -> str:
        """Bad bytes come out as U+FFFD."""
        data = self.held + data
        cut = len(data) - (0 if last else self._open_bytes(data))
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")


class Recent(Known):
    """A memo of at most twice ``limit`` values: at the limit those not met since the last time are forgotten."""

    def __init__(self, *args):
        super().__init__(*args)
        self.earlier: dict = {}

    def __missing__(self, key):
        value = self.earlier.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.earlier = self.copy()
                self.clear()
            self[key] = value
        return value


class Codec:
    """Encoder and streaming decoder of one rank file.

    A single blank between two other characters always starts a piece, so a text falls into
    parts at these blanks whose ids don't depend on each other, and common parts are known.
    """

    def __init__(self, ranks: dict[bytes, int] | Transducer):
        self.transducer = Transducer(ranks) if isinstance(ranks, dict) else ranks
        self._find = regex.compile(PATTERN).findall
        room = self.transducer.room
        self._pieces = Recent(self._piece, int((1 << 16) * room))
        self._first = Recent(lambda part: self._part(part, ""), int((1 << 15) * room))
        self._later = Recent(lambda part: self._part(part, " "), int((1 << 17) * room))

    def _piece(self, piece: str) -> bytes:
        ids = self.transducer.encode(piece.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def _whole(self, text: str) -> bytes:
        return b"".join(map(self._pieces.__getitem__, self._find(text)))

    def _part(self, part: str, blank: str) -> bytes | None:
        """Ids of a part with the blank before it; None if blanks at its ends join it to others."""
        if part.isalpha():  # one piece, and known as a part from now on
            return self._piece(blank + part)
        if not part or part[0].isspace() or part[-1].isspace():
            return None
        return self._whole(blank + part)

    def encode(self, text: str) -> np.ndarray:
        first, *later = text.split(" ")
        parts = [self._first[first], *map(self._later.__getitem__, later)]
        try:
            ids = b"".join(parts)
        except TypeError:  # a run of blanks: the parts beside it hang together
            ids = self._joined([first, *later], parts)
        return np.frombuffer(ids, "<u4")

    def _joined(self, words: list[str], parts: list[bytes | None]) -> bytes:
        out, at = [], 0
        while at < len(words):
            # A part may end only before a part that is whole, and if it is whole itself.
            stop = at + 1
            while stop < len(words) and (parts[stop] is None or parts[stop - 1] is None):
                stop += 1
            known = parts[at] if stop == at + 1 else None
            out.append(self._whole(" " * (at > 0) + " ".join(words[at:stop])) if known is None else known)
            at = stop
        return b"".join(out)

    def decode(self, ids: np.ndarray, chunk: int = 1 << 16) -> Iterator[str]:
        stream, token = Utf8Stream(), self.transducer.tokens.__getitem__
        for at in range(0, len(ids), chunk):
            yield stream.feed(b"".join(map(token, ids[at : at + chunk].tolist())))
        yield stream.feed(b"", last=True)


def compiled(docs: DataFrame, ranks: dict[bytes, int], room: float = 1.0) -> Broadcast:
    """The transducer without states, sent to every worker once."""
    return docs.sparkSession.sparkContext.broadcast(Transducer(ranks, room))


def codec_of(shared: Broadcast) -> Codec:
    """The worker's codec: states and parts that one task has met are there for the next one."""
    transducer = shared.value
    if transducer.codec is None:
        transducer.codec = Codec(transducer)
    return transducer.codec


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def encode(docs: DataFrame, ranks: dict[bytes, int], room: float = 1.0) -> DataFrame:
    """Documents -> ``doc_id, n_tokens, ids``. ``ranks`` is the vocabulary, fixed in size."""
    shared = compiled(docs, ranks, room)

    def run(batches):
        gc.disable()
        codec = codec_of(shared)
        for b in batches:
            ids = [codec.encode(t).astype(np.int32) for t in _texts(b.column(1))]
            arrays = pa.ListArray.from_arrays(
                np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32),
                np.concatenate([*ids, np.empty(0, np.int32)]),
            )
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(i) for i in ids], pa.int64()), arrays],
                ["doc_id", "n_tokens", "ids"],
            )

    return kernel(docs.select(F.col("doc_id").cast("bigint"), "text"), run, ENCODED)


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``doc_id, ids`` -> ``doc_id, text``; null ids read as none."""
    shared = compiled(encoded, ranks)

    def run(batches):
        codec = codec_of(shared)
        for b in batches:
            texts = ["".join(codec.decode(np.array(i or [], np.uint32))) for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return kernel(encoded.select(F.col("doc_id").cast("bigint"), "ids"), run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Encode and decode each text; counts and digests of ids and of decoded bytes."""
    shared = compiled(docs, ranks)

    def run(batches):
        gc.disable()  # the tables hold no cycles, and scanning them takes most of the time
        codec = codec_of(shared)
        for b in batches:
            counts, id_hashes, text_hashes = [], [], []
            for text in _texts(b.column(1)):
                ids = codec.encode(text)
                decoded = hashlib.sha256()
                for part in codec.decode(ids):
                    decoded.update(part.encode())
                counts.append(len(ids))
                id_hashes.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_hashes.append(decoded.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()),
                 pa.array(text_hashes, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return kernel(docs.select(F.col("doc_id").cast("bigint"), "text"), run, DIGESTS)
