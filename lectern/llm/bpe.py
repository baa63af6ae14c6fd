"""Byte-level BPE encoding and decoding by a public rank file.

A text is cut by the tokenizer's pattern; every piece is merged on its own. Distinct pieces of a batch are laid
out as padded numpy matrices, bucketed by length, one row a piece. In each round every row looks up the ranks of
its neighbouring pairs in an open-addressing hash table, merges its leftmost pair of least rank, and is compacted;
rows without a known pair leave the matrix. Pieces of more than LONG bytes merge all occurrences of their least
rank in one round, unless a merge has made a pair of lower rank, in which case only the leftmost is merged; both
ways give the same ids.

Nulls are read as empty text, which has no ids. Repeated rows each get their own result. An empty table gives an
empty result. Columns of the input other than the key and the text are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import batches, documents_of, sliced, tidy

#: Pieces above this length take the round-wise form for single rows.
LONG = 256
#: Pieces whose ids a task remembers, and the longest of them.
CACHE_PIECES, CACHE_LENGTH = 150_000, 64
NONE = np.int64(1) << 40
#: The width of the bucket of each length: exact for short pieces, else the next multiple of 8.
WIDTHS = [max(1, n) if n <= 16 else (n + 7) // 8 * 8 for n in range(LONG + 1)]


class PairTable:
    """(left id, right id) -> rank of their concatenation, by linear probing in numpy arrays."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        keys = (np.array(left, np.int64) << 32) | np.array(right, np.int64)
        values = np.array(rank, np.int64)
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int64)
        slot, todo = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.keys[slot[todo]] == -1
            self.keys[slot[todo[free]]] = keys[todo[free]]
            won = self.keys[slot[todo]] == keys[todo]
            self.values[slot[todo[won]]] = values[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; NONE where the table has no such pair or a side is padding (-1)."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        slot = self._slot(keys)
        out = np.full(keys.shape, NONE, np.int64)
        todo = np.flatnonzero(keys.ravel() >= 0)
        flat, flat_slot, flat_out = keys.ravel(), slot.ravel(), out.ravel()
        for _ in range(self.probes):
            if not len(todo):
                break
            seen = self.keys[flat_slot[todo]]
            hit = seen == flat[todo]
            flat_out[todo[hit]] = self.values[flat_slot[todo[hit]]]
            todo = todo[~hit & (seen != -1)]
            flat_slot[todo] = (flat_slot[todo] + 1) & ((1 << self.bits) - 1)
        return flat_out.reshape(keys.shape)


class Encoder:
    """Ranks, the pattern that cuts texts into pieces, and what has been merged so far."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.pattern = regex.compile(pattern)
        self.pairs = PairTable(ranks)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, r in ranks.items():
            self.tokens[r] = token
        self.seen: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> Encoder:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        return cls(ranks, pattern)

    def _matrix(self, pieces: list[bytes], width: int) -> np.ndarray:
        raw = np.array(pieces, dtype=f"S{width}").view(np.uint8).reshape(len(pieces), width)
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        return np.where(np.arange(width)[None, :] < length[:, None], self.byte[raw], -1)

    def _merge_rows(self, rows: np.ndarray) -> list[bytes]:
        out: list[bytes] = [b""] * len(rows)
        alive = np.arange(len(rows))
        while len(alive):
            ranks = self.pairs.get(rows[:, :-1], rows[:, 1:]) if rows.shape[1] > 1 else np.full((len(rows), 1), NONE)
            at = ranks.argmin(axis=1)  # the first of equal ranks
            least = ranks[np.arange(len(rows)), at]
            done = least == NONE
            ended = rows[done]
            packed, end = ended[ended >= 0].astype("<u4").tobytes(), np.cumsum((ended >= 0).sum(axis=1)) * 4
            start = 0
            for k, stop in zip(alive[done].tolist(), end.tolist(), strict=True):
                out[k] = packed[start:stop]
                start = stop
            keep = ~done
            rows, at, least, alive = rows[keep], at[keep], least[keep], alive[keep]
            if not len(alive):
                break
            column = np.arange(rows.shape[1] - 1)
            moved = np.where(column[None, :] > at[:, None], rows[:, 1:], rows[:, :-1])
            moved[np.arange(len(rows)), at] = least
            used = int((moved >= 0).sum(axis=1).max())
            rows = np.ascontiguousarray(moved[:, : max(1, used)])
        return out

    def _merge_long(self, piece: bytes) -> np.ndarray:
        ids = self.byte[np.frombuffer(piece, np.uint8)]
        ranks = self.pairs.get(ids[:-1], ids[1:])
        while len(ids) > 1 and (least := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == least)
            run = np.cumsum(np.diff(at, prepend=-2) > 1)  # overlapping occurrences form runs; every second one of a run merges
            start = np.flatnonzero(np.diff(run, prepend=0))
            at = at[(np.arange(len(at)) - start[run - 1]) % 2 == 0]
            new, new_ranks = self._merged(ids, at, least)
            if len(at) > 1 and new_ranks.min(initial=NONE) < least:
                new, new_ranks = self._merged(ids, at[:1], least)
            ids, ranks = new, new_ranks
        return ids

    def _merged(self, ids: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        ids = ids.copy()
        ids[at] = least
        ids = np.delete(ids, at + 1)
        return ids, self.pairs.get(ids[:-1], ids[1:])

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces, packed as little-endian unsigned 32-bit integers."""
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        out = {}
        for p in pieces:
            raw = p.encode("utf-8", "surrogatepass")
            if len(raw) > LONG:
                out[p] = self._merge_long(raw).astype("<u4").tobytes()
            else:
                buckets.setdefault(WIDTHS[len(raw)], []).append((p, raw))
        for width, rows in buckets.items():
            step = max(1, (1 << 19) // width)
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                out.update(zip([p for p, _ in part], self._merge_rows(self._matrix([r for _, r in part], width)), strict=True))
        return out

    def encode_batch(self, texts: list[str | None]) -> Iterator[bytes]:
        """The packed ids of each text, in order. Texts are taken a few megabytes at a time."""
        group: list[list[str]] = []
        size = 0
        for t in texts:
            group.append(self.pattern.findall(t or ""))
            size += len(t or "")
            if size > 4 << 20:
                yield from self._encode(group)
                group, size = [], 0
        yield from self._encode(group)

    def _encode(self, group: list[list[str]]) -> Iterator[bytes]:
        new = set().union(*group) - self.seen.keys() if group else set()
        if new:
            if len(self.seen) + len(new) > CACHE_PIECES:
                self.seen = {}
                new = set().union(*group)
            self.seen.update(self.learn(new))
        get = self.seen.__getitem__
        for pieces in group:
            yield b"".join(map(get, pieces))
        for p in [p for p in new if len(p) > CACHE_LENGTH]:
            del self.seen[p]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_loaded: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each worker process."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Encoder.load(path, pattern)
    return _loaded[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """key, ids (binary: little-endian unsigned 32-bit integers) and, if asked for, decoded (the bytes that the ids stand for).

    path must be readable on every worker. One pass over the texts, no shuffle; a worker holds a few megabytes of them.
    """
    source = documents_of(docs, key, text)
    names = [key, "ids"] + ["decoded"] * decoded
    kinds = f"`{key}` {source.schema[key].dataType.simpleString()}, ids binary" + ", decoded binary" * decoded

    def run(parts):
        own = encoder(path, pattern)

        def made():
            for part in sliced(parts, 1024):
                keys = part.column(0)
                schema = pa.schema([pa.field(n, keys.type if n == key else pa.binary()) for n in names])
                rows = ((k, ids, own.decode(ids)) if decoded else (k, ids) for k, ids in zip(keys.to_pylist(), own.encode_batch(part.column(1).to_pylist()), strict=True))
                yield from batches(rows, schema, weight=lambda r: 2 * len(r[1]))

        try:
            yield from tidy(made())
        finally:
            own.seen = {}  # the worker lives on, with other operators' tasks

    return source.mapInArrow(run, kinds)


def decode(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and decoded (binary) of packed ids; null ids give empty bytes."""
    source = documents_of(encoded, key, ids)

    def run(parts):
        own = encoder(path, pattern)
        for part in parts:
            keys = part.column(0)
            schema = pa.schema([pa.field(key, keys.type), pa.field("decoded", pa.binary())])
            rows = ((k, own.decode(x or b"")) for k, x in zip(keys.to_pylist(), part.column(1).to_pylist(), strict=True))
            yield from batches(rows, schema, weight=lambda r: len(r[1]))

    return source.mapInArrow(run, f"`{key}` {source.schema[key].dataType.simpleString()}, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 of every text; with ids also the packed ids themselves."""
    out = encode(docs, path, pattern, key, text, decoded=True)
    return out.select(f"`{key}`", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), *["ids"] * ids, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
