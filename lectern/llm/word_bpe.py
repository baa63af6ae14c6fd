"""BPE with word ends, encoded by backtracking over longest token matches, and decoded through an offset table.

The tokenizer's file is a parameter: its normalizer, the pattern that cuts texts into pieces, vocabulary, merges and
added tokens are read from it. A piece is a string over 512 units, the bytes and the bytes that end a piece. Merges of the
file are numbered in order of rank behind the units, so of two tokens the larger number was merged later.

Two tokens side by side are compatible if merging would never join across the place where they meet. That is found by taking
both apart, the later merge first: the pair that then meets must not have a merge that comes earlier than the
ones taken back (or, at the same rank, further left). Verdicts are kept in a table. A row of tokens is what the merges give
exactly if all neighbours in it are compatible and each token's own spelling merges to it (the few that don't are left
out). So an Aho-Corasick automaton reads all new pieces of a batch at once and proposes the longest token at every
place; where all neighbours are compatible that is the answer. Other pieces are walked with the matches at every place:
the longest token that fits its left neighbour, then its shorter prefixes, and back by one token where none does, with
the place marked so that no place is left twice for the same reason. The steps are linear in the length of a piece.

Texts are normalized in Python where all their characters have long been part of Unicode, else by the file's own
normalizer; character classes are those of the library's patterns, read off once, as Unicode versions differ.
Strings of added tokens in a text are these tokens, as in the library's default.

Decoding takes the spelling of every id from one string of all spellings by their offsets, with a space between two.

Nulls are read as empty text, which has no ids. Repeated rows each get their own result. An empty table gives an
empty result. Columns of the input other than the key and the text are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from ahocorasick import STORE_INTS, Automaton
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

from lectern.llm.common import batches, documents_of, sliced, tidy

UNITS = 512
#: Above every number of a token.
NEVER = np.int64(1) << 20
#: Pieces whose ids a task remembers, the longest of them, and verdicts on pairs that are kept.
CACHE_PIECES, CACHE_LENGTH, VERDICTS = 400_000, 64, 500_000
#: Ids that are decoded at a time.
DECODED = 1 << 18
#: Characters of scripts whose normal forms and cases have not changed for long: up to Cyrillic, punctuation, currency, kana, Han and Hangul.
_STABLE = re.compile("[\0-ԯ -⁤₠-₹　-〩ぁ-ゖ゙-ヿ一-龥가-힣！-～]*")
_WIDE = re.compile("[\U00010000-\U0010ffff]")


def byte_names() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else one from U+0100 on, in order."""
    prints = [33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255 for b in range(256)]
    return [chr(b) if prints[b] else chr(256 + prints[:b].count(False)) for b in range(256)]


def _ranges(points: list[int]) -> list[tuple[int, int]]:
    """Sorted numbers as ranges without gaps."""
    at = np.array(points)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    return list(zip(at[first].tolist(), at[np.append(first[1:] - 1, len(at) - 1)].tolist(), strict=True))


def classes() -> dict[str, list[tuple[int, int]]]:
    """The characters that a pattern's letters, numbers and spaces are, as ranges. Where Python's tables know a character, they are the
    library's too (the tests compare all); of the others in the planes that have scripts, the library's patterns are asked."""
    kinds: dict[str, list[int]] = {"L": [], "N": [], "Z": [9, 10, 11, 12, 13, 0x85], "C": []}
    for c in range(0x40000):
        if (k := unicodedata.category(chr(c))[0]) in kinds and (k != "C" or unicodedata.category(chr(c)) == "Cn"):
            kinds[k].append(c)
    unknown = "".join(map(chr, kinds["C"]))
    for k in "LN":
        spans = pre_tokenizers.Split(Regex(rf"\p{{{k}}}+"), "removed", invert=True).pre_tokenize_str(unknown)
        kinds[k] += [kinds["C"][at] for _, (begin, end) in spans for at in range(begin, end)]
    return {name: _ranges(sorted(kinds[k])) for name, k in ((r"\p{L}", "L"), (r"\p{N}", "N"), (r"\s", "Z"))}


class Merges:
    """Tokens numbered by rank, how they come apart, and which may stand side by side."""

    def __init__(self, pairs: list[tuple[int, int]]) -> None:
        count = UNITS + len(pairs)
        self.left, self.right = np.arange(count), np.arange(count)
        made = np.array(pairs, np.int64).reshape(-1, 2)
        self.left[UNITS:], self.right[UNITS:] = made[:, 0], made[:, 1]
        keys = self._key(made[:, 0], made[:, 1])
        order = np.argsort(keys)
        self.keys, self.made = np.append(keys[order], -1), np.append(UNITS + order, NEVER)
        self.pairs = {a << 20 | b: k for k, (a, b) in enumerate(pairs, UNITS)}
        self.verdicts: dict[int, bool] = {}
        sound = np.ones(count, bool)
        sound[UNITS:] = self.compatible(made[:, 0], made[:, 1], np.arange(UNITS, count))
        for k, (a, b) in enumerate(pairs, UNITS):
            sound[k] &= sound[a] and sound[b]
        self.sound = sound
        self.spelled = [chr(u) for u in range(UNITS)]
        for a, b in pairs:
            self.spelled.append(self.spelled[a] + self.spelled[b])
        self.size = np.array(list(map(len, self.spelled)))
        self.left_of, self.right_of, self.size_of = self.left.tolist(), self.right.tolist(), self.size.tolist()

    @staticmethod
    def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.int64) << 20) | b

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that a and b merge to; NEVER without one."""
        key = self._key(a, b)
        at = np.searchsorted(self.keys[:-1], key)
        return np.where(self.keys[at] == key, self.made[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether merging leaves a and b side by side as they are. limit: only merges before it count."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), NEVER) if limit is None else limit.astype(np.int64)
        out, left = np.ones(len(a), bool), np.arange(len(a))
        while len(left):
            across = self.joined(a, b) < limit
            out[left[across]] = False
            go = ~across & ((a >= UNITS) | (b >= UNITS))
            left, a, b = left[go], a[go], b[go]
            later = a > b  # of equal tokens the right one was merged later
            limit = np.where(later, a, b + 1)
            a, b = np.where(later, self.right[a], a), np.where(later, b, self.left[b])
        return out

    def agree(self, a: int, b: int) -> bool:
        """compatible() of one pair, which goes to the table of verdicts."""
        key, limit = a << 20 | b, int(NEVER)
        left, right, pairs = self.left_of, self.right_of, self.pairs
        while (out := pairs.get(a << 20 | b, limit) >= limit) and (a >= UNITS or b >= UNITS):
            if a > b:
                limit, a = a, right[a]
            else:
                limit, b = b + 1, left[b]
        self.verdicts[key] = out
        return out

    def agreeing(self, keys: list[int]) -> np.ndarray:
        """The verdicts on distinct pairs, those that the table doesn't have being found together."""
        if len(self.verdicts) + len(keys) > VERDICTS:
            self.verdicts.clear()
        new = [k for k in keys if k not in self.verdicts]
        if new:
            pair = np.array(new, np.int64)
            self.verdicts.update(zip(new, self.compatible(pair >> 20, pair & (int(NEVER) - 1)).tolist(), strict=True))
        return np.fromiter(map(self.verdicts.__getitem__, keys), bool, len(keys))


class Encoder:
    """A tokenizer's file as tables, and the pieces that have been merged so far."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.path, model = path, config["model"]
        split, byte_level = config["pre_tokenizer"]["pretokenizers"]
        steps = [x["type"] for x in config["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or (split["type"], split["invert"], byte_level["type"], byte_level["add_prefix_space"]) != ("Split", True, "ByteLevel", False) or config["decoder"]:
            raise ValueError(f"{path} isn't a byte-level BPE with word ends, lower case and no decoder")
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        names = byte_names()
        names += [n + end for n in names]
        number = {n: k for k, n in enumerate(names)}
        pairs = []
        for k, (a, b) in enumerate(model["merges"]):
            pairs.append((number[a], number[b]))
            number.setdefault(a + b, UNITS + k)
            names.append(a + b)
        self.merges = Merges(pairs)
        self.ids = np.array([vocab[n] for n in names], "<u4")
        self.tokens = Automaton(STORE_INTS)
        for k in np.flatnonzero(self.merges.sound).tolist():
            self.tokens.add_word(self.merges.spelled[k], k)
        self.tokens.make_automaton()
        self.shorter = [self._prefix(s) for s in self.merges.spelled]
        self.added = {x["content"]: np.array([x["id"]], "<u4").tobytes() for x in config["added_tokens"]}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self._patterns(split["pattern"]["Regex"])
        self._spellings({i: n for n, i in vocab.items()} | {x["id"]: x["content"] for x in config["added_tokens"]})
        self.seen: dict[str, bytes] = {}

    def _prefix(self, spelled: str) -> int:
        """The longest shorter token that a token begins with; -1 for units."""
        return next((k for n in range(len(spelled) - 1, 0, -1) if (k := self.tokens.get(spelled[:n], -1)) >= 0), -1)

    def _patterns(self, pattern: str) -> None:
        """The pattern for texts of ASCII, of two-byte characters, and of all characters; the fewer, the faster."""
        known = classes()

        def up_to(most: int) -> re.Pattern:
            text = pattern
            for name, ranges in known.items():
                text = text.replace(name, "".join(f"{re.escape(chr(a))}-{re.escape(chr(min(b, most)))}" for a, b in ranges if a <= most))
            return re.compile(text)

        self.ascii, self.narrow, self.wide = up_to(0x7F), up_to(0xFFFF), up_to(0x10FFFF)

    def _spellings(self, names: dict[int, str]) -> None:
        """One string of every id's spelling and a space, and where each begins."""
        spelled = [(names.get(k, "") + " ").encode() for k in range(max(names) + 1)]
        self.blob = np.frombuffer(b"".join(spelled), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(s) for s in spelled])])

    @cached_property
    def library(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def pieces(self, text: str) -> list[str]:
        """The normalized pieces of a text without added tokens."""
        if text.isascii():
            return self.ascii.findall(text.lower())
        if _STABLE.fullmatch(text):
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # else a last sigma gets its final form
        else:
            text = self.library.normalizer.normalize_str(text)
        return (self.wide if _WIDE.search(text) else self.narrow).findall(text)

    def learn(self, pieces: list[str]) -> Iterator[bytes]:
        """The packed ids of pieces, in order."""
        raw = [p.encode() for p in pieces]
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        units = np.frombuffer(b"".join(raw), np.uint8).astype("<u2")
        units[ends - 1] += 256
        spelled = units.tobytes().decode("utf-16-le")
        found = np.fromiter(chain.from_iterable(self.tokens.iter_long(spelled)), np.int64).reshape(-1, 2)
        last, token = found[:, 0], found[:, 1]
        owner = np.searchsorted(ends, last, "right")
        within = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, of = np.unique(Merges._key(token[within], token[within + 1]), return_inverse=True)
        fits = self.merges.agreeing(pairs.tolist())
        covered = np.bincount(owner, weights=self.merges.size[token], minlength=len(raw)).astype(np.int64)
        whole = covered == np.diff(ends, prepend=0)
        whole[owner[within[~fits[of]]]] = False
        stops = np.cumsum(np.bincount(owner, minlength=len(raw)))
        packed = self.ids[token].tobytes()
        odd = np.flatnonzero(~whole)
        walked = self._walk([spelled[a:b] for a, b in zip((ends[odd - 1] * (odd > 0)).tolist(), ends[odd].tolist(), strict=True)])
        begin = 0
        for stop, right in zip((stops * 4).tolist(), whole.tolist(), strict=True):
            yield packed[begin:stop] if right else next(walked)
            begin = stop

    def _walk(self, words: list[str]) -> Iterator[bytes]:
        """The packed ids of pieces, token by token with backtracking."""
        size, shorter, agree, known = self.merges.size_of, self.shorter, self.merges.agree, self.merges.verdicts.get
        found = np.fromiter(chain.from_iterable(self.tokens.iter("".join(words))), np.int64).reshape(-1, 2)
        place = np.zeros(sum(map(len, words)), np.int64)
        place[found[:, 0] - self.merges.size[found[:, 1]] + 1] = found[:, 1]  # of matches that begin at a place, the last one is the longest
        longest, end = place.tolist(), 0
        ids, stops = [], []
        for word in words:
            at, end = end, end + len(word)
            held: list[int] = []
            shut: set[int] = set()
            before, token = -1, longest[at]
            while at < end:
                while token >= 0:
                    if not shut or at + size[token] not in shut:
                        if before < 0 or (fits := known(before << 20 | token)) or (fits is None and agree(before, token)):
                            break
                    token = shorter[token]
                if token >= 0:
                    held.append(token)
                    at += size[token]
                    before = token
                    if at < end:
                        token = longest[at]
                else:
                    shut.add(at)
                    token = held.pop()
                    at -= size[token]
                    before = held[-1] if held else -1
            ids += held
            stops.append(len(ids) * 4)
        packed = self.ids[ids].tobytes() if ids else b""
        begin = 0
        for stop in stops:
            yield packed[begin:stop]
            begin = stop

    def encode_batch(self, texts: list[str | None]) -> Iterator[bytes]:
        """The packed ids of each text, in order. Texts are taken a few megabytes at a time."""
        group: list[list[str]] = []
        size = 0
        for t in texts:
            text = t or ""
            parts = self.marks.split(text) if self.marks and any(m in text for m in self.added) else [text]
            group.append([p for k, part in enumerate(parts) for p in ([part] if k % 2 else self.pieces(part))])
            size += len(text)
            if size > 4 << 20:
                yield from self._encode(group)
                group, size = [], 0
        yield from self._encode(group)

    def _encode(self, group: list[list[str]]) -> Iterator[bytes]:
        """Pieces that are an added token's string are that token: the pattern cuts such a string up everywhere else."""
        every = set().union(*group)
        if len(self.seen) + len(every) > CACHE_PIECES:
            self.seen = {}
        new = [p for p in every if p not in self.seen and p not in self.added]
        if new:
            self.seen.update(zip(new, self.learn(new), strict=True))
        known = self.seen | self.added if any(p in every for p in self.added) else self.seen
        get = known.__getitem__
        for pieces in group:
            yield b"".join(map(get, pieces))
        for p in [p for p in new if len(p) > CACHE_LENGTH]:
            del self.seen[p]

    def decode(self, packed: bytes) -> bytes:
        """The spellings of ids (UTF-8), a space between two; ids that the vocabulary doesn't have aren't spelled."""
        ids = np.frombuffer(packed, "<u4").astype(np.int64)
        ids = ids[ids < len(self.offsets) - 1]
        ids = ids[np.diff(self.offsets)[ids] > 1]
        out = []
        for k in range(0, len(ids), DECODED):
            begin = self.offsets[ids[k : k + DECODED]]
            length = self.offsets[ids[k : k + DECODED] + 1] - begin
            at = np.cumsum(length)
            out.append(self.blob[np.repeat(begin - at + length, length) + np.arange(at[-1])].tobytes())
        return b"".join(out)[:-1]


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """key, ids (binary: little-endian unsigned 32-bit integers) and, if asked for, decoded (the text of the ids, in UTF-8).

    path must be readable on every worker. One pass over the texts, no shuffle; a worker holds a few megabytes of them.
    """
    source = documents_of(docs, key, text)
    names = [key, "ids"] + ["decoded"] * decoded
    kinds = f"`{key}` {source.schema[key].dataType.simpleString()}, ids binary" + ", decoded binary" * decoded

    def run(parts):
        own = encoder(path)

        def made():
            for part in sliced(parts, 1024):
                keys = part.column(0)
                schema = pa.schema([pa.field(n, keys.type if n == key else pa.binary()) for n in names])
                rows = ((k, ids, own.decode(ids)) if decoded else (k, ids) for k, ids in zip(keys.to_pylist(), own.encode_batch(part.column(1).to_pylist()), strict=True))
                yield from batches(rows, schema, weight=lambda r: 3 * len(r[1]))

        try:
            yield from tidy(made())
        finally:
            own.seen = {}  # the worker lives on, with other operators' tasks
            own.merges.verdicts = {}

    return source.mapInArrow(run, kinds)


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and decoded (string) of packed ids; null ids give an empty one."""
    source = documents_of(encoded, key, ids)

    def run(parts):
        own = encoder(path)
        for part in parts:
            keys = part.column(0)
            schema = pa.schema([pa.field(key, keys.type), pa.field("decoded", pa.string())])
            rows = ((k, own.decode(x or b"").decode()) for k, x in zip(keys.to_pylist(), part.column(1).to_pylist(), strict=True))
            yield from batches(rows, schema, weight=lambda r: len(r[1]))

    return source.mapInArrow(run, f"`{key}` {source.schema[key].dataType.simpleString()}, decoded string")


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 of every text."""
    out = encode(docs, path, key, text, decoded=True)
    return out.select(f"`{key}`", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
