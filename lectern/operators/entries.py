"""Posting rows of the stored index as tasks make and open them: the entries of a term in a block of chunks, as runs of numbers.

An entry is offset in the block, sign, and count and length by field, INTS numbers in a row of an array, which takes less room in files and shuffles than
fields of their own. Rows come dealt out and sorted by block, so nothing is dealt out by term.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

from lectern.operators.scores import Held
from lectern.sources.batches import runs_of_batches

#: Numbers of an entry, and chunks or rows that are opened together, so long as blocks allow.
INTS, TOGETHER = 6, 256
#: A length that no field has, and parts of sizes that a task holds.
NONE, SIZES = 1 << 30, 10_000
#: What follows article_id in a posting row.
KINDS = [("block", pa.int64()), ("term", pa.string()), ("n", pa.int64())] + [(f"{x}_{f}", t) for f in ("section", "text") for x, t in (("n", pa.int64()), ("top", pa.int32()), ("low", pa.int32()))] + [("entries", pa.list_(pa.int32()))]


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Lengths and values of a column of lists; null is empty."""
    return column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten()


def _same(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal rows together, in order of the columns, and where runs of equal ones begin."""
    order = np.lexsort(columns[::-1])
    return order, np.flatnonzero(np.r_[True, np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)][: len(order)])


def _live(row: np.ndarray, term: np.ndarray, ints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of signed entries those that no removal has cancelled, in order of row, offset and term."""
    order, starts = _same(row, ints[:, 0], term, *ints[:, 2:].T)
    sign = np.add.reduceat(ints[order, 1], starts) if len(order) else np.zeros(0, np.int64)
    at = order[starts][sign > 0]
    live = ints[at]
    live[:, 1] = sign[sign > 0]
    return row[at], term[at], live


def _batch(articles: pa.Array, blocks: pa.Array, row: np.ndarray, code: np.ndarray, terms: pa.Array, ints: np.ndarray) -> pa.RecordBatch:
    """Posting rows of entries: of row `row` of articles and blocks, with term `code` of terms."""
    order, _ = _same(row, code, ints[:, 0])
    row, code, ints = row[order], code[order], ints[order]
    starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (code[1:] != code[:-1])])
    at, sign = pa.array(row[starts]), ints[:, 1]
    out = [articles.take(at), blocks.take(at), terms.take(pa.array(code[starts])), pa.array(np.add.reduceat(sign, starts))]
    for tf, length in ((ints[:, k], ints[:, k + 1]) for k in (2, 4)):
        low = np.minimum.reduceat(np.where(tf > 0, length, NONE), starts)
        out += [pa.array(np.add.reduceat(sign * (tf > 0), starts)), pa.array(np.maximum.reduceat(tf, starts)), pa.array(low, mask=low == NONE)]
    out.append(pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)) * INTS, pa.int32()), pa.array(ints.astype(np.int32).ravel())))
    schema = pa.schema([("article_id", articles.type), *KINDS])
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out, schema, strict=True)], schema=schema)


def _blocks(part: pa.RecordBatch) -> np.ndarray:
    """For every row of a part that is sorted by article and block, the first row of its block."""
    of = [part.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for k in (0, 1)]
    new = np.r_[True, np.any([c[1:] != c[:-1] for c in of], axis=0)]
    return np.flatnonzero(new)[np.cumsum(new) - 1]


def made(size: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Posting rows of chunks (article_id, block, chunk_idx, sign, terms of section, terms of text), and for the sizes of articles rows without a term."""

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, kind = {}, pa.null()
        for part in runs_of_batches(parts, 2, TOGETHER):
            kind = part.column(0).type
            (ns, section), (nt, text) = (_lists(part.column(k)) for k in (4, 5))
            sign, chunk, block = (part.column(k).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 2, 1))
            n, terms = part.num_rows, pa.concat_arrays([section, text]).dictionary_encode()
            code = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            width = max(1, len(terms.dictionary))
            key, of = np.unique(np.r_[np.repeat(np.arange(n), ns), np.repeat(np.arange(n), nt)] * width + code, return_inverse=True)
            tf = [np.bincount(x, minlength=len(key)) for x in (of[: ns.sum()], of[ns.sum() :])]
            row = key // width
            lens = [np.bincount(row[t > 0], minlength=n) for t in tf]
            for article, s, a, b in zip(part.column(0).to_pylist(), sign.tolist(), *(x.tolist() for x in lens), strict=True):
                held = sizes.setdefault(article, [0, 0, 0])
                held[:] = held[0] + s, held[1] + s * a, held[2] + s * b
            if len(sizes) > SIZES:
                yield _sized(sizes, kind)
                sizes = {}
            if not len(key):
                continue
            # Repeated rows of a chunk, of equal lengths, count as one whose terms are those of all.
            first = _blocks(part)
            order, starts = _same(first, chunk, sign, *lens)
            as_one = np.empty(n, np.int64)
            as_one[order] = np.repeat(order[starts], np.diff(np.append(starts, n)))
            key, of = np.unique(as_one[row] * width + key % width, return_inverse=True)
            tf = [np.bincount(of, t, len(key)).astype(np.int64) for t in tf]
            row = key // width
            ints = np.column_stack([(chunk - block * size)[row], sign[row], tf[0], lens[0][row], tf[1], lens[1][row]])
            yield _batch(part.column(0), part.column(1), first[row], key % width, terms.dictionary, ints)
        if sizes:
            yield _sized(sizes, kind)

    return run


def _sized(sizes: dict, kind: pa.DataType) -> pa.RecordBatch:
    """Rows of sizes: without block and term, n has the chunks of an article, n of a field its length."""
    chunks, section, text = (list(x) for x in zip(*sizes.values(), strict=True))
    schema = pa.schema([("article_id", kind), *KINDS])
    columns = {"article_id": list(sizes), "n": chunks, "n_section": section, "n_text": text}
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * len(sizes)), f.type) for f in schema], schema=schema)


def merged(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting rows of what is live of posting rows (article_id, block, term, entries)."""
    for part in runs_of_batches(parts, 2, TOGETHER):
        count, values = _lists(part.column(3))
        terms = part.column(2).dictionary_encode()
        code = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row, code, ints = _live(np.repeat(_blocks(part), count // INTS), np.repeat(code, count // INTS), values.to_numpy(zero_copy_only=False).reshape(-1, INTS).astype(np.int64))
        if len(row):
            yield _batch(part.column(0), part.column(1), row, code, terms.dictionary, ints)


class Weights:
    """Facts of the terms of articles (article_id, tid, idf and average length by field), a small table that goes to every task."""

    def __init__(self, rows: pa.Table) -> None:
        article = rows.column(0).combine_chunks().dictionary_encode()
        tid, *facts = (c.to_numpy().astype(np.int64 if k == 0 else float) for k, c in enumerate(rows.columns[1:]))
        self.articles = {a: k for k, a in enumerate(article.dictionary.to_pylist())}
        self.terms = 1 + int(tid.max(initial=0))
        key = article.indices.to_numpy(zero_copy_only=False).astype(np.int64) * self.terms + tid
        order = np.argsort(key)
        self.key, self.facts = key[order], np.column_stack(facts)[order]

    def of(self, articles: pa.Array, row: np.ndarray, tid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places in facts of terms of rows, and which of them are there."""
        code = np.array([self.articles.get(a, -1) for a in articles.to_pylist()], np.int64)[row]
        if not len(self.key):
            return np.zeros(len(row), np.int64), np.zeros(len(row), bool)
        at = np.minimum(np.searchsorted(self.key, code * self.terms + tid), len(self.key) - 1)
        return at, (code >= 0) & (tid < self.terms) & (self.key[at] == code * self.terms + tid)


def scored(size: int, weights, k: float, b: float, delta: float) -> Callable[[pa.RecordBatch], Held]:
    """Opens the rows article_id, block, posts (tid, entries): live entries, weighed. weights: a broadcast of Weights."""

    def opened(part: pa.RecordBatch) -> Held:
        posts, values = _lists(part.column(2))
        tid, entries = values.flatten()
        count, ints = _lists(entries)
        count, ints = count // INTS, ints.to_numpy(zero_copy_only=False).reshape(-1, INTS).astype(np.int64)
        row, tid = np.repeat(np.repeat(np.arange(part.num_rows), posts), count), np.repeat(tid.to_numpy(zero_copy_only=False).astype(np.int64), count)
        # Most entries are alone with their chunk and term, and need no comparison.
        key = (row * (1 + ints[:, 0].max(initial=0)) + ints[:, 0]) * (1 + tid.max(initial=0)) + tid
        order = np.argsort(key, kind="stable")
        again = key[order][1:] == key[order][:-1]
        several = np.r_[False, again] | np.r_[again, False] if len(key) else np.zeros(0, bool)
        alone = order[~several & (ints[order, 1] > 0)]
        rest = _live(row[order[several]], tid[order[several]], ints[order[several]])
        row, tid, ints = (np.concatenate([x[alone], y]) for x, y in zip((row, tid, ints), rest, strict=True))
        at, known = weights.value.of(part.column(0), row, tid)
        row, tid, ints, at = row[known], tid[known], ints[known], at[known]
        order = np.lexsort((tid, ints[:, 0], row))
        row, tid, ints, facts = row[order], tid[order], ints[order], weights.value.facts[at[order]]
        w = np.zeros(len(row))
        for f in (0, 1):
            tf, length, idf, average = ints[:, 2 + 2 * f], ints[:, 3 + 2 * f], facts[:, 2 * f], facts[:, 2 * f + 1]
            has = tf > 0
            w[has] += (idf * (delta + tf * (k + 1) / (tf + k * (1 - b + b * length / np.where(has, average, 1.0)))))[has]
        starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (ints[1:, 0] != ints[:-1, 0])][: len(row)])
        block = part.column(1).to_numpy(zero_copy_only=False)
        return Held(part.column(0).take(pa.array(row[starts])), pa.array(block[row[starts]] * size + ints[starts, 0], pa.int64()), np.append(starts, len(row)), tid, w)

    return opened


def bounds(part: pa.RecordBatch) -> Held:
    """Opens the rows article_id, block, posts (tid, bound): a block counts as a chunk, of several bounds of a term the highest."""
    posts, values = _lists(part.column(2))
    tid, bound = (x.to_numpy(zero_copy_only=False) for x in values.flatten())
    row = np.repeat(np.arange(part.num_rows), posts)
    order, starts = _same(row, tid.astype(np.int64))
    top = np.maximum.reduceat(bound[order].astype(float), starts) if len(order) else np.zeros(0)
    row, tid = row[order][starts], tid[order][starts].astype(np.int64)
    at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]][: len(row)])
    return Held(part.column(0).take(pa.array(row[at])), part.column(1).take(pa.array(row[at])), np.append(at, len(row)), tid, top)
