"""Sparse presence features of texts, how telling ones are found from labelled rows, and a linear classifier on them.

A token (a run without ASCII white space) gives: its letters in lower case, the first four, five and six of them, whether
they are on a list of insults, and its shape (runs of upper-case, lower-case, digits, and the marks themselves; of long
shapes the kinds of characters). Where other characters stand between its letters, every stretch of letters gives the
same; a stretch of more than LONG_STRETCH letters gives all its runs of six, so that scripts without spaces are read to
their end. A text has a feature or hasn't; how long it is plays no part. Models are fitted on bounded samples of labelled
rows (the bounds are parameters of the callers, the rows are those of least hash) and applied to whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import batches, discard, documents_of, sliced, stored, tidy

#: Tokens whose features a worker remembers.
CACHE_TOKENS = 150_000
#: Distinct features that a task counts before it passes them on.
FLUSH = 300_000
LONG_STRETCH, LONG_SHAPE = 24, 16
CALM = 10

# Common English insults; a token among them has the feature "l:insult".
INSULTS = frozenset("idiot idiots moron morons stupid dumb dumbass fool loser losers scum trash garbage pathetic worthless disgusting clown clowns jerk imbecile cretin vermin filth filthy parasite retard bastard coward ugly freak creep lowlife".split())

_OTHER = re.compile(r"[\W\d_]+")
_RUNS = ((re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "X"), (re.compile(r"[a-zß-öø-ÿ]+"), "x"), (re.compile(r"[0-9]+"), "9"))
_INSULTS = pa.array(sorted(INSULTS), pa.large_string())
_CLOSING = ".,;:!?%$*#&|)]}\"'"


def _shape(token: str) -> str:
    for pattern, mark in _RUNS:
        token = pattern.sub(mark, token)
    return token if len(token) <= LONG_SHAPE else "..." + "".join(sorted(set(token)))


def _of_stretch(letters: str) -> list[str]:
    out = ["w:" + letters] if len(letters) <= LONG_STRETCH else ["6:" + letters[k : k + 6] for k in range(len(letters) - 5)]
    size = len(letters)
    if size > 4:
        out.append("4:" + letters[:4])
        if size > 5:
            out.append("5:" + letters[:5])
            if size > 6:
                out.append("6:" + letters[:6])
    if letters in INSULTS:
        out.append("l:insult")
    return out


def token_features(token: str) -> list[str]:
    core = token.rstrip(_CLOSING)
    if core.isalpha():  # most are: a word, perhaps with closing marks
        plain = "x" if core.islower() else "X" if core.isupper() else "Xx" if core[0].isupper() and core[1:].islower() else None
        if plain is not None and len(token) - len(core) < LONG_SHAPE - 1:
            return [*_of_stretch(core.lower()), "s:" + plain + token[len(core) :]]
    low = token.lower()
    stretches = [x for x in _OTHER.split(low) if x]
    out = [f for x in (["".join(stretches)] if len(stretches) > 1 and len(token) <= 4 * LONG_STRETCH else []) + stretches for f in _of_stretch(x)]
    return [*dict.fromkeys(out), "s:" + _shape(token)]


class _Known(dict):
    """What tokens give, remembered up to a bound."""

    def __init__(self, at: dict[str, int] | None = None) -> None:
        self.at = at

    def __missing__(self, token: str) -> tuple:
        found = token_features(token)
        if (at := self.at) is not None:
            found = [at[f] for f in found if f in at]
        if len(self) >= CACHE_TOKENS:
            self.clear()
        if len(token) <= 4 * LONG_STRETCH:
            self[token] = found
        return found


class Features:
    """The numbers of chosen features that texts have.

    What tokens of letters (perhaps with closing marks) give is looked up for a batch's distinct tokens at once; other
    tokens go through token_features() one by one.
    """

    def __init__(self, names: list[str]) -> None:
        self.names = names
        self.at = {f: k for k, f in enumerate(names)}
        self.seen = _Known(self.at)
        self.sets = {}
        for kind in ("w", "4", "5", "6", "s", "l"):
            own = [k for k, f in enumerate(names) if f.startswith(kind + ":")]
            self.sets[kind] = (pa.array([names[k][2:] for k in own], pa.large_string()), np.array([*own, -1], np.int64))

    def __getstate__(self) -> list[str]:
        return self.names

    def __setstate__(self, names: list[str]) -> None:
        self.__init__(names)

    def _among(self, kind: str, values: pa.Array) -> np.ndarray:
        """The feature of this kind that each value is; -1 without one."""
        known, number = self.sets[kind]
        return number[pc.fill_null(pc.index_in(values, value_set=known), -1).to_numpy(zero_copy_only=False)]

    def _plain(self, tokens: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
        """Which tokens are plain, and for each kind of feature its number, as token_features() has it."""
        core = pc.utf8_rtrim(tokens, characters=_CLOSING)
        size = pc.utf8_length(core).to_numpy(zero_copy_only=False)
        lower, upper, title = (f(core).to_numpy(zero_copy_only=False) for f in (pc.utf8_is_lower, pc.utf8_is_upper, pc.utf8_is_title))
        closing = pc.utf8_length(tokens).to_numpy(zero_copy_only=False) - size
        plain = pc.utf8_is_alpha(core).to_numpy(zero_copy_only=False) & (lower | upper | title) & (size <= LONG_STRETCH) & (closing < LONG_SHAPE - 1)
        low = pc.utf8_lower(core)
        marks = pc.if_else(pa.array(closing > 0), pc.struct_field(pc.extract_regex(tokens, "(?P<m>[" + re.escape(_CLOSING) + "]*)$"), "m"), pa.scalar("", pa.large_string()))
        case = pa.array(np.where(lower, "x", np.where(upper, "X", "Xx")), pa.large_string())
        columns = [self._among("w", low), self._among("s", pc.binary_join_element_wise(case, marks, pa.scalar("", pa.large_string()))), np.where(pc.is_in(low, value_set=_INSULTS).to_numpy(zero_copy_only=False), self.at.get("l:insult", -1), -1)]
        for n in (4, 5, 6):
            columns.append(np.where(size > n, self._among(str(n), pc.utf8_slice_codeunits(low, 0, n)), -1))
        return plain, [np.where(plain, c, -1) for c in columns]

    def of(self, texts: pa.Array) -> np.ndarray:
        """(texts, features): which features each text has. A word of several texts is looked up once."""
        tokens = pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        row = np.repeat(np.arange(len(texts)), pc.list_value_length(tokens).to_numpy(zero_copy_only=False))
        coded = tokens.flatten().dictionary_encode()
        at, words = coded.indices.to_numpy(), coded.dictionary
        out = np.zeros((len(texts), len(self.names)), bool)
        plain, columns = self._plain(words)
        for c in columns:
            found = c[at]
            has = found >= 0
            out[row[has], found[has]] = True
        odd = ~plain[at]
        row, at = row[odd], at[odd]
        which = np.flatnonzero(~plain)
        found = [self.seen[w] if w else () for w in words.take(pa.array(which)).to_pylist()]
        size = np.zeros(len(words), np.int64)
        size[which] = np.fromiter(map(len, found), np.int64, len(found))
        begin, every = np.cumsum(size) - size, np.fromiter(chain.from_iterable(found), np.int64, int(size.sum()))
        step = 0
        while len(at):
            more = size[at] > step
            row, at = row[more], at[more]
            out[row, every[begin[at] + step]] = True
            step += 1
        return out


def order_of(key: str) -> Column:
    """A fixed, even order of rows for samples."""
    return F.xxhash64(F.col(f"`{key}`"), F.lit(17))


def sampled(docs: DataFrame, chosen: DataFrame, key: str, columns: list[str], most: int) -> DataFrame:
    """The rows of docs that at most `most` rows of chosen name by key, with the columns of both, stored.

    chosen is cut to the rows of least hash and broadcast: its size is bounded by `most`. Of several rows of one key the
    least values of its other columns count. Where keys of docs repeat so that more than `most` rows meet them, the least row of each key is taken.
    """
    one = chosen.groupBy(key).agg(*(F.min(c).alias(c) for c in chosen.columns if c != key)) if len(chosen.columns) > 1 else chosen.distinct()
    few = one.orderBy(order_of(key), key).limit(most)
    found = stored(documents_of(docs, key, *columns).join(F.broadcast(few), key), "sample")
    if found.count() <= most:
        return found
    others = [c for c in found.columns if c != key]
    least = stored(found.groupBy(key).agg(F.min(F.struct(*others)).alias("_least")).select(key, *(F.col(f"_least.{c}").alias(c) for c in others)), "sample")
    discard(found)
    return least


def telling(sample: DataFrame, text: str, label: Column, labels: list, top: int, support: int = 5) -> list[list[str]]:
    """For each label the features that tell its rows from the others, by the likelihood ratio; copies of a text count once.

    A feature is taken from at least `support` different texts. All labels are counted in one pass.
    """
    rows = sample.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"), F.array_position(F.array(*map(F.lit, labels)), label).cast("int").alias("_y")).filter("_y > 0").dropDuplicates(["_text", "_y"])
    size = len(labels)

    def run(parts):
        schema = pa.schema([("feature", pa.string()), *((f"n{k}", pa.int64()) for k in range(size))])
        known, counts = _Known(), [Counter() for _ in labels]
        flush = lambda: batches(((f, *(c[f] for c in counts)) for f in set().union(*counts)), schema, most=1 << 15)

        def made():
            for part in sliced(parts):
                for t, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    counts[y - 1].update(set().union(*map(known.__getitem__, set(t.split()))))
                if sum(map(len, counts)) > FLUSH:
                    yield from flush()
                    for c in counts:
                        c.clear()
            yield from flush()

        yield from tidy(made())

    kinds = "feature string, " + ", ".join(f"n{k} long" for k in range(size))
    every = sum((F.col(f"n{k}") for k in range(size)), F.lit(0))
    counts = stored(rows.mapInArrow(run, kinds).groupBy("feature").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(size))).filter(every >= support), "features")
    sizes = {r["_y"] - 1: float(r["n"]) for r in rows.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    n = sum(sizes.values())
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    out = []
    for k in range(size):
        p = sizes.get(k, 0.0)
        if not 0 < p < n:
            out.append([])
            continue
        a, both = F.col(f"n{k}").cast("double"), every.cast("double")
        b, c = both - a, F.lit(p) - a
        d = F.lit(n - p) - b
        ratio = part(a, both * (p / n)) + part(b, both * (1 - p / n)) + part(c, (c + d) * (p / n)) + part(d, (c + d) * (1 - p / n))
        out.append([r["feature"] for r in counts.withColumn("g", ratio).filter("g > 3").orderBy(F.desc("g"), "feature").limit(top).select("feature").collect()])
    discard(counts)
    return out


def presence(sample: DataFrame, features: Features, text: str, others: list[str]):
    """The sample on the driver: its other columns as a pandas frame, and a list of feature numbers a row."""
    source = sample.select(*others, f"`{text}`")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def run(parts):
        for part in sliced(parts):
            schema = pa.schema([pa.field(n, part.column(k).type) for k, n in enumerate(others)] + [pa.field("at", pa.list_(pa.int32()))])
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([np.flatnonzero(x) for x in features.of(part.columns[-1])], pa.list_(pa.int32()))], schema=schema)

    rows = source.mapInArrow(run, f"{kinds}, at array<int>").toPandas()
    rows = rows.sort_values(others[0], kind="stable").reset_index(drop=True)
    return rows[others], [np.asarray(x, np.int64) for x in rows["at"]]


class Sparse:
    """Rows of feature numbers, for products with weights."""

    def __init__(self, rows: list[np.ndarray], columns: int) -> None:
        self.n, self.columns = len(rows), columns
        self.column = np.concatenate(rows) if rows else np.empty(0, np.int64)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows]) if rows else np.empty(0, np.int64)

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.row, weights=weights[self.column, k], minlength=self.n) for k in range(weights.shape[1])], axis=1)

    def transposed_times(self, values: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.column, weights=values[self.row, k], minlength=self.columns) for k in range(values.shape[1])], axis=1)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train_softmax(rows: list[np.ndarray], columns: int, target: np.ndarray, weight: np.ndarray | None = None, l1: float = 2e-4, steps: int = 300, start: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights (columns, classes) and offsets of a linear classifier with soft targets, by accelerated proximal gradient.

    Of two classes, the first one's weights are those of the other with the opposite sign, and only these are worked on.
    It ends when CALM steps in a row gain next to nothing.
    """
    x = Sparse(rows, columns)
    size = target.shape[1]
    used = slice(1, 2) if size == 2 else slice(None)
    both = (lambda z: np.concatenate([-z, z], axis=-1)) if size == 2 else (lambda z: z)
    share = np.ones(x.n) if weight is None else weight
    share = (share / max(share.sum(), 1e-9))[:, None]
    per_row = max((len(r) for r in rows), default=0) + 1
    rate = 4.0 / np.sqrt(per_row) / 2
    w, b = (np.zeros((columns, size))[:, used], np.zeros(size)[used]) if start is None else (start[0][:, used], start[1][used])
    v, u, t = w.copy(), b.copy(), 1.0
    last, calm = np.inf, 0
    for _ in range(steps):
        p = softmax(both(x.times(v) + u))
        loss = -(share * target * np.log(p + 1e-12)).sum() + l1 * np.abs(v).sum() * (size / v.shape[1])
        if loss > last:
            rate, t, v, u = rate * 0.7, 1.0, w.copy(), b.copy()
            last = np.inf
            continue
        calm = calm + 1 if last - loss < 1e-5 * loss else 0
        if calm >= CALM:
            break
        last = loss
        error = (share * (p - target))[:, used]
        step = v - rate * x.transposed_times(error)
        new = np.sign(step) * np.maximum(np.abs(step) - rate * l1, 0)
        new_b = u - rate * error.sum(axis=0)
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, u = new + (t - 1) / t_next * (new - w), new_b + (t - 1) / t_next * (new_b - b)
        w, b, t = new, new_b, t_next
    return both(w), both(b)
