"""Language-model scoring by Brown class-based bigrams with exchange clustering.

Tokens are the lower-cased (A-Z) words of a text and one end. Counts and classes of all words of the training rows stay
a distributed table. Classes are found in two steps. First, exchange clustering on a matrix of fixed size, summed over
all training tokens, whose units are the UNIT_WORDS most frequent words and, for all others, shapes (the last two
characters before closing punctuation, and that punctuation): it moves one unit at a time to the class that raises the
likelihood of the class bigrams most, until no sweep gains. Then every other word seen OWN_COUNT times or more is put on
its own: the classes of its neighbours are summed over all training tokens, and it goes to the class under which these
are likeliest, what it gave to the class it is in taken off. Shapes decide for rarer words and words not in training.

P(text) is the product over tokens of P(class | class before) * P(word | class). Class transitions are counted anew
under the words' final classes and smoothed towards the classes' own shares; word emissions are discounted by an
absolute amount estimated from words seen once and twice, and what is taken off is the class's share for words never
seen in training.

Counting and scoring look the HEAD most frequent words up in a broadcast list (bounded: HEAD words of HEAD_BYTES bytes
at most); the counts and classes of all others, and so the transitions from and to them, come by joins with the word
table, so nothing is left out.

Defined results: a null text counts as empty and has the end alone; a null key is held in training (its checksum counts
as nought); repeated rows each count and each get their row; with no training rows N is 0 and all words are unknown.
"""

from __future__ import annotations

from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import discard, documents_of, sliced, stored, tidy, whole_groups

HEAD, HEAD_BYTES = 200_000, 64
UNIT_WORDS, UNIT_SHAPES = 1024, 508
CLASSES, SWEEPS = 48, 12
#: Words seen so often or more have a class by their own neighbours.
OWN_COUNT = 3
#: Strength of the classes' own shares in a class's transitions.
TRANSITION_WEIGHT = 20.0
#: Distinct words, and distinct neighbour counts, that a task holds before it passes them on.
FLUSH_WORDS, FLUSH_CODES = 400_000, 1 << 22
#: Bits of the filter through which words go before their neighbours are counted: two megabytes.
FILTER_BITS = 1 << 24
END = b""  # no word is empty

_CLOSING = ".,;:!?)]}\"'%$*#&|"


class Coded:
    """The words of a batch of texts, each text's end behind them: at (numbers), words (bytes by number), first (where texts begin), sizes."""

    def __init__(self, texts: pa.Array) -> None:
        # pyarrow 23 lower-cases slices of large strings wrongly, so this comes before the cast
        low = pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), ""))
        lists = pc.ascii_split_whitespace(low.cast(pa.large_string()))
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        held = lists.flatten().dictionary_encode()
        at, self.told = held.indices.to_numpy().astype(np.int64), held.dictionary.cast(pa.large_binary())
        self.end = pc.index(self.told, pa.scalar(END, pa.large_binary())).as_py()
        if self.end >= 0:  # white space at a text's edges gives empty words
            full = at != self.end
            sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[full], minlength=len(sizes))
            at = at[full]
        else:
            self.end = len(self.told)
            self.told = pa.concat_arrays([self.told, pa.array([END], pa.large_binary())])
        self.words = self.told.to_pylist()
        self.at = np.insert(at, np.cumsum(sizes), self.end)
        self.sizes = sizes + 1
        self.first = np.cumsum(self.sizes) - self.sizes
        self.row = np.repeat(np.arange(len(sizes)), self.sizes)

    def before(self, values: np.ndarray) -> np.ndarray:
        """The value (by word) of the token before each token; 0, which the end has, at the beginning of a text."""
        out = np.concatenate([[0], values[self.at[:-1]]]) if len(self.at) else values[:0]
        out[self.first] = 0
        return out

    def texts_sum(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=values, minlength=len(self.sizes))


def coded(parts, column: int = 0):
    """The batches, two at a time, each with the words of its texts: the more texts, the fewer different words are looked up."""
    held: list[pa.RecordBatch] = []
    for part in sliced(parts, 1024):
        held.append(part)
        if sum(x.num_rows for x in held) >= 2048:
            one, held = pa.concat_batches(held), []
            yield one, Coded(one.column(column))
    if held:
        one = pa.concat_batches(held)
        yield one, Coded(one.column(column))


def shapes(words: pa.Array) -> pa.Array:
    """Of words (large binary) the last two characters before closing punctuation, and the word's last mark if there is such; bytes that are no text give a shape of their own."""
    try:
        texts = words.cast(pa.large_string())
    except pa.ArrowInvalid:
        texts = pa.array([w.decode("utf-8", "replace") for w in words.to_pylist()], pa.large_string())
    core = pc.utf8_rtrim(texts, characters=_CLOSING)
    marked = pc.less(pc.binary_length(core), pc.binary_length(texts))
    nothing = pa.scalar("", pa.large_string())
    mark = pc.if_else(marked, pc.utf8_slice_codeunits(texts, -1), nothing)
    return pc.binary_join_element_wise(pc.utf8_slice_codeunits(core, -2), mark, pa.scalar(" ", pa.large_string()))


def held_out(key: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


def word_counts(texts: DataFrame) -> DataFrame:
    """word (binary), c over all rows of the one text column; counted in part before the shuffle."""
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64())])

    def run(parts):
        count: dict[bytes, int] = {}

        def made():
            nonlocal count
            for _, texts_ in coded(parts):
                for w, n in zip(texts_.words, np.bincount(texts_.at, minlength=len(texts_.words)).tolist(), strict=True):
                    count[w] = count.get(w, 0) + n
                if len(count) > FLUSH_WORDS:
                    yield pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.binary()), pa.array(count.values(), pa.int64())], schema=schema)
                    count = {}
            yield pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.binary()), pa.array(count.values(), pa.int64())], schema=schema)

        yield from tidy(made())

    return texts.mapInArrow(run, "word binary, c long").filter("c > 0").groupBy("word").agg(F.sum("c").alias("c"))


class Units:
    """Which unit a word belongs to: 0 the end, then frequent words, then shapes, then the rest by closing mark."""

    def __init__(self, words: list[bytes], shapes_: list[str]) -> None:
        self.words = pa.array([END, *(w for w in words if w != END)], pa.large_binary())
        self.shapes = pa.array(shapes_, pa.large_string())
        self.rest = len(self.words) + len(self.shapes)
        self.size = self.rest + 2

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The units of words (large binary), and which words are units of their own."""
        own = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        shape = shapes(words)
        by = pc.fill_null(pc.index_in(shape, value_set=self.shapes), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        marked = np.invert(pc.ends_with(shape, " ").to_numpy(zero_copy_only=False))
        return np.where(own >= 0, own, np.where(by >= 0, len(self.words) + by, self.rest + marked)), own >= 0


def unit_bigrams(texts: DataFrame, units: Units) -> np.ndarray:
    """How often one unit follows another, over all rows; the end goes before a text's first word."""
    size = units.size

    def run(parts):
        total = np.zeros(size * size, np.int64)
        for _, t in coded(parts):
            of, _ = units.of(t.told)
            total += np.bincount(t.before(of) * size + of[t.at], minlength=size * size)
        codes = np.flatnonzero(total)
        for at in range(0, len(codes), 1 << 16):
            part = codes[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["code", "n"])

    rows = texts.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[rows["code"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(size, size)


def _phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit. Unit 0, the end, keeps class 0 for itself; the others begin dealt out by frequency."""
    size = len(bigrams)
    weight = bigrams.sum(axis=0) + bigrams.sum(axis=1)
    classes = max(2, min(classes, size))
    own = np.zeros(size, np.int64)
    own[1 + np.argsort(-weight[1:], kind="stable")] = 1 + np.arange(size - 1) % (classes - 1)
    member = np.eye(classes)[own]
    grid = member.T @ bigrams @ member
    rows, cols = grid.sum(axis=1), grid.sum(axis=0)
    order = [u for u in 1 + np.argsort(-weight[1:], kind="stable") if weight[u] > 0]
    choices = np.arange(classes)
    for _ in range(sweeps):
        moves = 0
        for u in order:
            g, same = own[u], bigrams[u, u]
            after = np.bincount(own, weights=bigrams[u], minlength=classes)
            before = np.bincount(own, weights=bigrams[:, u], minlength=classes)
            after[g] -= same
            before[g] -= same
            grid[g] -= after
            grid[:, g] -= before
            grid[g, g] -= same
            out, into = after.sum() + same, before.sum() + same
            rows[g] -= out
            cols[g] -= into
            gain = (_phi(grid + after[None, :]) - _phi(grid)).sum(axis=1) + (_phi(grid + before[:, None]) - _phi(grid)).sum(axis=0)
            diagonal = grid[choices, choices]
            gain -= _phi(diagonal + after) - _phi(diagonal) + _phi(diagonal + before) - _phi(diagonal)
            gain += _phi(diagonal + after + before + same) - _phi(diagonal)
            gain -= _phi(rows + out) - _phi(rows) + _phi(cols + into) - _phi(cols)
            gain[0] = -np.inf
            h = int(gain.argmax()) if gain.max() > gain[g] + 1e-9 else g
            moves += h != g
            own[u] = h
            grid[h] += after
            grid[:, h] += before
            grid[h, h] += same
            rows[h] += out
            cols[h] += into
        if not moves:
            break
    return own


def listed(words: pa.Array, word: np.ndarray, columns: list[np.ndarray], kinds: list[pa.DataType], more: list[pa.Array]) -> list[pa.Array]:
    """Arrays by word from sorted rows (word number, values): the words that occur, lists of the values, and what else is said of each row's word."""
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.empty(0, np.int64)
    offsets = pa.array(np.append(first, len(word)), pa.int32())
    return [words.take(pa.array(word[first])), *(m.take(pa.array(first)) for m in more), *(pa.ListArray.from_arrays(offsets, pa.array(c, k)) for c, k in zip(columns, kinds, strict=True))]


class Often:
    """Whether words are among those seen OWN_COUNT times or more, by a bitmap of FILTER_BITS bits at any size; some others pass, too."""

    def __init__(self, counted: DataFrame) -> None:
        bit = F.pmod(F.crc32("word"), F.lit(FILTER_BITS))
        few = counted.filter(F.col("c") >= OWN_COUNT).select(F.floor(bit / 32).cast("int").alias("place"), (bit % 32).cast("int").alias("by"))
        held = few.groupBy("place").agg(F.expr("bit_or(shiftleft(1L, by))").alias("bits")).toArrow()
        self.bits = np.zeros(FILTER_BITS // 32, np.uint32)
        self.bits[held["place"].to_numpy()] = held["bits"].to_numpy().astype(np.uint32)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        bit = np.fromiter(map(crc32, words), np.int64, len(words)) % FILTER_BITS
        return (self.bits[bit // 32] >> (bit % 32).astype(np.uint32) & np.uint32(1)).astype(bool)


def neighbours(texts: DataFrame, units: Units, own: np.ndarray, often: Often) -> DataFrame:
    """word, codes, n of words that aren't units of their own and are seen often, a row for each task that has met a word, those of a word together: how often a word follows a class (code: the class) and goes before one (code: the class and the number of classes)."""
    size = int(own.max()) + 1
    schema = pa.schema([("word", pa.binary()), ("codes", pa.list_(pa.int16())), ("n", pa.list_(pa.int64()))])

    def run(parts):
        numbers: dict[bytes, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        codes = 0

        def flush():
            nonlocal numbers, held, codes
            code, back = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            n = np.bincount(back, weights=np.concatenate([c for _, c in held])).astype(np.int64)
            words = pa.array(numbers.keys(), pa.binary())
            for low in range(0, len(words), 1 << 14):
                a, b = np.searchsorted(code, [low * 2 * size, (low + (1 << 14)) * 2 * size])
                yield pa.RecordBatch.from_arrays(listed(words, code[a:b] // (2 * size), [code[a:b] % (2 * size), n[a:b]], [pa.int16(), pa.int64()], []), schema=schema)
            numbers, held, codes = {}, [], 0

        def made():
            nonlocal codes
            for _, t in coded(parts):
                of, alone = units.of(t.told)
                free = ~alone & often(t.words)
                cls = own[of]
                here = free[t.at]  # no end is, after which another text comes
                follows = (t.at * (2 * size) + t.before(cls))[here]
                goes = (t.at[:-1] * (2 * size) + size + cls[t.at[1:]])[here[:-1]]
                code, n = np.unique(np.concatenate([follows, goes]), return_counts=True)
                word = code // (2 * size)
                met = np.unique(word)
                place = np.zeros(len(t.words), np.int64)
                place[met] = [numbers.setdefault(t.words[k], len(numbers)) for k in met.tolist()]
                held.append((place[word] * (2 * size) + code % (2 * size), n))
                codes += len(code)
                if codes > FLUSH_CODES or len(numbers) > FLUSH_WORDS:
                    yield from flush()
            if held:
                yield from flush()

        yield from tidy(made())

    return texts.mapInArrow(run, "word binary, codes array<smallint>, n array<long>").repartition("word").sortWithinPartitions("word")


def likeliest(counts: np.ndarray, now: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """The class of each word by its neighbours (rows of counts as in neighbours()); now: the classes that hold their counts in grid."""
    size = len(grid)
    before, after = counts[:, :size], counts[:, size:]
    share = [(grid.sum(axis=k) + 1) / (grid.sum() + size) * TRANSITION_WEIGHT for k in (0, 1)]
    to, since = (np.log((g + w) / (g.sum(axis=1, keepdims=True) + TRANSITION_WEIGHT)) for g, w in zip((grid, grid.T), share, strict=True))
    fit = after @ to.T + before @ since.T
    left = np.zeros(len(counts))
    for own, g, w in ((after, grid, share[0]), (before, grid.T, share[1])):
        rest = np.maximum(g[now] - own, 0)
        left += (own * np.log((rest + w) / (rest.sum(axis=1, keepdims=True) + TRANSITION_WEIGHT))).sum(axis=1)
    fit[np.arange(len(counts)), now] = left
    fit[:, 0] = -np.inf
    return fit.argmax(axis=1)


def word_classes(counted: DataFrame, texts: DataFrame, units: Units, own: np.ndarray, bigrams: np.ndarray, often: Often) -> DataFrame:
    """word, c, class of every training word: the unit's for units of their own and words seen seldom, else the one its neighbours fit best."""
    size = int(own.max()) + 1
    member = np.eye(size)[own]
    grid = member.T @ bigrams @ member

    def fitted(parts):
        for part in whole_groups(parts, 1):
            word, codes, n = part.column(0), part.column(1), part.column(2)
            begins = np.r_[True, pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False)]
            row = np.repeat(np.cumsum(begins) - 1, pc.list_value_length(codes).to_numpy(zero_copy_only=False))
            met = int(begins.sum())
            counts = np.bincount(row * (2 * size) + codes.flatten().to_numpy().astype(np.int64), weights=n.flatten().to_numpy(), minlength=met * 2 * size).reshape(met, 2 * size)
            free = counts[:, :size].sum(axis=1) >= OWN_COUNT  # others have passed the bitmap by chance
            words = word.filter(pa.array(begins)).filter(pa.array(free))
            now = own[units.of(words.cast(pa.large_binary()))[0]]
            yield pa.RecordBatch.from_arrays([words, pa.array(likeliest(counts[free], now, grid), pa.int32())], names=["word", "own"])

    def shaped(parts):
        for part in sliced(parts, 1 << 14):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own[units.of(part.column(0).cast(pa.large_binary()))[0]], pa.int32())], names=["word", "c", "shaped"])

    fit = neighbours(texts, units, own, often).mapInArrow(lambda parts: tidy(fitted(parts)), "word binary, own int")
    every = counted.select("word", "c").mapInArrow(lambda parts: tidy(shaped(parts)), "word binary, c long, shaped int")
    return every.join(fit, "word", "left").select("word", "c", F.coalesce("own", "shaped").alias("class"))


class Model:
    """Counts, classes and log10 probabilities of the head; units and own tell the classes of words that aren't in training."""

    def __init__(self, head: list[tuple[bytes, int, int]], units: Units, own: np.ndarray, tokens: np.ndarray, types: np.ndarray, total: int, distinct: int, discount: float, often: Often) -> None:
        self.often = often
        self.units, self.own, self.total, self.distinct, self.discount = units, own, total, distinct, discount
        self.size = len(tokens)
        self.class_tokens = tokens
        with np.errstate(divide="ignore", invalid="ignore"):
            self.unknown = np.where(tokens > 0, np.log10(discount * types / tokens), np.log10(discount / max(total + distinct, 1)))  # a class without training tokens gives what one token of all has
        self.per_class = np.log10(np.maximum(tokens, 1))
        self.head = pa.array([w for w, _, _ in head], pa.large_binary())
        counts = np.array([c for _, c, _ in head], np.float64)
        self.head_class = np.array([k for _, _, k in head], np.int64)
        self.head_base = np.log10((counts + 1) / (total + distinct + 1))
        self.head_score = np.log10(np.maximum(counts - discount, 1e-9)) - self.per_class[self.head_class] if len(head) else counts
        self.moves = np.zeros((self.size, self.size))

    def set_moves(self, grid: np.ndarray) -> None:
        share = (grid.sum(axis=0) + 1) / (grid.sum() + self.size)
        self.moves = np.log10((grid + TRANSITION_WEIGHT * share) / (grid.sum(axis=1, keepdims=True) + TRANSITION_WEIGHT))


def class_bigrams(texts: DataFrame, model: Model, vocabulary: DataFrame) -> np.ndarray:
    """How often one class follows another, over all rows: between words whose class is at hand at once, from and to all others by joins."""
    size = model.size
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(parts):
        own, total = shared.value, np.zeros(size * size, np.int64)
        schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("code", pa.int32()), ("n", pa.int64())])

        def made():
            for _, t in coded(parts):
                _, cls = placed(own, t)
                before, now = t.before(cls), cls[t.at]
                both = (before >= 0) & (now >= 0)
                np.add.at(total, before[both] * size + now[both], 1)
                words = pa.array(t.words, pa.binary())
                word, code, _ = beside(t, cls, size)
                key, n = np.unique(word * (2 * size) + code, return_counts=True)
                yield pa.RecordBatch.from_arrays([words.take(pa.array(key // (2 * size))), pa.nulls(len(key), pa.binary()), pa.array(key % (2 * size), pa.int32()), pa.array(n)], schema=schema)
                a, b, _ = pairs_outside(t, cls)
                key, n = np.unique(a * len(words) + b, return_counts=True)
                yield pa.RecordBatch.from_arrays([words.take(pa.array(key // len(words))), words.take(pa.array(key % len(words))), pa.array(np.full(len(key), -1), pa.int32()), pa.array(n)], schema=schema)
            codes = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(codes), pa.binary()), pa.nulls(len(codes), pa.binary()), pa.array(codes, pa.int32()), pa.array(total[codes])], schema=schema)

        yield from tidy(made())

    found = stored(texts.mapInArrow(run, "a binary, b binary, code int, n long"), "transitions")
    known = vocabulary.select("word", "class")
    at_a, at_b = (known.select(F.col("word").alias(x), F.col("class").alias(f"class_{x}")) for x in ("a", "b"))
    one = found.filter("b is null and a is not null").join(at_a, "a")
    place = F.when(F.col("code") < size, F.col("code") * size + F.col("class_a")).otherwise(F.col("class_a") * size + F.col("code") - size)
    two = found.filter("b is not null").join(at_a, "a").join(at_b, "b")
    parts = found.filter("a is null").select("code", "n").unionByName(one.select(place.alias("code"), "n")).unionByName(two.select((F.col("class_a") * size + F.col("class_b")).alias("code"), "n"))
    grid = np.zeros(size * size)
    for r in parts.groupBy("code").agg(F.sum("n").alias("n")).collect():
        grid[r["code"]] = r["n"]
    discard(found)
    return grid.reshape(size, size)


def fit(texts: DataFrame, counted: DataFrame) -> tuple[Model, DataFrame]:
    """texts: the training rows' one text column; counted: word_counts(texts), stored. The model, and word, c, class of all words, stored."""
    facts = counted.agg(F.sum("c").alias("total"), F.count("*").alias("types"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).first()
    once, twice = facts["once"], facts["twice"]
    discount = float(np.clip(once / (once + 2 * twice), 0.1, 0.95)) if once else 0.5

    def of_shapes(parts):
        for part in sliced(parts, 1 << 16):
            sums = pa.table([shapes(part.column(0).cast(pa.large_binary())), part.column(1)], names=["shape", "n"]).group_by("shape").aggregate([("n", "sum")])
            yield from sums.rename_columns({"n_sum": "n"}).select(["shape", "n"]).cast(pa.schema([("shape", pa.string()), ("n", pa.int64())])).to_batches()

    common = counted.select("word", "c").mapInArrow(of_shapes, "shape string, n long").groupBy("shape").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "shape").limit(UNIT_SHAPES).collect()
    frequent = counted.filter(F.octet_length("word") <= HEAD_BYTES).orderBy(F.desc("c"), "word").limit(UNIT_WORDS).select("word").collect()
    units = Units([bytes(r["word"]) for r in frequent], [r["shape"] for r in common])
    bigrams = unit_bigrams(texts, units)
    own = exchange(bigrams)
    often = Often(counted)
    vocabulary = stored(word_classes(counted, texts, units, own, bigrams, often), "classes")
    size = int(own.max()) + 1
    tokens, types = np.zeros(size), np.zeros(size)
    for r in vocabulary.groupBy("class").agg(F.sum("c").alias("tokens"), F.count("*").alias("types")).collect():
        tokens[r["class"]], types[r["class"]] = r["tokens"], r["types"]
    short = vocabulary.filter(F.octet_length("word") <= HEAD_BYTES)
    level = F.floor(F.log2("c") * 8)
    levels = sorted(((r["level"], r["n"]) for r in short.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)
    fits = [k for (k, _), sum_ in zip(levels, accumulate(n for _, n in levels), strict=True) if sum_ <= HEAD]
    head = short.filter(level >= fits[-1]).select("word", "c", "class").toArrow() if fits else None  # found by its least count: no task sends more than what stays
    head = sorted(zip(*(x.to_pylist() for x in head.columns), strict=True)) if head else []
    model = Model(head, units, own, tokens, types, facts["total"] or 0, facts["types"], discount, often)
    model.set_moves(class_bigrams(texts, model, vocabulary))
    return model, vocabulary


def placed(model: Model, t: Coded) -> tuple[np.ndarray, np.ndarray]:
    """Words' places in the head, -1 outside of it, and their classes, -1 where the vocabulary has to tell.

    Words outside the head that aren't seen often have the class of their shape, and so have words not in training.
    """
    at = pc.fill_null(pc.index_in(t.told, value_set=model.head), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    cls = np.where(at >= 0, model.head_class[at], -1) if len(model.head) else at.copy()
    out = np.flatnonzero(at < 0)
    shaped = model.own[model.units.of(t.told.take(pa.array(out)))[0]]
    seldom = ~model.often([t.words[k] for k in out.tolist()]) & (out != t.end)
    cls[out] = np.where(seldom, shaped, -1)
    return at, cls


def beside(t: Coded, cls: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words without a class that have one with a class (or the text's start) on a side: word, code as in neighbours(), the token's place."""
    now, before = cls[t.at], t.before(cls)
    left = np.flatnonzero((now < 0) & (before >= 0))
    right = np.flatnonzero((now[:-1] < 0) & (now[1:] >= 0) & (t.row[:-1] == t.row[1:]))
    return np.concatenate([t.at[left], t.at[right]]), np.concatenate([before[left], size + now[right + 1]]), np.concatenate([left, right])


def pairs_outside(t: Coded, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours that both have no class: two words, and the first one's place."""
    out = cls[t.at] < 0
    k = np.flatnonzero(out[:-1] & out[1:] & (t.row[:-1] == t.row[1:]))
    return t.at[k], t.at[k + 1], k


SCORE = "_row long, n_tokens long, n_head long, base double, score double, word binary, other binary, times long, shaped int, shaped_other int, codes array<int>"


def score(docs: DataFrame, model: Model, vocabulary: DataFrame, key: str = "doc_id", text: str = "text", table: bool = False) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of every row. table: docs is read from files as it is, else it is stored first.

    A task gives a row for each text with the sums over its words in the head, and for each of its other words, and pairs of
    them, a row to be joined with the vocabulary. Only texts that are held out can have words that aren't in it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs if table else stored(documents_of(docs, key, text), "lm-input")  # rows are told apart by their place in a table
    source = stored(documents_of(docs, key, text).select(F.monotonically_increasing_id().alias("_row"), F.col(f"`{key}`").alias("_key"), held_out(key).alias("_out")), "keys")
    texts = documents_of(docs, key, text).select(F.monotonically_increasing_id().alias("_row"), held_out(key).alias("_out"), F.col(f"`{text}`").alias("_text"))

    def run(parts):
        own = shared.value
        size = own.size
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32())]
        schema = pa.schema([pa.field(c.split()[0], k) for c, k in zip(SCORE.split(", "), kinds, strict=True)])
        batch = lambda n, **given: pa.RecordBatch.from_arrays([given[f.name].cast(f.type) if f.name in given else pa.nulls(n, f.type) for f in schema], schema=schema)

        def made():
            for part, t in coded(parts, 2):
                at, cls = placed(own, t)
                place, now, before = at[t.at], cls[t.at], t.before(cls)
                known, both = place >= 0, (before >= 0) & (now >= 0)
                base, total = np.zeros(len(place)), np.zeros(len(place))
                base[known], total[known] = own.head_base[place[known]], own.head_score[place[known]]
                total[both] += own.moves[before[both], now[both]]
                rows, words = part.column(0), pa.array(t.words, pa.binary())
                yield batch(len(rows), _row=rows, n_tokens=pa.array(t.sizes), n_head=pa.array(t.texts_sum(known)), base=pa.array(t.texts_sum(base)), score=pa.array(t.texts_sum(total)))
                out = part.column(1).to_numpy(zero_copy_only=False)
                met = np.unique(t.at[~known & out[t.row]])
                shaped = np.where(at < 0, cls, -1)
                shaped[met] = own.own[own.units.of(t.told.take(pa.array(met)))[0]]
                width = len(t.words)
                code, n = np.unique(t.row[~known] * width + t.at[~known], return_counts=True)  # a text's other words
                word, by, where = beside(t, cls, size)
                order = np.argsort(t.row[where] * width + word, kind="stable")
                of = (t.row[where] * width + word)[order]
                begin = np.searchsorted(of, code)
                lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(of)), pa.int32()), pa.array(by[order], pa.int32()))
                yield batch(len(code), _row=rows.take(pa.array(code // width)), word=words.take(pa.array(code % width)), times=pa.array(n), shaped=pa.array(shaped[code % width]), codes=lists)
                a, b, where = pairs_outside(t, cls)
                code, n = np.unique((t.row[where] * width + a) * width + b, return_counts=True)
                a, b = code // width % width, code % width
                yield batch(len(code), _row=rows.take(pa.array(code // width // width)), word=words.take(pa.array(a)), other=words.take(pa.array(b)), times=pa.array(n), shaped=pa.array(shaped[a]), shaped_other=pa.array(shaped[b]))

        yield from tidy(made())

    part = stored(texts.mapInArrow(run, SCORE), "scores")
    total, distinct = F.lit(float(model.total)), F.lit(float(model.distinct))
    least, size = F.lit(model.discount), model.size
    numbers = lambda xs: F.expr("array(" + ", ".join(f"{float(x)!r}D" for x in xs) + ")")
    unknown, per_class, moves = numbers(model.unknown), numbers(model.per_class), numbers(model.moves.ravel())
    rest = part.filter("word is not null and other is null").select("_row", "word", "times", "shaped", "codes").join(vocabulary, "word", "left").withColumn("class", F.coalesce("class", "shaped"))
    cls = F.col("class") + 1
    emitted = F.when(F.col("c").isNotNull(), F.log10(F.greatest(F.col("c") - least, F.lit(1e-9))) - F.element_at(per_class, cls)).otherwise(F.element_at(unknown, cls))
    place = lambda x: F.when(x < size, x * size + F.col("class")).otherwise(F.col("class") * size + x - size)
    moved = F.aggregate("codes", F.lit(0.0), lambda sum_, x: sum_ + F.element_at(moves, place(x) + 1))
    single = rest.select(
        "_row",
        F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0).alias("_known"),
        (F.col("times") * F.log10((F.coalesce("c", F.lit(0)) + 1) / (total + distinct + 1))).alias("_base"),
        (F.col("times") * emitted + moved).alias("_score"),
    )
    at_a, at_b = (vocabulary.select(F.col("word").alias(x), F.col("class").alias(f"class_{x}")) for x in ("word", "other"))
    two = part.filter("other is not null").select("_row", "word", "other", "times", "shaped", "shaped_other").join(at_a, "word", "left").join(at_b, "other", "left")
    double = two.select("_row", F.lit(0).cast("long").alias("_known"), F.lit(0.0).alias("_base"), (F.col("times") * F.element_at(moves, F.coalesce("class_word", "shaped") * size + F.coalesce("class_other", "shaped_other") + 1)).alias("_score"))
    head = part.filter("word is null").select("_row", F.col("n_head").alias("_known"), F.col("base").alias("_base"), F.col("score").alias("_score"), "n_tokens")
    none = F.lit(None).cast("long").alias("n_tokens")
    sums = single.select("*", none).unionByName(double.select("*", none)).unionByName(head).groupBy("_row").agg(*(F.sum(c).alias(c) for c in ("_known", "_base", "_score")), F.max("n_tokens").alias("n_tokens"))
    return source.join(sums, "_row").select(F.col("_key").alias(key), F.col("_out").alias("held_out"), "n_tokens", F.col("_known").alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), F.col("_base").alias("base_score"), F.col("_score").alias("score"))


def train_and_score(docs: DataFrame, key: str = "doc_id", text: str = "text", table: bool = False) -> DataFrame:
    """Train on the rows that aren't held out, score all. table: docs is read from files as it is, else it is stored first."""
    docs = docs if table else stored(documents_of(docs, key, text), "lm-input")
    texts = documents_of(docs, key, text).filter(~held_out(key)).select(f"`{text}`")
    counted = stored(word_counts(texts), "words")
    model, vocabulary = fit(texts, counted)
    discard(counted)
    return score(docs, model, vocabulary, key, text, table=True)
