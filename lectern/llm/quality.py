"""Quality by co-training of two views: what a text says, and what is known about it.

The content view is a linear classifier on the text's telling features (words, word beginnings, token shapes). The
metadata view is one on the columns source and lang and on the layout: length, lines, how long and how equal they are,
shares of marks, capitals and digits, repeated lines. Both are fitted on a bounded sample of labelled rows; then, for
ROUNDS rounds, each labels the rows of a bounded unlabelled pool of which it is most sure, and the other is fitted
again with these added. Both are calibrated on labelled rows kept apart, and a logistic combination of the calibrated
views, fitted on these rows too, scores all documents.

Defined results: a null text counts as empty, null metadata as a value of its own; repeated rows each get their row;
without labels of both classes every document scores the share of good labels there are (1 without any labels, so that
nothing is rejected); an empty table gives an empty result. Columns that the input lacks are read as null.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import ASCII_UPPER, discard, documents_of, sliced, tidy
from lectern.llm.lexical import Features, presence, sampled, telling, train_softmax

LABELLED, POOL, TELLING = 15_000, 10_000, 2000
#: Co-training rounds; pool rows that a view labels in each, of either class; how sure it must be.
ROUNDS, NEW_ROWS, SURE = 4, 400, 0.95
#: Documents whose probability of good quality is lower are rejected.
REJECT_BELOW = 0.5
HASHED = 64


_CAPITALS = ASCII_UPPER.encode()


def capitals(text: str) -> int:
    """Upper-case characters of the whole text."""
    return len(text) - len(text.encode().translate(None, _CAPITALS)) if text.isascii() else sum(map(str.isupper, text))


def metadata(source: str | None, lang: str | None, text: str) -> list[float]:
    """The numbers of the metadata view, each about between -3 and 3."""
    n = len(text)
    lines = text.split("\n")
    sizes = [len(x) for x in lines]
    mean = sum(sizes) / len(sizes)
    spread = math.sqrt(sum((s - mean) ** 2 for s in sizes) / len(sizes))
    upper = capitals(text) / max(1, n)
    marks = sum(text.count(c) for c in "!|%$*#&<>{}[]=_~^@/\\") / max(1, n)
    stops = sum(text.count(c) for c in ".,;:?") / max(1, n)
    digits = sum(text.count(c) for c in "0123456789") / max(1, n)
    spaces = text.count(" ") / max(1, n)
    repeated = 1 - len(set(lines)) / len(lines)
    return [math.log1p(n) / 5 - 1.5, math.log1p(len(lines)) / 3 - 1, math.log1p(mean) / 4 - 1, math.log1p(spread) / 4 - 1, min(3.0, 5 * upper), min(3.0, 30 * marks), min(3.0, 20 * stops), min(3.0, 20 * digits), min(3.0, 8 * spaces), 2 * repeated]


DENSE = 10


def _hashed(source: str | None, lang: str | None) -> list[int]:
    """Numbers of the two columns' values: lang in the first HASHED, source in the next."""
    place = lambda x: 0 if x is None else 1 + sum((k + 1) * b for k, b in enumerate(x.encode())) % (HASHED - 1)
    return [place(lang), HASHED + place(source)]


class MetaView:
    """Logistic regression by Newton steps on the dense numbers (and their squares) and the hashed columns, with a ridge."""

    def __init__(self) -> None:
        self.w = np.zeros(1 + 2 * DENSE + 2 * HASHED)

    @staticmethod
    def design(dense: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        out = np.zeros((len(dense), 1 + 2 * DENSE + 2 * HASHED))
        out[:, 0] = 1
        out[:, 1 : 1 + DENSE] = dense
        out[:, 1 + DENSE : 1 + 2 * DENSE] = dense**2
        for k in range(hashed.shape[1]):
            out[np.arange(len(dense)), 1 + 2 * DENSE + hashed[:, k]] = 1
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        self.w = newton(x, y, weight, 3.0)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w


def newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 25) -> np.ndarray:
    w = np.zeros(x.shape[1])
    hold = np.full(x.shape[1], ridge)
    hold[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + hold * w
        bend = (x * (weight * (p * (1 - p) + 1e-6))[:, None]).T @ x + np.diag(hold)
        move = np.linalg.solve(bend, slope)
        w -= move * min(1.0, 5.0 / (np.abs(move).max() + 1e-12))
        if np.abs(move).max() < 1e-6:
            break
    return w


class Scorer:
    """Both views, their calibrations, and the combination."""

    def __init__(self, features: Features, weights: np.ndarray, offset: float, meta: MetaView, calibration: list[np.ndarray], blend: np.ndarray, constant: float | None = None) -> None:
        self.features, self.weights, self.offset, self.meta, self.calibration, self.blend, self.constant = features, weights, offset, meta, calibration, blend, constant

    def combined(self, content: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sure = [1 / (1 + np.exp(-np.clip(c[0] + c[1] * v, -30, 30))) for c, v in zip(self.calibration, (content, meta), strict=True)]
        logits = [np.log(p / (1 - p)) for p in (np.clip(s, 1e-6, 1 - 1e-6) for s in sure)]
        return 1 / (1 + np.exp(-(self.blend[0] + self.blend[1] * logits[0] + self.blend[2] * logits[1]))), sure[0], sure[1]

    def __call__(self, sources: list, langs: list, given: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.constant is not None:
            same = np.full(len(given), self.constant)
            return same, same, same
        texts = [t or "" for t in given.to_pylist()]
        content = self.offset + self.features.of(given).astype(np.float32) @ self.weights.astype(np.float32)
        dense = np.array([metadata(s, g, t) for s, g, t in zip(sources, langs, texts, strict=True)]).reshape(len(texts), DENSE)
        hashed = np.array([_hashed(s, g) for s, g in zip(sources, langs, strict=True)]).reshape(len(texts), 2)
        return self.combined(content, self.meta.logit(MetaView.design(dense, hashed)))


def _with_columns(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, text, _source, _lang; columns that aren't there are null."""
    own = lambda n: (F.col(f"`{n}`").cast("string") if n in docs.columns else F.lit(None).cast("string")).alias(f"_{n}")
    return docs.select(f"`{key}`", f"`{text}`", own("source"), own("lang"))


def _layout(sample: DataFrame, text: str) -> DataFrame:
    """The metadata view's numbers as a column `dense`."""
    others = [f for f in sample.schema.fields]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)

    def run(parts):
        for part in parts:
            at = {f: k for k, f in enumerate(part.schema.names)}
            rows = zip(*(part.column(at[c]).to_pylist() for c in ("_source", "_lang", text)), strict=True)
            dense = pa.array([metadata(s, g, t or "") for s, g, t in rows], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*part.columns, dense], names=[*part.schema.names, "dense"])

    return sample.mapInArrow(run, f"{kinds}, dense array<double>")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", labelled: int = LABELLED, pool: int = POOL) -> Scorer:
    known = documents_of(labels, key, label).filter(F.col(f"`{label}`").isNotNull() & F.col(f"`{key}`").isNotNull()).withColumnRenamed(label, "_good")
    rows = _with_columns(docs, key, text)
    sample = sampled(rows, known, key, [text, "_source", "_lang"], labelled)
    names = telling(sample, text, F.col("_good"), [0, 1], TELLING)[1]
    facts = sample.agg(F.avg((F.col("_good") == 1).cast("double")).alias("share")).first()
    if not names or facts["share"] in (None, 0.0, 1.0):
        discard(sample)
        return Scorer(Features([]), np.zeros(0), 0.0, MetaView(), [], np.zeros(3), 1.0 if facts["share"] is None else facts["share"])
    features = Features(names)
    others = rows.filter(F.col(f"`{key}`").isNotNull()).select(f"`{key}`").join(F.broadcast(sample.select(key).distinct()), key, "left_anti")
    more = sampled(rows, others, key, [text, "_source", "_lang"], pool)
    drawn = []
    for part, columns in ((sample, [key, "_good", "_source", "_lang", "dense"]), (more, [key, "_source", "_lang", "dense"])):
        frame, at = presence(_layout(part, text), features, text, columns)
        dense = np.array(frame["dense"].tolist(), float).reshape(len(frame), DENSE)
        hashed = np.array([_hashed(s, g) for s, g in zip(frame["_source"], frame["_lang"], strict=True)], int).reshape(len(frame), 2)
        drawn.append((frame, at, MetaView.design(dense, hashed)))
        discard(part)
    (frame, at, meta), (_, pool_at, pool_meta) = drawn
    good = (frame["_good"] == 1).to_numpy().astype(float)
    return co_train(features, at, meta, good, pool_at, pool_meta)


def co_train(features: Features, at: list[np.ndarray], meta: np.ndarray, good: np.ndarray, pool_at: list[np.ndarray], pool_meta: np.ndarray, rounds: int = ROUNDS, new_rows: int = NEW_ROWS, sure: float = SURE) -> Scorer:
    """Every fourth labelled row calibrates, the others train; pool rows join the other view's training as pseudo-labels."""
    apart = np.arange(len(good)) % 4 == 3
    if len(set(good[apart])) < 2 or len(set(good[~apart])) < 2:
        apart = np.zeros(len(good), bool)
    own = np.flatnonzero(~apart)
    said: list[dict[int, float]] = [{}, {}]  # pseudo-labels for the content and the metadata view
    columns = len(features.names)
    view, last = MetaView(), None
    for turn in range(rounds + 1):
        y = np.concatenate([good[own], list(said[0].values())])
        weight = _balanced(y, len(own))
        w, b = train_softmax([at[k] for k in own] + [pool_at[k] for k in said[0]], columns, np.stack([1 - y, y], axis=1), weight, l1=1e-4, start=last)
        last = w, b
        content = lambda rows, w=w, b=b: np.array([b[1] - b[0] + (w[r, 1] - w[r, 0]).sum() for r in rows])
        y = np.concatenate([good[own], list(said[1].values())])
        view.fit(np.concatenate([meta[own], pool_meta[list(said[1])]]) if said[1] else meta[own], y, _balanced(y, len(own)) * len(y))
        if turn == rounds or not len(pool_at):
            break
        for k, scores in ((1, content(pool_at)), (0, view.logit(pool_meta))):
            p = 1 / (1 + np.exp(-np.clip(scores, -30, 30)))
            for positive in (True, False):
                order = np.argsort(-p if positive else p, kind="stable")
                new = [int(r) for r in order if (p[r] >= sure if positive else p[r] <= 1 - sure) and int(r) not in said[k]][:new_rows]
                said[k] |= dict.fromkeys(new, float(positive))
    check = apart if apart.any() else ~apart
    scores = [content([at[k] for k in np.flatnonzero(check)]), view.logit(meta[check])]
    one = np.ones(int(check.sum()))
    calibration = [newton(np.stack([one, s], axis=1), good[check], one, 0.1) for s in scores]
    delta = w[:, 1] - w[:, 0]
    use = np.flatnonzero(delta)
    out = Scorer(Features([features.names[k] for k in use]), delta[use], float(b[1] - b[0]), view, calibration, np.array([0.0, 1.0, 0.0]))
    logits = [np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6))) for p in out.combined(*scores)[1:]]
    out.blend = newton(np.stack([one, *logits], axis=1), good[check], one, 0.1)
    return out


def _balanced(y: np.ndarray, labelled: int) -> np.ndarray:
    """Weights that sum to 1: classes alike, pseudo-labels half as much as labels."""
    weight = np.where(np.arange(len(y)) < labelled, 1.0, 0.5)
    for c in (0.0, 1.0):
        weight[y == c] /= max(weight[y == c].sum(), 1e-9)
    return weight / weight.sum()


def score(docs: DataFrame, scorer: Scorer, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, quality, content_quality, metadata_quality, accepted of every row."""
    source = _with_columns(docs, key, text)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # TELLING features at most

    def run(parts):
        own = shared.value

        def made():
            for part in sliced(parts, 2048):
                columns = [pa.array(c, pa.float64()) for c in own(part.column(2).to_pylist(), part.column(3).to_pylist(), part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=[key, "quality", "content_quality", "metadata_quality"])

        yield from tidy(made())

    kind = source.schema[key].dataType.simpleString()
    out = source.mapInArrow(run, f"`{key}` {kind}, quality double, content_quality double, metadata_quality double")
    return out.withColumn("accepted", F.col("quality") >= REJECT_BELOW)


def accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with all their columns; filtered where they are read, without a join."""
    scorer = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, key, text))
    names = docs.columns
    places, at_text = [names.index(n) if n in names else None for n in ("source", "lang")], names.index(text)

    def run(parts):
        own = scorer.value

        def made():
            for part in sliced(parts, 2048):
                sources, langs = ([None] * part.num_rows if k is None else [None if x is None else str(x) for x in part.column(k).to_pylist()] for k in places)
                yield part.filter(pa.array(own(sources, langs, part.column(at_text))[0] >= REJECT_BELOW))

        yield from tidy(made())

    return docs.mapInArrow(run, docs.schema)
