"""Toxicity by weak supervision.

From a bounded sample of labelled rows (LABELLED of least hash, never held-out ones) telling words, word beginnings and
token shapes are found. Voters are made of them: lexicon voters (a word) and pattern voters (a word beginning or a
shape), picked so that every toxic sample text is covered by up to COVER voters, each right on PRECISION of the texts
where it votes; one more voter votes "clean" where no telling feature of any rank is present. A generative label model
is fitted by expectation maximisation on the votes over sample rows with and without labels: the class, and for each
voter its rates given the class and the vote of the voter it depends on most, a tree of correlations over all voters
(weighted by conditional mutual information). Its posterior labels train a linear classifier on all telling features,
which scores every text. Labels are not read again in scoring; lang, source and doc_id never are.

Defined results: a null text counts as empty; repeated rows each get their row; without labels of both classes every
text scores the share of the labels there are (0 without any); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import discard, documents_of, sliced, tidy
from lectern.llm.lexical import Features, presence, sampled, softmax, telling, train_softmax

LABELLED, UNLABELLED = 20_000, 10_000
TELLING, VOTERS, COVER, PRECISION = 3000, 64, 3, 0.97
THRESHOLD = 0.7


def held_out(key: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def pick_voters(rows: list[np.ndarray], toxic: np.ndarray, columns: int, voters: int = VOTERS, cover: int = COVER, precision: float = PRECISION, least: int = 3) -> list[int]:
    """Features in the order picked: each time that which votes on most toxic rows that have fewer than `cover` voters."""
    yes, every = np.zeros(columns), np.zeros(columns)
    for r, y in zip(rows, toxic, strict=True):
        every[r] += 1
        yes[r] += y
    fit = (yes + 0.5) / (every + 1) >= precision - 1 / (every + 1)
    fit &= yes >= precision * every
    need = {int(k): cover for k in np.flatnonzero(toxic)}
    gain = yes * fit
    by_feature: dict[int, list[int]] = {}
    for k in need:
        for f in rows[k]:
            if fit[f]:
                by_feature.setdefault(int(f), []).append(k)
    out: list[int] = []
    while len(out) < voters and gain.max(initial=0) >= least:
        f = int(gain.argmax())
        out.append(f)
        gain[f] = -1
        for k in by_feature[f]:
            need[k] -= 1
            if need[k] == 0:
                for other in rows[k]:
                    gain[other] -= 1 if fit[other] and gain[other] >= 0 else 0
    return out


class LabelModel:
    """P(class) and, for each voter, P(vote | class, vote of its parent in the tree). A voter that is silent abstains; the prior is the share of the rows given."""

    def __init__(self, votes: np.ndarray, start: np.ndarray, given: np.ndarray, rounds: int = 25) -> None:
        """votes: (rows, voters) of 0 and 1; start: first guess of P(toxic); given: rows whose guess stays."""
        self.prior = float(np.clip((start[given] if given.any() else start).mean(), 1e-4, 1 - 1e-4))
        self.parent = self._tree(votes, start)
        guess = start.copy()
        for _ in range(rounds):
            self._maximise(votes, guess)
            new = np.where(given, start, self.posterior(votes))
            if np.abs(new - guess).max(initial=0) < 1e-4:
                break
            guess = new
        self.guess = guess

    @staticmethod
    def _tree(votes: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Each voter's parent (-1: none) in a spanning tree of greatest conditional mutual information given the class."""
        size = votes.shape[1]
        gain = np.zeros((size, size))
        for weight in (p, 1 - p):
            total = weight.sum() + 1
            for a in (0, 1):
                for b in (0, 1):
                    left, right = (votes == a).astype(float), (votes == b).astype(float)
                    both = ((left * weight[:, None]).T @ right + 0.25) / total
                    one, two = ((left.T @ weight) + 0.5) / total, ((right.T @ weight) + 0.5) / total
                    gain += total * both * np.log(both / (one[:, None] * two[None, :]))
        parent = np.full(size, -1)
        best, source = np.full(size, -np.inf), np.zeros(size, int)
        done = np.zeros(size, bool)
        at = 0
        for _ in range(size - 1):
            done[at] = True
            better = gain[at] > best
            best[better], source[better] = gain[at][better], at
            at = int(np.where(done, -np.inf, best).argmax())
            parent[at] = source[at]
        return parent

    def _maximise(self, votes: np.ndarray, guess: np.ndarray) -> None:
        size = votes.shape[1]
        self.rate = np.empty((2, 2, size))  # class, parent's vote, voter
        above = np.where(self.parent[None, :] >= 0, votes[:, np.maximum(self.parent, 0)], 0)
        for c, weight in enumerate((1 - guess, guess)):
            for v in (0, 1):
                here = (above == v) * weight[:, None]
                self.rate[c, v] = ((here * votes).sum(axis=0) + 0.1) / (here.sum(axis=0) + 1.0)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        above = np.where(self.parent[None, :] >= 0, votes[:, np.maximum(self.parent, 0)], 0)
        logs = np.empty((len(votes), 2))
        for c, prior in enumerate((1 - self.prior, self.prior)):
            rate = np.where(above == 1, self.rate[c, 1], self.rate[c, 0])
            logs[:, c] = np.log(prior) + np.where(votes == 1, np.log(rate), 0).sum(axis=1)  # to abstain says nothing
        return softmax(logs)[:, 1]


class Scorer:
    """The linear classifier: telling features, weights and offset."""

    def __init__(self, features: Features, weights: np.ndarray, offset: float) -> None:
        self.features, self.weights, self.offset = features, weights, offset

    def __call__(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.offset + self.features.of(texts).astype(np.float32) @ self.weights.astype(np.float32), -60, 60)))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", labelled: int = LABELLED, unlabelled: int = UNLABELLED) -> Scorer:
    """Labels of rows that are not held out train the voters; the texts of UNLABELLED more rows take part in the label model."""
    known = documents_of(labels, key, label).filter(F.col(f"`{label}`").isNotNull() & F.col(f"`{key}`").isNotNull() & ~held_out(key)).withColumnRenamed(label, "_toxic")
    sample = sampled(docs, known, key, [text], labelled)
    names = telling(sample, text, F.col("_toxic"), [0, 1], TELLING, support=3)[1]
    features = Features(names)
    facts, rows = presence(sample, features, text, [key, "_toxic"])
    toxic = (facts["_toxic"] == 1).to_numpy()
    if not names or not toxic.any() or toxic.all():
        share = float(toxic.mean()) if len(toxic) else 0.0
        discard(sample)
        return Scorer(Features([]), np.zeros(0), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    others = documents_of(docs, key).filter(F.col(f"`{key}`").isNotNull() & ~held_out(key)).join(F.broadcast(sample.select(key).distinct()), key, "left_anti")
    more = sampled(docs, others, key, [text], unlabelled)
    _, more_rows = presence(more, features, text, [key])
    discard(sample)
    discard(more)
    picked = pick_voters(rows, toxic.astype(float), len(names))
    lean = np.zeros(len(names))
    for r, y in zip(rows, toxic, strict=True):
        lean[r] += 1 if y else -toxic.sum() / (~toxic).sum()
    every = rows + more_rows
    votes = np.zeros((len(every), len(picked) + 1), np.int8)
    for k, r in enumerate(every):
        votes[k, :-1] = np.isin(picked, r)
        votes[k, -1] = not (lean[r] > 0).any()
    start = np.full(len(every), float(toxic.mean()))
    start[: len(rows)] = np.where(toxic, 0.99, 0.01)
    given = np.arange(len(every)) < len(rows)
    model = LabelModel(votes, start, given)
    guess = model.posterior(votes)
    target = np.stack([1 - guess, guess], axis=1)
    weight = np.where(guess > 0.5, 0.5 / max(guess.mean(), 0.02), 0.5 / max(1 - guess.mean(), 0.02))
    weights, offset = train_softmax(every, len(names), target, weight)
    use = np.flatnonzero(np.abs(weights[:, 1] - weights[:, 0]) > 0)
    return Scorer(Features([names[k] for k in use]), (weights[:, 1] - weights[:, 0])[use], float(offset[1] - offset[0]))


def score(docs: DataFrame, scorer: Scorer, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score of every row; one pass over whole texts."""
    source = documents_of(docs, key, text)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # TELLING features at most

    def run(parts):
        own = shared.value
        yield from tidy(pa.RecordBatch.from_arrays([part.column(0), pa.array(own(part.column(1)), pa.float64())], names=[key, "score"]) for part in sliced(parts, 2048))

    return source.mapInArrow(run, f"`{key}` {source.schema[key].dataType.simpleString()}, score double")


def train_and_score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    out = score(docs, fit(docs, labels, key, text), key, text)
    return out.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
