"""Mixing documents to target token weights of domains that each document belongs to in part.

A linear classifier on telling features, fitted on a bounded sample of a labelled table (LABELLED rows of least hash),
predicts every document's posterior over the domains, stated in thousandths. Rates r >= 0 for the documents are fitted
by least squares: sum over domains of (expected tokens of the domain - target)^2 / (tokens of the domain), with a weak
pull of every rate to 1.
Since the gradient of a document's rate, scaled by its tokens, depends on its posterior alone, documents of one
posterior have one rate; the steps of the accelerated projected gradient run over a table (posterior, tokens), made by
one aggregation that is combined before the shuffle, and a step sends one number a domain from each task to the driver. Rates are at
most MOST (with MOST = 1 no document repeats), but have no upper bound for documents mostly of domains that have less than their
target: these repeat until it is met. A domain that is scarce and has no such document can't be met, as other domains' documents
aren't repeated for traces of it; it keeps what it has. What the targets miss after the last step is logged and kept as Rates.missing.

A document is put out floor(rate) times, and once more if a checksum of its id falls below the rest of its rate.

Defined results: a null text counts as empty, with no tokens, and keeps a rate; repeated rows each get the same rate;
without labels all documents have even posteriors; an empty table gives an empty result.
"""

from __future__ import annotations

import logging
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import discard, documents_of, sliced, stored, tidy
from lectern.llm.lexical import Features, presence, sampled, softmax, telling, train_softmax

LABELLED, TELLING = 15_000, 1500
STEPS, PULL, MOST = 25, 1e-4, 1.0
#: The weights of the domains that the queries here mix to; the anchor gives all it has, the others follow.
TARGETS, ANCHOR = {"clean": 0.97, "junk": 0.01, "toxic": 0.02}, "clean"


class Posterior:
    def __init__(self, domains: list[str], features: Features, weights: np.ndarray, offsets: np.ndarray) -> None:
        self.domains, self.features, self.weights, self.offsets = domains, features, weights, offsets

    def __call__(self, texts: pa.Array) -> np.ndarray:
        """(texts, domains) in whole thousandths that sum to 1000."""
        logits = self.offsets + self.features.of(texts).astype(np.float32) @ self.weights.astype(np.float32)
        exact = softmax(logits) * 1000
        out = np.floor(exact).astype(np.int64)
        rest = np.argsort(-(exact - out), axis=1, kind="stable")
        missing = 1000 - out.sum(axis=1)
        for k in range(len(self.domains)):
            out[np.arange(len(out)), rest[:, k]] += missing > k
        return out


def fit_posterior(docs: DataFrame, labelled: DataFrame, domains: list[str], key: str = "doc_id", text: str = "text", domain: str = "domain", most: int = LABELLED) -> Posterior:
    """labelled: key and domain; rows of other domains or none aren't used."""
    known = documents_of(labelled, key, domain).filter(F.col(f"`{domain}`").isin(domains) & F.col(f"`{key}`").isNotNull()).withColumnRenamed(domain, "_domain")
    sample = sampled(docs, known, key, [text], most)
    names = list(dict.fromkeys(f for found in telling(sample, text, F.col("_domain"), domains, TELLING) for f in found))
    features = Features(names)
    facts, rows = presence(sample, features, text, [key, "_domain"])
    discard(sample)
    if not names:
        return Posterior(domains, features, np.zeros((0, len(domains))), np.zeros(len(domains)))
    place = np.array([domains.index(d) for d in facts["_domain"]])
    share = np.bincount(place, minlength=len(domains))
    weight = (1 / np.sqrt(np.maximum(share, 1)))[place]
    weights, offsets = train_softmax(rows, len(names), np.eye(len(domains))[place] * 0.999 + 0.001 / len(domains), weight, l1=5e-5, steps=400)
    return Posterior(domains, features, weights, offsets)


def posteriors(docs: DataFrame, model: Posterior, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens (words between white space) and p (array of thousandths) of every row."""
    source = documents_of(docs, key, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # TELLING features a domain at most

    def run(parts):
        yield from tidy(pa.RecordBatch.from_arrays([part.column(0), *judged(shared.value, part.column(1))], names=[key, "n_tokens", "p"]) for part in sliced(parts, 2048))

    return source.mapInArrow(run, f"`{key}` {source.schema[key].dataType.simpleString()}, n_tokens long, p array<int>")


def judged(model: Posterior, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Numbers of tokens, and posteriors."""
    words = pa.array([len((t or "").split()) for t in texts.to_pylist()], pa.int64())
    found = model(texts)
    return words, pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * found.shape[1], pa.int32()), pa.array(found.ravel(), pa.int32()))


class Rates:
    """What the gradient steps have added up to: a rate for every posterior."""

    def __init__(self, size: int, rate: float, most: float, pull: float, repeating: np.ndarray | None = None) -> None:
        """repeating: of which domains documents may pass the rate `most`."""
        self.size, self.rate, self.most, self.pull = size, rate, most, pull
        self.repeating = np.zeros(size, bool) if repeating is None else repeating
        self.history: list[tuple[np.ndarray, float]] = []
        self.missing: dict[str, float] = {}

    def __call__(self, p: np.ndarray, at: str = "rate") -> np.ndarray:
        """Of posteriors (rows, domains) as shares of 1: the rates, or the points where the next gradient is taken."""
        r = np.ones(len(p))
        look = r
        most = np.where(p[:, self.repeating].sum(axis=1) > 0.5, np.inf, self.most)
        for residual, speed in self.history:
            new = np.clip(look - self.rate * (p @ residual + self.pull * (look - 1)), 0, most)
            look = new + speed * (new - r)
            r = new
        return r if at == "rate" else look


def _shares(p: pa.Array, size: int) -> np.ndarray:
    """Posteriors in thousandths as shares of 1."""
    return p.flatten().to_numpy().reshape(len(p), size) / 1000


def _sums(profiles: DataFrame, rates: Rates | None, at: str = "rate") -> np.ndarray:
    """Expected tokens of each domain under the rates; without rates, those of each pair of domains. A task sends its sums alone."""
    size = rates.size if rates else len(profiles.first()["p"])

    def run(parts):
        total = np.zeros(size if rates else size * size)
        for part in parts:
            p = _shares(part.column(0), size)
            weight = part.column(1).to_numpy() * (rates(p, at) if rates else 1.0)
            total += (p * weight[:, None]).sum(axis=0) if rates else ((p * weight[:, None]).T @ p).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["x"])

    rows = [r["x"] for r in profiles.select("p", "tokens").mapInArrow(run, "x array<double>").collect()]
    return np.sum(rows, axis=0) if rows else np.zeros(size if rates else size * size)


def fit_rates(given: DataFrame, domains: list[str], targets: dict[str, float], anchor: str | None, most: float = MOST, pull: float = PULL, steps: int = STEPS) -> Rates:
    """given: posteriors(). With an anchor, targets are weights and the anchor's target is all it has; else they are token totals."""
    profiles = stored(given.groupBy("p").agg(F.sum("n_tokens").cast("double").alias("tokens")), "profiles")
    size = len(domains)
    there = _sums(profiles, Rates(size, 0.0, most, pull), "rate")
    everything = max(there.sum(), 1.0)
    want = np.array([float(targets.get(d, 0.0)) for d in domains])
    if anchor is not None:
        want = want * there[domains.index(anchor)] / max(want[domains.index(anchor)], 1e-12)
    stated = want
    if there.sum() <= 0:
        discard(profiles)
        return Rates(size, 0.0, most, pull)
    pairs = _sums(profiles, None).reshape(size, size) / everything
    purest = profiles.filter("tokens > 0").agg(*(F.max(F.get("p", F.lit(k))).alias(f"p{k}") for k in range(size))).first()
    scarce = want > most * there
    repeating = scarce & (np.array(list(purest)) > 500)
    want = np.where(scarce & ~repeating, most * there, want)
    own = np.maximum(pairs.sum(axis=1), 1e-6)  # a domain's share of all tokens: its error counts by that
    rates = Rates(size, 1.0 / ((pairs / own[:, None]).sum(axis=1).max() + pull), most, pull, repeating)  # the scaled problem's curvature is at most this
    t = 1.0
    for _ in range(steps):
        residual = (_sums(profiles, rates, "look") - want) / everything
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        rates.history.append((residual / own, (t - 1) / t_next))
        t = t_next
        if np.abs(residual).max() < 1e-5:
            break
    rates.missing = dict(zip(domains, (stated - _sums(profiles, rates, "rate")).tolist(), strict=True))
    if missed := {d: round(m, 1) for (d, m), w in zip(rates.missing.items(), stated, strict=True) if abs(m) > 0.01 * w}:
        logging.getLogger(__name__).warning("expected tokens short of the targets %s (negative: over): %s", dict(zip(domains, stated.round(1).tolist(), strict=True)), missed)
    discard(profiles)
    return rates


def copies_of(key: object, rate: float) -> int:
    whole = int(rate)
    return whole + (zlib.crc32(str(key).encode()) / 2**32 < rate - whole)


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, anchor: str | None = ANCHOR, key: str = "doc_id", text: str = "text", domain: str = "domain", most: float = MOST) -> DataFrame:
    """key, n_tokens, p_<domain>, rate, copies of every row."""
    domains = sorted(targets)
    given = stored(posteriors(docs, fit_posterior(docs, labelled, domains, key, text, domain), key, text), "posteriors")
    rates = fit_rates(given, domains, targets, anchor, most)
    kind = given.schema[key].dataType.simpleString()

    def run(parts):
        for part in parts:
            p = _shares(part.column(2), len(domains))
            r = rates(p)
            times = [copies_of(k, x) for k, x in zip(part.column(0).to_pylist(), r, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(p[:, k]) for k in range(len(domains))), pa.array(r), pa.array(times, pa.int64())], names=[key, "n_tokens", *(f"p_{d}" for d in domains), "rate", "copies"])

    return given.select(key, "n_tokens", "p").mapInArrow(run, f"`{key}` {kind}, n_tokens long, {', '.join(f'`p_{d}` double' for d in domains)}, rate double, copies long")


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, anchor: str | None = ANCHOR, key: str = "doc_id", text: str = "text", domain: str = "domain", most: float = MOST) -> DataFrame:
    """The rows of docs, each as often as mix() says, with all their columns; every text is classified once, and no join brings the rates back."""
    domains = sorted(targets)
    shared = docs.sparkSession.sparkContext.broadcast(fit_posterior(docs, labelled, domains, key, text, domain))
    names, at_key, at_text = docs.columns, docs.columns.index(key), docs.columns.index(text)

    def judge(parts):
        names_ = [f"c{k}" for k in range(len(names))] + ["n_tokens", "p"]
        yield from tidy(pa.RecordBatch.from_arrays([*part.columns, *judged(shared.value, part.column(at_text))], names=names_) for part in sliced(parts, 2048))

    own = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema))
    given = stored(docs.mapInArrow(judge, f"{own}, n_tokens long, p array<int>"), "judged")
    rates = fit_rates(given.select("n_tokens", "p"), domains, targets, anchor, most)

    def repeat(parts):
        for part in parts:
            r = rates(_shares(part.column(len(names) + 1), len(domains)))
            times = [copies_of(k, x) for k, x in zip(part.column(at_key).to_pylist(), r, strict=True)]
            yield pa.RecordBatch.from_arrays(part.take(pa.array(np.repeat(np.arange(part.num_rows), times))).columns[: len(names)], names=names)

    return given.mapInArrow(repeat, docs.schema)


def label_domains(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and domain of a table of quality and toxic labels: toxic, else junk, else clean."""
    toxic, quality = F.col("toxic"), F.col("quality")
    return labels.select(F.col(f"`{key}`"), F.when(toxic == 1, "toxic").when(quality == 0, "junk").when((quality == 1) & (toxic == 0), "clean").alias("domain"))
