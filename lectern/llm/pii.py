"""Personal data in texts: rules for the four base kinds, and a character-level bidirectional LSTM with CRF transitions.

The network is trained in numpy on labelled spans: windows of the corpus, labelled by the rules, from a bounded sample
(SAMPLE_WINDOWS different ones, those of least hash; windows with runs that the rules can't judge are left out), and made
windows in which spans of more forms (national telephone numbers, IPv6 addresses, keys and tokens that give access, as the
kind "secret") and look-alikes (dates, times, amounts, versions, long numbers) stand in running text. Since every span holds a
digit or an at sign, only windows around these are read. Windows overlap by half; where they do, their emission
scores are averaged with weights that fall towards a window's edges, and each connected region is decoded once over
the merged scores, so that a span cut by a window is still found whole. A decoded span is added if its mean marginal
is MIN_CONFIDENCE at least and it touches no base span.

Defined results: a null text counts as empty; positions are code points, ends exclusive; repeated rows each get their
row; an empty table gives an empty result; without any trigger in the corpus the made windows alone train the network.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import batches, documents_of, sliced, tidy

# The kinds in their order, and the forms of the base kinds.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")
#: A run that may be a secret, of which the rules know nothing.
UNJUDGED = re.compile(r"(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{18,}")

Span = tuple[int, int, int]  # kind, start, end


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each at sign: the run of local characters before it (after the last match), the domain behind it."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL.fullmatch(text, start - 1, start):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The spans of the base kinds, by kind and start. Each form is searched from left to right, a match that fails its condition is passed over."""
    out: list[Span] = []
    if "@" in text:
        out += ((0, a, b) for a, b in _emails(text))
    if TRIGGER.search(text) is None:
        return out
    if "." in text:
        out += ((1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += ((3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15)
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


# --- windows -----------------------------------------------------------------------------------------------------

WINDOW, STEP = 64, 32
#: Leading bits of a window's hash by which windows are counted.
BINS = 12
#: Windows of the corpus that train the network, and made ones.
SAMPLE_WINDOWS, MADE_WINDOWS = 3000, 2500
MIN_CONFIDENCE = 0.9
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind
SYMBOLS = 102  # padding, other, other letter, other space, and printable ASCII and line end


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    out = np.where((codes >= 32) & (codes < 127), codes - 32 + 5, np.where(codes == 10, 4, np.where(codes < 160, 3, np.where(codes < 0x250, 2, 1))))
    return out


def window_starts(text: str) -> list[int]:
    """Starts of the windows, on a grid of STEP, that hold a digit or an at sign."""
    found = sorted({k for m in TRIGGER.finditer(text) for k in (m.start() // STEP, m.start() // STEP - 1) if k >= 0})
    return [k * STEP for k in found]


def tags_of(length: int, spans: list[Span]) -> np.ndarray:
    tags = np.zeros(length, np.int64)
    for kind, a, b in spans:
        if not tags[a:b].any():
            tags[a] = 1 + 2 * kind
            tags[a + 1 : b] = 2 + 2 * kind
    return tags


def padded(values: np.ndarray, start: int) -> np.ndarray:
    out = np.zeros(WINDOW, np.int64)
    part = values[start : start + WINDOW]
    out[: len(part)] = part
    return out


# --- the network -------------------------------------------------------------------------------------------------

EMBED, HIDDEN = 16, 20


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def start_values(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    model = {"embed": rng.normal(0, 0.3, (SYMBOLS, EMBED)), "out": rng.normal(0, 0.2, (2 * HIDDEN, TAGS)), "out_bias": np.zeros(TAGS), "moves": np.zeros((TAGS, TAGS)), "first": np.zeros(TAGS), "last": np.zeros(TAGS)}
    for way in "fb":
        model[f"w{way}"] = rng.normal(0, 1 / np.sqrt(EMBED + HIDDEN), (EMBED + HIDDEN, 4 * HIDDEN))
        bias = np.zeros(4 * HIDDEN)
        bias[HIDDEN : 2 * HIDDEN] = 1.0
        model[f"b{way}"] = bias
    return {k: v.astype(np.float32) for k, v in model.items()}


def _run_lstm(x: np.ndarray, w: np.ndarray, b: np.ndarray, keep: list | None) -> np.ndarray:
    """x: (length, batch, EMBED) -> (length, batch, HIDDEN)."""
    n, size, _ = x.shape
    h = np.zeros((size, HIDDEN), np.float32)
    c = np.zeros((size, HIDDEN), np.float32)
    into = x @ w[:EMBED] + b
    out = np.empty((n, size, HIDDEN), np.float32)
    for t in range(n):
        gates = into[t] + h @ w[EMBED:]
        sig = _sigmoid(gates[:, : 3 * HIDDEN])
        i, f, o = sig[:, :HIDDEN], sig[:, HIDDEN : 2 * HIDDEN], sig[:, 2 * HIDDEN :]
        g = np.tanh(gates[:, 3 * HIDDEN :])
        before, was = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        if keep is not None:
            keep.append((i, f, o, g, before, was, tc))
    return out


def _back_lstm(x: np.ndarray, w: np.ndarray, kept: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, size, _ = x.shape
    dh, dc = np.zeros((size, HIDDEN), np.float32), np.zeros((size, HIDDEN), np.float32)
    dw, db, dx = np.zeros_like(w), np.zeros(4 * HIDDEN, np.float32), np.empty_like(x)
    for t in range(n - 1, -1, -1):
        i, f, o, g, before, was, tc = kept[t]
        dh = dh + grad[t]
        dc = dc + dh * o * (1 - tc * tc)
        gates = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        dw[:EMBED] += x[t].T @ gates
        dw[EMBED:] += was.T @ gates
        db += gates.sum(axis=0)
        dx[t] = gates @ w[:EMBED].T
        dh = gates @ w[EMBED:].T
        dc = dc * f
    return dw, db, dx


def emissions(model: dict[str, np.ndarray], windows: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """(batch, WINDOW) symbols -> (batch, WINDOW, TAGS) scores."""
    x = model["embed"][windows].transpose(1, 0, 2)
    kept_f, kept_b = ([], []) if keep is not None else (None, None)
    forth = _run_lstm(x, model["wf"], model["bf"], kept_f)
    back = _run_lstm(x[::-1], model["wb"], model["bb"], kept_b)[::-1]
    h = np.concatenate([forth, back], axis=2)
    if keep is not None:
        keep |= {"x": x, "f": kept_f, "b": kept_b, "h": h}
    return (h @ model["out"] + model["out_bias"]).transpose(1, 0, 2)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def forward_backward(model: dict[str, np.ndarray], scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (batch, length, TAGS): alphas, betas, log Z of the linear-chain CRF."""
    size, n, _ = scores.shape
    alpha, beta = np.empty_like(scores), np.empty_like(scores)
    alpha[:, 0] = model["first"] + scores[:, 0]
    for t in range(1, n):
        alpha[:, t] = _log_sum(alpha[:, t - 1, :, None] + model["moves"][None], 1) + scores[:, t]
    beta[:, -1] = model["last"]
    for t in range(n - 2, -1, -1):
        beta[:, t] = _log_sum(model["moves"][None] + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
    return alpha, beta, _log_sum(alpha[:, -1] + model["last"], 1)


def train(windows: np.ndarray, tags: np.ndarray, epochs: int = 8, size: int = 64, rate: float = 0.01, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam on the negative log-likelihood of the tags."""
    model, rng = start_values(seed), np.random.default_rng(seed)
    mean = {k: np.zeros_like(v) for k, v in model.items()}
    square = {k: np.zeros_like(v) for k, v in model.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), size):
            x, y = windows[order[at : at + size]], tags[order[at : at + size]]
            grads = _gradients(model, x, y)
            step += 1
            now = rate * (0.5 if epoch > epochs // 2 else 1.0)
            for k, g in grads.items():
                g = np.clip(g, -1, 1)
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                model[k] = (model[k] - now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def _gradients(model: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    keep: dict = {}
    scores = emissions(model, x, keep)
    size, n, _ = scores.shape
    alpha, beta, z = forward_backward(model, scores)
    marginal = np.exp(alpha + beta - z[:, None, None])
    expected = np.zeros((TAGS, TAGS))
    for t in range(n - 1):
        expected += np.exp(alpha[:, t, :, None] + model["moves"][None] + (scores[:, t + 1] + beta[:, t + 1])[:, None, :] - z[:, None, None]).sum(axis=0)
    seen = np.zeros((TAGS, TAGS))
    np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    eye = np.eye(TAGS, dtype=np.float32)
    error = ((marginal - eye[y]) / size).astype(np.float32)
    flat = error.transpose(1, 0, 2)
    grads = {"moves": (expected - seen) / size, "first": error[:, 0].sum(axis=0), "last": error[:, -1].sum(axis=0)}
    grads["out"] = np.tensordot(keep["h"], flat, axes=([0, 1], [0, 1]))
    grads["out_bias"] = flat.sum(axis=(0, 1))
    dh = flat @ model["out"].T
    grads["wf"], grads["bf"], dx = _back_lstm(keep["x"], model["wf"], keep["f"], dh[:, :, :HIDDEN])
    grads["wb"], grads["bb"], dx_back = _back_lstm(keep["x"][::-1], model["wb"], keep["b"], dh[::-1, :, HIDDEN:])
    dx = dx + dx_back[::-1]
    embed = np.zeros_like(model["embed"])
    np.add.at(embed, x.T, dx)
    grads["embed"] = embed
    return grads


# --- made windows ------------------------------------------------------------------------------------------------


def _made_piece(rng: np.random.Generator) -> tuple[str, int | None]:
    """A piece and its kind; None for a look-alike."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    w = lambda: "".join(map(chr, rng.integers(97, 123, rng.integers(3, 9))))
    hexes = lambda n: "".join("0123456789abcdef"[k] for k in rng.integers(0, 16, n))
    pick = int(rng.integers(0, 21))
    mixed = lambda n, letters: "".join(letters[k] for k in rng.integers(0, len(letters), n))
    big, small, every = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    if pick >= 18:  # look-alikes of secrets: long numbers, long words
        return (d(int(rng.integers(20, 40))), None) if pick == 18 else (mixed(int(rng.integers(18, 40)), every[26:52] if pick == 19 else every[:52]), None)
    if pick >= 14:
        return (mixed(int(rng.choice([32, 40])), small), "AKIA" + mixed(16, big), mixed(int(rng.integers(24, 41)), every), "sk-" + mixed(int(rng.integers(24, 40)), every))[pick - 14], 4
    if pick == 0:
        return f"{w()}.{w()}{d(2)}@{w()}.com", 0
    if pick == 1:
        return ".".join(str(k) for k in rng.integers(0, 256, 4)), 1
    if pick == 2:
        return ":".join(hexes(4) for _ in range(8)), 1
    if pick == 3:
        stem = d(15)
        return next(f"{s[:4]} {s[4:8]} {s[8:12]} {s[12:]}" for k in range(10) if luhn(s := stem + str(k))), 2
    if pick == 4:
        return f"+{d(2)} ({d(3)}) {d(3)}-{d(4)}", 3
    if pick == 5:
        return f"({d(3)}) {d(3)}-{d(4)}", 3
    if pick == 6:
        return f"{d(3)}-{d(3)}-{d(4)}", 3
    if pick == 7:
        return f"{rng.integers(1900, 2100)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}", None
    if pick == 8:
        return f"{rng.integers(0, 24):02d}:{rng.integers(0, 60):02d}", None
    if pick == 9:
        return f"{d(int(rng.integers(1, 4)))}.{d(2)}", None
    if pick == 10:
        return d(int(rng.integers(1, 13))), None
    if pick == 11:
        return f"v{rng.integers(0, 20)}.{rng.integers(0, 20)}.{rng.integers(0, 20)}", None
    if pick == 12:
        return f"@{w()}", None
    return f"{rng.integers(256, 999)}.{rng.integers(256, 999)}.{rng.integers(0, 256)}.{rng.integers(0, 256)}", None


def made_windows(count: int = MADE_WINDOWS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    words = lambda n: " ".join("".join(map(chr, rng.integers(97, 123, rng.integers(1, 9)))) for _ in range(n))
    xs, ys = [], []
    for _ in range(count):
        piece, kind = _made_piece(rng)
        before = words(12)[-int(rng.integers(1, 40)) :] + " "
        named = kind == 4 and rng.random() < 0.7  # said to be a secret, often in quotes
        quote = '"' if named and rng.random() < 0.6 else ""
        before = (before if rng.random() > 0.1 else "")[-12 if kind == 4 else 0 :] + (str(rng.choice(["token", "key", "secret", "api_key", "password"])) + str(rng.choice([" = ", "=", ": "])) + quote if named else "")
        text = before + piece
        start = len(text) - len(piece)
        text += quote + (" " if rng.random() < 0.8 else ".") + words(12)
        xs.append(padded(symbols(text), 0))
        ys.append(padded(tags_of(len(text), [] if kind is None else [(kind, start, start + len(piece))]), 0))
    return np.array(xs), np.array(ys)


# --- decoding ----------------------------------------------------------------------------------------------------

_SLOPE = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)


def merged(starts: list[int], scores: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Connected regions: start and averaged emission scores of the windows that cover it."""
    at = 0
    while at < len(starts):
        end = at + 1
        while end < len(starts) and starts[end] < starts[end - 1] + WINDOW:
            end += 1
        first, size = starts[at], min(length, starts[end - 1] + WINDOW) - starts[at]
        total, weight = np.zeros((size, TAGS), np.float32), np.zeros((size, 1), np.float32)
        for s, e in zip(starts[at:end], scores[at:end], strict=True):
            n = min(WINDOW, length - s)
            total[s - first : s - first + n] += e[:n] * _SLOPE[:n, None]
            weight[s - first : s - first + n] += _SLOPE[:n, None]
        yield first, total / weight
        at = end


def viterbi(model: dict[str, np.ndarray], scores: np.ndarray) -> np.ndarray:
    n = len(scores)
    best, back = model["first"] + scores[0], np.empty((n, TAGS), np.int64)
    for t in range(1, n):
        step = best[:, None] + model["moves"]
        back[t] = step.argmax(axis=0)
        best = step.max(axis=0) + scores[t]
    path = np.empty(n, np.int64)
    path[-1] = (best + model["last"]).argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def decoded(model: dict[str, np.ndarray], text: str, starts: list[int], scores: np.ndarray, least: float, free=lambda a, b: True) -> list[Span]:
    """Spans of the network over a whole text, in order; free(start, end): whether a span may stand there."""
    out: list[Span] = []
    for first, region in merged(starts, scores, len(text)):
        path = viterbi(model, region)
        sure = None
        for t in np.flatnonzero(path):
            if t and path[t] % 2 == 0 and path[t - 1] in (path[t], path[t] - 1):
                continue  # inside a span that has begun
            kind, end = (path[t] - 1) // 2, t + 1
            while end < len(path) and path[end] == 2 + 2 * kind:
                end += 1
            a, b = first + int(t), first + int(end)
            if not TRIGGER.search(text, a, b) or text[a].isspace() or text[b - 1].isspace() or not free(a, b):
                continue
            if sure is None:
                alpha, beta, z = forward_backward(model, region[None])
                sure = np.exp(alpha + beta - z[:, None, None])[0]
            if sure[np.arange(t, end), path[t:end]].mean() >= least:
                out.append((int(kind), a, b))
    return out


def _free(base: list[Span]):
    """Whether a stretch touches none of the spans."""
    covered = sorted((a, b) for _, a, b in base)
    begin = [a for a, _ in covered]
    reach = list(accumulate((b for _, b in covered), max))

    def free(a: int, b: int) -> bool:
        before = bisect_left(begin, b)
        return before == 0 or reach[before - 1] <= a

    return free


def added(model: dict[str, np.ndarray], texts: list[str], bases: list[list[Span]], least: float = MIN_CONFIDENCE, size: int = 512) -> list[list[Span]]:
    """The network's spans of each text that touch no base span. Windows are scored size at a time, those of short texts together."""
    out: list[list[Span]] = [[] for _ in texts]
    held: list[tuple[int, list[int], np.ndarray]] = []

    def close() -> None:
        windows = np.concatenate([w for _, _, w in held])
        scores = np.concatenate([emissions(model, windows[at : at + size]) for at in range(0, len(windows), size)])
        at = 0
        for k, starts, _ in held:
            out[k] = decoded(model, texts[k], starts, scores[at : at + len(starts)], least, _free(bases[k]))
            at += len(starts)
        held.clear()

    for k, text in enumerate(texts):
        if starts := window_starts(text):
            codes = symbols(text)
            held.append((k, starts, np.array([padded(codes, s) for s in starts])))
            if sum(len(w) for _, _, w in held) >= size:
                close()
    if held:
        close()
    return out


# --- over documents ----------------------------------------------------------------------------------------------


def _labelled(text: str) -> Iterator[tuple[int, bytes, bytes]]:
    """Checksum, symbols and tags of a text's windows, but for those with runs outside the base spans that may be secrets."""
    base = base_spans(text)
    free = _free(base)
    open_ = [m.span() for m in UNJUDGED.finditer(text) if free(*m.span())]
    codes, tags = symbols(text), tags_of(len(text), base)
    for s in window_starts(text):
        if not any(a < s + WINDOW and b > s for a, b in open_):
            x = padded(codes, s).astype(np.uint8).tobytes()
            yield zlib.crc32(x), x, padded(tags, s).astype(np.uint8).tobytes()


def labelled_windows(docs: DataFrame, text: str, most: int = SAMPLE_WINDOWS) -> tuple[np.ndarray, np.ndarray]:
    """Up to `most` different windows of the corpus, those of least hash, with tags from the rules.

    First the windows are counted by the leading bits of their hashes; then those below the cut-off that this gives are
    made different and gathered, so that no task sends more than what stays, or little more.
    """
    source = documents_of(docs, text)
    texts = lambda parts: (t for part in sliced(parts) for t in part.column(0).to_pylist() if t and TRIGGER.search(t))

    def count(parts):
        found = np.zeros(1 << BINS, np.int64)
        for t in texts(parts):
            np.add.at(found, [h >> (32 - BINS) for h, _, _ in _labelled(t)], 1)
        held = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(found[held])], names=["bin", "n"])

    sums = source.mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").collect()
    reached = np.cumsum([r["n"] for r in sums])
    cut = sums[min(int(np.searchsorted(reached, 2 * most)), len(sums) - 1)]["bin"] if sums else -1

    def gather(parts):
        schema = pa.schema([("h", pa.int64()), ("x", pa.binary()), ("y", pa.binary())])
        yield from tidy(batches((w for t in texts(parts) for w in _labelled(t) if w[0] >> (32 - BINS) <= cut), schema, weight=lambda r: 3 * WINDOW))

    seen = source.mapInArrow(gather, "h long, x binary, y binary").groupBy("h", "x").agg(F.min("y").alias("y")).orderBy("h", "x").limit(most).collect()
    as_rows = lambda name: np.array([np.frombuffer(bytes(r[name]), np.uint8) for r in seen], np.int64).reshape(-1, WINDOW)
    return as_rows("x"), as_rows("y")


def fit(docs: DataFrame, text: str = "text", most: int = SAMPLE_WINDOWS) -> dict[str, np.ndarray]:
    x, y = labelled_windows(docs, text, most)
    made_x, made_y = made_windows()
    return train(np.concatenate([x, made_x]), np.concatenate([y, made_y]))


def find(docs: DataFrame, model: dict[str, np.ndarray], key: str = "doc_id", text: str = "text", least: float = MIN_CONFIDENCE) -> DataFrame:
    """key, base and spans: arrays of (kind, start, end) of every text; spans holds the base spans and the network's."""
    source = documents_of(docs, key, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few tens of kilobytes
    kind = "array<struct<kind: string, start: int, end: int>>"

    def run(parts):
        for part in sliced(parts, 1024):
            keys = part.column(0)
            texts = [t or "" for t in part.column(1).to_pylist()]
            bases = [base_spans(t) for t in texts]
            more = added(shared.value, texts, bases, least)
            span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            schema = pa.schema([pa.field(key, keys.type), pa.field("base", span), pa.field("spans", span)])
            told = lambda spans: [(KINDS[k], a, b) for k, a, b in sorted(spans)]
            yield from batches(((k, told(b), told(b + m)) for k, b, m in zip(keys.to_pylist(), bases, more, strict=True)), schema, weight=lambda r: 64 + 48 * len(r[2]))

    return source.mapInArrow(run, f"`{key}` {source.schema[key].dataType.simpleString()}, base {kind}, spans {kind}")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, all spans in writing, and how many these are, secrets by themselves."""
    found = find(docs, fit(docs, text), key, text)
    line = lambda name: F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(key, *(count(k) for k in BASE_KINDS), F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"), F.size(F.filter("spans", lambda s: s["kind"] == "secret")).cast("long").alias("n_secret"))
