"""Windows, fusion and packing as plain functions, one choice after another, to hold the folds of the library against."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np

from lectern.operators.evidence import RRF, WEIGHTS, WINDOWS, cost

RADIUS = 1


def window(chunks: list[dict], at: int, budget: int, covered: set[int], radius: int = RADIUS) -> tuple[dict, set[int]] | None:
    """The chunk and those beside it in its section that aren't covered and still fit; None if the chunk itself doesn't fit."""
    left = budget - cost(chunks[at])
    if left < 0:
        return None
    taken = {at}
    for near in (at + side * step for step in range(1, radius + 1) for side in (-1, 1)):
        if 0 <= near < len(chunks) and near not in covered and chunks[near]["section"] == chunks[at]["section"] and len(chunks[near]["text"]) + 1 <= left:
            taken.add(near)
            left -= len(chunks[near]["text"]) + 1
    parts = [chunks[k] for k in sorted(taken)]
    made = {
        "chunk_id": f"window-{parts[0]['chunk_id']}-{parts[-1]['chunk_id']}",
        "chunk_idx": min(taken),
        "section": chunks[at]["section"],
        "text": "\n".join(p["text"] for p in parts),
        "block_ids": list(dict.fromkeys(b for p in parts for b in p["block_ids"])),
    }
    return made, taken


def pack_windows(chunks: list[dict], ranked: Iterable[int], budget: int, limit: int = WINDOWS) -> list[dict]:
    """Windows around the ranked chunks, best first, that fit the budget and don't overlap; none with a limit of 0."""
    out: list[dict] = []
    covered: set[int] = set()
    for at in ranked:
        if len(out) >= limit:
            break
        if at not in covered and (found := window(chunks, at, budget, covered)):
            out.append(found[0])
            covered |= found[1]
            budget -= cost(found[0])
    return out


@dataclass(eq=False)
class Evidence:
    """One chunk with what all channels that offered its blocks have said of it."""

    chunk: dict
    key: tuple
    sources: dict[str, None] = field(default_factory=dict)
    score: float = 0.0
    pinned: bool = False
    needs: set[int] = field(default_factory=set)

    def standing(self) -> tuple:
        return not self.pinned, -len(self.chunk["block_ids"]), -len(self.chunk["text"])


class Fusion:
    """Evidence by the blocks it stands for: an index from every block to its owner joins a new offer with all it touches.

    Scores, sources and needs of what is joined add up, the fullest chunk (pinned ones before others) stands for all and owns its
    blocks from then on, and the key is that of the one held longest.
    """

    def __init__(self) -> None:
        self.owner: dict[str, Evidence] = {}
        self.by_key: dict[tuple, Evidence] = {}

    def offer(self, chunk: dict, rank: int, source: str, pinned: bool = False, need: int | None = None) -> None:
        key = tuple(sorted(chunk["block_ids"])) or (chunk["chunk_id"],)
        new = Evidence(chunk, key, {source: None}, WEIGHTS[source] / (RRF + rank + 1), pinned, set() if need is None else {need})
        touched = {id(e): e for b in chunk["block_ids"] if (e := self.owner.get(b)) is not None}
        if (same := self.by_key.get(key)) is not None:
            touched[id(same)] = same
        joined = [*(e for e in self.by_key.values() if id(e) in touched), new] if touched else [new]
        for e in joined[:-1]:
            del self.by_key[e.key]
            for b in e.chunk["block_ids"]:
                self.owner.pop(b, None)
        one = Evidence(min(joined, key=Evidence.standing).chunk, joined[0].key)
        for e in joined:
            one.sources |= e.sources
            one.needs |= e.needs
            one.score += e.score
            one.pinned |= e.pinned
        self.by_key[one.key] = one
        self.owner.update(dict.fromkeys(one.chunk["block_ids"], one))

    def channel(self, ranked: Iterable[dict], source: str, pinned: bool = False, need: int | None = None) -> None:
        for rank, chunk in enumerate(ranked):
            self.offer(chunk, rank, source, pinned, need)

    def ranked(self) -> list[Evidence]:
        return sorted(self.by_key.values(), key=lambda e: (not e.pinned, -e.score, e.chunk["chunk_id"]))


def pack(ranked: list[Evidence], needs: int, budget: int, limit: int = WINDOWS) -> list[Evidence]:
    """By phases, as far as each fits: all that is pinned, for each need the best that isn't taken, coverage, and the rest."""
    costs = np.array([cost(e.chunk) for e in ranked], int)
    phases = [(np.array([e.pinned for e in ranked], bool), len(ranked))]
    phases += [(np.array([need in e.needs for e in ranked], bool), 1) for need in range(needs)]
    phases += [(np.array(["document-coverage" in e.sources for e in ranked], bool), len(ranked)), (np.ones(len(ranked), bool), len(ranked))]
    order: list[int] = []
    free = np.ones(len(ranked), bool)
    for wanted, most in phases:
        for k in np.flatnonzero(wanted & free)[:most].tolist():
            if len(order) < limit and costs[k] <= budget:
                order.append(k)
                free[k] = False
                budget -= costs[k]
    return [ranked[k] for k in order]
