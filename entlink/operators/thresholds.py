"""Random walk and belief propagation over the mentions that each threshold of keyphraseness keeps.

A text is solved once for every set of mentions that the thresholds leave of it, all sets at a time, in the task that makes its candidate pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from entlink.operators import bp, detect, texts, walk

# Numbers that the sets of mentions of a text take at a time.
_NUMBERS = 50_000


def _winners(score: np.ndarray, mention: np.ndarray, entity: np.ndarray) -> np.ndarray:
    """The place of each mention's best candidate: highest rounded score, the smaller entity of equal ones."""
    order = np.lexsort((entity, -np.round(score, 9), mention))
    return order[np.r_[True, np.diff(mention[order]) > 0]]


def solutions(cands: DataFrame, rel: DataFrame, thresholds: list[float]) -> DataFrame:
    """(doc_id, method, mention, entity_id, below, up): what ``frequent``, ``walk`` and ``bp`` (basic scorer) choose at the thresholds from place ``below`` to before ``up``, ascending from 0.

    ``cands``(doc_id, pos, n, mention, entity_id, freq, keyphraseness, total, compat), ``rel``(e1 < e2, rel). Walk and propagation
    are run to convergence; importance, edge weights and pair terms are those of the mentions kept. A row comes once for each method and threshold.
    """
    grid = np.array(sorted(thresholds))

    def solve(at: dict, mention: np.ndarray, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> dict:
        reached = np.searchsorted(grid, at["keyphraseness"], side="right")
        entity, name = at["entity_id"].astype(np.int64), at["mention"].dictionary_encode().indices.to_numpy().astype(np.int64)
        places, kinds, spans = [], [], []

        def add(kind: int, best: np.ndarray, below: int, up: np.ndarray) -> None:
            some = best[np.unique((name[best] << 32) | entity[best], return_index=True)[1]]
            places.append(some)
            kinds.append(np.full(len(some), kind))
            spans.append(np.stack([np.full(len(some), below), up[some]]))

        top = _winners(at["freq"].astype(float), mention, entity)
        add(0, top[reached[top] > 0], 0, reached)  # of equal names, all have the same keyphraseness
        steps = np.unique(reached[reached > 0])  # thresholds from one step to the next keep the same mentions
        low = 0
        while low < len(steps):
            own = np.flatnonzero(reached >= steps[low])  # what later sets do not keep either is left out
            at_own = np.full(len(reached), -1)
            at_own[own] = np.arange(len(own))
            m = np.unique(mention[own], return_inverse=True)[1]
            near = (at_own[a] >= 0) & (at_own[b] >= 0)
            one, two, v = at_own[a[near]], at_own[b[near]], value[near]
            some = steps[low : low + max(1, _NUMBERS // (len(v) + len(own) * (int(m[-1]) + 1)))]
            kept = reached[own][None, :] >= some[:, None]
            scores = (walked(kept, m, at["total"][own], at["compat"][own], one, two, v), propagated(kept, m, at["compat"][own], one, two, v))
            for k, up in enumerate(some):
                there = np.flatnonzero(kept[k])
                for kind, score in enumerate(scores, 1):
                    add(kind, own[there[_winners(score[k, there], m[there], entity[own[there]])]], steps[low + k - 1] if low + k else 0, np.full(len(mention), up))
            low += len(some)
        place, span = np.concatenate(places), np.concatenate(spans, axis=1).astype(np.int32)
        method = pa.array(["frequent", "walk", "bp"]).take(pa.array(np.concatenate(kinds)))
        return {"method": method, "mention": at["mention"].take(pa.array(place)), "entity_id": at["entity_id"][place], "below": span[0], "up": span[1]}

    slim = cands.select("doc_id", "pos", "n", "mention", "entity_id", "freq", "keyphraseness", "total", "compat")
    return texts.solved(slim, rel, "rel", solve, "method string, mention string, entity_id int, below int, up int")


def walked(kept: np.ndarray, mention: np.ndarray, total: np.ndarray, compat: np.ndarray, a: np.ndarray, b: np.ndarray, rel: np.ndarray, tolerance: float = 1e-10, most: int = 200) -> np.ndarray:
    """Compatibility times rank of each candidate for each row of ``kept``, the candidates whose mentions are kept: ``walk.ranks`` of all sets at a time."""
    sets, size = kept.shape
    first = np.searchsorted(mention, np.arange(mention[-1] + 1))
    weight = np.where(kept[:, first], np.log(detect.DOCS_IN_CORPUS / total[first].astype(float)), 0.0)
    prior = np.concatenate((np.zeros(kept.shape), weight / weight.sum(axis=1, keepdims=True)), axis=1)  # vertices: candidates, then mentions
    every, k = np.bincount(mention, compat)[mention], np.bincount(mention)[mention]
    down = np.where(every > 0, compat / np.where(every > 0, every, 1), 1 / k)
    strong = rel > walk.EPSILON
    a, b, rel = a[strong], b[strong], rel[strong]
    of, pair = np.nonzero(kept[:, a] & kept[:, b])
    wide = prior.shape[1]
    start, end = of * wide + a[pair], of * wide + b[pair]
    out = np.bincount(start, rel[pair], prior.size)
    one, c = np.nonzero(kept)
    w = (1 - walk.ALPHA) * np.concatenate((down[c], rel[pair] / out[start]))
    start, end = np.concatenate((one * wide + size + mention[c], start)), np.concatenate((one * wide + c, end))
    back = (1 - walk.ALPHA) * np.concatenate((out.reshape(prior.shape)[:, :size] == 0, np.zeros(weight.shape)), axis=1)
    p, found, live = prior.copy(), np.zeros(prior.shape), np.ones(sets, bool)
    for _ in range(most):
        q = np.bincount(end, w * p.take(start), prior.size).reshape(prior.shape)
        q += (walk.ALPHA + np.einsum("ij,ij->i", p, back))[:, None] * prior
        p -= q
        still = np.abs(p, out=p).max(axis=1) < tolerance
        p = q
        if np.count_nonzero(still):
            found[still & live] = p[still & live]
            live &= ~still
            if not live.any():
                break
    found[live] = p[live]
    return compat * found[:, :size]


def propagated(kept: np.ndarray, mention: np.ndarray, compat: np.ndarray, a: np.ndarray, b: np.ndarray, rel: np.ndarray, most: int = bp.ROUNDS, tolerance: float = bp.TOLERANCE) -> np.ndarray:
    """Final score of each candidate for each row of ``kept``, the candidates whose mentions are kept: ``bp.solved`` of all sets at a time."""
    m = int(mention[-1]) + 1
    first = np.searchsorted(mention, np.arange(m))
    there = kept[:, first]
    size = there.sum(axis=1)[:, None]
    local = np.where(kept, compat / size, 0.0)
    score = local.copy()
    counts = rel >= bp.LEAST_RELATED
    a, b, rel = a[counts], b[counts], rel[counts]
    way = mention[a] * len(mention) + b  # listed pairs by message: mention of the sender, candidate of the receiver
    order = np.argsort(way, kind="stable")
    a, b, rel = a[order], b[order], rel[order]
    way, begin = np.unique(way[order], return_index=True)
    heard = mention[b] * len(mention) + a
    pair = 2 * rel / (size * np.maximum(size - 1, 1))
    mask = there[:, :, None] & kept[:, None, :] & (mention[None, :] != np.arange(m)[:, None])
    live, old = np.flatnonzero(size[:, 0] > 1), None
    local, pair, mask = local[live], pair[live], mask[live]
    sent = np.zeros(mask.shape)
    for _ in range(most):
        if not len(live):
            break
        base = (local + sent.sum(axis=1))[:, None, :] - sent  # by set: mention that is left out, sender
        best = np.maximum.reduceat(base, first, axis=2).transpose(0, 2, 1).take(mention, axis=2)
        if len(way):
            flat = best.reshape(len(live), -1)
            known = base.reshape(len(live), -1).take(heard, axis=1)
            known += pair
            flat[:, way] = np.maximum(flat.take(way, axis=1), np.maximum.reduceat(known, begin, axis=1))
        best -= np.minimum.reduceat(best, first, axis=2).take(mention, axis=2)
        sent = np.where(mask, best, 0.0)
        now = sent.sum(axis=1) + local
        score[live] = now
        if old is not None:
            left = np.abs(now - old).max(axis=1) >= tolerance
            if not left.all():
                live, local, pair, mask, sent, now = (x[left] for x in (live, local, pair, mask, sent, now))
        old = now
    return score
