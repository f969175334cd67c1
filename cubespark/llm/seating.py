"""Chinese-restaurant seatings of a two-level Pitman-Yor model, resampled by Gibbs for many dishes at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Dishes of up to so many customers draw their number of tables from its exact conditional.
EXACT = 256


@lru_cache(64)
def log_stirling(discount: float) -> np.ndarray:
    """Logs of generalised Stirling numbers: seatings of n customers at k tables, weighed by table sizes."""
    out = np.full((EXACT + 1, EXACT + 2), -np.inf)
    out[1, 1] = 0.0
    k = np.arange(EXACT + 2)
    for n in range(1, EXACT):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = np.where(k <= n, np.log(np.maximum(n - discount * k, 1e-300)) + out[n], -np.inf)
        out[n + 1, 1:] = np.logaddexp(out[n, :-1], stay[1:])
    return out


def log_ratio(t: np.ndarray, count: np.ndarray, discount: float) -> np.ndarray:
    """log of S(n, t + 1) / S(n, t) for many customers n, read off the last exact row.

    With few tables, t times the ratio is a function of t / n^d alone (the generating function's expansion at its
    singularity is in powers of n^-d); with many, of t / n (its saddle point). Between them the two are blended.
    """
    row = log_stirling(discount)[EXACT]
    k = np.arange(1, EXACT)
    places, values = np.concatenate(([0.0], k)), np.concatenate(([-np.log(discount)], np.log(k) + row[2 : EXACT + 1] - row[1:EXACT]))
    few = np.interp(t * (EXACT / count) ** discount, places, values)
    many = np.interp(t * (EXACT / count), places, values)
    share = np.clip((t / count - 0.1) / 0.2, 0, 1)
    return (1 - share) * few + share * many - np.log(t)


def reseat(count: np.ndarray, start: np.ndarray, step: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """A new number of tables of each dish given everyone else's seating.

    A dish of n customers opens table t + 1 with weight start + step * t (the restaurant's strength and other tables times
    the parent's probability of the dish). All its customers are reseated at once: with the table sizes summed out, t has
    weight S(n, t) * product of the opening weights. For more than EXACT customers the Stirling ratios come from their
    scaling law; where the most likely t is large, t is drawn from the normal law around it.
    """
    tables = np.minimum(count, 1).astype(np.int64)
    discount = round(discount, 3)
    exact = log_stirling(discount)
    small = np.flatnonzero((count > 1) & (count <= EXACT))
    small = small[np.argsort(count[small], kind="stable")]
    n = count[small]
    cuts = np.flatnonzero(np.diff(n, prepend=0)) if len(n) else np.zeros(0, np.int64)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(n)] if len(n) else [], strict=True):
        size = int(n[a])
        for lo in range(a, b, max(1, 400_000 // size)):
            at = small[lo : min(b, lo + max(1, 400_000 // size))]
            w = np.log(start[at, None] + step[at, None] * np.arange(1, size))
            w = np.concatenate((np.zeros((len(at), 1)), np.cumsum(w, axis=1)), axis=1) + exact[size, 1 : size + 1]
            tables[at] = 1 + _draw(w, rng)
    large = np.flatnonzero(count > EXACT)
    for lo in range(0, len(large), 4000):
        at = large[lo : lo + 4000]
        tables[at] = _reseat_many(count[at].astype(float), start[at], step[at], discount, rng)
    return tables


def _draw(log_weight: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    w = np.exp(log_weight - log_weight.max(axis=1, keepdims=True)).cumsum(axis=1)
    return (w < (rng.random(len(w)) * w[:, -1])[:, None]).sum(axis=1)


def _reseat_many(n: np.ndarray, start: np.ndarray, step: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    def slope(t: np.ndarray) -> np.ndarray:
        """How the log weight changes from t to t + 1."""
        return np.log(start + step * t) + log_ratio(t, n, discount)

    low, high = np.ones(len(n)), n.copy()
    for _ in range(60):
        middle = np.sqrt(low * high)
        rising = slope(middle) > 0
        low, high = np.where(rising, middle, low), np.where(rising, high, middle)
    out = np.ones(len(n), np.int64)
    few = np.flatnonzero(low <= 60)
    if len(few):
        t = np.arange(1, 256)
        w = np.log(start[few, None] + step[few, None] * t) + log_ratio(np.broadcast_to(t, (len(few), 255)).astype(float), n[few, None], discount)
        out[few] = 1 + _draw(np.concatenate((np.zeros((len(few), 1)), np.cumsum(w, axis=1)), axis=1), rng)
    many = np.flatnonzero(low > 60)
    if len(many):
        d = 0.05 * low
        bend = (slope(low + d) - slope(low - d)) / (2 * d)
        spread = np.sqrt(-1 / np.minimum(bend, -1e-12))
        out[many] = np.clip(np.rint(rng.normal(low[many], spread[many])), 1, n[many])
    return out


def discount_of(count: np.ndarray) -> float:
    """A discount from the numbers of singletons and pairs (Ney, Essen and Kneser)."""
    one, two = int((count == 1).sum()), int((count == 2).sum())
    return round(float(np.clip(one / max(one + 2 * two, 1), 0.2, 0.95)), 3)
