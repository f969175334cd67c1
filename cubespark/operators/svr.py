"""Linear epsilon support vector regression for small problems, with an unregularised bias."""

from __future__ import annotations

import numpy as np


def fit_svr(x: np.ndarray, y: np.ndarray, c: float = 1.0, epsilon: float = 0.1, tolerance: float = 1e-3, steps: int = 20_000) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2 / 2 + c * sum of errors beyond epsilon.

    The dual in b = a - a*, with sum b = 0 and |b| <= c, is solved two coordinates at a time (Chang and Lin's SMO): the
    pair that violates optimality most is moved to its exact optimum along the direction (+1, -1).
    """
    n = len(y)
    gram = x @ x.T
    b, f = np.zeros(n), -y.astype(float)  # f = gram @ b - y
    for _ in range(steps):
        # slopes of the dual in moving b up or down: the epsilon term changes side at 0
        up = np.where(b < c, f + np.where(b >= 0, epsilon, -epsilon), np.inf)
        down = np.where(b > -c, f + np.where(b > 0, epsilon, -epsilon), -np.inf)
        i, j = int(up.argmin()), int(down.argmax())
        if down[j] - up[i] < tolerance:
            break
        curve = max(gram[i, i] + gram[j, j] - 2 * gram[i, j], 1e-12)
        move = (down[j] - up[i]) / curve
        # not past the box, nor past a change of sign, where the slope jumps
        move = min(move, (0 - b[i]) if b[i] < 0 else c - b[i], b[j] if b[j] > 0 else b[j] + c)
        b[i] += move
        b[j] -= move
        f += move * (gram[:, i] - gram[:, j])
    up = np.where(b < c, f + np.where(b >= 0, epsilon, -epsilon), np.inf)
    down = np.where(b > -c, f + np.where(b > 0, epsilon, -epsilon), -np.inf)
    return x.T @ b, float(-(up.min() + down.max()) / 2)


def folds(n: int, k: int, rng: np.random.Generator | None) -> list[np.ndarray]:
    at = np.arange(n) if rng is None else rng.permutation(n)
    return np.array_split(at, k)


def cv_error(x: np.ndarray, y: np.ndarray, c: float, epsilon: float, parts: list[np.ndarray]) -> float:
    """Mean absolute error over folds."""
    errors = []
    for test in parts:
        train = np.setdiff1d(np.arange(len(y)), test)
        w, bias = fit_svr(x[train], y[train], c, epsilon)
        errors.append(np.abs(x[test] @ w + bias - y[test]).mean())
    return float(np.mean(errors))


#: The grid of the search.
GRID = [(c, e) for c in (0.001, 0.01, 0.1, 1.0, 10.0) for e in (0.1, 0.4, 0.7, 1.0)]


def search(x: np.ndarray, y: np.ndarray, strategy: str, rng: np.random.Generator) -> tuple[float, float, float]:
    """(c, epsilon, cross-validated error): Custom is fixed, FullGridSearch tries all, RandomGridSearch five."""
    if strategy == "Custom":
        return 1000.0, 1.0, cv_error(x, y, 1000.0, 1.0, folds(len(y), 3, rng))
    grid = GRID if strategy == "FullGridSearch" else [GRID[i] for i in rng.choice(len(GRID), 5, replace=False)]
    parts = folds(len(y), 3, None)
    return min(((c, e, cv_error(x, y, c, e, parts)) for c, e in grid), key=lambda t: t[2])
