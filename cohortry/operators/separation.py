"""Where a logistic likelihood has no maximum, and in which direction it grows.

A pattern all of whose subjects have the outcome, or none of them, lets the
likelihood grow without end along a direction of the coefficients on which no pattern speaks against it. Such
directions form a cone. A direction inside it decides every pattern that any of them decides: their subjects are predicted exactly,
and the rest of the fit is that of the remaining patterns. All of this is linear algebra with at most as many
unknowns as terms, over the patterns whose outcome does not vary.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TINY = 1e-9


def null_space(rows: np.ndarray, size: int) -> np.ndarray:
    """An orthonormal basis, as columns, of the vectors of ``size`` numbers that all rows are orthogonal to."""
    if not len(rows):
        return np.eye(size)
    _, values, right = np.linalg.svd(rows.reshape(-1, size))
    rank = int((values > TINY * max(values.max(), 1)).sum())
    return right[rank:].T


def independent(rows: np.ndarray, size: int) -> np.ndarray:
    """The first columns that span all columns; the last column, the intercept, goes first."""
    chosen: list[int] = []
    for j in [size - 1, *range(size - 1)]:
        if len(rows) and np.linalg.matrix_rank(rows[:, [*chosen, j]], tol=TINY * len(rows)) > len(chosen):
            chosen.append(j)
    return np.array(sorted(chosen), int)


def nonnegative(columns: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """The weights, none negative, of the columns' sum nearest to ``goal``; by active sets."""
    count = columns.shape[1]
    weights, active = np.zeros(count), np.zeros(count, bool)
    for _ in range(30 * (count + 1)):
        slope = columns.T @ (goal - columns @ weights)
        slope[active] = -np.inf
        if not count or slope.max() <= TINY:
            break
        active[slope.argmax()] = True
        while True:
            tried = np.zeros(count)
            tried[active] = np.linalg.lstsq(columns[:, active], goal, rcond=None)[0]
            below = active & (tried <= TINY)
            if not below.any():
                break
            step = (weights[below] / np.maximum(weights[below] - tried[below], TINY)).min()
            weights = weights + min(step, 1) * (tried - weights)
            active &= weights > TINY
            weights[~active] = 0
        weights = tried
    return weights


@dataclass(frozen=True)
class Limit:
    """What a fit tends to. ``direction`` is 0 on the patterns that stay open, and at least 1 the right way on all decided ones.

    ``free`` are terms to fit on the open patterns, as many as these can tell apart. ``infinite`` has 0 for a term with a finite estimate,
    1 or -1 for one that grows without end that way, and not-a-number for one that may go either way.
    """

    decided: bool
    direction: np.ndarray
    free: np.ndarray
    infinite: np.ndarray


def limit(open_rows: np.ndarray, sided: np.ndarray, sign: np.ndarray) -> Limit:
    """The limit of a fit from rows that span its patterns of both outcomes, and its patterns of one outcome with its sign."""
    size = sided.shape[1]
    basis = null_space(open_rows, size)
    pulls = sided * sign[:, None]
    direction, left = np.zeros(size), np.arange(len(pulls))
    while True:
        seen = pulls[left] @ basis
        seen[np.abs(seen) < TINY] = 0
        found = seen.sum(axis=0)
        if not np.abs(seen).any():
            break
        found = seen.T @ (1 + nonnegative(seen.T, -found))
        if np.linalg.norm(found) < 1e-7:  # some sum of pulls with positive weights is nothing: no direction suits all
            break
        step = basis @ (found / np.abs(found).max())
        new = pulls[left] @ step > 1e-7
        if not new.any():
            break
        step = step / (pulls[left] @ step)[new].min()
        done = np.delete(pulls, left, axis=0)
        # what is decided already stays decided
        direction = direction * (1 + np.max(-(done @ step), initial=0)) + step
        left = left[~new]
    direction[np.abs(direction) < TINY] = 0
    rest = np.concatenate([open_rows.reshape(-1, size), sided[left]])
    loose = null_space(rest, size)
    infinite = np.zeros(size)
    cone = pulls @ loose
    for j in np.flatnonzero(np.linalg.norm(loose, axis=1) > TINY):
        # a term cannot grow if growing is a sum of pulls against it
        stopped = [np.linalg.norm(cone.T @ nonnegative(cone.T, way * loose[j]) - way * loose[j]) < 1e-7 for way in (-1, 1)]
        infinite[j] = {(True, False): -1, (False, True): 1}.get(tuple(stopped), np.nan)
    return Limit(len(left) < len(pulls), direction, independent(rest, size), infinite)
