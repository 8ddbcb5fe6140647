"""Two-way effects and a low-rank part under a nuclear-norm penalty, solved in factors.

With L = A B' the penalty is half of |A|^2 + |B|^2, and given the periods' side (effects beta, loadings A, coefficients
gamma of covariates) each unit's effect and loadings are a small ridge regression of their own. So a pass over
units, in any order and anywhere, yields the objective and the sums that the periods' next values need; only the periods' side is
carried from pass to pass. Passes are mixed with the last few of them (Anderson), and a mixed step that doesn't lower the objective is
taken back. The factors' rank grows from 0 by the leading directions of the weighted residual R until its spectral
norm is at most half the penalty, which certifies that no other L is better.

``solve`` runs over anything that can do a pass: ``Panel`` holds a dense panel in one task, ``operators.joint`` keeps blocks of units in Spark.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np

#: Steps that are mixed, and how much beyond half the penalty the residual's norm may be: while the rank grows, and at the end.
MIXED, LOOSE, CERTAIN = 15, 1e-3, 1e-5


@dataclass
class State:
    """The periods' side of a fit."""

    beta: np.ndarray
    a: np.ndarray
    gamma: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([self.beta, self.a.ravel(), self.gamma])

    def like(self, x: np.ndarray) -> State:
        t, n = len(self.beta), self.a.size
        return State(x[:t], x[t : t + n].reshape(self.a.shape), x[t + n :])


@dataclass
class Solved:
    """``dual``: the residual's spectral norm by half the penalty (at most 1 but for tolerance at an optimum)."""

    state: State
    objective: float
    passes: int
    converged: bool
    dual: float


class Problem(Protocol):
    n_periods: int
    n_units: int
    n_covariates: int

    def sweep(self, state: State, lam: float) -> np.ndarray: ...

    def leading(self, state: State, lam: float) -> tuple[np.ndarray, np.ndarray]: ...


def units_given(state: State, y: np.ndarray, w: np.ndarray, x: np.ndarray, lam: float) -> tuple[np.ndarray, np.ndarray]:
    """Effect and loadings of each unit (units x (1 + rank)) and what the fit leaves of ``y`` (periods x units)."""
    t, n = y.shape
    z = np.hstack([np.ones((t, 1)), state.a])
    k = z.shape[1]
    normal = ((z[:, :, None] * z[:, None, :]).reshape(t, k * k).T @ w).T.reshape(n, k, k)
    normal = normal + np.diag([0.0] + [lam / 2] * (k - 1))
    normal[w.sum(axis=0) <= 0, 0, 0] = 1.0  # a unit without weight has effect 0
    goal = y - state.beta[:, None] - x @ state.gamma
    theta = np.linalg.solve(normal, (z.T @ (w * goal)).T[..., None])[..., 0]
    return theta, goal - z @ theta.T


def sums(state: State, y: np.ndarray, w: np.ndarray, x: np.ndarray, lam: float) -> np.ndarray:
    """One flat vector, additive over units: objective, and the periods' normal equations with those of the covariates."""
    t, n = y.shape
    theta, rest = units_given(state, y, w, x, lam)
    k = theta.shape[1]
    q = theta.copy()
    q[:, 0] = 1.0
    own = w * (y - theta[:, 0])
    cross = np.einsum("tn,nk,tnp->tkp", w, q, x, optimize=True) if x.shape[2] else np.zeros((t, k, 0))
    parts = [
        np.array([(w * rest**2).sum() + lam / 2 * (theta[:, 1:] ** 2).sum()]), w @ (q[:, :, None] * q[:, None, :]).reshape(n, k * k), own @ q, cross,
        np.einsum("tnp,tn,tnq->pq", x, w, x, optimize=True), np.einsum("tnp,tn->p", x, own),
    ]
    return np.concatenate([p.ravel() for p in parts])


def _periods(flat: np.ndarray, state: State, lam: float) -> tuple[float, State]:
    """The objective at ``state`` and the periods' next values from the sums."""
    t, k, p = len(state.beta), state.a.shape[1] + 1, len(state.gamma)
    cuts = np.cumsum([1, t * k * k, t * k, t * k * p, p * p])
    one, normal, right, cross, xx, xr = np.split(flat, cuts)
    normal = normal.reshape(t, k, k) + np.diag([0.0] + [lam / 2] * (k - 1))
    normal[normal[:, 0, 0] <= 0, 0, 0] = 1.0  # a period without weight has effect 0
    right, cross, xx = right.reshape(t, k), cross.reshape(t, k, p), xx.reshape(p, p)
    alone = np.linalg.solve(normal, right[..., None])[..., 0]
    gamma = state.gamma
    if p:
        slope = np.linalg.solve(normal, cross)
        gamma = np.linalg.lstsq(xx - np.einsum("tkp,tkq->pq", cross, slope), xr - np.einsum("tkp,tk->p", cross, alone), rcond=1e-10)[0]
        alone = alone - slope @ gamma
    return float(one[0] + lam / 2 * (state.a**2).sum()), State(alone[:, 0], alone[:, 1:], gamma)


def _settle(problem: Problem, state: State, lam: float, tol: float, most: int) -> tuple[State, float, int, bool]:
    """Mixed passes at a fixed rank until a pass moves fitted values by less than ``tol``."""
    t = problem.n_periods
    at, fallback, last = state.flat(), None, np.inf
    seen: list[np.ndarray] = []
    moves: list[np.ndarray] = []
    for step in range(1, most + 1):
        objective, nxt = _periods(problem.sweep(state.like(at), lam), state.like(at), lam)
        if not np.isfinite(objective):
            raise FloatingPointError("fit diverged")
        if fallback is not None and objective > last + 1e-12 * abs(last):
            at, fallback, seen, moves = fallback, None, [], []
            continue
        last, goal = objective, nxt.flat()
        move = goal - at
        # loadings of units are about |A| by the root of their number: both sides weigh alike at an optimum
        size = max(1.0, 3 * np.linalg.norm(nxt.a) / np.sqrt(problem.n_units))
        shift = move[:t] - move[:t].mean()
        if max(np.abs(shift).max(initial=0), size * np.abs(move[t:]).max(initial=0)) < tol:
            return nxt, objective, step, True
        seen, moves, fallback = [*seen[-MIXED + 1 :], at], [*moves[-MIXED + 1 :], move], goal
        if len(seen) > 1:
            d_move, d_at = np.diff(moves, axis=0).T, np.diff(seen, axis=0).T
            at = goal - (d_at + d_move) @ np.linalg.lstsq(d_move, move, rcond=1e-10)[0]
        else:
            at = goal
    return state.like(fallback if fallback is not None else at), last, most, False


def solve(problem: Problem, lam: float, tol: float = 1e-6, maxiter: int = 500, start: State | None = None) -> Solved:
    """The optimum for a penalty above 0 (an infinite one: effects alone), from ``start`` or from nothing. ``maxiter`` bounds the passes."""
    t, p = problem.n_periods, problem.n_covariates
    state = start or State(np.zeros(t), np.zeros((t, 0)), np.zeros(p))
    plain = not np.isfinite(lam)
    lam = 0.0 if plain else lam
    fine, passes, dual = plain or start is not None, 0, 0.0
    while True:
        state, objective, used, ok = _settle(problem, state, lam, tol if fine else 1e3 * tol, max(1, maxiter - passes))
        passes += used
        if plain or passes >= maxiter:
            return Solved(state, objective, passes, ok and fine, dual)
        u, s = problem.leading(state, lam)
        dual = float(s[0] / (lam / 2)) if len(s) else 0.0
        new = u[:, s > lam / 2 * (1 + (CERTAIN if fine else LOOSE))]
        strength = np.sqrt(s[: new.shape[1]])
        if state.a.shape[1] and new.shape[1]:
            own = np.linalg.qr(state.a)[0]
            new = new - own @ (own.T @ new)
        new = new * strength if new.size else new
        new = new[:, np.linalg.norm(new, axis=0) > 1e-6 * (strength if len(strength) else 1.0)]
        if not new.shape[1] or state.a.shape[1] >= t:
            if fine:
                return Solved(state, objective, passes, ok, dual)
            fine = True
            continue
        state = State(state.beta, np.hstack([state.a, new[:, : t - state.a.shape[1]] * 0.1]), state.gamma)


#: What a Gram matrix may cost: residual of its eigenvectors by the greatest eigenvalue, and error of a singular value at the level that matters.
RESIDUAL, BUDGET = 1e-9, 1e-12
EPS = float(np.finfo(float).eps)


def spectrum(m: np.ndarray, level: float) -> tuple[np.ndarray, np.ndarray]:
    """Left singular vectors and falling singular values, exact for values of ``level`` and more; vectors of lesser ones may be anything.

    From the smaller Gram matrix. That squares the values, so it is taken only where the greatest is so near the level that the error stays in
    its budget, and where the vectors' residual confirms it; else by a singular value decomposition.
    """
    wide = m.shape[0] <= m.shape[1]
    gram = m @ m.T if wide else m.T @ m
    size = gram.trace()  # at least the greatest eigenvalue
    if level > 0 and EPS * size <= BUDGET * level * level:  # false where it isn't finite
        e, v = np.linalg.eigh(gram)
        rest = (gram @ v - v * e).ravel()
        if rest @ rest <= (RESIDUAL * e[-1]) ** 2 or not size:
            s = np.sqrt(np.maximum(e, 0.0))
            return (v if wide else m @ (v / np.maximum(s, 1e-300)))[:, ::-1], s[::-1]
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    return u, s


class Panel:
    """A dense panel (periods x units) with weights; ``y`` is anything where the weight is 0."""

    def __init__(self, y: np.ndarray, w: np.ndarray, x: np.ndarray | None = None) -> None:
        self.y, self.w = y, w
        self.n_periods, self.n_units = y.shape
        self.x = np.zeros((*y.shape, 0)) if x is None else x
        self.n_covariates = self.x.shape[2]

    def sweep(self, state: State, lam: float) -> np.ndarray:
        return sums(state, self.y, self.w, self.x, lam)

    def leading(self, state: State, lam: float) -> tuple[np.ndarray, np.ndarray]:
        return spectrum(self.w * units_given(state, self.y, self.w, self.x, lam)[1], lam / 2)

    def parts(self, state: State, lam: float) -> tuple[np.ndarray, np.ndarray]:
        """Unit effects, and the low-rank part."""
        theta = units_given(state, self.y, self.w, self.x, lam)[0]
        return theta[:, 0], state.a @ theta[:, 1:].T
