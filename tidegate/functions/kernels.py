"""Numerical kernels of Gaussian Markov-switching models and alarm detectors, on one series at a time.

Recursions over time are products of K x K matrices, so they run in blocks: about sqrt(T) numpy steps over all
blocks at once give the block products, a short loop links the blocks, and a second sweep fills them.
Where a scaled linear step would vanish (a regime of probability zero meets an outlier), the
recursion is redone in the log domain step by step.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

HALF_LN_2PI = 0.9189385332046728
#: Floors and tolerances of the model.
RATIO_FLOOR, WEIGHT_FLOOR, VARIANCE_FLOOR, SIMPLEX_TOL = 1e-300, 1e-10, 1e-6, 1e-9


class ModelError(ValueError):
    """Parameters or observations that the model can't take."""


@dataclass
class Params:
    pi: np.ndarray
    transition: np.ndarray
    means: np.ndarray
    variances: np.ndarray

    def __post_init__(self) -> None:
        for name in ("pi", "transition", "means", "variances"):
            setattr(self, name, np.asarray(getattr(self, name), float))

    @property
    def k(self) -> int:
        return len(self.pi)

    def check(self) -> Params:
        """At least two regimes, probabilities that sum to one, variances above zero."""
        k = self.k
        if k < 2 or self.transition.shape != (k, k) or len(self.means) != k or len(self.variances) != k:
            raise ModelError("at least two regimes, and as many rows, means and variances, are needed")
        for name, rows in (("pi", self.pi[None]), ("transition", self.transition)):
            if not np.isfinite(rows).all() or (rows < 0).any() or (np.abs(rows.sum(1) - 1) > SIMPLEX_TOL).any():
                raise ModelError(f"{name} isn't made of probabilities that sum to one")
        if not np.isfinite(self.means).all() or not np.isfinite(self.variances).all() or (self.variances <= 0).any():
            raise ModelError("means must be finite and variances positive")
        return self

    def row(self) -> dict:
        return {"k": self.k, "pi": self.pi.tolist(), "transition": self.transition.tolist(), "means": self.means.tolist(), "variances": self.variances.tolist()}


def log_density(y: np.ndarray, means: np.ndarray, variances: np.ndarray) -> np.ndarray:
    """T x K log densities."""
    y = np.asarray(y, float)[:, None]
    return -HALF_LN_2PI - 0.5 * np.log(variances) - 0.5 * (y - means) ** 2 / variances


def log_sum_exp(x: np.ndarray, axis: int = -1) -> np.ndarray:
    top = np.max(x, axis=axis, keepdims=True)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.squeeze(safe, axis) + np.log(np.exp(x - safe).sum(axis=axis))


def _sweep(steps: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """v[t] = v[t-1] @ steps[t], scaled to sum one, and the sums; None where a sum vanishes."""
    t, k, _ = steps.shape
    length = max(1, int(math.sqrt(t)))
    blocks = -(-t // length)
    padded = np.concatenate((steps, np.broadcast_to(np.eye(k), (blocks * length - t, k, k)))).reshape(blocks, length, k, k)
    whole = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for i in range(length):
        whole = whole @ padded[:, i]
        top = whole.max(axis=(1, 2), keepdims=True)
        if not (top > 0).all():
            return None
        whole = whole / top
    firsts = np.empty((blocks, k))
    v = start
    for b in range(blocks):
        firsts[b] = v
        v = v @ whole[b]
        total = v.sum()
        if not total > 0 or not np.isfinite(total):
            return None
        v = v / total
    out, sums = np.empty((blocks, length, k)), np.empty((blocks, length))
    for i in range(length):
        firsts = np.einsum("bk,bkj->bj", firsts, padded[:, i])
        total = firsts.sum(1)
        if not (total > 0).all() or not np.isfinite(total).all():
            return None
        firsts = firsts / total[:, None]
        out[:, i], sums[:, i] = firsts, total
    return out.reshape(-1, k)[:t], sums.ravel()[:t]


@dataclass
class Filtered:
    predicted: np.ndarray
    filtered: np.ndarray
    log_c: np.ndarray

    @property
    def log_likelihood(self) -> float:
        return float(self.log_c.sum())


def forward_filter(p: Params, y: np.ndarray, move_first: bool = False) -> Filtered:
    """Hamilton filter. The first prediction is pi, or pi moved one step if move_first (the online filter)."""
    y = np.asarray(y, float)
    if not len(y):
        raise ModelError("no observations")
    if not np.isfinite(y).all():
        raise ModelError("observations must be finite")
    logs = log_density(y, p.means, p.variances)
    shift = logs.max(1)
    weights = np.exp(logs - shift[:, None])
    steps = p.transition[None] * weights[:, None, :]
    if not move_first:
        steps[0] = np.diag(weights[0])
    got = _sweep(steps, p.pi)
    first = p.pi @ p.transition if move_first else p.pi
    if got is not None:
        filtered, sums = got
        return Filtered(np.concatenate((first[None], filtered[:-1] @ p.transition)), filtered, np.log(sums) + shift)
    predicted, filtered, log_c = np.empty_like(logs), np.empty_like(logs), np.empty(len(y))
    now = first
    for t in range(len(y)):
        predicted[t] = now
        with np.errstate(divide="ignore"):
            u = np.where(now > 0, logs[t] + np.log(np.where(now > 0, now, 1.0)), -np.inf)
        log_c[t] = log_sum_exp(u)
        if not np.isfinite(log_c[t]):
            raise ModelError(f"the density of observation {t + 1} vanishes")
        filtered[t] = np.exp(u - log_c[t])
        now = filtered[t] @ p.transition
    return Filtered(predicted, filtered, log_c)


def smooth(p: Params, f: Filtered) -> np.ndarray:
    """Smoothed probabilities, backward from the last filtered ones; each row is scaled to sum one."""
    t = len(f.filtered)
    if t == 1:
        return f.filtered.copy()
    ratio = np.where(f.predicted[1:] < RATIO_FLOOR, 0.0, 1.0 / np.maximum(f.predicted[1:], RATIO_FLOOR))
    # gamma[t] = diag(f[t]) P diag(1 / pred[t+1]) gamma[t+1], as row vectors from the end
    steps = (f.filtered[:-1, :, None] * p.transition[None] * ratio[:, None, :]).transpose(0, 2, 1)[::-1]
    got = _sweep(steps, f.filtered[-1])
    if got is not None:
        return np.concatenate((got[0][::-1], f.filtered[-1:]))
    out = np.empty_like(f.filtered)
    out[-1] = f.filtered[-1]
    for i in range(t - 2, -1, -1):
        g = f.filtered[i] * (p.transition @ (out[i + 1] * ratio[i]))
        out[i] = g / g.sum() if g.sum() > 0 else g
    return out


def pairwise(p: Params, f: Filtered, smoothed: np.ndarray) -> np.ndarray:
    """(T-1) x K x K posteriors of consecutive regimes."""
    if len(smoothed) < 2:
        return np.zeros((0, p.k, p.k))
    ratio = np.where(f.predicted[1:] < RATIO_FLOOR, 0.0, smoothed[1:] / np.maximum(f.predicted[1:], RATIO_FLOOR))
    return f.filtered[:-1, :, None] * p.transition[None] * ratio[:, None, :]


def _updated(first: np.ndarray, leave: np.ndarray, expected: np.ndarray, weight: np.ndarray, sums: np.ndarray, squares, old: Params, floor: float) -> Params:
    """Closed-form update from the sums over a series; squares(means) sums the weighted squares about them. Regimes or rows without weight keep their values."""
    rows = np.where(leave[:, None] < WEIGHT_FLOOR, old.transition, expected / np.maximum(leave, WEIGHT_FLOOR)[:, None])
    rows = rows / rows.sum(1, keepdims=True)
    has = weight >= WEIGHT_FLOOR
    safe = np.where(has, weight, 1.0)
    means = np.where(has, sums / safe, old.means)
    return Params(first / first.sum(), rows, means, np.where(has, np.maximum(squares(means) / safe, floor), old.variances))


def m_step(y: np.ndarray, smoothed: np.ndarray, expected: np.ndarray, old: Params, floor: float = VARIANCE_FLOOR) -> Params:
    """Closed-form update; regimes or rows without weight keep their values."""
    y = np.asarray(y, float)
    return _updated(smoothed[0], smoothed[:-1].sum(0), expected, smoothed.sum(0), smoothed.T @ y, lambda means: (smoothed * (y[:, None] - means) ** 2).sum(0), old, floor)


#: Steps after which products are scaled, and the least sum that a scaled step may have here.
SCALE_EACH, LEAST_SUM = 16, 1e-100


class Blocks:
    """A series dealt into blocks for a step of EM: arrays have the axes (regime, place in the block, block), so each of a block's
    steps is one small matrix product over all blocks, side by side in memory. The places behind the series' end have weight one, which
    leaves the backward recursion as it is, and don't count in sums.

    Where a sum nearly vanishes the results are None; forward_filter, smooth and m_step have the log domain for that."""

    def __init__(self, y: np.ndarray, k: int):
        self.t, self.k = len(y), k
        self.length = max(1, int(math.sqrt(self.t) / 2))
        self.blocks = -(-self.t // self.length)
        self.rest = self.blocks * self.length - self.t
        self.y = np.ascontiguousarray(np.concatenate((y, np.zeros(self.rest))).reshape(self.blocks, self.length).T)
        shape = (k, self.length, self.blocks)
        self.w, self.f, self.h = np.empty(shape), np.empty(shape), np.empty(shape)

    def _end(self, x: np.ndarray, value: float) -> None:
        if self.rest:
            x[..., self.length - self.rest :, -1] = value

    @staticmethod
    def _chain(products: np.ndarray, start: list[float]) -> np.ndarray | None:
        """What reaches each block: products (from, to, block) one after the other, as columns."""
        out, v, k = [], start, range(len(start))
        for m in products.transpose(2, 1, 0).tolist():
            out.append(v)
            v = [sum(v[i] * row[i] for i in k) for row in m]
            total = sum(v)
            if not 0 < total < math.inf:
                return None
            v = [x / total for x in v]
        return np.ascontiguousarray(np.array(out).T)

    def forward(self, p: Params) -> float | None:
        """The log-likelihood; keeps the filtered probabilities and the weights over their sums."""
        k, n = self.k, self.blocks
        w = self.w
        for j in range(k):
            np.subtract(self.y, p.means[j], out=w[j])
            np.multiply(w[j], w[j], out=w[j])
            w[j] *= -0.5 / p.variances[j]
            w[j] += -HALF_LN_2PI - 0.5 * math.log(p.variances[j])
        shift = w.max(0)
        np.subtract(w, shift, out=w)
        np.exp(w, out=w)
        self._end(w, 1.0)
        self._end(shift, 0.0)
        to = np.ascontiguousarray(p.transition.T)
        whole, scratch = np.zeros((k, k, n)), np.empty((k, k, n))  # (to, from, block)
        whole[range(k), range(k)] = 1.0
        for i in range(self.length):
            np.matmul(to, whole.reshape(k, -1), out=scratch.reshape(k, -1))
            if i == 0:
                scratch[:, :, 0] = np.eye(k)  # pi is the first prediction
            np.multiply(scratch, w[:, i, None, :], out=whole)
            if i % SCALE_EACH == SCALE_EACH - 1:
                top = whole.max((0, 1))
                if not top.min() > LEAST_SUM:
                    return None
                whole /= top
        now = self._chain(whole.transpose(1, 0, 2), p.pi.tolist())
        if now is None:
            return None
        c, u = np.empty((self.length, n)), np.empty((k, n))
        for i in range(self.length):
            np.matmul(to, now, out=u)
            if i == 0:
                u[:, 0] = p.pi
            np.multiply(u, w[:, i], out=u)
            np.add.reduce(u, 0, out=c[i])
            now = self.f[:, i]
            np.divide(u, c[i], out=now)
        if not (c.min() > LEAST_SUM and np.isfinite(c).all()):
            return None
        self._end(c, 1.0)
        w /= c
        return float(np.log(c, out=c).sum() + shift.sum())

    def update(self, p: Params, floor: float = VARIANCE_FLOOR) -> Params | None:
        """The parameters after the step whose forward half went before."""
        k, n, e, f, h = self.k, self.blocks, self.w, self.f, self.h
        tr = np.ascontiguousarray(p.transition)
        whole, scratch = np.zeros((k, k, n)), np.empty((k, k, n))  # (from, to, block)
        whole[range(k), range(k)] = 1.0
        for i in range(self.length - 1, -1, -1):
            np.multiply(whole, e[:, i, None, :], out=scratch)
            np.matmul(tr, scratch.reshape(k, -1), out=whole.reshape(k, -1))
        if not np.isfinite(whole).all():
            return None
        behind = self._chain(whole[:, :, ::-1].transpose(1, 0, 2), [1.0 / k] * k)
        if behind is None:
            return None
        behind = np.ascontiguousarray(behind[:, ::-1])
        behind /= (behind * f[:, -1]).sum(0) if not self.rest else np.append((behind * f[:, -1]).sum(0)[:-1], behind[0, -1])
        for i in range(self.length - 1, -1, -1):
            # h becomes the backward sums ahead of a row's own weight; with it, behind it
            now = h[:, i]
            now[...] = behind
            behind = np.matmul(tr, now * e[:, i])
        self._end(f, 0.0)
        gamma = f * h
        total = gamma.sum(0)
        self._end(total, 1.0)
        if not (total.min() > 0 and np.isfinite(total).all()):
            return None
        gamma /= total
        np.multiply(h, e, out=h)
        self._end(h, 0.0)
        inside, across = f[:, :-1].reshape(k, -1), f[:, -1, :-1]
        expected = p.transition * (inside @ h[:, 1:].reshape(k, -1).T + across @ h[:, 0, 1:].T)
        flat, y = gamma.reshape(k, -1), self.y.ravel()
        weight = flat.sum(1)
        last = gamma[:, (self.t - 1) % self.length, -1]
        return _updated(gamma[:, 0, 0], weight - last, expected, weight, flat @ y, lambda means: np.array([g @ (y - m) ** 2 for g, m in zip(flat, means)]), p, floor)


def initial_params(y: np.ndarray, k: int) -> Params:
    """Regimes from k consecutive chunks of the sorted values; persistent transitions."""
    y = np.sort(np.asarray(y, float))
    if len(y) < 1:
        raise ModelError("no observations")
    chunk = max(len(y) // k, 1)
    means, variances = np.zeros(k), np.full(k, VARIANCE_FLOOR)
    for j in range(k):
        part = y[min(j * chunk, len(y) - 1) : len(y) if j == k - 1 else min((j + 1) * chunk, len(y))]
        part = part if len(part) else y[-1:]
        means[j], variances[j] = part.mean(), max(part.var(), VARIANCE_FLOOR)
    rows = np.full((k, k), 0.1 / (k - 1))
    np.fill_diagonal(rows, 0.9)
    return Params(np.full(k, 1 / k), rows, means, variances)


@dataclass
class Fit:
    params: Params
    history: list[float] = field(default_factory=list)
    converged: bool = False

    @property
    def log_likelihood(self) -> float:
        return self.history[-1]

    @property
    def n_iter(self) -> int:
        return len(self.history) - 1


def fit_em(y: np.ndarray, start: Params, tol: float = 1e-6, max_iter: int = 1000, floor: float = VARIANCE_FLOOR) -> Fit:
    """Baum-Welch until the log-likelihood changes by less than tol."""
    y = np.asarray(y, float)
    p = start.check()
    if not len(y) or not np.isfinite(y).all():
        raise ModelError("observations must be there and finite")
    blocks = Blocks(y, p.k)

    def forward() -> tuple[float, Filtered | None]:
        got = blocks.forward(p)
        return (got, None) if got is not None else ((f := forward_filter(p, y)).log_likelihood, f)

    ll, f = forward()
    out = Fit(p, [ll])
    for _ in range(max_iter):
        new = blocks.update(p, floor) if f is None else None
        if new is None:
            f = f or forward_filter(p, y)
            s = smooth(p, f)
            new = m_step(y, s, pairwise(p, f, s).sum(0), p, floor)
        p = new
        ll, f = forward()
        out.params = p
        out.history.append(ll)
        if abs(out.history[-1] - out.history[-2]) < tol:
            out.converged = True
            break
    return out


def stationary(transition: np.ndarray, most: int = 256, tol: float = 1e-10) -> np.ndarray:
    """Power iteration from the uniform distribution; that one again if it doesn't settle."""
    k = len(transition)
    v = np.full(k, 1 / k)
    for _ in range(most):
        new = v @ transition
        total = new.sum()
        if not total > 0 or not np.isfinite(total):
            break
        new = new / total
        if np.abs(new - v).sum() < tol:
            return new
        v = new
    return np.full(k, 1 / k)


def dominant(filtered: np.ndarray) -> np.ndarray:
    """Likeliest regime of each row, the last one of a tie."""
    k = filtered.shape[1]
    return k - 1 - filtered[:, ::-1].argmax(1)


@dataclass
class Detector:
    """kind: hard_switch, leave_previous, total_variation or surprise (with the weight of its running baseline, if it has one)."""

    kind: str
    threshold: float
    required: int = 1
    cooldown: int = 0
    alpha: float | None = None

    def check(self) -> Detector:
        if self.kind not in ("hard_switch", "leave_previous", "total_variation", "surprise"):
            raise ModelError(f"no detector {self.kind!r}")
        if not math.isfinite(self.threshold) or self.required < 1 or self.cooldown < 0:
            raise ModelError("a finite threshold, at least one crossing and no negative cooldown are needed")
        if self.alpha is not None and not 0 < self.alpha < 1:
            raise ModelError("the baseline's weight must be between 0 and 1")
        return self


def scores(d: Detector, filtered: np.ndarray, log_c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, crossed, ready) of each step; the first step is ready only for a surprise without baseline."""
    t = len(log_c)
    score, ready = np.zeros(t), np.arange(t) > 0
    if d.kind == "surprise":
        s = -log_c
        if d.alpha is None:
            return s, s >= d.threshold, np.ones(t, bool)
        base = s[0] if t else 0.0
        for i in range(1, t):
            score[i] = s[i] - base
            base = d.alpha * s[i] + (1 - d.alpha) * base
        return score, ready & (score >= d.threshold), ready
    if t > 1:
        top = dominant(filtered)
        if d.kind == "hard_switch":
            score[1:] = (top[1:] != top[:-1]) & (filtered[np.arange(1, t), top[1:]] >= max(d.threshold, 0.0))
        elif d.kind == "leave_previous":
            score[1:] = 1 - filtered[np.arange(1, t), top[:-1]]
        else:
            score[1:] = np.abs(filtered[1:] - filtered[:-1]).sum(1) / 2
    crossed = score > 0 if d.kind == "hard_switch" else score >= d.threshold
    return score, ready & crossed, ready


def resume(d: Detector, filtered: np.ndarray, log_c: np.ndarray, before: np.ndarray | None = None, base: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float | None]:
    """scores() of steps that follow others: `before` is the filtered row ahead of them and `base` the running baseline there, None at the start. With the baseline at the end."""
    if d.kind == "surprise" and d.alpha is not None:
        score, ready = np.zeros(len(log_c)), np.ones(len(log_c), bool)
        for i, s in enumerate((-log_c).tolist()):
            if base is None:
                ready[i], base = False, s
            else:
                score[i] = s - base
                base = d.alpha * s + (1 - d.alpha) * base
        return score, ready & (score >= d.threshold), ready, base
    if d.kind == "surprise" or before is None:
        return *scores(d, filtered, log_c), None
    score, crossed, ready = scores(d, np.vstack((before, filtered)), np.append(0.0, log_c))
    return score[1:], crossed[1:], ready[1:], None


def persist(crossed, ready, required: int, cooldown: int, count: int = 0, left: int = 0) -> tuple[list[bool], int, int]:
    """Alarms after `required` crossings in a row, then none for `cooldown` steps; steps that aren't ready pass by. With the state at the end."""
    out = []
    for x, r in zip(crossed, ready):
        alarm = False
        if r:
            if left > 0:
                left, count = left - 1, 0
            elif x:
                count += 1
                if count >= required:
                    count, left, alarm = 0, cooldown, True
            else:
                count = 0
        out.append(alarm)
    return out, count, left


def detect(d: Detector, f: Filtered) -> dict[str, np.ndarray]:
    score, crossed, ready = scores(d.check(), f.filtered, f.log_c)
    alarm = np.array(persist(crossed.tolist(), ready.tolist(), d.required, d.cooldown)[0], bool)
    return {"score": score, "ready": ready, "alarm": alarm, "dominant": dominant(f.filtered)}


def match_events(truth: list[int], alarms: list[int], window: int) -> list[tuple[int, int]]:
    """(change point, alarm) pairs: each change point in order takes the first alarm not yet used in [tau, tau + window)."""
    out, last = [], 0
    alarms = sorted(set(alarms))
    i = 0
    for tau in sorted(truth):
        while i < len(alarms) and (alarms[i] < tau or alarms[i] <= last):
            i += 1
        if i < len(alarms) and alarms[i] < tau + window:
            out.append((tau, alarms[i]))
            last = alarms[i]
    return out


def simulate(p: Params, t: int, rng: np.random.Generator, jump_prob: float = 0.0, jump_scale: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(states, observations); with jumps, an observation gets N(0, (scale sigma)^2) on top now and then."""
    u = rng.random(t)
    start, rows = np.cumsum(p.pi), np.cumsum(p.transition, axis=1)
    states = np.empty(t, np.int64)
    for i in range(t):
        states[i] = min(int(np.searchsorted(start if i == 0 else rows[states[i - 1]], u[i], "right")), p.k - 1)
    sd = np.sqrt(p.variances[states])
    y = p.means[states] + sd * rng.standard_normal(t)
    if jump_prob > 0:
        y = y + (rng.random(t) < jump_prob) * jump_scale * sd * rng.standard_normal(t)
    return states, y
