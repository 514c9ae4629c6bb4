"""Conditional-sum-of-squares fit of one seasonal ARIMA model to one chunk (numpy, no Spark).

Model: v = y - mean - drift * t, phi(B) Phi(B^m) (1-B)^d (1-B^m)^D v_t = theta(B) Theta(B^m) e_t.
Residuals start after the first p + m*P differenced values with zero earlier errors. Filtering by
1/theta(B)Theta(B^m) is a convolution with its power series, exact for a zero start.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import mul

import numpy as np

# 5% point of the level-stationarity test, seasonal-strength threshold, and the
# smallest root modulus of a model that the automatic choice accepts.
KPSS_5PCT = 0.463
SEASONAL_STRENGTH = 0.64
MIN_ROOT = 1.01

ITERATIONS = 60
CONVERGED = 1e-7


@dataclass(frozen=True)
class Order:
    p: int
    d: int
    q: int
    sp: int = 0
    sd: int = 0
    sq: int = 0
    m: int = 1
    mean: bool = True
    drift: bool = False

    def regressors(self, n: int) -> np.ndarray:
        """Differenced columns of the mean and drift terms that differencing leaves in."""
        cols = []
        if self.mean and self.d + self.sd == 0:
            cols.append(np.ones(n))
        if self.drift and self.d + self.sd <= 1:
            cols.append(np.arange(1.0, n + 1))
        return np.array([self.difference(c) for c in cols]) if cols else np.zeros((0, n))

    def constants(self) -> int:
        """Free constants of the differenced model without a trend left in it."""
        differences = self.d + self.sd
        return int((differences == 0 and self.mean) or (differences == 1 and self.drift))

    def difference(self, x: np.ndarray) -> np.ndarray:
        for _ in range(self.sd):
            x = x[self.m :] - x[: -self.m]
        return np.diff(x, self.d) if self.d else x


def _convolve(rows: np.ndarray, g: np.ndarray) -> np.ndarray:
    n = rows.shape[-1]
    size = 1 << int(2 * n - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(rows, size) * np.fft.rfft(g, size), size)[..., :n]


def _reciprocal(coefs: np.ndarray, n: int) -> list[float]:
    """Power series of 1/(1 + c_1 z + ...), cut where its terms have died out."""
    back = [-float(c) for c in coefs][::-1]
    k = len(back)
    g = [0.0] * (k - 1) + [1.0]
    while back and len(g) < n + k - 1:
        for _ in range(32):
            g.append(sum(map(mul, back, g[-k:])))
        if max(map(abs, g[-k:])) < 1e-20:
            break
    return g[max(k - 1, 0) :][:n]


def _error_filter(ma: np.ndarray, sma: np.ndarray, m: int, n: int) -> np.ndarray:
    """First n coefficients of 1/(theta(B) Theta(B^m))."""
    short = np.array(_reciprocal(ma, n))
    out = np.zeros(n)
    for j, c in enumerate(_reciprocal(sma, -(-n // m))):
        part = short[: n - j * m]
        out[j * m : j * m + len(part)] += c * part
    return out


def _poly(coefs: np.ndarray, stride: int, sign: float) -> np.ndarray:
    out = np.zeros(len(coefs) * stride + 1)
    out[0] = 1
    out[stride::stride] = sign * coefs
    return out


def _shift(x: np.ndarray, k: int) -> np.ndarray:
    return np.concatenate([np.zeros(k), x[: len(x) - k]])


def inverse_root(coefs: np.ndarray, sign: float) -> float:
    """Largest modulus of the inverse roots of 1 + sign*(c_1 z + ...); below 1 is stable."""
    return float(np.abs(np.roots(np.r_[1, sign * coefs])).max()) if np.any(coefs) else 0.0


class CssProblem:
    """Residuals and their derivatives as functions of [ar, sar, ma, sma, regression] parameters."""

    def __init__(self, y: np.ndarray, order: Order):
        self._hold(order, order.difference(y), order.regressors(len(y)))

    @classmethod
    def of_differenced(cls, w: np.ndarray, order: Order) -> CssProblem:
        """The same problem for a stretch of an already differenced series, whose only regressor can
        be a constant."""
        made = cls.__new__(cls)
        made._hold(order, w, np.full((order.constants(), len(w)), float(order.m if order.sd else 1)))
        return made

    def _hold(self, order: Order, w: np.ndarray, x: np.ndarray) -> None:
        self.o, self.w, self.x = order, w, x
        self.cuts = np.cumsum([order.p, order.sp, order.q, order.sq])
        self.start = order.p + order.m * order.sp
        self.free = int(self.cuts[-1]) + len(self.x)
        self.n_star = len(self.w)

    def split(self, theta: np.ndarray) -> list[np.ndarray]:
        return np.split(theta, self.cuts)

    def evaluate(self, theta: np.ndarray, jacobian: bool = True):
        o, (ar, sar, ma, sma, beta) = self.o, self.split(theta)
        v = self.w - beta @ self.x if len(beta) else self.w
        phi, sphi, th, sth = _poly(ar, 1, -1), _poly(sar, o.m, -1), _poly(ma, 1, 1), _poly(sma, o.m, 1)
        full = np.convolve(phi, sphi)
        n, cut = len(v), slice(self.start, len(v))
        g = _error_filter(ma, sma, o.m, n - self.start)
        filtered = lambda poly, s: np.convolve(s, poly)[:n]
        e = _convolve(filtered(full, v)[cut], g)
        if not jacobian:
            return e, None
        sv, nv = filtered(sphi, v), filtered(phi, v)
        parts = [-_shift(sv, i)[cut] for i in range(1, o.p + 1)]
        parts += [-_shift(nv, j * o.m)[cut] for j in range(1, o.sp + 1)]
        se, ne = np.convolve(e, sth)[: len(e)], np.convolve(e, th)[: len(e)]
        parts += [-_shift(se, i) for i in range(1, o.q + 1)]
        parts += [-_shift(ne, j * o.m) for j in range(1, o.sq + 1)]
        parts += [-filtered(full, c)[cut] for c in self.x]
        return e, _convolve(np.array(parts), g) if parts else np.zeros((0, len(e)))

    def stable(self, theta: np.ndarray, limit: float = 1.0) -> bool:
        ar, sar, ma, sma, _ = self.split(theta)
        return all(inverse_root(c, s) < limit for c, s in ((ar, -1), (sar, -1), (ma, 1), (sma, 1)))

    def first_guess(self) -> tuple[np.ndarray, float]:
        """Two-stage regression: residuals of a long autoregression stand in for the errors."""
        o = self.o
        beta = np.linalg.lstsq(self.x.T, self.w, rcond=None)[0] if len(self.x) else np.zeros(0)
        v = self.w - beta @ self.x if len(beta) else self.w
        lags = [*range(1, o.p + 1)], [j * o.m for j in range(1, o.sp + 1)]
        errors = [*range(1, o.q + 1)], [j * o.m for j in range(1, o.sq + 1)]
        e, n = v, len(v)
        if o.q + o.sq:
            long = min(max(10, o.p + o.q + 2, o.m + 2 if o.sp + o.sq else 0), n // 3)
            design = np.array([_shift(v, i)[long:] for i in range(1, long + 1)]).T
            e = np.r_[np.zeros(long), v[long:] - design @ np.linalg.lstsq(design, v[long:], rcond=None)[0]]
        cols = [_shift(v, k) for k in lags[0] + lags[1]] + [_shift(e, k) for k in errors[0] + errors[1]]
        guess, cut = np.zeros(len(cols)), self.start
        residual = v[cut:]
        if cols:
            design = np.array(cols).T[cut:]
            guess = np.linalg.lstsq(design, residual, rcond=None)[0]
            residual = residual - design @ guess
        theta = np.r_[guess, beta]
        while not self.stable(theta, 0.98):
            theta[: self.cuts[-1]] *= 0.9
        return theta, float(residual @ residual)

    def aicc(self, sse: float) -> float:
        k = self.free + 1
        if self.n_star - k - 1 <= 0 or sse <= 0:
            return np.inf
        aic = self.n_star * np.log(sse / (self.n_star - self.start)) + 2 * k
        return float(aic + 2 * k * (k + 1) / (self.n_star - k - 1))

    def solve(self) -> tuple[np.ndarray, float, bool]:
        """Damped Gauss-Newton steps; a step is halved until it lowers the sum and stays stable."""
        theta, _ = self.first_guess()
        e, jac = self.evaluate(theta)
        sse, done = float(e @ e), self.free == 0
        for _ in range(ITERATIONS):
            if done:
                break
            step = np.linalg.lstsq(jac.T, -e, rcond=1e-10)[0]
            size = 1.0
            while size > 1e-6:
                trial = theta + size * step
                if self.stable(trial):
                    e2, _ = self.evaluate(trial, jacobian=False)
                    if float(e2 @ e2) < sse:
                        break
                size /= 2
            else:
                done = True
                break
            gain = sse - float(e2 @ e2)
            theta, done = trial, gain <= CONVERGED * sse
            e, jac = self.evaluate(theta)
            sse = float(e @ e)
        return theta, sse, done


def enough_rows(n: int, o: Order) -> bool:
    free = o.p + o.q + o.sp + o.sq + 2
    return n - o.d - o.m * o.sd - o.p - o.m * o.sp > free + 2 and n > 3 * max(o.q, o.m * o.sq)


def fit_css(y: np.ndarray, order: Order) -> dict:
    """Coefficients, ``sigma2`` (error sum over differenced length - free parameters) and ``aicc``."""
    out = {"status": "too_short", "aicc": None, "sigma2": None}
    if not enough_rows(len(y), order):
        return out
    scale = np.abs(y).max() or 1.0
    problem = CssProblem(y / scale, order)
    if np.ptp(problem.w) <= 1e-12:
        return out | {"status": "degenerate"}
    theta, sse, done = problem.solve()
    ar, sar, ma, sma, beta = problem.split(theta)
    beta = (beta * scale).tolist()
    has_mean = order.mean and order.d + order.sd == 0
    sigma2 = sse / (problem.n_star - problem.free) * scale**2
    if not (np.all(np.isfinite(theta)) and sigma2 > 0):
        return out | {"status": "degenerate"}
    return {
        "ar": ar.tolist(), "ma": ma.tolist(), "sar": sar.tolist(), "sma": sma.tolist(),
        "mean": beta.pop(0) if has_mean else None,
        "drift": beta.pop(0) if beta else None,
        "sigma2": sigma2,
        "aicc": problem.aicc(sse * scale**2) if problem.stable(theta, 1 / MIN_ROOT) else np.inf,
        "status": "ok" if done else "no_convergence",
    }


def approximate_aicc(y: np.ndarray, order: Order) -> float:
    """Criterion of the two-stage regression, to rank candidates without iterating."""
    if not enough_rows(len(y), order):
        return np.inf
    problem = CssProblem(y / (np.abs(y).max() or 1.0), order)
    return problem.aicc(problem.first_guess()[1]) if np.ptp(problem.w) > 1e-12 else np.inf


def kpss_level(y: np.ndarray) -> float:
    """Level-stationarity statistic with a Bartlett window of 3 sqrt(n)/13 lags."""
    n = len(y)
    e = y - y.mean()
    lags = int(3 * np.sqrt(n) / 13)
    s2 = e @ e + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))
    return float(np.sum(np.cumsum(e) ** 2) / (n * s2)) if s2 > 0 else 0.0


def seasonal_strength(y: np.ndarray, m: int) -> float:
    """Share of the detrended variation that a fixed seasonal pattern explains."""
    if m < 2 or len(y) < 2 * m + 1:
        return 0.0
    weights = np.ones(m) / m if m % 2 else np.r_[0.5, np.ones(m - 1), 0.5] / m
    half = len(weights) // 2
    detrended = y[half : len(y) - half] - np.convolve(y, weights, mode="valid")
    phase = np.arange(len(detrended)) % m
    means = np.bincount(phase, detrended, m) / np.maximum(np.bincount(phase, minlength=m), 1)
    total = np.var(detrended)
    return max(0.0, 1 - np.var(detrended - means[phase]) / total) if total > 0 else 0.0


def difference_orders(y: np.ndarray, m: int, max_d: int, max_sd: int) -> tuple[int, int]:
    """Seasonal differences by seasonal strength, then plain ones by the stationarity test."""
    sd = d = 0
    while sd < max_sd and seasonal_strength(y, m) > SEASONAL_STRENGTH:
        y, sd = y[m:] - y[:-m], sd + 1
    while d < max_d and len(y) > 10 and np.ptp(y) > 0 and kpss_level(y) > KPSS_5PCT:
        y, d = np.diff(y), d + 1
    return d, sd
