"""Seeded series and slow, obvious versions of the computations under test."""

import datetime as dt

import numpy as np

START = dt.datetime(2020, 1, 1)


def simulate(n, ar=(), ma=(), sar=(), sma=(), m=1, mean=0.0, seed=42, burn=500):
    """ARMA values by the defining recursion."""
    e = np.random.default_rng(seed).normal(size=n + burn)
    a = np.convolve(np.r_[1, -np.array(ar)], season(-np.array(sar), m))
    b = np.convolve(np.r_[1, np.array(ma)], season(np.array(sma), m))
    y = np.zeros(n + burn)
    for t in range(n + burn):
        y[t] = sum(b[j] * e[t - j] for j in range(min(t + 1, len(b))))
        y[t] -= sum(a[j] * y[t - j] for j in range(1, min(t + 1, len(a))))
    return y[burn:] + mean


def season(coefs, m):
    out = np.zeros(len(coefs) * m + 1)
    out[0] = 1
    out[m::m] = coefs
    return out


def series_frame(spark, values, series_id="s", step_seconds=3600):
    rows = [
        (series_id, START + dt.timedelta(seconds=step_seconds * i), None if v is None else float(v))
        for i, v in enumerate(values)
    ]
    return spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, y double")


def series_frames(spark, named):
    out = None
    for name, values in named.items():
        part = series_frame(spark, values, name)
        out = part if out is None else out.unionByName(part)
    return out


def pi_loop(a, b, tol):
    r = [1.0]
    for j in range(1, tol + 1):
        value = a[j] if j < len(a) else 0.0
        value -= sum(b[i] * r[j - i] for i in range(1, min(len(b) - 1, j) + 1))
        r.append(value)
    return [-x for x in r[1:]]


def forecast_loop(y, coef, h):
    p = len(coef) - 2
    out = list(y)
    n = len(y)
    for i in range(1, h + 1):
        out.append(coef[0] + coef[1] * (n + i) + sum(coef[2 + k] * out[-1 - k] for k in range(p)))
    return out[n:]


def psi_loop(pi, h):
    psi = [1.0]
    for j in range(1, h):
        psi.append(sum(pi[i] * psi[j - 1 - i] for i in range(min(len(pi), j))))
    return psi


def ols(y, p, trend=False):
    rows = range(p, len(y))
    x = np.array([[1.0] + ([t + 1.0] if trend else []) + [y[t - i] for i in range(1, p + 1)] for t in rows])
    target = np.array([y[t] for t in rows])
    beta = np.linalg.lstsq(x, target, rcond=None)[0]
    return beta, float(np.sum((target - x @ beta) ** 2))
