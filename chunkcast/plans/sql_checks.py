"""SQL twins of the catalogue queries, for an engine that sees the same Parquet tables as views.

They are written from the definitions (window functions over whole series, regression aggregates,
recursive common table expressions), not from the Spark plans.
"""

from __future__ import annotations

from statistics import NormalDist

from chunkcast.plans.catalogue import CHUNKS, CSS_POINT, HORIZON, LAGS_LONG, SEASON, SEASON_LAGS, STATUS_STEPS, STEPS_LONG, TOL, TOL_LONG


def _z(level: float) -> str:
    return repr(NormalDist().inv_cdf(0.5 * (1 + level / 100)))


def _series(table: str, ts: str, value: str, unit: str, key: str = "'all'", scale: str = "") -> str:
    return f"""series AS (
  SELECT CAST({key} AS VARCHAR) AS series_id, date_trunc('{unit}', {ts}) AS ts,
         CAST(sum(CAST({value} AS DECIMAL(18,2))) AS DOUBLE){scale} AS y
  FROM {table} GROUP BY 1, 2)"""


EVENTS = _series("events", "ts", "value", "hour", "event_type")
EVENTS_ALL = _series("events", "ts", "value", "hour")
ORDERS = _series("orders", "o_orderdate", "o_totalprice", "day", scale=" / 1e6")
ORDERS_PRIORITY = _series("orders", "o_orderdate", "o_totalprice", "day", "o_orderpriority")
ORDERS_PRIORITY_M = _series("orders", "o_orderdate", "o_totalprice", "day", "o_orderpriority", " / 1e6")
CUSTOMERS = _series("orders", "o_orderdate", "o_totalprice", "day", "o_custkey", " / 1e6")
SHIPMENTS = _series("lineitem", "l_shipdate", "l_extendedprice", "day", scale=" / 1e6")

# all observations with their position
INDEXED = """indexed AS (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS idx,
         count(*) OVER (PARTITION BY series_id) AS n FROM series)"""

# the same, and the last rows split off
SPLIT = f"""everything AS (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS idx,
         count(*) OVER (PARTITION BY series_id) - {HORIZON} AS n FROM series),
indexed AS (SELECT * FROM everything WHERE idx <= n),
holdout AS (SELECT series_id, idx - n AS step, ts, y FROM everything WHERE idx > n)"""


def _chunked(k: int) -> str:
    return f"""sized AS (SELECT *, greatest(n // {k}, 1) AS chunk_size FROM indexed),
chunked AS (
  SELECT *, CAST(least((idx + chunk_size - 1) // chunk_size, {k}) AS INTEGER) AS chunk,
         idx - (CAST(least((idx + chunk_size - 1) // chunk_size, {k}) AS BIGINT) - 1) * chunk_size AS pos
  FROM sized),
lagged AS (
  SELECT *, lag(y, 1) OVER w AS l1, lag(y, 2) OVER w AS l2 FROM chunked
  WINDOW w AS (PARTITION BY series_id, chunk ORDER BY idx))"""


# one-lag model per chunk; the residual variance comes from a second pass over the rows
AR1 = """slopes AS (
  SELECT series_id, chunk, count(*) AS n_k, count(l1) AS n_eff, min(idx) AS start,
         regr_slope(y, l1) AS pi1, regr_intercept(y, l1) AS c0,
         avg(l1) AS ml, avg(l1 * l1) AS mll
  FROM lagged GROUP BY 1, 2),
models AS (
  SELECT s.series_id, s.chunk, any_value(s.n_k) AS n_k, any_value(s.n_eff) AS n_eff,
         any_value(s.c0) AS c0, any_value(s.pi1) AS pi1, any_value(s.ml) AS ml, any_value(s.mll) AS mll,
         sum(power(y - s.c0 - s.pi1 * l1, 2)) / (any_value(s.n_k) - 2) AS sigma2
  FROM lagged r JOIN slopes s USING (series_id, chunk) WHERE l1 IS NOT NULL GROUP BY 1, 2)"""

# two-lag model per chunk by Cramer's rule on centred sums
AR2 = """centred AS (
  SELECT series_id, chunk, y, l1, l2,
         y - avg(y) OVER w AS dy, l1 - avg(l1) OVER w AS d1, l2 - avg(l2) OVER w AS d2
  FROM lagged WHERE l2 IS NOT NULL WINDOW w AS (PARTITION BY series_id, chunk)),
sums AS (
  SELECT series_id, chunk, avg(y) AS my, avg(l1) AS m1, avg(l2) AS m2,
         sum(d1 * d1) AS s11, sum(d1 * d2) AS s12, sum(d2 * d2) AS s22, sum(d1 * dy) AS s1y, sum(d2 * dy) AS s2y
  FROM centred GROUP BY 1, 2),
slopes AS (
  SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS pi1,
         (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS pi2 FROM sums),
counts AS (SELECT series_id, chunk, count(*) AS n_k FROM chunked GROUP BY 1, 2),
models AS (
  SELECT s.series_id, s.chunk, any_value(n_k) AS n_k, any_value(my - pi1 * m1 - pi2 * m2) AS c0,
         any_value(pi1) AS pi1, any_value(pi2) AS pi2,
         sum(power(r.dy - pi1 * r.d1 - pi2 * r.d2, 2)) / (any_value(n_k) - 3) AS sigma2
  FROM centred r JOIN slopes s USING (series_id, chunk) JOIN counts USING (series_id, chunk) GROUP BY 1, 2)"""

GLOBAL2 = """model AS (
  SELECT series_id, sum(n_k / sigma2 * c0) / sum(n_k / sigma2) AS c0,
         sum(n_k / sigma2 * pi1) / sum(n_k / sigma2) AS pi1,
         sum(n_k / sigma2 * pi2) / sum(n_k / sigma2) AS pi2,
         sum(n_k) / sum(n_k / sigma2) AS sigma2
  FROM models GROUP BY 1)"""

GLOBAL1 = """model AS (
  SELECT series_id, sum(n_k / sigma2 * c0) / sum(n_k / sigma2) AS c0,
         sum(n_k / sigma2 * pi1) / sum(n_k / sigma2) AS pi1, CAST(0 AS DOUBLE) AS pi2,
         sum(n_k) / sum(n_k / sigma2) AS sigma2
  FROM models GROUP BY 1)"""


def _steps(h: int, unit: str) -> str:
    """Recursive forecasts with their psi weights; psi starts 1, pi1."""
    return f"""tail AS (
  SELECT i.series_id, max(ts) AS last_ts, max_by(y, idx) AS y1, max_by(y, idx) FILTER (WHERE idx < n) AS y2
  FROM indexed i GROUP BY 1),
walk AS (
  SELECT series_id, 1 AS step, last_ts, c0 + pi1 * y1 + pi2 * y2 AS pred, y1 AS before,
         CAST(1 AS DOUBLE) AS psi, CAST(0 AS DOUBLE) AS psi_before, CAST(1 AS DOUBLE) AS vars, c0, pi1, pi2, sigma2
  FROM tail JOIN model USING (series_id)
  UNION ALL
  SELECT series_id, step + 1, last_ts, c0 + pi1 * pred + pi2 * before, pred,
         pi1 * psi + pi2 * psi_before, psi, vars + power(pi1 * psi + pi2 * psi_before, 2), c0, pi1, pi2, sigma2
  FROM walk WHERE step < {h}),
steps AS (
  SELECT series_id, step, last_ts + step * INTERVAL 1 {unit} AS ts, pred, psi, sqrt(sigma2 * vars) AS se FROM walk)"""


def _intervals(levels: list[float]) -> str:
    values = ", ".join(f"(CAST({x} AS DOUBLE), CAST({_z(x)} AS DOUBLE))" for x in levels)
    return f"""levels(level, z) AS (VALUES {values}),
intervals AS (
  SELECT s.*, level, pred - z * se AS lower, pred + z * se AS upper FROM steps s CROSS JOIN levels)"""


def _scale(m: int) -> str:
    return f"""scales AS (
  SELECT a.series_id, avg(abs(a.y - b.y)) AS scale
  FROM indexed a JOIN indexed b ON a.series_id = b.series_id AND b.idx = a.idx - {m} GROUP BY 1)"""


SCORES = """scores AS (
  SELECT i.series_id, i.step, t.ts, level, t.y, pred, lower, upper,
         abs(t.y - pred) / nullif(scale, 0) AS mase,
         abs(t.y - pred) * 200 / nullif(abs(t.y) + abs(pred), 0) AS smape,
         (upper - lower + 2 / ((100 - level) / 100) * greatest(lower - t.y, 0)
                        + 2 / ((100 - level) / 100) * greatest(t.y - upper, 0)) / nullif(scale, 0) AS msis
  FROM intervals i JOIN holdout t USING (series_id, step) JOIN scales USING (series_id))"""

EVENT_MODEL = [EVENTS, SPLIT, _chunked(CHUNKS), AR2, GLOBAL2]
EVENT_STEPS = [*EVENT_MODEL, _steps(HORIZON, "HOUR")]

# seasonal models from moments, and their lag polynomials as (lag, coefficient) rows
MOMENTS = f"""seasonal AS (
  SELECT *, lag(y, 1) OVER w AS z1, lag(y, 2) OVER w AS z2, lag(y, {SEASON}) OVER w AS zs FROM chunked
  WINDOW w AS (PARTITION BY series_id, chunk ORDER BY idx)),
moments AS (
  SELECT series_id, chunk, regr_slope(y, z1) AS a, regr_slope(y, zs) AS s, corr(y - z1, z1 - z2) / 2 AS b,
         avg(y) AS mean, avg(y - z1) AS drift FROM seasonal GROUP BY 1, 2),
factors AS (
  SELECT series_id, chunk, 1 AS f, 0 AS lag, CAST(1 AS DOUBLE) AS c FROM moments
  UNION ALL SELECT series_id, chunk, 1, 1, -a FROM moments
  UNION ALL SELECT series_id, chunk, 2, 0, 1 FROM moments
  UNION ALL SELECT series_id, chunk, 2, 1, -1 FROM moments WHERE chunk = 2
  UNION ALL SELECT series_id, chunk, 3, 0, 1 FROM moments
  UNION ALL SELECT series_id, chunk, 3, {SEASON}, -s FROM moments
  UNION ALL SELECT series_id, chunk, 4, 0, 1 FROM moments
  UNION ALL SELECT series_id, chunk, 4, {SEASON}, -1 FROM moments WHERE chunk = 1
  UNION ALL SELECT series_id, chunk, 5, 0, 1 FROM moments
  UNION ALL SELECT series_id, chunk, 5, 1, b FROM moments
  UNION ALL SELECT series_id, chunk, 6, 0, 1 FROM moments
  UNION ALL SELECT series_id, chunk, 6, {SEASON}, b / 2 FROM moments),
ar_terms AS (
  SELECT series_id, chunk, p.lag + q.lag + r.lag + t.lag AS lag, sum(p.c * q.c * r.c * t.c) AS coef
  FROM factors p JOIN factors q USING (series_id, chunk) JOIN factors r USING (series_id, chunk)
  JOIN factors t USING (series_id, chunk)
  WHERE p.f = 1 AND q.f = 2 AND r.f = 3 AND t.f = 4 GROUP BY 1, 2, 3),
ma_terms AS (
  SELECT series_id, chunk, p.lag + q.lag AS lag, sum(p.c * q.c) AS coef
  FROM factors p JOIN factors q USING (series_id, chunk) WHERE p.f = 5 AND q.f = 6 GROUP BY 1, 2, 3)"""

def _weights(tol: int) -> str:
    """The weights as one growing list per model."""
    return f"""grid AS (
  SELECT series_id, chunk, lag, coalesce(x.coef, 0) AS a, coalesce(y.coef, 0) AS b
  FROM moments CROSS JOIN (SELECT unnest(range(0, {tol} + 1)) AS lag) l
  LEFT JOIN ar_terms x USING (series_id, chunk, lag) LEFT JOIN ma_terms y USING (series_id, chunk, lag)),
lists AS (
  SELECT series_id, chunk, list(a ORDER BY lag) AS a, list(b ORDER BY lag) AS b FROM grid GROUP BY 1, 2),
expansion AS (
  SELECT series_id, chunk, 1 AS j, [CAST(1 AS DOUBLE)] AS r, a, b FROM lists
  UNION ALL
  SELECT series_id, chunk, j + 1,
         list_append(r, a[j + 1] - list_sum(list_transform(range(1, j + 1), lambda i: b[i + 1] * r[j + 1 - i]))), a, b
  FROM expansion WHERE j <= {tol}),
finished AS (SELECT series_id, chunk, r FROM expansion WHERE j = {tol} + 1),
weights AS (
  SELECT series_id, chunk, lag, -r[lag + 1] AS weight
  FROM finished CROSS JOIN (SELECT unnest(range(1, {tol} + 1)) AS lag) l)"""


WEIGHTS = _weights(TOL)

MODELS_FROM_MOMENTS = [EVENTS, INDEXED, _chunked(2), MOMENTS]


def _query(ctes: list[str], select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)}\n{select}"


def _kpss(name: str, values: str) -> str:
    """Level-stationarity statistic of each chunk of ``values`` (series_id, chunk, t, y), lag by lag."""
    return f"""{name}_e AS (
  SELECT series_id, chunk, t, y - avg(y) OVER c AS e, count(*) OVER c AS n, max(y) OVER c - min(y) OVER c AS spread
  FROM {values} WINDOW c AS (PARTITION BY series_id, chunk)),
{name}_c AS (
  SELECT *, sum(e) OVER (PARTITION BY series_id, chunk ORDER BY t) AS c, CAST(floor(3 * sqrt(n) / 13) AS BIGINT) AS lags
  FROM {name}_e WHERE n > 10 AND spread > 0),
{name}_lags AS (
  SELECT a.series_id, a.chunk, sum((1 - (a.t - b.t) / (a.lags + 1)) * a.e * b.e) AS s
  FROM {name}_c a JOIN {name}_c b ON a.series_id = b.series_id AND a.chunk = b.chunk AND b.t < a.t AND b.t >= a.t - a.lags
  GROUP BY 1, 2),
{name} AS (
  SELECT series_id, chunk, sum(c * c) / (max(n) * (sum(e * e) + 2 * coalesce(max(s), 0))) > 0.463 AS wanders
  FROM {name}_c LEFT JOIN {name}_lags USING (series_id, chunk) GROUP BY 1, 2)"""


def _differences(m: int) -> list[str]:
    """d and sd of every chunk: at most one seasonal and two plain differences."""
    half, cut = m // 2, (m + 1 - m % 2) // 2
    ends = "" if m % 2 else f" - 0.5 * (lag(y, {half}) OVER c + lead(y, {half}) OVER c)"
    levels = []
    for d, source in ((0, "seasoned"), (1, "once")):
        levels.append(_kpss(f"kpss{d}", source))
        if d == 0:
            levels.append("""once AS (
  SELECT series_id, chunk, t - 1 AS t, y - x AS y
  FROM (SELECT *, lag(y) OVER (PARTITION BY series_id, chunk ORDER BY t) AS x FROM seasoned JOIN kpss0 USING (series_id, chunk) WHERE wanders)
  WHERE x IS NOT NULL)""")
    return [
        f"""smooth AS (
  SELECT series_id, chunk, pos, y - (sum(y) OVER (c ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING){ends}) / {m} AS x,
         count(*) OVER (PARTITION BY series_id, chunk) AS n
  FROM chunked WINDOW c AS (PARTITION BY series_id, chunk ORDER BY pos)),
phased AS (
  SELECT series_id, chunk, x, x - avg(x) OVER (PARTITION BY series_id, chunk, (pos - {cut} - 1) % {m}) AS rest
  FROM smooth WHERE n > {2 * m} AND pos > {cut} AND pos <= n - {cut}),
seasons AS (
  SELECT series_id, chunk, var_pop(x) > 0 AND 1 - var_pop(rest) / var_pop(x) > 0.64 AS seasonal FROM phased GROUP BY 1, 2),
judged AS (
  SELECT series_id, chunk, pos, y, lag(y, {m}) OVER (PARTITION BY series_id, chunk ORDER BY pos) AS x, coalesce(seasonal, false) AS seasonal
  FROM chunked LEFT JOIN seasons USING (series_id, chunk)),
seasoned AS (
  SELECT series_id, chunk, CASE WHEN seasonal THEN pos - {m} ELSE pos END AS t, CASE WHEN seasonal THEN y - x ELSE y END AS y
  FROM judged WHERE NOT seasonal OR x IS NOT NULL)""",
        *levels,
    ]


_DIFF_SELECT = """SELECT j.series_id, j.chunk, {extra}
  CASE WHEN coalesce(a.wanders, false) THEN CASE WHEN coalesce(b.wanders, false) THEN 2 ELSE 1 END ELSE 0 END AS d,
  CASE WHEN any_value(seasonal) THEN 1 ELSE 0 END AS sd
FROM judged j LEFT JOIN kpss0 a USING (series_id, chunk) LEFT JOIN kpss1 b USING (series_id, chunk)
GROUP BY j.series_id, j.chunk, a.wanders, b.wanders"""

def _ar_grid(m: int) -> list[str]:
    """Least squares of the autoregressions of order 0, 1 and 2, with and without a constant, on the differenced values."""
    sums = ", ".join(
        f"sum({a} * {b}) FILTER (WHERE l{p} IS NOT NULL) - k * sum({a}) FILTER (WHERE l{p} IS NOT NULL) * sum({b}) FILTER (WHERE l{p} IS NOT NULL) / count(l{p}) AS {name}{p}"
        for p in (0, 1, 2)
        for name, a, b in (("yy", "l0", "l0"), ("y1", "l0", "l1"), ("y2", "l0", "l2"), ("aa", "l1", "l1"), ("ab", "l1", "l2"), ("bb", "l2", "l2"))
        if max(int(a[1]), int(b[1])) <= p
    )
    means = ", ".join(f"avg(l{j}) FILTER (WHERE l{p} IS NOT NULL) AS m{j}{p}" for p in (0, 1, 2) for j in range(p + 1))
    det = "(aa2 * bb2 - ab2 * ab2)"
    one, two = f"((y12 * bb2 - y22 * ab2) / {det})", f"((y22 * aa2 - y12 * ab2) / {det})"
    return [
        """twice AS (
  SELECT series_id, chunk, t - 1 AS t, y - x AS y
  FROM (SELECT *, lag(y) OVER (PARTITION BY series_id, chunk ORDER BY t) AS x FROM once JOIN kpss1 USING (series_id, chunk) WHERE wanders)
  WHERE x IS NOT NULL),
stationary AS (
  SELECT series_id, chunk, t, y, 0 AS d FROM seasoned LEFT JOIN kpss0 USING (series_id, chunk) WHERE NOT coalesce(wanders, false)
  UNION ALL SELECT series_id, chunk, t, y, 1 FROM once LEFT JOIN kpss1 USING (series_id, chunk) WHERE NOT coalesce(wanders, false)
  UNION ALL SELECT series_id, chunk, t, y, 2 FROM twice),
kinds AS (SELECT series_id, chunk, count(*) AS n_k, CASE WHEN any_value(seasonal) THEN 1 ELSE 0 END AS sd FROM judged GROUP BY 1, 2),
back AS (
  SELECT series_id, chunk, d, y AS l0, lag(y, 1) OVER c AS l1, lag(y, 2) OVER c AS l2
  FROM stationary WINDOW c AS (PARTITION BY series_id, chunk ORDER BY t))""",
        f"""moments AS (
  SELECT series_id, chunk, any_value(d) AS d, k, count(*) AS n, {sums}, {means}
  FROM back CROSS JOIN (SELECT unnest([0, 1]) AS k) c GROUP BY series_id, chunk, k)""",
        f"""grid AS (
  SELECT series_id, chunk, d, k, n, 0 AS p, NULL AS pi1, NULL AS pi2, yy0 AS sse, m00 AS level FROM moments
  UNION ALL SELECT series_id, chunk, d, k, n, 1, y11 / aa1, NULL, yy1 - y11 * y11 / aa1, (m01 - y11 / aa1 * m11) / (1 - y11 / aa1) FROM moments
  UNION ALL SELECT series_id, chunk, d, k, n, 2, {one}, {two}, yy2 - {one} * y12 - {two} * y22,
    (m02 - {one} * m12 - {two} * m22) / (1 - {one} - {two}) FROM moments),
judged_grid AS (
  SELECT *, p + k AS free, n * ln(sse / (n - p)) + 2 * (p + k + 1) + 2 * (p + k + 1) * (p + k + 2) / (n - (p + k + 1) - 1) AS aicc
  FROM grid JOIN kinds USING (series_id, chunk) WHERE k = 0 OR d + sd <= 1),
chosen_order AS (SELECT * FROM judged_grid QUALIFY row_number() OVER (PARTITION BY series_id, chunk ORDER BY aicc, p) = 1)""",
    ]


TS = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS ts"


def _r(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)


def _three_lags(a: int, b: int, c: int) -> str:
    """Least squares on a constant and three lags per chunk, by Cramer's rule on centred sums."""
    return f""", more AS (
  SELECT series_id, chunk, y, lag(y, {a}) OVER w AS x1, lag(y, {b}) OVER w AS x2, lag(y, {c}) OVER w AS x3 FROM chunked
  WINDOW w AS (PARTITION BY series_id, chunk ORDER BY idx)),
centred AS (
  SELECT series_id, chunk, y, x1, x2, x3, y - avg(y) OVER w AS dy, x1 - avg(x1) OVER w AS d1,
         x2 - avg(x2) OVER w AS d2, x3 - avg(x3) OVER w AS d3
  FROM more WHERE x3 IS NOT NULL WINDOW w AS (PARTITION BY series_id, chunk)),
sums AS (
  SELECT series_id, chunk, count(*) AS n_eff, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3,
         sum(d1 * d1) AS a, sum(d1 * d2) AS b, sum(d1 * d3) AS c, sum(d2 * d2) AS d, sum(d2 * d3) AS e, sum(d3 * d3) AS f,
         sum(d1 * dy) AS u, sum(d2 * dy) AS v, sum(d3 * dy) AS w FROM centred GROUP BY 1, 2),
dets AS (SELECT *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) AS det FROM sums),
slopes AS (
  SELECT *, (u * (d * f - e * e) - b * (v * f - e * w) + c * (v * e - d * w)) / det AS pi{a},
         (a * (v * f - e * w) - u * (b * f - e * c) + c * (b * w - v * c)) / det AS pi{b},
         (a * (d * w - v * e) - b * (b * w - v * c) + u * (b * e - d * c)) / det AS pi{c} FROM dets),
counts AS (SELECT series_id, chunk, count(*) AS n_k FROM chunked GROUP BY 1, 2),
models AS (
  SELECT s.series_id, s.chunk, any_value(n_k) AS n_k, any_value(n_eff) AS n_eff, any_value(my - pi{a} * m1 - pi{b} * m2 - pi{c} * m3) AS c0,
         any_value(pi{a}) AS pi{a}, any_value(pi{b}) AS pi{b}, any_value(pi{c}) AS pi{c},
         sum(power(r.dy - pi{a} * r.d1 - pi{b} * r.d2 - pi{c} * r.d3, 2)) / (any_value(n_k) - 4) AS sigma2
  FROM centred r JOIN slopes s USING (series_id, chunk) JOIN counts USING (series_id, chunk) GROUP BY 1, 2)
"""


ORACLES = {
    "hourly_series": _query([EVENTS], f"SELECT series_id, {TS.format('ts')}, y FROM series"),
    "hourly_total": _query([EVENTS_ALL], f"SELECT series_id, {TS.format('ts')}, y FROM series"),
    "daily_orders_series": _query([ORDERS_PRIORITY], f"SELECT series_id, {TS.format('ts')}, y FROM series"),
    "daily_shipments_series": _query(
        [_series("lineitem", "l_shipdate", "l_extendedprice", "day")],
        f"SELECT series_id, {TS.format('ts')}, y FROM series",
    ),
    "series_sizes": _query([ORDERS_PRIORITY], "SELECT series_id, count(*) AS n FROM series GROUP BY 1"),
    "row_index": _query([SHIPMENTS, INDEXED], f"SELECT series_id, {TS.format('ts')}, idx, n FROM indexed"),
    "row_index_ranged": _query(
        [ORDERS_PRIORITY, INDEXED], f"SELECT series_id, {TS.format('ts')}, idx, n FROM indexed"
    ),
    "gap_fill": _query(
        [EVENTS],
        f"""SELECT g.series_id, {TS.format('g.ts')}, s.y FROM (
  SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM series GROUP BY 1) g
LEFT JOIN series s ON s.series_id = g.series_id AND s.ts = g.ts""",
    ),
    "gap_fill_index": _query(
        [EVENTS],
        f""", filled AS (SELECT g.series_id, g.ts, s.y FROM (
  SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM series GROUP BY 1) g
LEFT JOIN series s ON s.series_id = g.series_id AND s.ts = g.ts)
SELECT series_id, {TS.format('ts')}, y, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS idx,
  count(*) OVER (PARTITION BY series_id) AS n FROM filled""",
    ),
    "csv_round_trip": f"""SELECT 'orders' AS series_id, {TS.format('o_orderdate')}, o_totalprice AS y FROM orders
WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')""",
    "zone_export": _query(
        [EVENTS, SPLIT],
        f"""SELECT series_id, 'train' AS split, {TS.format('ts')}, y FROM indexed
UNION ALL SELECT series_id, 'test', {TS.format('ts')}, y FROM holdout""",
    ),
    "coefficients_csv": _query(
        [EVENTS, INDEXED, _chunked(CHUNKS), AR2, GLOBAL2],
        """SELECT series_id, pos, round(theta, 6) + 0.0 AS theta, round(sigma2, 6) AS sigma2 FROM (
  SELECT series_id, 0 AS pos, c0 AS theta, sigma2 FROM model UNION ALL SELECT series_id, 1, 0, sigma2 FROM model
  UNION ALL SELECT series_id, 2, pi1, sigma2 FROM model UNION ALL SELECT series_id, 3, pi2, sigma2 FROM model)""",
    ),
    "forecast_csv": _query(
        [*EVENT_STEPS, _intervals([95])],
        f"SELECT series_id, step, {TS.format('ts')}, {_r('pred', 'lower', 'upper')} FROM intervals",
        recursive=True,
    ),
    "chunk_assign": _query(
        [EVENTS, INDEXED, _chunked(7)], "SELECT series_id, idx, chunk, chunk_size, pos FROM chunked"
    ),
    "chunk_counts": _query(
        [ORDERS, INDEXED, _chunked(16)], "SELECT series_id, chunk, count(*) AS n_k FROM chunked GROUP BY 1, 2"
    ),
    "chunk_counts_short": _query(
        [CUSTOMERS, INDEXED],
        "SELECT series_id, CAST(idx AS INTEGER) AS chunk, count(*) AS n_k FROM indexed GROUP BY 1, 2",
    ),
    "split_holdout": _query(
        [EVENTS, INDEXED],
        f"""SELECT series_id, idx, {TS.format('ts')}, y, CASE WHEN idx > n - {HORIZON} THEN 'test' ELSE 'train' END AS split,
  CASE WHEN idx > n - {HORIZON} THEN idx - n + {HORIZON} END AS step, n - {HORIZON} AS n FROM indexed""",
    ),
    "ar1_local": _query(
        [EVENTS, INDEXED, _chunked(CHUNKS), AR1],
        f"SELECT series_id, chunk, n_k, {_r('sigma2', 'c0', 'pi1')} FROM models",
    ),
    "ar2_local": _query(
        [ORDERS, INDEXED, _chunked(CHUNKS), AR2],
        f"SELECT series_id, chunk, n_k, {_r('sigma2', 'c0', 'pi1', 'pi2')} FROM models",
    ),
    "ar3_local": _query(
        [SHIPMENTS, INDEXED, _chunked(CHUNKS)],
        _three_lags(1, 2, 3) + "SELECT series_id, chunk, n_k, "
        + _r("sigma2", "c0", "pi1", "pi2", "pi3")
        + " FROM models",
    ),
    "ar_season24_local": _query(
        [EVENTS, INDEXED, _chunked(CHUNKS)],
        _three_lags(*SEASON_LAGS)
        + "SELECT series_id, chunk, n_k, n_eff, 'ok' AS status, "
        + _r("sigma2", "c0", *(f"pi{i}" for i in SEASON_LAGS))
        + " FROM models",
    ),
    "ar1_local_gaps": _query(
        [
            EVENTS.replace("series AS", "present AS", 1),
            """hours AS (
  SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM present GROUP BY 1),
series AS (SELECT h.series_id, h.ts, p.y FROM hours h LEFT JOIN present p ON p.series_id = h.series_id AND p.ts = h.ts)""",
            INDEXED, _chunked(CHUNKS),
        ],
        """, slopes AS (
  SELECT series_id, chunk, count(y) AS n_k, regr_count(y, l1) AS n_eff, regr_slope(y, l1) AS pi1, regr_intercept(y, l1) AS c0
  FROM lagged GROUP BY 1, 2),
models AS (
  SELECT series_id, chunk, any_value(n_k) AS n_k, any_value(n_eff) AS n_eff, any_value(c0) AS c0, any_value(pi1) AS pi1,
         sum(power(y - c0 - pi1 * l1, 2)) / (any_value(n_k) - 2) AS sigma2
  FROM lagged JOIN slopes USING (series_id, chunk) GROUP BY 1, 2)
SELECT series_id, chunk, n_k, n_eff, 'ok' AS status, """
        + _r("sigma2", "c0", "pi1")
        + " FROM models",
    ),
    "css_loss": _query(
        [
            ORDERS, INDEXED, _chunked(CHUNKS),
            f"""centred AS (
  SELECT series_id, chunk, list(v ORDER BY idx) AS v FROM (
    SELECT series_id, chunk, idx, y - avg(y) OVER (PARTITION BY series_id, chunk) AS v FROM chunked) GROUP BY 1, 2),
errors AS (
  SELECT series_id, chunk, v, 1 AS k, CAST([] AS DOUBLE[]) AS e FROM centred
  UNION ALL
  SELECT series_id, chunk, v, k + 1, list_append(e, v[k + 1] - {CSS_POINT[0]} * v[k]
    - {CSS_POINT[1]} * coalesce(e[k - 1], 0) * (k > 1)::INT
    - {CSS_POINT[2]} * (CASE WHEN k > {SEASON} THEN e[k - {SEASON}] ELSE 0 END)
    - {CSS_POINT[1] * CSS_POINT[2]} * (CASE WHEN k > {SEASON} + 1 THEN e[k - {SEASON} - 1] ELSE 0 END))
  FROM errors WHERE k < len(v))"""
        ],
        """SELECT series_id, chunk, CAST(len(e) AS BIGINT) AS n_errors,
  round(list_sum(list_transform(e, lambda x: x * x)), 4) AS sse FROM errors WHERE k = len(v)""",
        recursive=True,
    ),
    "ar1_trend_local": _query(
        [SHIPMENTS, INDEXED, _chunked(CHUNKS)],
        """, centred AS (
  SELECT series_id, chunk, chunk_size, y, l1, idx, y - avg(y) OVER w AS dy, l1 - avg(l1) OVER w AS d1, idx - avg(idx) OVER w AS dt
  FROM lagged WHERE l1 IS NOT NULL WINDOW w AS (PARTITION BY series_id, chunk)),
sums AS (
  SELECT series_id, chunk, any_value(chunk_size) AS size, avg(y) AS my, avg(l1) AS m1, avg(idx) AS mt,
         sum(dt * dt) AS s11, sum(d1 * dt) AS s12, sum(d1 * d1) AS s22, sum(dt * dy) AS s1y, sum(d1 * dy) AS s2y
  FROM centred GROUP BY 1, 2),
slopes AS (
  SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS c1,
         (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS pi1 FROM sums),
lines AS (SELECT *, my - c1 * mt - pi1 * m1 AS c0 FROM slopes)
SELECT series_id, chunk, (chunk - 1) * size + 1 AS start, """
        + _r("c0", "c1", "pi1")
        + " FROM lines",
    ),
    "local_weights": _query(
        [EVENTS, INDEXED, _chunked(CHUNKS), AR1],
        """SELECT series_id, chunk, round(n_k / sigma2, 6) AS w, round(n_k / sigma2 * c0, 6) AS wc0,
  round(n_k / sigma2 * pi1, 6) + 0.0 AS wpi1 FROM models""",
    ),
    "model_rows": _query(
        [CUSTOMERS, INDEXED, _chunked(2)],
        """, stats AS (
  SELECT series_id, chunk, count(*) AS n_k, count(l1) AS n_eff,
         count(DISTINCT l1) FILTER (WHERE l1 IS NOT NULL) AS spread
  FROM lagged GROUP BY 1, 2)
SELECT series_id, chunk, n_k, n_eff,
  CASE WHEN n_eff <= 2 THEN 'too_short' WHEN spread < 2 THEN 'singular' ELSE 'ok' END AS status FROM stats""",
    ),
    "model_status": _query(
        [CUSTOMERS, INDEXED, _chunked(2)],
        """, stats AS (
  SELECT series_id, chunk, count(l1) AS n_eff FROM lagged GROUP BY 1, 2)
SELECT series_id, count(*) AS chunks, count(*) FILTER (WHERE n_eff <= 2) AS failed,
  CASE WHEN max(n_eff) <= 2 THEN 'no_model' ELSE 'ok' END AS status FROM stats GROUP BY 1""",
    ),
    "order_search_ar": _query(
        [
            EVENTS, INDEXED, _chunked(CHUNKS),
            AR1.replace("slopes", "slopes1").replace("models", "models1"),
            AR2.replace("slopes", "slopes2").replace("models", "models2"),
        ],
        """, fits AS (
  SELECT series_id, chunk, 1 AS p, n_k, n_k * ln(sigma2 * (n_k - 2) / (n_k - 1)) + 6 AS aic, 3 AS k FROM models1
  UNION ALL
  SELECT series_id, chunk, 2, n_k, n_k * ln(sigma2 * (n_k - 3) / (n_k - 2)) + 8, 4 FROM models2),
ranked AS (SELECT *, aic + 2.0 * k * (k + 1) / (n_k - k - 1) AS aicc FROM fits)
SELECT series_id, chunk, arg_min(p, aicc) AS p, round(min(aicc), 6) AS aicc FROM ranked GROUP BY 1, 2""",
    ),
    "sarima_css_ar": _query(
        [EVENTS, INDEXED, _chunked(CHUNKS), AR2],
        """SELECT series_id, chunk, n_k, round(sigma2, 4) AS sigma2, round(c0 / (1 - pi1 - pi2), 4) AS mean,
  round(pi1, 4) + 0.0 AS pi1, round(pi2, 4) + 0.0 AS pi2 FROM models""",
    ),
    "sarima_whole_ar": _query(
        [EVENTS, INDEXED, _chunked(1), AR2],
        """SELECT series_id, n_k, round(sigma2, 4) AS sigma2, round(c0 / (1 - pi1 - pi2), 4) AS mean,
  round(pi1, 4) + 0.0 AS pi1, round(pi2, 4) + 0.0 AS pi2 FROM models""",
    ),
    "whole_series_ar2": _query(
        [EVENTS, SPLIT, _chunked(1), AR2, GLOBAL2, _steps(HORIZON, "HOUR")],
        f"SELECT series_id, step, {_r('pred', 'se')} FROM steps",
        recursive=True,
    ),
    "dlsa_weighted": _query(
        [EVENTS, INDEXED, _chunked(CHUNKS), AR2, GLOBAL2],
        """SELECT series_id, pos, round(theta, 6) + 0.0 AS theta FROM (
  SELECT series_id, 0 AS pos, c0 AS theta FROM model UNION ALL SELECT series_id, 1, 0 FROM model
  UNION ALL SELECT series_id, 2, pi1 FROM model UNION ALL SELECT series_id, 3, pi2 FROM model)""",
    ),
    "dlsa_orders": _query(
        [ORDERS_PRIORITY_M, INDEXED, _chunked(16), AR1, GLOBAL1],
        """SELECT series_id, pos, round(theta, 6) + 0.0 AS theta, n_used FROM (
  SELECT series_id, 0 AS pos, c0 AS theta FROM model UNION ALL SELECT series_id, 1, 0 FROM model
  UNION ALL SELECT series_id, 2, pi1 FROM model)
JOIN (SELECT series_id, CAST(sum(n_k) AS BIGINT) AS n_used FROM models GROUP BY 1) USING (series_id)""",
    ),
    "global_sigma2": _query(
        [EVENTS, INDEXED, _chunked(CHUNKS), AR1],
        """SELECT series_id, CAST(sum(n_k) AS BIGINT) AS n_used, round(sum(n_k) / sum(n_k / sigma2), 6) AS sigma2
FROM models GROUP BY 1""",
    ),
    "dlsa_full_p2": _query(
        [EVENTS, INDEXED, _chunked(CHUNKS), AR1],
        """, summed AS (
  SELECT series_id, sum(n_k) AS n, sum(n_eff / sigma2) AS a, sum(n_eff * ml / sigma2) AS b, sum(n_eff * mll / sigma2) AS c,
         sum((n_eff * c0 + n_eff * ml * pi1) / sigma2) AS u, sum((n_eff * ml * c0 + n_eff * mll * pi1) / sigma2) AS v
  FROM models GROUP BY 1)
SELECT series_id, 0 AS i, round((c * u - b * v) / (a * c - b * b), 6) AS theta,
       round(n * c / (a * c - b * b), 6) AS s0, round(-n * b / (a * c - b * b), 6) AS s1 FROM summed
UNION ALL
SELECT series_id, 1, round((a * v - b * u) / (a * c - b * b), 6) + 0.0,
       round(-n * b / (a * c - b * b), 6), round(n * a / (a * c - b * b), 6) FROM summed""",
    ),
    "poly_product": _query(
        MODELS_FROM_MOMENTS,
        """, reach AS (SELECT series_id, chunk, unnest(range(0, max(lag) + 1)) AS lag FROM ar_terms GROUP BY 1, 2)
SELECT series_id, chunk, CAST(lag AS INTEGER) AS lag, round(coalesce(coef, 0), 6) + 0.0 AS coef
FROM reach LEFT JOIN ar_terms USING (series_id, chunk, lag)""",
    ),
    "pi_weights": _query(
        [*MODELS_FROM_MOMENTS, WEIGHTS],
        "SELECT series_id, chunk, CAST(lag - 1 AS INTEGER) AS lag, round(weight, 6) + 0.0 AS weight FROM weights",
        recursive=True,
    ),
    "pi_weights_long": _query(
        [*MODELS_FROM_MOMENTS, _weights(TOL_LONG)],
        "SELECT series_id, chunk, CAST(lag - 1 AS INTEGER) AS lag, round(weight, 6) + 0.0 AS weight FROM weights",
        recursive=True,
    ),
    "ar_intercept_trend": _query(
        [*MODELS_FROM_MOMENTS, WEIGHTS],
        """SELECT series_id, chunk,
  round(any_value(mean) * (1 - sum(weight)) + any_value(drift) * sum(lag * weight), 6) + 0.0 AS c0,
  round(any_value(drift) * (1 - sum(weight)), 6) + 0.0 AS c1
FROM weights JOIN moments USING (series_id, chunk) GROUP BY 1, 2""",
        recursive=True,
    ),
    "lag_design": _query(
        [SHIPMENTS, INDEXED],
        """SELECT series_id, idx, y, CASE WHEN idx > 3 THEN lag(y, 1) OVER w END AS y_lag1,
  CASE WHEN idx > 3 THEN lag(y, 2) OVER w END AS y_lag2, lag(y, 3) OVER w AS y_lag3
FROM indexed WINDOW w AS (PARTITION BY series_id ORDER BY idx)""",
    ),
    "fitted_residuals": _query(
        [ORDERS, INDEXED, _chunked(CHUNKS), AR2, GLOBAL2],
        """, fits AS (
  SELECT i.series_id, idx, y,
         c0 + pi1 * lag(y, 1) OVER (PARTITION BY i.series_id ORDER BY idx)
            + pi2 * lag(y, 2) OVER (PARTITION BY i.series_id ORDER BY idx) AS fit
  FROM indexed i JOIN model USING (series_id))
SELECT series_id, idx, y, round(fit, 6) AS fitted, round(y - fit, 6) + 0.0 AS residual FROM fits""",
    ),
    "fitted_long": _query(
        [SHIPMENTS, INDEXED],
        f"""SELECT series_id, idx, y, CASE WHEN idx > {LAGS_LONG} THEN round(0.5 + 0.02 * sum(y) OVER w, 6) END AS fitted,
  CASE WHEN idx > {LAGS_LONG} THEN round(y - 0.5 - 0.02 * sum(y) OVER w, 6) + 0.0 END AS residual FROM indexed
WINDOW w AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN {LAGS_LONG} PRECEDING AND 1 PRECEDING)""",
    ),
    "forecast_long": _query(
        [*EVENT_MODEL, _steps(STEPS_LONG, "HOUR")], f"SELECT series_id, step, {_r('pred', 'se')} FROM steps", recursive=True
    ),
    "forecast_ar2": _query(EVENT_STEPS, f"SELECT series_id, step, {_r('pred')} FROM steps", recursive=True),
    "psi_weights": _query(
        EVENT_STEPS, f"SELECT series_id, step - 1 AS lag, {_r('psi')} FROM steps", recursive=True
    ),
    "forecast_se": _query(EVENT_STEPS, f"SELECT series_id, step, {_r('se')} FROM steps", recursive=True),
    "intervals_multi": _query(
        [*EVENT_STEPS, _intervals([80, 95])],
        f"SELECT series_id, step, {_r('level', 'lower', 'upper')} FROM intervals",
        recursive=True,
    ),
    "intervals_fan": _query(
        [*EVENT_STEPS, _intervals(list(range(51, 100, 3)))],
        f"SELECT series_id, step, {_r('level', 'lower', 'upper')} FROM intervals",
        recursive=True,
    ),
    "forecast_table": _query(
        EVENT_STEPS, f"SELECT series_id, step, {TS.format('ts')}, {_r('pred', 'se')} FROM steps", recursive=True
    ),
    "inv_box_cox_series": _query(
        [
            "logs AS (SELECT CAST('all' AS VARCHAR) AS series_id, date_trunc('day', o_orderdate) AS ts, "
            "CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1e6 AS y FROM orders GROUP BY 1, 2)",
            "series AS (SELECT series_id, ts, ln(y) AS y FROM logs)",
            SPLIT, _chunked(CHUNKS), AR1, GLOBAL1, _steps(HORIZON, "DAY"),
        ],
        """SELECT series_id, step, round(exp(pred), 6) AS median, round(exp(pred) * (1 + se * se / 2), 6) AS mean,
  round(sign(pred * 0.5 + 1) * power(abs(pred * 0.5 + 1), 2), 6) + 0.0 AS power FROM steps""",
        recursive=True,
    ),
    "seasonal_scale": _query([EVENTS, SPLIT, _scale(24)], f"SELECT series_id, {_r('scale')} FROM scales"),
    "seasonal_scale_weekly": _query(
        [SHIPMENTS, INDEXED, _scale(7)], f"SELECT series_id, {_r('scale')} FROM scales"
    ),
    "score_steps": _query(
        [*EVENT_STEPS, _intervals([95]), _scale(24), SCORES],
        f"SELECT series_id, step, {_r('level', 'y', 'mase', 'smape', 'msis')} FROM scores",
        recursive=True,
    ),
    "mean_scores": _query(
        [*EVENT_STEPS, _intervals([95]), _scale(24), SCORES],
        """SELECT series_id, level, round(avg(mase), 6) AS mase, round(avg(smape), 6) AS smape,
  round(avg(msis), 6) AS msis, count(*) FILTER (WHERE mase IS NULL OR smape IS NULL OR msis IS NULL) AS missing
FROM scores GROUP BY 1, 2""",
        recursive=True,
    ),
    "unmatched_steps": _query(
        [EVENTS, SPLIT],
        """, reached AS (SELECT DISTINCT series_id, unnest(range(1, 31)) AS step FROM indexed)
SELECT series_id, count(*) FILTER (WHERE h.step IS NULL) AS forecast_only, count(*) FILTER (WHERE f.step IS NULL) AS holdout_only
FROM reached f FULL JOIN holdout h USING (series_id, step) GROUP BY 1""",
    ),
    "run_status": _query(
        [
            f"""dirty AS (
  SELECT CAST(o_custkey AS VARCHAR) AS series_id, o_orderdate AS ts, o_totalprice AS y,
         o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS usable FROM orders),
sizes AS (
  SELECT series_id, count(*) AS rows, count(*) FILTER (WHERE NOT usable) AS dropped,
         greatest(count(*) FILTER (WHERE usable) - {STATUS_STEPS}, 0) AS trained,
         least(count(*) FILTER (WHERE usable), {STATUS_STEPS}) AS held FROM dirty GROUP BY 1),
kept AS (
  SELECT series_id, lag(y) OVER (PARTITION BY series_id ORDER BY ts, y) AS l1,
         row_number() OVER (PARTITION BY series_id ORDER BY ts, y) AS idx FROM dirty WHERE usable),
spreads AS (
  SELECT series_id, count(DISTINCT l1) AS spread FROM kept JOIN sizes USING (series_id) WHERE idx <= trained GROUP BY 1),
states AS (
  SELECT *, CASE WHEN trained > 0 THEN 1 ELSE 0 END AS chunks,
         CASE WHEN trained > 0 AND (trained <= 3 OR spread < 2) THEN 1 ELSE 0 END AS failed
  FROM sizes LEFT JOIN spreads USING (series_id))"""
        ],
        f"""SELECT series_id, rows, dropped, trained, chunks, failed, 0 AS flagged,
  CASE WHEN failed = 1 THEN {STATUS_STEPS} ELSE 0 END AS missing,
  CASE WHEN trained > 0 THEN {STATUS_STEPS} - held ELSE 0 END AS forecast_only,
  CASE WHEN trained > 0 THEN 0 ELSE held END AS holdout_only,
  CASE WHEN rows = dropped THEN 'empty' WHEN trained = 0 THEN 'short' WHEN failed = 1 THEN 'no_model' ELSE 'ok' END AS status
FROM states""",
    ),
    "diff_orders": _query([SHIPMENTS, INDEXED, _chunked(CHUNKS), *_differences(7)], _DIFF_SELECT.format(extra="")),
    "diff_orders_whole": _query([EVENTS, INDEXED, _chunked(1), *_differences(24)], _DIFF_SELECT.format(extra="")),
    "whole_order_ar": _query(
        [EVENTS, INDEXED, _chunked(1), *_differences(24), *_ar_grid(24)],
        f"""SELECT series_id, n_k, d, sd, p, {_r('pi1', 'pi2', digits=4)},
  CASE WHEN k = 1 THEN round(level / CASE WHEN sd = 1 THEN 24 ELSE 1 END, 4) + 0.0 END AS level,
  round(sse / (n - free), 4) + 0.0 AS sigma2 FROM chosen_order""",
    ),
    "flagship": _query(
        [EVENTS_ALL, SPLIT, _chunked(CHUNKS), AR2, GLOBAL2, _steps(HORIZON, "HOUR"), _intervals([95]), _scale(24), SCORES],
        f"SELECT step, {TS.format('ts')}, {_r('y', 'pred', 'lower', 'upper', 'mase', 'smape', 'msis', digits=4)} FROM scores",
        recursive=True,
    ),
    "run_sizes": _query(
        [EVENTS, INDEXED, _chunked(CHUNKS)],
        f"""SELECT series_id, max(n) AS sample_size, max(chunk_size) AS sample_size_per_chunk, {TOL + 2} AS n_par,
  max(chunk) AS chunks FROM chunked GROUP BY 1""",
    ),
}
