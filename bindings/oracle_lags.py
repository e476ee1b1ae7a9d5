"""SQL for models of any order: plain recursion over whole lists, all orders and series as rows."""

from __future__ import annotations

from collections.abc import Sequence

from meterloom.functions.arma import ROUNDS, Order

ID = "key, o, held"


def _order_rows(orders: Sequence[Order]) -> str:
    rows = []
    for number, o in enumerate(orders):
        r = 1 + max([0, *o.ar, *o.ma])
        lags = ", ".join(f"{lags}::BIGINT[]" for lags in (o.ar, o.ma))
        rows.append(f"({number}, {', '.join(map(str, o))}, {lags}, {o.lost}, {r}, {max(o.ma, default=0)})")
    return ", ".join(rows)


def solve(name: str, source: str) -> str:
    """``name(key, o, held, v)``: elimination with limited pivots on the augmented matrices ``a`` of ``source``."""
    pivot = """CASE WHEN a[j + 1][j + 1] = 0 THEN CASE WHEN top > 0 THEN top / 100 ELSE 1.0 END
        WHEN abs(a[j + 1][j + 1]) * 100 < top THEN sign(a[j + 1][j + 1]) * top / 100 ELSE a[j + 1][j + 1] END"""
    return f"""
{name}_up AS (SELECT {ID}, a, 0 AS j, []::DOUBLE[] AS ps, 0.0::DOUBLE AS top FROM {source}
  UNION ALL
  SELECT {ID}, list_transform(a, lambda row, i: CASE WHEN i <= j + 1 THEN row ELSE
           list_transform(row, lambda v, c: v - a[i][j + 1] / pv * a[j + 1][c]) END),
         j + 1, list_append(ps, pv), greatest(top, abs(pv))
  FROM (SELECT *, {pivot} AS pv FROM {name}_up WHERE j < len(a))),
{name}_down AS (SELECT {ID}, a, ps, len(a) AS j, []::DOUBLE[] AS v FROM {name}_up WHERE j = len(a)
  UNION ALL
  SELECT {ID}, a, ps, j - 1, list_prepend((a[j][len(a) + 1]
         - coalesce(list_sum(list_transform(v, lambda y, i: a[j][j + i] * y)), 0.0)) / ps[j], v)
  FROM {name}_down WHERE j > 0),
{name} AS MATERIALIZED (SELECT {ID}, v FROM {name}_down WHERE j = 0)"""


def dot(lags: str, offset: str, past: str) -> str:
    """Sum of coefficients ``v[offset + i]`` times ``past[lags[i]]``, absent values zero."""
    term = f"v[{offset} + i] * coalesce({past}[l], 0.0)"
    return f"coalesce(list_sum(list_transform({lags}, lambda l, i: {term})), 0.0)"


def lag_models(orders: Sequence[Order], source: str, horizon: int) -> str:
    """CTEs up to ``best`` (one row per series, order and fit, with coefficients ``v``) and
    ``path`` (its forecast ``y`` and running spread ``wide``, ``horizon`` steps or the length of the tail)."""
    since = max(max([0, *o.ar, *o.ma]) for o in orders)
    rounds = []
    for k in range(1, ROUNDS + 1):
        rounds.append(f"""
cols{k} AS (SELECT {ID}, list_concat(
    list_transform(ar, lambda a: list_transform(range(r + 1, stop + 1), lambda t: z[t - a])),
    list_transform(ma, lambda b: list_transform(range(r + 1, stop + 1), lambda t: e[t - b]))) AS cs,
    z[r + 1:stop] AS y FROM fit JOIN noise{k} USING ({ID})),
aug{k} AS (SELECT {ID}, list_transform(cs, lambda ci: list_append(
    list_transform(cs, lambda cj: list_dot_product(ci, cj)), list_dot_product(ci, y))) AS a FROM cols{k}),
{solve(f"co{k}", f"aug{k}")}""")
        if k < ROUNDS:
            rounds.append(f"""
go{k} AS (SELECT {ID}, r AS t, 0.0::DOUBLE AS pt, list_reverse(z[1:r]) AS pz,
    [z[r] - {dot("ar", "0", "list_reverse(z[1:r - 1])")}] AS pe FROM fit JOIN co{k} USING ({ID})
  UNION ALL
  SELECT {ID}, t + 1, p1, list_prepend(p1, pz[1:r]), list_prepend(0.0, pe[1:r])
  FROM (SELECT {ID}, t, r, pz, pe, {dot("ar", "0", "pz")} + {dot("ma", "len(ar)", "pe")} AS p1
        FROM go{k} JOIN co{k} USING ({ID}) JOIN fit USING ({ID}) WHERE t < stop)),
drawn{k} AS (SELECT {ID}, list(pt ORDER BY t) AS ps FROM go{k} GROUP BY {ID}),
noise{k + 1} AS MATERIALIZED (SELECT {ID}, list_transform(range(1, stop + 1), lambda t:
    CASE WHEN t <= r THEN 0.0 ELSE z[t] - ps[t - r + 1] END) AS e FROM drawn{k} JOIN fit USING ({ID}))""")
    every = " UNION ALL ".join(f"SELECT {ID}, {k} AS k, v FROM co{k}" for k in range(1, ROUNDS + 1))
    return f"""
ser AS (SELECT key, list(value ORDER BY ts) AS x, max(ts) AS last FROM {source} GROUP BY key),
orders(o, p, d, q, sp, sd, sq, m, ar, ma, lost, r, reach) AS (VALUES {_order_rows(orders)}),
f1 AS (SELECT key, x, h.held, orders.*, CASE WHEN h.held THEN CAST(floor(len(x) * 0.15::DOUBLE) AS BIGINT)
       ELSE 1 END AS tail FROM ser, orders, (VALUES (false), (true)) h(held)),
f2 AS (SELECT *, len(x) - lost - CASE WHEN held THEN tail ELSE 0 END AS n FROM f1),
f3 AS (SELECT *, n - tail AS stop, CASE WHEN sd = 1 AND m > 0
       THEN list_transform(range(m + 1, len(x) + 1), lambda i: x[i] - x[i - m]) ELSE x END AS w1
       FROM f2 WHERE n > 0 AND tail >= 1 AND n - tail >= 2 * r),
f4 AS (SELECT *, CASE WHEN d = 1 THEN list_transform(range(2, len(w1) + 1), lambda i: w1[i] - w1[i - 1])
       ELSE w1 END AS w FROM f3),
f5 AS (SELECT *, list_avg(w[1:n]) AS mu FROM f4),
fit AS MATERIALIZED (SELECT *, list_transform(w[1:n], lambda v: v - mu) AS z FROM f5),
cov AS (SELECT {ID}, r, list_transform(range(0, r + 1), lambda h: list_sum(
        list_transform(range(1, n - h + 1), lambda i: z[i] * z[i + h])) / n) AS c FROM fit),
aug0 AS (SELECT {ID}, list_transform(range(1, r + 1), lambda i: list_append(
         list_transform(range(1, r + 1), lambda j: c[abs(i - j) + 1]), c[i + 1])) AS a FROM cov),
{solve("co0", "aug0")},
noise1 AS MATERIALIZED (SELECT {ID}, list_transform(range(1, stop + 1), lambda t: CASE WHEN t <= r THEN 0.0
    ELSE z[t] - list_sum(list_transform(range(1, r + 1), lambda k: v[k] * z[t - k])) END) AS e
  FROM fit JOIN co0 USING ({ID})),
{", ".join(rounds)},
coefs AS MATERIALIZED ({every}),
er AS (SELECT {ID}, k, r - 1 AS t, []::DOUBLE[] AS pe, 0.0::DOUBLE AS squares FROM fit JOIN coefs USING ({ID})
  UNION ALL
  SELECT {ID}, k, t + 1, list_prepend(e1, pe[1:reach]), squares + CASE WHEN t >= {since} THEN e1 * e1 ELSE 0.0 END
  FROM (SELECT {ID}, k, t, reach, pe, squares, z[t + 1] - {dot("ar", "0", "list_reverse(z[t - r + 2:t])")}
               - {dot("ma", "len(ar)", "pe")} AS e1
        FROM er JOIN coefs USING ({ID}, k) JOIN fit USING ({ID}) WHERE t < n)),
ends AS MATERIALIZED (SELECT {ID}, k, t, pe, squares FROM er JOIN fit USING ({ID}) WHERE t IN (stop, n)),
tails AS (SELECT {ID}, k, 0 AS s, list_reverse(z[stop - r + 1:stop]) AS pz, pe, 0.0::DOUBLE AS miss
  FROM ends JOIN fit USING ({ID}) WHERE t = stop
  UNION ALL
  SELECT {ID}, k, s + 1, list_prepend(p1, pz[1:r]), list_prepend(0.0, pe[1:reach]), miss + (z[stop + s + 1] - p1) ** 2
  FROM (SELECT {ID}, k, s, r, reach, z, stop, pz, pe, miss, {dot("ar", "0", "pz")} + {dot("ma", "len(ar)", "pe")} AS p1
        FROM tails JOIN coefs USING ({ID}, k) JOIN fit USING ({ID}) WHERE s < tail)),
best AS MATERIALIZED (SELECT {ID}, k, v, pe, squares FROM (
    SELECT {ID}, k, row_number() OVER (PARTITION BY {ID} ORDER BY miss, k) AS place
    FROM tails JOIN fit USING ({ID}) WHERE s = tail) JOIN coefs USING ({ID}, k)
  JOIN (SELECT {ID}, k, pe, squares FROM ends JOIN fit USING ({ID}) WHERE t = n) USING ({ID}, k) WHERE place = 1),
ahead AS (SELECT {ID}, 0 AS s, list_reverse(z[n - r + 1:n]) AS pz, pe, []::DOUBLE[] AS zs, [1.0::DOUBLE] AS ws
  FROM best JOIN fit USING ({ID})
  UNION ALL
  SELECT {ID}, s + 1, list_prepend(p1, pz[1:r]), list_prepend(0.0, pe[1:reach]), list_append(zs, p1),
         list_prepend({dot("ar", "0", "ws")} + coalesce(v[len(ar) + list_position(ma, s + 1)], 0.0), ws)
  FROM (SELECT {ID}, s, r, reach, ar, ma, v, pz, best.pe AS _, ahead.pe, zs, ws,
               {dot("ar", "0", "pz")} + {dot("ma", "len(ar)", "ahead.pe")} AS p1
        FROM ahead JOIN best USING ({ID}) JOIN fit USING ({ID})
        WHERE s < CASE WHEN held THEN tail ELSE {horizon} END)),
u1 AS (SELECT {ID}, x, w1, n, lost, d, sd, m, tail, ws, list_transform(zs, lambda p: p + mu) AS y1
       FROM ahead JOIN fit USING ({ID}) WHERE s = CASE WHEN held THEN tail ELSE {horizon} END),
u2 AS (SELECT *, CASE WHEN d = 1 THEN list_transform(y1, lambda y, s: w1[n + lost - sd * m] + list_sum(y1[1:s]))
       ELSE y1 END AS y2 FROM u1),
path AS MATERIALIZED (SELECT {ID}, x, n, lost, tail, CASE WHEN sd = 1 AND m > 0 THEN list_transform(y2, lambda y, s:
         x[n + lost - m + (s - 1) % m + 1] + list_sum(list_transform(range(s, 0, -m), lambda j: y2[j])))
       ELSE y2 END AS y,
       list_transform(range(1, len(y2) + 1), lambda s: sqrt(list_sum(list_transform(
         (list_reverse(ws))[1:s], lambda w: w * w)))) AS wide FROM u2),
scores AS (SELECT key, o, sqrt(list_avg(list_transform(y, lambda v, s: (x[n + lost + s] - v) ** 2))) AS rmse, tail
           FROM path WHERE held)"""
