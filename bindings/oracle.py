"""SQL counterparts of the queries, for DuckDB over the same tables.

Written independently of the Spark code: plain windows where that uses blocks,
explicit recursion over lists where that uses sums, elimination in SQL where that
calls a solver.
"""

from __future__ import annotations

from zlib import crc32

from bindings import queries as q
from bindings.oracle_lags import lag_models

ORACLE: dict[str, str] = {}


def r(expression: str, digits: int, name: str) -> str:
    return f"round({expression}, {digits}) + 0.0 AS {name}"


def values(rows: list[tuple], columns: str) -> str:
    cells = ", ".join("(" + ", ".join(f"'{c}'" for c in row) + ")" for row in rows)
    return f"(SELECT * FROM (VALUES {cells}) v({columns}))"


def chain(key: str = "event_type", minutes: int = 30) -> str:
    """readings, ma, ri, pi for a key column of events."""
    step = f"INTERVAL {minutes} MINUTE"
    return f"""
slots AS (SELECT CAST({key} AS VARCHAR) AS key, time_bucket({step}, ts) AS ts, sum(value) AS value
          FROM events GROUP BY 1, 2),
b AS (SELECT min(ts) lo, max(ts) hi FROM slots),
grid AS (SELECT k.key, g.ts FROM (SELECT DISTINCT key FROM slots) k,
         (SELECT unnest(generate_series(lo, hi, {step})) AS ts FROM b) g),
readings AS (SELECT grid.key, grid.ts, coalesce(s.value, 0.0) AS value
             FROM grid LEFT JOIN slots s USING (key, ts)),
ma AS (SELECT key, ts, a AS ma FROM
       (SELECT key, ts, avg(value) OVER w AS a, count(*) OVER w AS n FROM readings
        WINDOW w AS (PARTITION BY key ORDER BY ts
                     RANGE BETWEEN CURRENT ROW AND INTERVAL 90 MINUTE FOLLOWING)) WHERE n = 4),
ri AS (SELECT r.key, r.ts, CASE WHEN m.ma <> 0 THEN r.value / m.ma ELSE r.value END AS ri
       FROM readings r JOIN ma m USING (key, ts)),
pi AS (SELECT key, dayofweek(ts) + 1 AS dow, hour(ts) AS hour, avg(ri) AS pi
       FROM ri GROUP BY ALL)"""


HALF_HOURLY = f"WITH {chain()}"
BY_USER = f"WITH {chain('user_id')}"
HOURLY = f"WITH {chain(minutes=60)}"

CENTERED = f"""{HOURLY},
framed AS (SELECT key, ts, value, row_number() OVER w AS i, count(*) OVER (PARTITION BY key) AS n,
           sum(value) OVER (w ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING) AS a,
           sum(value) OVER (w ROWS BETWEEN 11 PRECEDING AND 12 FOLLOWING) AS c
           FROM readings WINDOW w AS (PARTITION BY key ORDER BY ts)),
cma AS (SELECT key, ts, value,
        CASE WHEN i BETWEEN 13 AND n - 12 THEN 0.5 * a / 24 + 0.5 * c / 24 ELSE value END AS cma
        FROM framed),
cri AS (SELECT key, ts, CASE WHEN cma <> 0 THEN value / cma END AS ri FROM cma)"""


def ring(names: str) -> str:
    """Every event type with the next one in alphabetical order, the last with the first."""
    return f"""(SELECT * FROM (SELECT t, coalesce(lead(t) OVER (ORDER BY t), min(t) OVER ())
                FROM (SELECT DISTINCT event_type AS t FROM events)) AS ring_of({names}))"""


DOW = "dayofweek(r.ts) + 1 AS dow"
MATCH = "dayofweek(r.ts) + 1 = p.dow AND hour(r.ts) = p.hour"
PAIRS = f"""pairs AS (SELECT DISTINCT key, key AS profile_key FROM readings
          UNION ALL SELECT * FROM {ring("key, profile_key")})"""
ADJUSTED = f"""{HALF_HOURLY}, {PAIRS},
adjusted AS (SELECT r.key, pairs.profile_key, r.ts, {DOW}, r.value / p.pi AS adjusted
             FROM readings r JOIN pairs USING (key)
             JOIN pi p ON p.key = pairs.profile_key AND {MATCH} WHERE p.pi <> 0)"""

# Sources ------------------------------------------------------------------------------

ORACLE["read_dayslot"] = f"""
SELECT event_type AS key, TIMESTAMP '2009-01-01' + to_days(CAST(dayofyear(ts) - 1 AS INTEGER))
       + to_minutes(30 * ((hour(ts) * 60 + minute(ts)) // 30 + 1)) AS ts, {r("value", 2, "value")}
FROM events"""
ORACLE["read_dayslot_split"] = f"""
SELECT event_type AS key, TIMESTAMP '2009-01-01' + to_days(CAST(dayofyear(ts) AS INTEGER))
       + to_minutes(30 * ((hour(ts) * 60 + minute(ts)) // 30)) AS ts, {r("value", 2, "value")}
FROM events"""
ORACLE["read_dayslot_rejects"] = """
SELECT CAST(doc_id AS VARCHAR) AS meter, source AS code, CAST(n_chars AS VARCHAR) AS value
FROM documents"""


def weather(key: str = "event_type") -> str:
    return f"""WITH {chain(key, 60)},
weather AS (SELECT key AS meter_id, CAST(ts AS DATE) AS date, hour(ts) AS hour, value AS reading,
            CAST((day(ts) * 7 + hour(ts) * 5) % 31 - 3 AS DOUBLE) AS temperature FROM readings)"""


WEATHER = weather()
USER_WEATHER = weather("user_id")
ORACLE["read_weather"] = f"""{USER_WEATHER}
SELECT CAST(meter_id AS INTEGER) AS meter_id, date, CAST(hour AS INTEGER) AS hour,
       {r("reading", 2, "reading")}, {r("temperature", 2, "temperature")} FROM weather"""


def hinge(name: str) -> str:
    return {
        "over": "greatest(temperature - 20.0, 0.0)",
        "under": "greatest(16.0 - temperature, 0.0)",
        "frost": "greatest(5.0 - temperature, 0.0)",
    }[name]


RESIDUAL = (
    f"reading - {q.BETA[4]} * {hinge('over')} - {q.BETA[5]} * {hinge('under')}"
    f" - ({q.BETA[6]}) * {hinge('frost')}"
)
USER_ACTIVITY = f"""{USER_WEATHER},
residual AS (SELECT CAST(meter_id AS INTEGER) AS meter_id, date, hour, {RESIDUAL} AS activity
             FROM weather),
found AS (SELECT meter_id, hour, avg(activity) AS mean, stddev_pop(activity) AS std
          FROM residual GROUP BY ALL),
activity AS (SELECT m.meter_id, h.hour, coalesce(mean, 0.0) AS mean, coalesce(std, 0.0) AS std
             FROM (SELECT DISTINCT meter_id FROM found) m
             CROSS JOIN (SELECT unnest(range(24)) AS hour) h LEFT JOIN found USING (meter_id, hour))"""
ORACLE["read_activity"] = ORACLE["activity_arrays"] = f"""{USER_ACTIVITY}
SELECT meter_id, CAST(hour AS INTEGER) AS hour, {r("mean", 4, "mean")}, {r("std", 4, "std")}
FROM activity"""
SPOILT_DAY = "(day(date) + hour) % 7 = 0"
ORACLE["read_weather_mixed"] = f"""{USER_WEATHER}
SELECT CAST(meter_id AS INTEGER) AS meter_id, CAST(hour AS INTEGER) AS hour,
       concat(CASE WHEN {SPOILT_DAY} THEN 'x' ELSE '' END, CAST(date AS VARCHAR)) AS date,
       {r("reading", 2, "reading")}, {r("temperature", 2, "temperature")}, {SPOILT_DAY} AS rejected FROM weather"""
ORACLE["read_activity_mixed"] = f"""{USER_ACTIVITY}
SELECT meter_id, CAST(hour AS INTEGER) AS hour, {r("mean", 4, "mean")}, {r("std", 4, "std")}
FROM activity WHERE meter_id % 3 <> 0
UNION ALL SELECT DISTINCT meter_id, CAST(NULL AS INTEGER), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)
FROM activity WHERE meter_id % 3 = 0"""
SEED = """seed_hours AS (
  SELECT unnest(generate_series(date_trunc('hour', lo), date_trunc('hour', hi), INTERVAL 1 HOUR)) AS ts
  FROM (SELECT min(ts) AS lo, max(ts) AS hi FROM events)),
seed AS (SELECT CAST(row_number() OVER (ORDER BY ts) - 1 AS INTEGER) AS i,
         CAST((day(ts) * 7 + hour(ts) * 5) % 31 - 3 AS DOUBLE) AS temp FROM seed_hours)"""
ORACLE["read_temperature_seed"] = f"WITH {SEED} SELECT i, temp FROM seed"
ORACLE["time_grid"] = """
SELECT CAST(user_id AS VARCHAR) AS key,
       unnest(generate_series(date_trunc('hour', min(ts)), max(ts), INTERVAL 6 HOUR)) AS ts
FROM events GROUP BY user_id"""
ORACLE["gap_fill"] = f"{HALF_HOURLY} SELECT key, ts, {r('value', 4, 'value')} FROM readings"
ORACLE["gap_fill_series"] = f"""
WITH slots AS (SELECT CAST(user_id AS VARCHAR) AS key, date_trunc('hour', ts) AS ts,
               sum(value) AS value FROM events GROUP BY 1, 2),
grid AS (SELECT key, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts
         FROM slots GROUP BY key)
SELECT key, ts, {r("coalesce(value, 0.0)", 4, "value")} FROM grid LEFT JOIN slots USING (key, ts)"""

# Rows ---------------------------------------------------------------------------------

ORACLE["assign_key"] = f"SELECT 'all' AS key, ts, {r('value * 2', 4, 'value')} FROM events"
ORACLE["calendar_expand"] = f"""
SELECT event_type AS key, ts, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) - 1 AS INTEGER) AS month,
       CAST(day(ts) AS INTEGER) AS day, CAST(dayofweek(ts) + 1 AS INTEGER) AS dow,
       CAST(hour(ts) AS INTEGER) AS hour, CAST(minute(ts) AS INTEGER) AS minute,
       {r("value", 4, "value")} FROM events"""
ORACLE["filter_day"] = f"""{HALF_HOURLY}
SELECT key, ts, {r("value", 4, "value")} FROM readings WHERE dayofweek(ts) + 1 = 1"""
ORACLE["filter_key"] = f"""{HALF_HOURLY}
SELECT key, ts, {r("value", 4, "value")} FROM readings WHERE key = 'view'"""


def day_windows(weeks: str) -> str:
    return f"""{HALF_HOURLY}
SELECT key, ts, CAST(week AS INTEGER) AS week, {r("value", 4, "value")}
FROM readings JOIN (SELECT unnest({weeks}) AS week) w
  ON dayofyear(ts) BETWEEN 2 + 7 * week AND 2 + 7 * week + 7"""


ORACLE["select_days"] = day_windows("range(4)")
ORACLE["select_days_last"] = day_windows("[2]")
ORACLE["union_series"] = f"SELECT event_type AS key, ts, {r('value', 4, 'value')} FROM events"
ORACLE["dedupe"] = f"""
SELECT CAST(user_id AS VARCHAR) AS key, date_trunc('hour', ts) AS ts, {r("sum(value)", 4, "value")}
FROM events GROUP BY 1, 2"""

# Smoothing and profiles ---------------------------------------------------------------

ORACLE["moving_average"] = f"{HALF_HOURLY} SELECT key, ts, {r('ma', 6, 'ma')} FROM ma"
ORACLE["moving_average_users"] = f"{BY_USER} SELECT key, ts, {r('ma', 6, 'ma')} FROM ma"
ORACLE["raw_index"] = f"{HALF_HOURLY} SELECT key, ts, {r('ri', 6, 'ri')} FROM ri"
ORACLE["raw_index_aligned"] = f"""{HALF_HOURLY}
SELECT key, ts, {r("ri", 6, "ri")} FROM ri WHERE hour(ts) % 2 = 0 AND minute(ts) = 0"""
ORACLE["centered_ma"] = f"{CENTERED} SELECT key, ts, {r('cma', 6, 'cma')} FROM cma"
ORACLE["raw_index_centered"] = f"{CENTERED} SELECT key, ts, {r('ri', 5, 'ri')} FROM cri"
CELL = "key, CAST(dow AS INTEGER) AS dow, CAST(hour AS INTEGER) AS hour"
ORACLE["periodic_index"] = f"{HALF_HOURLY} SELECT {CELL}, {r('pi', 6, 'pi')} FROM pi"
ORACLE["periodic_index_users"] = f"{BY_USER} SELECT {CELL}, {r('pi', 6, 'pi')} FROM pi"
ORACLE["last_cycle_index"] = f"""{CENTERED},
newest AS (SELECT key, dayofweek(ts) + 1 AS dow, hour(ts) AS hour, ri,
           row_number() OVER (PARTITION BY key, dayofweek(ts), hour(ts) ORDER BY ts DESC) AS back
           FROM cri)
SELECT {CELL}, {r("ri * 0.5", 5, "pi")} FROM newest WHERE back = 1"""
TOTAL = "sum(pi) OVER (PARTITION BY key, dow)"
SCALED = f"CASE WHEN {TOTAL} <> 0 THEN 24 * pi / {TOTAL} END"
ORACLE["normalize_index"] = f"{HALF_HOURLY} SELECT {CELL}, {r(SCALED, 6, 'pi')} FROM pi"
ORACLE["normalize_index_as_written"] = f"""{HALF_HOURLY}
SELECT {CELL}, {r(f"{SCALED} / (hour + 1)", 6, "pi")} FROM pi"""
ORACLE["pack_profile"] = f"""{HALF_HOURLY}
SELECT key AS profile_key, CAST(dow AS INTEGER) AS dow, CAST(hour AS INTEGER) AS hour,
       {r("pi", 6, "pi")} FROM pi"""
COLS = "key, profile_key, ts, CAST(dow AS INTEGER) AS dow"
ORACLE["peaks"] = f"""{HALF_HOURLY}
SELECT r.key, p.key AS profile_key, r.ts, CAST(p.dow AS INTEGER) AS dow,
       {r("r.value - p.pi", 4, "peak")} FROM readings r JOIN pi p ON r.key = p.key AND {MATCH}"""
ORACLE["peaks_users"] = ORACLE["peaks"].replace(HALF_HOURLY, BY_USER)
ORACLE["peaks_paired"] = f"""{HALF_HOURLY}, {PAIRS}
SELECT r.key, p.key AS profile_key, r.ts, CAST(p.dow AS INTEGER) AS dow,
       {r("r.value - p.pi", 4, "peak")}
FROM readings r JOIN pairs USING (key) JOIN pi p ON p.key = pairs.profile_key AND {MATCH}"""
ORACLE["adjusted_series_paired"] = f"""{ADJUSTED}
SELECT {COLS}, {r("adjusted", 4, "adjusted")} FROM adjusted"""
ORACLE["adjusted_series"] = f"""{ADJUSTED}
SELECT {COLS}, {r("adjusted", 4, "adjusted")} FROM adjusted WHERE key = profile_key"""
ORACLE["adjusted_series_normalized"] = f"""{CENTERED},
cpi AS (SELECT key, dayofweek(ts) + 1 AS dow, hour(ts) AS hour, avg(ri) AS pi FROM cri GROUP BY ALL),
npi AS (SELECT key, dow, hour, {SCALED} AS pi FROM cpi)
SELECT r.key, r.key AS profile_key, r.ts, CAST(p.dow AS INTEGER) AS dow,
       {r("r.value / p.pi", 3, "adjusted")}
FROM readings r JOIN npi p ON r.key = p.key AND {MATCH} WHERE p.pi <> 0"""

# Series algebra -----------------------------------------------------------------------


def hour_sums(ts: str) -> str:
    return f"""{HALF_HOURLY}
SELECT key, CAST({ts} AS DATE) AS date, CAST(dayofweek({ts}) + 1 AS INTEGER) AS dow,
       CAST(hour({ts}) + 1 AS INTEGER) AS hour, {r("sum(value)", 4, "value")}
FROM readings GROUP BY 1, 2, 3, 4"""


ORACLE["hourly_sum"] = hour_sums("ts")
ORACLE["hourly_sum_end"] = hour_sums("(ts - INTERVAL 30 MINUTE)")
PLACE = "row_number() OVER w - 1 AS i"
ORACLE["difference"] = f"""{HALF_HOURLY}
SELECT key, ts, {PLACE}, {r("value - lag(value) OVER w", 4, "diff")}
FROM readings WINDOW w AS (PARTITION BY key ORDER BY ts)"""
ORACLE["difference_seasonal"] = f"""{HOURLY},
one AS (SELECT key, ts, {PLACE}, value - lag(value, 24) OVER w AS d
        FROM readings WINDOW w AS (PARTITION BY key ORDER BY ts))
SELECT key, ts, i, {r("d - lag(d, 24) OVER w", 4, "diff")}
FROM one WINDOW w AS (PARTITION BY key ORDER BY ts)"""
ORACLE["integrate"] = f"{HOURLY} SELECT key, ts, {r('value', 4, 'integrated')} FROM readings"
ORACLE["center"] = f"""{HALF_HOURLY}
SELECT key, ts, {r("value - avg(value) OVER (PARTITION BY key)", 5, "centered")} FROM readings"""
ORACLE["autocovariance"] = f"""{HALF_HOURLY},
c AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY ts) AS i,
      count(*) OVER (PARTITION BY key) AS n, value - avg(value) OVER (PARTITION BY key) AS x FROM readings),
apart AS (SELECT a.key, a.n, CAST(lags.lag AS INTEGER) AS lag, a.x * b.x AS product
          FROM c a CROSS JOIN (SELECT unnest(range(6)) AS lag) lags
          JOIN c b ON a.key = b.key AND b.i = a.i + lags.lag)
SELECT key, n, lag, {r("sum(product) / n", 3, "acov")} FROM apart GROUP BY key, n, lag"""
ORACLE["series_stats"] = f"""{HALF_HOURLY}
SELECT key, count(*) AS n, {r("min(value)", 4, "min")}, {r("avg(value)", 5, "mean")},
       {r("stddev_pop(value)", 4, "std")}, {r("var_samp(value)", 3, "variance")}
FROM readings GROUP BY key"""
ORACLE["rmse"] = f"""{HALF_HOURLY}
SELECT key, count(*) AS n, {r("sqrt(avg((value - ma) * (value - ma)))", 4, "rmse")}
FROM readings JOIN ma USING (key, ts) GROUP BY key"""
FEATURES = f"""{WEATHER},
features AS (SELECT * FROM (
  SELECT meter_id, hour, date, reading, temperature, lag(reading, 1) OVER w AS lag1,
         lag(reading, 2) OVER w AS lag2, lag(reading, 3) OVER w AS lag3,
         {hinge("over")} AS over, {hinge("under")} AS under, {hinge("frost")} AS frost
  FROM weather WINDOW w AS (PARTITION BY meter_id, hour ORDER BY date)) WHERE lag3 IS NOT NULL)"""
PREDICTORS = ["lag1", "lag2", "lag3", "over", "under", "frost"]
ORACLE["lag_features"] = f"""{FEATURES}
SELECT meter_id, CAST(hour AS INTEGER) AS hour, date,
       {", ".join(r(f'"{c}"', 4, f'"{c}"') for c in ["reading", "temperature", *PREDICTORS])} FROM features"""
GRAM = [(a, b) for k, a in enumerate(["reading", "lag1", "over"]) for b in ["reading", "lag1", "over"][k:]]
ORACLE["gram"] = f"""{FEATURES}
SELECT meter_id, CAST(hour AS INTEGER) AS hour,
       {", ".join(r(f'sum("{a}" * "{b}")', 5, f"g_{a}_{b}") for a, b in GRAM)}
FROM features GROUP BY 1, 2"""

# Models -------------------------------------------------------------------------------


def elimination() -> str:
    """Least squares per group by Gauss-Jordan elimination, one step per statement."""
    names = ["one", *PREDICTORS]
    size = len(names)
    column = [f'"{c}"' if c != "one" else "1.0" for c in [*names, "reading"]]
    cells = ", ".join(
        f"sum({column[a]} * {column[b]}) AS m{a}_{b}" for a in range(size) for b in range(size + 1)
    )
    steps = [f"s0 AS (SELECT meter_id, hour, count(*) AS n, {cells} FROM features GROUP BY ALL)"]
    for k in range(size):
        row = lambda a, b: (
            f"m{k}_{b} / m{k}_{k}" if a == k else f"m{a}_{b} - m{a}_{k} * m{k}_{b} / m{k}_{k}"
        )
        cells = ", ".join(
            f"{row(a, b)} AS m{a}_{b}" for a in range(size) for b in range(k + 1, size + 1)
        )
        steps.append(f"s{k + 1} AS (SELECT meter_id, hour, n, {cells} FROM s{k})")
    return ",\n".join(steps)


SIZE = len(PREDICTORS) + 1
MODELS = f"{FEATURES}, {elimination()}"
ORACLE["fit_thermal_ar"] = f"""{MODELS}
SELECT meter_id, CAST(hour AS INTEGER) AS hour, n, 'ok' AS status,
       {", ".join(r(f"m{k}_{SIZE}", 3, f"b{k}") for k in range(SIZE))} FROM s{SIZE}"""
ORACLE["thermal_normal_equations"] = f"""{FEATURES}
SELECT DISTINCT meter_id, CAST(hour AS INTEGER) AS hour,
       {", ".join(f'0.0 AS "{c}"' for c in PREDICTORS)} FROM features"""
ORACLE["activity_residual"] = f"""{WEATHER}
SELECT meter_id, date, CAST(hour AS INTEGER) AS hour, {r(RESIDUAL, 4, "activity")} FROM weather"""
ORACLE["activity_profile"] = ORACLE["train_activity"] = f"""{MODELS},
residual AS (SELECT meter_id, hour, reading - m4_{SIZE} * {hinge("over")} - m5_{SIZE} * {hinge("under")}
             - m6_{SIZE} * {hinge("frost")} AS activity FROM weather JOIN s{SIZE} USING (meter_id, hour))
SELECT meter_id, CAST(hour AS INTEGER) AS hour, {r("avg(activity)", 3, "mean")},
       {r("stddev_pop(activity)", 3, "std")} FROM residual GROUP BY 1, 2"""


def ma1(source: str, keys: str, value: str) -> str:
    """Estimation of the default order over lists, by explicit recursion."""
    def theta(errors: str) -> str:
        top = f"list_sum(list_transform(range(2, L), lambda t: y[t + 1] * {errors}[t]))"
        square = f"list_sum(list_transform(range(2, L), lambda t: {errors}[t] * {errors}[t]))"
        return f"CASE WHEN {square} = 0 THEN {top} ELSE {top} / {square} END"

    def last(theta_name: str, end: str) -> str:
        return (
            f"list_reduce(list_prepend(0.0, y[2:{end}]), lambda e, v: v - {theta_name} * e)"
        )

    rounds = []
    for k in range(1, 6):
        rounds.append(
            f"t{k} AS (SELECT *, {theta(f'e{k}')} AS th{k} FROM "
            + ("errors)" if k == 1 else f"u{k - 1})")
        )
        if k < 5:
            restart = (
                f"list_transform(range(0, L), lambda t: CASE WHEN t < 2 THEN 0.0 "
                f"WHEN t = 2 THEN y[3] - th{k} * y[2] ELSE y[t + 1] END)"
            )
            rounds.append(f"u{k} AS (SELECT *, {restart} AS e{k + 1} FROM t{k})")
    tail = "coalesce(list_sum(list_transform(y[L + 2:], lambda v: v * v)), 0.0)"
    scores = ", ".join(
        f"sqrt(((y[L + 1] - th{k} * {last(f'th{k}', 'L')}) ** 2 + {tail}) / f) AS sc{k}"
        for k in range(1, 6)
    )
    lowest = "least(" + ", ".join(f"sc{k}" for k in range(1, 6)) + ")"
    pick = "CASE " + " ".join(f"WHEN sc{k} = {lowest} THEN th{k}" for k in range(1, 6)) + " END"
    return f"""
g AS (SELECT {keys}, list({value} ORDER BY ts) AS x, list(ts ORDER BY ts) AS tss, count(*) AS n,
      CAST(floor(count(*) * 0.15::DOUBLE) AS BIGINT) AS t FROM {source} GROUP BY ALL),
fits AS (SELECT {keys}, 'full' AS fit, x AS xs, n AS N, n - 1 AS L, 1 AS f FROM g WHERE n >= 7
         UNION ALL
         SELECT {keys}, 'held' AS fit, x[1:n - t] AS xs, n - t AS N, n - 2 * t AS L, t AS f
         FROM g WHERE n >= 7),
centred AS (SELECT *, list_avg(xs) AS mu,
            list_transform(xs, lambda v: v - list_avg(xs)) AS y FROM fits),
cov AS (SELECT *, list_sum(list_transform(y, lambda v: v * v)) / N AS c0,
        list_sum(list_transform(range(1, N), lambda i: y[i] * y[i + 1])) / N AS c1,
        list_sum(list_transform(range(1, N - 1), lambda i: y[i] * y[i + 2])) / N AS c2 FROM centred),
pivot0 AS (SELECT *, CASE WHEN c0 = 0 THEN 1.0 ELSE c0 END AS d0 FROM cov),
raw1 AS (SELECT *, c1 / d0 AS mult, c0 - c1 * c1 / d0 AS w FROM pivot0),
pivot1 AS (SELECT *, CASE WHEN w = 0 THEN d0 / 100 WHEN abs(w) * 100 < d0 THEN sign(w) * d0 / 100
           ELSE w END AS d1 FROM raw1),
second AS (SELECT *, (c2 - mult * c1) / d1 AS phi2 FROM pivot1),
first AS (SELECT *, c1 / d0 - mult * phi2 AS phi1 FROM second),
errors AS (SELECT *, list_transform(range(0, L), lambda t: CASE WHEN t < 2 THEN 0.0
           ELSE y[t + 1] - phi1 * y[t] - phi2 * y[t - 1] END) AS e1 FROM first),
{", ".join(rounds)},
scored AS (SELECT *, {scores} FROM t5),
picked AS (SELECT *, {pick} AS theta FROM scored),
fitted AS (SELECT {keys}, fit, mu, theta, {last("theta", "N")} AS error FROM picked),
params AS (SELECT g.*, a.mu, a.theta, a.error, sqrt(list_avg(list_transform(range(n - t, n),
             lambda i: (x[i + 1] - h.mu - CASE WHEN i = n - t THEN h.theta * h.error ELSE 0.0 END) ** 2)))
             AS rmse, list_var_samp(x) AS variance
           FROM g LEFT JOIN (SELECT * FROM fitted WHERE fit = 'full') a USING ({keys})
           LEFT JOIN (SELECT * FROM fitted WHERE fit = 'held') h USING ({keys}))"""


THREE = "key, profile_key, dow"
KEYS3 = "key, profile_key, CAST(dow AS INTEGER) AS dow"
MA1 = f"{ADJUSTED}, {ma1('adjusted', THREE, 'adjusted')}"
BOUND = "1.959963984540054 * rmse * CASE WHEN step >= {} THEN sqrt(1 + theta * theta) ELSE 1.0 END"


def bounds(first_step: int) -> str:
    b = BOUND.format(first_step)
    return f"""{r("yhat", 3, "yhat")}, {r(f"yhat - {b}", 3, "lo")}, {r(f"yhat + {b}", 3, "hi")},
       {r("rmse", 3, "rmse")}"""


STATUS = "CASE WHEN mu IS NULL THEN 'too_short' ELSE 'ok' END AS status"
YHAT = "mu + CASE WHEN step = 0 THEN theta * error ELSE 0.0 END AS yhat"
ORACLE["forecast_arima"] = f"""{MA1},
steps AS (SELECT *, unnest(range(0, n)) AS step FROM params),
rows AS (SELECT *, tss[step + 1] AS ts, {YHAT} FROM steps)
SELECT {KEYS3}, step, ts, {STATUS}, {bounds(1)} FROM rows"""
ORACLE["forecast_future"] = f"""{HALF_HOURLY}, {ma1("readings", "key", "value")},
steps AS (SELECT *, unnest(range(0, 8)) AS step FROM params),
rows AS (SELECT *, tss[-1] + to_minutes(30 * (step + 1)) AS ts, {YHAT} FROM steps)
SELECT key, step, ts, {STATUS}, {bounds(2)} FROM rows"""
ORACLE["forecast_log"] = f"""{ADJUSTED}
SELECT {KEYS3}, concat('{{"params":"p= 0, d= 0, q= 1, P= 1, D= 1, Q= 0, m= 0","forecast_size":',
       count(*), ',"input_size":', count(*), '}}') AS log
FROM adjusted GROUP BY key, profile_key, dow"""
SQUARE = "(1.959963984540054 * rmse) ** 2 * (1 + theta * theta)"
ORACLE["forecast_models"] = f"""{MA1}
SELECT {KEYS3}, n, t AS n_test, {r("mu", 3, "mu")}, {r("theta", 4, "theta")}, {r("error", 3, "error")},
       {r("rmse", 3, "rmse")}, {r("variance", 2, "variance")},
       {r(f"CASE WHEN variance < 1e-7 THEN {SQUARE} ELSE abs({SQUARE} / variance) END", 3,
          "max_normalized_variance")}
FROM params WHERE n >= 7"""
SCORES = f"n, CASE WHEN n >= 7 THEN t END AS n_test, {STATUS}, {r('rmse', 3, 'rmse')}"
ORACLE["backtest"] = f"{MA1} SELECT {KEYS3}, {SCORES} FROM params"
ORACLE["backtest_users"] = f"""{BY_USER}, {ma1("readings", "key", "value")}
SELECT key, {SCORES} FROM params"""

_AR = " ".join(f"- {c} * x[t + 1 - {k}]" for k, c in q.AR_COEFFICIENTS.items())
_MA = " ".join(f"- ({c}) * e[{k}]" for k, c in q.MA_COEFFICIENTS.items())
_START = max(*q.AR_COEFFICIENTS, *q.MA_COEFFICIENTS)
ORACLE["arma_residuals"] = f"""WITH RECURSIVE {chain(minutes=60)},
g AS (SELECT key, list(value ORDER BY ts) AS x FROM readings GROUP BY key),
walk AS (SELECT key, CAST(-1 AS BIGINT) AS t, [0.0::DOUBLE, 0.0, 0.0] AS e FROM g
         UNION ALL
         SELECT key, t + 1, list_prepend(CASE WHEN t + 1 < {_START} THEN 0.0 ELSE
                (SELECT u FROM (SELECT x[t + 2] {_AR.replace("x[t + 1 -", "x[t + 2 -")} {_MA} AS u)) END,
                e[1:2])
         FROM walk JOIN g USING (key) WHERE t + 1 < len(x)),
placed AS (SELECT key, ts, row_number() OVER (PARTITION BY key ORDER BY ts) - 1 AS i FROM readings)
SELECT key, ts, i, {r("e[1]", 4, "residual")} FROM placed JOIN walk USING (key) WHERE i = t"""
ORACLE["fit_ar"] = f"""{HALF_HOURLY},
c AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY ts) AS i,
      count(*) OVER (PARTITION BY key) AS n, value - avg(value) OVER (PARTITION BY key) AS x FROM readings),
lags AS (SELECT key, n, x, lead(x, 1) OVER w AS x1, lead(x, 2) OVER w AS x2 FROM c
         WINDOW w AS (PARTITION BY key ORDER BY i)),
cov AS (SELECT key, n, sum(x * x) / n AS c0, sum(x * x1) / n AS c1, sum(x * x2) / n AS c2
        FROM lags GROUP BY key, n),
piv AS (SELECT *, c1 / c0 AS l, greatest(c0 - c1 * c1 / c0, c0 / 100) AS d1 FROM cov),
phi AS (SELECT *, (c2 - l * c1) / d1 AS phi2 FROM piv)
SELECT key, n, CAST(1 AS INTEGER) AS lag, {r("c1 / c0 - l * phi2", 4, "phi")} FROM phi
UNION ALL SELECT key, n, CAST(2 AS INTEGER) AS lag, {r("phi2", 4, "phi")} FROM phi"""

GAPS = f"""{HOURLY},
gaps AS (SELECT key, ts, CASE WHEN (hour(ts) + 24 * dayofyear(ts)) % 7 <> 3 THEN value END AS value FROM readings)"""
ORACLE["integrate_twice"] = f"{HOURLY} SELECT key, ts, {r('value', 4, 'integrated')} FROM readings"
ORACLE["integrate_nulls"] = f"""{GAPS},
placed AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts) - 1 AS i,
           value - lag(value, 24) OVER (PARTITION BY key ORDER BY ts) AS diff FROM gaps),
steps AS (SELECT *, CASE WHEN i < 24 THEN coalesce(value, 0.0) ELSE diff END AS step FROM placed)
SELECT key, ts, {r("CASE WHEN step IS NOT NULL THEN sum(step) OVER (PARTITION BY key, i % 24 ORDER BY i) END",
                   4, "integrated")} FROM steps"""
ORACLE["forecast_nulls"] = f"""{GAPS}, known AS (SELECT * FROM gaps WHERE value IS NOT NULL),
{ma1("known", "key", "value")},
steps AS (SELECT *, unnest(range(0, n)) AS step FROM params),
rows AS (SELECT *, tss[step + 1] AS ts, {YHAT} FROM steps)
SELECT key, step, ts, {STATUS}, {bounds(1)} FROM rows"""
ORACLE["difference_far"] = f"""WITH {chain(minutes=1)},
placed AS (SELECT key, ts, row_number() OVER w - 1 AS i, value - lag(value, 17520) OVER w AS diff
           FROM readings WINDOW w AS (PARTITION BY key ORDER BY ts))
SELECT key, ts, i, {r("diff", 4, "diff")} FROM placed WHERE diff IS NOT NULL"""

# Orders of any lag set.
_SEASONAL = f"WITH RECURSIVE {chain(minutes=60)}, {lag_models([q.SEASONAL], 'readings', 24)}"
ORACLE["forecast_seasonal"] = f"""{_SEASONAL},
steps AS (SELECT key, last, unnest(range(0, 24)) AS step FROM ser),
rows AS (SELECT steps.*, y[step + 1] AS yhat, 1.959963984540054 * rmse * wide[step + 1] AS off, rmse
         FROM steps LEFT JOIN (SELECT * FROM path JOIN scores USING (key, o) WHERE NOT held) USING (key))
SELECT key, step, last + to_hours(step + 1) AS ts, CASE WHEN yhat IS NULL THEN 'too_short' ELSE 'ok' END AS status,
       {r("yhat", 3, "yhat")}, {r("yhat - off", 3, "lo")}, {r("yhat + off", 3, "hi")}, {r("rmse", 3, "rmse")}
FROM rows"""
ORACLE["arma_coefficients"] = f"""{_SEASONAL},
cells AS (SELECT key, held, unnest(list_concat(ar, ma)) AS lag, unnest(v) AS coefficient,
                 unnest(range(1, len(v) + 1)) AS number FROM best JOIN fit USING (key, o, held))
SELECT key, held, CAST(number AS INTEGER) AS number, CAST(lag AS INTEGER) AS lag, {r("coefficient", 4, "coefficient")}
FROM cells"""
ORACLE["backtest_seasonal"] = f"""WITH RECURSIVE {chain("user_id", 60)}, {lag_models([q.DAILY], "readings", 1)}
SELECT key, len(ser.x) AS n, tail AS n_test, CASE WHEN rmse IS NULL THEN 'too_short' ELSE 'ok' END AS status,
       {r("rmse", 3, "rmse")} FROM ser LEFT JOIN scores USING (key)"""
ORACLE["auto_arima"] = f"""WITH RECURSIVE {chain(minutes=60)}, {lag_models(q.GRID, "readings", 48)},
counted AS (SELECT key, o, squares, n - {q.GRID_SINCE} AS e, len(v) + 2 AS c
            FROM best JOIN fit USING (key, o, held) WHERE NOT held),
ranked AS (SELECT key, o, sqrt(squares / e) AS sigma, row_number() OVER (PARTITION BY key ORDER BY
             e * ln(greatest(squares / e, 1e-300)) + 2 * c + 2 * c * (c + 1) / (e - c - 1)::DOUBLE, o) AS place
           FROM counted WHERE e - c - 1 >= 1),
steps AS (SELECT key, last, unnest(range(0, 48)) AS step FROM ser),
rows AS (SELECT steps.*, b.*, y[step + 1] AS yhat, 1.959963984540054 * sigma * wide[step + 1] AS off
         FROM steps LEFT JOIN (SELECT ranked.key AS k, orders.* EXCLUDE (lost, r, reach, ar, ma), sigma, y, wide
           FROM ranked JOIN orders USING (o) JOIN path ON path.key = ranked.key AND path.o = ranked.o AND NOT held
           WHERE place = 1) b ON b.k = steps.key)
SELECT key, p, d, q, sp AS seasonal_p, sd AS seasonal_d, sq AS seasonal_q, m, step,
       last + to_hours(step + 1) AS ts, CASE WHEN yhat IS NULL THEN 'too_short' ELSE 'ok' END AS status,
       {r("yhat", 3, "yhat")}, {r("yhat - off", 3, "lo95")}, {r("yhat + off", 3, "hi95")}
FROM rows"""

OWN = f"""{MA1},
steps AS (SELECT *, unnest(range(0, n)) AS step FROM params WHERE key = profile_key AND n >= 7),
forecast AS (SELECT key, tss[step + 1] AS ts, {YHAT} FROM steps)"""
ORACLE["add_peaks"] = ORACLE["decompose"] = f"""{OWN}
SELECT r.key, p.key AS profile_key, r.ts, CAST(p.dow AS INTEGER) AS dow,
       {r("f.yhat + r.value - p.pi", 3, "value")}
FROM forecast f JOIN readings r ON r.key = f.key AND r.ts = f.ts JOIN pi p ON p.key = r.key AND {MATCH}"""
ORACLE["add_peaks_combos"] = f"""{OWN}, ring AS {ring("a, b")},
combos AS (SELECT 'addpeaks1' AS measurement, a AS f_key, a AS p_key, a AS p_profile FROM ring
           UNION ALL SELECT 'addpeaks2', a, a, b FROM ring
           UNION ALL SELECT 'addpeaks3', a, b, b FROM ring
           UNION ALL SELECT 'addpeaks4', a, b, a FROM ring)
SELECT measurement, f_key, f_key AS f_profile, r.key, p.key AS profile_key, r.ts,
       CAST(p.dow AS INTEGER) AS dow, {r("f.yhat + r.value - p.pi", 3, "value")}
FROM forecast f JOIN combos c ON c.f_key = f.key
JOIN readings r ON r.key = c.p_key AND r.ts = f.ts
JOIN pi p ON p.key = c.p_profile AND {MATCH}"""

# Synthetic series ---------------------------------------------------------------------

ASSIGN = f"""{USER_ACTIVITY}, {SEED},
numbered AS (SELECT meter_id, row_number() OVER (ORDER BY meter_id) - 1 AS number
             FROM (SELECT DISTINCT meter_id FROM activity)),
assigned AS (SELECT c_custkey AS id, meter_id FROM customer
             JOIN numbered ON number = c_custkey % (SELECT count(*) FROM numbered)),
plan AS (SELECT id, meter_id, day, hour, day * 24 + hour AS i,
         CAST(DATE '{q.SYNTH_START}' + to_days(CAST(day AS INTEGER)) AS DATE) AS date
         FROM assigned, (SELECT unnest(range({q.SYNTH_DAYS})) AS day) d,
         (SELECT unnest(range(24)) AS hour) h),
hours AS (SELECT plan.*, temp FROM plan JOIN seed ON seed.i = plan.i % (SELECT count(*) FROM seed)),
low AS (SELECT id, min(temp) AS x0 FROM hours GROUP BY id)"""


def curve(temp: str, x0: str) -> str:
    a, b, c = -0.0059, 0.0155, 0.2233
    x1, x2, y0 = q.CURVE["x1"], q.CURVE["x2"], q.CURVE["y0"]
    knee = f"(({a}) * ({x1} - {x0}) + {y0})"
    return f"""least(greatest(CASE WHEN {temp} < {x1} THEN ({a}) * ({temp} - {x0}) + {y0}
  WHEN {temp} < {x2} THEN {b} * ({temp} - {x1}) + {knee}
  ELSE {c} * ({temp} - {x2}) + {b} * ({x2} - {x1}) + {knee} END, 0.0), 0.2)"""


AT = "id, date, CAST(hour AS INTEGER) AS hour"
ORACLE["synth_assign"] = f"{ASSIGN} SELECT id, meter_id FROM assigned"
ORACLE["synth_ids"] = "SELECT row_number() OVER () - 1 AS id FROM customer"
ORACLE["synth_grid"] = f"""{ASSIGN}
SELECT id, CAST(day AS INTEGER) AS day, date, CAST(hour AS INTEGER) AS hour, CAST(i AS INTEGER) AS i FROM plan"""
ORACLE["synth_temperature"] = f"{ASSIGN} SELECT {AT}, {r('temp', 4, 'temp')} FROM hours"
ORACLE["synth_temperature_wrapped"] = f"""WITH {SEED},
plan AS (SELECT n_nationkey AS id, day * 24 + hour AS i, hour,
         CAST(DATE '{q.SYNTH_START}' + to_days(CAST(day AS INTEGER)) AS DATE) AS date
         FROM nation, (SELECT unnest(range({q.WRAP_DAYS})) AS day) d, (SELECT unnest(range(24)) AS hour) h)
SELECT {AT}, {r('temp', 4, 'temp')}
FROM plan JOIN seed ON seed.i = plan.i % (SELECT count(*) FROM seed)"""
ORACLE["thermal_load"] = f"""{ASSIGN}
SELECT {AT}, {r(curve("temp", "x0"), 4, "thermal")} FROM hours JOIN low USING (id)"""
ORACLE["thermal_load_weather"] = f"""{USER_WEATHER},
low AS (SELECT meter_id, min(temperature) AS x0 FROM weather GROUP BY meter_id)
SELECT meter_id, date, CAST(hour AS INTEGER) AS hour, {r(curve("temperature", "x0"), 4, "thermal")}
FROM weather JOIN low USING (meter_id)"""
ORACLE["synth_activity"] = f"""{ASSIGN}
SELECT {AT}, {r("greatest(mean, 0.0)", 4, "activity")}
FROM plan JOIN activity USING (meter_id, hour)"""
LOADS = f"""{ASSIGN},
loads AS (SELECT hours.*, greatest(mean, 0.0) + {curve("temp", "x0")} AS load
          FROM hours JOIN low USING (id) JOIN activity USING (meter_id, hour)),
daily AS (SELECT *, avg(load) OVER (PARTITION BY id, day) AS m FROM loads),
made AS (SELECT *, CASE WHEN load > m THEN m + (load - m) * {q.PEAKY} ELSE load END AS peak FROM daily)"""
ORACLE["synth_readings"] = f"""{LOADS}
SELECT {AT}, {r("peak", 4, "load")}, {r("temp", 4, "temp")} FROM made"""


def draw(purpose: str, *what: str) -> str:
    """The hash behind the noise, in whole numbers."""
    halves = [str(crc32(purpose.encode()))]
    for value in what:
        halves += [f"{value} & 4294967295", f"({value} >> 32) & 4294967295"]
    steps = ", ".join(f"CAST({half} AS BIGINT), 0" for half in halves)
    h = "xor(h, v)"
    return f"list_reduce([{q.NOISE_SEED}::BIGINT, {steps}, 0], lambda h, v: (xor({h} >> 16, {h}) * 73244475) & 4294967295)"


def uniform(purpose: str, *what: str) -> str:
    return f"(({draw(purpose, *what)} + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def gaussian(purpose: str, *what: str) -> str:
    u, v = uniform(f"{purpose} radius", *what), uniform(f"{purpose} angle", *what)
    return f"(sqrt(-2.0 * ln({u})) * cos(2.0::DOUBLE * pi() * {v}))"


DRAWN = ASSIGN.replace(
    "JOIN numbered ON number = c_custkey %", f"JOIN numbered ON number = {draw('profile', 'c_custkey')} %"
)
ORACLE["synth_assign_random"] = f"{DRAWN} SELECT id, meter_id FROM assigned"
ORACLE["synth_temperature_noisy"] = f"""WITH {SEED},
plan AS (SELECT c_custkey AS id, CAST(day * 24 + hour AS BIGINT) AS i,
         CAST(DATE '{q.SYNTH_START}' + to_days(CAST(day AS INTEGER)) AS DATE) AS date
         FROM customer, (SELECT unnest(range({q.WRAP_DAYS})) AS day) d, (SELECT unnest(range(24)) AS hour) h),
hours AS (SELECT id, date, temp + 2.0 * {gaussian("temperature", "id", "plan.i")} AS temp
          FROM plan JOIN seed ON seed.i = plan.i % (SELECT count(*) FROM seed))
SELECT id, date, {r("avg(temp)", 6, "mean")}, {r("max(temp)", 6, "highest")} FROM hours GROUP BY id, date"""
ORACLE["synth_readings_random"] = f"""{DRAWN},
noisy AS (SELECT id, meter_id, day, date, hour, i, temp + 2.0 * {gaussian("temperature", "id", "i")} AS temp FROM hours),
breaks AS (SELECT id, 10 + floor({uniform("first break", "id")} * 6) AS x1,
           floor({uniform("second break", "id")} * 9) AS gap, abs({gaussian("base load", "id")} / 1.5) AS y0
           FROM assigned),
drawn AS (SELECT id, x1, x1 + 4 + gap AS x2, y0 FROM breaks),
lowest AS (SELECT id, min(temp) AS x0 FROM noisy GROUP BY id),
loads AS (SELECT n.*, greatest(mean + 0.1 * {gaussian("activity", "n.id", "n.i")}, 0.0)
            + least(greatest(CASE WHEN temp < x1 THEN -0.0059 * (temp - x0) + y0
                WHEN temp < x2 THEN 0.0155 * (temp - x1) + (-0.0059 * (x1 - x0) + y0)
                ELSE 0.2233 * (temp - x2) + 0.0155 * (x2 - x1) + (-0.0059 * (x1 - x0) + y0) END, 0.0), 0.2) AS load
          FROM noisy n JOIN drawn USING (id) JOIN lowest USING (id) JOIN activity USING (meter_id, hour)),
daily AS (SELECT *, avg(load) OVER (PARTITION BY id, day) AS m FROM loads),
made AS (SELECT *, CASE WHEN load > m THEN m + (load - m) * {q.PEAKY} ELSE load END AS peak FROM daily)
SELECT {AT}, {r("peak", 6, "load")}, {r("temp", 6, "temp")} FROM made"""
ORACLE["write_synthetic"] = f"""{LOADS}
SELECT printf('%d|%s %d:00:00|%.6f|%.6f', id, strftime(date, '%Y-%m-%d'), hour,
              round(peak, 4) + 0.0, round(temp, 4) + 0.0) AS value FROM made"""
ORACLE["peak_amplify"] = f"""{HALF_HOURLY},
daily AS (SELECT *, avg(value) OVER (PARTITION BY key, CAST(ts AS DATE)) AS m FROM readings)
SELECT key, ts, {r(f"CASE WHEN value > m THEN m + (value - m) * {q.PEAKY} ELSE value END", 7, "load")}
FROM daily"""

# Text and sinks -----------------------------------------------------------------------

COUNTS = r"""
SELECT word, count(*) AS count
FROM (SELECT unnest(regexp_split_to_array(lower(text), '\W+')) AS word FROM documents)
WHERE length(word) > 0 GROUP BY word"""
ORACLE["wordcount"] = ORACLE["stream_wordcount"] = COUNTS
ORACLE["tokens"] = r"""
SELECT word, CAST(1 AS INTEGER) AS count
FROM (SELECT unnest(regexp_split_to_array(lower(text), '\W+')) AS word FROM conversations)
WHERE length(word) > 0"""
ORACLE["to_line_protocol"] = f"""{HALF_HOURLY}
SELECT printf('energy,key=%s value=%.2f %d', key, value, epoch_ms(ts)) AS value FROM readings"""
ORACLE["write_line_batches"] = f"SELECT value, true AS within FROM ({ORACLE['to_line_protocol']})"
ORACLE["point_to_csv"] = f"""{HALF_HOURLY}
SELECT printf('%d,%s,%.2f', epoch_ms(ts), key, value) AS value FROM readings"""
ORACLE["write_points"] = f"""{HALF_HOURLY}
SELECT concat('m_', key) AS measurement, key, epoch_ms(ts) AS ts_ms, {r("value", 4, "value")} FROM readings"""
ORACLE["stream_points"] = f"""{HALF_HOURLY}
SELECT 'energy' AS measurement, key, epoch_ms(ts) AS ts_ms, {r("value", 4, "value")} FROM readings"""

# Streams: windows closed by a watermark one part and a day behind the last reading ------

CLOSED = f"""ts + INTERVAL 120 MINUTE <= (
    SELECT max(ts) - to_days(CAST(1 + greatest(1, ceil(date_diff('second', min(ts), max(ts))
                                  / 86400.0 / {q.STREAM_PARTS})) AS INTEGER)) FROM readings)"""
ORACLE["stream_moving_average"] = f"""{HALF_HOURLY}
SELECT key, ts, {r("ma", 6, "ma")} FROM ma WHERE {CLOSED}"""
ORACLE["stream_raw_index"] = f"""{HALF_HOURLY}
SELECT key, ts, {r("ri", 6, "ri")} FROM ri WHERE {CLOSED}"""
ORACLE["stream_count_trigger"] = ORACLE["moving_average"]
ORACLE["stream_periodic_index"] = ORACLE["periodic_index"]
ORACLE["stream_peaks"] = f"""{HALF_HOURLY}
SELECT r.key, r.ts, CAST(p.dow AS INTEGER) AS dow, {r("r.value - p.pi", 4, "peak")}
FROM readings r JOIN pi p ON r.key = p.key AND {MATCH}"""
ORACLE["stream_adjusted"] = f"""{ADJUSTED}
SELECT key, ts, CAST(dow AS INTEGER) AS dow, {r("adjusted", 4, "adjusted")}
FROM adjusted WHERE key = profile_key"""
ALIGNED = "hour(ts) % 2 = 0 AND minute(ts) = 0"
ORACLE["stream_raw_index_aligned"] = f"""{HALF_HOURLY}
SELECT key, ts, {r("ri", 6, "ri")} FROM ri WHERE {CLOSED} AND {ALIGNED}"""
ORACLE["stream_peaks_paired"] = ORACLE["peaks_paired"]
ORACLE["stream_adjusted_paired"] = ORACLE["adjusted_series_paired"]
ORACLE["stream_add_peaks"] = ORACLE["add_peaks"]
PASSED = CLOSED.replace("ts + INTERVAL 120 MINUTE <=", "f.ts <=")
ORACLE["stream_join_forecast"] = f"""{OWN},
tops AS (SELECT r.key, r.ts, r.value - p.pi AS peak FROM readings r JOIN pi p ON r.key = p.key AND {MATCH}
         WHERE hour(r.ts) % 3 <> 1)
SELECT f.key, f.key AS profile_key, f.ts, CAST(dayofweek(f.ts) + 1 AS INTEGER) AS dow,
       {r("yhat + peak", 3, "value")}
FROM forecast f LEFT JOIN tops USING (key, ts) WHERE peak IS NOT NULL OR {PASSED}"""
ORACLE["stream_profile_versions"] = ORACLE["periodic_index"]
ORACLE["stream_lines"] = COUNTS
ORACLE["read_dayslot_mixed"] = ORACLE["stream_dayslot"] = f"""
SELECT event_type AS key, CASE WHEN event_id % 3 <> 0 THEN
       TIMESTAMP '2009-01-01' + to_days(CAST(dayofyear(ts) - 1 AS INTEGER))
       + to_minutes(30 * ((hour(ts) * 60 + minute(ts)) // 30 + 1)) END AS ts,
       CASE WHEN event_id % 3 = 0 THEN printf('x%03d%02d', dayofyear(ts),
                 (hour(ts) * 60 + minute(ts)) // 30 + 1) END AS code, {r("value", 2, "value")}
FROM events"""
NAMED = "CASE WHEN r.key = p.key THEN r.key ELSE concat(r.key, '/', p.key) END"
ORACLE["stream_decompose"] = f"""{OWN}, ring AS {ring("a, b")},
crossed AS (SELECT DISTINCT * FROM (SELECT * FROM pairs UNION ALL SELECT b, a FROM ring)),
combos AS (SELECT 'addpeaks1' AS measurement, a AS f_key, a AS p_key, a AS p_profile FROM ring
           UNION ALL SELECT 'addpeaks2', a, a, b FROM ring
           UNION ALL SELECT 'addpeaks3', a, b, b FROM ring
           UNION ALL SELECT 'addpeaks4', a, b, a FROM ring),
tops AS (SELECT {NAMED} AS name, r.key, p.key AS profile_key, r.ts, r.value, p.pi
         FROM readings r JOIN crossed c USING (key) JOIN pi p ON p.key = c.profile_key AND {MATCH}),
points AS (SELECT 'average' AS measurement, key, ts, ma AS x FROM ma WHERE {CLOSED}
  UNION ALL SELECT 'index', key, ts, ri FROM ri WHERE {CLOSED} AND {ALIGNED}
  UNION ALL SELECT 'peaks', name, ts, value - pi FROM tops
  UNION ALL SELECT 'adjusted', name, ts, value / pi FROM tops WHERE pi <> 0
  UNION ALL SELECT c.measurement, t.name, t.ts, f.yhat + t.value - t.pi
  FROM forecast f JOIN combos c ON c.f_key = f.key
  JOIN tops t ON t.key = c.p_key AND t.profile_key = c.p_profile AND t.ts = f.ts)
SELECT measurement, key, epoch_ms(ts) AS ts_ms, {r("x", 5, "value")} FROM points"""
