"""Independent DuckDB SQL for every registered query (the correctness oracle).

Written directly from the rules, not from the Spark code: gap filling uses a
calendar spine join (Spark uses ``lead`` + ``sequence``), correlations use
DuckDB's ``corr``, p-values use the closed ``lgamma`` form of the series
coefficients (Spark sums them recursively), and so on.  The driver
pre-registers every table as a view.
"""

from __future__ import annotations

SUM_TYPES = "('click', 'purchase')"


def rnd(expr: str, digits: int) -> str:
    """HALF_UP rounding of the shortest decimal text of the double, float noise
    beyond the 9th decimal cleared first: the same rule as the
    Spark side.  DuckDB's own double ``round`` and double->DECIMAL cast scale
    in floating point and can round exact ties the other way."""
    return f"CAST(round(CAST(CAST(({expr}) AS VARCHAR) AS DECIMAL(38, 9)), {digits}) AS DOUBLE)"

# Daily series of the events stand-in: zero-filled sums for click/purchase,
# sparse means for the rest.
def ev_daily(name: str = "daily") -> str:
    return f"""
ev_day AS (
  SELECT user_id AS subject_id, event_type AS metric, CAST(ts AS DATE) AS date,
         avg(value) AS mean_v, sum(value) AS sum_v
  FROM events WHERE ts IS NOT NULL
  GROUP BY 1, 2, 3),
ev_span AS (
  SELECT subject_id, metric, min(date) AS lo, max(date) AS hi
  FROM ev_day WHERE metric IN {SUM_TYPES} GROUP BY 1, 2),
ev_spine AS (
  SELECT subject_id, metric,
         CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date
  FROM ev_span),
{name} AS (
  SELECT s.subject_id, s.metric, s.date, coalesce(d.sum_v, 0.0) AS value
  FROM ev_spine s LEFT JOIN ev_day d USING (subject_id, metric, date)
  UNION ALL
  SELECT subject_id, metric, date, mean_v AS value FROM ev_day
  WHERE metric NOT IN {SUM_TYPES} AND mean_v IS NOT NULL)
"""


EV_DAILY = ev_daily()

ORD_DAILY = """
daily AS (
  SELECT CAST(0 AS BIGINT) AS subject_id, o_orderpriority AS metric,
         CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS value
  FROM orders WHERE o_orderdate IS NOT NULL
  GROUP BY 1, 2, 3 HAVING avg(o_totalprice) IS NOT NULL)
"""


def anomalies_select(src: str, thr: float = 2.0) -> str:
    return f"""
SELECT subject_id, date, metric,
       {rnd("value", 2)} AS value, {rnd("mu", 2)} AS rolling_mean, {rnd("sd", 2)} AS rolling_std,
       {rnd(f"mu - {thr} * sd", 2)} AS expected_low, {rnd(f"mu + {thr} * sd", 2)} AS expected_high,
       {rnd("dev", 2)} AS deviation_sigma,
       CASE WHEN dev >= {thr + 1.5} THEN 'critical'
            WHEN dev >= {thr + 0.5} THEN 'high' ELSE 'moderate' END AS severity
FROM (
  SELECT *, abs(value - mu) / sd AS dev
  FROM (
    SELECT subject_id, metric, date, value,
           count(*) OVER (PARTITION BY subject_id, metric) AS npts,
           count(value) OVER w AS c,
           avg(value) OVER w AS mu,
           stddev_samp(value) OVER w AS sd
    FROM {src}
    WINDOW w AS (PARTITION BY subject_id, metric ORDER BY date
                 ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) b
  WHERE npts >= 10 AND c >= 7 AND sd IS NOT NULL AND sd <> 0) f
WHERE dev >= {thr}
"""


def anomalies_sql(daily_cte: str, thr: float = 2.0) -> str:
    return f"WITH {daily_cte} {anomalies_select('daily', thr)}"


def rolling_sql(daily_cte: str) -> str:
    def gated(n):
        mp = max(1, n // 3)
        return (f"CASE WHEN count(value) OVER (PARTITION BY subject_id, metric ORDER BY date "
                f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) >= {mp} THEN "
                f"avg(value) OVER (PARTITION BY subject_id, metric ORDER BY date "
                f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END")
    return f"""
WITH {daily_cte}
SELECT subject_id, metric, date, {rnd("value", 4)} AS raw,
       {rnd(gated(7), 4)} AS rolling_7, {rnd(gated(30), 4)} AS rolling_30,
       {rnd(gated(90), 4)} AS rolling_90
FROM daily
"""


# Per-series summary: positions counted from the newest day (rn = 1).
def stats_ctes(src: str) -> str:
    return f"""
rk AS (
  SELECT *, row_number() OVER (PARTITION BY subject_id, metric ORDER BY date DESC) AS rn
  FROM {src}),
st AS (
  SELECT subject_id, metric, count(*) AS n_points,
         arg_max(value, date) AS cur,
         avg(value) FILTER (WHERE rn <= 7) AS avg7,
         min(value) FILTER (WHERE rn <= 7) AS min7,
         max(value) FILTER (WHERE rn <= 7) AS max7,
         avg(value) FILTER (WHERE rn <= 90) AS avg90,
         count(*) FILTER (WHERE rn <= 30) AS n30,
         regr_slope(value, 30.0 - rn) FILTER (WHERE rn <= 30) AS slope,
         stddev_pop(value) FILTER (WHERE rn <= 30) AS sd
  FROM rk GROUP BY 1, 2),
tr AS (
  SELECT *,
         CASE WHEN n30 < 7 THEN 'insufficient_data'
              WHEN sd = 0 THEN 'stable'
              WHEN abs(slope / sd) < 0.1 THEN 'stable'
              WHEN slope / sd > 0 THEN 'increasing' ELSE 'decreasing' END AS trend_raw
  FROM st),
tl AS (
  SELECT *,
         CASE WHEN trend_raw IN ('stable', 'insufficient_data') THEN trend_raw
              WHEN metric IN ('click', 'purchase', 'signup', 'sleep_duration')
                   THEN CASE WHEN trend_raw = 'increasing' THEN 'improving' ELSE 'declining' END
              WHEN metric IN ('error')
                   THEN CASE WHEN trend_raw = 'decreasing' THEN 'improving' ELSE 'declining' END
              ELSE trend_raw END AS direction
  FROM tr)
"""


EV_STATS = f"{EV_DAILY}, {stats_ctes('daily')}"

EV_ANOM = f"ev_anom AS ({anomalies_sql(EV_DAILY)})"
EV_AS_OF = "DATE '2024-01-31'"

# -- sleep, workouts, correlations ------------------------------------------------

def sleep_ctes(subj: str = "user_id") -> str:
    return f"""
sl AS (
  SELECT {subj} AS subject_id, ts AS s,
         ts + to_minutes(CAST(floor(value) AS BIGINT)) AS e,
         CAST(event_id % 7 AS DOUBLE) AS code
  FROM events WHERE event_type = 'view'),
sl2 AS (
  SELECT subject_id, CAST(s AS DATE) - CASE WHEN hour(s) < 18 THEN 1 ELSE 0 END AS night, code,
         CASE WHEN code = 0 THEN 'in_bed' WHEN code = 1 THEN 'asleep_unspecified'
              WHEN code = 2 THEN 'awake' WHEN code = 3 THEN 'core' WHEN code = 4 THEN 'deep'
              WHEN code = 5 THEN 'rem' ELSE 'unknown' END AS stage,
         (epoch_us(e) - epoch_us(s)) / 3600000000.0 AS hrs
  FROM sl),
sflag AS (SELECT subject_id, count(DISTINCT code) > 2 AS has_stages FROM sl2 GROUP BY 1),
skept AS (
  SELECT sl2.*, sflag.has_stages FROM sl2 JOIN sflag USING (subject_id)
  WHERE night IS NOT NULL AND (NOT has_stages OR stage NOT IN ('in_bed', 'awake'))),
sn AS (SELECT subject_id, night AS date, coalesce(sum(hrs), 0.0) AS value FROM skept GROUP BY 1, 2)
"""


WORKOUT_CTE = """
wt AS (
  SELECT user_id AS subject_id,
         replace(coalesce('HKWorkoutActivityType' || CAST(event_id % 4 AS VARCHAR), 'None'),
                 'HKWorkoutActivityType', '') AS activity,
         value AS d, ts
  FROM events WHERE event_type = 'purchase')
"""


def p_value_sql(r: str, n: str) -> str:
    """Two-sided Pearson p from the t distribution, series coefficients in
    closed form via lgamma."""
    df = f"(({n}) - 2)"
    s = f"abs({r})"
    c2 = f"(1.0 - ({r}) * ({r}))"
    even = (f"{s} * list_sum(list_transform(range(0, ({df} - 2) // 2 + 1), "
            f"lambda k: exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1)) * pow({c2}, k)))")
    odd = (f"2.0 / pi() * (asin({s}) + {s} * sqrt({c2}) * list_sum(list_transform("
           f"range(0, ({df} - 3) // 2 + 1), "
           f"lambda k: exp(lgamma(k + 1) + lgamma(1.5) - lgamma(k + 1.5)) * pow({c2}, k))))")
    cdf = f"CASE WHEN {df} = 1 THEN 2.0 / pi() * asin({s}) WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END"
    return f"CASE WHEN {s} >= 1 THEN 0.0 ELSE greatest(0.0, 1.0 - ({cdf})) END"


def corr_ctes(subj: str) -> str:
    return f"""
ms AS (
  SELECT {subj} AS subject_id, event_type AS metric, CAST(ts AS DATE) AS date, avg(value) AS value
  FROM events WHERE event_type IN ('signup', 'error', 'click') AND ts IS NOT NULL GROUP BY 1, 2, 3),
hrv AS (SELECT subject_id, date, value FROM ms WHERE metric = 'signup' AND value IS NOT NULL),
rhr AS (SELECT subject_id, date, value FROM ms WHERE metric = 'error' AND value IS NOT NULL),
tmp AS (SELECT subject_id, date, value FROM ms WHERE metric = 'click' AND value IS NOT NULL),
wk AS (SELECT {subj} AS subject_id, ts, value AS duration FROM events
       WHERE event_type = 'purchase' AND ts IS NOT NULL),
wi AS (SELECT subject_id, CAST(ts AS DATE) AS date, avg(duration) AS value FROM wk GROUP BY 1, 2),
we AS (SELECT subject_id, CAST(ts AS DATE) AS date, avg(duration) AS value FROM wk
       WHERE hour(ts) >= 18 GROUP BY 1, 2),
hrv_prev AS (SELECT subject_id, CAST(date - INTERVAL 1 DAY AS DATE) AS date, value FROM hrv),
rhr_prev AS (SELECT subject_id, CAST(date - INTERVAL 1 DAY AS DATE) AS date, value FROM rhr),
tdev AS (
  SELECT subject_id, date,
         value - CASE WHEN count(value) OVER w >= 7 THEN avg(value) OVER w END AS value
  FROM tmp WINDOW w AS (PARTITION BY subject_id ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
rdev AS (
  SELECT subject_id, date,
         value - CASE WHEN count(value) OVER w >= 7 THEN avg(value) OVER w END AS value
  FROM rhr WINDOW w AS (PARTITION BY subject_id ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
{sleep_ctes(subj)}
"""


def pearson_sql(rel: str, x: str, y: str) -> str:
    return f"""
SELECT p.subject_id, '{rel}' AS relationship,
       CASE WHEN coalesce(st.n, 0) >= 5 THEN {rnd("st.r", 4)} END AS r,
       CASE WHEN coalesce(st.n, 0) >= 5 AND st.r IS NOT NULL THEN {rnd(p_value_sql("st.r", "st.n"), 6)} END AS p,
       coalesce(st.n, 0) AS n
FROM (SELECT DISTINCT subject_id FROM {x} INTERSECT SELECT DISTINCT subject_id FROM {y}) p
LEFT JOIN (
  SELECT a.subject_id, count(*) AS n,
         CASE WHEN isnan(corr(a.value, b.value)) THEN NULL ELSE corr(a.value, b.value) END AS r
  FROM {x} a JOIN {y} b USING (subject_id, date)
  WHERE a.value IS NOT NULL AND b.value IS NOT NULL
  GROUP BY 1) st USING (subject_id)
"""


CORR_RELATIONS = [
    ("workout_intensity_vs_next_day_hrv", "wi", "hrv_prev"),
    ("sleep_duration_vs_next_day_rhr", "sn", "rhr_prev"),
    ("evening_workout_vs_sleep_quality", "we", "sn"),
    ("wrist_temp_deviation_vs_rhr_change", "tdev", "rdev"),
]


def corr_sql(index: int, subj: str = "user_id") -> str:
    rel, x, y = CORR_RELATIONS[index]
    return f"WITH {corr_ctes(subj)} {pearson_sql(rel, x, y)}"


def corr_all_sql(subj: str) -> str:
    body = " UNION ALL ".join(f"({pearson_sql(rel, x, y)})" for rel, x, y in CORR_RELATIONS)
    return f"WITH {corr_ctes(subj)} {body}"


# -- snapshot history: as-of figures by joining every report week to all days
# up to its Sunday (a non-equi join; the Spark side uses one window pass).

LAST_WEEK = "DATE '2024-01-29'"
POLARITY_CASE = """
CASE WHEN trend_raw IN ('stable', 'insufficient_data') THEN trend_raw
     WHEN metric IN ('click', 'purchase', 'signup', 'sleep_duration')
          THEN CASE WHEN trend_raw = 'increasing' THEN 'improving' ELSE 'declining' END
     WHEN metric IN ('error')
          THEN CASE WHEN trend_raw = 'decreasing' THEN 'improving' ELSE 'declining' END
     ELSE trend_raw END"""
UNIT_CASE = """
CASE metric WHEN 'click' THEN 'clicks' WHEN 'purchase' THEN 'usd' WHEN 'error' THEN 'errors'
            WHEN 'signup' THEN 'signups' WHEN 'view' THEN 'min' WHEN 'sleep_duration' THEN 'hrs'
            ELSE '' END"""

FULL_BASE = f"""
{ev_daily('evd')}, {sleep_ctes()},
dall AS (
  SELECT subject_id, metric, date, value FROM evd
  UNION ALL SELECT subject_id, 'sleep_duration' AS metric, date, value FROM sn)
"""

SNAP_CTES = f"""
{FULL_BASE},
fl AS (
  SELECT subject_id, metric, date, value,
         coalesce(count(value) OVER w >= 7 AND stddev_samp(value) OVER w <> 0
                  AND abs(value - avg(value) OVER w) / stddev_samp(value) OVER w >= 2.0, false) AS flag
  FROM dall
  WINDOW w AS (PARTITION BY subject_id, metric ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
ser AS (
  SELECT subject_id, metric, CAST(date_trunc('week', min(date)) AS DATE) AS fw FROM dall GROUP BY 1, 2),
sw AS (
  SELECT subject_id, metric,
         CAST(unnest(generate_series(fw, {LAST_WEEK}, INTERVAL 7 DAY)) AS DATE) AS week
  FROM ser WHERE fw <= {LAST_WEEK}),
upto AS (
  SELECT sw.subject_id, sw.metric, sw.week, f.date, f.value, f.flag,
         row_number() OVER (PARTITION BY sw.subject_id, sw.metric, sw.week ORDER BY f.date DESC) AS rn
  FROM sw JOIN fl f
    ON f.subject_id = sw.subject_id AND f.metric = sw.metric AND f.date <= sw.week + 6),
snap0 AS (
  SELECT subject_id, metric, week, count(*) AS npts, arg_max(value, date) AS cur,
         avg(value) FILTER (WHERE rn <= 7) AS avg7,
         min(value) FILTER (WHERE rn <= 7) AS min7,
         max(value) FILTER (WHERE rn <= 7) AS max7,
         avg(value) FILTER (WHERE rn <= 90) AS avg90,
         count(*) FILTER (WHERE rn <= 30) AS n30,
         regr_slope(value, -1.0 * rn) FILTER (WHERE rn <= 30) AS slope,
         stddev_pop(value) FILTER (WHERE rn <= 30) AS sd,
         count(*) FILTER (WHERE flag) AS nflags
  FROM upto GROUP BY 1, 2, 3),
snap1 AS (
  SELECT *, CASE WHEN n30 < 7 THEN 'insufficient_data' WHEN sd = 0 THEN 'stable'
                 WHEN abs(slope / sd) < 0.1 THEN 'stable'
                 WHEN slope / sd > 0 THEN 'increasing' ELSE 'decreasing' END AS trend_raw
  FROM snap0),
runs0 AS (
  SELECT subject_id, week,
         CAST(sum(CASE WHEN npts >= 10 THEN nflags ELSE 0 END) AS BIGINT) AS anomaly_count
  FROM snap0 GROUP BY 1, 2),
wo AS (SELECT user_id AS subject_id, ts, value AS d FROM events WHERE event_type = 'purchase' AND ts IS NOT NULL),
run_w AS (
  SELECT r.subject_id, r.week, count(w.ts) AS wn, coalesce(sum(w.d), 0.0) AS wmin
  FROM runs0 r LEFT JOIN wo w ON w.subject_id = r.subject_id AND CAST(w.ts AS DATE) <= r.week + 6
  GROUP BY 1, 2),
run_i AS (
  SELECT r.subject_id, r.week, count(w.ts) AS wiw
  FROM runs0 r LEFT JOIN wo w ON w.subject_id = r.subject_id AND CAST(date_trunc('week', w.ts) AS DATE) = r.week
  GROUP BY 1, 2),
run_s AS (
  SELECT r.subject_id, r.week, avg(s.value) AS savg
  FROM runs0 r LEFT JOIN sn s ON s.subject_id = r.subject_id AND s.date <= r.week + 6
  GROUP BY 1, 2),
runs AS (
  SELECT r.subject_id, r.week,
         row_number() OVER (PARTITION BY r.subject_id ORDER BY r.week) AS run_number,
         r.anomaly_count, w.wn AS workout_count, {rnd("w.wmin / 60", 1)} AS workout_duration_hrs,
         i.wiw AS workouts_in_week, {rnd("s.savg", 2)} AS sleep_avg_hrs
  FROM runs0 r JOIN run_w w USING (subject_id, week) JOIN run_i i USING (subject_id, week)
       JOIN run_s s USING (subject_id, week)),
sm AS (
  SELECT s.subject_id, s.week, s.metric, {rnd("s.avg7", 2)} AS avg, {rnd("s.cur", 2)} AS current,
         {rnd("s.min7", 2)} AS min, {rnd("s.max7", 2)} AS max, {rnd("s.avg90", 2)} AS avg_90d,
         {POLARITY_CASE} AS direction, {UNIT_CASE} AS unit, r.run_number
  FROM snap1 s JOIN runs r USING (subject_id, week)),
last4 AS (
  SELECT *, count(*) OVER (PARTITION BY subject_id) AS nruns,
         row_number() OVER (PARTITION BY subject_id ORDER BY run_number DESC) AS k
  FROM runs),
recent AS (SELECT *, least(nruns, 4) AS weeks_covered FROM last4 WHERE k <= 4 AND nruns >= 2)
"""


def unit_case(col: str) -> str:
    return UNIT_CASE.replace("CASE metric", f"CASE {col}")


def display_sql(col: str) -> str:
    """Title case after '_' -> ' ': upper-case a letter at the start or after a non-letter."""
    s = f"replace({col}, '_', ' ')"
    return (f"array_to_string(list_transform(range(1, length({s}) + 1), lambda i: "
            f"CASE WHEN i = 1 OR NOT regexp_matches(substr({s}, i - 1, 1), '[A-Za-z]') "
            f"THEN upper(substr({s}, i, 1)) ELSE lower(substr({s}, i, 1)) END), '')")


def arrow_sql(col: str) -> str:
    k = f"lower(trim({col}))"
    return (f"CASE WHEN {k} IN ('up', 'increasing', 'rising') THEN 'up' "
            f"WHEN {k} IN ('down', 'decreasing', 'falling') THEN 'down' ELSE 'flat' END")


WOW_PAIRS = f"""
wow_pairs AS (
  SELECT c.subject_id, c.week, c.metric, c.unit, c.avg AS current_avg, p.avg AS previous_avg,
         {rnd("c.avg - p.avg", 2)} AS delta
  FROM sm c JOIN sm p
    ON c.subject_id = p.subject_id AND c.metric = p.metric AND c.run_number = p.run_number + 1
  WHERE c.avg IS NOT NULL AND p.avg IS NOT NULL),
wow AS (
  SELECT subject_id, week, metric, delta,
         CASE WHEN previous_avg = 0 THEN 0.0 ELSE {rnd("delta / previous_avg * 100", 1)} END AS pct_change,
         CASE WHEN abs(delta) < 0.01 THEN 'unchanged' WHEN delta > 0 THEN 'up' ELSE 'down' END AS direction,
         unit, current_avg, previous_avg
  FROM wow_pairs)
"""

REPORT_CTES = f"""
{SNAP_CTES}, {stats_ctes('dall')}, {WOW_PAIRS},
fan AS ({anomalies_select('dall')}),
tsum AS (
  SELECT subject_id, metric, direction, {rnd("cur", 2)} AS current_value, {rnd("avg90", 2)} AS avg_90d,
         CASE WHEN avg90 = 0 THEN NULL ELSE {rnd("(cur - avg90) / avg90 * 100", 1)} END AS pct_vs_90d
  FROM tl)
"""


def context_sql() -> str:
    corr_union = " UNION ALL ".join(f"({pearson_sql(rel, x, y)})" for rel, x, y in CORR_RELATIONS)
    nl = "chr(10)"
    trend_line = (
        "'• **' || metric || '**: trend is **' || direction || '**' || "
        "CASE WHEN current_value IS NOT NULL THEN ' (current: ' || printf('%.1f', " + rnd("current_value", 1) + ") || "
        "CASE WHEN avg_90d IS NOT NULL THEN ' vs 90d avg: ' || printf('%.1f', " + rnd("avg_90d", 1) + ") ELSE '' END || ')' "
        "ELSE '' END || "
        "CASE WHEN pct_vs_90d IS NOT NULL THEN ', ' || printf('%+.1f', " + rnd("pct_vs_90d", 1) + ") || '% vs 90d avg' ELSE '' END")
    return f"""
WITH {REPORT_CTES}, {corr_ctes('user_id').replace(sleep_ctes('user_id'), '').rstrip().rstrip(',')},
cor AS ({corr_union}),
topa AS (
  SELECT *, row_number() OVER (PARTITION BY subject_id, metric ORDER BY date DESC) AS k,
         count(*) OVER (PARTITION BY subject_id, metric) AS n_readings
  FROM fan),
lines AS (
  SELECT subject_id, 1 AS sec, metric, 0 AS k, {trend_line} AS line FROM tsum
  UNION ALL
  SELECT subject_id, 2, metric, 0,
         '• **' || metric || '** — ' || CAST(n_readings AS VARCHAR) || ' anomalous reading(s):'
  FROM topa WHERE k = 1
  UNION ALL
  SELECT subject_id, 2, metric, k,
         '  – ' || strftime(date, '%Y-%m-%d') || ' 00:00:00: value=' || CAST(value AS VARCHAR) ||
         CASE WHEN deviation_sigma IS NOT NULL
              THEN ' (z-score ' || printf('%+.2f', deviation_sigma) || ')' ELSE '' END
  FROM topa WHERE k <= 5
  UNION ALL
  SELECT subject_id, 3, relationship, 0,
         '• **' || relationship || '**: r = ' ||
         CASE WHEN r IS NULL THEN 'nan' ELSE printf('%.3f', {rnd("r", 3)}) END
  FROM cor),
sec AS (
  SELECT subject_id, sec, string_agg(line, {nl} ORDER BY metric, k, line) AS body
  FROM lines GROUP BY 1, 2),
rng AS (
  SELECT user_id AS subject_id, strftime(min(ts), '%Y-%m-%d') AS s, strftime(max(ts), '%Y-%m-%d') AS e
  FROM events GROUP BY 1),
subj AS (SELECT DISTINCT subject_id FROM tsum)
SELECT subj.subject_id,
       '## Data Context  (date range: ' || coalesce(rng.s, 'unknown') || ' to ' || coalesce(rng.e, 'unknown') || ')'
       || {nl} || {nl} || '### Trends' || {nl} || coalesce(s1.body, 'No trend data available.')
       || {nl} || {nl} || '### Anomalies' || {nl} || coalesce(s2.body, 'No anomalies detected.')
       || {nl} || {nl} || '### Correlations' || {nl} || coalesce(s3.body, 'No correlation data available.')
       AS text
FROM subj
LEFT JOIN (SELECT * FROM sec WHERE sec = 1) s1 ON s1.subject_id = subj.subject_id
LEFT JOIN (SELECT * FROM sec WHERE sec = 2) s2 ON s2.subject_id = subj.subject_id
LEFT JOIN (SELECT * FROM sec WHERE sec = 3) s3 ON s3.subject_id = subj.subject_id
LEFT JOIN rng ON rng.subject_id = subj.subject_id
"""


ORACLE = {
    "daily_mean": f"""
WITH {EV_DAILY}
SELECT subject_id, metric, date, {rnd("value", 4)} AS value
FROM daily WHERE metric NOT IN {SUM_TYPES}
""",
    "daily_sum_zero_filled": f"""
WITH {EV_DAILY}
SELECT subject_id, metric, date, {rnd("value", 4)} AS value
FROM daily WHERE metric IN {SUM_TYPES}
""",
    "anomalies": anomalies_sql(EV_DAILY),
    "anomalies_long_history": anomalies_sql(ORD_DAILY),
    "anomaly_severity_counts": f"""
WITH a AS ({anomalies_sql(EV_DAILY)})
SELECT metric, severity, count(*) AS n_anomalies,
       {rnd("avg(deviation_sigma)", 4)} AS mean_deviation,
       max(deviation_sigma) AS max_deviation
FROM a GROUP BY metric, severity
""",
    "rolling_7_30_90": rolling_sql(EV_DAILY),
    "rolling_long_history": rolling_sql(ORD_DAILY),
    "baseline_deviation": f"""
WITH {EV_DAILY},
b AS (
  SELECT subject_id, metric, date, value,
         CASE WHEN count(value) OVER w >= 7 THEN avg(value) OVER w END AS mu
  FROM daily
  WINDOW w AS (PARTITION BY subject_id, metric ORDER BY date
               ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT subject_id, metric, date, {rnd("value", 4)} AS value, {rnd("mu", 4)} AS rolling_mean,
       {rnd("value - mu", 4)} AS baseline_deviation
FROM b
""",
    "last7_stats": f"""
WITH {EV_STATS}
SELECT subject_id, metric, {rnd("coalesce(avg7, cur)", 2)} AS avg, {rnd("cur", 2)} AS current,
       {rnd("min7", 2)} AS min, {rnd("max7", 2)} AS max, n_points
FROM st
""",
    "chart_last90": f"""
WITH {ORD_DAILY},
r AS (
  SELECT subject_id, metric, date, value AS raw,
         CASE WHEN count(value) OVER w >= 2 THEN avg(value) OVER w END AS rolling_7,
         row_number() OVER (PARTITION BY subject_id, metric ORDER BY date DESC) AS rn,
         count(*) OVER (PARTITION BY subject_id, metric) AS n
  FROM daily
  WINDOW w AS (PARTITION BY subject_id, metric ORDER BY date
               ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
SELECT subject_id, metric, date, {rnd("raw", 4)} AS raw, {rnd("rolling_7", 4)} AS rolling_7
FROM r WHERE rn <= 90 AND n >= 2
""",
    "trend_class": f"""
WITH {EV_STATS}
SELECT subject_id, metric, n_points, n30 AS n_trend, trend_raw, direction,
       {rnd("CASE WHEN sd = 0 THEN NULL ELSE slope / sd END", 4)} AS norm_slope
FROM tl
""",
    "trend_summary": f"""
WITH {EV_STATS}, {EV_ANOM},
rec AS (
  SELECT subject_id, metric, count(*) AS n,
         string_agg(strftime(date, '%Y-%m-%d'), ',' ORDER BY date DESC) AS dates
  FROM ev_anom WHERE date >= {EV_AS_OF} - INTERVAL 14 DAY
  GROUP BY 1, 2)
SELECT t.subject_id, t.metric, t.direction, {rnd("t.cur", 2)} AS current_value,
       {rnd("t.avg90", 2)} AS avg_90d,
       CASE WHEN t.avg90 = 0 THEN NULL ELSE {rnd("(t.cur - t.avg90) / t.avg90 * 100", 1)} END AS pct_vs_90d,
       coalesce(r.n, 0) AS n_recent_anomalies, coalesce(r.dates, '') AS recent_anomaly_dates
FROM tl t LEFT JOIN rec r USING (subject_id, metric)
""",
    "recent_anomalies": f"""
WITH {EV_ANOM}
SELECT subject_id, metric, date, value, deviation_sigma, severity
FROM ev_anom WHERE date >= CAST({EV_AS_OF} - INTERVAL 14 DAY AS DATE)
""",
    "sleep_nightly": f"""
WITH {sleep_ctes()}
SELECT subject_id, date AS night, {rnd("value", 4)} AS hours FROM sn
""",
    "sleep_stage_pivot": f"""
WITH {sleep_ctes()}
SELECT subject_id, night,
       {rnd("coalesce(sum(hrs * 60) FILTER (WHERE stage = 'asleep_unspecified'), 0.0)", 4)} AS asleep_unspecified,
       {rnd("coalesce(sum(hrs * 60) FILTER (WHERE stage = 'core'), 0.0)", 4)} AS core,
       {rnd("coalesce(sum(hrs * 60) FILTER (WHERE stage = 'deep'), 0.0)", 4)} AS deep,
       {rnd("coalesce(sum(hrs * 60) FILTER (WHERE stage = 'rem'), 0.0)", 4)} AS rem,
       {rnd("coalesce(sum(hrs * 60) FILTER (WHERE stage = 'unknown'), 0.0)", 4)} AS unknown
FROM skept WHERE has_stages GROUP BY 1, 2
""",
    "sleep_rolling": f"""
WITH {sleep_ctes()}
SELECT subject_id, date AS night, {rnd("value", 4)} AS hours,
       {rnd("CASE WHEN count(value) OVER w7 >= 3 THEN avg(value) OVER w7 END", 4)} AS avg_duration_7d,
       {rnd("CASE WHEN count(value) OVER w30 >= 7 THEN avg(value) OVER w30 END", 4)} AS avg_duration_30d
FROM sn
WINDOW w7 AS (PARTITION BY subject_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
       w30 AS (PARTITION BY subject_id ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)
""",
    "sleep_stats": f"""
WITH {sleep_ctes()}
SELECT subject_id, {rnd("avg(value)", 2)} AS mean_hrs, {rnd("median(value)", 2)} AS median_hrs,
       {rnd("stddev_samp(value)", 2)} AS std_hrs, {rnd("min(value)", 2)} AS min_hrs,
       {rnd("max(value)", 2)} AS max_hrs, count(*) AS total_nights
FROM sn GROUP BY 1
""",
    "workouts_by_type": f"""
WITH {WORKOUT_CTE}
SELECT subject_id, activity, count(*) AS sessions, {rnd("avg(d)", 1)} AS avg_duration_min
FROM wt GROUP BY 1, 2
""",
    "workout_weekly_load": f"""
WITH {WORKOUT_CTE}
SELECT subject_id, CAST(date_trunc('week', ts) AS DATE) AS week,
       {rnd("coalesce(sum(d), 0.0)", 1)} AS total_duration_min, count(d) AS session_count,
       CAST(NULL AS DOUBLE) AS avg_hr, {rnd("coalesce(sum(d), 0.0)", 1)} AS estimated_load
FROM wt WHERE ts IS NOT NULL GROUP BY 1, 2
""",
    "workout_stats": f"""
WITH {WORKOUT_CTE}
SELECT subject_id, count(*) AS total_workouts, {rnd("coalesce(sum(d), 0.0) / 60", 1)} AS total_duration_hrs,
       {rnd("avg(d)", 1)} AS avg_duration_min, count(DISTINCT activity) AS unique_types
FROM wt WHERE ts IS NOT NULL GROUP BY 1
""",
    "corr_intensity_next_day": corr_sql(0),
    "corr_sleep_next_day": corr_sql(1),
    "corr_evening_sleep": corr_sql(2),
    "corr_baseline_dev": corr_sql(3),
    "corr_p_value": corr_all_sql("CAST(0 AS BIGINT)"),
    "snapshot_metrics": f"""
WITH {SNAP_CTES}
SELECT subject_id, week, metric, avg, current, min, max, avg_90d, direction, unit FROM sm
""",
    "snapshot_runs": f"""
WITH {SNAP_CTES}
SELECT subject_id, week, run_number, anomaly_count, workout_count, workout_duration_hrs, workouts_in_week, sleep_avg_hrs
FROM runs
""",
    "wow_deltas": f"""
WITH {SNAP_CTES}, {WOW_PAIRS}
SELECT * FROM wow
""",
    "monthly_rollup": f"""
WITH {SNAP_CTES}
SELECT m.subject_id, m.metric, {rnd("avg(m.avg)", 2)} AS month_avg, {rnd("max(m.avg)", 2)} AS best_week,
       {rnd("min(m.avg)", 2)} AS worst_week, min(m.unit) AS unit
FROM sm m JOIN recent r USING (subject_id, week)
WHERE m.avg IS NOT NULL
GROUP BY 1, 2
""",
    "monthly_totals": f"""
WITH {SNAP_CTES}
SELECT subject_id, max(weeks_covered) AS weeks_covered,
       CAST(sum(anomaly_count) AS BIGINT) AS total_anomalies,
       CAST(sum(workout_count) AS BIGINT) AS total_workouts,
       {rnd("sum(workout_duration_hrs)", 1)} AS total_workout_hrs,
       {rnd("avg(sleep_avg_hrs)", 2)} AS avg_sleep_hrs
FROM recent GROUP BY 1
""",
    "monthly_due": f"""
WITH {SNAP_CTES}
SELECT subject_id, max(run_number) AS latest_run, max(run_number) % 4 = 0 AS monthly_due
FROM runs GROUP BY 1
""",
    "report_overview": f"""
WITH {REPORT_CTES}
SELECT t.subject_id, t.metric, {display_sql("t.metric")} AS display_name,
       trim(regexp_replace({display_sql("t.metric")}, '[<>:"/\\\\|?*]', '', 'g')) AS page_name,
       t.current_value, {unit_case("t.metric")} AS unit, {arrow_sql("t.direction")} AS arrow,
       t.direction, t.avg_90d,
       w.delta AS wow_delta, w.pct_change AS wow_pct_change, w.direction AS wow_direction
FROM tsum t LEFT JOIN (SELECT * FROM wow WHERE week = {LAST_WEEK}) w USING (subject_id, metric)
WHERE t.direction <> 'insufficient_data'
""",
    "report_anomalies": f"""
WITH {FULL_BASE}, fan AS ({anomalies_select('dall')})
SELECT subject_id, row_number() OVER (PARTITION BY subject_id ORDER BY date DESC, metric) AS row_no,
       metric, {display_sql("metric")} AS display_name, strftime(date, '%Y-%m-%d') AS date, value,
       deviation_sigma AS deviation, printf('%+.2fσ', deviation_sigma) AS deviation_text,
       CASE WHEN abs(deviation_sigma) >= 2.0 THEN 'warning' ELSE 'info' END AS callout, severity
FROM fan WHERE date >= {EV_AS_OF} - INTERVAL 7 DAY
""",
    "top5_anomalies": f"""
WITH {FULL_BASE}, fan AS ({anomalies_select('dall')})
SELECT subject_id, metric, k, date, value, deviation_sigma, n_readings
FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, metric ORDER BY date DESC) AS k,
             count(*) OVER (PARTITION BY subject_id, metric) AS n_readings
      FROM fan)
WHERE k <= 5
""",
    "metric_log_upsert": f"""
WITH {FULL_BASE}, {stats_ctes('dall')},
keep AS (SELECT subject_id, metric, {rnd("cur", 2)} AS cv, direction FROM tl
         WHERE direction <> 'insufficient_data'),
tail AS (
  SELECT d.subject_id, d.metric, d.date, {rnd("d.value", 2)} AS value, 'flat' AS trend
  FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, metric ORDER BY date DESC) AS r FROM dall) d
  WHERE d.r <= 90 AND (d.subject_id, d.metric) IN (SELECT subject_id, metric FROM keep)),
newr AS (SELECT subject_id, metric, DATE '2024-01-30' AS date, cv AS value, direction AS trend FROM keep
         WHERE metric <> 'click'),  -- click has no page yet: history only
merged AS (
  SELECT * FROM newr
  UNION ALL
  SELECT * FROM tail t WHERE NOT EXISTS (
    SELECT 1 FROM newr n WHERE n.subject_id = t.subject_id AND n.metric = t.metric AND n.date = t.date))
SELECT subject_id, metric, date, value, {unit_case("metric")} AS unit, trend, {arrow_sql("trend")} AS arrow
FROM merged
""",
    "context_text": context_sql(),
    "dataset_profile": """
SELECT event_type AS metric, count(*) AS rows,
       strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_start,
       strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_start
FROM events GROUP BY 1
""",
    "dataset_totals": """
SELECT count(*) AS total_records, count(DISTINCT event_type) AS n_metrics FROM events
""",
    "kept_skipped_counts": """
SELECT CASE WHEN event_type IN ('click', 'purchase', 'error', 'signup') THEN 'kept' ELSE 'skipped' END AS status,
       count(*) AS n_records
FROM events GROUP BY 1
""",
    "typed_records": """
WITH raw AS (
  SELECT user_id AS subject_id, event_type AS metric,
         CASE WHEN event_type = 'view' THEN 'HKCategoryValueSleepAnalysisAsleep'
              ELSE CAST(value AS VARCHAR) END AS vtext,
         strftime(ts, '%Y-%m-%d %H:%M:%S') || ' -0600' AS stext
  FROM events WHERE event_type IN ('click', 'purchase', 'error', 'signup')),
parsed AS (
  SELECT subject_id, metric, TRY_CAST(vtext AS DOUBLE) AS value,
         strptime(substr(stext, 1, 19), '%Y-%m-%d %H:%M:%S') AS loc,
         (CASE WHEN substr(stext, 21, 1) = '-' THEN -1 ELSE 1 END)
           * (CAST(substr(stext, 22, 2) AS INTEGER) * 60 + CAST(substr(stext, 24, 2) AS INTEGER)) AS off_min
  FROM raw)
SELECT subject_id, metric, value, strftime(loc, '%Y-%m-%d %H:%M:%S') AS start_local,
       strftime(loc - to_minutes(off_min), '%Y-%m-%d %H:%M:%S') AS start_utc
FROM parsed
""",
    "full_analysis": f"""
WITH {FULL_BASE}, fan AS ({anomalies_select('dall')}),
ser AS (SELECT subject_id, count(DISTINCT metric) AS n_series, count(*) AS n_daily_rows FROM dall GROUP BY 1),
an AS (SELECT subject_id, count(*) AS n FROM fan GROUP BY 1),
sst AS (SELECT subject_id, count(*) AS total_nights, {rnd("avg(value)", 2)} AS mean_hrs FROM sn GROUP BY 1),
wst AS (SELECT user_id AS subject_id, count(*) AS total_workouts FROM events
        WHERE event_type = 'purchase' AND ts IS NOT NULL GROUP BY 1)
SELECT ser.subject_id, ser.n_series, ser.n_daily_rows, coalesce(an.n, 0) AS n_anomalies,
       coalesce(sst.total_nights, 0) AS total_nights, sst.mean_hrs,
       coalesce(wst.total_workouts, 0) AS total_workouts
FROM ser LEFT JOIN an USING (subject_id) LEFT JOIN sst USING (subject_id) LEFT JOIN wst USING (subject_id)
""",
}


# -- all outputs of one analysis, sinks and sources ----------------------------------------

def outputs_sql() -> str:
    """Rows, figures and the sum of figures in hundredths of every output, each
    figure rounded to 4 digits and then to 2."""
    daily = f"{FULL_BASE}, daily AS (SELECT * FROM dall)"
    body = " UNION ALL ".join(f"({pearson_sql(rel, x, y)})" for rel, x, y in CORR_RELATIONS)
    mean_click = "tmp AS (SELECT subject_id, date, value FROM ms WHERE metric = 'click' AND value IS NOT NULL)"
    ctes = corr_ctes("user_id")
    assert mean_click in ctes
    correlations = f"WITH {ev_daily('evd')}, " + ctes.replace(
        mean_click, "tmp AS (SELECT subject_id, date, value FROM evd WHERE metric = 'click')") + body
    parts = {
        "daily": (f"WITH {daily} SELECT {rnd('value', 4)} AS value FROM daily", ["value"]),
        "rolling": (rolling_sql(daily), ["raw", "rolling_7", "rolling_30", "rolling_90"]),
        "chart": (ORACLE["chart_last90"].replace(ORD_DAILY, daily), ["raw", "rolling_7"]),
        "anomalies": (f"WITH {FULL_BASE} {anomalies_select('dall')}", ["value", "deviation_sigma"]),
        "trend": (f"WITH {REPORT_CTES} SELECT * FROM tsum", ["current_value", "avg_90d", "pct_vs_90d"]),
        "correlations": (correlations, ["r", "p"]),
        "sleep_nightly": (ORACLE["sleep_nightly"], ["hours"]),
        "sleep_stages": (ORACLE["sleep_stage_pivot"], ["asleep_unspecified", "core", "deep", "rem", "unknown"]),
        "sleep_rolling": (ORACLE["sleep_rolling"], ["hours", "avg_duration_7d", "avg_duration_30d"]),
        "sleep_stats": (ORACLE["sleep_stats"], ["mean_hrs", "median_hrs", "total_nights"]),
        "workout_by_type": (ORACLE["workouts_by_type"], ["sessions", "avg_duration_min"]),
        "workout_weekly": (ORACLE["workout_weekly_load"], ["total_duration_min", "session_count"]),
        "workout_stats": (ORACLE["workout_stats"], ["total_workouts", "total_duration_hrs", "avg_duration_min", "unique_types"]),
    }
    assert ORD_DAILY in ORACLE["chart_last90"]

    def one(name: str, sql: str, columns: list[str]) -> str:
        figures = " + ".join(f"count({c})" for c in columns)
        total = " + ".join(f"coalesce(sum(CAST(round({rnd(rnd(c, 4), 2)} * 100) AS BIGINT)), 0)" for c in columns)
        return f"SELECT '{name}' AS output, count(*) AS n_rows, {figures} AS n_figures, CAST({total} AS BIGINT) AS hundredths FROM ({sql})"

    return " UNION ALL ".join(one(n, q, c) for n, (q, c) in parts.items())


#: Subjects with a reading on the last day of the data.
STILL_THERE = "(SELECT user_id FROM events WHERE CAST(ts AS DATE) = (SELECT CAST(max(ts) AS DATE) FROM events))"

DIRTY = """
dirty AS (
  SELECT user_id, event_type, event_id % 11 AS k, ts,
         CASE WHEN event_id % 11 IN (0, 1, 2, 3) THEN NULL
              WHEN event_id % 11 = 4 THEN floor(value) * 10 + 5 ELSE value END AS value
  FROM events WHERE event_type IN ('click', 'purchase', 'error', 'signup') AND event_id % 11 <> 6)
"""

ORACLE |= {
    "analysis_outputs": outputs_sql(),
    "build_snapshot": f"""
WITH {FULL_BASE}, {stats_ctes('dall')}, fan AS ({anomalies_select('dall')}),
an AS (SELECT subject_id, count(*) AS n FROM fan GROUP BY 1),
wo AS (SELECT user_id AS subject_id, count(*) AS n, {rnd("coalesce(sum(value), 0.0) / 60", 1)} AS hrs,
              count(value) FILTER (WHERE CAST(date_trunc('week', ts) AS DATE) = {LAST_WEEK}) AS own
       FROM events WHERE event_type = 'purchase' AND ts IS NOT NULL GROUP BY 1),
sl_avg AS (SELECT subject_id, {rnd("avg(value)", 2)} AS hrs FROM sn GROUP BY 1)
SELECT t.subject_id, {EV_AS_OF} AS report_date, {LAST_WEEK} AS week, t.metric,
       {rnd("coalesce(t.avg7, t.cur)", 2)} AS avg, {rnd("t.cur", 2)} AS current, {rnd("t.min7", 2)} AS min,
       {rnd("t.max7", 2)} AS max, {rnd("t.avg90", 2)} AS avg_90d, t.direction, {unit_case("t.metric")} AS unit,
       '2024-01-31T00:00:00' AS generated_at, coalesce(an.n, 0) AS anomaly_count, coalesce(wo.n, 0) AS workout_count,
       coalesce(wo.hrs, 0.0) AS workout_duration_hrs, coalesce(wo.own, 0) AS workouts_in_week, sl_avg.hrs AS sleep_avg_hrs
FROM tl t LEFT JOIN an USING (subject_id) LEFT JOIN wo USING (subject_id) LEFT JOIN sl_avg USING (subject_id)
""",
    "snapshot_upsert": f"""
WITH {SNAP_CTES},
placed AS (SELECT week, row_number() OVER (ORDER BY week) AS place FROM (SELECT DISTINCT week FROM runs)),
saved AS (
  SELECT subject_id, week, row_number() OVER (PARTITION BY subject_id ORDER BY place % 2, week) AS number
  FROM runs JOIN placed USING (week))
SELECT sm.subject_id, CAST(sm.week + 6 AS DATE) AS report_date, sm.week, sm.metric, sm.avg, saved.number AS run_number
FROM sm JOIN saved USING (subject_id, week)
""",
    "snapshot_json_roundtrip": f"""
WITH {SNAP_CTES}
SELECT sm.subject_id, CAST(sm.week + 6 AS DATE) AS report_date, sm.week, sm.metric, sm.avg, sm.current, sm.min, sm.max,
       sm.avg_90d, sm.direction, sm.unit, runs.run_number, runs.anomaly_count
FROM sm JOIN runs USING (subject_id, week)
""",
    "report_sink_roundtrip": f"""
WITH top AS ({ORACLE["top5_anomalies"]})
SELECT DATE '2024-01-24' AS report_date, count(*) AS n_rows, count(DISTINCT subject_id) AS n_subjects,
       CAST(sum(n_readings) AS BIGINT) AS n_readings FROM top HAVING count(*) > 0
UNION ALL
SELECT DATE '2024-01-31', count(*), count(DISTINCT subject_id), CAST(sum(n_readings) AS BIGINT)
FROM top WHERE subject_id IN {STILL_THERE} HAVING count(*) > 0
""",
    "ingest_roundtrip": f"""
SELECT user_id AS subject_id, event_type AS metric, count(*) AS n, {rnd("sum(value)", 4)} AS total,
       strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last
FROM events
WHERE event_type IN ('click', 'purchase', 'error', 'signup') AND NOT (user_id IN {STILL_THERE} AND event_type = 'error')
GROUP BY 1, 2
UNION ALL
SELECT user_id, 'workout', count(*), {rnd("sum(value)", 4)},
       strftime(min(ts), '%Y-%m-%d %H:%M:%S'), strftime(max(ts), '%Y-%m-%d %H:%M:%S')
FROM events WHERE event_type = 'purchase' GROUP BY 1
""",
    "dirty_records": f"""
WITH {DIRTY},
clocks AS (
  SELECT *, CASE WHEN k <> 5 THEN date_trunc('second', ts) END AS loc,
         CASE WHEN k = 5 THEN NULL WHEN k % 2 = 0 THEN date_trunc('second', ts) + INTERVAL 6 HOUR
              ELSE date_trunc('second', ts) - INTERVAL 150 MINUTE END AS utc
  FROM dirty)
SELECT user_id AS subject_id, event_type AS metric, count(*) AS n, count(value) AS n_values, {rnd("sum(value)", 4)} AS total,
       count(utc) AS n_starts, strftime(min(loc), '%Y-%m-%d %H:%M:%S') AS first_local,
       strftime(max(utc), '%Y-%m-%d %H:%M:%S') AS last_utc
FROM clocks GROUP BY 1, 2
""",
    "dirty_daily": f"""
WITH {DIRTY}, {ev_daily().replace("FROM events WHERE ts IS NOT NULL", "FROM dirty WHERE k <> 5")}
SELECT subject_id, metric, date, {rnd("value", 4)} AS value FROM daily
""",
}
