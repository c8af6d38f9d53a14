"""DuckDB SQL of the second queries, written from their definitions."""

from __future__ import annotations

from itertools import combinations

from . import second_queries as Q
from .views import sql_with


def _slices(columns: dict[str, list[str]], cast: str) -> str:
    """Counts of every value in both slices; a column may be given as `name:expression`."""
    parts = []
    for t, cs in columns.items():
        cond = Q.MIDDLE[t]
        parts += [f"""SELECT '{t}' AS asset, '{c.split(':')[0]}' AS "column", CAST({c.split(':')[-1]} AS {cast}) AS value, ({cond}) AS later FROM {t}""" for c in cs]
    return f"""WITH cells AS ({' UNION ALL '.join(parts)}),
counted AS (SELECT asset, "column", value, count(*) FILTER (NOT later) AS a, count(*) FILTER (later) AS b FROM cells WHERE value IS NOT NULL GROUP BY ALL),
totals AS (SELECT asset, "column", CAST(sum(a) AS BIGINT) AS n_before, CAST(sum(b) AS BIGINT) AS n_after, count(*) AS categories FROM counted GROUP BY ALL)"""


NUMERIC_SHIFT = _slices({"orders": ["o_totalprice", "o_custkey", "o_orderkey"], "events": ["value", "user_id", "event_id"]}, "DOUBLE") + """,
steps AS (
  SELECT asset, "column", value, n_before, n_after,
    abs(sum(a) OVER w / n_before - sum(b) OVER w / n_after) AS gap, coalesce(lead(value) OVER w - value, 0) AS width
  FROM counted JOIN totals USING (asset, "column") WINDOW w AS (PARTITION BY asset, "column" ORDER BY value)
),
spread AS (SELECT asset, "column", stddev_pop(value) AS sd FROM cells WHERE NOT later GROUP BY ALL),
out AS (
  SELECT asset, "column", any_value(n_before) AS n_before, any_value(n_after) AS n_after, sum(gap * width) AS wasserstein, max(gap) AS ks, any_value(sd) AS sd
  FROM steps JOIN spread USING (asset, "column") GROUP BY ALL
)
SELECT asset, "column", n_before, n_after, wasserstein, wasserstein / CASE WHEN sd > 0 THEN sd ELSE 1 END AS effect, ks,
  (wasserstein / CASE WHEN sd > 0 THEN sd ELSE 1 END >= 0.2 OR ks >= 0.1) AS shifted FROM out"""

CATEGORICAL_SHIFT = _slices({"orders": ["o_orderstatus", "o_orderpriority"], "events": ["event_type", "user_id", "day:CAST(ts AS DATE)"]}, "VARCHAR") + """,
shares AS (
  SELECT *, a / n_before AS p, b / n_after AS q, (a + 0.5) / (n_before + 0.5 * categories) AS sp, (b + 0.5) / (n_after + 0.5 * categories) AS sq
  FROM counted JOIN totals USING (asset, "column")
),
out AS (
  SELECT asset, "column", any_value(n_before) AS n_before, any_value(n_after) AS n_after, any_value(categories) AS categories,
    sum((CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2) AS js,
    sum((sp - sq) * ln(sp / sq)) AS psi
  FROM shares GROUP BY ALL
),
critical AS (SELECT *, CAST(categories - 1 AS DOUBLE) AS k FROM out)
SELECT asset, "column", n_before, n_after, categories, js, psi, k * pow(1 - 2 / (9 * k) + 2.326348 * sqrt(2 / (9 * k)), 3) * (1.0 / n_before + 1.0 / n_after) AS psi_critical,
  psi > k * pow(1 - 2 / (9 * k) + 2.326348 * sqrt(2 / (9 * k)), 3) * (1.0 / n_before + 1.0 / n_after) AND js >= 0.01 AS shifted
FROM critical"""

ANOMALIES = """WITH days AS (SELECT event_type, CAST(ts AS DATE) AS d, CAST(count(*) AS DOUBLE) AS n, avg(value) AS mean FROM events GROUP BY ALL),
history AS (SELECT event_type || '.rows' AS series, d, n AS value FROM days UNION ALL SELECT event_type || '.mean', d, mean FROM days),
placed AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY d, value) AS place FROM history WHERE value IS NOT NULL),
trended AS (SELECT *, CASE WHEN place > 7 THEN avg(value) OVER (PARTITION BY series ORDER BY place ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) END AS trend FROM placed),
based AS (
  SELECT *, trend + coalesce(quantile_cont(value - trend, 0.5) OVER (PARTITION BY series, place % 7 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS baseline
  FROM trended
),
judged AS (
  SELECT c.series, c.d, c.value, c.baseline, c.value - c.baseline AS residual,
    count(e.place) AS earlier, count(CASE WHEN abs(e.value - e.baseline) >= abs(c.value - c.baseline) THEN 1 END) AS at_least
  FROM based c LEFT JOIN based e ON e.series = c.series AND e.place < c.place AND e.baseline IS NOT NULL GROUP BY ALL
)
SELECT series, d AS "at", value, baseline, residual, CASE WHEN residual IS NOT NULL AND earlier >= 9 THEN (at_least + 1) / (earlier + 1) END AS p_value,
  coalesce(residual IS NOT NULL AND earlier >= 9 AND (at_least + 1) / (earlier + 1) <= 0.1, false) AS anomaly FROM judged"""

VOLUME = """WITH days AS (SELECT CAST(user_id AS VARCHAR) AS series, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL),
calendar AS (SELECT series, CAST(unnest(generate_series(min(day), DATE '2024-02-01', INTERVAL 1 DAY)) AS DATE) AS day FROM days GROUP BY series),
complete AS (SELECT series, day, coalesce(n, 0) AS n FROM calendar LEFT JOIN days USING (series, day)),
based AS (SELECT *, quantile_cont(n, 0.5) OVER (PARTITION BY series, dayofweek(day) ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS expected FROM complete)
SELECT series, day, n, expected, CASE WHEN expected IS NULL THEN 'new' WHEN n = 0 AND expected > 0 THEN 'missing' WHEN n < 0.5 * expected THEN 'low' ELSE 'ok' END AS state FROM based"""

SERIES = """WITH placed AS (SELECT event_type AS series, ts, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, value) AS place FROM events WHERE ts IS NOT NULL)
SELECT series, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at, max(place) AS last_place,
  CAST(sum(place * CAST(round(value * 100) AS BIGINT) % 1000003) AS BIGINT) AS order_mark FROM placed GROUP BY series"""


def explanation() -> str:
    names = ("country", "city", "prefix")
    combos = [c for k in (1, 2) for c in combinations(names, k)]
    label = lambda c: " || ' & ' || ".join(f"'{n}=' || coalesce({n}, 'null')" for n in c)
    parts = [f"SELECT {label(c)} AS segment, {len(c)} AS size, {f'{label(c[:1])}' if len(c) > 1 else 'NULL'} AS one, {f'{label(c[1:])}' if len(c) > 1 else 'NULL'} AS two, fails FROM rows" for c in combos]
    return sql_with(("dirty_customers",), f""", rows AS (SELECT country, city, substr(total, 1, 1) AS prefix, email IS NULL AS fails FROM dirty_customers),
cells AS ({' UNION ALL '.join(parts)}),
whole AS (SELECT count(*) AS n, count(*) FILTER (fails) AS k FROM rows),
counted AS (SELECT segment, size, one, two, count(*) FILTER (fails) AS failing, count(*) AS rows FROM cells GROUP BY ALL HAVING count(*) FILTER (fails) >= 0.1 * (SELECT k FROM whole)),
rated AS (SELECT *, failing / rows AS rate FROM counted)
SELECT c.segment, CAST(c.size AS INT) AS size, c.failing, c.rows, c.failing / k AS support, c.rate, c.rate / (k / n) AS lift
FROM rated c LEFT JOIN rated x ON x.segment = c.one LEFT JOIN rated y ON y.segment = c.two, whole
WHERE c.rate / (k / n) >= 1.1 AND (c.size = 1 OR (c.rate >= 1.2 * x.rate AND c.rate >= 1.2 * y.rate))""").replace(") , rows AS", "), rows AS")


def dependencies() -> str:
    parts = []
    for t, columns in Q.DEPENDENT.items():
        for k in (0, 1, 2):
            for x in combinations(columns, k):
                for y in columns:
                    if y not in x:
                        by = f"GROUP BY {', '.join(x)}" if x else ""
                        members = "[" + ", ".join(f"'{c}'" for c in x) + "]::VARCHAR[]"
                        parts.append(f"""SELECT '{t}' AS asset, {members} AS x, '{y}' AS y, CAST(sum(top) AS BIGINT) AS top, count(*) AS vals
                            FROM (SELECT max(c) AS top FROM (SELECT {', '.join([*x, y])}, count(*) AS c FROM {t} GROUP BY ALL) {by}) q""")
    return sql_with(("dirty_customers",), f""", g AS ({' UNION ALL '.join(parts)}),
n AS (SELECT 'part' AS asset, count(*) AS n FROM part UNION ALL SELECT 'dirty_customers', count(*) FROM dirty_customers UNION ALL SELECT 'orders', count(*) FROM orders),
e AS (SELECT g.asset, x, y, vals, n, 1 - top / n AS error FROM g JOIN n USING (asset)),
holds AS (SELECT e.*, e.vals > 0.9 * e.n AS is_key, c.error AS guess FROM e JOIN e c ON c.asset = e.asset AND c.y = e.y AND len(c.x) = 0 WHERE len(e.x) > 0)
SELECT h.asset, array_to_string(h.x, ', ') AS determinant, h.y AS dependent, h.n AS rows, h.error, 1 - h.error / h.guess AS gain
FROM holds h
WHERE NOT is_key AND h.error <= 0.4 AND h.guess > 0 AND 1 - h.error / h.guess > 0
  AND NOT EXISTS (SELECT 1 FROM holds s WHERE s.asset = h.asset AND len(s.x) < len(h.x) AND list_has_all(h.x, s.x) AND (s.is_key OR (s.y = h.y AND s.error <= 0.4)))""")


BALANCE = """WITH sums AS (SELECT l_orderkey AS key, sum(CAST(round(l_extendedprice, 2) AS DECIMAL(30,2))) AS child_sum FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY 1),
totals AS (SELECT o_orderkey AS key, sum(CAST(round(o_totalprice, 2) AS DECIMAL(30,2))) AS parent_sum FROM orders WHERE o_orderkey IS NOT NULL GROUP BY 1)
SELECT key, CAST(child_sum AS DOUBLE) AS child_total, CAST(parent_sum AS DOUBLE) AS parent_total, CAST(coalesce(child_sum, 0) - coalesce(parent_sum, 0) AS DOUBLE) AS difference,
  CASE WHEN t.key IS NULL THEN 'no_parent' WHEN abs(coalesce(child_sum, 0) - coalesce(parent_sum, 0)) <= 1000 THEN 'balanced' WHEN s.key IS NULL THEN 'no_child' ELSE 'differs' END AS state
FROM sums s FULL JOIN totals t USING (key)"""


def overlaps() -> str:
    cells = " UNION ALL ".join(f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, CAST({c} AS VARCHAR) AS v FROM {t} WHERE {c} IS NOT NULL" for t, cs in Q.OVERLAP.items() for c in cs)
    return f"""WITH cells AS ({cells}), sizes AS (SELECT t, c, count(*) AS n FROM cells GROUP BY ALL),
shared AS (SELECT a.t AS lt, a.c AS lc, b.t AS rt, b.c AS rc, count(*) AS shared FROM cells a JOIN cells b ON a.v = b.v AND a.t <> b.t GROUP BY ALL)
SELECT lt AS left_table, lc AS left_column, rt AS right_table, rc AS right_column, x.n AS left_values, y.n AS right_values, shared, shared / x.n AS containment, shared / (x.n + y.n - shared) AS jaccard
FROM shared JOIN sizes x ON x.t = lt AND x.c = lc JOIN sizes y ON y.t = rt AND y.c = rc WHERE shared >= 0.9 * x.n"""


CUSTOM = " UNION ALL ".join(
    f"SELECT '{c.id}' AS check_id, count(*) AS evaluated, count(CASE WHEN {c.fails} THEN 1 END) AS failed, 1 - count(CASE WHEN {c.fails} THEN 1 END) / count(*) AS ratio, "
    f"1 - count(CASE WHEN {c.fails} THEN 1 END) / count(*) >= 1 - {c.tolerance} - 1e-12 AS passed FROM orders" for c in Q.CUSTOM)

def near() -> str:
    cells = {"dirty_customers": ("city", "name", "email", "vat_id"), "conversations": ("role", "text")}
    parts = " UNION ALL ".join(f"""SELECT '{t}' AS asset, '{c}' AS "column", CAST({c} AS VARCHAR) AS value FROM {t} WHERE {c} IS NOT NULL""" for t, cs in cells.items() for c in cs)
    return sql_with(("dirty_customers",), f""", cells AS ({parts}),
spelt AS (SELECT asset, "column", value, regexp_replace(lower(value), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS form, count(*) AS n FROM cells GROUP BY ALL)
SELECT asset, "column", form, count(*) AS variants, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n) - max(n) AS BIGINT) AS failing FROM spelt WHERE form <> '' GROUP BY asset, "column", form HAVING count(*) > 1""")


# Who was written twice is known from how the records were made.
LINKAGE = 'SELECT c_custkey AS "left", c_custkey + 1000000000 AS "right" FROM customer WHERE c_custkey % 20 = 0'

SECOND_ORACLE = {
    "near_duplicates": near(), "record_linkage": LINKAGE,
    "distribution_shift_numeric": NUMERIC_SHIFT, "distribution_shift_categorical": CATEGORICAL_SHIFT, "metric_anomalies": ANOMALIES, "failure_explanation": explanation(),
    "functional_dependency": dependencies(), "volume_trend": VOLUME, "overlapping_tables": overlaps(), "time_series_extraction": SERIES, "aggregate_balance": BALANCE, "custom_sql": CUSTOM,
}
