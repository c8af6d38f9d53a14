"""SQL counterparts of the queries on kept state, in closed form over the three slices."""

from __future__ import annotations

from .oracle import count_if

_SLICE = "CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 864000000000.0) AS INTEGER)"
SEVERITY = "CASE g WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'medium' ELSE 'low' END"
# Per check and slice: counts and whether it fails; then one row per check with the three verdicts.
BASE = f"""WITH r AS (SELECT {_SLICE} AS p, concat('share:', event_type, ':', CAST(user_id % 7 AS VARCHAR)) AS check_id, CAST(user_id % 7 AS INTEGER) AS g,
 count(*) AS n, count(CASE WHEN value > 100 THEN 1 END) AS k FROM events WHERE ts < TIMESTAMP '2024-01-31 00:00:00' GROUP BY 1, 2, 3),
 v AS (SELECT *, NOT (CAST(n - k AS DOUBLE) / n >= 1 - 0.13) AS fails FROM r),
 w AS (SELECT check_id, any_value(g) AS g, coalesce(bool_or(fails) FILTER (WHERE p = 0), false) AS f0, coalesce(bool_or(fails) FILTER (WHERE p = 1), false) AS f1,
  coalesce(bool_or(fails) FILTER (WHERE p = 2), false) AS f2 FROM v WHERE g <> 6 GROUP BY 1),
 s AS (SELECT *, CAST(f0 AS INT) + CAST(f1 AS INT) + CAST(f2 AS INT) AS occ,
  CASE WHEN f0 THEN 0 WHEN f1 THEN 1 WHEN f2 THEN 2 END AS first, CASE WHEN f2 THEN 2 WHEN f1 THEN 1 WHEN f0 THEN 0 END AS last,
  CASE WHEN f0 AND NOT f1 THEN 1 ELSE 0 END + CASE WHEN f1 AND NOT f2 THEN 1 ELSE 0 END AS healed FROM w WHERE f0 OR f1 OR f2) """

LINK = BASE + f"""SELECT check_id, CASE WHEN f2 THEN 'open' ELSE 'resolved' END AS status, {SEVERITY} AS severity, CAST(occ AS BIGINT) AS occurrences,
 concat('scan', CAST(first AS VARCHAR)) AS first_scan_id, concat('scan', CAST(last AS VARCHAR)) AS last_scan_id,
 CASE WHEN f2 THEN NULL ELSE concat('scan', CAST(last + 1 AS VARCHAR)) END AS resolved_scan_id, CAST(occ + healed AS BIGINT) AS version FROM s"""

_EVENTS = """SELECT check_id, 0 AS p, 'opened' AS action FROM s WHERE f0 UNION ALL
 SELECT check_id, 1, CASE WHEN f0 THEN 'recurred' ELSE 'opened' END FROM s WHERE f1 UNION ALL SELECT check_id, 1, 'auto_resolved' FROM s WHERE f0 AND NOT f1 UNION ALL
 SELECT check_id, 2, CASE WHEN f1 THEN 'recurred' WHEN f0 THEN 'reopened' ELSE 'opened' END FROM s WHERE f2 UNION ALL SELECT check_id, 2, 'auto_resolved' FROM s WHERE f1 AND NOT f2"""
SUMMARY = BASE + f""", e AS ({_EVENTS} UNION ALL SELECT check_id, p, 'unlinked' FROM v WHERE g = 6 AND fails)
 SELECT concat('scan', CAST(q.p AS VARCHAR)) AS scan_id, a.action, count(e.check_id) AS findings FROM (VALUES (0), (1), (2)) AS q(p)
 CROSS JOIN (VALUES ('opened'), ('recurred'), ('reopened'), ('unmuted'), ('auto_resolved'), ('unlinked')) AS a(action)
 LEFT JOIN e ON e.p = q.p AND e.action = a.action GROUP BY 1, 2"""
AUTO = BASE + f""", e AS ({_EVENTS}) SELECT check_id, concat('scan', CAST(p AS VARCHAR)) AS scan_id, 'open' AS from_status, 'resolved' AS to_status FROM e WHERE action = 'auto_resolved'"""
# Group by group: 0 acknowledged, 1 muted with an end, 2 resolved, 3 out of turn, 4 muted without end, 5 stale.
TRANSITIONS = BASE + """SELECT check_id, CASE g WHEN 0 THEN 'acknowledged' WHEN 1 THEN 'muted' WHEN 2 THEN 'resolved' WHEN 4 THEN 'muted' ELSE 'open' END AS status,
 CAST(CASE WHEN g IN (3, 5) THEN 1 ELSE 2 END AS BIGINT) AS version, CASE g WHEN 3 THEN 'invalid_transition' WHEN 5 THEN 'stale_version' END AS refusal FROM s WHERE f0"""
MUTE = BASE + """SELECT check_id, CASE WHEN NOT f1 THEN 'resolved' WHEN NOT f0 THEN 'open' WHEN g = 0 THEN 'acknowledged' WHEN g = 4 THEN 'muted' ELSE 'open' END AS status,
 CAST(CAST(f0 AS INT) + CAST(f1 AS INT) AS BIGINT) AS occurrences,
 CAST(CASE WHEN NOT f0 THEN 1 ELSE 1 + CASE WHEN g IN (3, 5) THEN 0 ELSE 1 END + CASE WHEN f1 THEN 1 WHEN g = 2 THEN 0 ELSE 1 END END AS BIGINT) AS version, false AS has_until FROM s WHERE f0 OR f1"""
LATEST = BASE + "SELECT s.check_id, concat('scan', CAST(last AS VARCHAR)) AS scan_id, n AS evaluated, k AS failed FROM s JOIN v ON v.check_id = s.check_id AND v.p = s.last"
PAGE = BASE + f""", f AS (SELECT check_id, {SEVERITY} AS severity, CASE WHEN g = 0 THEN 1 WHEN g = 1 THEN 2 WHEN g <= 3 THEN 3 ELSE 4 END AS rank,
 TIMESTAMP '2024-01-31 00:00:00' AS last_seen_at, concat('scan', CAST(first AS VARCHAR), '/', check_id) AS id FROM s WHERE f2)
 SELECT f.check_id, f.severity, f.last_seen_at, n AS evaluated, k AS failed FROM (SELECT * FROM f WHERE rank > 2 OR (rank = 2 AND id > 'scan0/share:click:1') ORDER BY rank, id LIMIT 5) f
 JOIN v ON v.check_id = f.check_id AND v.p = 2"""
DETAIL = BASE + f""", e AS ({_EVENTS}), seen AS (SELECT p, TIMESTAMP '2024-01-11 00:00:00' + INTERVAL 10 DAY * p AS t FROM (VALUES (0), (1), (2)) AS q(p))
 SELECT 'event' AS what, t AS seen_at, action AS detail FROM e JOIN seen USING (p) JOIN s USING (check_id) WHERE check_id = (SELECT min(check_id) FROM s WHERE f0 AND occ > 1) UNION ALL
 SELECT * FROM (SELECT 'occurrence', t, CAST(k AS VARCHAR) FROM v JOIN seen USING (p) JOIN s USING (check_id) WHERE check_id = (SELECT min(check_id) FROM s WHERE f0 AND occ > 1) AND fails ORDER BY t DESC LIMIT 2)"""
SCAN_FINDINGS = BASE + "SELECT v.check_id, k AS failed, CASE WHEN s.check_id IS NOT NULL THEN 'open' END AS finding_status FROM v LEFT JOIN s ON s.check_id = v.check_id WHERE p = 2 AND fails AND v.g >= 4"

_Z = "1.959964"
RECORDS = f"""WITH c AS (SELECT {_SLICE} AS p, event_type AS asset, count(*) AS n, count(CASE WHEN value > 100 THEN 1 END) AS k FROM events WHERE ts < TIMESTAMP '2024-01-31 00:00:00' GROUP BY 1, 2),
 a AS (SELECT p, asset, n, k FROM c UNION ALL SELECT p, NULL, CAST(sum(n) AS BIGINT), CAST(sum(k) AS BIGINT) FROM c GROUP BY 1),
 b AS (SELECT *, CAST(n - k AS DOUBLE) / n AS s, CAST(n AS DOUBLE) * (2 * n - 1) / n AS e FROM a),
 rec AS (SELECT concat('scan', CAST(p AS VARCHAR)) AS scan_id, p, asset, round(100 * s, 1) AS overall,
  round(100 * greatest(0.0, ((s + {_Z} * {_Z} / (2 * e)) - {_Z} * sqrt(s * (1 - s) / e + {_Z} * {_Z} / (4 * e * e))) / (1 + {_Z} * {_Z} / e)), 1) AS low,
  round(100 * least(1.0, ((s + {_Z} * {_Z} / (2 * e)) + {_Z} * sqrt(s * (1 - s) / e + {_Z} * {_Z} / (4 * e * e))) / (1 + {_Z} * {_Z} / e)), 1) AS high FROM b) """
HISTORY = RECORDS + """SELECT asset, scan_id, overall, low, high, CAST(1 AS BIGINT) AS checks, CASE WHEN p = 0 THEN 'manual' ELSE 'schedule' END AS trigger FROM rec
 WHERE (asset IS NULL AND p <= 1) OR (asset = 'click' AND p >= 1)"""
CHANGE = RECORDS + """SELECT x.asset, x.scan_id, x.overall, y.scan_id AS since_scan, y.overall AS since, round(x.overall - y.overall, 1) AS delta,
 CASE WHEN y.scan_id IS NOT NULL THEN y.low <= x.high AND x.low <= y.high END AS within FROM rec x LEFT JOIN rec y ON y.asset IS NOT DISTINCT FROM x.asset AND y.p = x.p - 1"""

_M = f"""WITH e AS (SELECT {_SLICE} AS p, value, event_type, ts FROM events WHERE ts < TIMESTAMP '2024-01-31 00:00:00'),
 x AS (SELECT p, count(*) AS n, count(DISTINCT value) AS dv, avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS mn, max(value) AS mx, quantile_cont(value, [0.01, 0.25, 0.5, 0.75, 0.99]) AS q,
  count(DISTINCT event_type) AS de, avg(length(event_type)) AS ml, count(DISTINCT ts) AS dt FROM e GROUP BY 1),
 m AS (SELECT p, 'value' AS col, unnest(['null_share', 'distinct_share', 'mean', 'stddev', 'min', 'max', 'p01', 'p25', 'p50', 'p75', 'p99']) AS measure,
  unnest([0.0, CAST(dv AS DOUBLE) / n, mean, sd, mn, mx, q[1], q[2], q[3], q[4], q[5]]) AS v FROM x
  UNION ALL SELECT p, 'event_type', unnest(['null_share', 'distinct_share', 'blank_share', 'mean_length']), unnest([0.0, CAST(de AS DOUBLE) / n, 0.0, ml]) FROM x
  UNION ALL SELECT p, 'ts', unnest(['null_share', 'distinct_share']), unnest([0.0, CAST(dt AS DOUBLE) / n]) FROM x) """
MEASURES = _M + """SELECT concat('scan', CAST(p AS VARCHAR)) AS scan_id, 'events' AS asset, col AS "column", measure, round(v, 6) AS value FROM m"""
SERIES = _M + """SELECT 'events' AS asset, col AS "column", measure, count(*) AS points, round(min_by(v, p), 6) AS first, round(max_by(v, p), 6) AS newest, round(min(v), 6) AS lowest, round(max(v), 6) AS highest FROM m GROUP BY 2, 3"""
POINTS = _M + "SELECT concat('scan', CAST(p AS VARCHAR)) AS scan_id, 'schedule' AS trigger, n AS \"rows\", round(mean, 6) AS mean FROM x WHERE p >= 1"

LOG = """SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS event_id, ts AS at, concat('check.', event_type) AS action, concat('User_', CAST(user_id AS VARCHAR), '%') AS actor
 FROM events WHERE user_id % 2 = 0 AND starts_with(CAST(user_id AS VARCHAR), '1') AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-28 00:00:00'
 ORDER BY ts DESC, event_id DESC LIMIT 40"""
FIELDS = """SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 2 ELSE CAST(b AS BIGINT) + CAST(t AS BIGINT) END AS fields,
 CASE WHEN p_partkey % 11 <> 0 AND b THEN p_brand END AS was_brand, CASE WHEN p_partkey % 11 <> 0 AND t THEN p_type END AS was_type,
 CASE WHEN b OR p_partkey % 11 = 0 THEN nb END AS now_brand, CASE WHEN t OR p_partkey % 11 = 0 THEN nt END AS now_type FROM
 (SELECT *, nb <> p_brand AS b, nt <> p_type AS t FROM (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN 'Brand#99' ELSE p_brand END AS nb, CASE WHEN p_partkey % 3 = 0 THEN 'OTHER' ELSE p_type END AS nt FROM part))"""

SPECS = """WITH g AS (SELECT p_brand, CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS b, concat('{"max": ', CAST(max(p_size) AS VARCHAR), ', "min": ', CAST(min(p_size) AS VARCHAR), '}') AS params
  FROM part WHERE p_size % 25 <> 0 GROUP BY 1), gen AS (SELECT * FROM g WHERE b % 7 <> 0),
 o AS (SELECT p_brand, CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS b, concat('{"max": ', CAST(max(p_size) AS VARCHAR), ', "min": ', CAST(min(p_size) AS VARCHAR), '}') AS params FROM part GROUP BY 1),
 old AS (SELECT *, CASE b % 4 WHEN 0 THEN 'proposed' WHEN 1 THEN 'active' WHEN 2 THEN 'locked' ELSE 'retired' END AS status,
  CASE WHEN b % 6 = 0 THEN 'manual' ELSE 'generated' END AS origin, CAST(b % 3 + 1 AS BIGINT) AS version FROM o WHERE b % 5 <> 0),
 j AS (SELECT concat('range:part:', coalesce(gen.p_brand, old.p_brand)) AS check_id, gen.params AS gp, old.params AS op, old.status, old.origin, old.version, gen.b IS NOT NULL AS has_g, old.b IS NOT NULL AS has_o
  FROM gen FULL JOIN old ON gen.p_brand = old.p_brand) """
RECONCILE = SPECS + """, k AS (SELECT *, CASE WHEN status = 'retired' THEN 'retired' WHEN NOT has_o THEN 'new' WHEN status = 'locked' OR origin = 'manual' THEN 'kept' WHEN NOT has_g THEN 'dropped' ELSE 'updated' END AS outcome FROM j)
 SELECT check_id, outcome, CASE outcome WHEN 'new' THEN 'proposed' WHEN 'kept' THEN status WHEN 'updated' THEN status END AS status,
 CASE outcome WHEN 'new' THEN gp WHEN 'kept' THEN op WHEN 'updated' THEN gp END AS params, CASE outcome WHEN 'new' THEN 'generated' WHEN 'kept' THEN origin WHEN 'updated' THEN 'generated' END AS origin,
 CASE outcome WHEN 'new' THEN 1 WHEN 'kept' THEN version WHEN 'updated' THEN version END AS version FROM k"""
_FOLD = SPECS + """, k AS (SELECT *, CASE WHEN NOT has_o THEN 'created' WHEN NOT has_g THEN 'absent' WHEN ends_with(check_id, '1') THEN 'skipped'
  WHEN status IN ('proposed', 'active') AND origin <> 'manual' AND gp <> op THEN 'regenerated' ELSE 'seen' END AS a FROM j) """
PERSIST = _FOLD + """SELECT check_id, coalesce(status, 'proposed') AS status, CASE WHEN a IN ('created', 'regenerated') THEN gp ELSE op END AS params,
 CASE a WHEN 'created' THEN 1 WHEN 'regenerated' THEN version + 1 ELSE version END AS version, CASE WHEN a IN ('absent', 'skipped') THEN 'scan0' ELSE 'scan1' END AS last_scan_id,
 CASE WHEN a IN ('created', 'regenerated') THEN TIMESTAMP '2024-01-20 00:00:00' END AS updated_at FROM k"""
EVENTS = _FOLD + "SELECT check_id, a AS action, status AS from_status, coalesce(status, 'proposed') AS to_status, op AS params_before, gp AS params_after FROM k WHERE a IN ('created', 'regenerated')"
MOVES = SPECS + """, m AS (SELECT *, CASE b % 6 WHEN 0 THEN 'proposed' WHEN 1 THEN 'active' WHEN 2 THEN 'locked' WHEN 3 THEN 'retired' WHEN 4 THEN 'proposed' ELSE 'active' END AS needs,
  CASE b % 6 WHEN 0 THEN 'active' WHEN 1 THEN 'locked' WHEN 2 THEN 'active' WHEN 3 THEN 'active' WHEN 4 THEN 'retired' ELSE 'retired' END AS gets FROM old)
 SELECT concat('range:part:', p_brand) AS check_id, CASE WHEN b % 10 <> 3 AND status = needs THEN gets ELSE status END AS status, CASE WHEN b % 10 <> 3 AND status = needs THEN version + 1 ELSE version END AS version,
 CASE WHEN b % 10 = 3 THEN 'stale_version' WHEN status <> needs THEN 'invalid_transition' END AS refusal FROM m"""
_STATUS_COUNTS = ", ".join(f"{count_if(f'status = {chr(39)}{s}{chr(39)}')} AS {s}" for s in ("proposed", "active", "locked", "retired"))
COUNTS = SPECS + f"SELECT asset, {_STATUS_COUNTS} FROM (SELECT 'part' AS asset, status FROM old UNION ALL SELECT p_brand, status FROM old) GROUP BY 1"
LISTED = SPECS + "SELECT concat('range:part:', p_brand) AS check_id, p_brand AS \"column\", status FROM old WHERE status IN ('active', 'locked')"

STATE_ORACLE = {
    "link_findings": LINK, "mute_expiry": MUTE, "fold_summary": SUMMARY, "auto_resolve": AUTO, "finding_transitions": TRANSITIONS, "latest_occurrence": LATEST,
    "findings_page": PAGE, "finding_history": DETAIL, "scan_findings": SCAN_FINDINGS, "score_history": HISTORY, "score_change": CHANGE, "measures": MEASURES,
    "measure_series": SERIES, "measure_points": POINTS, "change_log": LOG, "changed_fields": FIELDS, "reconcile_checks": RECONCILE, "persist_checks": PERSIST,
    "check_events": EVENTS, "check_transitions": MOVES, "check_counts": COUNTS, "check_list": LISTED,
}
