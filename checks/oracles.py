"""Reference SQL (DuckDB) for the registered queries, built from named CTEs."""

from __future__ import annotations

import re

from tidemark.config import HalfSpace
from tidemark.operators.detectors import HalfSpaceTrees

CTES: dict[str, str] = {}

CTES["ev"] = """
  SELECT *, sha256(CAST(src_id AS VARCHAR) || '-' || CAST(delivery AS VARCHAR)) AS event_id FROM (
    SELECT *, 0 AS delivery FROM ev0
    UNION ALL SELECT * REPLACE (ingested_at + INTERVAL 3 SECOND AS ingested_at), 1 FROM ev0 WHERE src_id % 20 = 0
    UNION ALL SELECT * REPLACE (ingested_at + INTERVAL 8 SECOND AS ingested_at), 2 FROM ev0 WHERE src_id % 40 = 0)
"""
CTES["ev0"] = """
  SELECT event_id AS src_id,
    CASE WHEN event_id % 101 = 0 THEN 'marine'
         WHEN st = 0 THEN 'industrial' WHEN st = 1 THEN 'vehicle' ELSE 'network' END AS sensor_type,
    CASE WHEN event_id % 97 = 0 THEN 'bad id!'
         ELSE CASE st WHEN 0 THEN 'industrial' WHEN 1 THEN 'vehicle' ELSE 'network' END
              || '-device-' || lpad(CAST(user_id AS VARCHAR), 4, '0') END AS device_id,
    ts, ts + to_milliseconds(k * 10) AS ingested_at,
    CASE st WHEN 0 THEN 'temperature' WHEN 1 THEN 'speed' ELSE 'bytes_in' END AS f1,
    round(CASE st WHEN 0 THEN 50 + value * 0.2 WHEN 1 THEN value * 0.5 ELSE value * 1000 END
          * CASE WHEN event_id % 83 = 0 THEN 10 ELSE 1 END, 4) AS v1,
    CASE st WHEN 0 THEN 'pressure' WHEN 1 THEN 'engine_rpm' ELSE 'bytes_out' END AS f2,
    round(CASE st WHEN 0 THEN 0.25 + k * 0.085 WHEN 1 THEN 2000 + k * 10.0 ELSE k * 500.0 END, 4) AS v2,
    CASE st WHEN 0 THEN 'vibration' WHEN 1 THEN 'fuel_level' ELSE 'packet_loss' END AS f3,
    round(CASE st WHEN 0 THEN 2 + k * 0.05 + value * 0.02 WHEN 1 THEN k ELSE value * 0.012 END, 4) AS v3,
    event_id % 89 = 0 AS has_humidity, event_type AS source_tag,
    CASE WHEN user_id % 4 = 1 THEN 'acme' END AS tag_tenant,
    CASE WHEN user_id % 4 = 2 THEN 'globex' END AS tenant_id,
    event_id AS seq, CASE WHEN event_id % 10 = 9 THEN NULL ELSE value >= 200 END AS is_anomaly
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k, user_id % 3 AS st FROM events)
"""
# fixed values: the sensor catalog
CTES["cat"] = """
  SELECT * FROM (VALUES
    ('industrial', 'temperature', 'celsius', -20.0::DOUBLE, 120.0::DOUBLE, 65.0::DOUBLE, 2.0::DOUBLE, 1),
    ('industrial', 'pressure', 'bar', 0.0, 10.0, 4.5, 0.15, 2),
    ('industrial', 'vibration', 'mm/s', 0.0, 50.0, 3.2, 0.4, 3),
    ('vehicle', 'speed', 'km/h', 0.0, 200.0, 60.0, 5.0, 1),
    ('vehicle', 'engine_rpm', 'rpm', 0.0, 8000.0, 2200.0, 150.0, 2),
    ('vehicle', 'fuel_level', 'percent', 0.0, 100.0, 72.0, 0.5, 3),
    ('network', 'bytes_in', 'bytes', 0.0, 1000000000.0, 50000.0, 8000.0, 1),
    ('network', 'bytes_out', 'bytes', 0.0, 1000000000.0, 30000.0, 5000.0, 2),
    ('network', 'packet_loss', 'percent', 0.0, 100.0, 0.1, 0.05, 3)
  ) t(sensor_type, field, unit, lo, hi, baseline, noise, no)
"""
CTES["ml"] = """
  SELECT event_id, device_id, sensor_type, ts, 1 AS pos, f1 AS field, v1 AS value FROM ev
  UNION ALL SELECT event_id, device_id, sensor_type, ts, 2, f2, v2 FROM ev
  UNION ALL SELECT event_id, device_id, sensor_type, ts, 3, f3, v3 FROM ev
  UNION ALL SELECT event_id, device_id, sensor_type, ts, 4, 'humidity', 40.0 FROM ev WHERE has_humidity
"""
CTES["types"] = "SELECT DISTINCT sensor_type FROM cat"
CTES["err_schema"] = """
  SELECT event_id, 1 AS ord, 'schema: ''' || device_id || ''' does not match ''^[a-zA-Z0-9_-]+$''' AS error
  FROM ev WHERE NOT regexp_matches(device_id, '^[a-zA-Z0-9_-]+$')
  UNION ALL
  SELECT event_id, 2, 'schema: ''' || sensor_type || ''' is not one of [''industrial'', ''vehicle'', ''network'']'
  FROM ev WHERE sensor_type NOT IN (SELECT sensor_type FROM types)
"""
CTES["err_type"] = """
  SELECT event_id, 3 AS ord, 'unknown sensor_type: ' || sensor_type AS error
  FROM ev WHERE sensor_type NOT IN (SELECT sensor_type FROM types)
"""
CTES["err_field"] = """
  SELECT m.event_id, 10 + m.pos AS ord, 'unknown metric field: ' || m.field AS error
  FROM ml m LEFT JOIN cat c USING (sensor_type, field)
  WHERE c.field IS NULL AND m.sensor_type IN (SELECT sensor_type FROM types)
"""
CTES["err_range"] = """
  SELECT m.event_id, 10 + m.pos AS ord,
    'range: ' || m.field || '=' || CAST(m.value AS VARCHAR) || ' outside [' || CAST(c.lo AS VARCHAR) || ', '
      || CAST(c.hi AS VARCHAR) || ']' AS error
  FROM ml m JOIN cat c USING (sensor_type, field) WHERE m.value < c.lo OR m.value > c.hi
"""
CTES["errs"] = """
  SELECT * FROM err_schema UNION ALL SELECT * FROM err_type UNION ALL SELECT * FROM err_field
  UNION ALL SELECT * FROM err_range
"""
CTES["dd0"] = """
  SELECT event_id, ingested_at,
    hash_key, row_number() OVER (PARTITION BY hash_key ORDER BY ingested_at, event_id) AS rn
  FROM (SELECT event_id, ingested_at,
          device_id || '|' || CAST(ts AS VARCHAR) || '|' || f1 || v1 || '|' || f2 || v2 || '|' || f3 || v3 || '|'
          || CAST(has_humidity AS VARCHAR) AS hash_key FROM ev)
"""
CTES["dd"] = """
  SELECT event_id, hash_key, rn, ingested_at AS anchor, true AS kept FROM dd0 WHERE rn = 1
  UNION ALL
  SELECT d.event_id, d.hash_key, d.rn,
    CASE WHEN d.ingested_at > r.anchor + INTERVAL 5 SECOND THEN d.ingested_at ELSE r.anchor END,
    d.ingested_at > r.anchor + INTERVAL 5 SECOND
  FROM dd r JOIN dd0 d ON d.hash_key = r.hash_key AND d.rn = r.rn + 1
"""
CTES["cls"] = """
  SELECT e.* EXCLUDE (tenant_id), e.tenant_id AS raw_tenant,
    coalesce(e.tag_tenant, e.tenant_id, 'default') AS tenant_id, i.event_id IS NOT NULL AS is_invalid,
    NOT d.kept AS is_dup,
    i.event_id IS NULL AND NOT d.kept AS is_deduped,
    i.event_id IS NULL AND d.kept AS is_valid,
    (epoch_us(e.ingested_at) - epoch_us(e.ts)) / 1000.0 AS latency
  FROM ev e JOIN dd d USING (event_id) LEFT JOIN (SELECT DISTINCT event_id FROM errs) i USING (event_id)
"""
CTES["val"] = "SELECT * FROM cls WHERE is_valid"
CTES["vl"] = """
  SELECT v.tenant_id, v.device_id, v.sensor_type, v.event_id, v.ts, m.pos, m.field, m.value
  FROM val v JOIN ml m USING (event_id)
"""
# windows -------------------------------------------------------------------
CTES["win"] = """
  SELECT v.*, (epoch_us(v.ts) - epoch_us(e.a)) // 21600000000 AS window_no,
    (epoch_us(e.z) - epoch_us(e.a)) // 21600000000 AS newest
  FROM val v JOIN (SELECT tenant_id, device_id, sensor_type, min(ts) AS a, max(ts) AS z FROM val GROUP BY ALL) e
    USING (tenant_id, device_id, sensor_type)
"""
CTES["wl"] = """
  SELECT w.tenant_id, w.device_id, w.sensor_type, w.window_no, w.newest, w.event_id, w.ts, m.field, m.value
  FROM win w JOIN ml m USING (event_id)
"""
CTES["wst"] = """
  SELECT s.*, g.window_start, g.window_end FROM (
    SELECT tenant_id, device_id, sensor_type, window_no, any_value(newest) AS newest, field, count(*) AS count,
      avg(value) AS mean, min(value) AS min, max(value) AS max, stddev_pop(value) AS std
    FROM wl GROUP BY tenant_id, device_id, sensor_type, window_no, field) s
  JOIN (SELECT tenant_id, device_id, sensor_type, window_no, min(ts) AS window_start, max(ts) AS window_end
        FROM win GROUP BY ALL) g USING (tenant_id, device_id, sensor_type, window_no)
"""
CTES["em0"] = """
  SELECT *, row_number() OVER (PARTITION BY tenant_id, device_id, sensor_type ORDER BY ts, event_id) AS rn FROM win
"""
CTES["em"] = """
  SELECT tenant_id, device_id, sensor_type, rn, event_id, window_no, ts, ts AS last_emit, true AS emits
  FROM em0 WHERE rn = 1
  UNION ALL
  SELECT e.tenant_id, e.device_id, e.sensor_type, e.rn, e.event_id, e.window_no, e.ts,
    CASE WHEN e.ts >= r.last_emit + INTERVAL 1 HOUR THEN e.ts ELSE r.last_emit END,
    e.ts >= r.last_emit + INTERVAL 1 HOUR
  FROM em r JOIN em0 e ON e.device_id = r.device_id AND e.tenant_id = r.tenant_id
    AND e.sensor_type = r.sensor_type AND e.rn = r.rn + 1
"""
CTES["snap"] = """
  SELECT e.tenant_id, e.device_id, e.sensor_type, e.window_no, e.ts AS emitted_at, m.field, count(*) AS count,
    avg(m.value) AS mean, min(m.value) AS min, max(m.value) AS max, stddev_pop(m.value) AS std,
    min(b.ts) AS window_start, max(b.ts) AS window_end
  FROM em e JOIN em b ON b.tenant_id = e.tenant_id AND b.device_id = e.device_id AND b.sensor_type = e.sensor_type
    AND b.window_no = e.window_no AND b.rn <= e.rn
  JOIN ml m ON m.event_id = b.event_id
  WHERE e.emits
  GROUP BY e.tenant_id, e.device_id, e.sensor_type, e.window_no, e.ts, e.event_id, m.field
"""
# the events a stream has handled when its watermark is an hour behind the newest
CTES["sw"] = """
  SELECT *, min(ts) OVER w AS window_start, max(ts) OVER w AS window_end
  FROM sw0 WINDOW w AS (PARTITION BY tenant_id, device_id, sensor_type, window_no)
"""
CTES["sw0"] = """
  SELECT *, (epoch_us(ts) - epoch_us(min(ts) OVER k)) // 21600000000 AS window_no,
    (epoch_us(max(ts) OVER k) - epoch_us(min(ts) OVER k)) // 21600000000 AS newest,
    row_number() OVER (PARTITION BY tenant_id, device_id, sensor_type ORDER BY ts, event_id) AS rn
  FROM (SELECT event_id, coalesce(tag_tenant, tenant_id, 'default') AS tenant_id, device_id, sensor_type, ts FROM ev
        WHERE epoch_us(ts) <= ((SELECT max(epoch_us(ts)) FROM ev) // 1000 - 3600000) * 1000)
  WINDOW k AS (PARTITION BY tenant_id, device_id, sensor_type)
"""
CTES["swm"] = """
  SELECT tenant_id, device_id, sensor_type, rn, window_no, ts, ts AS last_emit, true AS emits, event_id, window_start FROM sw WHERE rn = 1
  UNION ALL
  SELECT e.tenant_id, e.device_id, e.sensor_type, e.rn, e.window_no, e.ts,
    CASE WHEN e.ts >= r.last_emit + INTERVAL 1 HOUR THEN e.ts ELSE r.last_emit END,
    e.ts >= r.last_emit + INTERVAL 1 HOUR, e.event_id, e.window_start
  FROM swm r JOIN sw e ON e.device_id = r.device_id AND e.tenant_id = r.tenant_id
    AND e.sensor_type = r.sensor_type AND e.rn = r.rn + 1
"""
CTES["arr"] = """
  SELECT *, min(ts) OVER (PARTITION BY tenant_id, device_id, sensor_type, window_no ORDER BY rn) AS window_start
  FROM (SELECT *, max(w) OVER a AS window_no, row_number() OVER a AS rn
  FROM (SELECT tenant_id, device_id, sensor_type, event_id, ts, ingested_at,
          (epoch_us(ts) - epoch_us(first_value(ts) OVER (PARTITION BY tenant_id, device_id, sensor_type
            ORDER BY ingested_at, event_id))) // 21600000000 AS w FROM val)
  WINDOW a AS (PARTITION BY tenant_id, device_id, sensor_type ORDER BY ingested_at, event_id ROWS UNBOUNDED PRECEDING))
"""
CTES["arm"] = """
  SELECT tenant_id, device_id, sensor_type, rn, window_no, ts, ts AS last_emit, true AS emits, event_id, window_start FROM arr WHERE rn = 1
  UNION ALL
  SELECT e.tenant_id, e.device_id, e.sensor_type, e.rn, e.window_no, e.ts,
    CASE WHEN e.ts >= r.last_emit + INTERVAL 1 HOUR THEN e.ts ELSE r.last_emit END,
    e.ts >= r.last_emit + INTERVAL 1 HOUR, e.event_id, e.window_start
  FROM arm r JOIN arr e ON e.device_id = r.device_id AND e.tenant_id = r.tenant_id
    AND e.sensor_type = r.sensor_type AND e.rn = r.rn + 1
"""
CTES["late"] = """
  SELECT event_id, tenant_id, device_id, sensor_type, ts, w AS window_no,
    max(w) OVER (PARTITION BY tenant_id, device_id, sensor_type ORDER BY ingested_at, event_id
                 ROWS UNBOUNDED PRECEDING) AS open_window
  FROM (SELECT *, CAST(floor((epoch_us(ts) - epoch_us(first_value(ts) OVER (
            PARTITION BY tenant_id, device_id, sensor_type ORDER BY ingested_at, event_id))) / 100000) AS BIGINT) AS w
        FROM val)
"""
# anomaly scores ------------------------------------------------------------
CTES["ew0"] = """
  SELECT *, row_number() OVER (PARTITION BY tenant_id, device_id, field ORDER BY ts, event_id) AS rn FROM vl
"""
CTES["ew"] = """
  SELECT tenant_id, device_id, field, rn, event_id, value, value AS m, 0.0::DOUBLE AS s FROM ew0 WHERE rn = 1
  UNION ALL
  SELECT e.tenant_id, e.device_id, e.field, e.rn, e.event_id, e.value,
    0.1 * e.value + 0.9 * r.m, 0.1 * (e.value - r.m) * (e.value - r.m) + 0.9 * r.s
  FROM ew r JOIN ew0 e ON e.device_id = r.device_id AND e.tenant_id = r.tenant_id AND e.field = r.field
    AND e.rn = r.rn + 1
"""
CTES["ews0"] = """
  SELECT e.tenant, e.device_id, m.field, e.event_id, m.value,
    row_number() OVER (PARTITION BY e.tenant, e.device_id, m.field ORDER BY e.ts, e.event_id) AS rn
  FROM (SELECT *, coalesce(tag_tenant, tenant_id, 'default') AS tenant FROM ev) e JOIN ml m USING (event_id)
"""
CTES["ews"] = """
  SELECT tenant, device_id, field, rn, event_id, value, value AS m, 0.0::DOUBLE AS s FROM ews0 WHERE rn = 1
  UNION ALL
  SELECT e.tenant, e.device_id, e.field, e.rn, e.event_id, e.value,
    0.1 * e.value + 0.9 * r.m, 0.1 * (e.value - r.m) * (e.value - r.m) + 0.9 * r.s
  FROM ews r JOIN ews0 e ON e.device_id = r.device_id AND e.tenant = r.tenant AND e.field = r.field AND e.rn = r.rn + 1
"""
# a network that keeps the mean of the scaled inputs; 0.05 weighs the new value in the running mean and spread
CTES["fz0"] = """
  SELECT tenant_id, device_id, sensor_type, event_id, v1::DOUBLE AS x, v2::DOUBLE AS y, v3::DOUBLE AS z,
    row_number() OVER (PARTITION BY tenant_id, device_id, sensor_type ORDER BY ts, event_id) AS rn FROM val
"""
CTES["fz"] = """
  SELECT tenant_id, device_id, sensor_type, rn, event_id, x, y, z, x AS mx, y AS my, z AS mz,
    0.95005::DOUBLE AS sx, 0.95005::DOUBLE AS sy, 0.95005::DOUBLE AS sz FROM fz0 WHERE rn = 1
  UNION ALL
  SELECT e.tenant_id, e.device_id, e.sensor_type, e.rn, e.event_id, e.x, e.y, e.z,
    0.95 * r.mx + 0.05 * e.x, 0.95 * r.my + 0.05 * e.y, 0.95 * r.mz + 0.05 * e.z,
    0.95 * r.sx + 0.05 * (abs(e.x - (0.95 * r.mx + 0.05 * e.x)) + 1e-3),
    0.95 * r.sy + 0.05 * (abs(e.y - (0.95 * r.my + 0.05 * e.y)) + 1e-3),
    0.95 * r.sz + 0.05 * (abs(e.z - (0.95 * r.mz + 0.05 * e.z)) + 1e-3)
  FROM fz r JOIN fz0 e ON e.device_id = r.device_id AND e.tenant_id = r.tenant_id AND e.sensor_type = r.sensor_type AND e.rn = r.rn + 1
"""
CTES["fzm"] = """
  SELECT event_id, ((a - (a + b + c) / 3) ** 2 + (b - (a + b + c) / 3) ** 2 + (c - (a + b + c) / 3) ** 2) / 3 AS mse
  FROM (SELECT event_id, greatest(-10.0, least(10.0, (x - mx) / sx)) AS a, greatest(-10.0, least(10.0, (y - my) / sy)) AS b,
          greatest(-10.0, least(10.0, (z - mz) / sz)) AS c FROM fz)
"""


def splits(cfg: HalfSpace, dims: int = 3) -> str:
    """The random splits that the seed gives, as rows: tree, node, feature (from 1), threshold."""
    feature, threshold = HalfSpaceTrees(cfg).forest(dims)
    rows = (f"({t}, {n}, {feature[t, n] + 1}, {float(threshold[t, n])!r}::DOUBLE)" for t in range(cfg.n_trees) for n in range(1, 2**cfg.height))
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") s(tree, node, f, cut)"


# half-space trees of 16 events a window: nodes each event visits, and the mass that the window before left in them
CTES["spl"] = splits(HalfSpace(window=16))
CTES["hx"] = """
  SELECT v.event_id, v.tenant_id, v.device_id, v.sensor_type, (v1 - a.lo) / (a.hi - a.lo) AS x1, (v2::DOUBLE - b.lo) / (b.hi - b.lo) AS x2,
    (v3::DOUBLE - c.lo) / (c.hi - c.lo) AS x3,
    (row_number() OVER (PARTITION BY v.tenant_id, v.device_id, v.sensor_type ORDER BY v.ts, v.event_id) - 1) // 16 AS slot
  FROM val v JOIN cat a ON a.field = v.f1 JOIN cat b ON b.field = v.f2 JOIN cat c ON c.field = v.f3
"""
CTES["hp"] = """
  SELECT event_id, tree, 0 AS depth, 1 AS node, x1, x2, x3 FROM hx, (SELECT DISTINCT tree FROM spl)
  UNION ALL
  SELECT h.event_id, h.tree, h.depth + 1, 2 * h.node + CAST(CASE s.f WHEN 1 THEN x1 WHEN 2 THEN x2 ELSE x3 END >= s.cut AS INT), x1, x2, x3
  FROM hp h JOIN spl s ON s.tree = h.tree AND s.node = h.node
"""
CTES["hm"] = """
  SELECT tenant_id, device_id, sensor_type, slot, tree, node, count(*) AS m FROM hp JOIN hx USING (event_id) GROUP BY ALL
"""
CTES["hs"] = """
  SELECT event_id, sum(CASE WHEN earlier THEN 0 ELSE m * 2 ** depth END) AS total
  FROM (SELECT *, coalesce(bool_or(m < 1.6) OVER (PARTITION BY event_id, tree ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS earlier
    FROM (SELECT p.event_id, p.tree, p.depth, coalesce(q.m, 0) AS m FROM hp p JOIN hx x USING (event_id)
      LEFT JOIN hm q ON q.tenant_id = x.tenant_id AND q.device_id = x.device_id AND q.sensor_type = x.sensor_type AND q.slot = x.slot - 1
        AND q.tree = p.tree AND q.node = p.node WHERE x.slot > 0))
  GROUP BY event_id
"""
CTES["iso"] = """
  SELECT x.event_id, CASE WHEN slot = 0 THEN 0.5 ELSE least(1.0, greatest(0.0, 1.5 - total / (10 * 16 * 511.0))) END AS isolation_forest
  FROM hx x LEFT JOIN hs USING (event_id)
"""
CTES["stat"] = """
  SELECT event_id, max(CASE WHEN rn < 20 THEN 0.0
                            ELSE least(1.0, abs(value - m) / sqrt(greatest(s, 1e-9)) / 3.5) END) AS statistical
  FROM ew GROUP BY event_id
"""
# fixed values: rules by field
CTES["rl"] = """
  SELECT event_id, field, pos, greatest(
      CASE WHEN value >= ca THEN 1.0 WHEN value >= wa THEN 0.6 ELSE 0.0 END,
      CASE WHEN value <= cb THEN 1.0 WHEN value <= wb THEN 0.6 ELSE 0.0 END)::DOUBLE AS score
  FROM vl LEFT JOIN (VALUES ('temperature', 95.0::DOUBLE, 110.0::DOUBLE, NULL::DOUBLE, NULL::DOUBLE),
    ('pressure', NULL, NULL, 1.0, 0.5), ('vibration', 15.0, 25.0, NULL, NULL), ('packet_loss', 1.0, 5.0, NULL, NULL))
    r(field, wa, ca, wb, cb) USING (field)
"""
CTES["rule"] = "SELECT event_id, max(score) AS rule_based FROM rl GROUP BY event_id"
# the checked ensemble weighs the two methods SQL can follow: statistical 0.7, rule_based 0.3
CTES["anom"] = """
  SELECT *, CASE WHEN greatest(score, rule_based) >= 0.9 THEN 'critical' WHEN greatest(score, rule_based) >= 0.75
      THEN 'high' WHEN greatest(score, rule_based) >= 0.65 THEN 'medium' ELSE 'low' END AS severity,
    CASE WHEN is_anomaly THEN 'ensemble=' || printf('%.2f', score) || ', top='
      || CASE WHEN statistical >= rule_based THEN 'statistical' ELSE 'rule_based' END || '='
      || printf('%.2f', greatest(statistical, rule_based)) ELSE '' END AS message
  FROM (SELECT v.event_id, v.tenant_id, v.device_id, v.sensor_type, v.ts, v.f1, v.f2, v.f3, s.statistical, r.rule_based,
          score, score >= 0.65 OR r.rule_based >= 1.0 AS is_anomaly, v.is_anomaly AS label
        FROM val v JOIN stat s USING (event_id) JOIN rule r USING (event_id),
          LATERAL (SELECT greatest(0.0, least(1.0, 0.7 * s.statistical + 0.3 * r.rule_based)) AS score))
  WHERE is_anomaly OR rule_based >= 0.6
"""
CTES["meth"] = """
  SELECT event_id, 'statistical' AS name, statistical AS score, 1 AS ord FROM anom
  UNION ALL SELECT event_id, 'rule_based', rule_based, 2 FROM anom
  UNION ALL SELECT a.event_id, 'rule_' || l.field, l.score, 2 + l.pos FROM anom a JOIN rl l USING (event_id)
"""
CTES["cand"] = """
  SELECT *, row_number() OVER (PARTITION BY tenant_id, device_id ORDER BY ts, event_id) AS rn
  FROM anom WHERE severity IN ('medium', 'high', 'critical')
"""
CTES["cool"] = """
  SELECT tenant_id, device_id, rn, event_id, ts AS sent, true AS kept FROM cand WHERE rn = 1
  UNION ALL
  SELECT c.tenant_id, c.device_id, c.rn, c.event_id,
    CASE WHEN c.ts >= r.sent + INTERVAL 12 HOUR THEN c.ts ELSE r.sent END, c.ts >= r.sent + INTERVAL 12 HOUR
  FROM cool r JOIN cand c ON c.tenant_id = r.tenant_id AND c.device_id = r.device_id AND c.rn = r.rn + 1
"""
# metrics and evaluation ----------------------------------------------------
CTES["lat"] = """
  SELECT tenant_id, ingested_at, event_id, latency FROM val
"""
CTES["lat500"] = """
  SELECT tenant_id, latency FROM val
  QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY ingested_at DESC, event_id DESC) <= 500
"""
CTES["inj"] = """
  SELECT *, CASE WHEN label = 'drift:vibration' THEN row_number() OVER (PARTITION BY device_id, label ORDER BY ts, event_id) END AS nth
  FROM (SELECT *, CASE WHEN draw < 0.02 THEN CASE sensor_type
      WHEN 'industrial' THEN ['spike:temperature', 'drift:vibration', 'flatline:pressure'][CAST(floor(pick * 3) AS INT) + 1]
      WHEN 'vehicle' THEN 'spike:engine_rpm' WHEN 'network' THEN 'spike:bytes_in' END END AS label
    FROM (SELECT *, CAST('0x' || substr(md5(event_id || '|42'), 1, 8) AS BIGINT) / 4294967296.0 AS draw,
            CAST('0x' || substr(md5(event_id || '|43'), 1, 8) AS BIGINT) / 4294967296.0 AS pick FROM ev))
"""
# labelled rows of a wide file: one device, rules alone
CTES["csv"] = """
  SELECT ev.event_id, ev.ts, ev.is_anomaly, coalesce(max(greatest(
      CASE WHEN m.value >= ca THEN 1.0 WHEN m.value >= wa THEN 0.6 ELSE 0.0 END,
      CASE WHEN m.value <= cb THEN 1.0 WHEN m.value <= wb THEN 0.6 ELSE 0.0 END)), 0.0)::DOUBLE AS score
  FROM ev JOIN ml m ON m.event_id = ev.event_id LEFT JOIN (VALUES ('temperature', 95.0::DOUBLE, 110.0::DOUBLE, NULL::DOUBLE, NULL::DOUBLE),
    ('pressure', NULL, NULL, 1.0, 0.5), ('vibration', 15.0, 25.0, NULL, NULL), ('packet_loss', 1.0, 5.0, NULL, NULL))
    r(field, wa, ca, wb, cb) ON r.field = m.field
  GROUP BY ev.event_id, ev.ts, ev.is_anomaly
"""
CTES["csvc"] = """
  SELECT t, count(*) FILTER (is_anomaly AND p) AS tp, count(*) FILTER (NOT is_anomaly AND p) AS fp,
    count(*) FILTER (NOT is_anomaly AND NOT p) AS tn, count(*) FILTER (is_anomaly AND NOT p) AS fn
  FROM (SELECT t, is_anomaly, score >= t OR score >= 1.0 AS p
    FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS rn, count(*) OVER () AS n FROM csv WHERE is_anomaly IS NOT NULL),
      (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9])::DOUBLE AS t)
    WHERE rn > least(50, n // 2))
  GROUP BY t
"""
CTES["latp"] = """
  SELECT tenant_id, count(*) AS samples, avg(latency) AS mean,
    list_sort(list(latency))[least(CAST(floor(count(*) * 50 / 100.0) AS BIGINT), count(*) - 1) + 1] AS p50,
    list_sort(list(latency))[least(CAST(floor(count(*) * 95 / 100.0) AS BIGINT), count(*) - 1) + 1] AS p95,
    list_sort(list(latency))[least(CAST(floor(count(*) * 99 / 100.0) AS BIGINT), count(*) - 1) + 1] AS p99
  FROM lat GROUP BY tenant_id
"""
CTES["thr"] = """
  SELECT tenant_id, CASE WHEN count(*) < 2 THEN count(*) / 21600.0
    WHEN max(ingested_at) = min(ingested_at) THEN count(*)::DOUBLE
    ELSE count(*) / ((epoch_us(max(ingested_at)) - epoch_us(min(ingested_at))) / 1000000.0) END AS eps
  FROM cls JOIN (SELECT tenant_id, max(ingested_at) AS z FROM cls GROUP BY 1) USING (tenant_id)
  WHERE ingested_at >= z - INTERVAL 6 HOUR GROUP BY tenant_id
"""
CTES["tm"] = """
  SELECT c.*, coalesce(a.anomalies, 0) AS anomalies_detected, p.mean, p.p95, p.p99, t.eps
  FROM (SELECT tenant_id, count(*) AS ingested, count(*) FILTER (is_valid) AS valid,
          count(*) FILTER (is_invalid) AS invalid, count(*) FILTER (is_deduped) AS deduped FROM cls GROUP BY 1) c
  LEFT JOIN (SELECT tenant_id, count(*) AS anomalies FROM anom GROUP BY 1) a USING (tenant_id)
  LEFT JOIN latp p USING (tenant_id) LEFT JOIN thr t USING (tenant_id)
"""
CTES["er"] = """
  SELECT l.event_id, l.is_anomaly, a.event_id IS NOT NULL AS emitted, coalesce(a.is_anomaly, false) AS flagged,
    a.score, coalesce(a.statistical, 0) AS statistical, coalesce(a.rule_based, 0) AS rule_based
  FROM (SELECT event_id, is_anomaly, row_number() OVER (ORDER BY ts, event_id) AS rn, count(*) OVER () AS n
        FROM val WHERE is_anomaly IS NOT NULL) l LEFT JOIN anom a USING (event_id)
  WHERE rn > least(50, n // 2)
"""
CTES["conf"] = """
  SELECT key, count(*) FILTER (is_anomaly AND p) AS tp, count(*) FILTER (NOT is_anomaly AND p) AS fp,
    count(*) FILTER (NOT is_anomaly AND NOT p) AS tn, count(*) FILTER (is_anomaly AND NOT p) AS fn
  FROM (SELECT 'ensemble' AS key, is_anomaly, emitted AND (flagged OR score >= 0.65) AS p FROM er
    UNION ALL SELECT 'statistical', is_anomaly, emitted AND statistical >= 0.65 FROM er
    UNION ALL SELECT 'rule_based', is_anomaly, emitted AND rule_based >= 0.65 FROM er
    UNION ALL SELECT 'isolation_forest', is_anomaly, false FROM er
    UNION ALL SELECT 'autoencoder', is_anomaly, false FROM er
    UNION ALL SELECT CAST(t AS VARCHAR), is_anomaly, emitted AND (flagged OR score >= t)
      FROM er, (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9])::DOUBLE AS t))
  GROUP BY key
"""
CTES["qual"] = """
  SELECT key, tp, fp, tn, fn, p AS precision, r AS recall, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f1,
    CASE WHEN tp + fp + tn + fn = 0 THEN 0 ELSE (tp + tn)::DOUBLE / (tp + fp + tn + fn) END AS accuracy
  FROM (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp) END AS p,
          CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fn) END AS r FROM conf)
"""


def sql(body: str) -> str:
    """The statement with the CTEs it needs, in order of dependence."""
    names: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"\b[a-z_0-9]+\b", text)):
            if word in CTES and word not in names and word not in visiting:
                visiting.add(word)
                visit(CTES[word])
                names.append(word)

    visiting: set[str] = set()
    visit(body)
    if not names:
        return body
    ctes = ",\n".join(f"{n} AS ({CTES[n]})" for n in names)
    return f"WITH RECURSIVE {ctes}\n{body}"
