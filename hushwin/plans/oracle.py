"""DuckDB SQL that states, independently of the Spark code, what each
registered query must return. Tables are the driver's pre-registered views.

Times: DuckDB's ``epoch_ms`` rounds, Spark's ``unix_millis`` floors, so the
oracle uses ``epoch_us(ts) // 1000``.
"""

from __future__ import annotations

# --- Shared row sources (same fixed parameters as hushwin.sources.tables) ----
REC = """rec AS (
  SELECT 0 AS shard, event_id AS seq, epoch_us(ts) // 1000 AS p, epoch_us(ts) // 1000 AS t,
         CAST(user_id % 10 AS INTEGER) AS key, value, event_type AS topic
  FROM events)"""

NAN_REC = """rec AS (
  SELECT 0 AS shard, event_id AS seq, epoch_us(ts) // 1000 AS p, epoch_us(ts) // 1000 AS t,
         CAST(user_id % 10 AS INTEGER) AS key,
         CASE WHEN event_id % 7 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END AS value,
         event_type AS topic
  FROM events)"""


def _keep_max(win_cte: str, keys: str) -> str:
    """Keep-max fold per (keys, window_start_ms): first record if its value is
    NaN, else the earliest record with the largest non-NaN value."""
    return f"""{win_cte},
first AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys}, window_start_ms ORDER BY p, seq) AS rn FROM w)
  WHERE rn = 1),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys}, window_start_ms ORDER BY value DESC, p, seq) AS rn
                 FROM w WHERE NOT isnan(value))
  WHERE rn = 1)
SELECT f.{keys.replace(', ', ', f.')}, f.window_start_ms, f.window_end_ms,
       CASE WHEN isnan(f.value) OR b.seq IS NULL THEN f.t ELSE b.t END AS event_time_ms,
       CASE WHEN isnan(f.value) OR b.seq IS NULL THEN f.value ELSE b.value END AS value,
       CASE WHEN isnan(f.value) OR b.seq IS NULL THEN f.seq ELSE b.seq END AS seq
FROM first f LEFT JOIN best b USING ({keys}, window_start_ms)"""


ORACLE: dict[str, str] = {}

ORACLE["tumbling_assign"] = f"""WITH {REC}
SELECT seq, t AS event_time_ms, t - t % 10000 AS window_start_ms, t - t % 10000 + 10000 AS window_end_ms
FROM rec"""

ORACLE["window_reduce_max"] = f"""WITH {REC}
, w AS (SELECT *, t - t % 86400000 AS window_start_ms, t - t % 86400000 + 86400000 AS window_end_ms FROM rec)
SELECT key, window_start_ms, window_end_ms, t AS event_time_ms, value, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY key, window_start_ms ORDER BY value DESC, p, seq) AS rn FROM w)
WHERE rn = 1"""

ORACLE["window_reduce_max_nan"] = "WITH " + _keep_max(
    NAN_REC + """,
w AS (SELECT *, t - t % 86400000 AS window_start_ms, t - t % 86400000 + 86400000 AS window_end_ms FROM rec)""",
    "key")

ORACLE["window_max_by"] = f"""WITH {NAN_REC}
, w AS (SELECT *, t - t % 86400000 AS window_start_ms, t - t % 86400000 + 86400000 AS window_end_ms FROM rec)
SELECT key, window_start_ms, window_end_ms, t AS event_time_ms, value, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY key, window_start_ms
                               ORDER BY isnan(value) DESC, value DESC, p, seq) AS rn FROM w)
WHERE rn = 1"""

ORACLE["sliding_reduce_max"] = "WITH " + _keep_max(
    REC + """,
w AS (
  SELECT rec.*, s.window_start_ms, s.window_start_ms + 86400000 AS window_end_ms
  FROM rec, LATERAL (SELECT t - t % 21600000 - k * 21600000 AS window_start_ms FROM range(0, 4) r(k)) s)""",
    "key")

ORACLE["session_reduce_max"] = "WITH " + _keep_max(
    REC + """,
g AS (SELECT *, CASE WHEN lag(t) OVER (PARTITION BY key ORDER BY t, seq) IS NULL
                       OR t - lag(t) OVER (PARTITION BY key ORDER BY t, seq) >= 1800000 THEN 1 ELSE 0 END AS st
      FROM rec),
s AS (SELECT *, sum(st) OVER (PARTITION BY key ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                AS session_id FROM g),
w AS (SELECT *, min(t) OVER (PARTITION BY key, session_id) AS window_start_ms,
                max(t) OVER (PARTITION BY key, session_id) + 1800000 AS window_end_ms FROM s)""",
    "key")

# JSON fixture: kind = seq % 10. 0 no time, 2 not JSON, 3 bad time, 4 string value
# -> quarantined; 1 -> defaults (-1, -Infinity); others decode as written.
JSON_DECODED = f"""WITH {REC}
SELECT topic, seq, t AS event_time_ms,
       CASE WHEN seq % 10 = 1 THEN -1 ELSE key END AS key,
       CASE WHEN seq % 10 = 1 THEN CAST('-Infinity' AS DOUBLE) ELSE value END AS value
FROM rec WHERE seq % 10 NOT IN (0, 2, 3, 4)"""

ORACLE["json_decode"] = JSON_DECODED
ORACLE["json_roundtrip"] = JSON_DECODED
ORACLE["json_quarantine"] = f"""WITH {REC}
SELECT topic, seq, CASE WHEN seq % 10 = 0 THEN 'no_event_time' ELSE 'unparsable' END AS reason
FROM rec WHERE seq % 10 IN (0, 2, 3, 4)"""
ORACLE["topic_fanout"] = f"""WITH d AS ({JSON_DECODED})
SELECT o.topic, d.seq, d.event_time_ms, d.key, d.value
FROM d CROSS JOIN (VALUES ('test-out'), ('audit')) o(topic)"""
ORACLE["topic_pattern"] = f"""WITH {REC}
SELECT topic, seq FROM rec WHERE regexp_full_match(topic, 'c.*|pur.*')"""
ORACLE["start_position"] = f"""WITH {REC}
SELECT seq, t AS event_time_ms FROM rec WHERE t >= 1705276800000"""

JITTERED = """rec AS (
  SELECT CAST(event_id % 4 AS INTEGER) AS shard, event_id AS seq,
         epoch_us(ts) // 1000 + (event_id * 7919) % 14400000 AS p, epoch_us(ts) // 1000 AS t,
         CAST(user_id % 10 AS INTEGER) AS key, value, event_type AS topic
  FROM events)"""

ORACLE["round_robin"] = f"""WITH {JITTERED}
SELECT shard, seq, CAST((shard + row_number() OVER (PARTITION BY shard ORDER BY p, seq)) % 4 AS INTEGER)
       AS out_partition
FROM rec"""

ORACLE["bounded_watermark"] = f"""WITH {JITTERED}
SELECT shard, seq, p, t AS event_time_ms,
       max(t) OVER (PARTITION BY shard ORDER BY p, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
         - 600000 - 1 AS wm_ms
FROM rec"""

LATE = f"""{JITTERED},
m AS (SELECT *, t - t % 3600000 AS window_start_ms, t - t % 3600000 + 3600000 AS window_end_ms,
             max(t) OVER (PARTITION BY shard ORDER BY p, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
               AS max_before_ms
      FROM rec),
l AS (SELECT *, coalesce(window_end_ms <= max_before_ms - 600000, false) AS is_late FROM m)"""

ORACLE["late_rows"] = f"""WITH {LATE}
SELECT shard, seq, t AS event_time_ms, window_start_ms, window_end_ms, max_before_ms, is_late FROM l"""

ORACLE["late_drop"] = f"""WITH {LATE}
SELECT shard, key, window_start_ms, window_end_ms, t AS event_time_ms, value, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY shard, key, window_start_ms ORDER BY value DESC, p, seq) AS rn
  FROM l WHERE NOT is_late)
WHERE rn = 1"""

# Decoupled replay: arrival (event_id // 4) * 170 s, heartbeat every I ms.
def decoupled_sql(idle: int) -> str:
    return f"""rec AS (
  SELECT CAST(event_id % 4 AS INTEGER) AS shard, event_id AS seq, (event_id // 4) * 170000 AS p,
         epoch_us(ts) // 1000 AS t, CAST(user_id % 10 AS INTEGER) AS key, value
  FROM events),
ticks AS (
  SELECT shard, -n AS seq, n * {idle} AS p, n * {idle} AS t, n
  FROM (SELECT shard, unnest(range(1, max(p) // {idle} + 1)) AS n FROM rec GROUP BY shard))"""


# The clock, walked one row at a time per shard (the reference's own rule):
# tick f: s2 = d + f; real t: if |t - s2| >= 3I then d += t - s2; s2 = t.
# Then the watermark input before each row and late real rows (L = 0).
def epoch_sql(idle: int) -> str:
    """Jittered rows and the ticks of a source that starts with the day of the first arrival."""
    return f"""{JITTERED},
start AS (SELECT min(p) - min(p) % 86400000 AS origin FROM rec),
ticks AS (
  SELECT shard, -n AS seq, origin + n * {idle} AS p, n * {idle} AS t
  FROM (SELECT shard, origin, unnest(range(1, (max(p) - origin) // {idle} + 1)) AS n FROM rec, start GROUP BY shard, origin))"""


def walk_sql(idle: int, size: int, source: str | None = None) -> str:
    band = 3 * idle
    return f"""RECURSIVE {source or decoupled_sql(idle)},
tr AS (
  SELECT *, row_number() OVER (PARTITION BY shard ORDER BY p, real, seq) AS rn FROM (
    SELECT shard, seq, p, t, 1 AS real, key, value FROM rec
    UNION ALL
    SELECT shard, seq, p, t, 0 AS real, -1 AS key, CAST('-Infinity' AS DOUBLE) AS value FROM ticks)),
walk(shard, rn, s2, d, re) AS (
  SELECT DISTINCT shard, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0 FROM rec
  UNION ALL
  SELECT tr.shard, tr.rn,
         CASE WHEN tr.real = 1 THEN tr.t ELSE walk.d + tr.t END,
         CASE WHEN tr.real = 1 AND abs(tr.t - walk.s2) >= {band} THEN walk.d + tr.t - walk.s2 ELSE walk.d END,
         CASE WHEN tr.real = 1 AND abs(tr.t - walk.s2) >= {band} THEN 1 ELSE 0 END
  FROM walk JOIN tr ON tr.shard = walk.shard AND tr.rn = walk.rn + 1),
proj AS (SELECT tr.*, walk.s2, walk.d, walk.re FROM tr JOIN walk USING (shard, rn)),
seen AS (
  SELECT *, t - t % {size} AS window_start_ms, t - t % {size} + {size} AS window_end_ms,
         max(s2) OVER (PARTITION BY shard ORDER BY p, real, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
           AS max_before_ms
  FROM proj),
late AS (SELECT *, real = 1 AND coalesce(window_end_ms <= max_before_ms, false) AS is_late FROM seen)"""


def heartbeat_close_sql(idle: int, size: int, source: str | None = None) -> str:
    return f"""WITH {walk_sql(idle, size, source)},
kept AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY shard, key, window_start_ms ORDER BY value DESC, p, seq) AS k
    FROM late WHERE real = 1 AND NOT is_late)
  WHERE k = 1)
SELECT shard, key, window_start_ms, window_end_ms, t AS event_time_ms, value, seq,
       (SELECT min(pr.p) FROM proj pr WHERE pr.shard = kept.shard AND pr.s2 >= kept.window_end_ms) AS close_ms
FROM kept"""


DECOUPLED = decoupled_sql(300000)
WALK = walk_sql(300000, 3600000)

ORACLE["heartbeat_ticks"] = f"""WITH {DECOUPLED}
SELECT shard, n, p AS tick_ms FROM ticks"""

ORACLE["connect_union"] = f"""WITH {DECOUPLED}
SELECT shard, seq, p, t, true AS is_real, key, value FROM rec
UNION ALL
SELECT shard, seq, p, t, false AS is_real, -1 AS key, CAST('-Infinity' AS DOUBLE) AS value FROM ticks"""

ORACLE["drop_heartbeats"] = f"""WITH {DECOUPLED}
SELECT shard, seq, p, t FROM rec"""

ORACLE["projected_clock"] = f"""WITH {WALK}
SELECT shard, seq, p, real = 1 AS is_real, s2, d, re AS reanchored FROM proj"""

ORACLE["heartbeat_window_close"] = heartbeat_close_sql(300000, 3600000)

# The heartbeat job with the reference's own defaults: 10 s windows,
# heartbeat / idle interval 30 s, L = 0.
ORACLE["heartbeat_job_defaults"] = heartbeat_close_sql(30000, 10000)

ORACLE["heartbeat_epoch_replay"] = heartbeat_close_sql(300000, 3600000, epoch_sql(300000))

ORACLE["lateness_histogram"] = f"""WITH {JITTERED},
b AS (SELECT shard, greatest(coalesce(max(t) OVER (PARTITION BY shard ORDER BY p, seq
                                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - t, 0), 0) AS behind
      FROM rec)
SELECT shard, behind - behind % 600000 AS late_from_ms, count(*) AS n_rows FROM b GROUP BY ALL"""

ORACLE["shard_progress"] = f"""WITH {WALK}
SELECT shard, CAST(sum(real) AS BIGINT) AS n_real, CAST(sum(1 - real) AS BIGINT) AS n_tick,
       CAST(sum(re) AS BIGINT) AS n_reanchored, CAST(sum(CAST(is_late AS BIGINT)) AS BIGINT) AS n_late,
       max(CASE WHEN real = 1 THEN t END) AS max_event_ms,
       arg_max(s2, rn) AS last_projected_ms, arg_max(d, rn) AS last_offset_ms
FROM late GROUP BY shard"""

ORACLE["close_latency"] = f"""WITH {JITTERED},
g AS (SELECT shard, key, t - t % 3600000 AS window_start_ms, t - t % 3600000 + 3600000 AS window_end_ms,
             count(*) AS n_rows, max(p) AS last_arrival_ms
      FROM rec GROUP BY ALL),
c AS (SELECT g.*, (SELECT min(r.p) FROM rec r WHERE r.shard = g.shard AND r.t >= g.window_end_ms + 60000)
                    AS close_ms FROM g)
SELECT *, close_ms - window_end_ms AS delay_ms FROM c"""

# Idle replay: four shards arriving at event time, 5 min grid, 20 min idle timeout.
IDLE_REC = """rec AS (
  SELECT CAST(event_id % 4 AS INTEGER) AS shard, event_id AS seq, epoch_us(ts) // 1000 AS p,
         epoch_us(ts) // 1000 AS t
  FROM events)"""

ORACLE["idle_intervals"] = f"""WITH {IDLE_REC},
n AS (SELECT shard, p, lead(p) OVER (PARTITION BY shard ORDER BY p, seq) AS nx FROM rec)
SELECT shard, p + 1200000 AS idle_from_ms, nx AS idle_to_ms FROM n WHERE nx IS NULL OR nx - p > 1200000"""

def combined_grid_sql(src: str, grid: int, idle: int) -> str:
    """The combined watermark per grid cell from CTE ``src`` (shard, p, t):
    min over non-idle shards, max over all if every shard is idle, L = 0,
    never moving back."""
    return f"""cells AS (SELECT shard, p // {grid} AS g, max(t) AS mt, max(p) AS mp FROM {src} GROUP BY ALL),
grid AS (SELECT s.shard, gg.g FROM (SELECT DISTINCT shard FROM cells) s
         CROSS JOIN (SELECT unnest(range(min(g), max(g) + 1)) AS g FROM cells) gg),
f AS (SELECT grid.shard, grid.g,
             max(c.mt) OVER (PARTITION BY grid.shard ORDER BY grid.g ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
               AS max_t,
             max(c.mp) OVER (PARTITION BY grid.shard ORDER BY grid.g ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
               AS last_p
      FROM grid LEFT JOIN cells c ON c.shard = grid.shard AND c.g = grid.g),
per AS (SELECT g, last_p IS NULL OR (g + 1) * {grid} - last_p > {idle} AS idle, max_t - 1 AS wm FROM f),
comb AS (SELECT g, sum(CAST(idle AS INTEGER)) AS n_idle,
                coalesce(min(wm) FILTER (WHERE NOT idle), max(wm)) AS wm
         FROM per GROUP BY g),
wmg AS (SELECT g, n_idle, max(wm) OVER (ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS wm_ms
        FROM comb)"""


def idle_grid_sql(rec: str) -> str:
    """The combined watermark per 5 min cell (20 min idle timeout, L = 0)."""
    return f"""{rec},
{combined_grid_sql("rec", 300000, 1200000)}"""


ORACLE["idle_watermark"] = f"""WITH {idle_grid_sql(IDLE_REC)}
SELECT g * 300000 AS grid_start_ms, CAST(n_idle AS INTEGER) AS n_idle, wm_ms FROM wmg"""

# The idle-timeout job on the jittered replay: a row in cell c sees the
# watermark emitted at the end of cell c - 1; maxBy over rows whose window
# had not closed; close = first emission with wm >= end - 1.
ORACLE["idle_timeout_job"] = f"""WITH {idle_grid_sql(JITTERED)},
r AS (SELECT rec.*, t - t % 3600000 AS ws, t - t % 3600000 + 3600000 AS we, w.wm_ms
      FROM rec LEFT JOIN wmg w ON w.g = rec.p // 300000 - 1),
k AS (SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY key, ws ORDER BY isnan(value) DESC, value DESC, p, seq) AS rn
        FROM r WHERE NOT coalesce(we - 1 <= wm_ms, false))
      WHERE rn = 1)
SELECT key, ws AS window_start_ms, we AS window_end_ms, t AS event_time_ms, value, seq,
       (SELECT min((g + 1) * 300000) FROM wmg WHERE wmg.wm_ms >= k.we - 1) AS close_ms
FROM k"""

# Idle close on the jittered replay, processing time = arrival: per key,
# bursts split by arrival gaps >= 30 min; late if the window ended by the
# last timer's close or by the key's event time; close at the first of the
# event-time close and the first burst's end + 30 min.
ORACLE["idle_close"] = f"""WITH {JITTERED},
a AS (SELECT *, lag(p) OVER k AS pp,
             max(t) OVER (k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mb
      FROM rec WINDOW k AS (PARTITION BY key ORDER BY p, seq)),
b AS (SELECT *, sum(CASE WHEN pp IS NULL OR p - pp >= 1800000 THEN 1 ELSE 0 END)
                  OVER (PARTITION BY key ORDER BY p, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS burst
      FROM a),
bs AS (SELECT key, burst, max(t) AS bmax, max(p) AS bend FROM b GROUP BY key, burst),
bp AS (SELECT *, max(bmax) OVER (PARTITION BY key ORDER BY burst ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                 AS prior FROM bs),
c AS (SELECT b.*, bp.bend, bp.prior, b.t - b.t % 3600000 AS ws, b.t - b.t % 3600000 + 3600000 AS we
      FROM b JOIN bp ON b.key = bp.key AND b.burst = bp.burst),
acc AS (SELECT * FROM c
        WHERE NOT (coalesce(we <= prior - prior % 3600000 + 3600000, false) OR coalesce(we <= mb, false))),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, ws ORDER BY p, seq) AS r1 FROM acc) WHERE r1 = 1),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, ws ORDER BY value DESC, p, seq) AS r2 FROM acc)
      WHERE r2 = 1),
g AS (SELECT k.key, k.ws, k.we, k.t, k.value, k.seq, f.bend + 1800000 AS timer,
             (SELECT min(r.p) FROM rec r WHERE r.key = k.key AND r.t >= k.we) AS ev
      FROM k JOIN f ON k.key = f.key AND k.ws = f.ws)
SELECT key, ws AS window_start_ms, we AS window_end_ms, t AS event_time_ms, value, seq,
       CASE WHEN ev IS NOT NULL AND ev < timer THEN ev ELSE timer END AS close_ms,
       CASE WHEN ev IS NOT NULL AND ev < timer THEN 'event_time' ELSE 'idle_timeout' END AS closed_by
FROM g"""


# Several shards, one window operator: the watermark is the minimum of the
# shards' projected clocks (heartbeats every 5 min, emitted every 5 min;
# a shard counts once it has started), windows per key, keep-max.
ORACLE["heartbeat_min_shards"] = f"""WITH {walk_sql(300000, 3600000)},
prog AS (SELECT shard, p, s2 AS t FROM proj),
{combined_grid_sql("prog", 300000, 1 << 60)},
r AS (SELECT seen.*, w.wm_ms FROM seen LEFT JOIN wmg w ON w.g = seen.p // 300000 - 1 WHERE seen.real = 1),
k AS (SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY key, window_start_ms ORDER BY value DESC, p, seq) AS kn
        FROM r WHERE NOT coalesce(window_end_ms - 1 <= wm_ms, false))
      WHERE kn = 1)
SELECT key, window_start_ms, window_end_ms, t AS event_time_ms, value, seq,
       (SELECT min((g + 1) * 300000) FROM wmg WHERE wmg.wm_ms >= k.window_end_ms - 1) AS close_ms
FROM k"""
