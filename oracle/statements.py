"""DuckDB statements that answer the registered queries independently.

Shared CTEs are assembled per statement; where Spark uses range frames,
conditional aggregates or cell joins, the SQL uses plain joins on purpose.
"""

from __future__ import annotations

LAGS = (1, 2, 3, 4, 6, 12, 24, 48, 336)
HORIZONS = (30, 60, 120, 180)

# name -> (CTEs it needs, text)
PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def part(name: str, needs: str, text: str) -> None:
    PARTS[name] = (tuple(needs.split()), text)


def _readings(station: str) -> str:
    return f"""
    SELECT {station} AS station_id, ts AS raw_ts, event_id,
           CASE WHEN event_id % 211 = 0 THEN 0 ELSE cap END AS docks_total,
           CASE WHEN dead THEN 0 ELSE lvl END AS bikes,
           CASE WHEN dead THEN 0 ELSE cap - lvl END AS docks_avail
    FROM (SELECT *, least(CAST(floor(value / 2) AS INTEGER), cap) AS lvl,
                 event_id % 211 = 0 OR event_id % 97 = 0 AS dead
          FROM (SELECT *, CAST(20 + 4 * (user_id % 6) AS INTEGER) AS cap FROM events))"""


def _places(across: int, wide: bool) -> str:
    # concat makes a plain column of one that DuckDB read as a dictionary; some of its
    # versions end a join on such a column with an internal error.
    name = "concat(n_name, '_', station_id)" if wide else "concat(n_name, '')"
    return f"""
    SELECT station_id, {name} AS name, CASE WHEN station_id <> 7 THEN concat(r_name, '') END AS district,
           121.4e0 + 0.004e0 * CAST(station_id % {across} AS DOUBLE)
             + 0.000001e0 * CAST((station_id * station_id * 277 + station_id * 17) % 991 AS DOUBLE) AS lon,
           25e0 + 0.004e0 * CAST(station_id // {across} AS DOUBLE)
             + 0.000001e0 * CAST((station_id * station_id * 389 + station_id * 31) % 997 AS DOUBLE) AS lat
    FROM (SELECT DISTINCT station_id FROM {'wide_readings' if wide else 'readings'})
    JOIN nation ON n_nationkey = station_id % 25 JOIN region ON r_regionkey = n_regionkey"""


part("readings", "", _readings("user_id % 16"))
part("wide_readings", "", _readings("user_id"))
part("places", "readings", _places(4, False))
part("wide_places", "wide_readings", _places(40, True))
part("snaps", "readings", """
    SELECT station_id, ts, w.bikes AS bikes, w.docks_avail AS docks_avail, w.docks_total AS docks_total
    FROM (SELECT station_id, time_bucket(INTERVAL '30 minutes', raw_ts) AS ts,
                 arg_max({'bikes': bikes, 'docks_avail': docks_avail, 'docks_total': docks_total}, raw_ts) AS w
          FROM readings GROUP BY ALL)""")
part("stations", "snaps places", """
    SELECT p.*, s.capacity_docks, s.first_ts, s.last_ts, s.n_snapshots, p.station_id = 13 AS always_empty
    FROM places p JOIN (SELECT station_id, max(docks_total) AS capacity_docks, min(ts) AS first_ts,
                               max(ts) AS last_ts, count(*) AS n_snapshots
                        FROM snaps GROUP BY station_id) s ON s.station_id = p.station_id""")
part("live_stations", "stations", "SELECT * FROM stations WHERE always_empty IS NOT TRUE")
part("newest", "snaps", """
    SELECT s.* FROM snaps s
    JOIN (SELECT station_id, max(ts) AS ts FROM snaps GROUP BY 1) m
      ON m.station_id = s.station_id AND m.ts = s.ts""")
part("valid", "snaps", "SELECT * FROM snaps WHERE docks_total > 0 AND bikes + docks_avail > 0")
part("model_stations", "stations", """
    SELECT *, CAST(dense_rank() OVER (ORDER BY district) - 1 AS INTEGER) AS district_id,
           CAST(station_id % 6 AS INTEGER) AS cluster_id
    FROM stations WHERE capacity_docks > 0 AND NOT always_empty AND n_snapshots >= 30
                    AND district IS NOT NULL""")
part("obs", "valid model_stations", """
    SELECT v.*, CAST(bikes AS DOUBLE) / docks_total AS ratio
    FROM valid v WHERE station_id IN (SELECT station_id FROM model_stations)""")
part("profile", "snaps", """
    SELECT station_id, CAST(isodow(ts) AS INTEGER) AS isodow,
           CAST(datepart('hour', ts) * 2 + datepart('minute', ts) // 30 AS INTEGER) AS slot,
           count(*) AS n,
           round(quantile_cont(bikes, 0.5) + 1e-9, 2) AS bikes_p50, round(quantile_cont(bikes, 0.1) + 1e-9, 2) AS bikes_p10,
           round(quantile_cont(bikes, 0.9) + 1e-9, 2) AS bikes_p90, round(avg(bikes) + 1e-9, 2) AS bikes_mean,
           round(count(*) FILTER (bikes = 0) / count(*) + 1e-9, 4) AS empty_rate,
           round(count(*) FILTER (docks_avail = 0) / count(*) + 1e-9, 4) AS full_rate,
           round(avg(bikes / nullif(docks_total, 0)) + 1e-9, 4) AS occ_rate
    FROM snaps GROUP BY 1, 2, 3""")
part("rollup", "profile", """
    SELECT isodow, slot, round(sum(empty_rate * n) / sum(n) + 1e-9, 4) AS empty_rate,
           round(sum(full_rate * n) / sum(n) + 1e-9, 4) AS full_rate,
           round(sum(occ_rate * n) / sum(n) + 1e-9, 4) AS occ_rate, CAST(sum(n) AS BIGINT) AS n
    FROM profile GROUP BY 1, 2""")
PULSE_COLS = """
           ts, CAST(datepart('hour', ts) * 2 + datepart('minute', ts) // 30 AS INTEGER) AS slot,
           count(*) AS n_stations,
           count(*) FILTER (bikes = 0 AND docks_avail > 0) AS n_empty,
           count(*) FILTER (docks_avail = 0 AND bikes > 0) AS n_full,
           count(*) FILTER (bikes + docks_avail > 0 AND least(bikes, docks_avail) <= 2) AS n_risk,
           CAST(sum(bikes) AS BIGINT) AS bikes,
           round(sum(bikes) / nullif(sum(docks_total), 0) + 1e-9, 4) AS occ_rate"""
part("pulse_all", "snaps live_stations", f"""
    SELECT {PULSE_COLS} FROM snaps SEMI JOIN live_stations USING (station_id) GROUP BY ts""")
part("last_day", "snaps", "SELECT CAST(max(ts) AS DATE) AS day FROM snaps")
part("pulse_day", "pulse_all last_day", """
    SELECT * FROM pulse_all WHERE CAST(ts AS DATE) = (SELECT day FROM last_day)""")
part("base_day", "profile live_stations last_day", """
    SELECT slot, round(sum(empty_rate) + 1e-9, 1) AS n_empty, round(sum(full_rate) + 1e-9, 1) AS n_full
    FROM profile SEMI JOIN live_stations USING (station_id)
    WHERE isodow = (SELECT isodow(day) FROM last_day) GROUP BY slot""")
part("district_now", "newest live_stations", """
    SELECT district, count(*) AS n_stations, CAST(sum(docks_total) AS BIGINT) AS docks_total,
           CAST(sum(bikes) AS BIGINT) AS bikes, CAST(sum(docks_avail) AS BIGINT) AS docks_avail,
           round(sum(bikes) / nullif(sum(docks_total), 0) + 1e-9, 4) AS occ_rate,
           count(*) FILTER (bikes = 0 AND docks_avail > 0) AS n_empty,
           count(*) FILTER (docks_avail = 0 AND bikes > 0) AS n_full,
           count(*) FILTER (bikes = 0 AND docks_avail = 0) AS n_offline,
           count(*) FILTER (bikes IN (1, 2)) AS n_near_empty,
           count(*) FILTER (docks_avail IN (1, 2)) AS n_near_full
    FROM newest JOIN live_stations USING (station_id) WHERE district IS NOT NULL GROUP BY district""")
part("station_rates", "snaps", """
    SELECT station_id, count(*) AS n,
           round(count(*) FILTER (bikes = 0) / count(*) + 1e-9, 4) AS empty_rate,
           round(count(*) FILTER (docks_avail = 0) / count(*) + 1e-9, 4) AS full_rate
    FROM snaps GROUP BY 1 HAVING count(*) > 100""")
part("stay", "valid", """
    SELECT c.station_id, c.ts, any_value(CASE WHEN c.bikes = 0 THEN 'empty' ELSE 'full' END) AS kind,
           max(p.ts) FILTER (CASE WHEN c.bikes = 0 THEN p.bikes <> 0 ELSE p.docks_avail <> 0 END) AS ok_ts,
           min(p.ts) AS seen_ts
    FROM valid c JOIN valid p ON p.station_id = c.station_id AND p.ts <= c.ts
         AND p.ts > c.ts - INTERVAL 6 HOUR
    WHERE c.bikes = 0 OR c.docks_avail = 0 GROUP BY 1, 2""")
part("episode", "stay", """
    SELECT station_id, ts, kind, ok_ts IS NULL AS duration_capped,
           CAST(date_diff('minute', coalesce(ok_ts, seen_ts), ts) AS INTEGER) AS duration_min FROM stay""")


def _alert_rows(as_of: str | None) -> str:
    """Alerts of the newest valid slot up to as_of, built from runs of rows."""
    upto = f"WHERE ts <= TIMESTAMP '{as_of}'" if as_of else ""
    return f"""
    SELECT a.station_id, name, district, lon, lat, capacity_docks, a.ts, bikes, docks_avail, docks_total,
           kind, duration_min, duration_capped,
           CASE WHEN kind NOT IN ('empty', 'full') THEN 'notice'
                WHEN duration_min >= 60 THEN 'critical' ELSE 'warning' END AS level
    FROM (
      SELECT *, kind IN ('empty', 'full') AND ok_ts IS NULL AS duration_capped,
             CAST(CASE WHEN kind IN ('empty', 'full')
                       THEN date_diff('minute', coalesce(ok_ts, seen_ts), ts) ELSE 0 END AS INTEGER)
               AS duration_min
      FROM (
        SELECT n.*, min(p.ts) AS seen_ts,
               max(p.ts) FILTER ((kind = 'empty' AND p.bikes > 0) OR (kind = 'full' AND p.docks_avail > 0))
                 AS ok_ts
        FROM (SELECT *, CASE WHEN bikes = 0 THEN 'empty' WHEN docks_avail = 0 THEN 'full'
                             WHEN bikes <= 2 THEN 'near_empty' WHEN docks_avail <= 2 THEN 'near_full'
                        END AS kind
              FROM valid WHERE ts = (SELECT max(ts) FROM valid {upto})
                AND ts > (SELECT max(ts) - INTERVAL 6 HOUR FROM snaps {upto})) n
        JOIN valid p ON p.station_id = n.station_id AND p.ts <= n.ts
             AND p.ts > (SELECT max(ts) - INTERVAL 6 HOUR FROM snaps {upto})
        WHERE kind IS NOT NULL GROUP BY ALL)) a
    JOIN live_stations USING (station_id)"""


part("alert_now", "valid snaps live_stations", _alert_rows(None))
part("alert_then", "valid snaps live_stations", _alert_rows("2024-01-20 12:00:00"))
part("alert_before", "valid snaps live_stations", _alert_rows("2024-01-20 11:30:00"))
part("cells", "obs", """
    SELECT station_id, unnest(generate_series(min(ts), max(ts), INTERVAL 30 MINUTE)) AS ts
    FROM obs GROUP BY station_id""")
part("ahead", "obs", "SELECT o.station_id, o.ts, o.bikes, o.docks_avail, o.docks_total, o.ratio, " + ", ".join(
    f"f{h}.ratio AS y_ratio_{h}, f{h}.bikes AS y_bikes_{h}, f{h}.docks_avail AS y_docks_{h}, "
    f"w{h}.ratio AS bl_lastweek_{h}" for h in HORIZONS) + " FROM obs o " + " ".join(
    f"LEFT JOIN obs f{h} ON f{h}.station_id = o.station_id AND f{h}.ts = o.ts + INTERVAL {h} MINUTE "
    f"LEFT JOIN obs w{h} ON w{h}.station_id = o.station_id "
    f"AND w{h}.ts = o.ts + INTERVAL {h} MINUTE - INTERVAL 7 DAY" for h in HORIZONS))
part("behind", "obs", "SELECT o.station_id, o.ts, " + ", ".join(
    f"p{k}.ratio AS ratio_lag{k}" for k in LAGS) + " FROM obs o " + " ".join(
    f"LEFT JOIN obs p{k} ON p{k}.station_id = o.station_id AND p{k}.ts = o.ts - INTERVAL {30 * k} MINUTE"
    for k in LAGS))
part("rolled", "obs", "SELECT o.station_id, o.ts, " + ", ".join(
    f"avg(p.ratio) FILTER (p.ts > o.ts - INTERVAL {30 * n} MINUTE) AS roll_mean_{n}, "
    f"stddev_samp(p.ratio) FILTER (p.ts > o.ts - INTERVAL {30 * n} MINUTE) AS roll_std_{n}"
    for n in (4, 12)) + """,
           avg(p.ratio) AS roll_mean_48, min(p.ratio) AS roll_min_48, max(p.ratio) AS roll_max_48,
           CAST(count(*) FILTER (p.ts > o.ts - INTERVAL 180 MINUTE AND p.bikes <= 1) AS INTEGER) AS empty_streak,
           CAST(count(*) FILTER (p.ts > o.ts - INTERVAL 180 MINUTE AND p.docks_avail <= 1) AS INTEGER) AS full_streak
    FROM obs o JOIN obs p ON p.station_id = o.station_id AND p.ts <= o.ts AND p.ts > o.ts - INTERVAL 24 HOUR
    GROUP BY 1, 2""")
part("day_edges", "", """
    SELECT lo + CAST(n - 2 * (n // 6) AS INTEGER) AS valid_from, lo + CAST(n - n // 6 AS INTEGER) AS test_from
    FROM (SELECT lo, hi - lo + 1 AS n
          FROM (SELECT CAST(min(ts) AS DATE) AS lo, CAST(max(ts) AS DATE) AS hi FROM events))""")
part("usual", "obs day_edges", """
    SELECT station_id, CAST(dayofweek(ts) AS INTEGER) AS dow,
           CAST(datepart('hour', ts) * 2 + datepart('minute', ts) // 30 AS INTEGER) AS slot_of_day,
           avg(ratio) AS norm_ratio, count(*) FILTER (bikes <= 1) / count(*) AS norm_empty_rate,
           count(*) FILTER (docks_avail <= 1) / count(*) AS norm_full_rate
    FROM obs WHERE ts < (SELECT valid_from FROM day_edges) GROUP BY 1, 2, 3""")
part("near", "model_stations", """
    SELECT station_id, neighbour_id, km FROM (
      SELECT a.station_id, b.station_id AS neighbour_id,
             111e0 * sqrt((a.lat - b.lat) ** 2 + ((a.lon - b.lon) * cos(radians(a.lat))) ** 2) AS km
      FROM model_stations a, model_stations b WHERE a.station_id <> b.station_id)
    WHERE km <= 1
    QUALIFY count(*) OVER (PARTITION BY station_id ORDER BY round(km, 9), neighbour_id
                           ROWS UNBOUNDED PRECEDING) <= 5""")
part("near_mean", "near obs", """
    SELECT near.station_id, ts, avg(ratio) AS neigh_ratio, count(*) AS neigh_n
    FROM near JOIN obs ON obs.station_id = neighbour_id GROUP BY 1, 2""")
part("member_obs", "obs model_stations", """
    SELECT obs.*, district, cluster_id FROM obs JOIN model_stations USING (station_id)""")
part("district_mean", "member_obs", "SELECT district, ts, avg(ratio) AS district_ratio FROM member_obs GROUP BY 1, 2")
part("cluster_mean", "member_obs", "SELECT cluster_id, ts, avg(ratio) AS cluster_ratio FROM member_obs GROUP BY 1, 2")
part("hour_mean", "obs", """
    SELECT CAST(ts AS DATE) AS day, CAST(datepart('hour', ts) AS INTEGER) AS hour, avg(ratio) AS r
    FROM obs GROUP BY 1, 2""")
part("day_shape", "hour_mean", """
    SELECT day, hour, r, (r - m) / (s + 1e-9) AS z
    FROM hour_mean JOIN (SELECT day, avg(r) AS m, stddev_pop(r) AS s FROM hour_mean GROUP BY day
                         HAVING count(*) = (SELECT count(DISTINCT hour) FROM hour_mean)) USING (day)""")
part("day_gap", "day_shape", """
    SELECT day, sqrt(sum((z - e) ** 2)) AS to_weekend, sqrt(sum((z - w) ** 2)) AS to_workday
    FROM (SELECT a.day, a.hour, any_value(a.z) AS z,
                 avg(b.z) FILTER (isodow(b.day) >= 6) AS e, count(*) FILTER (isodow(b.day) >= 6) AS ne,
                 avg(b.z) FILTER (isodow(b.day) < 6 AND b.day <> a.day) AS w,
                 count(*) FILTER (isodow(b.day) < 6 AND b.day <> a.day) AS nw
          FROM day_shape a JOIN day_shape b ON b.hour = a.hour AND abs(b.day - a.day) <= 21
          WHERE isodow(a.day) < 6 GROUP BY 1, 2)
    WHERE ne >= 4 AND nw >= 8 GROUP BY day""")
part("bucket_mean", "obs day_edges", """
    SELECT station_id, CAST(datepart('hour', ts) + CASE WHEN isodow(ts) >= 6 THEN 24 ELSE 0 END AS INTEGER)
             AS bucket, avg(ratio) AS lvl
    FROM obs WHERE ts < (SELECT valid_from FROM day_edges) GROUP BY 1, 2""")
part("bucket_fill", "bucket_mean", """
    SELECT s.station_id, CAST(b.bucket AS INTEGER) AS bucket,
           CASE WHEN l.bucket IS NULL THEN u.lvl WHEN u.bucket IS NULL OR u.bucket = l.bucket THEN l.lvl
                ELSE l.lvl + (u.lvl - l.lvl) * (CAST(b.bucket - l.bucket AS DOUBLE) / (u.bucket - l.bucket))
           END AS level
    FROM (SELECT DISTINCT station_id FROM bucket_mean) s
    CROSS JOIN (SELECT unnest(range(48)) AS bucket) b
    LEFT JOIN bucket_mean l ON l.station_id = s.station_id AND l.bucket =
      (SELECT max(x.bucket) FROM bucket_mean x WHERE x.station_id = s.station_id AND x.bucket <= b.bucket)
    LEFT JOIN bucket_mean u ON u.station_id = s.station_id AND u.bucket =
      (SELECT min(x.bucket) FROM bucket_mean x WHERE x.station_id = s.station_id AND x.bucket >= b.bucket)""")
part("bridging", "obs", """
    SELECT station_id, CAST(dayofweek(ts) AS INTEGER) AS dow,
           CAST(datepart('hour', ts) * 2 + datepart('minute', ts) // 30 AS INTEGER) AS slot_of_day,
           arg_max(bikes, ts) AS bikes, arg_max(docks_avail, ts) AS docks_avail,
           arg_max(docks_total, ts) AS docks_total, arg_max(ratio, ts) AS ratio
    FROM obs WHERE ts >= (SELECT max(ts) - INTERVAL 28 DAY FROM obs) GROUP BY 1, 2, 3""")
part("bridged", "obs bridging model_stations", """
    SELECT c.station_id, c.ts, coalesce(o.bikes, b.bikes) AS bikes,
           coalesce(o.docks_avail, b.docks_avail) AS docks_avail,
           coalesce(o.docks_total, b.docks_total) AS docks_total,
           coalesce(o.ratio, b.ratio) AS ratio, o.station_id IS NOT NULL AS is_live
    FROM (SELECT station_id, unnest(generate_series(t - INTERVAL 7 DAY, t, INTERVAL 30 MINUTE)) AS ts
          FROM model_stations, (SELECT max(ts) AS t FROM obs)) c
    LEFT JOIN obs o ON o.station_id = c.station_id AND o.ts = c.ts
    LEFT JOIN bridging b ON b.station_id = c.station_id AND b.dow = dayofweek(c.ts)
      AND b.slot_of_day = datepart('hour', c.ts) * 2 + datepart('minute', c.ts) // 30""")
_WHOLE = " AND ".join(f"y_ratio_{h} IS NOT NULL" for h in HORIZONS)
part("targets", "ahead", " UNION ALL ".join(
    f"""SELECT station_id, ts, bikes, docks_avail, docks_total, ratio, {h} AS horizon, y_ratio_{h} AS y_ratio,
               y_bikes_{h} AS y_bikes, y_docks_{h} AS y_docks, bl_lastweek_{h} AS lastweek
        FROM ahead WHERE {_WHOLE}""" for h in HORIZONS))
part("scored", "targets", """
    SELECT *, ratio + (0.5e0 - ratio) * horizon / 6e2 AS pred_ratio,
           round(3e0 / (3e0 + bikes) * (1e0 - horizon / 1e3), 6) AS proba_empty,
           round(3e0 / (3e0 + docks_avail) * (1e0 - horizon / 1e3), 6) AS proba_full
    FROM targets""")
part("judged", "scored", """
    SELECT station_id, ts, horizon, 'empty' AS kind, proba_empty AS proba, y_bikes <= 1 AS fact FROM scored
    UNION ALL
    SELECT station_id, ts, horizon, 'full', proba_full, y_docks <= 1 FROM scored""")
part("baseline", "targets", """
    SELECT horizon, 'persistence' AS model, ratio AS pred, y_ratio, y_bikes, y_docks, docks_total FROM targets
    UNION ALL
    SELECT horizon, 'lastweek', lastweek, y_ratio, y_bikes, y_docks, docks_total
    FROM targets WHERE lastweek IS NOT NULL""")
part("firing", "judged", """
    SELECT j.horizon, kind, t.threshold, count(*) FILTER (fact AND proba >= threshold) AS tp,
           count(*) FILTER (NOT fact AND proba >= threshold) AS fp,
           count(*) FILTER (fact AND proba < threshold) AS fn
    FROM judged j CROSS JOIN (SELECT i / 2e1 AS threshold FROM range(1, 20) x(i)) t GROUP BY 1, 2, 3""")


def _prf(src: str) -> str:
    return f"""
    SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
                   ELSE 0e0 END AS f1
    FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0e0 END AS precision,
                    CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0e0 END AS recall FROM {src})"""


part("firing_prf", "firing", _prf("firing"))


def _starts(src: str) -> str:
    """Rows numbered per station; a start joins its next row and lacks its previous one."""
    return f"""
    SELECT a.station_id, a.ts, a.kind FROM {src} a
    JOIN {src} n ON n.station_id = a.station_id AND n.kind = a.kind AND n.i = a.i + 1 AND n.inside
    LEFT JOIN {src} p ON p.station_id = a.station_id AND p.kind = a.kind AND p.i = a.i - 1
    WHERE a.inside AND (p.inside IS NULL OR NOT p.inside)"""


def _states(src: str) -> str:
    return f"""
    SELECT station_id, ts, kind, i, CASE kind WHEN 'empty' THEN bikes <= 1
                                              ELSE docks_total - bikes <= 1 END AS inside
    FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY ts) AS i FROM {src})
    CROSS JOIN (VALUES ('empty'), ('full')) k(kind)"""


part("obs_states", "obs", _states("obs"))
part("obs_starts", "obs_states", _starts("obs_states"))
part("target_rows", "scored", "SELECT station_id, ts, bikes, docks_total FROM scored WHERE horizon = 30")
part("target_states", "target_rows", _states("target_rows"))
part("target_starts", "target_states", _starts("target_states"))
part("obs_judged", "obs", """
    SELECT station_id, ts, h AS horizon, kind,
           round(3e0 / (3e0 + CASE kind WHEN 'empty' THEN bikes ELSE docks_avail END) * (1e0 - h / 1e3), 6) AS proba
    FROM obs CROSS JOIN (VALUES (30), (60), (120), (180)) x(h) CROSS JOIN (VALUES ('empty'), ('full')) k(kind)""")


def _leads(starts: str, judged: str) -> str:
    return f"""
    SELECT s.station_id, s.ts, s.kind, CAST(coalesce(max(j.horizon), 0) AS INTEGER) AS lead
    FROM {starts} s LEFT JOIN {judged} j
      ON j.station_id = s.station_id AND j.kind = s.kind AND j.proba >= 0.3
     AND date_diff('minute', j.ts, s.ts) = j.horizon
    GROUP BY 1, 2, 3"""


part("obs_leads", "obs_starts obs_judged", _leads("obs_starts", "obs_judged"))
part("target_leads", "target_starts judged", _leads("target_starts", "judged"))
part("duty", "obs rolled", """
    SELECT o.station_id, o.ts, o.bikes, empty_streak, round(3e0 / (3e0 + bikes) * 0.94e0, 6) AS proba
    FROM obs o JOIN rolled r ON r.station_id = o.station_id AND r.ts = o.ts""")
part("queue", "duty", """
    SELECT station_id, ts, CASE WHEN bikes <= 1 THEN 'rule' ELSE 'prevent' END AS queue,
           CASE WHEN bikes <= 1 THEN CAST(empty_streak AS DOUBLE) ELSE proba END AS score FROM duty""")
part("picked", "queue", """
    SELECT q.station_id, q.ts, q.queue, q.score, CAST(1 + count(b.station_id) AS INTEGER) AS rank
    FROM queue q LEFT JOIN queue b ON b.ts = q.ts AND b.queue = q.queue
      AND (b.score > q.score OR (b.score = q.score AND b.station_id < q.station_id))
    GROUP BY 1, 2, 3, 4""")
part("crew", "", "SELECT unnest([5, 10, 20, 40]) AS capacity")
part("empties", "duty", "SELECT station_id, ts FROM duty WHERE bikes <= 1")
part("saved", "picked empties crew", """
    SELECT capacity, e.station_id, e.ts,
           bool_or(queue = 'prevent' AND rank <= capacity) AS p, bool_or(queue = 'rule' AND rank <= capacity) AS r,
           bool_or(rank <= greatest(capacity // 2, 1)) AS h
    FROM empties e JOIN picked k ON k.station_id = e.station_id
      AND date_diff('minute', k.ts, e.ts) BETWEEN CASE queue WHEN 'prevent' THEN 60 ELSE 30 END
                                              AND CASE queue WHEN 'prevent' THEN 150 ELSE 120 END
    CROSS JOIN crew GROUP BY 1, 2, 3""")
part("forecast", "valid places", """
    SELECT n.station_id, name, district, n.ts AS base_ts, h AS horizon, bikes AS now_bikes,
           docks_avail AS now_docks_avail, docks_total, pred_ratio, pred_bikes,
           greatest(docks_total - pred_bikes, 0) AS pred_docks, greatest(pred_bikes - 2, 0) AS pred_bikes_lo,
           least(pred_bikes + 2, docks_total) AS pred_bikes_hi, proba_empty, proba_full,
           proba_empty >= 0.7 AS alert_empty, proba_full >= 0.7 AS alert_full,
           proba_empty >= 0.3 AS watch_empty, proba_full >= 0.3 AS watch_full
    FROM (SELECT *, CAST(round_even(least(greatest(pred_ratio, 0), 1) * docks_total, 0) AS INTEGER) AS pred_bikes
          FROM (SELECT v.*, h, CAST(bikes AS DOUBLE) / docks_total
                         + (0.5e0 - CAST(bikes AS DOUBLE) / docks_total) * h / 6e2 AS pred_ratio,
                       round(3e0 / (3e0 + bikes) * (1e0 - h / 1e3), 6) AS proba_empty,
                       round(3e0 / (3e0 + docks_avail) * (1e0 - h / 1e3), 6) AS proba_full
                FROM valid v CROSS JOIN (VALUES (30), (60), (120), (180)) x(h)
                WHERE ts = (SELECT max(m.ts) FROM valid m WHERE m.station_id = v.station_id))) n
    JOIN places p ON p.station_id = n.station_id""")
part("task", "forecast places", """
    SELECT n.station_id AS to_station, n.name AS to_name, n.district, n.now_bikes, n.pred_bikes AS to_pred_bikes,
           n.docks_total AS to_capacity, n.proba_empty, need_bikes, g.station_id AS from_station,
           g.name AS from_name, g.spare_bikes, g.proba_full, g.km
    FROM (SELECT f.*, lon, lat, CAST(greatest(3, ceil(docks_total * 0.35e0) - pred_bikes) AS INTEGER) AS need_bikes
          FROM forecast f JOIN places USING (station_id) WHERE horizon = 60 AND watch_empty) n
    LEFT JOIN LATERAL (
      SELECT f.station_id, f.name, f.proba_full,
             CAST(greatest(3, pred_bikes - floor(docks_total * 0.65e0)) AS INTEGER) AS spare_bikes,
             111e0 * sqrt((n.lat - p.lat) ** 2 + ((n.lon - p.lon) * cos(radians(n.lat))) ** 2) AS km
      FROM forecast f JOIN places p USING (station_id)
      WHERE horizon = 60 AND watch_full AND f.station_id <> n.station_id
        AND 111e0 * sqrt((n.lat - p.lat) ** 2 + ((n.lon - p.lon) * cos(radians(n.lat))) ** 2) <= 1.2e0
      ORDER BY round(km, 9), f.station_id LIMIT 1) g ON true
    ORDER BY n.proba_empty DESC, need_bikes DESC, to_station""")
part("task_out", "task", """
    SELECT to_station, to_name, district, now_bikes, to_pred_bikes, to_capacity,
           round(proba_empty, 3) AS proba_empty, need_bikes, from_station, from_name, spare_bikes,
           round(proba_full, 3) AS proba_full, round(km, 2) AS distance_km,
           least(need_bikes, coalesce(spare_bikes, need_bikes)) AS move_bikes FROM task""")


def _typed(fixed: bool) -> str:
    """Text sources as they parse: minutes only before the 16th, seconds after."""
    name = "name" if fixed else ("CASE WHEN raw_ts < TIMESTAMP '2024-01-16' AND r.station_id = 3 "
                                 "THEN 'NATION?3' ELSE name END")
    return f"""
    SELECT {name} AS name, district, lon, lat, docks_total, bikes, docks_avail,
           CASE WHEN raw_ts < TIMESTAMP '2024-01-16' THEN date_trunc('minute', raw_ts)
                ELSE date_trunc('second', raw_ts) END AS raw_ts
    FROM readings r JOIN places p ON p.station_id = r.station_id"""


def _slot_rows(src: str) -> str:
    return f"""
    SELECT *, time_bucket(INTERVAL '30 minutes', raw_ts) AS ts FROM {src}
    QUALIFY row_number() OVER (PARTITION BY name, time_bucket(INTERVAL '30 minutes', raw_ts)
                               ORDER BY raw_ts DESC, bikes DESC, docks_avail DESC, docks_total DESC) = 1"""


def _commonest(src: str, col: str) -> str:
    return f"""
    SELECT name, {col} FROM {src} WHERE {col} IS NOT NULL GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, {col}) = 1"""


def _master(src: str) -> str:
    return f"""
    SELECT row_number() OVER (ORDER BY first_ts, name) AS station_id, g.*, d.district, x.lon, y.lat
    FROM (SELECT name, max(docks_total) AS capacity_docks, min(ts) AS first_ts, max(ts) AS last_ts,
                 count(*) AS n_snapshots, max(bikes) = 0 AS always_empty,
                 count(DISTINCT (lon, lat)) AS n_coord_variants FROM {src} GROUP BY name) g
    LEFT JOIN ({_commonest(src, 'district')}) d USING (name)
    LEFT JOIN ({_commonest(src, 'lon')}) x USING (name)
    LEFT JOIN ({_commonest(src, 'lat')}) y USING (name)"""


part("typed", "readings places", _typed(True))
part("typed_raw", "readings places", _typed(False))
part("slot_rows", "typed", _slot_rows("typed"))
part("slot_rows_raw", "typed_raw", _slot_rows("typed_raw"))
part("master", "slot_rows", _master("slot_rows"))
part("master_raw", "slot_rows_raw", _master("slot_rows_raw"))
part("feed", "wide_readings wide_places", """
    SELECT r.*, name, district, lon, lat, time_bucket(INTERVAL '30 minutes', raw_ts) AS ts
    FROM wide_readings r JOIN wide_places USING (station_id)""")


def build(body: str, *needs: str) -> str:
    """Statement with the CTEs it needs, dependencies first."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in PARTS[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)
    for n in needs:
        visit(n)
    ctes = ",\n".join(f"{n} AS ({PARTS[n][1]})" for n in order)
    return (f"WITH {ctes}\n" if ctes else "") + body


STATEMENTS: dict[str, str] = {}


def stmt(name: str, needs: str, body: str) -> None:
    STATEMENTS[name] = build(body, *needs.split())


def r6(*cols: str) -> str:
    """Six decimals, never a negative zero."""
    return ", ".join(f"CASE WHEN round({c} + 1e-9, 6) = 0 THEN 0e0 ELSE round({c} + 1e-9, 6) END AS {c}" for c in cols)


OCC = "round(bikes / nullif(docks_total, 0) + 1e-9, 4)"
STATUS = """CASE WHEN coalesce(docks_total, 0) = 0 OR bikes + docks_avail = 0 THEN 'offline'
                 WHEN bikes = 0 THEN 'empty' WHEN docks_avail = 0 THEN 'full'
                 WHEN bikes <= 2 THEN 'near_empty' WHEN docks_avail <= 2 THEN 'near_full' ELSE 'normal' END"""

stmt("snapshot_dedupe", "snaps", "SELECT * FROM snaps")
stmt("snapshot_enriched", "snaps stations", f"""
    SELECT station_id, name, district, ts, CAST(ts AS DATE) AS date, CAST(datepart('hour', ts) AS INTEGER) AS hour,
           CAST(isodow(ts) AS INTEGER) AS isodow, isodow(ts) > 5 AS is_weekend, bikes, docks_avail, docks_total,
           bikes = 0 AS is_empty, docks_avail = 0 AS is_full, {OCC} AS occ_rate, {r6('lon', 'lat')}, always_empty
    FROM snaps JOIN stations USING (station_id)""")
stmt("status_ladder", "snaps", f"SELECT {STATUS} AS status, count(*) AS n FROM snaps GROUP BY 1")
stmt("name_fix_union", "typed", """
    SELECT name, district, count(*) AS n, min(raw_ts) AS first_ts, max(raw_ts) AS last_ts FROM typed GROUP BY 1, 2""")
stmt("station_master", "master", f"SELECT * EXCLUDE (lon, lat), {r6('lon', 'lat')} FROM master")
stmt("history_build", "master slot_rows", """
    SELECT m.station_id, count(*) AS n, CAST(sum(bikes) AS BIGINT) AS bikes,
           CAST(sum(docks_avail) AS BIGINT) AS docks_avail, CAST(sum(docks_total) AS BIGINT) AS docks_total,
           min(ts) AS first_ts, max(ts) AS last_ts
    FROM slot_rows JOIN master m USING (name) GROUP BY 1""")
stmt("registry_append", "feed", f"""
    SELECT station_id, name, district, {r6('lon', 'lat')}, capacity_docks, first_ts, last_ts, n_snapshots, always_empty
    FROM (SELECT station_id, name, min(district) AS district, min(lon) AS lon, min(lat) AS lat,
                 max(docks_total) FILTER (mine) AS capacity_docks, min(ts) FILTER (mine) AS first_ts,
                 max(ts) FILTER (mine) AS last_ts, count(*) FILTER (mine) AS n_snapshots,
                 early AND max(bikes) FILTER (mine) = 0 AS always_empty
          FROM (SELECT *, (ts < TIMESTAMP '2024-01-03') = early AS mine
                FROM (SELECT *, min(ts) OVER (PARTITION BY station_id) < TIMESTAMP '2024-01-03' AS early FROM feed))
          GROUP BY station_id, name, early)""")
stmt("station_merge", "wide_places", """
    SELECT coalesce(w.station_id, c_custkey) AS station_id, coalesce(w.name, c_name) AS name,
           CASE WHEN w.station_id IS NULL THEN 'master' ELSE 'feed' END AS origin
    FROM wide_places w FULL JOIN customer ON c_custkey = w.station_id""")
stmt("unknown_customers", "", """
    SELECT o_custkey, count(*) AS n_orders FROM orders
    WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = o_custkey) GROUP BY 1""")
stmt("qc_month", "snaps", """
    SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n_rows, count(DISTINCT station_id) AS n_stations,
           round(100e0 * count(*) FILTER (bikes = 0) / count(*) + 1e-9, 2) AS empty_pct,
           round(100e0 * count(*) FILTER (docks_avail = 0) / count(*) + 1e-9, 2) AS full_pct FROM snaps GROUP BY 1""")
stmt("qc_station", "master_raw", """
    SELECT count(*) AS n_stations, count(*) FILTER (always_empty) AS n_always_empty,
           count(*) - count(district) AS n_no_district, count(*) FILTER (contains(name, '?')) AS n_damaged_name,
           count(*) FILTER (n_coord_variants > 1) AS n_moved FROM master_raw""")
stmt("qc_misaligned", "snaps", "SELECT count(*) FILTER (datepart('minute', ts) % 30 <> 0) AS n_misaligned FROM snaps")
stmt("latest", "newest", "SELECT * FROM newest")
stmt("latest_slot", "snaps stations", f"""
    SELECT station_id, ts, bikes, docks_avail, docks_total, name, district, {r6('lon', 'lat')}, ts AS fetched_at
    FROM snaps JOIN stations USING (station_id) WHERE ts = (SELECT max(ts) FROM snaps)""")
stmt("station_list", "newest live_stations", f"""
    SELECT station_id, name, district, {r6('lon', 'lat')}, capacity_docks, always_empty, ts, bikes, docks_avail,
           docks_total, {OCC} AS occ_rate, {STATUS} AS status
    FROM live_stations LEFT JOIN newest USING (station_id)""")
stmt("mappable_stations", "stations", f"SELECT station_id, name, {r6('lon', 'lat')} FROM stations WHERE lon * lat <> 0")
_LONG_RUN = f"""count(*) AS n_snapshots, round(avg(bikes) + 1e-9, 2) AS bikes_mean,
           round(count(*) FILTER (bikes = 0) / count(*) + 1e-9, 4) AS empty_rate,
           round(count(*) FILTER (docks_avail = 0) / count(*) + 1e-9, 4) AS full_rate,
           round(avg(bikes / nullif(docks_total, 0)) + 1e-9, 4) AS occ_rate"""
stmt("station_stats", "snaps", f"SELECT station_id, {_LONG_RUN} FROM snaps GROUP BY 1")
stmt("station_detail", "snaps stations newest", f"""
    SELECT s.station_id, name, district, capacity_docks, s.n_snapshots, ts, {STATUS} AS status,
           bikes_mean, empty_rate, full_rate, occ_rate
    FROM stations s JOIN newest USING (station_id)
    JOIN (SELECT station_id, {_LONG_RUN} FROM snaps GROUP BY 1) t ON t.station_id = s.station_id
    WHERE s.station_id = 3""")
stmt("station_history", "snaps", f"""
    SELECT ts, bikes, docks_avail, docks_total, {OCC} AS occ_rate FROM snaps
    WHERE station_id = 3 AND ts > (SELECT max(ts) - INTERVAL 7 DAY FROM snaps)""")
stmt("replay", "snaps live_stations", f"""
    SELECT station_id, name, district, {r6('lon', 'lat')}, ts, bikes, docks_avail, docks_total, {OCC} AS occ_rate,
           {STATUS} AS status
    FROM snaps JOIN live_stations USING (station_id) WHERE ts = TIMESTAMP '2024-01-15 08:00:00'""")
stmt("replay_status", "newest live_stations", f"""
    SELECT {STATUS} AS status, count(*) AS n_stations FROM live_stations LEFT JOIN newest USING (station_id) GROUP BY 1""")
stmt("replay_days", "snaps", """
    SELECT CAST(ts AS DATE) AS day, count(*) AS n_rows, count(DISTINCT ts) AS n_slots FROM snaps GROUP BY 1
    HAVING count(DISTINCT ts) >= 40""")
stmt("weekly_profile", "profile", "SELECT * FROM profile")
stmt("profile_rollup", "rollup", "SELECT * FROM rollup")
stmt("profile_district", "profile stations", """
    SELECT isodow, slot, round(sum(empty_rate * n) / sum(n) + 1e-9, 4) AS empty_rate,
           round(sum(full_rate * n) / sum(n) + 1e-9, 4) AS full_rate,
           round(sum(occ_rate * n) / sum(n) + 1e-9, 4) AS occ_rate, CAST(sum(n) AS BIGINT) AS n
    FROM profile JOIN stations USING (station_id) WHERE district = 'ASIA' GROUP BY 1, 2""")
stmt("heatmap", "rollup", """
    SELECT CAST(d AS INTEGER) AS isodow, CAST(s AS INTEGER) AS slot, coalesce(empty_rate, 0e0) AS empty_rate,
           round(least(1, coalesce(empty_rate, 0e0) / (SELECT greatest(0.001e0, max(empty_rate)) FROM rollup)) + 1e-9, 6) AS shade
    FROM range(1, 8) a(d) CROSS JOIN range(48) b(s) LEFT JOIN rollup ON isodow = d AND slot = s""")
stmt("pulse", "pulse_all", "SELECT * FROM pulse_all")
stmt("pulse_newest_day", "pulse_day", "SELECT * FROM pulse_day")
stmt("pulse_baseline", "base_day", "SELECT * FROM base_day")
stmt("pulse_vs_baseline", "pulse_day base_day", """
    SELECT *, round(n_empty / scale_max + 1e-9, 6) AS n_empty_scaled, round(n_full / scale_max + 1e-9, 6) AS n_full_scaled,
           round(base_empty / scale_max + 1e-9, 6) AS base_empty_scaled, round(base_full / scale_max + 1e-9, 6) AS base_full_scaled
    FROM (SELECT *, max(greatest(10e0, n_empty, n_full, base_empty, base_full)) OVER () AS scale_max
          FROM (SELECT slot, CAST(n_empty AS DOUBLE) AS n_empty, CAST(n_full AS DOUBLE) AS n_full FROM pulse_day)
          FULL JOIN (SELECT slot, n_empty AS base_empty, n_full AS base_full FROM base_day) USING (slot))""")
stmt("districts", "district_now", "SELECT * FROM district_now")
stmt("district_capacity", "live_stations", """
    SELECT district, count(*) AS n_stations, CAST(sum(capacity_docks) AS BIGINT) AS capacity FROM live_stations GROUP BY 1""")
stmt("district_list", "stations", "SELECT DISTINCT district FROM stations WHERE district IS NOT NULL")
stmt("problem_bar", "district_now", """
    SELECT district, n_empty + n_full AS n_problem,
           round((n_empty + n_full) / greatest(1, max(n_empty + n_full) OVER ()) + 1e-9, 6) AS bar FROM district_now""")
stmt("overview", "newest live_stations", """
    SELECT max(ts) AS as_of, count(*) AS n_stations, CAST(sum(bikes) AS BIGINT) AS bikes,
           CAST(sum(docks_total) AS BIGINT) AS docks_total,
           round(sum(bikes) / nullif(sum(docks_total), 0) + 1e-9, 4) AS occ_rate,
           count(*) FILTER (bikes = 0 AND docks_avail > 0) AS n_empty,
           count(*) FILTER (docks_avail = 0 AND bikes > 0) AS n_full,
           count(*) FILTER (bikes = 0 AND docks_avail = 0) AS n_offline,
           count(*) FILTER (bikes + docks_avail > 0 AND least(bikes, docks_avail) <= 2) AS n_risk
    FROM newest SEMI JOIN live_stations USING (station_id)""")
stmt("overview_history", "snaps live_stations", """
    SELECT min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_rows, count(DISTINCT station_id) AS n_stations,
           round(count(*) FILTER (bikes = 0) / count(*) + 1e-9, 4) AS empty_rate,
           round(count(*) FILTER (docks_avail = 0) / count(*) + 1e-9, 4) AS full_rate
    FROM snaps SEMI JOIN live_stations USING (station_id)""")
for _name, _by in (("worst", "empty_rate"), ("worst_full", "full_rate")):
    stmt(_name, "station_rates live_stations", f"""
    SELECT station_id, name, district, capacity_docks, n, empty_rate, full_rate
    FROM station_rates JOIN live_stations USING (station_id) ORDER BY {_by} DESC, station_id LIMIT 10""")
stmt("coverage", "snaps", """
    SELECT min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_rows, count(DISTINCT station_id) AS n_stations FROM snaps""")
stmt("freshness", "newest", "SELECT max(ts) AS last_ts, max(ts) AS fetched_at, count(*) AS n_stations FROM newest")
stmt("labels", "episode", """
    SELECT strftime(ts, '%H:%M') AS label,
           CASE WHEN duration_min <= 0 THEN CASE WHEN duration_capped THEN 'just seen' ELSE '-' END
                ELSE CASE WHEN duration_capped THEN '≥ ' ELSE '' END
                     || concat_ws(' ', CASE WHEN duration_min >= 60 THEN (duration_min // 60) || ' h' END,
                                       CASE WHEN duration_min % 60 > 0 THEN (duration_min % 60) || ' m' END) END AS text,
           count(*) AS n
    FROM episode GROUP BY 1, 2""")
_PLACED = f"SELECT * EXCLUDE (lon, lat), {r6('lon', 'lat')} FROM "
stmt("alerts", "alert_now", _PLACED + "alert_now")
stmt("alerts_as_of", "alert_then", _PLACED + "alert_then")
stmt("episodes", "episode", "SELECT * FROM episode")
stmt("alert_counts", "alert_then", "SELECT level, kind, count(*) AS n FROM alert_then GROUP BY 1, 2")
stmt("escalations", "alert_then alert_before", """
    SELECT a.station_id, a.name, a.district, a.level, b.level AS prev_level, a.kind, a.duration_min, a.bikes,
           a.docks_avail, a.docks_total, a.ts
    FROM alert_then a LEFT JOIN (SELECT * FROM alert_before WHERE level <> 'notice') b USING (station_id)
    WHERE a.level = 'critical' AND b.level IS DISTINCT FROM 'critical' OR a.level = 'warning' AND b.level IS NULL
    ORDER BY a.level, a.duration_min DESC, a.station_id""")
stmt("dispatch_rule", "alert_then", """
    SELECT station_id, name, district, bikes AS now_bikes, docks_total,
           CAST(greatest(3, ceil(docks_total * 0.35e0) - bikes) AS INTEGER) AS need_bikes, level, duration_min
    FROM alert_then WHERE level <> 'notice' AND bikes < 2 ORDER BY duration_min DESC, station_id""")
stmt("grid", "cells obs", f"""
    SELECT station_id, ts, bikes, docks_avail, docks_total, {r6('ratio')}
    FROM cells LEFT JOIN obs USING (station_id, ts)""")
stmt("lags", "behind", f"SELECT station_id, ts, {r6(*[f'ratio_lag{k}' for k in LAGS])} FROM behind")
stmt("leads", "ahead", "SELECT station_id, ts, " + ", ".join(
    f"{r6(f'y_ratio_{h}', f'bl_lastweek_{h}')}, y_bikes_{h}, y_docks_{h}" for h in HORIZONS) + " FROM ahead")
ROLLS = [f"roll_{f}_{n}" for n in (4, 12) for f in ("mean", "std")] + ["roll_mean_48", "roll_min_48", "roll_max_48"]
stmt("rolling", "rolled", f"SELECT station_id, ts, {r6(*ROLLS)}, empty_streak, full_streak FROM rolled")
stmt("norms", "usual", f"SELECT station_id, dow, slot_of_day, {r6('norm_ratio', 'norm_empty_rate', 'norm_full_rate')} FROM usual")
stmt("neighbours", "near", f"SELECT station_id, neighbour_id, {r6('km')} FROM near")
stmt("neighbour_mean", "near_mean", f"SELECT station_id, ts, {r6('neigh_ratio')}, neigh_n FROM near_mean")
stmt("group_means", "district_mean cluster_mean", """
    SELECT 'district' AS kind, district AS grp, ts, round(district_ratio + 1e-9, 6) AS mean_ratio FROM district_mean
    UNION ALL
    SELECT 'cluster', CAST(cluster_id AS VARCHAR), ts, round(cluster_ratio + 1e-9, 6) FROM cluster_mean""")
stmt("holidays", "day_gap", f"""
    SELECT day, {r6('to_weekend', 'to_workday')}, to_weekend < to_workday AS is_holiday FROM day_gap""")
stmt("shape_z", "day_shape", f"SELECT day, hour, {r6('r', 'z')} FROM day_shape")
stmt("shape_fill", "bucket_fill", f"""
    SELECT station_id, bucket, {r6('level', 'z')}
    FROM (SELECT *, (level - avg(level) OVER w) / (stddev_pop(level) OVER w + 1e-9) AS z
          FROM bucket_fill WINDOW w AS (PARTITION BY station_id))""")
_F6 = ["ratio", *[f"ratio_lag{k}" for k in LAGS], "d1", "d2", "d4", *ROLLS, "lat", "lon", "norm_ratio", "norm_dev",
       "norm_empty_rate", "norm_full_rate", "district_ratio", "cluster_ratio", "neigh_ratio", "neigh_dev",
       *[f"{p}_{h}" for h in HORIZONS for p in ("y_ratio", "bl_lastweek")]]
_FINT = ["bikes", "docks_total", "slot_of_day", "dow", "is_weekend", "is_holiday", "minutes_since_midnight",
         "capacity", "cluster_id", "district_id", "empty_streak", "full_streak",
         *[f"{p}_{h}" for h in HORIZONS for p in ("y_bikes", "y_docks")]]
stmt("features", "ahead behind rolled usual model_stations district_mean cluster_mean near_mean day_gap", f"""
    SELECT station_id, ts, {', '.join(_FINT)}, {r6(*_F6)}
    FROM (
      SELECT a.*, b.* EXCLUDE (station_id, ts), r.* EXCLUDE (station_id, ts), lat, lon, s.cluster_id, district_id,
             capacity_docks AS capacity, norm_ratio, norm_empty_rate, norm_full_rate, district_ratio, cluster_ratio,
             neigh_ratio, a.ratio - norm_ratio AS norm_dev, neigh_ratio - district_ratio AS neigh_dev,
             a.ratio - ratio_lag1 AS d1, a.ratio - ratio_lag2 AS d2, a.ratio - ratio_lag4 AS d4,
             CAST(date_part('epoch', a.ts) // 60 % 1440 AS INTEGER) AS minutes_since_midnight,
             CAST(date_part('epoch', a.ts) // 1800 % 48 AS INTEGER) AS slot_of_day,
             CAST(dayofweek(a.ts) AS INTEGER) AS dow, CAST(isodow(a.ts) > 5 AS INTEGER) AS is_weekend,
             CAST(h.day IS NOT NULL AS INTEGER) AS is_holiday
      FROM ahead a
      JOIN behind b ON b.station_id = a.station_id AND b.ts = a.ts
      JOIN rolled r ON r.station_id = a.station_id AND r.ts = a.ts
      JOIN model_stations s ON s.station_id = a.station_id
      LEFT JOIN usual u ON u.station_id = a.station_id AND u.dow = dayofweek(a.ts)
        AND u.slot_of_day = date_part('epoch', a.ts) // 1800 % 48
      LEFT JOIN district_mean d ON d.district = s.district AND d.ts = a.ts
      LEFT JOIN cluster_mean c ON c.cluster_id = s.cluster_id AND c.ts = a.ts
      LEFT JOIN near_mean n ON n.station_id = a.station_id AND n.ts = a.ts
      LEFT JOIN (SELECT day FROM day_gap WHERE to_weekend < to_workday) h ON h.day = CAST(a.ts AS DATE))""")
stmt("split_counts", "ahead day_edges", f"""
    SELECT CASE WHEN ts < valid_from THEN 'train' WHEN ts < test_from THEN 'valid' ELSE 'test' END AS split,
           count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts
    FROM ahead, day_edges WHERE {_WHOLE} GROUP BY 1""")
stmt("bridge", "bridging", f"SELECT * EXCLUDE (ratio), {r6('ratio')} FROM bridging")
stmt("bridged_grid", "bridged", f"SELECT * EXCLUDE (ratio), {r6('ratio')} FROM bridged")
stmt("bridge_ratio", "bridged", """
    SELECT count(*) AS grid_cells, round(count(*) FILTER (is_live) / count(*) + 1e-9, 4) AS live_slot_ratio,
           round(count(*) FILTER (NOT is_live AND ratio IS NOT NULL) / count(*) + 1e-9, 4) AS bridged_slot_ratio FROM bridged""")
_ERR = """count(*) AS n, round(avg(abs(pred - y_ratio)) + 1e-9, 6) AS mae_ratio,
           round(sqrt(avg((pred - y_ratio) ** 2)) + 1e-9, 6) AS rmse_ratio,
           round(avg(abs(pred - y_ratio) * docks_total) + 1e-9, 6) AS mae_bikes"""
stmt("baseline_metrics", "baseline", f"SELECT horizon, model, {_ERR} FROM baseline GROUP BY 1, 2")
PARTS["rule_counts"] = (("baseline",), """
    SELECT horizon, model, kind, count(*) FILTER (fact AND hit) AS tp, count(*) FILTER (NOT fact AND hit) AS fp,
           count(*) FILTER (fact AND NOT hit) AS fn
    FROM (SELECT horizon, model, kind, CASE kind WHEN 'empty' THEN y_bikes <= 1 ELSE y_docks <= 1 END AS fact,
                 CASE kind WHEN 'empty' THEN pred * docks_total <= 1 ELSE (1e0 - pred) * docks_total <= 1 END AS hit
          FROM baseline CROSS JOIN (VALUES ('empty'), ('full')) k(kind)) GROUP BY 1, 2, 3""")
PARTS["rule_scores"] = (("rule_counts",), _prf("rule_counts"))
stmt("rule_prf", "rule_scores", f"SELECT * EXCLUDE (precision, recall, f1), {r6('precision', 'recall', 'f1')} FROM rule_scores")
stmt("level_metrics", "scored", """
    SELECT horizon, round(100 * (1 - avg(abs(pred_ratio - y_ratio) * docks_total)
                                     / avg(abs(ratio - y_ratio) * docks_total)), 6) AS improve_pct
    FROM scored GROUP BY 1""")
stmt("threshold_prf", "firing_prf", f"""
    SELECT * EXCLUDE (precision, recall, f1, threshold), {r6('precision', 'recall', 'f1', 'threshold')} FROM firing_prf""")
stmt("best_threshold", "firing_prf", f"""
    SELECT * EXCLUDE (precision, recall, f1, threshold), {r6('precision', 'recall', 'f1', 'threshold')} FROM firing_prf
    QUALIFY row_number() OVER (PARTITION BY horizon, kind ORDER BY f1 DESC, threshold) = 1""")
stmt("average_precision", "judged", """
    SELECT horizon, kind, n_pos, n_neg, round(ap / nullif(n_pos, 0) + 1e-9, 6) AS average_precision,
           round(pairs / nullif(n_pos * n_neg, 0) + 1e-9, 6) AS roc_auc
    FROM (SELECT a.horizon, a.kind, any_value(n_pos) AS n_pos, any_value(n_neg) AS n_neg,
                 sum(CASE WHEN fact THEN hits / shown END) AS ap,
                 sum(CASE WHEN NOT fact THEN hits - same / 2e0 END) AS pairs
          FROM judged a
          JOIN (SELECT x.horizon, x.kind, x.proba, count(*) FILTER (y.fact) AS hits, count(*) AS shown,
                       count(*) FILTER (y.fact AND y.proba = x.proba) AS same
                FROM (SELECT DISTINCT horizon, kind, proba FROM judged) x
                JOIN judged y ON y.horizon = x.horizon AND y.kind = x.kind AND y.proba >= x.proba
                GROUP BY 1, 2, 3) c ON c.horizon = a.horizon AND c.kind = a.kind AND c.proba = a.proba
          JOIN (SELECT horizon, kind, count(*) FILTER (fact) AS n_pos, count(*) FILTER (NOT fact) AS n_neg
                FROM judged GROUP BY 1, 2) t ON t.horizon = a.horizon AND t.kind = a.kind
          GROUP BY 1, 2)""")
stmt("interval_report", "scored", """
    SELECT horizon, round(avg(CASE WHEN y_ratio BETWEEN least(lo, hi) AND greatest(lo, hi) THEN 1e0 ELSE 0e0 END) + 1e-9, 6)
             AS coverage,
           round(avg(abs(hi - lo) * docks_total) + 1e-9, 6) AS mean_width_bikes,
           round(avg(CASE WHEN lo > hi THEN 1e0 ELSE 0e0 END) + 1e-9, 6) AS crossed_rate, 0.8e0 AS target_coverage
    FROM (SELECT *, pred_ratio - 0.1e0 AS lo, pred_ratio + horizon / 6e2 - 0.15e0 AS hi FROM scored) GROUP BY 1""")
stmt("events", "obs_starts", "SELECT * FROM obs_starts")
stmt("event_leads", "obs_leads", "SELECT * FROM obs_leads")
stmt("event_report", "target_leads judged", """
    SELECT l.*, a.* EXCLUDE (kind) FROM (
      SELECT kind, count(*) AS n_events, count(*) FILTER (lead > 0) AS detected,
             round(count(*) FILTER (lead > 0) / count(*) + 1e-9, 6) AS coverage,
             round(coalesce(avg(lead) FILTER (lead > 0), 0) + 1e-9, 6) AS mean_lead_minutes,
             round(coalesce(median(lead) FILTER (lead > 0), 0) + 1e-9, 6) AS median_lead_minutes,
             round(avg(lead) + 1e-9, 6) AS mean_lead_minutes_all_events,
             count(*) FILTER (lead = 30) AS lead_30, count(*) FILTER (lead = 60) AS lead_60,
             count(*) FILTER (lead = 120) AS lead_120, count(*) FILTER (lead = 180) AS lead_180,
             count(*) FILTER (lead = 0) AS missed
      FROM target_leads GROUP BY 1) l
    JOIN (SELECT kind, count(*) FILTER (fired) AS alerts_fired, count(*) FILTER (fired AND NOT fact) AS false_alarms,
                 round(CASE WHEN bool_or(fired) THEN count(*) FILTER (fired AND NOT fact) / count(*) FILTER (fired)
                            ELSE 0e0 END, 6) AS false_alarm_rate,
                 round(count(*) FILTER (fired) / greatest((SELECT date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) + 1 FROM judged)
                                                             * (SELECT count(DISTINCT station_id) FROM judged), 1) + 1e-9, 6)
                   AS alerts_per_station_per_day
          FROM (SELECT *, proba >= 0.3 AS fired FROM judged) GROUP BY 1) a ON a.kind = l.kind""")
stmt("policy_rank", "picked", f"SELECT station_id, ts, queue, {r6('score')}, rank FROM picked WHERE rank <= 40")
stmt("policy_coverage", "saved empties crew", """
    SELECT capacity, empty_slots, prevent_slots, rule_slots, hybrid_slots,
           round(100e0 * prevent_slots / empty_slots + 1e-9, 2) AS prevent_pct,
           round(100e0 * rule_slots / empty_slots + 1e-9, 2) AS rule_pct,
           round(100e0 * hybrid_slots / empty_slots + 1e-9, 2) AS hybrid_pct, capacity * 48 AS dispatches_per_day,
           round(prevent_slots * 0.5e0 + 1e-9, 1) AS prevent_station_hours, round(hybrid_slots * 0.5e0 + 1e-9, 1) AS hybrid_station_hours,
           round(100e0 * (hybrid_slots - rule_slots) / empty_slots + 1e-9, 2) AS uplift_vs_rule
    FROM (SELECT c.capacity, (SELECT count(*) FROM empties) AS empty_slots, count(*) FILTER (p) AS prevent_slots,
                 count(*) FILTER (r) AS rule_slots, count(*) FILTER (h) AS hybrid_slots
          FROM crew c LEFT JOIN saved s ON s.capacity = c.capacity GROUP BY 1)""")
stmt("events_preventable", "obs_starts picked crew", """
    SELECT capacity, n_events, prevented, prevented_hybrid, round(100e0 * prevented / greatest(n_events, 1) + 1e-9, 2) AS prevented_pct,
           round(100e0 * prevented_hybrid / greatest(n_events, 1) + 1e-9, 2) AS prevented_hybrid_pct
    FROM (SELECT capacity, count(*) AS n_events, count(*) FILTER (rank <= capacity) AS prevented,
                 count(*) FILTER (rank <= greatest(capacity // 2, 1)) AS prevented_hybrid
          FROM (SELECT * FROM obs_starts WHERE kind = 'empty') e
          LEFT JOIN picked k ON k.station_id = e.station_id AND k.queue = 'prevent' AND k.ts = e.ts - INTERVAL 1 HOUR
          CROSS JOIN crew GROUP BY 1)""")
stmt("concentration", "duty", """
    SELECT any_value(k) AS top_stations, round(sum(n_empty) FILTER (i <= k) / nullif(sum(n_empty), 0) + 1e-9, 4) AS top_share,
           count(*) FILTER (n_empty / n > 0.5) AS mostly_empty_stations, CAST(sum(n_empty) AS BIGINT) AS empty_slots
    FROM (SELECT *, row_number() OVER (ORDER BY n_empty DESC, station_id) AS i,
                 CAST(greatest(floor(count(*) OVER () * 0.05e0), 1) AS BIGINT) AS k
          FROM (SELECT station_id, count(*) FILTER (bikes <= 1) AS n_empty, count(*) AS n FROM duty GROUP BY 1))""")
stmt("forecast_top", "forecast", f"""
    SELECT station_id, name, district, base_ts, horizon, now_bikes, pred_bikes, pred_docks, proba_empty, proba_full,
           watch_empty, watch_full, {r6('risk')}
    FROM (SELECT *, greatest(proba_empty, proba_full) AS risk FROM forecast) WHERE horizon = 60
    ORDER BY risk DESC, station_id LIMIT 300""")
for _name, _h, _flag in (("forecast_alerts", 60, "watch"), ("forecast_alerts_strict", 30, "alert")):
    stmt(_name, "forecast", f"""
    SELECT station_id, name, district, base_ts, horizon, now_bikes, now_docks_avail, docks_total, pred_bikes, pred_docks,
           proba_empty, proba_full, CASE WHEN proba_full > proba_empty THEN 'full' ELSE 'empty' END AS kind,
           greatest(proba_empty, proba_full) AS proba
    FROM forecast WHERE horizon = {_h} AND ({_flag}_empty OR {_flag}_full) ORDER BY proba DESC, station_id LIMIT 200""")
stmt("forecast_totals", "forecast", """
    SELECT horizon, count(*) AS n_rows, count(*) FILTER (alert_empty) AS n_alert_empty,
           count(*) FILTER (alert_full) AS n_alert_full, count(*) FILTER (watch_empty) AS n_watch_empty,
           count(*) FILTER (watch_full) AS n_watch_full FROM forecast GROUP BY 1""")
stmt("forecast_station", "forecast", f"""
    SELECT horizon, base_ts, now_bikes, pred_bikes, pred_docks, {r6('pred_ratio')} FROM forecast WHERE station_id = 3""")
stmt("forecast_curve", "forecast", """
    SELECT station_id, base_ts AS ts, now_bikes AS bikes, now_bikes AS band_lo, 0 AS band_width
    FROM forecast WHERE horizon = 30
    UNION ALL
    SELECT station_id, base_ts + to_minutes(horizon), pred_bikes, pred_bikes_lo, greatest(pred_bikes_hi - pred_bikes_lo, 0)
    FROM forecast""")
stmt("dispatch", "task_out", "SELECT * FROM task_out")
stmt("dispatch_totals", "task_out", """
    SELECT count(*) AS n_tasks, count(from_station) AS n_paired, CAST(coalesce(sum(move_bikes), 0) AS BIGINT) AS total_move_bikes,
           CAST(coalesce(sum(move_bikes) FILTER (from_station IS NOT NULL), 0) AS BIGINT) AS paired_move_bikes FROM task_out""")
_RENUMBERED = "CASE WHEN station_id = 5 THEN 900000 ELSE station_id END AS station_id"
stmt("stream_recent", "snaps", f"SELECT {_RENUMBERED}, ts, bikes, docks_avail, docks_total FROM snaps")
stmt("stream_recent_kept", "snaps", f"""
    SELECT {_RENUMBERED}, ts, bikes, docks_avail, docks_total FROM snaps
    WHERE CAST(ts AS DATE) >= (SELECT max(CAST(ts AS DATE)) FROM snaps) - 14""")
PARTS["last_reading"] = (("readings",), """
    SELECT * FROM readings r WHERE raw_ts = (SELECT max(x.raw_ts) FROM readings x WHERE x.station_id = r.station_id)""")
stmt("stream_latest", "last_reading places", f"""
    SELECT * EXCLUDE (station_id), {_RENUMBERED}
    FROM (SELECT r.station_id, time_bucket(INTERVAL '30 minutes', raw_ts) AS ts, bikes, docks_avail, docks_total,
                 name, district, {r6('lon', 'lat')}, raw_ts AS fetched_at
          FROM last_reading r JOIN places p ON p.station_id = r.station_id)""")
stmt("stream_episodes", "episode", "SELECT * FROM episode")


def _long(src: str, section: str, keys: str) -> str:
    """Metric columns of a part as rows."""
    cols = {k: k if k in keys.split() else "NULL" for k in ("model", "kind", "horizon")}
    return f"""SELECT '{section}' AS section, CAST({cols['model']} AS VARCHAR) AS model,
           CAST({cols['kind']} AS VARCHAR) AS kind, CAST({cols['horizon']} AS INTEGER) AS horizon, metric, value
    FROM (UNPIVOT (SELECT {keys.replace(' ', ', ')}, CAST(COLUMNS(* EXCLUDE ({keys.replace(' ', ', ')})) AS DOUBLE)
                   FROM {src}) ON * EXCLUDE ({keys.replace(' ', ', ')}) INTO NAME metric VALUE value)"""


PARTS["errors"] = (("scored",), """
    SELECT horizon, model, count(pred) AS n, avg(abs(pred - y_ratio)) AS mae_ratio,
           sqrt(avg((pred - y_ratio) ** 2)) AS rmse_ratio, avg(abs(pred - y_ratio) * docks_total) AS mae_bikes
    FROM (SELECT horizon, y_ratio, docks_total, UNNEST(['model', 'persistence', 'lastweek']) AS model,
                 UNNEST([pred_ratio, ratio, lastweek]) AS pred FROM scored)
    WHERE pred IS NOT NULL GROUP BY 1, 2""")
PARTS["gains"] = (("errors",), """
    SELECT a.horizon, 'model' AS model, 100e0 - 100e0 * a.mae_bikes / p.mae_bikes AS improve_vs_persistence_pct,
           100e0 - 100e0 * a.mae_bikes / w.mae_bikes AS improve_vs_lastweek_pct
    FROM errors a JOIN errors p ON p.horizon = a.horizon AND p.model = 'persistence'
    LEFT JOIN errors w ON w.horizon = a.horizon AND w.model = 'lastweek' WHERE a.model = 'model'""")
PARTS["ranks"] = (("judged",), STATEMENTS["average_precision"][
    STATEMENTS["average_precision"].rindex("SELECT horizon, kind, n_pos"):].replace(
    "round(ap / nullif(n_pos, 0) + 1e-9, 6)", "ap / nullif(n_pos, 0)").replace(
    "round(pairs / nullif(n_pos * n_neg, 0) + 1e-9, 6)", "pairs / nullif(n_pos * n_neg, 0)"))
PARTS["rates"] = (("judged",), "SELECT horizon, kind, avg(CASE WHEN fact THEN 1e0 ELSE 0e0 END) AS pos_rate FROM judged GROUP BY 1, 2")
for _tag, _t in (("strict", "0.7"), ("operational", "0.3")):
    PARTS[f"hits_{_tag}"] = (("judged",), f"""
    SELECT horizon, kind, count(*) FILTER (fact AND proba >= {_t}) AS tp, count(*) FILTER (NOT fact AND proba >= {_t}) AS fp,
           count(*) FILTER (fact AND proba < {_t}) AS fn FROM judged GROUP BY 1, 2""")
    PARTS[f"prf_{_tag}"] = ((f"hits_{_tag}",), _prf(f"hits_{_tag}"))
    PARTS[f"lead_{_tag}"] = (("target_starts", "judged"), _leads("target_starts", "judged").replace("0.3", _t))
    _body = STATEMENTS["event_report"]
    _body = _body[_body.index("SELECT l.*, a.*"):].replace("target_leads", f"lead_{_tag}").replace("proba >= 0.3", f"proba >= {_t}")
    PARTS[f"warned_{_tag}"] = ((f"lead_{_tag}", "judged"), _body)
PARTS["ruled"] = (("scored",), """
    SELECT horizon, kind, count(*) FILTER (fact AND hit) AS tp, count(*) FILTER (NOT fact AND hit) AS fp,
           count(*) FILTER (fact AND NOT hit) AS fn
    FROM (SELECT horizon, kind, CASE kind WHEN 'empty' THEN y_bikes <= 1 ELSE y_docks <= 1 END AS fact,
                 CASE kind WHEN 'empty' THEN ratio * docks_total <= 1 ELSE (1e0 - ratio) * docks_total <= 1 END AS hit
          FROM scored CROSS JOIN (VALUES ('empty'), ('full')) k(kind)) GROUP BY 1, 2""")
PARTS["prf_rule"] = (("ruled",), _prf("ruled"))
_SECTIONS = [("errors", "level", "horizon model"), ("gains", "level", "horizon model"), ("ranks", "ranking", "horizon kind"),
             ("rates", "ranking", "horizon kind"), ("prf_strict", "strict", "horizon kind"),
             ("prf_operational", "operational", "horizon kind"), ("prf_rule", "rule", "horizon kind"),
             ("warned_strict", "events_strict", "kind"), ("warned_operational", "events_operational", "kind")]
stmt("backtest_report", " ".join(x[0] for x in _SECTIONS), f"""
    SELECT section, model, kind, horizon, metric, {r6('value')}
    FROM ({' UNION ALL '.join(_long(*x) for x in _SECTIONS)}) WHERE value IS NOT NULL""")


stmt("alerts_served", "alert_then", _PLACED + "alert_then")
PARTS["rule_tasks"] = (("alert_then",), """
    SELECT station_id AS to_station, name AS to_name, district, CAST(bikes AS INTEGER) AS now_bikes,
           CAST(docks_total AS INTEGER) AS to_capacity,
           CAST(greatest(3, ceil(docks_total * 0.35e0) - bikes) AS INTEGER) AS need_bikes
    FROM alert_then WHERE level <> 'notice' AND bikes < 2""")
stmt("dispatch_served", "task_out rule_tasks", """
    SELECT *, 'forecast' AS source FROM task_out
    UNION ALL BY NAME
    SELECT *, need_bikes AS move_bikes, 'rule' AS source FROM rule_tasks""")
PARTS["residual"] = (("scored", "day_edges"), """
    SELECT horizon, CASE WHEN ratio < 1e0 / 3 THEN 0 WHEN ratio < 2e0 / 3 THEN 1 ELSE 2 END AS grp,
           CAST(floor((y_ratio - pred_ratio) * 1e4 + 0.5e0) AS DOUBLE) AS step
    FROM scored, day_edges WHERE ts >= valid_from AND ts < test_from""")
stmt("band_table", "residual", f"""
    SELECT horizon, grp, n, {r6('lo_shift', 'hi_shift')}
    FROM (SELECT w.horizon, CAST(g.grp AS INTEGER) AS grp, coalesce(n, 0) AS n,
                 CASE WHEN n >= 50 THEN p.lo ELSE w.lo END / 1e4 AS lo_shift,
                 CASE WHEN n >= 50 THEN p.hi ELSE w.hi END / 1e4 AS hi_shift
          FROM (SELECT horizon, quantile_cont(step, 0.1) AS lo, quantile_cont(step, 0.9) AS hi FROM residual GROUP BY 1) w
          CROSS JOIN (SELECT unnest([0, 1, 2]) AS grp) g
          LEFT JOIN (SELECT horizon, grp, count(*) AS n, quantile_cont(step, 0.1) AS lo, quantile_cont(step, 0.9) AS hi
                     FROM residual GROUP BY 1, 2) p ON p.horizon = w.horizon AND p.grp = g.grp)""")


def _pick(name: str, digits: int, section: str, metric: str, **where: str | int) -> str:
    cond = " AND ".join([f"section = '{section}'", f"metric = '{metric}'",
                         *[f"{k} = {v!r}" for k, v in where.items()]])
    return f"round(max(value) FILTER ({cond}), {digits}) AS {name}"


_HEADLINE = ", ".join([
    _pick("mae_bikes_60min", 3, "level", "mae_bikes", model="model", horizon=60),
    _pick("mae_bikes_60min_persistence", 3, "level", "mae_bikes", model="persistence", horizon=60),
    _pick("improve_vs_persistence_pct_60min", 1, "level", "improve_vs_persistence_pct", horizon=60),
    _pick("empty_event_coverage", 4, "events_operational", "coverage", kind="empty"),
    _pick("empty_event_mean_lead_minutes", 1, "events_operational", "mean_lead_minutes", kind="empty"),
    _pick("empty_event_false_alarm_rate", 4, "events_operational", "false_alarm_rate", kind="empty"),
    _pick("empty_f1_60min", 3, "operational", "f1", kind="empty", horizon=60),
    _pick("full_event_coverage", 4, "events_operational", "coverage", kind="full"),
    _pick("full_event_mean_lead_minutes", 1, "events_operational", "mean_lead_minutes", kind="full"),
    "CAST(" + _pick("n", 0, "events_operational", "n_events", kind="empty").removesuffix(" AS n") + " AS BIGINT) AS n_empty_events",
    "CAST(" + _pick("n", 0, "events_operational", "n_events", kind="full").removesuffix(" AS n") + " AS BIGINT) AS n_full_events",
    _pick("strict_empty_event_coverage", 4, "events_strict", "coverage", kind="empty"),
    _pick("strict_empty_event_false_alarm_rate", 4, "events_strict", "false_alarm_rate", kind="empty")])
stmt("forecast_meta", "forecast " + " ".join(x[0] for x in _SECTIONS), f"""
    SELECT f.*, h.*
    FROM (SELECT max(base_ts) AS base_ts, count(*) AS n_rows, count(DISTINCT station_id) AS n_stations,
                 0.7e0 AS alert_threshold, {', '.join(f"count(*) FILTER (horizon = 60 AND {x}) AS n_{x}" for x in
                 ('alert_empty', 'alert_full', 'watch_empty', 'watch_full'))},
                 max(base_ts + horizon * INTERVAL 1 MINUTE) AS last_target FROM forecast) f,
         (SELECT {_HEADLINE} FROM ({' UNION ALL '.join(_long(*x) for x in _SECTIONS)})) h""")


stmt("nested_master", "places", f"""
    SELECT CAST(station_id AS VARCHAR) AS sno, coalesce(regexp_extract(district, '[^ ]+'), 'ROAD') AS district,
           name, {r6('lon', 'lat')} FROM places""")
stmt("historical_slots", "snaps", """
    SELECT CAST(station_id AS VARCHAR) AS sno, ts AS slot, bikes, docks_avail FROM snaps""")
stmt("name_lookup", "stations", "SELECT name, station_id FROM stations")
stmt("rejected_records", "readings places", """
    SELECT CAST(raw_ts AS DATE) AS day, count(*) FILTER (station_id <> 3 AND bikes <> 7) AS n_ok,
           count(*) FILTER (station_id = 3 OR bikes = 7) AS n_bad,
           count(*) FILTER (station_id <> 3 AND bikes <> 7 AND name = 'FRANCE') AS n_relabelled
    FROM readings JOIN places USING (station_id) GROUP BY 1""")
stmt("json_rows", "", """
    SELECT event_id, '{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"}'
           AS body FROM events""")
_SENT = "station_id, name, district, level, kind, duration_min, bikes, docks_avail, docks_total, ts"
stmt("notifications", "alert_then alert_before", f"""
    SELECT {_SENT}, NULL::VARCHAR AS prev_level, TIMESTAMP '2024-01-20 11:30:00' AS received_at
    FROM alert_before WHERE level <> 'notice'
    UNION ALL BY NAME
    SELECT {', '.join(f'a.{c.strip()}' for c in _SENT.split(','))}, b.level AS prev_level,
           TIMESTAMP '2024-01-20 12:00:00' AS received_at
    FROM alert_then a LEFT JOIN alert_before b ON b.station_id = a.station_id AND b.level <> 'notice'
    WHERE a.level = 'critical' AND b.level IS DISTINCT FROM 'critical' OR a.level = 'warning' AND b.level IS NULL""")
