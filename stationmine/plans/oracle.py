"""Query key → SQL for DuckDB with the same result.

Each entry is a final SELECT and the named parts it builds on; parts are collected in
dependency order into one WITH clause.  The SQL takes the plain way (row-level windows,
full joins, item self joins), not the way of the operators it checks.
"""

from __future__ import annotations

import re

from stationmine.operators.grid import tags
from stationmine.params import EXTRACTION_TYPES, MineParams
from stationmine.plans.queries import (
    CITY,
    CONF,
    CONFS,
    KS,
    LAGS,
    MINUTES,
    MODELS,
    PIVOT_CENTER,
    PIVOT_STATIONS,
    SPLIT,
    SUPPORT,
    SWEEP,
    SWEEP_CONFS,
    SWEEP_SUPPORT,
    SWEEP_TARGET,
    TARGET,
    TREE_DEPTH,
    TEST,
    TRAIN,
    WIDTH,
    P,
    sequence_params,
)

STEP = P.interval * 60
BASE = f"(epoch_us(TIMESTAMP '{P.base_time}') // 1000000 // {STEP})"

_parts: dict[str, str] = {}
_final: dict[str, str] = {}


def part(name: str, sql: str) -> str:
    _parts.setdefault(name, sql)
    return name


def final(key: str, sql: str) -> None:
    _final[key] = sql


def _with_parts(sql: str) -> str:
    order: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\b[a-z_0-9]+\b", text):
            if name in _parts and name not in order and name not in visiting:
                visiting.add(name)
                visit(_parts[name])
                order.append(name)

    visiting: set[str] = set()
    visit(sql)
    if not order:
        return sql
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({_parts[n]})" for n in order) + "\n" + sql


def sec(col: str) -> str:
    return f"(epoch_us({col}) // 1000000)"


def bin_of(col: str, minutes: int) -> str:
    return f"({sec(col)} // {minutes * 60} * {minutes * 60})"


def as_time(col: str) -> str:
    return f"make_timestamp(CAST({col} * 1000000 AS BIGINT))"


def haversine(a: str, b: str) -> str:
    h = (
        f"(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat))"
        f" * pow(sin(radians({b}.long - {a}.long) / 2), 2))"
    )
    return f"(2 * 6373.0 * atan2(sqrt({h}), sqrt(1 - {h})))"


def delta_sql(dist: str, th: float) -> str:
    return f"CAST(greatest(1, ceil(round({dist} / {th}, 9))) AS BIGINT)"


def big(*names: str) -> str:
    return ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names)


# --- adapter -----------------------------------------------------------------------------

part(
    "fx_station",
    """
    SELECT s_suppkey AS id, s_name AS name,
           37.0::DOUBLE + CAST(r * 5 AS DOUBLE) / 1000 AS lat,
           -122.4::DOUBLE + CAST((s_suppkey - r * r - r) * 5 AS DOUBLE) / 1000 AS long,
           9 + s_suppkey % 4 * 2 AS dock_count,
           CASE WHEN s_suppkey < 5 THEN 'San Francisco' WHEN s_suppkey < 10 THEN 'San Jose'
                ELSE 'City ' || (s_suppkey // 5) END AS city,
           DATE '2013-08-01' + CAST(s_suppkey % 100 AS INTEGER) AS installation_date
    FROM (SELECT *, CAST(floor(sqrt(CAST(s_suppkey AS DOUBLE))) AS BIGINT) AS r FROM supplier)
    """,
)
part(
    "fx_status",
    """
    SELECT station_id,
           CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN 0
                ELSE v % (dock_count + 1) END AS bikes_available,
           CASE WHEN event_id % 89 = 0 THEN 0
                ELSE dock_count - v % (dock_count + 1) + CASE WHEN event_id % 53 = 0 THEN 7 ELSE 0 END
           END AS docks_available,
           ts AS time
    FROM (SELECT user_id * 2 // 3 AS station_id, event_id, CAST(floor(value) AS BIGINT) AS v, ts FROM events)
    JOIN fx_station ON id = station_id
    """,
)
part(
    "fx_trip",
    """
    SELECT event_id AS id, duration, ts AS start_date, ts + to_seconds(duration) AS end_date,
           user_id * 2 // 3 AS start_station_id, rider * 2 // 3 AS end_station_id, user_id AS bike_id,
           CASE WHEN event_type IN ('click', 'view') THEN 'Subscriber' ELSE 'Customer' END AS subscription_type
    FROM (SELECT *, 60 + CAST(floor(value * 60) AS BIGINT) AS duration,
                 user_id - user_id % 15
                 + (user_id % 15 * 4 + (event_id * 7 % 15) * (event_id % 4) // 3) % 15
                 - CASE WHEN event_id % 40 = 0 AND user_id >= 15 THEN 15 ELSE 0 END AS rider
          FROM events)
    """,
)
part(
    "fx_edges",
    """
    SELECT start_station_id AS start_id, end_station_id AS end_id, count(*) AS weight
    FROM fx_trip GROUP BY ALL
    """,
)
part(
    "fx_valid",
    f"""
    SELECT *, {sec('time')} AS s, {sec('time')} // {STEP} - {BASE} AS slot
    FROM fx_status
    WHERE bikes_available IS NOT NULL AND (docks_available <> 0 OR bikes_available <> 0)
    """,
)

final("scan_status", "SELECT * FROM fx_status")
final("status_file", "SELECT * FROM fx_status")
final(
    "scan_station",
    """
    SELECT id, name, round(lat, 6) AS lat, round(long, 6) AS long, dock_count, city, installation_date
    FROM fx_station
    """,
)
final("scan_trip", "SELECT * FROM fx_trip")
final("trip_page", "SELECT * FROM fx_trip ORDER BY start_date, id LIMIT 5 OFFSET 55")

_columns = {"station_id": "bigint", "bikes_available": "int", "docks_available": "int", "time": "timestamp_ntz"}
final(
    "profile",
    " UNION ALL ".join(
        f"""
        SELECT '{c}' AS "column", '{kind}' AS "type", count({c}) AS n_values, count(*) - count({c}) AS n_nulls,
               CAST(min({c}) AS VARCHAR) AS least, CAST(max({c}) AS VARCHAR) AS greatest FROM fx_status
        """
        for c, kind in _columns.items()
    ),
)

# --- cleaning ----------------------------------------------------------------------------

final("valid_readings", "SELECT station_id, bikes_available, docks_available, time FROM fx_valid")
final("hour_zone", "SELECT * FROM fx_status WHERE hour(time) >= 17 AND hour(time) < 18")
part(
    "fx_day_slots",
    """
    SELECT *, '21-5' AS day_slot FROM fx_status WHERE hour(time) >= 21 OR hour(time) < 5
    UNION ALL SELECT *, '5-10' FROM fx_status WHERE hour(time) >= 5 AND hour(time) < 10
    UNION ALL SELECT *, '10-15' FROM fx_status WHERE hour(time) >= 10 AND hour(time) < 15
    UNION ALL SELECT *, '15-21' FROM fx_status WHERE hour(time) >= 15 AND hour(time) < 22
    """,
)
final("day_slot_counts", "SELECT day_slot, count(*) AS n FROM fx_day_slots GROUP BY 1")
final(
    "clean_status",
    """
    SELECT coalesce(station_id, id) AS station_id, bikes_available, docks_available, time
    FROM fx_status FULL JOIN fx_station ON station_id = id
    WHERE NOT coalesce(abs(bikes_available + docks_available - dock_count) > 5, false)
    """,
)
final(
    "city_status",
    "SELECT * FROM fx_status WHERE station_id IN (SELECT id FROM fx_station WHERE city LIKE 'City%')",
)
final(
    "time_split",
    f"SELECT *, CASE WHEN time < TIMESTAMP '{SPLIT}' THEN 'train' ELSE 'test' END AS split FROM fx_status",
)
final("day_slice", "SELECT * FROM fx_status WHERE CAST(time AS DATE) = DATE '2024-01-12'")
final(
    "critical_share",
    """
    SELECT count(*) AS n_readings, count(*) FILTER (docks_available < 3) AS n_critical,
           round(100.0::DOUBLE * count(*) FILTER (docks_available < 3) / count(*), 6) AS percent
    FROM fx_valid
    """,
)

# --- states ------------------------------------------------------------------------------


def by_reading(side: str, wrap: bool, ct: int = P.ct) -> str:
    level = "docks_available" if side == "Full" else "bikes_available"
    zero = "" if wrap else f"WHEN {level} = 0 THEN '{side}'"
    return f"CASE {zero} WHEN {level} < {ct} THEN 'Almost{side}' ELSE 'Normal' END"


final("state_full", f"SELECT station_id, time, slot, {by_reading('Full', False)} AS state FROM fx_valid")
final("state_empty", f"SELECT station_id, time, slot, {by_reading('Empty', False)} AS state FROM fx_valid")


def flags_part(p: MineParams, source: str = "fx_valid") -> str:
    """Trend and level flags with windows over single readings."""
    level = "docks_available" if p.side == "Full" else "bikes_available"
    scope = "k > 1" if p.state_change else "true"
    tag = f"{p.side.lower()}_{int(p.state_change)}{int(p.wrap_states)}_{p.ct}_{source}"
    ordered = part(
        f"fx_ordered_{source}",
        f"""
        SELECT *, row_number() OVER w AS k, min(bikes_available) OVER w AS low, max(bikes_available) OVER w AS high
        FROM {source}
        WINDOW w AS (PARTITION BY station_id, slot ORDER BY s, bikes_available, docks_available
                     ROWS UNBOUNDED PRECEDING)
        """,
    )
    counts = part(
        f"fx_counts_{tag}",
        f"""
        SELECT station_id, slot, max(bikes_available - low) > {p.thr} AS increase,
               max(high - bikes_available) > {p.thr} AS decrease,
               count(*) FILTER ({level} = 0 AND {scope}) AS n_zero,
               count(*) FILTER ({level} < {p.ct} AND {scope}) AS n_low,
               max(CASE WHEN k = 1 THEN {level} END) AS b0
        FROM {ordered} GROUP BY station_id, slot
        """,
    )
    critical = "false" if p.wrap_states else "n_zero >= 1"
    ok = "true"
    if p.state_change:
        critical, ok = f"({critical} AND b0 <> 0)", f"b0 >= {p.ct}"
    return part(
        f"fx_flags_{tag}",
        f"""
        SELECT station_id, slot, increase, decrease, {critical} AS critical, {ok} AS almost_ok,
               {ok} AND n_low - CAST({critical} AS INTEGER) >= 1 AS almost
        FROM {counts}
        """,
    )


def states_part(p: MineParams, source: str = "fx_valid") -> str:
    tag = re.sub(r"\W", "_", p.extraction_type.lower())
    tag += "_" + "".join(str(int(x)) for x in (p.wrap_states, p.state_change, p.for_test, p.negatives))
    tag += f"_{p.ct}_{source}"
    if p.by_reading:
        kept = "" if p.for_test else "WHERE state <> 'Normal'"
        return part(
            f"fx_states_{tag}",
            f"""
            SELECT DISTINCT slot, station_id, state
            FROM (SELECT slot, station_id, {by_reading(p.side, p.wrap_states, p.ct)} AS state FROM {source}) {kept}
            """,
        )
    flags = flags_part(p, source)
    pieces = [
        (f"'{p.side}'", "critical"),
        (f"'Almost{p.side}'", "almost"),
        ("'Increase'", "increase"),
        ("'Decrease'", "decrease"),
    ]
    if p.negatives:
        pieces += [("'NoIncrease'", "NOT increase"), ("'NoDecrease'", "NOT decrease")]
    if p.for_test:
        pieces.append(("'Normal'", "almost_ok AND NOT almost"))
    return part(
        f"fx_states_{tag}",
        " UNION ALL ".join(f"SELECT slot, station_id, {s} AS state FROM {flags} WHERE {c}" for s, c in pieces),
    )


final("slot_state_full", f"SELECT slot, station_id, state FROM {states_part(P)}")
final(
    "dense_slots",
    """
    SELECT day, hour, part, row_number() OVER (ORDER BY day, hour, part) AS slot
    FROM (SELECT DISTINCT CAST(time AS DATE) AS day, hour(time) AS hour, minute(time) // 30 AS part FROM fx_valid)
    """,
)
final("slot_trend", f"SELECT station_id, slot, increase, decrease FROM {flags_part(P)}")
final(
    "slot_level",
    f"SELECT station_id, slot, critical, almost FROM {flags_part(P.but(extraction_type='Empty-Increase'))}",
)
for _key, _p in {
    "slot_state_change": P.but(extraction_type="Full-Decrease", state_change=True),
    "slot_negatives": P.but(extraction_type="Empty-Increase", no_increase=True),
    "slot_states_test": P.but(extraction_type="Full-Increase", for_test=True, wrap_states=True),
}.items():
    final(_key, f"SELECT slot, station_id, state FROM {states_part(_p)}")
final(
    "minute_states",
    """
    SELECT DISTINCT station_id, year(time) AS year, month(time) AS month, day(time) AS day, hour(time) AS hour,
           minute(time) AS minute, CAST(docks_available = 0 AS BIGINT) AS status
    FROM fx_valid WHERE docks_available < 3
    """,
)

# --- windows, neighbours, sequences ------------------------------------------------------


def windows_part(states: str, base: int = 0) -> str:
    return part(
        f"fx_win_{states}",
        f"""
        SELECT win, slot, row_number() OVER (PARTITION BY win ORDER BY slot) - 1 AS t
        FROM (SELECT slot, unnest(range(greatest(slot - {P.window_size - 1}, {base}), slot + 1)) AS win
              FROM (SELECT DISTINCT slot FROM {states} WHERE slot >= {base}))
        """,
    )


_full = states_part(P)
_test = states_part(P.but(for_test=True))
final("slot_itemsets", f"SELECT slot, station_id || '_' || state AS item FROM {_full}")
final(
    "complete_slots",
    f"""
    SELECT slot, station_id, state FROM {_test}
    WHERE slot IN (SELECT slot FROM {_test} GROUP BY slot HAVING count(DISTINCT station_id) = 79)
    """,
)
final(
    "window_expand",
    f"""
    SELECT win, count(*) AS n_items, count(DISTINCT slot) AS n_slots
    FROM {_full} JOIN {windows_part(_full)} USING (slot) GROUP BY win
    """,
)
final(
    "window_t",
    f"SELECT win, t, slot, station_id, state FROM {_full} JOIN {windows_part(_full)} USING (slot)",
)

part(
    "fx_pairs",
    f"""
    SELECT a.id AS id_a, b.id AS id_b, {haversine('a', 'b')} AS dist
    FROM fx_station a JOIN fx_station b ON a.id < b.id
    """,
)
part(
    "fx_near",
    f"""
    SELECT id_a AS center, id_b AS station_id, {delta_sql('dist', P.th)} AS delta
    FROM fx_pairs WHERE dist <= {P.th * P.max_delta}
    UNION ALL
    SELECT id_b, id_a, {delta_sql('dist', P.th)} FROM fx_pairs WHERE dist <= {P.th * P.max_delta}
    """,
)


def partners_part(side: str, n: int = P.n_neighbors) -> str:
    center, other = ("end_id", "start_id") if side == "Full" else ("start_id", "end_id")
    return part(
        f"fx_partners_{side.lower()}_{n}",
        f"""
        SELECT a.id AS center, b.id AS station_id, {delta_sql(haversine('a', 'b'), P.th)} AS delta
        FROM (SELECT *, row_number() OVER (PARTITION BY {center} ORDER BY weight DESC, {other}) AS k FROM fx_edges)
        JOIN fx_station a ON a.id = {center} JOIN fx_station b ON b.id = {other}
        WHERE k <= {n} AND a.id <> b.id
        """,
    )


final("station_distance", "SELECT id_a, id_b, round(dist, 6) AS dist FROM fx_pairs WHERE dist <= 3.0")
final("neighbors_distance", "SELECT * FROM fx_near")
final("neighbors_trips", f"SELECT * FROM {partners_part('Full')}")


def keep_sql(p: MineParams) -> str:
    if p.extraction_type == "Full-Increase":
        return "state NOT IN ('Decrease', 'NoIncrease')"
    if p.extraction_type == "Empty-Decrease":
        return "state <> 'Increase'"
    if p.extraction_type == "Full-Decrease":
        return (
            "CASE WHEN delta = 0 THEN state NOT IN ('Decrease', 'NoIncrease')"
            " ELSE state IN ('Decrease', 'NoIncrease') END"
        )
    if p.extraction_type == "Empty-Increase":
        return "CASE WHEN delta = 0 THEN state <> 'Increase' ELSE state IN ('Increase', 'NoIncrease') END"
    return "true"


def labels_part(p: MineParams, source: str = "fx_valid") -> str:
    """(win, center, t, label) for centres with a state in T0."""
    states = states_part(p, source)
    win = windows_part(states)
    near = "fx_near" if p.neighborhood == "distance" else partners_part(p.side, p.n_neighbors)
    seen = part(
        f"fx_seen_{states}_{near}",
        f"""
        SELECT slot, station_id AS center, state, 0 AS delta FROM {states}
        UNION ALL SELECT slot, center, state, delta FROM {states} JOIN {near} USING (station_id)
        """,
    )
    return part(
        f"fx_labels_{states}_{near}",
        f"""
        SELECT DISTINCT win, center, t, state || '_T' || t || '_' || delta AS label
        FROM {seen} JOIN {win} USING (slot)
        WHERE {keep_sql(p)}
          AND (win, center) IN (SELECT (win, station_id) FROM {states} JOIN {win} USING (slot) WHERE t = 0)
        """,
    )


def sequences_part(p: MineParams, source: str = "fx_valid") -> str:
    labels = labels_part(p, source)
    return part(
        f"fx_seq_{labels}",
        f"""
        SELECT win, center, string_agg(items, '-' ORDER BY t) AS sequence, count(*) AS n_slots
        FROM (SELECT win, center, t, string_agg(label, ',' ORDER BY label) AS items FROM {labels} GROUP BY ALL)
        GROUP BY win, center
        """,
    )


final(
    "labels",
    f"""
    SELECT DISTINCT win, center, t, state || '_T' || t || '_' || delta AS label
    FROM (SELECT slot, station_id AS center, state, 0 AS delta FROM {_full}
          UNION ALL SELECT slot, center, state, delta FROM {_full} JOIN fx_near USING (station_id))
    JOIN {windows_part(_full)} USING (slot)
    """,
)
for _kind in EXTRACTION_TYPES:
    final(
        "sequences_" + _kind.lower().replace("-", "_"),
        f"SELECT win, center, sequence FROM {sequences_part(sequence_params(_kind))}",
    )

part(
    "fx_dense",
    """
    SELECT dense_rank() OVER (ORDER BY CAST(time AS DATE), hour(time), minute(time) // 30) AS slot, station_id,
           CASE WHEN docks_available = 0 THEN 'Full' ELSE 'AlmostFull' END AS state
    FROM fx_valid WHERE docks_available < 3
    """,
)
part("fx_states_v1", "SELECT DISTINCT slot, station_id, state FROM fx_dense")
part(
    "fx_items_v1",
    f"""
    SELECT win, t, center, state || '_T' || t || '_' || delta AS label, delta = 0 AND t = 0 AS head
    FROM (SELECT slot, station_id AS center, state, 0 AS delta FROM fx_states_v1
          UNION ALL SELECT slot, center, state, delta FROM fx_states_v1 JOIN fx_near USING (station_id))
    JOIN {windows_part('fx_states_v1', 1)} USING (slot)
    """,
)
final(
    "sequences_v1",
    """
    SELECT win, center, sequence
    FROM (SELECT win, center, string_agg(items, '-' ORDER BY t) AS sequence, sum(heads) AS copies
          FROM (SELECT win, center, t, string_agg(label, ',' ORDER BY label) AS items,
                       count(*) FILTER (head) AS heads
                FROM fx_items_v1 GROUP BY ALL)
          GROUP BY win, center), range(1, 10) r(i)
    WHERE i <= copies
    """,
)

# --- patterns and rules ------------------------------------------------------------------


def patterns_part(p: MineParams, max_items: int = 5, source: str = "fx_valid", support: float = SUPPORT) -> str:
    """All frequent patterns, grown item by item: a pattern's beginnings are frequent too.

    A label names its slot, so a pattern is a set of labels in slot order.
    """
    labels = labels_part(p, source)
    tag = f"{labels}_{max_items}_{int(support * 100)}"
    need = part(
        f"fx_need_{tag}",
        f"SELECT ceil({support} * count(*)) AS n FROM (SELECT DISTINCT win, center FROM {labels})",
    )
    items = part(
        f"fx_items_{tag}",
        f"""
        SELECT win, center, t, label FROM {labels}
        WHERE label IN (SELECT label FROM {labels} GROUP BY label HAVING count(*) >= (SELECT n FROM {need}))
        """,
    )
    grown = [
        part(f"fx_grown_{tag}_1", f"SELECT *, label AS key, 1 AS n_items, 1 AS n_slots FROM {items}"),
    ]
    for n in range(2, max_items + 1):
        longer = part(
            f"fx_longer_{tag}_{n}",
            f"""
            SELECT a.win, a.center, b.t, b.label, a.key || CASE WHEN a.t = b.t THEN ',' ELSE '-' END || b.label AS key,
                   {n} AS n_items, a.n_slots + CAST(a.t <> b.t AS INTEGER) AS n_slots
            FROM {grown[-1]} a JOIN {items} b
              ON a.win = b.win AND a.center = b.center AND (b.t > a.t OR (b.t = a.t AND b.label > a.label))
            """,
        )
        grown.append(
            part(
                f"fx_grown_{tag}_{n}",
                f"""
                SELECT * FROM {longer}
                WHERE key IN (SELECT key FROM {longer} GROUP BY key HAVING count(*) >= (SELECT n FROM {need}))
                """,
            )
        )
    pieces = " UNION ALL ".join(f"SELECT key, n_items, n_slots FROM {g}" for g in grown)
    return part(
        f"fx_patterns_{tag}",
        f"SELECT key, n_items, n_slots, count(*) AS freq FROM ({pieces}) GROUP BY ALL",
    )


def focal_part(patterns: str) -> str:
    return part(f"fx_focal_{patterns}", f"SELECT * FROM {patterns} WHERE key LIKE '%\\_T0\\_0%' ESCAPE '\\'")


def rules_part(patterns: str) -> str:
    focal = focal_part(patterns)
    return part(
        f"fx_rules_{patterns}",
        f"""
        SELECT p.key, p.antecedent_key, p.consequent_key, p.freq / q.freq AS conf, p.freq AS sup,
               p.n_items, p.n_slots
        FROM (SELECT *, regexp_replace(key, '-[^-]*$', '') AS antecedent_key,
                     regexp_extract(key, '[^-]*$') AS consequent_key
              FROM {focal} WHERE n_slots > 1) p
        JOIN {focal} q ON q.key = p.antecedent_key
        """,
    )


_all = patterns_part(P)
_rules = rules_part(_all)
_cols = "key, antecedent_key, consequent_key, round(conf, 6) AS conf, sup"

final("patterns", f"SELECT key, freq FROM {_all}")
final("patterns_focal", f"SELECT key, freq FROM {focal_part(_all)}")
final("rules", f"SELECT {_cols} FROM {_rules}")
final(
    "rules_by_conf",
    f"""
    SELECT row_number() OVER (ORDER BY conf DESC, sup DESC, key) AS rank, key, round(conf, 6) AS conf, sup
    FROM {_rules}
    """,
)
final(
    "rules_by_sup",
    f"""
    SELECT row_number() OVER (ORDER BY sup DESC, conf DESC, key) AS rank, key, round(conf, 6) AS conf, sup
    FROM {_rules}
    """,
)
final(
    "pattern_stats",
    f"""
    SELECT count(*) AS n_patterns, {', '.join(f'CAST({f}(n_{c}) AS BIGINT) AS {f}_{c}' for c in ('items', 'slots') for f in ('min', 'max'))},
           round(sum(sup * n_items) / sum(sup), 6) AS mean_items,
           round(sum(sup * n_slots) / sum(sup), 6) AS mean_slots, (SELECT count(*) FROM {focal_part(_all)}
            WHERE len(list_filter(string_split(key, '-'),
                  lambda s: len(string_split(s, ',')) <> len(list_distinct(string_split(s, ','))))) > 0) AS n_repeated
    FROM {_rules}
    """,
)
_mixed = "regexp_matches(key, '(^|[-,])Full') AND regexp_matches(key, '(^|[-,])AlmostFull')"
final("rules_mixed", f"SELECT {_cols} FROM {_rules} WHERE {_mixed}")
final(
    "rules_influence",
    f"""
    SELECT {_cols} FROM {_rules}
    WHERE split_part(key, '-', 1) LIKE '%T0\\_0%' ESCAPE '\\'
      AND len(list_filter(string_split(key, '-')[2:],
              lambda s: s LIKE '%,%' AND regexp_matches(s, '_[1-9][0-9]*(,|$)'))) > 0
    """,
)
final(
    "conf_hist_whole",
    f"""
    SELECT CAST(b AS BIGINT) AS bucket, count(conf) AS n_rules
    FROM range(10) r(b) LEFT JOIN {_rules} ON least(floor(conf * 10), 9) = b GROUP BY b
    """,
)
part("fx_rounded", f"SELECT round(conf, 2) AS v FROM {_rules}")
part(
    "fx_edges_of_bins",
    """
    SELECT min(v) - CASE WHEN min(v) = max(v) THEN 0.5 ELSE 0 END AS lo,
           max(v) + CASE WHEN min(v) = max(v) THEN 0.5 ELSE 0 END AS hi FROM fx_rounded
    """,
)
final(
    "conf_hist",
    """
    SELECT CAST(b AS BIGINT) AS bucket,
           (SELECT count(*) FROM fx_rounded WHERE least(floor((v - lo) / (hi - lo) * 10), 9) = b) AS n_rules
    FROM range(10) r(b), fx_edges_of_bins
    """,
)
_limits = ", ".join(f"({0.3 + i * 0.1:.1f}::DOUBLE)" for i in range(7))
final(
    "conf_curve",
    f"""
    SELECT threshold, count(key) AS n_rules
    FROM (VALUES {_limits}) l(threshold) LEFT JOIN {_rules} ON conf >= threshold GROUP BY threshold
    """,
)
_sweep = patterns_part(P, support=0.1)
final(
    "support_sweep",
    f"""
    SELECT support, count(key) AS n_patterns
    FROM (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.3::DOUBLE)) l(support)
    LEFT JOIN {_sweep}
      ON freq / (SELECT count(*) FROM (SELECT DISTINCT win, center FROM {labels_part(P)})) >= support
    GROUP BY support
    """,
)
final(
    "rule_lines",
    f"""
    SELECT key, sup, '[[[[''' || replace(key, '-', '''], [''') || ''']]], [''' || CAST(conf AS VARCHAR)
           || ' - ' || sup || ''']]' AS line
    FROM {_rules}
    """,
)

final("rules_text_roundtrip", f"SELECT key, round(conf, 6) AS conf, sup FROM {_rules}")
_other = rules_part(
    patterns_part(P.but(extraction_type="Empty-AlmostEmpty", n_neighbors=2, neighborhood="indegree"))
)
final(
    "mine_grid",
    f"""
    SELECT 'Full-AlmostFull' AS extraction, 'Dist' AS neighborhood, {_cols} FROM {_rules}
    UNION ALL SELECT 'Empty-AlmostEmpty', '2', {_cols} FROM {_other}
    """,
)

# --- associative classifier --------------------------------------------------------------

_train = part("fx_valid_train", f"SELECT * FROM fx_valid WHERE time < TIMESTAMP '{SPLIT}'")
_held = part("fx_valid_test", f"SELECT * FROM fx_valid WHERE time >= TIMESTAMP '{SPLIT}'")
_train_rules = rules_part(patterns_part(TRAIN, source=_train))


def aimed_part(rules: str, target: str = TARGET) -> str:
    """Rules whose consequent holds only the centre's target."""
    return part(
        f"fx_aimed_{rules}",
        f"""
        SELECT * FROM {rules}
        WHERE NOT regexp_matches(consequent_key, '_[1-9][0-9]*(,|$)')
          AND len(list_filter(string_split(consequent_key, ','), lambda i: NOT contains(i, '{target}'))) = 0
        """,
    )


def tested_part(p: MineParams, target: str = TARGET) -> str:
    """Held-out sequences of full length with their label."""
    found = sequences_part(p, _held)
    return part(
        f"fx_tested_{found}",
        f"""
        SELECT *, CASE WHEN regexp_matches(split_part(sequence, '-', 3), '{target}_T._0') THEN '{target}'
                       ELSE 'Normal' END AS y_true
        FROM {found} WHERE n_slots = 3
        """,
    )


_atom = "back || '|' || split_part(item, '_', 1) || '|' || split_part(item, '_', 3)"


def tested_atoms_part(tested: str) -> str:
    return part(
        f"fx_seq_atoms_{tested}",
        f"""
        SELECT DISTINCT win, center, {_atom} AS atom
        FROM (SELECT win, center, 3 - i AS back, unnest(string_split(split_part(sequence, '-', i), ',')) AS item
              FROM {tested}, (VALUES (1), (2)) s(i))
        """,
    )


part("fx_aimed", f"SELECT * FROM {aimed_part(_train_rules)}")
part("fx_chosen", f"SELECT * FROM fx_aimed WHERE conf >= {CONF}")
part("fx_tested", f"SELECT * FROM {tested_part(TEST)}")
part("fx_seq_atoms", f"SELECT * FROM {tested_atoms_part(tested_part(TEST))}")
part("fx_several", f"SELECT * FROM {sequences_part(TEST, _held)} WHERE n_slots > 1")
part(
    "fx_several_atoms",
    f"""
    SELECT DISTINCT win, center, {_atom} AS atom
    FROM (SELECT win, center, n_slots - i AS back, unnest(string_split(split_part(sequence, '-', i), ',')) AS item
          FROM fx_several, (VALUES (1), (2)) s(i) WHERE i < n_slots)
    """,
)


def atoms_part(rules: str) -> str:
    """Atoms of every rule and their number."""
    raw = part(
        f"fx_raw_{rules}",
        f"""
        SELECT DISTINCT key, {_atom} AS atom
        FROM (SELECT key, n - i + 1 AS back, unnest(string_split(split_part(antecedent_key, '-', i), ',')) AS item
              FROM (SELECT key, antecedent_key, len(string_split(antecedent_key, '-')) AS n FROM {rules}),
                   (VALUES (1), (2)) s(i)
              WHERE i <= n)
        """,
    )
    return part(f"fx_atoms_{rules}", f"SELECT *, count(*) OVER (PARTITION BY key) AS n_atoms FROM {raw}")


def match_part(rules: str, atoms: str = "fx_seq_atoms") -> str:
    return part(
        f"fx_match_{rules}_{atoms}",
        f"""
        SELECT win, center, key FROM {atoms} JOIN {atoms_part(rules)} USING (atom)
        GROUP BY win, center, key, n_atoms HAVING count(*) = n_atoms
        """,
    )


def cells(pred: str, true: str) -> str:
    return ", ".join(
        f"count(*) FILTER ({c}) AS {n}"
        for n, c in {
            "tp": f"{pred} AND {true}",
            "tn": f"NOT ({pred}) AND NOT ({true})",
            "fp": f"({pred}) AND NOT ({true})",
            "fn": f"NOT ({pred}) AND ({true})",
        }.items()
    )


def metrics_sql(source: str, extra: str = "") -> str:
    return f"""
    SELECT {extra} tp, tn, fp, fn, round((tp + tn) / nullif(tp + tn + fp + fn, 0), 6) AS accuracy,
           round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / nullif(p + r, 0), 6) AS f1
    FROM (SELECT *, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r FROM {source})
    """


_match = match_part("fx_chosen")
part(
    "fx_predicted",
    f"""
    SELECT win, center, CASE WHEN EXISTS (SELECT 1 FROM {_match} m WHERE m.win = s.win AND m.center = s.center)
                             THEN '{TARGET}' ELSE 'Normal' END AS y_pred, y_true
    FROM fx_tested s
    """,
)
part("fx_confusion", f"SELECT {cells(f'''y_pred = '{TARGET}' ''', f'''y_true = '{TARGET}' ''')} FROM fx_predicted")
final("rules_target", "SELECT key, round(conf, 6) AS conf, sup FROM fx_chosen")
final("seq_labels", "SELECT win, center, sequence, y_true FROM fx_tested")
final("rule_matches", f"SELECT win, center, count(*) AS votes FROM {_match} GROUP BY win, center")
final("predictions", "SELECT win, center, y_pred, y_true FROM fx_predicted")
final("confusion", "SELECT * FROM fx_confusion")
final("metrics", metrics_sql("fx_confusion"))
final(
    "match_log",
    f"""
    SELECT win, center, key,
           CASE WHEN len(string_split(antecedent_key, '-')) = 2
                THEN split_part(sequence, '-', 1) || '-' || split_part(sequence, '-', 2)
                ELSE split_part(sequence, '-', CAST(n_slots - 1 AS INTEGER)) END AS matched
    FROM (SELECT win, center, key, antecedent_key,
                 row_number() OVER (PARTITION BY win, center ORDER BY conf DESC, sup DESC, key) AS k
          FROM {match_part("fx_chosen", "fx_several_atoms")} JOIN fx_chosen USING (key))
    JOIN fx_several USING (win, center) WHERE k = 2
    """,
)
part(
    "fx_dummy",
    f"""
    SELECT {cells(f'''split_part(sequence, '-', 2) LIKE '%{TARGET}\\_T1\\_0%' ESCAPE '\\' ''', f'''y_true = '{TARGET}' ''')}
    FROM fx_tested
    """,
)
final("baseline_persistence", metrics_sql("fx_dummy"))


def grid_part(name: str, aimed: str, tested: str, atoms: str, target: str, confs: list[float]) -> str:
    """Counts per confidence and match threshold."""
    limits = f"(VALUES {', '.join(f'({c}::DOUBLE)' for c in confs)}) v(c)"
    votes = part(
        f"{name}_votes",
        f"""
        SELECT c, s.win, s.center, y_true, count(m.key) AS votes
        FROM (SELECT * FROM {tested}, {limits}) s
        LEFT JOIN (SELECT win, center, key, conf FROM {match_part(aimed, atoms)} JOIN {aimed} USING (key)) m
          ON m.win = s.win AND m.center = s.center AND m.conf >= c
        GROUP BY ALL
        """,
    )
    is_target = f"y_true = '{target}'"
    return part(
        name,
        f"""
        SELECT c AS confidence_threshold, k AS match_threshold, n_rules, {cells('votes >= k', is_target)}
        FROM {votes}
        JOIN (SELECT c, count(*) AS n_rules FROM {aimed}, {limits} WHERE conf >= c GROUP BY c) USING (c),
             (VALUES {', '.join(f'({k})' for k in KS)}) x(k)
        WHERE n_rules >= k
        GROUP BY c, k, n_rules
        """,
    )


grid_part("fx_grid", "fx_aimed", "fx_tested", "fx_seq_atoms", TARGET, CONFS)
final(
    "classifier_grid",
    metrics_sql("fx_grid", "confidence_threshold, CAST(match_threshold AS BIGINT) AS match_threshold, n_rules,"),
)

def _swept(i: int, p: MineParams) -> str:
    aimed = aimed_part(rules_part(patterns_part(p, source=_train, support=SWEEP_SUPPORT)), SWEEP_TARGET)
    tested = tested_part(p.but(for_test=True), SWEEP_TARGET)
    counts = grid_part(f"fx_sweep_{i}", aimed, tested, tested_atoms_part(tested), SWEEP_TARGET, SWEEP_CONFS)
    named = tags(p)
    return f"SELECT '{named['extraction']}' AS extraction, '{named['neighborhood']}' AS neighborhood, {p.ct} AS ct, * FROM {counts}"


part("fx_sweep", " UNION ALL ".join(_swept(i, p) for i, p in enumerate(SWEEP)))
final(
    "classifier_sweep",
    metrics_sql(
        "fx_sweep",
        "extraction, neighborhood, CAST(ct AS BIGINT) AS ct, confidence_threshold, "
        "CAST(match_threshold AS BIGINT) AS match_threshold, n_rules,",
    ),
)
final(
    "metrics_roundtrip",
    metrics_sql(
        "fx_grid",
        "'Full-AlmostFull_wrapped' AS extraction, 'Dist' AS neighborhood, confidence_threshold, "
        "CAST(match_threshold AS BIGINT) AS match_threshold,",
    ),
)

# --- series ------------------------------------------------------------------------------


def binned_part(how: str, minutes: int = MINUTES, source: str = "fx_status", by: str = "") -> str:
    """Resampled bikes and docks with every bin between the first and the last."""
    key = f"{by}, station_id" if by else "station_id"
    zero = (lambda c: c) if how == "avg" else (lambda c: f"CAST(coalesce({c}, 0) AS BIGINT)")
    tag = f"{how}_{minutes}_{source}"
    raw = part(
        f"fx_raw_{tag}",
        f"""
        SELECT {key}, {bin_of('time', minutes)} AS bin, {how}(bikes_available) AS bikes, {how}(docks_available) AS docks
        FROM {source} GROUP BY ALL
        """,
    )
    return part(
        f"fx_bins_{tag}",
        f"""
        SELECT {key}, bin, {zero('bikes')} AS bikes_available, {zero('docks')} AS docks_available
        FROM (SELECT {key}, unnest(range(min(bin), max(bin) + 1, {minutes * 60})) AS bin FROM {raw} GROUP BY {key})
        LEFT JOIN {raw} USING ({key}, bin)
        """,
    )


_mean = binned_part("avg")
_by_bin = "PARTITION BY station_id ORDER BY bin"
final(
    "resample_mean",
    f"""
    SELECT station_id, {as_time('bin')} AS time, round(bikes_available, 6) AS bikes_available,
           round(docks_available, 6) AS docks_available FROM {_mean}
    """,
)
for _key, _how in (("resample_sum", "sum"), ("resample_count", "count")):
    final(
        _key,
        f"SELECT station_id, {as_time('bin')} AS time, bikes_available, docks_available FROM {binned_part(_how)}",
    )
final(
    "skip_first",
    f"""
    SELECT station_id, {as_time('bin')} AS time, round(bikes_available, 6) AS bikes_available,
           round(docks_available, 6) AS docks_available
    FROM (SELECT *, row_number() OVER ({_by_bin}) AS k FROM {_mean} WHERE {as_time('bin')} >= TIMESTAMP '{SPLIT}')
    WHERE k > 3
    """,
)
_lag_cols = ", ".join(
    f"round(lag({c}, {i}) OVER ({_by_bin}), 6) AS {c}_T{i}"
    for c in ("bikes_available", "docks_available")
    for i in range(WIDTH)
)
final("lag_features", f"SELECT station_id, {as_time('bin')} AS time, {_lag_cols} FROM {_mean}")
_next = f"lead(CASE WHEN docks_available <= 2 THEN 'QP' ELSE 'N' END) OVER ({_by_bin})"
final("next_label", f"SELECT station_id, {as_time('bin')} AS time, {_next} AS status FROM {_mean}")
part(
    "fx_deltas",
    f"""
    SELECT * FROM (SELECT station_id, lead(bin) OVER ({_by_bin}) AS bin,
                          lead(bikes_available) OVER ({_by_bin}) - bikes_available AS delta_bikes FROM {_mean})
    WHERE bin IS NOT NULL AND delta_bikes IS NOT NULL
    """,
)
final(
    "bike_deltas",
    f"SELECT station_id, {as_time('bin')} AS time, round(delta_bikes, 6) + 0.0::DOUBLE AS delta_bikes FROM fx_deltas",
)
_sums = binned_part("sum")
part(
    "fx_sum_deltas",
    f"""
    SELECT * FROM (SELECT station_id, lead(bin) OVER ({_by_bin}) AS bin,
                          lead(bikes_available) OVER ({_by_bin}) - bikes_available AS delta_bikes FROM {_sums})
    WHERE bin IS NOT NULL
    """,
)
part(
    "fx_profile",
    f"""
    SELECT *, sum(delta_bikes) OVER (PARTITION BY station_id ORDER BY day_time) AS sum_deltas
    FROM (SELECT station_id, strftime({as_time('bin')}, '%H:%M:%S') AS day_time, avg(delta_bikes) AS delta_bikes
          FROM fx_sum_deltas GROUP BY ALL)
    """,
)
final(
    "daily_profile",
    """
    SELECT station_id, day_time, round(delta_bikes, 6) + 0.0::DOUBLE AS delta_bikes,
           round(sum_deltas, 6) + 0.0::DOUBLE AS sum_deltas
    FROM fx_profile
    """,
)
final(
    "profile_long",
    """
    SELECT station_id, day_time, 'delta_bikes' AS variable, round(delta_bikes, 6) + 0.0::DOUBLE AS value
    FROM fx_profile
    UNION ALL SELECT station_id, day_time, 'sum_deltas', round(sum_deltas, 6) + 0.0::DOUBLE FROM fx_profile
    """,
)
_kinds = {
    "full": "docks_available = 0",
    "almost_full": "docks_available <= 3",
    "normal": "NOT coalesce(docks_available <= 3 OR bikes_available <= 3, false)",
    "almost_empty": "bikes_available <= 3",
    "empty": "bikes_available = 0",
}
final(
    "occupancy",
    f"""
    SELECT station_id, {', '.join(f'round(avg("{k}"), 6) AS "{k}"' for k in _kinds)}
    FROM (SELECT station_id, CAST(time AS DATE) AS day,
                 {', '.join(f'100.0::DOUBLE * count(*) FILTER ({c}) / count(*) AS "{k}"' for k, c in _kinds.items())}
          FROM fx_status GROUP BY ALL)
    GROUP BY station_id
    """,
)
part(
    "fx_window_flags",
    f"""
    SELECT station_id, bin, coalesce(max(bikes_available - low) > 0, false) AS has_increase,
           max(CAST(docks_available > 0 AND docks_available < 3 AS INTEGER)) = 1 AS has_almost_full,
           min(docks_available) = 0 AS has_full
    FROM (SELECT *, {bin_of('time', P.interval)} AS bin,
                 min(bikes_available) OVER (PARTITION BY station_id, {bin_of('time', P.interval)}
                                            ORDER BY {sec('time')}, bikes_available, docks_available
                                            ROWS UNBOUNDED PRECEDING) AS low
          FROM fx_status WHERE docks_available < 7)
    GROUP BY station_id, bin
    """,
)
final(
    "window_flags",
    f"SELECT station_id, {as_time('bin')} AS time, has_increase, has_almost_full, has_full FROM fx_window_flags",
)
final(
    "transition_rate",
    f"""
    SELECT n_antecedent, n_hit, round(n_hit / nullif(n_antecedent, 0), 6) AS rate,
           round(n_hit / nullif(n_hit + n_antecedent, 0), 6) AS rate_ref
    FROM (SELECT count(*) AS n_antecedent, count(*) FILTER (b.has_almost_full) AS n_hit
          FROM fx_window_flags a JOIN fx_window_flags b
            ON a.station_id = b.station_id AND b.bin = a.bin + {STEP}
          WHERE a.has_increase AND a.has_full)
    """,
)


def busy_part(kind: str) -> str:
    counts = [
        f"""
        SELECT station_id, {m} AS m, n FROM (
            SELECT {kind}_station_id AS station_id, {bin_of(f'{kind}_date', MINUTES * m)} AS bin, count(*) AS n
            FROM fx_trip GROUP BY ALL)
        """
        for m in (1, 2, 4)
    ]
    cols = ", ".join(
        f"count(*) FILTER (m = {m} AND n >= {t * m}) AS count_trsh{t * m}_intrv{m * MINUTES}"
        for m in (1, 2, 4)
        for t in (2, 3, 5)
    )
    return part(f"fx_busy_{kind}", f"SELECT station_id, {cols} FROM ({' UNION ALL '.join(counts)}) GROUP BY station_id")


final("busy_departures", f"SELECT * FROM {busy_part('start')}")
final("busy_arrivals", f"SELECT * FROM {busy_part('end')}")
final(
    "busy_totals",
    "SELECT "
    + ", ".join(
        f"CAST(sum(count_trsh{t * m}_intrv{m * MINUTES}) AS BIGINT) AS count_trsh{t * m}_intrv{m * MINUTES}"
        for m in (1, 2, 4)
        for t in (2, 3, 5)
    )
    + f" FROM {busy_part('end')}",
)
for _kind in ("start", "end"):
    part(
        f"fx_count_{_kind}",
        f"""
        SELECT {_kind}_station_id AS station_id, {bin_of(f'{_kind}_date', MINUTES)} AS bin, count(*) AS n
        FROM fx_trip GROUP BY ALL
        """,
    )
    part(
        f"fx_filled_{_kind}",
        f"""
        SELECT station_id, bin, coalesce(n, 0) AS n
        FROM (SELECT station_id, unnest(range(min(bin), max(bin) + 1, {MINUTES * 60})) AS bin
              FROM fx_count_{_kind} GROUP BY station_id)
        LEFT JOIN fx_count_{_kind} USING (station_id, bin)
        """,
    )
part(
    "fx_flow",
    f"""
    SELECT *, CAST(sum(delta_bikes) OVER ({_by_bin}) AS BIGINT) AS sum_delta
    FROM (SELECT station_id, bin, -coalesce(o.n, 0) AS bikes_out, coalesce(i.n, 0) AS bikes_in,
                 coalesce(i.n, 0) - coalesce(o.n, 0) AS delta_bikes
          FROM fx_filled_start o FULL JOIN fx_filled_end i USING (station_id, bin))
    """,
)
final(
    "net_flow",
    f"SELECT station_id, {as_time('bin')} AS time, bikes_out, bikes_in, delta_bikes, sum_delta FROM fx_flow",
)
part(
    "fx_both",
    f"""
    SELECT station_id, bin, bikes_available, delta_bikes, row_number() OVER ({_by_bin}) AS k
    FROM {_mean} JOIN fx_flow USING (station_id, bin)
    """,
)
final(
    "rebuild_status",
    f"""
    SELECT station_id, {as_time('bin')} AS time, round(bikes_available, 6) AS bikes_available, delta_bikes,
           round(first_value(bikes_available) OVER ({_by_bin})
                 + coalesce(sum(delta_bikes) OVER ({_by_bin} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) + 0.0::DOUBLE
           AS trips_bikes_available
    FROM fx_both
    """,
)
part(
    "fx_midnight",
    """
    SELECT station_id, k, bikes_available FROM fx_both WHERE bin % 86400 = 0
    UNION ALL SELECT station_id, 0, bikes_available FROM fx_both WHERE k = 1
    """,
)
final(
    "rebuild_reset",
    f"""
    SELECT b.station_id, {as_time('b.bin')} AS time, round(b.bikes_available, 6) AS bikes_available, b.delta_bikes,
           round(m.bikes_available + coalesce((SELECT sum(d.delta_bikes) FROM fx_both d
                 WHERE d.station_id = b.station_id AND d.k > m.k AND d.k < b.k), 0), 6) + 0.0::DOUBLE AS trips_bikes_available
    FROM fx_both b ASOF JOIN fx_midnight m ON b.station_id = m.station_id AND b.k > m.k
    """,
)
final(
    "null_audit",
    f"""
    SELECT station_id, count(*) AS n_bins,
           count(*) FILTER (bikes_available IS NULL OR docks_available IS NULL) AS n_null
    FROM {_mean} WHERE {as_time('bin')} >= TIMESTAMP '{SPLIT}' GROUP BY station_id
    """,
)
final(
    "null_totals",
    f"""
    SELECT count(*) AS n_bins, count(*) FILTER (bikes_available IS NULL OR docks_available IS NULL) AS n_null,
           count(*) FILTER (bikes_available IS NOT NULL AND docks_available IS NOT NULL) AS n_known
    FROM {_mean} WHERE {as_time('bin')} >= TIMESTAMP '{SPLIT}'
    """,
)
final("span", 'SELECT min(start_date) AS "first", max(end_date) AS "last" FROM fx_trip')

# --- correlation -------------------------------------------------------------------------

part("fx_nbrs_in", "SELECT DISTINCT end_id AS center, start_id AS station_id FROM fx_edges")
part(
    "fx_nbrs_both",
    """
    SELECT end_id AS center, start_id AS station_id FROM fx_edges
    UNION SELECT start_id, end_id FROM fx_edges
    """,
)
final("nbrs_in", "SELECT * FROM fx_nbrs_in")
final("nbrs_both", "SELECT * FROM fx_nbrs_both")
final(
    "neighborhood_wide",
    f"""
    SELECT center, station_id, {as_time('bin')} AS time,
           {', '.join(f'round(T{i}, 6) AS bikes_available_T{i}' for i in range(WIDTH))}
    FROM fx_nbrs_in JOIN (
        SELECT station_id, bin, {', '.join(f'lag(bikes_available, {i}) OVER ({_by_bin}) AS T{i}' for i in range(WIDTH))}
        FROM {_mean}) USING (station_id)
    """,
)


_thousandths = " || ',' || ".join(
    f"coalesce(CAST(CAST(round(T{i} * 1000) AS BIGINT) AS VARCHAR), '-')" for i in reversed(range(WIDTH))
)
final(
    "neighborhood_tables",
    f"""
    SELECT center, {as_time('bin')} AS time,
           string_agg(CAST(station_id AS VARCHAR) || ':' || {_thousandths}, ';' ORDER BY station_id) AS stations
    FROM fx_nbrs_in JOIN (
        SELECT station_id, bin, {', '.join(f'lag(bikes_available, {i}) OVER ({_by_bin}) AS T{i}' for i in range(WIDTH))}
        FROM {_mean}) USING (station_id)
    GROUP BY center, bin
    """,
)
final(
    "neighborhood_pivot",
    f"""
    SELECT {as_time('bin')} AS time, {', '.join(
        f'round(max(T{i}) FILTER (station_id = {s}), 6) AS "{s}_T{i}"' for s in PIVOT_STATIONS for i in range(WIDTH))}
    FROM fx_nbrs_in JOIN (
        SELECT station_id, bin, {', '.join(f'lag(bikes_available, {i}) OVER ({_by_bin}) AS T{i}' for i in range(WIDTH))}
        FROM {_mean}) USING (station_id)
    WHERE center = {PIVOT_CENTER} GROUP BY bin
    """,
)


def corr_sql(bins: str, nbrs: str, width: int, by: str = "") -> str:
    key = f"{by}, station_id" if by else "station_id"
    over = f"PARTITION BY {key} ORDER BY bin"
    series = part(
        f"fx_lagged_{bins}_{width}",
        " UNION ALL ".join(
            f"SELECT {key}, bin, {i} AS lag, lag(bikes_available, {i}) OVER ({over}) AS v FROM {bins}"
            for i in range(width)
        ),
    )
    pairs = part(
        f"fx_copairs_{nbrs}",
        f"""
        SELECT l.center, l.station_id AS a, r.station_id AS b
        FROM {nbrs} l JOIN {nbrs} r ON l.center = r.center AND l.station_id <= r.station_id
        """,
    )
    tag = f"x.{by}, " if by else ""
    same = f"AND x.{by} = y.{by}" if by else ""
    sums = part(
        f"fx_corr_{bins}_{nbrs}",
        f"""
        SELECT {tag} a, x.lag AS lag_a, b, y.lag AS lag_b, count(*) AS n,
               CASE WHEN min(x.v) < max(x.v) AND min(y.v) < max(y.v) THEN corr(x.v, y.v) END AS r
        FROM (SELECT DISTINCT a, b FROM {pairs})
        JOIN {series} x ON x.station_id = a JOIN {series} y ON y.station_id = b AND x.bin = y.bin {same}
        WHERE x.v IS NOT NULL AND y.v IS NOT NULL GROUP BY ALL
        """,
    )
    out = f"{by}, " if by else ""
    return f"""
    SELECT {out} center, a, CAST(lag_a AS BIGINT) AS lag_a, b, CAST(lag_b AS BIGINT) AS lag_b, n,
           round(r, 6) + 0.0::DOUBLE AS r
    FROM {sums} JOIN {pairs} USING (a, b)
    """


final("lag_corr", corr_sql(_mean, "fx_nbrs_in", LAGS))
final(
    "lag_corr_slot",
    corr_sql(binned_part("avg", 1440, "fx_day_slots", "day_slot"), "fx_nbrs_both", LAGS, "day_slot"),
)

# --- trips and graph ---------------------------------------------------------------------

final(
    "graph_size",
    """
    SELECT (SELECT count(*) FROM (SELECT start_id FROM fx_edges UNION SELECT end_id FROM fx_edges)) AS n_nodes,
           (SELECT count(*) FROM fx_edges) AS n_edges
    """,
)
final("od_weights", "SELECT * FROM fx_edges")
final("edge_importance", "SELECT start_id, end_id, weight AS count FROM fx_edges")
final("weight_stats", "SELECT count(*) AS n_edges, round(avg(weight), 6) AS mean_weight FROM fx_edges")


def box_sql(source: str, value: str) -> str:
    quart = ", ".join(f"quantile_cont(v, {q}) AS {n}" for n, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)))
    inside = "v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"
    whisker = (lambda c: f"round({c}, 6)") if value == "minutes" else (lambda c: c)
    return f"""
    SELECT kind, count(*) AS n_rows, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median,
           round(any_value(q3), 6) AS q3, {whisker(f'min(v) FILTER ({inside})')} AS whisker_low,
           {whisker(f'max(v) FILTER ({inside})')} AS whisker_high, count(*) FILTER (NOT ({inside})) AS n_outliers
    FROM {source} JOIN (SELECT kind, {quart} FROM {source} GROUP BY kind) USING (kind) GROUP BY kind
    """


part(
    "fx_minutes",
    """
    SELECT 'all' AS kind, duration / 60 AS v FROM fx_trip
    UNION ALL SELECT subscription_type, duration / 60 FROM fx_trip
    """,
)
part("fx_weights", "SELECT 'all' AS kind, weight AS v FROM fx_edges")
final("duration_box", box_sql("fx_minutes", "minutes"))
final("weight_box", box_sql("fx_weights", "weight"))
part(
    "fx_heavy",
    """
    SELECT start_id AS a, end_id AS b FROM fx_edges WHERE weight > 12
    UNION SELECT end_id, start_id FROM fx_edges WHERE weight > 12
    """,
)
part("fx_reach", "SELECT a AS id, a AS other FROM fx_heavy UNION SELECT id, b FROM fx_reach JOIN fx_heavy ON a = other")
part("fx_component", "SELECT id, min(other) AS component FROM fx_reach GROUP BY id")
final("components", "SELECT id, component, count(*) OVER (PARTITION BY component) AS size FROM fx_component")
part(
    "fx_degrees",
    """
    SELECT station, in_deg, out_deg, w_in, w_out, city
    FROM (SELECT coalesce(i.station, o.station) AS station, coalesce(in_deg, 0) AS in_deg,
                 coalesce(out_deg, 0) AS out_deg, coalesce(w_in, 0) AS w_in, coalesce(w_out, 0) AS w_out
          FROM (SELECT end_id AS station, count(*) AS in_deg, CAST(sum(weight) AS BIGINT) AS w_in
                FROM fx_edges GROUP BY 1) i
          FULL JOIN (SELECT start_id AS station, count(*) AS out_deg, CAST(sum(weight) AS BIGINT) AS w_out
                     FROM fx_edges GROUP BY 1) o ON i.station = o.station)
    LEFT JOIN fx_station ON id = station
    """,
)
final("degrees", "SELECT * FROM fx_degrees")
final("edge_file", "SELECT * FROM fx_degrees")
final("top_stations", "SELECT * FROM fx_degrees ORDER BY w_in DESC, station LIMIT 25")
final("bottom_stations", "SELECT * FROM fx_degrees ORDER BY w_in, station LIMIT 25")
final(
    "top_per_city",
    """
    SELECT *, row_number() OVER (PARTITION BY city ORDER BY w_in DESC, station) AS rank FROM fx_degrees
    QUALIFY rank <= 5
    """,
)
final(
    "self_loops",
    """
    SELECT count(*) FILTER (start_id = end_id) AS n_loops, count(DISTINCT start_id) AS n_nodes FROM fx_edges
    """,
)
final(
    "hourly_share",
    """
    SELECT h.hour, count(id) AS n_trips, round(100.0::DOUBLE * count(id) / (SELECT count(*) FROM fx_trip), 6) AS percent
    FROM range(24) h(hour) LEFT JOIN fx_trip ON hour(start_date) = h.hour GROUP BY h.hour
    """,
)
part(
    "fx_speed",
    f"""
    SELECT t.id, start_station_id, end_station_id, duration / 60 AS duration, {haversine('a', 'b')} AS distance,
           3600 * {haversine('a', 'b')} / duration AS avg_speed
    FROM fx_trip t LEFT JOIN fx_station a ON a.id = start_station_id LEFT JOIN fx_station b ON b.id = end_station_id
    """,
)
_speed = """
    SELECT id, start_station_id, end_station_id, round(duration, 6) AS duration, round(distance, 6) AS distance,
           round(avg_speed, 6) AS avg_speed FROM fx_speed
    """
final("trip_speed", _speed)
final("far_trips", f"SELECT * FROM ({_speed}) WHERE distance >= 2.5")
final("fast_trips", f"SELECT * FROM ({_speed}) WHERE avg_speed >= 60")

# --- comparison classifiers --------------------------------------------------------------

_daily = binned_part("avg", 1440)
_values = [(c, i) for i in reversed(range(WIDTH)) for c in ("docks_available", "bikes_available")]
part(
    "fx_lags",
    f"""
    SELECT station_id, city, bin, [{', '.join(f'lag({c}, {i}) OVER ({_by_bin})' for c, i in _values)}] AS own,
           {_next} AS status
    FROM {_daily} JOIN fx_station ON id = station_id
    """,
)
part("fx_known", f"SELECT * FROM fx_lags WHERE {' AND '.join(f'own[{i + 1}] IS NOT NULL' for i in range(2 * WIDTH))}")
part(
    "fx_complete",
    """
    SELECT city, bin, flatten(list(own ORDER BY station_id)) AS features
    FROM fx_known JOIN (SELECT city, count(*) AS n FROM fx_station GROUP BY city) USING (city)
    GROUP BY city, bin, n HAVING count(*) = n
    """,
)
part("fx_features", "SELECT * FROM fx_known JOIN fx_complete USING (city, bin) WHERE status IS NOT NULL")
final(
    "feature_table",
    f"""
    SELECT station_id, city, {as_time('bin')} AS time, status,
           array_to_string(list_transform(features, lambda x: CAST(CAST(round(x * 1000) AS BIGINT) AS VARCHAR)), ',')
           AS features
    FROM fx_features
    """,
)
part(
    "fx_station_confusion",
    f"SELECT station_id, {cells(f'own[{2 * WIDTH - 1}] <= 2', '''status = 'QP' ''')} FROM fx_features GROUP BY station_id",
)
part(
    "fx_micro",
    f"SELECT {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ('tp', 'tn', 'fp', 'fn'))} FROM fx_station_confusion",
)
final("station_metrics", metrics_sql("fx_station_confusion", "station_id,"))
final("micro_metrics", metrics_sql("fx_micro"))
final(
    "class_weights",
    """
    SELECT station_id, status, n_class, CAST(sum(n_class) OVER (PARTITION BY station_id) AS BIGINT) AS n_rows,
           round(sum(n_class) OVER (PARTITION BY station_id) / (2.0::DOUBLE * n_class), 6) AS weight
    FROM (SELECT station_id, status, count(*) AS n_class FROM fx_features GROUP BY ALL)
    """,
)


part(
    "fx_scored",
    f"""
    SELECT station_id, count(*) AS n_rows, count(*) FILTER (status = 'QP') AS n_positive FROM fx_features
    WHERE city = '{CITY}' AND {as_time('bin')} >= TIMESTAMP '{SPLIT}'
      AND station_id IN (SELECT station_id FROM fx_features WHERE {as_time('bin')} < TIMESTAMP '{SPLIT}')
    GROUP BY station_id
    """,
)
for _key in ("dt", "rf", "gbt"):
    final(f"{_key}_confusion", "SELECT * FROM fx_scored")
final(
    "classifier_comparison",
    f"""
    SELECT classifier, CAST(sum(n_rows) AS BIGINT) AS n_rows, CAST(sum(n_positive) AS BIGINT) AS n_positive
    FROM fx_scored, (VALUES {', '.join(f"('{m}')" for m in MODELS)}) m(classifier) GROUP BY classifier
    """,
)


def grown(name: str, rows: str, depth: int) -> str:
    """Trees per model ``s`` over rows (s, station_id, x, y, w; w = 0: to be predicted): one step of the tree per part."""
    part(f"{name}_0", f"SELECT *, 1::BIGINT AS node FROM {rows}")

    def impurity(n: str, p: str) -> str:
        return f"(CASE WHEN {n} = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * ({p}) * ({n} - ({p})) / ({n}) END)"

    for k in range(depth):
        part(
            f"{name}_h{k}",
            f"""
            SELECT s, node, f, b, sum(w) AS n, sum(w * y) AS p FROM (
              SELECT s, node, w, y, unnest(range(len(x))) AS f, unnest(x) AS b FROM {name}_{k} WHERE w > 0 AND node >= {1 << k})
            GROUP BY ALL
            """,
        )
        part(
            f"{name}_c{k}",
            f"""
            SELECT *, sum(n) OVER upto AS ln, sum(p) OVER upto AS lp, sum(n) OVER whole AS tn, sum(p) OVER whole AS tp
            FROM {name}_h{k}
            WINDOW whole AS (PARTITION BY s, node, f), upto AS (PARTITION BY s, node, f ORDER BY b)
            """,
        )
        part(
            f"{name}_b{k}",
            f"""
            SELECT s, node, f, b FROM (
              SELECT *, round({impurity('tn', 'tp')} - {impurity('ln', 'lp')} - {impurity('tn - ln', 'tp - lp')}, 9) AS gain
              FROM {name}_c{k} WHERE ln < tn)
            WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY s, node ORDER BY gain DESC, f, b) = 1
            """,
        )
        part(
            f"{name}_{k + 1}",
            f"""
            SELECT t.s, station_id, x, y, w, CASE WHEN f IS NULL THEN t.node ELSE 2 * t.node + CAST(x[f + 1] > b AS INT) END AS node
            FROM {name}_{k} t LEFT JOIN {name}_b{k} g ON t.s = g.s AND t.node = g.node
            """,
        )
    part(f"{name}_leaf", f"SELECT s, node, sum(w) AS n, sum(w * y) AS p FROM {name}_{depth} WHERE w > 0 GROUP BY ALL")
    return part(
        f"{name}_hit", f"SELECT station_id, y, 2 * p > n AS hit FROM {name}_{depth} JOIN {name}_leaf USING (s, node) WHERE w = 0"
    )


def _binned(features: str) -> str:
    return f"[CAST(greatest(0, least(63, floor(round(v, 6)))) AS INT) FOR v IN {features}]"


_late = f"CAST({as_time('bin')} < TIMESTAMP '{SPLIT}' AS INT) AS w, CAST(status = 'QP' AS INT) AS y"
part("fx_tree_rows", f"SELECT station_id AS s, station_id, {_binned('features')} AS x, {_late} FROM fx_features")
part(
    "fx_city_means",
    f"SELECT city, bin, [{', '.join(f'avg(own[{i + 1}])' for i in range(2 * WIDTH))}] AS means FROM fx_features GROUP BY ALL",
)
part(
    "fx_network_rows",
    f"""
    SELECT 0 AS s, station_id, {_binned('list_concat(own, means)')} AS x, {_late}
    FROM fx_features JOIN fx_city_means USING (city, bin)
    """,
)
for _key, _rows in (("tree_confusion", "fx_tree_rows"), ("network_tree_confusion", "fx_network_rows")):
    _hit = grown(f"{_rows}_t", _rows, TREE_DEPTH)
    final(_key, f"SELECT station_id, {cells('hit', 'y = 1')} FROM {_hit} GROUP BY station_id")


def oracle_sql() -> dict[str, str]:
    return {key: _with_parts(sql) for key, sql in _final.items()}
