"""Oracle SQL for every query that SQL can express.

Written along other lines than the Spark code: lookups and NOT IN instead of pattern tests, unions of
the two directions instead of one mirrored pass, distinct aggregates and port-level windows instead of
count tables, range joins instead of slice arithmetic.
"""

from __future__ import annotations

import math
import re
from functools import cache

from hostloom.plans import standin
from hostloom.plans.queries import FOLDS, HOST, OFF_TIES, OVERLAP, SLICES, SUBNET, TIMELINE_EDGES, UNEVEN_EDGES
from hostloom.schema import FEATURE_GROUPS, FEATURES, SERIES, SHARE_FEATURES, SPREAD_FEATURES

HOUR = 3600000
ROLES = (0, 1, 2, 3, 4)


def _digits(value: str) -> str:
    """Single precision, as the queries keep it."""
    return f"CAST(CAST({value} * {OFF_TIES}::DOUBLE AS FLOAT) AS DOUBLE)"


def _r(expression: str, name: str) -> str:
    return f"CAST(coalesce({expression}, 0) AS DOUBLE) AS {name}"


# --- shared subqueries

_OCTET = "CAST(split_part(ip, '.', {}) AS BIGINT)"
_NUMBER = " * 256 + ".join(["((" + _OCTET.format(1), _OCTET.format(2) + ")", _OCTET.format(3) + ")", _OCTET.format(4)])


def _number(dotted: str) -> int:
    value = 0
    for part in dotted.split("."):
        value = value * 256 + int(part)
    return value


# First and last address of the ranges that are not global.
_NOT_GLOBAL = (
    ("0.0.0.0", "0.255.255.255"),
    ("10.0.0.0", "10.255.255.255"),
    ("100.64.0.0", "100.127.255.255"),
    ("127.0.0.0", "127.255.255.255"),
    ("169.254.0.0", "169.254.255.255"),
    ("172.16.0.0", "172.31.255.255"),
    ("192.0.0.0", "192.0.0.8"),
    ("192.0.0.11", "192.0.0.255"),
    ("192.0.2.0", "192.0.2.255"),
    ("192.168.0.0", "192.168.255.255"),
    ("198.18.0.0", "198.19.255.255"),
    ("198.51.100.0", "198.51.100.255"),
    ("203.0.113.0", "203.0.113.255"),
    ("240.0.0.0", "255.255.255.255"),
)
_IN_RANGES = " OR ".join(f"num BETWEEN {_number(a)} AND {_number(b)}" for a, b in _NOT_GLOBAL)


def _ends(source: str, keys: str = "") -> str:
    """Both directions of ``source`` from the host's point of view."""
    shared = f"{keys} ip_protocol, network_bytes, last_packet - first_packet AS duration, source_bytes AS sent"
    halves = []
    for own, far, inc in (("source", "destination", 0), ("destination", "source", 1)):
        pairs = ", ".join(
            f"{own}_{m} AS source_{m}, {far}_{m} AS destination_{m}" for m in ("port", "bytes", "packets")
        )
        halves.append(f"SELECT {own}_ip AS ip, {far}_ip AS other_ip, {inc} AS inc, {pairs}, {shared} FROM {source}")
    return " UNION ALL ".join(halves)


def _port_rows(source: str, keys: str) -> str:
    parts = []
    for series in SERIES:
        end = series.split("_")[0]
        host = "destination" if series.endswith("_inc") else "source"
        parts.append(
            f"SELECT {keys} {host}_ip AS ip, '{series}' AS series, {end}_port AS port, count(*) AS cnt "
            f"FROM {source} GROUP BY ALL"
        )
    return " UNION ALL ".join(parts)


def _ranked(source: str, keys: str) -> str:
    group = f"{keys} ip, series"
    return (
        f"SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY cnt DESC, port ASC NULLS FIRST) AS rn, "
        f"sum(cnt) OVER (PARTITION BY {group} ORDER BY cnt DESC, port ASC NULLS FIRST ROWS UNBOUNDED PRECEDING) AS cum, "
        f"sum(cnt) OVER (PARTITION BY {group}) AS total, count(*) OVER (PARTITION BY {group}) AS n, "
        f"sum(CAST(cnt AS HUGEINT) * cnt) OVER (PARTITION BY {group}) AS q FROM {source}"
    )


def _fine_columns(names: tuple[str, ...]) -> list[str]:
    columns = []
    for s in SERIES:
        here = f"series = '{s}'"
        for name in names:
            if name in SHARE_FEATURES:
                quarter = SHARE_FEATURES.index(name)
                value = (
                    f"coalesce(arg_min(cnt, rn) FILTER ({here} AND total > 1 AND cum * 4 > total * {quarter}) / "
                    f"max(total) FILTER ({here}), 1)"
                )
            elif name == "featuresvar":
                # (n Q - S^2) / n^2 in whole numbers; var_pop would miss exact rounding ties.
                n, total, q = (f"max({c}) FILTER ({here})" for c in ("n", "total", "q"))
                value = f"({n} * {q} - CAST({total} AS HUGEINT) * ({total})) / ({n} * {n})"
            elif name in SPREAD_FEATURES:
                k = SPREAD_FEATURES.index(name) - 1
                far = f"pow_(n * cnt - total) > {k * k} * (n * q - pow_(total))"
                far = re.sub(r"pow_\((.*?)\)", r"(CAST(\1 AS HUGEINT) * (\1))", far)
                value = f"count(*) FILTER ({here} AND n * cnt > total{' AND ' + far if k else ''})"
            else:
                value = f"max(port) FILTER ({here} AND rn = {name[-1]})"
            integer = name not in SHARE_FEATURES + ("featuresvar",)
            columns.append(f"CAST(coalesce({value}, 0) AS BIGINT) AS {s}_{name}" if integer else _r(value, f"{s}_{name}"))
    return columns


_TOP5 = tuple(f"top5_{k}" for k in range(1, 6))


def _fine(ranked: str, keys: str, names: tuple[str, ...]) -> str:
    return f"SELECT {keys} ip, {', '.join(_fine_columns(names))} FROM {ranked} GROUP BY {keys} ip"


def _coarse_columns(low: str, high: str) -> list[str]:
    columns = []
    for end in ("source", "destination"):
        p = f"{end}_port"
        user = f"{p} IS NOT NULL" if not low else f"{p} >= {low} AND {p} < {high}"
        for band, inside in (("system", f"{p} < 1024"), ("user", user)):
            columns.append(f"count(DISTINCT CASE WHEN {inside} THEN {p} END) AS {p}_{band}_unique")
            columns.append(_r(f"stddev_samp(CASE WHEN {inside} THEN {p} END)", f"{p}_{band}_std"))
            columns.append(
                f"coalesce(list_max(map_values(histogram({p}) FILTER ({inside}))), 0)::BIGINT AS {p}_{band}_most_count"
            )
        columns.append(f"count(*) FILTER ({p} >= 49151) AS {p}_dynamic")
    columns.append("count(*) FILTER (source_port < destination_port) AS host_lt_other")
    columns.append("count(DISTINCT ip_protocol) AS ipProtocol_unique")
    return columns


def _li(source: str, keys: str = "", low: str = "", high: str = "") -> str:
    columns = _coarse_columns(low, high)
    columns.append("list_max(map_values(histogram(ip_protocol)))::BIGINT AS ipProtocol_most_count")
    columns += [_r(f"avg({e}_bytes)", f"{e}_bytes_mean") for e in ("source", "destination")]
    columns += [_r(f"avg(TRY_CAST(split_part(other_ip, '.', {i}) AS INT)) / 255", f"ip_octet_byte_{i}") for i in (1, 2, 3, 4)]
    return f"SELECT {keys} ip, {', '.join(columns)} FROM {source} GROUP BY {keys} ip"


def _node(source: str, keys: str = "") -> str:
    measures = ("duration", "source_bytes", "destination_bytes", "source_packets", "destination_packets")
    columns = [_r(f"{f}({m})", f"{m}_{s}") for m in measures for f, s in (("avg", "mean"), ("var_samp", "var"))]
    return f"SELECT {keys} ip, {', '.join(columns)} FROM {source} GROUP BY {keys} ip"


def _lyu(source: str, keys: str = "") -> str:
    """Two grouped halves and a full join."""
    names = ("sessions", "network_bytes_mean", "network_bytes_var", "ipProtocol_mode", "ipProtocol_minor_fraction", "port_intext_ratio")
    halves = {}
    for host in ("source", "destination"):
        grouped = (
            f"SELECT {keys} {host}_ip AS ip, count(source_bytes) AS sessions, avg(network_bytes) AS network_bytes_mean, "
            f"var_samp(network_bytes) AS network_bytes_var, histogram(ip_protocol) AS h, "
            f"count(DISTINCT source_port) / nullif(count(DISTINCT destination_port), 0) AS port_intext_ratio "
            f"FROM {source} GROUP BY {keys} {host}_ip"
        )
        halves[host] = (
            f"SELECT * EXCLUDE (h), list_min(list_filter(map_keys(h), lambda c: h[c] = list_max(map_values(h)))) AS ipProtocol_mode, "
            f"1 - list_max(map_values(h)) / list_sum(map_values(h)) AS ipProtocol_minor_fraction FROM ({grouped})"
        )
    integer = ("sessions", "ipProtocol_mode")
    columns = []
    for side, suffix in (("a", ""), ("b", "_inc")):
        for name in names:
            value = f"{side}.{name}"
            columns.append(
                f"CAST(coalesce({value}, 0) AS BIGINT) AS {name}{suffix}" if name in integer else _r(value, f"{name}{suffix}")
            )
    using = f"{keys} ip"
    return (
        f"SELECT {using}, {', '.join(columns)} FROM ({halves['source']}) a "
        f"FULL JOIN ({halves['destination']}) b USING ({using})"
    )


def _all_features(keys: str, prefix: str) -> str:
    using = f"{keys} ip"
    return (
        f"SELECT {using}, {', '.join(FEATURES)} FROM {prefix}li LEFT JOIN "
        f"(SELECT * EXCLUDE (source_bytes_mean, destination_bytes_mean) FROM {prefix}node) USING ({using}) "
        f"LEFT JOIN {prefix}lyu USING ({using}) LEFT JOIN {prefix}fine USING ({using})"
    )


_ACTIVITY = f"""
SELECT ip, count(*) FILTER (inc = 0) AS n_src, count(*) FILTER (inc = 1) AS n_dst,
       count(*) FILTER (inc = 0 AND ans) AS n_src_ans, count(*) FILTER (inc = 1 AND ans) AS n_dst_ans, slice, slice_no
FROM (SELECT source_ip AS ip, 0 AS inc, destination_bytes > 0 AS ans, slice, slice_no FROM placed
      UNION ALL SELECT destination_ip, 1, destination_bytes > 0, slice, slice_no FROM placed)
GROUP BY ip, slice, slice_no
"""

CTES = {
    "sessions_raw": standin.SESSIONS_RAW,
    "sessions": "SELECT * FROM sessions_raw WHERE contains(event_provider, 'arkime') AND NOT contains(protocol, 'lldp')",
    "host_labels": standin.HOST_LABELS,
    "predictions": standin.PREDICTIONS,
    "seen": "SELECT source_ip AS ip FROM sessions UNION SELECT destination_ip FROM sessions",
    "v4": f"SELECT ip, {_NUMBER} AS num FROM (SELECT ip FROM seen WHERE ip NOT LIKE '%:%')",
    # The stand-in has IPv6 addresses of fd00::/8 only, none of which is global.
    "pub": f"SELECT ip FROM v4 WHERE NOT ({_IN_RANGES})",
    # The stand-in writes the last group of an IPv6 address with up to two digits in fd00::/120.
    "changed_pub": f"SELECT ip FROM v4 WHERE CASE WHEN num BETWEEN {_number('10.1.0.160')} AND {_number('10.1.0.163')} THEN TRUE "
    f"WHEN num BETWEEN {_number('10.1.0.128')} AND {_number('10.1.0.255')} THEN FALSE "
    f"WHEN num BETWEEN {_number('10.1.0.0')} AND {_number('10.1.255.255')} THEN TRUE "
    f"WHEN num BETWEEN {_number('8.8.1.0')} AND {_number('8.8.1.255')} THEN FALSE ELSE NOT ({_IN_RANGES}) END "
    "UNION ALL SELECT ip FROM seen WHERE regexp_full_match(ip, 'fd00::[0-9a-f]{1,2}')",
    "label_v4": f"SELECT ip, {_NUMBER} AS num FROM (SELECT ip FROM host_labels WHERE ip NOT LIKE '%:%')",
    "inventory": f"SELECT * FROM host_labels WHERE ip IN (SELECT ip FROM label_v4 WHERE {_IN_RANGES})",
    "internal": "SELECT * FROM sessions WHERE source_ip NOT LIKE '%:%' AND source_ip NOT IN (SELECT ip FROM pub) "
    "AND destination_ip NOT IN (SELECT ip FROM pub)",
    "mirrored": _ends("internal"),
    "src_totals": "SELECT source_ip AS ip, sum(source_bytes)::BIGINT AS source_bytes, sum(destination_bytes)::BIGINT AS "
    "destination_bytes, sum(network_bytes)::BIGINT AS network_bytes FROM sessions GROUP BY 1",
    "dst_totals": "SELECT destination_ip AS ip, sum(source_bytes)::BIGINT AS source_bytes_dst, sum(destination_bytes)::BIGINT AS "
    "destination_bytes_dst, sum(network_bytes)::BIGINT AS network_bytes_dst FROM sessions GROUP BY 1",
    "totals": "SELECT ip, "
    + ", ".join(
        f"coalesce({c}{d}, 0) AS {c}{d}" for d in ("", "_dst") for c in ("source_bytes", "destination_bytes", "network_bytes")
    )
    + " FROM src_totals FULL JOIN dst_totals USING (ip)",
    "ghosts": "SELECT * FROM totals WHERE source_bytes = 0 AND destination_bytes_dst = 0",
    "ignored": "SELECT * FROM totals WHERE destination_bytes = 0 AND source_bytes_dst = 0",
    "reals": "SELECT * FROM totals WHERE ip NOT IN (SELECT ip FROM ghosts) AND ip NOT IN (SELECT ip FROM ignored)",
    "roles": "SELECT *, blue_team IS DISTINCT FROM 'None' AS blue_team_bool, CAST(CASE WHEN ip NOT IN (SELECT ip FROM reals) THEN "
    "CASE WHEN ip IN (SELECT ip FROM ghosts) THEN 0 ELSE 1 END WHEN red_team THEN 2 WHEN blue_team IS DISTINCT FROM 'None' THEN 3 "
    "ELSE 4 END AS BIGINT) AS red_vs_blue FROM inventory",
    "facilities": "SELECT *, CAST(CASE WHEN red_vs_blue < 2 THEN red_vs_blue ELSE coalesce(list_position(['Corporate', "
    "'Confidential Data Storage', 'Cyprus Creek Campus'], facility) + 1, 5) END AS BIGINT) AS facility_class FROM roles",
    "raw_bounds": "SELECT min(first_packet) AS a, max(last_packet) FILTER (last_packet <= 1461418000000) AS d1_end, "
    "min(first_packet) FILTER (first_packet >= 1461417000000) AS b, max(last_packet) AS d2_end FROM sessions",
    "bounds": "SELECT "
    + ", ".join(
        f"{c} - {c} % 100 + CASE WHEN {c} % 100 > 50 OR ({c} % 100 = 50 AND ({c} // 100) % 2 = 1) THEN 100 ELSE 0 END AS {n}"
        for c, n in (("a", "d1_start"), ("b", "d2_start"))
    )
    + ", d1_end, d2_end FROM raw_bounds",
    "edges": f"SELECT range(d1_start, d1_end + {HOUR}, {HOUR}) AS e1, range(d2_start, d2_end, {HOUR}) AS e2 FROM bounds",
    "catalogue": "SELECT concat('d1_', i) AS slice, i AS slice_no, e1[i] AS start_ms, e1[i + 1] AS end_ms "
    "FROM (SELECT e1, unnest(range(1, len(e1))) AS i FROM edges) UNION ALL "
    "SELECT concat('d2_', i), i + len(e1) - 1, e2[i], e2[i + 1] FROM (SELECT e1, e2, unnest(range(1, len(e2))) AS i FROM edges)",
    "placed": "SELECT * FROM sessions LEFT JOIN catalogue ON first_packet > start_ms AND first_packet <= end_ms",
    "sliced": "SELECT * FROM placed WHERE slice IS NOT NULL",
    "sliced_internal": "SELECT * FROM sliced WHERE source_ip NOT LIKE '%:%' AND source_ip NOT IN (SELECT ip FROM pub) "
    "AND destination_ip NOT IN (SELECT ip FROM pub)",
    "sliced_mirrored": _ends("sliced_internal", "slice,"),
    "activity": _ACTIVITY,
    "ever": "SELECT ip, sum(n_src + n_dst_ans) > 0 AS ur, sum(n_src_ans + n_dst) > 0 AS ig FROM activity GROUP BY ip",
    "slabels": "SELECT ip, c.slice, c.slice_no, CAST(CASE WHEN a.ip IS NULL THEN -1 WHEN ever.ur AND n_src + n_dst_ans = 0 "
    "THEN 0 WHEN ever.ig AND n_src_ans + n_dst = 0 THEN 1 ELSE red_vs_blue END AS BIGINT) AS label FROM roles r "
    "CROSS JOIN catalogue c LEFT JOIN activity a USING (ip, slice) LEFT JOIN ever USING (ip)",
    "li": _li("mirrored"),
    "node": _node("mirrored"),
    "lyu": _lyu("internal"),
    "port_rows": _port_rows("internal", ""),
    "ranked": _ranked("port_rows", ""),
    "fine": _fine("ranked", "", SHARE_FEATURES + SPREAD_FEATURES + _TOP5),
    "features": _all_features("", ""),
    "s_li": _li("sliced_mirrored", "slice,"),
    "s_node": _node("sliced_mirrored", "slice,"),
    "s_lyu": _lyu("sliced_internal", "slice,"),
    "s_port_rows": _port_rows("sliced_internal", "slice,"),
    "s_ranked": _ranked("s_port_rows", "slice,"),
    "s_fine": _fine("s_ranked", "slice,", SHARE_FEATURES + SPREAD_FEATURES + _TOP5),
    "s_features": _all_features("slice,", "s_"),
    "early_internal": "SELECT * FROM sliced_internal WHERE regexp_matches(slice, '_[1-4]$')",
    "early_mirrored": _ends("early_internal"),
    "day_internal": "SELECT *, CASE WHEN first_packet < 1461417000000 THEN 'd1' ELSE 'd2' END AS part FROM internal",
    "day_mirrored": _ends("day_internal", "part,"),
} | {
    f"{prefix}_{name}": sql
    for prefix, keys in (("early", ""), ("day", "part,"))
    for name, sql in (
        ("li", _li(f"{prefix}_mirrored", keys)),
        ("node", _node(f"{prefix}_mirrored", keys)),
        ("lyu", _lyu(f"{prefix}_internal", keys)),
        ("port_rows", _port_rows(f"{prefix}_internal", keys)),
        ("ranked", _ranked(f"{prefix}_port_rows", keys)),
        ("fine", _fine(f"{prefix}_ranked", keys, SHARE_FEATURES + SPREAD_FEATURES + _TOP5)),
        ("features", _all_features(keys, f"{prefix}_")),
    )
} | {
    "feature_hosts": "SELECT ip, red_vs_blue FROM roles WHERE ip IN (SELECT ip FROM mirrored)",
    "ordered": "SELECT *, row_number() OVER (PARTITION BY red_vs_blue ORDER BY md5(concat(ip, '|0')), ip) AS rk, "
    "count(*) OVER (PARTITION BY red_vs_blue) AS size FROM feature_hosts",
    "split": "SELECT ip, red_vs_blue, CASE WHEN rk <= (size * 200 + 999) // 1000 THEN 'test' ELSE 'train' END AS part FROM ordered",
    "folds": "SELECT ip, red_vs_blue AS class, CAST((rk - 1) % 5 AS BIGINT) AS fold FROM ordered",
    "facility_folds": "SELECT facility_class AS class, (row_number() OVER (PARTITION BY facility_class ORDER BY "
    "md5(concat(ip, '|0')), ip) - 1) % 5 AS fold FROM facilities WHERE ip IN (SELECT ip FROM mirrored)",
    "present": "SELECT DISTINCT slice, ip FROM sliced_mirrored",
    "present_labels": "SELECT slice, ip, label FROM present JOIN slabels USING (slice, ip)",
    "per_class": "SELECT c, count(*) FILTER (y_true = c AND pred_a = c) AS tp, count(*) FILTER (y_true = c) AS support, "
    "count(*) FILTER (pred_a = c) AS predicted FROM predictions, (SELECT unnest([0, 1, 2, 3, 4]) AS c) GROUP BY c",
    "scores": "SELECT c, support, tp, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) "
    "AS recall, coalesce(2 * tp / nullif(support + predicted, 0), 0) AS f1 FROM per_class WHERE support + predicted > 0",
    "hits": "SELECT slice, slice_no, fold, CASE WHEN y_true = pred_a THEN 1.0::DOUBLE ELSE 0 END AS hit FROM predictions WHERE y_true > 1",
    "matrix": "SELECT slice, slice_no AS \"order\", "
    + ", ".join(f"(avg(hit) FILTER (fold = {f})) AS preds{f}" for f in FOLDS)
    + " FROM hits GROUP BY slice, slice_no",
    "pred_counts": "SELECT ip, pred_a, count(*) AS n FROM predictions GROUP BY ip, pred_a",
    "merged": "SELECT ip, CASE WHEN len(l) = 1 THEN l[1] ELSE l[2] END AS pred FROM "
    "(SELECT ip, list(pred_a ORDER BY n DESC, pred_a) AS l FROM pred_counts GROUP BY ip)",
    "compared": "SELECT s_features.*, label FROM s_features JOIN slabels USING (slice, ip) WHERE label IN (2, 4)",
}


_KEYS = "(SELECT CAST(unnest([0, 1, 2, 3, 4]) AS BIGINT) AS f), (SELECT unnest(['test', 'train']) AS part)"


def _cross_validated(source: str, more: str = "", tables: str = "") -> str:
    """Every fold and part with its number of rows; scores are in range and beat the largest class."""
    return (
        f"SELECT {more} f AS fold, part, count(*) AS support, TRUE AS in_range, TRUE AS beats_majority FROM {source} "
        f"x, {_KEYS} {tables} WHERE (x.fold = f) = (part = 'test') GROUP BY ALL"
    )


_BOTH_MODELS = (
    "SELECT slice, slice_no, fold, count(*) AS support, TRUE AS static_in_range, TRUE AS slice_in_range "
    "FROM present_labels JOIN catalogue USING (slice) JOIN folds USING (ip) WHERE label > 1 GROUP BY ALL"
)


def _with(sql: str) -> str:
    """``sql`` with the shared subqueries it needs, in order of definition."""
    needed: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in CTES:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN) {name}\b", text):
                needed.add(name)
                todo.append(CTES[name])
    parts = [f"{name} AS ({CTES[name]})" for name in CTES if name in needed]
    return f"WITH {', '.join(parts)} {sql}" if parts else sql


def _confusion(source: str, true: str, pred: str, share: bool = False, classes: tuple[int, ...] = ROLES) -> str:
    """A row for every class, also one that is never true."""
    cells = [f"count(*) FILTER ({pred} = {c})" for c in classes]
    columns = [
        f"{cell} / greatest(count({true}), 1) AS pred_{c}" if share else f"{cell} AS pred_{c}" for c, cell in zip(classes, cells)
    ]
    every = f"(SELECT CAST(unnest({list(classes)}) AS BIGINT) AS k) every"
    return (
        f"SELECT k AS \"true\", {', '.join(columns)} FROM {every} LEFT JOIN (SELECT * FROM {source}) x ON k = {true} GROUP BY k"
    )



_SCALED = [
    f"{e}_port_{s}"
    for e in ("source", "destination")
    for s in ("system_unique", "system_most_count", "user_unique", "user_most_count", "dynamic")
] + ["ipProtocol_unique", "ipProtocol_most_count"]
_STDS = [f"{e}_port_{b}_std" for e in ("source", "destination") for b in ("system", "user")]
_RAW_STD = ", ".join(
    f"coalesce(stddev_samp({e}_port) FILTER ({f'{e}_port < 1024' if b == 'system' else 'TRUE'}), 0) AS {e}_port_{b}_std"
    for e in ("source", "destination")
    for b in ("system", "user")
)
_SESSION_COLUMNS = (
    "source_ip, destination_ip, source_port, destination_port, source_bytes, destination_bytes, network_bytes, "
    "source_packets, destination_packets, ip_protocol, protocol, event_provider, first_packet, last_packet"
)
_LO, _HI, _WIDTH = TIMELINE_EDGES
_EDGE_BINS = len(range(_LO, _HI, _WIDTH)) - 1

# Steps of the Poisson(1) distribution: sums of exp(-1) / k!.
_STEPS = ", ".join(f"{sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))!r}::DOUBLE" for k in range(13))
_BAND = f"""
SELECT slice_no, avg(a) AS mean_accuracy, any_value(low) AS low, any_value(high) AS high
FROM (SELECT slice_no, fold, avg(hit) AS a FROM hits GROUP BY slice_no, fold) JOIN (
    SELECT slice_no, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM (
        SELECT slice_no, replicate, sum(w * a) / sum(w) AS m FROM (
            SELECT *, len(list_filter([{_STEPS}], lambda s: u >= s)) AS w FROM (
                SELECT slice_no, a, replicate, CAST(concat('0x', substr(md5(concat_ws('|', 0, slice_no, fold, replicate)), 1, 8))
                    AS BIGINT)::DOUBLE / 4294967296 AS u
                FROM (SELECT slice_no, fold, avg(hit) AS a FROM hits GROUP BY slice_no, fold),
                    (SELECT unnest(range(1000)) AS replicate)))
        GROUP BY slice_no, replicate HAVING sum(w) > 0)
    GROUP BY slice_no) USING (slice_no)
GROUP BY slice_no
"""

_AUTO = (
    "WITH logs AS (SELECT feature, label, round(log10(value), 9) AS x FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, label, CAST({c} AS DOUBLE) AS value FROM compared" for c in FEATURES)
    + """) WHERE value > 0),
rules AS (SELECT feature, min(x) AS lo, max(x) - min(x) AS span, (max(x) - min(x)) / (log2(count(*)) + 1) AS by_count,
    2 * (quantile_disc(x, 0.75) - quantile_disc(x, 0.25)) / pow(count(*)::DOUBLE, 1::DOUBLE / 3) AS by_quartiles FROM logs GROUP BY feature),
sized AS (SELECT *, CASE WHEN span = 0 THEN 1 WHEN by_quartiles > 0 THEN ceil(span / least(by_quartiles, by_count) - 1e-9)
    ELSE ceil(span / by_count - 1e-9) END AS bins FROM rules),
binned AS (SELECT feature, if(span = 0, lo - 0.5, lo) AS lo, if(span = 0, 1, span / bins) AS width, CAST(bins AS BIGINT) AS bins FROM sized),
counted AS (SELECT feature, label, least(CAST(floor((x - lo) / width + 1e-9) AS BIGINT), bins - 1) AS bin, lo, width, count(*) AS n
    FROM logs JOIN binned USING (feature) GROUP BY ALL)
SELECT feature, label, bin, lo + bin * width AS left, width, n, n / (sum(n) OVER (PARTITION BY feature, label) * width) AS density FROM counted"""
)

QUERIES = {
    "session_scan": "SELECT * FROM sessions_raw",
    "slice_store_roundtrip": "SELECT * FROM s_node",
    "label_table_csv": "SELECT ip, hostname, facility, blue_team, red_vs_blue FROM roles",
    "clean_sessions": "SELECT * FROM sessions",
    "internal_sessions": "SELECT * FROM internal",
    "internal_sessions_by_list": "SELECT * FROM internal",
    "session_duration": "SELECT source_ip, destination_ip, first_packet, last_packet, last_packet - first_packet AS duration FROM sessions",
    "mirrored_sessions": "SELECT * EXCLUDE (inc, sent) FROM mirrored",
    "ip_octets": "SELECT ip, ip_octet_byte_1, ip_octet_byte_2, ip_octet_byte_3, ip_octet_byte_4 FROM li",
    "slice_sessions": "SELECT slice, slice_no, source_ip, destination_ip, first_packet FROM sliced",
    "host_sessions": " UNION ALL ".join(
        f"SELECT '{role}' AS role, source_ip, destination_ip, first_packet, last_packet, network_bytes FROM sessions "
        f"WHERE {role}_ip = '{HOST}'"
        for role in ("source", "destination")
    ),
    "subnet_activity": f"SELECT ip, slice, slice_no, n_src + n_dst AS n FROM activity WHERE slice IS NOT NULL AND ip LIKE '{SUBNET}%'",
    "answered_sessions": "SELECT source_ip, destination_ip, first_packet, destination_bytes FROM sessions WHERE destination_bytes > 0",
    "activity_hist_wide": "SELECT ip, "
    + ", ".join(f"coalesce(sum(n_src + n_dst) FILTER (slice = '{s}'), 0)::BIGINT AS {s}" for s in SLICES)
    + " FROM activity GROUP BY ip",
    "host_features": "SELECT * FROM features",
    "feature_group_select": f"SELECT ip, {', '.join(FEATURE_GROUPS['coarse'])} FROM features",
    "class_subset": "SELECT ip, red_vs_blue, ['red', 'blue', 'gray'][red_vs_blue - 1] AS class_name FROM roles WHERE red_vs_blue > 1",
    "facility_hostnames": "SELECT DISTINCT hostname FROM host_labels WHERE facility = 'Confidential Data Storage'",
    "misclassified": "SELECT * FROM predictions WHERE y_true = 4 AND y_true <> pred_a",
    "accuracy_melt": " UNION ALL ".join(f"SELECT \"order\", 'preds{f}' AS variable, preds{f} AS value FROM matrix" for f in FOLDS),
    "labelled_features": "SELECT features.*, red_vs_blue FROM features JOIN roles USING (ip)",
    "host_rows": f"SELECT * FROM s_node WHERE ip IN ('{HOST}', '10.2.0.2')",
    "host_totals": "SELECT * FROM totals",
    "li_features": "SELECT * FROM li",
    "li_features_intended": _li("mirrored", low="1024", high="49151"),
    "li_features_scaled": "SELECT li.* REPLACE ("
    + ", ".join(f"({c} / sessions) AS {c}" for c in _SCALED)
    + ") FROM li JOIN (SELECT ip, count(source_bytes) AS sessions FROM mirrored GROUP BY ip) USING (ip)",
    "li_features_minmax": "SELECT li.* REPLACE ("
    + ", ".join(
        f"(coalesce((d.{c} - min(d.{c}) OVER ()) / nullif(max(d.{c}) OVER () - min(d.{c}) OVER (), 0), 0)) AS {c}"
        for c in _STDS
    )
    + f") FROM li JOIN (SELECT ip, {_RAW_STD} FROM mirrored GROUP BY ip) d ON li.ip = d.ip",
    "lyu_features": "SELECT * FROM lyu",
    "pro_node_features": "SELECT * FROM node",
    "pro_edge_features": "SELECT ip, other_ip, "
    + ", ".join(_r(f"avg({m})", f"{m}_mean") for m in ("duration", "destination_bytes", "destination_packets"))
    + " FROM mirrored GROUP BY ip, other_ip",
    "port_value_counts": "SELECT ip, series, CAST(rn - 1 AS INT) AS position, port, cnt FROM ranked",
    "activity_hist": "SELECT ip, slice, slice_no, n_src + n_dst AS n FROM activity WHERE slice IS NOT NULL",
    "period_bounds": "SELECT * FROM bounds",
    "label_counts": "SELECT red_vs_blue, count(*) AS n FROM roles GROUP BY 1",
    "facility_list": "SELECT DISTINCT facility FROM host_labels",
    "host_timeline": f"SELECT CASE WHEN first_packet = hi THEN 199 ELSE (first_packet - lo) * 200 // (hi - lo) END AS bin, count(*) AS n "
    f"FROM sessions, (SELECT min(first_packet) AS lo, max(first_packet) AS hi FROM sessions WHERE source_ip = '{HOST}') "
    f"WHERE source_ip = '{HOST}' GROUP BY 1",
    "host_timeline_edges": f"SELECT least((first_packet - {_LO}) // {_WIDTH}, {_EDGE_BINS - 1}) AS bin, count(*) AS n FROM sessions "
    f"WHERE destination_ip = '{HOST}' AND first_packet BETWEEN {_LO} AND {_LO + _EDGE_BINS * _WIDTH} GROUP BY 1",
    "uneven_edge_hist": f"SELECT protocol, len(list_filter({list(UNEVEN_EDGES)}, lambda e: e < first_packet)) AS bin, count(*) AS n "
    "FROM sessions WHERE first_packet IS NOT NULL GROUP BY 1, 2",
    "interval_activity": "SELECT c.slice AS interval, s.source_ip AS ip, count(*) AS n FROM sessions s JOIN catalogue c "
    f"ON s.first_packet > c.start_ms - {OVERLAP} AND s.first_packet <= c.end_ms + {OVERLAP} GROUP BY 1, 2",
    "accuracy_band": _BAND,
    "feature_density": "SELECT feature, label, bin, n, (n / (sum(n) OVER (PARTITION BY feature, label) * 0.1::DOUBLE)) AS density "
    "FROM (SELECT feature, label, CAST(floor(log10(value) * 10 + 1e-9) AS BIGINT) AS bin, count(*) AS n FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, label, CAST({c} AS DOUBLE) AS value FROM compared" for c in FEATURES)
    + ") WHERE value > 0 GROUP BY ALL)",
    "feature_density_auto": _AUTO,
    "port_quartile_shares": _fine("ranked", "", SHARE_FEATURES),
    "port_count_spread": _fine("ranked", "", SPREAD_FEATURES),
    "top5_ports": _fine("ranked", "", _TOP5),
    "port_distribution_features": "SELECT * FROM fine",
    "slice_features": "SELECT * FROM s_features",
    "host_features_from_states": "SELECT * FROM features",
    "slice_features_from_states": "SELECT * FROM s_features",
    "early_features_from_states": "SELECT * FROM early_features",
    "day_features_from_states": "SELECT * FROM day_features",
    "sessions_per_hour": "SELECT ip, (sessions / hours) AS sessions, (sessions_inc / hours) AS sessions_inc FROM lyu, "
    "(SELECT ((d1_end - d1_start) + (d2_end - d2_start)) / 3600000 AS hours FROM bounds)",
    "slice_catalogue": "SELECT * FROM catalogue",
    "slice_labels": "SELECT * FROM slabels",
    "slice_labels_simple": "SELECT r.ip, c.slice, c.slice_no, CASE WHEN a.ip IS NULL THEN -1 ELSE red_vs_blue END AS label "
    "FROM roles r CROSS JOIN catalogue c LEFT JOIN activity a USING (ip, slice)",
    "slice_labels_present": "SELECT * FROM present_labels",
    "hosts_missing_activity": "SELECT ip, NOT ur AS missing_ur, NOT ig AS missing_ig FROM ever WHERE NOT (ur AND ig)",
    "class_comparison": "SELECT s_node.*, label FROM s_node JOIN slabels USING (slice, ip) WHERE label IN (2, 4)",
    "public_ips": "SELECT ip FROM pub",
    "public_ips_by_ranges": "SELECT ip FROM pub",
    "public_ips_by_changed_ranges": "SELECT ip FROM changed_pub",
    "internal_sessions_by_ranges": "SELECT * FROM sessions WHERE source_ip NOT LIKE '%:%' AND source_ip NOT IN "
    "(SELECT ip FROM changed_pub) AND destination_ip NOT IN (SELECT ip FROM changed_pub)",
    "ipv4_hosts": "SELECT ip FROM v4",
    "labelled_hosts": "SELECT ip FROM v4 WHERE ip NOT IN (SELECT ip FROM pub)",
    "blue_team_flag": "SELECT ip, blue_team, blue_team IS DISTINCT FROM 'None' AS blue_team_bool FROM host_labels",
    "ghost_hosts": "SELECT * FROM ghosts",
    "ignored_hosts": "SELECT * FROM ignored",
    "real_hosts": "SELECT * FROM reals",
    "host_roles": "SELECT ip, blue_team_bool, red_team, red_vs_blue FROM roles",
    "facility_class": "SELECT ip, facility, red_vs_blue, facility_class FROM facilities",
    "class_weights": "SELECT red_vs_blue, count(*) AS n, ((SELECT count(*) FROM feature_hosts) / ((SELECT count(DISTINCT "
    "red_vs_blue) FROM feature_hosts) * count(*))) AS weight FROM feature_hosts GROUP BY red_vs_blue",
    "sample_weights": "SELECT ip, red_vs_blue, (count(*) OVER () / ((SELECT count(DISTINCT red_vs_blue) FROM feature_hosts) * "
    "count(*) OVER (PARTITION BY red_vs_blue))) AS weight FROM feature_hosts",
    "stratified_split": "SELECT * FROM split",
    "stratified_folds": "SELECT ip, red_vs_blue, CAST((rk - 1) % 5 AS INT) AS fold FROM ordered",
    "slice_train_test": "SELECT slice, ip, label, part FROM present_labels JOIN split USING (ip)",
    "classification_report": "SELECT CAST(c AS VARCHAR) AS label, (precision) AS precision, (recall) AS recall, "
    "(f1) AS f1, support FROM scores UNION ALL "
    "SELECT 'accuracy', (sum(tp) / sum(support)), (sum(tp) / sum(support)), (sum(tp) / sum(support)), "
    "CAST(sum(support) AS BIGINT) FROM scores UNION ALL "
    "SELECT 'macro avg', (avg(precision)), (avg(recall)), (avg(f1)), CAST(sum(support) AS BIGINT) FROM scores "
    "UNION ALL SELECT 'weighted avg', (sum(precision * support) / sum(support)), (sum(recall * support) / sum(support)), "
    "(sum(f1 * support) / sum(support)), CAST(sum(support) AS BIGINT) FROM scores",
    "macro_f1": "SELECT (avg(f1)) AS macro_f1 FROM scores",
    "confusion_matrix": _confusion("predictions", "y_true", "pred_a"),
    "confusion_matrix_norm": _confusion("predictions", "y_true", "pred_a", share=True),
    "facility_confusion": _confusion("facilities", "red_vs_blue", "facility_class", classes=(0, 1, 2, 3, 4, 5)),
    "public_list_from_disk": "SELECT * FROM internal",
    "fold_predictions_csv": "SELECT y_true, pred_a, CAST(fold AS BIGINT) AS fold, 'test' AS part FROM predictions",
    "score_table_csv": "SELECT slice, slice_no, avg(hit) AS accuracy FROM hits GROUP BY slice, slice_no",
    "direction_hist": "SELECT ip, slice, slice_no, n_src AS n_source, n_dst AS n_destination, n_src + n_dst_ans > 0 AS ur, "
    "n_src_ans + n_dst > 0 AS ig FROM activity WHERE slice IS NOT NULL",
    **{f"feature_group_{g}": f"SELECT ip, {', '.join(FEATURE_GROUPS[g])} FROM features" for g in FEATURE_GROUPS},
    "mismatches_by_host": "SELECT ip, count(*) AS n FROM predictions WHERE y_true <> pred_a GROUP BY ip",
    "model_vs_model": _confusion("predictions", "pred_a", "pred_b"),
    "agreement_confusion": _confusion("predictions WHERE pred_a = pred_b", "y_true", "pred_a"),
    "accuracy_by_slice": "SELECT slice, slice_no, (avg(hit)) AS accuracy FROM hits GROUP BY slice, slice_no",
    "accuracy_fold_matrix": "SELECT * FROM matrix",
    "accuracy_over_time": "SELECT slice_no, (avg(a)) AS mean_accuracy, (stddev_samp(a)) AS std_accuracy FROM "
    "(SELECT slice_no, fold, avg(hit) AS a FROM hits GROUP BY slice_no, fold) GROUP BY slice_no",
    "confused_hosts": "SELECT DISTINCT ip FROM predictions WHERE y_true = 4 AND pred_a = 2",
    "repeat_hosts": "SELECT ip, count(*) AS n, count(*) > 1 AS repeated FROM predictions GROUP BY ip",
    "merged_predictions": "SELECT ip, pred FROM merged",
    "ml_decision_tree": _cross_validated("folds"),
    "ml_random_forest": _cross_validated("folds"),
    "ml_boosted_trees": _cross_validated("folds"),
    "ml_facility": _cross_validated("facility_folds"),
    "ml_ablation": _cross_validated(
        "folds", "feature_group,", f", (SELECT unnest({list(FEATURE_GROUPS)}) AS feature_group)"
    ),
    "ml_depth_grid": "SELECT kind, CAST(unnest([1, 2, 4, 6, 8, 10, 12, 16, 20, 24, 30]) AS BIGINT) AS max_depth, TRUE AS in_range, "
    "TRUE AS consistent FROM (SELECT unnest(['decision_tree', 'random_forest']) AS kind)",
    "ml_depth_grid_boosted": "SELECT 'boosted_trees' AS kind, CAST(unnest([1, 2, 4, 6, 8, 10, 12, 16, 20, 24, 32, NULL]) AS BIGINT) "
    "AS max_depth, TRUE AS in_range, TRUE AS consistent",
    "ml_feature_importance": "SELECT f AS fold, r AS rank, TRUE AS known, TRUE AS in_range FROM "
    "(SELECT DISTINCT fold AS f FROM folds), (SELECT unnest(range(1, 11)) AS r)",
    "ml_static_vs_slice": _BOTH_MODELS,
    "ml_static_vs_slice_as_written": _BOTH_MODELS,
    "ml_fold_reports": f"SELECT f AS fold, part, class, count(*) AS support, TRUE AS in_range FROM folds x, {_KEYS} "
    "WHERE (x.fold = f) = (part = 'test') GROUP BY ALL",
    "ml_projection": "SELECT ip, ['red', 'blue', 'gray'][red_vs_blue - 1] AS class_name, TRUE AS in_range FROM feature_hosts "
    "WHERE red_vs_blue > 1",
    "merged_confusion": _confusion("merged JOIN roles USING (ip)", "red_vs_blue", "pred", share=True),
}


# Columns of floats, of which both sides keep single precision.
_FEATURE_FLOATS = r"(_mean|_var|_std|fraction|ratio|featuresvar|featuresfracq\d|octet_byte_\d)(_inc)?$"
_FLOATS = {
    "li_features_scaled": f"{_FEATURE_FLOATS}|^({'|'.join(_SCALED)})$",
    "sessions_per_hour": "^sessions",
    "accuracy_melt": "^value$",
    "feature_density": "^density$",
    "feature_density_auto": "^(left|width|density)$",
    "class_weights": "^weight$",
    "sample_weights": "^weight$",
    "classification_report": "^(precision|recall|f1)$",
    "macro_f1": "^macro_f1$",
    "confusion_matrix_norm": "^pred_",
    "merged_confusion": "^pred_",
    "accuracy_by_slice": "^accuracy$",
    "score_table_csv": "^accuracy$",
    "accuracy_fold_matrix": "^preds",
    "accuracy_over_time": "_accuracy$",
    "accuracy_band": "^(mean_accuracy|low|high)$",
} | dict.fromkeys(
    (
        "slice_store_roundtrip ip_octets host_features labelled_features host_rows li_features li_features_intended "
        "li_features_minmax lyu_features pro_node_features pro_edge_features class_comparison port_quartile_shares "
        "port_count_spread port_distribution_features slice_features "
        "host_features_from_states slice_features_from_states early_features_from_states day_features_from_states"
    ).split()
    + [f"feature_group_{g}" for g in FEATURE_GROUPS]
    + ["feature_group_select"],
    _FEATURE_FLOATS,
)


def _kept(name: str, sql: str) -> str:
    if name not in _FLOATS:
        return sql
    floats = f"COLUMNS('{_FLOATS[name]}')"
    if name == "macro_f1":  # no other column
        return f"SELECT {_digits('macro_f1')} AS macro_f1 FROM ({sql})"
    return f"SELECT COLUMNS(lambda c: NOT regexp_matches(c, '{_FLOATS[name]}')), {_digits(floats)} AS '\\0' FROM ({sql})"


@cache
def _texts() -> dict[str, str]:
    return {name: _with(_kept(name, sql)) for name, sql in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_texts())
