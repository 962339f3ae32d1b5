"""The 94 features of each host, written out with plain loops over session tuples."""

from __future__ import annotations

import statistics
from collections import Counter, defaultdict
from fractions import Fraction

from hostloom.schema import SERIES


def mean(values):
    values = [v for v in values if v is not None]
    return float(Fraction(sum(values), len(values))) if values else 0.0


def variance(values):
    values = [v for v in values if v is not None]
    return float(statistics.variance([Fraction(v) for v in values])) if len(values) > 1 else 0.0


def deviation(values):
    return variance(values) ** 0.5


def busiest(values):
    counts = Counter(v for v in values if v is not None)
    return max(counts.values(), default=0)


def commonest(values):
    counts = Counter(v for v in values if v is not None)
    return min(counts, key=lambda v: (-counts[v], v)) if counts else 0


def minor_share(values):
    values = [v for v in values if v is not None]
    return sum(v != commonest(values) for v in values) / len(values) if values else 0.0


def distribution(ports, sessions):
    """Nine shape features and five top ports of one series."""
    counts = Counter(ports)
    entries = sorted(counts.items(), key=lambda e: (-e[1], -1 if e[0] is None else e[0]))
    top = [(p or 0) for p, _ in entries[:5]] + [0] * (5 - len(entries[:5]))
    if sessions <= 1:
        return [1.0, 1.0, 1.0, 1.0, 0.0, 0, 0, 0, 0], top
    shares = []
    for quarter in range(4):
        running = 0
        for _, count in entries:
            running += count
            if Fraction(running, sessions) > Fraction(quarter, 4):
                shares.append(count / sessions)
                break
    values = [c for _, c in entries]
    average = Fraction(sum(values), len(values))
    spread = sum((v - average) ** 2 for v in values) / len(values)
    above = [sum(v > average and (v - average) ** 2 > k * k * spread for v in values) for k in range(4)]
    return shares + [float(spread)] + above, top


def host_features(sessions, user_band="as_written"):
    """``sessions``: dicts of internal sessions in the column contract."""
    sent, received = defaultdict(list), defaultdict(list)
    for s in sessions:
        sent[s["source_ip"]].append(s)
        received[s["destination_ip"]].append(s)
    result = {}
    for ip in set(sent) | set(received):
        out, inc = sent[ip], received[ip]
        f = {}
        for m in ("bytes", "packets"):
            own = [s[f"source_{m}"] for s in out] + [s[f"destination_{m}"] for s in inc]
            far = [s[f"destination_{m}"] for s in out] + [s[f"source_{m}"] for s in inc]
            for end, values in (("source", own), ("destination", far)):
                f[f"{end}_{m}_mean"], f[f"{end}_{m}_var"] = mean(values), variance(values)
        durations = [s["last_packet"] - s["first_packet"] for s in out + inc]
        f["duration_mean"], f["duration_var"] = mean(durations), variance(durations)
        f["ipProtocol_unique"] = len({s["ip_protocol"] for s in out + inc} - {None})
        own = [s["source_port"] for s in out] + [s["destination_port"] for s in inc]
        far = [s["destination_port"] for s in out] + [s["source_port"] for s in inc]
        for end, ports in (("source", own), ("destination", far)):
            ports = [p for p in ports if p is not None]
            user = ports if user_band == "as_written" else [p for p in ports if 1024 <= p < 49151]
            for band, inside in (("system", [p for p in ports if p < 1024]), ("user", user)):
                f[f"{end}_port_{band}_unique"] = len(set(inside))
                f[f"{end}_port_{band}_std"] = deviation(inside)
                f[f"{end}_port_{band}_most_count"] = busiest(inside)
            f[f"{end}_port_dynamic"] = sum(p >= 49151 for p in ports)
        f["host_lt_other"] = sum(a < b for a, b in zip(own, far) if a is not None and b is not None)
        for suffix, rows in (("", out), ("_inc", inc)):
            f[f"sessions{suffix}"] = sum(s["source_bytes"] is not None for s in rows)
            network = [s["network_bytes"] for s in rows]
            f[f"network_bytes_mean{suffix}"], f[f"network_bytes_var{suffix}"] = mean(network), variance(network)
            protocols = [s["ip_protocol"] for s in rows]
            f[f"ipProtocol_mode{suffix}"] = commonest(protocols)
            f[f"ipProtocol_minor_fraction{suffix}"] = minor_share(protocols)
            a, b = (len({s[f"{e}_port"] for s in rows} - {None}) for e in ("source", "destination"))
            f[f"port_intext_ratio{suffix}"] = a / b if b else 0.0
        for series in SERIES:
            suffix = "_inc" if series.endswith("_inc") else ""
            rows = inc if suffix else out
            ports = [s[f"{series.split('_')[0]}_port"] for s in rows]
            shape, top = distribution(ports, f[f"sessions{suffix}"])
            names = [f"featuresfracq{q}" for q in range(4)] + ["featuresvar", "featuresabvavg"]
            names += [f"featuresabvavg{k}s" for k in (1, 2, 3)]
            f.update({f"{series}_{n}": v for n, v in zip(names, shape)})
            f.update({f"{series}_top5_{k}": v for k, v in enumerate(top, 1)})
        result[ip] = f
    return result
