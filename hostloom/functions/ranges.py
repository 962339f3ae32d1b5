"""Address ranges as data: a table of ranges, looked up by longest prefix, in place of the compiled pattern.

A table has rows (cidr, is_global), IPv4 and IPv6. It is flattened once, on the driver, into disjoint segments with rising
bounds; an address finds its segment by binary search over an array literal, so the test stays an expression in the scan
stage: no join, no Python worker. An address in no range has the default of its family.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from hostloom.functions import addresses as A

# Longest table that is taken as a literal.
MAX_RANGES = 20_000

Row = tuple[str, bool]


def standard_ranges() -> list[Row]:
    """The ranges behind ``addresses.is_public``. An IPv4 address mapped into IPv6 follows the IPv4 rows but the shared
    space."""
    rows = [(c, False) for c in A.V4_PRIVATE + A.V4_SHARED + A.V6_PRIVATE]
    rows += [(c, True) for c in A.V4_EXCEPTIONS + A.V6_EXCEPTIONS]
    for cidrs, flag in ((A.V4_PRIVATE, False), (A.V4_EXCEPTIONS, True)):
        for cidr in cidrs:
            start, length = cidr.split("/")
            rows.append((f"::ffff:{start}/{int(length) + 96}", flag))
    return rows


@dataclass(frozen=True)
class Segments:
    """Rising first addresses as fixed-width hexadecimal text; ``flags`` has one more entry, for what lies before."""

    bounds: tuple[str, ...]
    flags: tuple[bool, ...]


@dataclass(frozen=True)
class IpRanges:
    v4: Segments
    v6: Segments


def compiled(rows: Iterable[Row], default: bool = True) -> IpRanges:
    """Segments of a table. The longest prefix decides; a range listed twice with different flags is an error."""
    known: dict = {}
    for cidr, flag in rows:
        net = ipaddress.ip_network(cidr)
        if known.setdefault(net, bool(flag)) != bool(flag):
            raise ValueError(f"range {cidr} is listed with both flags")
    if len(known) > MAX_RANGES:
        raise ValueError(f"more than {MAX_RANGES} ranges")
    families = []
    for version, bits in ((4, 32), (6, 128)):
        ranges = [(int(n.network_address), int(n.broadcast_address), f) for n, f in known.items() if n.version == version]
        families.append(_flattened(ranges, bits, default))
    return IpRanges(*families)


def _flattened(ranges: Sequence[tuple[int, int, bool]], bits: int, default: bool) -> Segments:
    flag_from: dict[int, bool] = {}
    inside: list[tuple[int, bool]] = []  # ends and flags of the ranges around the current address, outermost first

    def leave(before: int) -> None:
        while inside and inside[-1][0] < before:
            end, _ = inside.pop()
            flag_from[end + 1] = inside[-1][1] if inside else default

    for start, end, flag in sorted(ranges, key=lambda r: (r[0], -r[1])):
        leave(start)
        inside.append((end, flag))
        flag_from[start] = flag
    leave(1 << bits)
    bounds, flags = [], [default]
    for point in sorted(flag_from):
        if point < 1 << bits and flag_from[point] != flags[-1]:
            bounds.append(f"{point:0{bits // 4}x}")
            flags.append(flag_from[point])
    return Segments(tuple(bounds), tuple(flags))


def _v4_digits(ip: Column) -> Column:
    number = F.lit(0).cast("bigint")
    for position in range(1, 5):
        number = number * 256 + A.octet(ip, position)
    return F.lower(F.lpad(F.hex(number), 8, "0"))


def _looked_up(digits: Column, segments: Segments) -> Column:
    """Flag of the last segment that does not begin behind ``digits``."""
    count = len(segments.bounds)
    if not count:
        return F.lit(segments.flags[0])
    bounds = F.array(*[F.lit(b) for b in segments.bounds])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(count.bit_length()))])
    # ``get`` is null beyond the array, and so is the comparison: the step is not taken.
    passed = F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= digits, at + step).otherwise(at)
    )
    return F.get(F.array(*[F.lit(f) for f in segments.flags]), passed)


def is_public_by(ip: Column, ranges: IpRanges) -> Column:
    """Globally routable by the table? Text that is no address, and null, is not."""
    digits = A.ipv6_digits(ip)
    tail = F.split_part(ip, F.lit(":"), F.lit(-1))
    # A dotted tail stands for the last 32 bits.
    whole = F.when(digits.contains("."), F.concat(F.substring(digits, 1, 24), _v4_digits(_unzoned(tail)))).otherwise(digits)
    six = F.when(A.is_ipv6_digits(digits), _looked_up(whole, ranges.v6))
    four = F.when(A.is_ipv4(ip), _looked_up(_v4_digits(ip), ranges.v4))
    return F.coalesce(F.when(A.is_ipv6(ip), six).otherwise(four), F.lit(False))


def _unzoned(text: Column) -> Column:
    return F.split_part(text, F.lit("%"), F.lit(1))
