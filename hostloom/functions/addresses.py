"""Address tests as native string expressions: IPv4, globally routable, octets.

Each test is one regular expression per address, built once from the range list, so it runs inside
the scan's own stage: no lookup table, no join and no Python worker. Addresses of the usual internal ranges are told
by their first characters alone.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

# Special-purpose address ranges that are not globally reachable (IANA registries, as
# read by Python 3.13), the exceptions inside them, and the shared IPv4 space.
V4_PRIVATE = (
    "0.0.0.0/8",
    "10.0.0.0/8",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/24",
    "192.0.0.170/31",
    "192.0.2.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "240.0.0.0/4",
    "255.255.255.255/32",
)
V4_EXCEPTIONS = ("192.0.0.9/32", "192.0.0.10/32")
V4_SHARED = ("100.64.0.0/10",)
V6_PRIVATE = (
    "::1/128",
    "::/128",
    "64:ff9b:1::/48",
    "100::/64",
    "2001::/23",
    "2001:db8::/32",
    "2002::/16",
    "fc00::/7",
    "fe80::/10",
)
V6_EXCEPTIONS = (
    "2001:1::1/128",
    "2001:1::2/128",
    "2001:3::/32",
    "2001:4:112::/48",
    "2001:20::/28",
    "2001:30::/28",
)

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_QUAD = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def _dotted(cidr: str) -> str:
    """Pattern for the dotted form of the addresses in an IPv4 range."""
    net = ipaddress.IPv4Network(cidr)
    low, high = net.network_address.packed, net.broadcast_address.packed
    parts = ["|".join(str(v) for v in range(a, b + 1)) for a, b in zip(low, high) if (a, b) != (0, 255)]
    return r"\.".join(f"(?:{p})" for p in parts) + (r"\." if len(parts) < 4 else "$")


def _hex(cidr: str) -> str:
    """Pattern for the fixed-width hexadecimal form of the addresses in a range."""
    net = ipaddress.ip_network(cidr)
    digits = net.max_prefixlen // 4
    low, high = (f"{int(a):0{digits}x}" for a in (net.network_address, net.broadcast_address))
    whole, rest = divmod(net.prefixlen, 4)
    if not rest:
        return low[:whole]
    span = range(int(low[whole], 16), int(high[whole], 16) + 1)
    return low[:whole] + "[" + "".join(f"{v:x}" for v in span) + "]"


def _beginnings(cidr: str) -> list[str]:
    """Texts one of which begins every dotted form in an IPv4 range, and no text outside it.

    None for ranges that end in the last octet, hold an exception or would need more than 16 texts.
    """
    net = ipaddress.IPv4Network(cidr)
    fixed, rest = divmod(net.prefixlen, 8)
    if net.prefixlen > 24 or 0 < rest < 4 or any(ipaddress.IPv4Network(e).subnet_of(net) for e in V4_EXCEPTIONS):
        return []
    nets = net.subnets(new_prefix=8 * (fixed + 1)) if rest else [net]
    return ["".join(f"{octet}." for octet in part.network_address.packed[: fixed + (rest > 0)]) for part in nets]


def _any(form, cidrs) -> str:
    return "(?:" + "|".join(form(c) for c in cidrs) + ")"


_V4_GLOBAL = rf"^(?!(?!{_any(_dotted, V4_EXCEPTIONS)}){_any(_dotted, V4_PRIVATE + V4_SHARED)}){_QUAD}$"
# An IPv4 address mapped into IPv6 follows the IPv4 list (without the shared space). Its last 32 bits
# are tested in the form they are written in: eight digits, or a dotted tail kept after the digits.
_MAPPED = "0{20}ffff"
_MAPPED_NOT_GLOBAL = (
    f"(?:(?!{_any(_hex, V4_EXCEPTIONS)}){_any(_hex, V4_PRIVATE)}[0-9a-f]*$"
    rf"|.{{8}}\.(?!{_any(_dotted, V4_EXCEPTIONS)}){_any(_dotted, V4_PRIVATE)})"
)
_V6_FORM = rf"[0-9a-f]{{32}}(?:\.{_QUAD})?"
_V6_GLOBAL = (
    f"^(?!{_MAPPED}{_MAPPED_NOT_GLOBAL})"
    f"(?!(?!{_MAPPED})(?!{_any(_hex, V6_EXCEPTIONS)}){_any(_hex, V6_PRIVATE)}){_V6_FORM}$"
)
# Most addresses of a log are internal: their first characters settle that before any pattern is tried.
_V4_INTERNAL: dict[int, list[str]] = {}
for _text in sorted((b for cidr in V4_PRIVATE for b in _beginnings(cidr)), key=len):
    _V4_INTERNAL.setdefault(len(_text), []).append(_text)
# Ranges told by a first group of four digits; without exceptions, so text beginning so is not global or no address.
_V6_INTERNAL = f"^(?={_any(_hex, [c for c in V6_PRIVATE if c[0] != '0' and ipaddress.ip_network(c).prefixlen <= 16])})[0-9a-f]{{4}}:"


def _begins_internal(ip: Column) -> Column:
    begins = F.lit(False)
    for length, texts in _V4_INTERNAL.items():
        begins = begins | (ip.startswith(texts[0]) if len(texts) == 1 else F.substring(ip, 1, length).isin(texts))
    return begins


def is_ipv6(ip: Column) -> Column:
    return ip.contains(":")


def is_ipv4(ip: Column) -> Column:
    return ip.rlike(f"^{_QUAD}$")


def ipv6_digits(ip: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address.

    An address with a dotted tail gets zeros in its place and the tail after a further dot. Text that is
    no address gives some other text.
    """
    # Give "::" a group on both sides; then it stands for 8 - (number of colons) zero groups.
    inner = F.regexp_replace(F.regexp_replace(F.lower(ip), "^::", "0::"), "::(?=$|%)", "::0")
    inner = F.regexp_replace(inner, "%.*$", "")
    inner = F.regexp_replace(inner, rf"(?<=:)({_QUAD})$", "0:0.$1")
    missing = F.lit(8) - F.length(F.regexp_replace(inner, "[^:]", ""))
    groups = F.replace(inner, F.lit("::"), F.concat(F.lit(":"), F.repeat(F.lit("0:"), missing)))
    padded = F.regexp_replace(groups, "(^|:)", "$1000")
    return F.regexp_replace(padded, "(?:^|:)[0-9a-f]{0,3}([0-9a-f]{4})(?=[:.]|$)", "$1")


def is_ipv6_digits(digits: Column) -> Column:
    """Whether ``ipv6_digits`` found an address."""
    return digits.rlike(f"^{_V6_FORM}$")


def is_public_v4(ip: Column) -> Column:
    return ~_begins_internal(ip) & ip.rlike(_V4_GLOBAL)


def is_public(ip: Column) -> Column:
    """Globally routable? Text that is no address is not."""
    is_public_v6 = ~ip.rlike(_V6_INTERNAL) & ipv6_digits(ip).rlike(_V6_GLOBAL)
    return F.when(is_ipv6(ip), is_public_v6).otherwise(is_public_v4(ip))


def octet(ip: Column, position: int) -> Column:
    """One dotted part (1-4) as an integer; null where the part is absent or not a number."""
    # The split is the same expression for all positions, so Spark runs it once per address.
    return F.get(F.split(ip, r"\."), F.lit(position - 1)).try_cast("int")
