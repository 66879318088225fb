"""IP addresses and address ranges as columns.

Ranges are short configured lists, so membership is one predicate built from
literals: no join, no shuffle, usable in any filter.
"""

import ipaddress

from pyspark.sql import Column, functions as F

from .urls import IPV4
from .values import is_blank, let

# Ranges that may not be fetched.
BLOCKED_RANGES = ("127.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16")
# Private and reserved ranges a public client address lies outside of.
NON_PUBLIC_RANGES = (
    "10.0.0.0/8",
    "172.16.0.0/12",
    "192.168.0.0/16",
    "0.0.0.0/8",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "240.0.0.0/4",
    "fc00::/7",
    "::/127",
    "5f::/16",
    "fe80::/10",
    "2001:db8::/32",
    "2001:10::/28",
    "3ff3::/16",
)
# Request headers that may carry the client address, best first.
CLIENT_HEADERS = (
    "HTTP_CF_CONNECTING_IP",
    "HTTP_CLIENT_IP",
    "HTTP_X_FORWARDED_FOR",
    "HTTP_X_FORWARDED",
    "HTTP_X_CLUSTER_CLIENT_IP",
    "HTTP_FORWARDED_FOR",
    "HTTP_FORWARDED",
    "REMOTE_ADDR",
)


def ipv4_number(ip: Column) -> Column:
    """Dotted quad as a BIGINT; NULL for anything else."""
    p = F.split(ip, r"\.")
    octets = [F.try_element_at(p, F.lit(i)).try_cast("bigint") for i in range(1, 5)]
    number = octets[0] * (1 << 24) + octets[1] * (1 << 16) + octets[2] * (1 << 8) + octets[3]
    return F.when(ip.rlike(IPV4), number)


def _v4_tail_as_groups(ip: Column) -> Column:
    """``::ffff:1.2.3.4`` as ``::ffff:0102:0304``, all lower case."""

    def joined(v4):
        digits = F.lpad(F.lower(F.hex(ipv4_number(v4))), 8, "0")
        head = F.lower(F.regexp_replace(ip, r"[0-9.]+$", ""))
        groups = F.regexp_replace(digits, "^(.{4})(.{4})$", "$1:$2")
        return F.when(v4 == "", F.lower(ip)).otherwise(F.concat(head, groups))

    return let(F.regexp_extract(ip, r":([0-9]+(?:\.[0-9]+){3})$", 1), joined)


def ipv6_hex(ip: Column) -> Column:
    """IPv6 text as 32 hex digits; NULL when it is not a valid address."""

    def groups(text):
        return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ":"))

    def split(sides):
        return F.struct(
            F.size(sides).alias("sides"),
            groups(F.get(sides, 0)).alias("left"),
            groups(F.coalesce(F.get(sides, 1), F.lit(""))).alias("right"),
        )

    def filled(s):
        known = F.size(s["left"]) + F.size(s["right"])
        gap = F.array_repeat(F.lit("0"), F.greatest(8 - known, F.lit(0)))
        count_ok = F.when(s["sides"] == 2, known <= 7).otherwise(
            (s["sides"] == 1) & (known == 8)
        )
        every = F.when(s["sides"] == 2, F.concat(s["left"], gap, s["right"])).otherwise(s["left"])
        return F.when(count_ok, every)

    def digits(every):
        valid = F.forall(every, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(valid, F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), ""))

    sides = F.split(_v4_tail_as_groups(ip), "::")
    return F.when(ip.contains(":"), let(let(let(sides, split), filled), digits))


def is_ip(c: Column) -> Column:
    return F.coalesce(c.rlike(IPV4), F.lit(False)) | ipv6_hex(c).isNotNull()


def _in_v4_range(n: Column, cidr: str) -> Column | None:
    if "/" not in cidr:
        return n["ip"] == cidr
    subnet, bits = cidr.split("/")
    if ":" in subnet:
        return None
    free = 32 - int(bits)
    low = int(ipaddress.IPv4Address(subnet)) >> free << free
    return n["v4"].between(low, low + (1 << free) - 1)


def _in_v6_range(n: Column, cidr: str) -> Column:
    """An IPv6 address is compared with the leading bits of any subnet."""
    if "/" not in cidr:
        return n["ip"] == cidr
    subnet, bits = cidr.split("/")
    full, rest = divmod(int(bits), 4)
    digits = ipaddress.ip_address(subnet).packed.hex()
    test = n["v6"].startswith(digits[:full])
    if rest:
        low = int(digits[full], 16) >> (4 - rest) << (4 - rest)
        allowed = [f"{d:x}" for d in range(low, low + (1 << (4 - rest)))]
        test = test & F.substring(n["v6"], full + 1, 1).isin(*allowed)
    return test


def _numbers(ip: Column) -> Column:
    return F.struct(ip.alias("ip"), ipv4_number(ip).alias("v4"), ipv6_hex(ip).alias("v6"))


def _first_range(n: Column, ranges) -> Column:
    def first(test):
        tests = [(test(n, r), r) for r in ranges]
        found = [F.when(t, F.lit(r)) for t, r in tests if t is not None]
        return F.coalesce(*found, F.lit(None).cast("string"))

    return F.when(n["v6"].isNull(), first(_in_v4_range)).otherwise(first(_in_v6_range))


def matching_range(ip: Column, ranges) -> Column:
    """The first range that holds ``ip``; NULL when none does."""
    if not ranges:
        return F.lit(None).cast("string")
    return let(_numbers(ip), lambda n: _first_range(n, ranges))


def in_ranges(ip: Column, ranges) -> Column:
    return matching_range(ip, ranges).isNotNull()


def is_blocked(ip: Column, ranges=BLOCKED_RANGES) -> Column:
    return in_ranges(ip, ranges)


def is_public(ip: Column) -> Column:
    return let(
        _numbers(ip),
        lambda n: (n["v4"].isNotNull() | n["v6"].isNotNull())
        & _first_range(n, NON_PUBLIC_RANGES).isNull(),
    )


def client_ip(headers: Column) -> Column:
    """Client address from a map of request headers: the first listed header with a
    public address (the first of a comma list), else REMOTE_ADDR, else 127.0.0.1."""
    values = F.array(*[F.try_element_at(headers, F.lit(name)) for name in CLIENT_HEADERS])
    firsts = F.transform(
        F.filter(values, lambda v: ~is_blank(v)),
        lambda v: F.when(v.contains(","), F.trim(F.get(F.split(v, ","), 0))).otherwise(v),
    )
    return F.coalesce(
        F.get(F.filter(firsts, is_public), 0),
        F.try_element_at(headers, F.lit("REMOTE_ADDR")),
        F.lit("127.0.0.1"),
    )
