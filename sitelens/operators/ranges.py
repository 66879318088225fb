"""Address ranges that are a table: the longest prefix that holds an address.

A range is stored under its family, length and leading bits.  An address is looked up
under each length in use (at most 33 for IPv4 and 129 for IPv6), so the search is an
equality join whatever the number of ranges.  Addresses are reduced to distinct ones first;
the answer per address is joined back so that a frequent address can be split.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.network import ipv4_number, ipv6_hex
from .joins import join_unique


def address_digits(ip: Column) -> Column:
    """An address as hex digits: 8 for IPv4, 32 for IPv6, else NULL."""
    v4 = F.lpad(F.lower(F.hex(ipv4_number(ip))), 8, "0")
    return F.coalesce(v4, ipv6_hex(ip))


def leading_bits(digits: Column, bits: Column) -> Column:
    """The first ``bits`` bits, as hex digits with the rest of the last one cleared."""
    whole, rest = F.floor(bits / 4).cast("int"), bits % 4
    digit = F.conv(F.substring(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
    cleared = digit - digit % F.element_at(F.array(*[F.lit(n) for n in (1, 8, 4, 2)]), rest + 1)
    tail = F.when(rest == 0, "").otherwise(F.lower(F.hex(cleared)))
    return F.concat(F.substring(digits, F.lit(1), whole), tail)


def prefixes(ranges: DataFrame, cidr: str = "cidr") -> DataFrame:
    """``ranges`` with ``family`` (digits of an address), ``bits`` and ``prefix``.

    ``a.b.c.d/n`` and ``x::/n``; without a length the one address.  Bits beyond the length
    are ignored.  Rows that are no range are left out.
    """
    parts = F.split(F.trim(F.col(cidr)), "/")
    digits = address_digits(F.get(parts, 0))
    family = F.length(digits)
    given = F.get(parts, 1)
    bits = F.when(F.size(parts) == 1, family * 4).when(given.rlike(r"^\d{1,3}$"), given.cast("int"))
    known = ranges.withColumns({"_digits": digits, "family": family, "bits": bits})
    known = known.filter("_digits IS NOT NULL AND bits BETWEEN 0 AND family * 4").filter(F.size(parts) <= 2)
    return known.withColumn("prefix", leading_bits(F.col("_digits"), F.col("bits"))).drop("_digits")


def longest_ranges(rows: DataFrame, ranges: DataFrame, ip: str = "ip_address", cidr: str = "cidr") -> DataFrame:
    """``rows`` with ``range``: the longest range that holds the address, or NULL.

    Of ranges with the same bits the smallest text counts.  Rows without a valid address stay,
    with NULL.  Families do not mix.
    """
    stored = prefixes(ranges.select(F.col(cidr).alias("range")), "range")
    stored = stored.groupBy("family", "bits", "prefix").agg(F.min("range").alias("range"))
    # At most 162 rows, whatever the ranges.
    lengths = F.broadcast(stored.groupBy("family").agg(F.collect_set("bits").alias("lengths")))
    addresses = rows.select(F.col(ip).alias("_ip")).distinct().withColumn("_digits", address_digits(F.col("_ip")))
    asked = addresses.filter("_digits IS NOT NULL").withColumn("family", F.length("_digits"))
    asked = asked.join(lengths, "family").withColumn("bits", F.explode("lengths"))
    asked = asked.withColumn("prefix", leading_bits(F.col("_digits"), F.col("bits"))).select("_ip", "family", "bits", "prefix")
    found = asked.join(stored, ["family", "bits", "prefix"]).groupBy("_ip").agg(F.max_by("range", "bits").alias("range"))
    return join_unique(rows.withColumn("_ip", F.col(ip)), found, "_ip", "left").select(*(F.col(f"`{c}`") for c in rows.columns), "range")


def whitelisted(requests: DataFrame, ranges: DataFrame, cidr: str = "cidr") -> DataFrame:
    """``requests`` with ``whitelisted``: whether a range of the table holds the address."""
    found = longest_ranges(requests, ranges, cidr=cidr)
    return found.withColumn("whitelisted", F.col("range").isNotNull()).drop("range")
