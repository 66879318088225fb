"""Addresses against a table of ranges, compared with the ipaddress module."""

import ipaddress
import random

from pyspark.sql import functions as F

from sitelens.operators import ranges as N


def expected(ip, nets):
    try:
        address = ipaddress.ip_address(ip)
    except ValueError:
        return None
    held = [(n.prefixlen, text) for n, text in nets if n.version == address.version and address in n]
    return min((t for b, t in held if b == max(held)[0])) if held else None


def test_longest_prefix(spark):
    rng = random.Random(4)
    texts = ["0.0.0.0/0", "::/0", "10.0.0.0/8", "10.1.2.3/16", "10.1.0.0/16", "9.9.9.9", "2001:db8::/33", "::ffff:1.2.3.4/112", "fe80::1"]
    for _ in range(400):
        bits = rng.randint(1, 32)
        texts.append(f"{rng.choice([10, 11, 192])}.{rng.randrange(4)}.{rng.randrange(256)}.{rng.randrange(256)}/{bits}")
        texts.append(f"2001:db8:{rng.randrange(4):x}:{rng.randrange(65536):x}::/{rng.randint(20, 128)}")
    nets = [(ipaddress.ip_network(t, strict=False), t) for t in texts]
    bad = ["", None, "x/8", "1.2.3.4/33", "1.2.3.4/", "1.2.3.4/8/9", "1.2.3/8", "::1/129", "1.2.3.4/-1"]
    ips = [f"{rng.choice([10, 11, 192, 200])}.{rng.randrange(4)}.{rng.randrange(256)}.{rng.randrange(256)}" for _ in range(300)]
    ips += [f"2001:db8:{rng.randrange(5):x}:{rng.randrange(65536):x}::{rng.randrange(9):x}" for _ in range(300)]
    ips += ["9.9.9.9", "fe80::1", "::ffff:1.2.3.9", None, "", "nonsense", "256.1.1.1"] + ["10.1.2.3"] * 50
    rows = spark.createDataFrame(list(enumerate(ips)), "id int, ip_address string").withColumn("a.b", F.lit(1)).withColumn("prefix", F.lit("p"))
    table = spark.createDataFrame([(t,) for t in texts + bad], "cidr string")
    for keep in (texts + bad, texts[2:3], []):
        some = [n for n in nets if n[1] in keep]
        got = N.longest_ranges(rows, table.filter(F.col("cidr").isin(keep)) if keep else table.limit(0)).collect()
        assert len(got) == len(ips)
        for r in got:
            assert r.range == expected(r.ip_address or "", some), r
    flagged = N.whitelisted(rows, table.filter("cidr = '10.0.0.0/8'")).collect()
    assert {r.id for r in flagged if r.whitelisted} == {i for i, ip in enumerate(ips) if (ip or "").startswith("10.")}


def test_many_ranges_are_an_equality_join(spark):
    table = spark.range(100_000).select(
        F.concat_ws(".", (F.col("id") % 200 + 1).cast("string"), (F.floor(F.col("id") / 200) % 256).cast("string"),
                    (F.col("id") % 256).cast("string"), F.lit("0")).alias("net"),
        (F.lit(12) + F.col("id") % 13).cast("string").alias("n"),
    ).select(F.concat("net", F.lit("/"), "n").alias("cidr"))
    rows = spark.range(20_000).select("id", F.concat((F.col("id") % 220).cast("string"), F.lit(".7."), (F.col("id") % 256).cast("string"), F.lit(".9")).alias("ip_address"))
    found = N.longest_ranges(rows, table)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
    got = found.filter("range IS NOT NULL").collect()
    assert got
    for r in got[::500]:
        assert ipaddress.ip_address(r.ip_address) in ipaddress.ip_network(r.range, strict=False)
