import ipaddress
import random

from pyspark.sql import functions as F

from sitelens.functions import network as N

X = F.col("x")


def test_ranges_against_the_standard_library(evaluate):
    rng = random.Random(3)
    ranges = ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "198.51.100.7/32", "100.64.0.0/10",
              "fc00::/7", "2001:db8::/32", "fe80::/10", "::/127", "2001:10::/28"]
    ips = [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(300)]
    ips += [f"172.{a}.0.1" for a in range(14, 34)] + [f"100.{a}.255.255" for a in range(60, 130)]
    v6 = [ipaddress.IPv6Address(rng.getrandbits(128)) for _ in range(100)]
    v6 += [ipaddress.IPv6Address(rng.choice([0xFC, 0xFD, 0xFE]) << 120 | rng.getrandbits(112)) for _ in range(60)]
    v6 += [ipaddress.IPv6Address(a) for a in ("::", "::1", "::2", "2001:db8::1", "2001:1f::9", "2001:20::", "fe80::1")]
    ips += [str(a) for a in v6] + [a.exploded.upper() for a in v6]

    def expected(ip):
        a = ipaddress.ip_address(ip)
        for r in ranges:
            net = ipaddress.ip_network(r)
            bits = net.prefixlen
            # An IPv6 address is also held against the leading bits of IPv4 subnets.
            if a.version == 4 and net.version == 4 and a in net:
                return r
            if a.version == 6 and int.from_bytes(a.packed, "big") >> (128 - bits) == (
                int(net.network_address) >> ((32 if net.version == 4 else 128) - bits)
            ):
                return r
        return None

    assert evaluate(ips, N.matching_range(X, ranges)) == [expected(ip) for ip in ips]


def test_odd_addresses(evaluate):
    bad = ["", "10.0.0", "10.0.0.256", "010.0.0.1", "1.2.3.4.5", "x", ":::", "1::2::3", "12345::",
           "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "::1.2.3.400", None]
    assert evaluate(bad, N.is_ip(X)) == [False] * len(bad)
    mapped = evaluate(["::ffff:10.0.0.1", "1:2:3:4:5:6:7:8", "::"], N.ipv6_hex(X))
    assert mapped == ["00000000000000000000ffff0a000001", "00010002000300040005000600070008", "0" * 32]
    assert evaluate(["10.0.0.1", "10.0.0.2"], N.in_ranges(X, ["10.0.0.1"])) == [True, False]
    assert evaluate(["10.0.0.1"], N.in_ranges(X, [])) == [False]
    assert evaluate(["1.2.3.4", "fc00::1"], N.in_ranges(X, ["0.0.0.0/0"])) == [True, True]


def test_public(evaluate):
    cases = {
        "8.8.8.8": True, "10.1.2.3": False, "127.0.0.1": False, "0.1.2.3": False,
        "169.254.1.1": False, "240.0.0.1": False, "100.64.0.1": True, "2a00::1": True,
        "fd00::1": False, "::1": False, "fe80::1": False, "2001:db8::1": False, "text": False,
    }
    assert dict(zip(cases, evaluate(list(cases), N.is_public(X)))) == cases


def test_client_ip(evaluate):
    headers = [
        {"HTTP_X_FORWARDED_FOR": " 8.8.8.8 , 10.0.0.1", "REMOTE_ADDR": "10.0.0.9"},
        {"HTTP_CF_CONNECTING_IP": "10.0.0.1", "HTTP_CLIENT_IP": "9.9.9.9"},
        {"HTTP_FORWARDED": "junk", "REMOTE_ADDR": "192.168.1.1"},
        {},
        {"REMOTE_ADDR": "1.1.1.1", "HTTP_FORWARDED_FOR": ""},
    ]
    assert evaluate(headers, N.client_ip(X), "map<string,string>") == [
        "8.8.8.8", "9.9.9.9", "192.168.1.1", "127.0.0.1", "1.1.1.1",
    ]
