from pyspark.sql import functions as F

from sitelens.functions import urls as U

X = F.col("x")


def test_normalize(evaluate):
    cases = {
        "https://Example.COM": "https://example.com/",
        "HTTP://EXAMPLE.com/A?b=C#d": "http://example.com/A?b=C#d",
        "example.com/x": "http://example.com/x",
        "  example.com\n": "http://example.com/",
        "http://h.example:443/": "http://h.example:443/",
        "http://h.example:80": "http://h.example/",
        "https://h.example:443/a": "https://h.example/a",
        "http://h.example:0/": "http://h.example/",
        "http://h.example:": "http://h.example/",
        "http://h.example/?0#0": "http://h.example/",
        "http://u:p@h.example/": "http://h.example/",
        "http://h.example./": "http://h.example./",
        "http://h.example:8080/": None,
        "http://h.example:99999/": None,
        "http://h.example:x/": None,
        "ftp://h.example/": None,
        "mailto:a@b": "http://b/",  # read as user and password of host b
        "http://-bad.example/": None,
        "http://a_b.example/": None,
        "http://" + "a" * 64 + ".example/": None,
        "http://" + "a" * 63 + ".example/": "http://" + "a" * 63 + ".example/",
        "http://": None,
        "http:///path": None,
        "": None,
    }
    assert dict(zip(cases, evaluate(list(cases), U.normalize_url(X)))) == cases


def test_errors(evaluate):
    cases = {
        None: ["URL is required"],
        "0": ["URL is required"],
        "https://example.com": [],
        "http://127.0.0.1/": ["Localhost and IP addresses are not allowed"],
        "localhost": ["Localhost and IP addresses are not allowed"],
        "http://10.0.0.256/": [],
        "ftp://x.example/": ["Invalid URL format: Only HTTP and HTTPS schemes are allowed"],
        "http://x.example:81/": ["Invalid URL format: Port 81 is not allowed"],
        "http://x.example/" + "a" * 2040: ["URL is too long (maximum 2048 characters)"],
        "  ": ["Invalid URL format: Invalid URL format"],
    }
    assert evaluate(list(cases), U.url_errors(X)) == list(cases.values())


def test_cache_key_is_that_of_the_normalised_url(evaluate):
    a, b, bad = evaluate(["HTTP://Example.com", "example.com/", "ftp://x"], U.cache_key(X))
    assert a == b and len(a) == 40 and bad is None
    assert evaluate([a, a.upper(), None, "x"], U.is_cache_key(X)) == [True, False, False, False]


def test_domain(evaluate):
    cases = {
        "http://A.example:80/x": "A.example", "//cdn.example/y": "cdn.example", "/x": "",
        "mailto:a@b": "", "https://u@h.example?x": "h.example", "http://[::1]/": "[::1]",
    }
    assert dict(zip(cases, evaluate(list(cases), U.domain(X)))) == cases


def test_resolve(evaluate):
    def against(base, cases):
        got = evaluate(list(cases), U.resolve_url(F.lit(base), X))
        assert dict(zip(cases, got)) == cases

    against(
        "https://h.example:8443/a/b.html?q#f",
        {
            "http://x.example/": "http://x.example/",
            "//c.example/y": "https://c.example/y",
            "/root": "https://h.example:8443/root",
            "x": "https://h.example:8443/a/x",
            "#top": "https://h.example:8443/a/#top",
            "?q=1": "https://h.example:8443/a/?q=1",
            "../x": "https://h.example:8443/a/../x",
            "mailto:a@b": "https://h.example:8443/a/mailto:a@b",
            "HTTP://x": "https://h.example:8443/a/HTTP://x",
            "0": "0",
            "": "",
            None: None,
        },
    )
    against("https://h.example/a/b/", {"x": "https://h.example/a/x"})
    against("https://h.example", {"x": "https://h.example/x"})
    against("https://h.example/", {"x": "https://h.example/x"})
