from pyspark.sql import functions as F

from sitelens.functions import values as V

X = F.col("x")


def test_blank_and_trim(evaluate):
    assert evaluate([None, "", "0", " ", "00", "a"], V.is_blank(X)) == [
        True, True, True, False, False, False,
    ]
    assert evaluate([" \t\n\r\x00\x0ba b\x0b ", " a"], V.trim(X)) == ["a b", " a"]


def test_truncate_counts_characters(evaluate):
    assert evaluate(["é" * 5, "é" * 6, None], V.truncate(X, 5)) == ["é" * 5, "é" * 5 + "...", None]


def test_sizes_and_durations(evaluate):
    sizes = [0, 1024, 1025, 1536, 1048576, 1048577, 5 * 1024**4, 3 * 1024**5]
    assert evaluate(sizes, V.format_bytes(X), "long") == [
        "0 B", "1024 B", "1 KB", "1.5 KB", "1024 KB", "1 MB", "5 TB", "3072 TB",
    ]
    assert evaluate([0, 999, 1000, 8325, 59_999, 60_000, 90_000], V.format_duration(X), "long") == [
        "0ms", "999ms", "1s", "8.33s", "60s", "1m", "1.5m",
    ]
    assert evaluate([0, 59, 60, 3599, 3600], V.countdown_text(X), "long") == [
        "0s", "59s", "1m 0s", "59m 59s", "1h 0m",
    ]
