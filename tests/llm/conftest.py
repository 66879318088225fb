import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

#: Rows every operator has to bear: null id, null text, empty, blank, no letters, repeated row.
ODD = [
    (None, "text of a row without an id, which is long enough to be a line of its own"),
    (900, None),
    (901, ""),
    (902, " \t\n\x0b\f\r "),
    (903, "1234 !!! ???"),
    (904, "the same row twice is one document here"),
    (904, "the same row twice is one document here"),
    (905, "x" * 300_000),
]
#: Names that operators use inside.
CLASHING = "key string, id int, h string, fp string, found string, hashes string, row string, at string, n int, part string, _kept int, `a.b` string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) rows, with columns whose names clash with inner ones."""

    def make(rows):
        more = (c.split() for c in CLASHING.split(", "))
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        return df.selectExpr("*", "'en' AS lang", "'s' AS source", *(f"CAST('1' AS {kind}) AS {name}" for name, kind in more))

    return make


@pytest.fixture(scope="session")
def prose():
    """Deterministic text of ``n`` words from a small vocabulary."""
    import random

    def make(seed, n, words=400):
        rng = random.Random(seed)
        vocabulary = ["".join(rng.choice("aeioulnrstdm") for _ in range(rng.randint(2, 9))) for _ in range(words)]
        out = []
        for i in range(n):
            out.append(rng.choice(vocabulary) + (".\n" if i % 17 == 16 else " "))
        return "".join(out).strip()

    return make
