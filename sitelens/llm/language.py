"""Language identification with error-correcting output codes.

Every language has a codeword of bits.  One binary classifier per bit, a logistic
regression on hashed character 1- to 3-grams, predicts that bit; decoding adds up the
logistic loss of all bits, each weighted by how well its classifier does on rows kept
aside, and takes the nearest codeword.  A small lead over the second is flagged.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import arrow_schema, ids_and_texts, record_batch, slices

FEATURES = 1 << 13
#: Texts used for learning, for each language.
SAMPLE_PER_LANGUAGE = 600
#: Bounds of what reaches the driver: languages that are learned, and texts of all together.
MAX_LANGUAGES = 512
SAMPLE_TEXTS = 6000
MAX_BITS = 15
STEPS = 150
AMBIGUOUS = 0.2
SEED = 7
SCHEMA = "doc_id bigint, lang_pred string, score double, ambiguous boolean"
UNKNOWN = "und"
CHUNK_CHARS = 1 << 20


def _hashed(codes: np.ndarray) -> list[np.ndarray]:
    """Buckets of the 1-, 2- and 3-grams of lower-cased letters, other runs as one space."""
    a = codes.astype(np.uint64)
    out = [a * np.uint64(0x9E3779B97F4A7C15)]
    b = a[:-1] * np.uint64(0x100000001B3) + a[1:] + np.uint64(1 << 40)
    out.append(b * np.uint64(0xC2B2AE3D27D4EB4F))
    c = (b[:-1] * np.uint64(0x100000001B3) + a[2:]) if len(a) > 2 else b[:0]
    out.append(c * np.uint64(0x165667B19E3779F9))
    return [(x >> np.uint64(64 - 13)).astype(np.int64) for x in out]


def features(text: str) -> np.ndarray | None:
    """Square roots of the n-gram frequencies; None for a text without a letter."""
    counts = np.zeros(FEATURES)
    letters = False
    for at in range(0, len(text), CHUNK_CHARS):
        part = text[at : at + CHUNK_CHARS].lower()
        met = set(part)
        table = {ord(c): " " for c in met if not c.isalpha()}
        letters = letters or len(table) < len(met)
        codes = np.frombuffer((" " + " ".join(part.translate(table).split()) + " ").encode("utf-32-le"), dtype="<u4")
        for buckets in _hashed(codes):
            counts += np.bincount(buckets, minlength=FEATURES)
    if not letters:
        return None
    return np.sqrt(counts / counts.sum()).astype(np.float32)


def codewords(n: int, max_bits: int = MAX_BITS) -> np.ndarray:
    """(n, bits) of -1 and 1: distinct rows, no constant and no equal or opposite columns.

    Few languages get every split of them; many get random splits, chosen greedily so
    that codewords lie far apart.
    """
    if n < 2:
        return np.ones((n, 1))
    if 2 ** (n - 1) - 1 <= max_bits:
        return np.array([[1 if code >> i & 1 else -1 for code in range(1, 2 ** (n - 1))] for i in range(n)])
    bits = max(max_bits, int(np.ceil(6 * np.log2(n))))
    rng, best, far = np.random.default_rng(SEED), None, -1
    for _ in range(200):
        m = rng.choice([-1, 1], size=(n, bits))
        apart = ((m[:, None, :] != m[None, :, :]).sum(axis=2) + bits * np.eye(n, dtype=int)).min()
        if apart > far and (np.abs(m.sum(axis=0)) < n).all():
            best, far = m, apart
    if best is None or far < 1:
        raise ValueError("no code of distinct words was found")
    return best


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (rows, languages) from the weighted losses."""
        margins = x @ self.weights + self.bias
        loss = np.stack([np.logaddexp(0, -margins * code) @ self.trust for code in self.codes], axis=1)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return p / p.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, lang: list[str]) -> Model:
    """``x``: feature rows; a fifth of them only measures how far each bit is trusted."""
    names = sorted(set(lang))
    codes = codewords(len(names)).astype(np.float32)
    y = codes[[names.index(v) for v in lang]]
    aside = np.arange(len(x)) % 5 == 4
    xt, yt = x[~aside], y[~aside]
    mean = xt.mean(axis=0)
    w, b = np.zeros((x.shape[1], codes.shape[1]), np.float32), np.zeros(codes.shape[1], np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        margin = (xt - mean) @ w + b
        g = -yt / (1 + np.exp(np.clip(yt * margin, -30, 30))) / len(xt)
        gw = (xt - mean).T @ g + 1e-5 * w
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        w -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        b -= 2 * g.sum(axis=0)
    b = b - mean @ w
    held_x, held_y = (x[aside], y[aside]) if aside.any() else (xt, yt)
    right = ((held_x @ w + b) * held_y > 0).mean(axis=0)
    trust = np.clip(2 * right - 1, 0.05, 1)
    return Model(names, codes, w, b, trust / trust.sum() * min(len(trust), 4))


FEATURES_SCHEMA = "doc_id bigint, lang string, x binary"


def _smallest_hashes(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows (doc_id, lang) of each language with the smallest hashes of the id.

    Hashes are counted by their order of magnitude, at most 65 counts for a language, so
    only about twice as many rows as are wanted are ranked, however many there are.  The
    counts are broadcast: their number is bounded by that of the languages of the model.
    """
    share = F.xxhash64("doc_id").cast("double") / 2.0**64 + 0.5
    sized = rows.withColumn("size", F.floor(F.log2(F.greatest(share, F.lit(2.0**-64)))))
    counts = sized.groupBy("lang", "size").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("size")) - F.col("n")
    needed = counts.withColumn("before", before).filter(F.col("before") < n).select("lang", "size")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ranked = sized.join(F.broadcast(needed), ["lang", "size"], "left_semi").withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= n).select("doc_id", "lang")


def learn(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model | None:
    """A model from rows (doc_id, text, lang), at most ``per_language`` whole texts of each language.

    Of more than ``MAX_LANGUAGES`` languages the most frequent are learned (ties: by name), and
    ``SAMPLE_TEXTS`` bounds the texts of all together.  Rows with a null language or id, or
    without a letter, teach nothing; without any row there is no model.  The sample is the same
    in every run: it is chosen by a hash of the id.  An id teaches once, whatever rows it has:
    in the first of its languages by name, and with the text of that language that has the smallest hash.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )
    often = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES)
    names = [r["lang"] for r in often.collect()]
    if not names:
        return None
    rows = rows.filter(F.col("lang").isin(names))
    # Chosen by id first: only texts of the sample are shuffled.
    own = rows.groupBy("doc_id").agg(F.min("lang").alias("lang"))
    chosen = _smallest_hashes(own, max(1, min(per_language, SAMPLE_TEXTS // len(names))))
    ids = sorted(r["doc_id"] for r in chosen.select("doc_id").collect())
    schema = arrow_schema(FEATURES_SCHEMA)

    def run(batches):
        for batch in slices(batches):
            out = []
            for i, lang, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lang", "text"))):
                x = features(text or "")
                if x is not None:
                    out.append((i, lang, x.astype(np.float16).tobytes()))
            if out:
                yield record_batch(out, schema)

    first = F.min(F.struct("lang", F.xxhash64("text").alias("hash"), "text")).alias("first")
    texts = rows.filter(F.col("doc_id").isin(ids)).groupBy("doc_id").agg(first)
    sample = texts.select("doc_id", "first.lang", "first.text").mapInArrow(run, FEATURES_SCHEMA)
    found = sorted((tuple(r) for r in sample.collect()), key=lambda r: (r[0], r[1], bytes(r[2])))
    if not found:
        return None
    x = np.stack([np.frombuffer(bytes(r[2]), np.float16).astype(np.float32) for r in found])
    return fit(x, [r[1] for r in found])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` and ``ambiguous`` of every row of ``docs``.

    A null text, a text without a letter, or any text when there is no model, gives
    ``und`` with score 0.  Null ids and repeated rows give a result each.  Only the
    text is looked at; other columns are ignored.
    """
    schema = arrow_schema(SCHEMA)

    def run(batches):
        for batch in slices(batches):
            xs = [features(t or "") if model else None for t in batch.column("text").to_pylist()]
            out = [(UNKNOWN, 0.0, False)] * len(xs)
            rows = [i for i, x in enumerate(xs) if x is not None]
            if rows:
                p = model.scores(np.stack([xs[i] for i in rows]))
                order = np.sort(p, axis=1)
                lead = order[:, -1] - (order[:, -2] if p.shape[1] > 1 else 0)
                for i, row, k, gap in zip(rows, p, p.argmax(axis=1), lead):
                    out[i] = (model.languages[k], float(row[k]), bool(gap < AMBIGUOUS))
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")] + [pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:])],
                schema=schema,
            )

    return ids_and_texts(docs).mapInArrow(run, SCHEMA)
