"""Quality score from supervised subword embeddings.

A document is the average of learned vectors: one for each word, each pair of
neighbouring words and each character n-gram of a word, all hashed into one table.  A
softmax layer on the average gives the probability of the label.  Table and layer are
learned together by stochastic gradient descent in numpy.  A pair of equal words
shares one vector, whatever the word, so that repetition can be learned.
"""

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_schema, ids_and_texts, one_text_each, record_batch, sampled_labels, slices

BUCKETS = 1 << 15
DIM = 8
#: Lengths of the n-grams in characters (code points); a space marks both ends of a word.
NGRAMS = (2, 3, 4)
#: Labelled texts used for learning, for each label.
SAMPLE_PER_LABEL = 1500
EPOCHS = 12
RATE = 0.5
SEED = 11
SAME = 0
#: Chains the parts of a pair or n-gram.
PRIME = np.uint64(0x100000001B3)
#: Words hashed at once.
STRETCH = 1 << 16
SCHEMA = "doc_id bigint, score double"


def _buckets(hashes: np.ndarray, kind: int) -> np.ndarray:
    mixed = (hashes.astype(np.uint64) + np.uint64(kind << 48)) * np.uint64(0x9E3779B97F4A7C15)
    return 1 + ((mixed >> np.uint64(32)) % np.uint64(BUCKETS - 1)).astype(np.int64)


def _word_counts(words: list[bytes], following: list[bytes]) -> np.ndarray:
    """Bucket counts of words, their n-grams and the pairs they begin."""
    hashes = np.fromiter(map(zlib.crc32, words + following), np.uint64, len(words) + len(following))
    ids = [_buckets(hashes[: len(words)], 1)]
    if len(hashes) > 1:
        a, b = hashes[:-1], hashes[1:]
        ids.append(np.where(a == b, SAME, _buckets(a * PRIME ^ b, 2)))
    text = np.frombuffer((b" " + b" ".join(words) + b" ").decode().encode("utf-32-le"), np.uint32).astype(np.uint64)
    inner, grams = text != 32, text
    for n in range(2, max(NGRAMS) + 1):
        grams = grams[:-1] * PRIME + text[n - 1 :]
        if n in NGRAMS:
            # No space but at the ends: an n-gram does not reach into the next word.
            whole = np.ones(len(grams), dtype=bool)
            for i in range(1, n - 1):
                whole &= inner[i : i + len(grams)]
            ids.append(_buckets(grams[whole], n + 1))
    return np.bincount(np.concatenate(ids), minlength=BUCKETS)


def bag(text: str) -> np.ndarray:
    """Bucket counts of a whole text."""
    words = text.encode().split()
    total = np.zeros(BUCKETS)
    with np.errstate(over="ignore"):
        for at in range(0, len(words), STRETCH):
            total += _word_counts(words[at : at + STRETCH], words[at + STRETCH : at + STRETCH + 1])
    return total


@dataclass
class Model:
    table: np.ndarray
    layer: np.ndarray
    bias: np.ndarray

    def scorer(self):
        """Score of a bag; the layer is linear, so every vector is reduced to its share of the logit."""
        share = self.table @ (self.layer[:, 1] - self.layer[:, 0])
        bias = self.bias[1] - self.bias[0]

        def score(counts: np.ndarray) -> float:
            logit = counts @ share / max(counts.sum(), 1) + bias
            return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))

        return score


def fit(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> Model:
    """``bags``: (buckets, counts) of each text; ``y``: 0 or 1."""
    rng = np.random.default_rng(SEED)
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    layer, bias = rng.normal(0, 0.5, (DIM, 2)), np.zeros(2)
    shares = [c / max(c.sum(), 1) for _, c in bags]
    n, total = 0, EPOCHS * len(bags)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            rate = RATE * (1 - n / total)
            n += 1
            used, share = bags[i][0], shares[i]
            hidden = share @ table[used]
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = layer @ p
            layer -= rate * np.outer(hidden, p)
            bias -= rate * 0.1 * p
            # The average spreads the gradient over the text; scaled so that rare vectors move too.
            table[used] -= rate * 10 * share[:, None] * back
    return Model(table.astype(np.float32), layer.astype(np.float32), bias.astype(np.float32))


BAGS_SCHEMA = "doc_id bigint, label int, buckets binary, counts binary"


def learn(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> Model | None:
    """A model from ``docs`` and ``labels`` (doc_id, label), at most ``per_label`` whole texts of each label.

    ``sampled_labels`` says which ids teach, each with one text, however often it is repeated;
    without rows of both labels there is no model.
    """
    wanted = sampled_labels(labels, per_label)
    if not wanted:
        return None
    schema = arrow_schema(BAGS_SCHEMA)

    def run(batches):
        for batch in slices(batches):
            out = []
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                counts = bag(text or "")
                used = np.flatnonzero(counts)
                out.append((i, wanted[i], used.astype(np.uint16).tobytes(), counts[used].astype(np.float32).tobytes()))
            if out:
                yield record_batch(out, schema)

    sample = one_text_each(docs, sorted(wanted)).mapInArrow(run, BAGS_SCHEMA)
    found = sorted((r[0], r[1], bytes(r[2]), bytes(r[3])) for r in sample.collect())
    y = np.array([r[1] for r in found])
    if len(set(y.tolist())) < 2:
        return None
    bags = [(np.frombuffer(r[2], np.uint16).astype(np.int64), np.frombuffer(r[3], np.float32).astype(float)) for r in found]
    return fit(bags, y)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1, higher for label 1) of every row of ``docs``.

    A null or empty text has an average of zero and so the score of the bias alone; without a
    model every score is 0.5.  Null ids and repeated rows give a result each; only
    the text is looked at.
    """
    schema = arrow_schema(SCHEMA)

    def run(batches):
        scorer = model.scorer() if model else None
        for batch in slices(batches):
            found = [scorer(bag(t or "")) if scorer else 0.5 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], schema=schema)

    return ids_and_texts(docs).mapInArrow(run, SCHEMA)
