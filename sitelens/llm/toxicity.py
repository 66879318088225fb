"""Toxicity score: gradient-boosted trees over dense features, calibrated.

A lexicon of words and word beginnings that mark toxic texts is learned from the
labelled sample, so it is not tied to a language.  Trees over densities of lexicon
words, second-person words near them, capitals, punctuation and obfuscation are
fitted on features made with lexicons of the other folds, and isotonic regression on
sums of trees of the other folds maps a sum to a probability.
"""

import re
import string
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import UPPER, arrow_schema, filter_texts, ids_and_texts, one_text_each, record_batch, sampled_labels, slices

#: Labelled texts used for learning, for each label.
SAMPLE_PER_LABEL = 4000
LEXICON = 400
MIN_SUPPORT = 4
MIN_ODDS = 8.0
#: Logarithm of the chance that a term's documents are toxic by accident.
MIN_EVIDENCE = 9.0
FOLDS = 4
STEMS = range(3, 8)
NEAR = 3
TREES, DEPTH, RATE, BINS = 60, 3, 0.2, 32
MIN_LEAF, MIN_GAIN = 8, 1.0
#: Words a reader remembers; longer ones than ``MEMO_CHARS`` are read afresh each time.
MEMO_WORDS = 1 << 19
MEMO_CHARS = 64
SCHEMA = "doc_id bigint, score double"
FEATURES = (
    "lexicon_density", "lexicon_count", "lexicon_words", "second_person", "second_person_near",
    "capitals", "shouted_words", "punctuation", "exclamations", "obfuscated", "stretched", "log_words",
)
#: Words that address the reader, in a few languages.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch"
    " ti tus usted ustedes vosotros".split()
)
#: Characters that stand for letters in disguised words.
LOOKALIKES = str.maketrans("013457@$!", "oieastasi")
PUNCTUATION = string.punctuation + "«»„“”‘’…–—¡¿"
DISGUISED = re.compile(r"[^\W\d_][\d@$!*#._-]+[^\W\d_]")
STRETCHED = re.compile(r"(\w)\1\1")
CAPITALS = UPPER.encode()
MARKS = string.punctuation.encode()


def terms(word: str) -> list[str]:
    """What the lexicon may hold of a word: the word, and its beginnings marked with a star."""
    return [word] + [word[:n] + "*" for n in STEMS if len(word) >= n]


def plain(word: str) -> str:
    return word.strip(PUNCTUATION).lower()


class Reader:
    """Dense features of texts for a lexicon, with a memory for words.

    Most words say nothing; they are only remembered as such.
    """

    def __init__(self, lexicon: frozenset[str]):
        self.lexicon = lexicon
        self.telling: dict[str, tuple[bool, bool, bool, bool, bool]] = {}
        self.dull: set[str] = set()

    def _read(self, raw: str) -> tuple[bool, bool, bool, bool, bool]:
        """Marked, second person, shouted, disguised, stretched."""
        word = plain(raw)
        marked = not self.lexicon.isdisjoint(terms(word))
        disguised = not word.isalpha() and bool(DISGUISED.search(raw))
        if disguised and not marked:
            bare = re.sub(r"[\W\d_]", "", word.translate(LOOKALIKES))
            marked = not self.lexicon.isdisjoint(terms(bare))
        shouted = len(word) > 2 and raw.isupper()
        return marked, word in SECOND_PERSON, shouted, disguised, bool(STRETCHED.search(word))

    def _learn(self, words: set[str]) -> dict[str, tuple]:
        """Readings of the telling words among ``words``."""
        if len(self.dull) + len(self.telling) > MEMO_WORDS:
            self.dull.clear()
            self.telling.clear()
        once = {}
        for raw in words.difference(self.dull, self.telling):
            found = self._read(raw)
            if len(raw) > MEMO_CHARS:
                once[raw] = found
            elif any(found):
                self.telling[raw] = found
            else:
                self.dull.add(raw)
        return {w: self.telling.get(w) or once[w] for w in words.intersection(self.telling) | once.keys()}

    def features(self, text: str) -> list[float]:
        words = text.split()
        n = max(len(words), 1)
        telling = self._learn(set(words))
        read = [(i, telling[w]) for i, w in enumerate(words) if w in telling] if telling else []
        marked, second, shouted, disguised, stretched = ([i for i, r in read if r[k]] for k in range(5))
        you = set(second)
        near = sum(any(j in you for j in range(i - NEAR, i + NEAR + 1)) for i in marked)
        data = text.encode()
        size = max(len(data), 1)
        return [
            len(marked) / n, min(len(marked), 20), min(len({plain(words[i]) for i in marked}), 10),
            len(second) / n, near / n, (len(data) - len(data.translate(None, CAPITALS))) / size, len(shouted) / n,
            (len(data) - len(data.translate(None, MARKS))) / size, text.count("!") / n,
            len(disguised) / n, len(stretched) / n, float(np.log1p(len(words))),
        ]


@dataclass
class Trees:
    """Boosted trees of fixed depth: at each level of a tree, one feature and threshold for each node."""

    features: np.ndarray
    thresholds: np.ndarray
    values: np.ndarray
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.features, self.thresholds, self.values):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic gradient boosting on histograms of ``BINS`` quantiles of each feature."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    # Values above zero matter even where almost every value is zero.
    edges = [np.unique(np.concatenate([e, np.quantile(c[c > 0], np.linspace(0, 1, 8)[:-1]) - 1e-9])) if (c > 0).any() else e for e, c in zip(edges, x.T)]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    n_bins = max(len(e) for e in edges) + 1
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    raw = np.full(len(y), base)
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    all_f, all_t, all_v = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p) + 1e-6
        f, t = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), dtype=np.int64)
        for depth in range(DEPTH):
            for k in range(2**depth - 1, 2 ** (depth + 1) - 1):
                mine = node == k
                best = MIN_GAIN
                if mine.sum() >= 2 * MIN_LEAF:
                    gm, hm, bm = g[mine], h[mine], binned[mine]
                    whole = gm.sum() ** 2 / (hm.sum() + 1)
                    for j, e in enumerate(edges):
                        gl = np.cumsum(np.bincount(bm[:, j], gm, n_bins))[: len(e)]
                        hl = np.cumsum(np.bincount(bm[:, j], hm, n_bins))[: len(e)]
                        rows = np.cumsum(np.bincount(bm[:, j], minlength=n_bins))[: len(e)]
                        gain = gl**2 / (hl + 1) + (gm.sum() - gl) ** 2 / (hm.sum() - hl + 1) - whole
                        gain[(rows < MIN_LEAF) | (len(bm) - rows < MIN_LEAF)] = 0
                        if len(gain) and gain.max() > best:
                            best = gain.max()
                            f[k], t[k] = j, e[int(gain.argmax())]
            node = 2 * node + 1 + (x[np.arange(len(y)), f[node]] > t[node])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + 1)
        raw = raw + value[leaf]
        all_f.append(f), all_t.append(t), all_v.append(value)
    return Trees(np.array(all_f), np.array(all_t), np.array(all_v), base)


@dataclass
class Isotonic:
    """A non-decreasing step function, interpolated between the middles of its blocks."""

    at: np.ndarray
    value: np.ndarray

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.at, self.value)


def isotonic(raw: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators; every block is drawn a little to the mean, so none is 0 or 1."""
    blocks: list[list[float]] = []
    order = np.argsort(raw, kind="stable")
    for r, label in zip(raw[order].tolist(), y[order].tolist()):
        blocks.append([label, 1, r])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, a = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + a]
    value = [(s + 0.5 * y.mean()) / (n + 0.5) for s, n, _ in blocks]
    # Small blocks are drawn more, so what this turned round is levelled again.
    return Isotonic(np.array([a / n for _, n, a in blocks]), np.maximum.accumulate(value))


@dataclass
class Model:
    lexicon: frozenset[str]
    trees: Trees
    calibrated: Isotonic

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.calibrated(self.trees.raw(x)), 0, 1)


COUNT_SCHEMA = "term string, fold int, toxic bigint, clean bigint"
ROW_SCHEMA = "doc_id bigint, label int, fold int, x binary"


def _fold_of(doc_id: int) -> int:
    return zlib.crc32(b"fold %d" % doc_id) % FOLDS


def term_counts(sample: DataFrame, label: dict[int, int]) -> DataFrame:
    """(term, toxic, clean): documents of the sample that hold a term, as arrays with one number for each fold."""
    schema = arrow_schema(COUNT_SCHEMA)

    def run(batches):
        for batch in slices(batches):
            counts: dict[tuple[str, int], list[int]] = {}
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = {plain(w) for w in set((text or "").split())}
                fold = _fold_of(i)
                for term in {t for w in words if len(w) > 2 for t in terms(w)}:
                    counts.setdefault((term, fold), [0, 0])[label[i]] += 1
            yield record_batch([(term, fold, n[1], n[0]) for (term, fold), n in counts.items()], schema)

    def by_fold(column: str) -> Column:
        folds = (F.sum(F.when(F.col("fold") == k, F.col(column)).otherwise(0)) for k in range(FOLDS))
        return F.array(*folds).alias(column)

    return sample.mapInArrow(run, COUNT_SCHEMA).groupBy("term").agg(by_fold("toxic"), by_fold("clean"))


def evidence(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    """How surely a term held by so many toxic and clean documents marks toxic ones; null if it does not.

    It has to be far more frequent, by documents, among toxic texts.  The evidence is the
    Chernoff bound on the chance of so many toxic documents among those with the term.
    """
    share = max(n_toxic, 1) / max(n_toxic + n_clean, 1)
    odds = ((toxic + 0.1) / (n_toxic + 1)) / ((clean + 0.5) / (n_clean + 1))
    n = F.greatest(toxic + clean, F.lit(1))
    rate = F.least(F.greatest(toxic / n, F.lit(1e-9)), F.lit(1 - 1e-9))
    bound = n * (rate * F.log(rate / share) + (1 - rate) * F.log((1 - rate) / max(1 - share, 1e-9)))
    return F.when((toxic >= MIN_SUPPORT) & (odds >= MIN_ODDS) & (rate > share) & (bound >= MIN_EVIDENCE), bound)


def pick_lexicons(sample: DataFrame, label: dict[int, int]) -> list[frozenset[str]]:
    """A lexicon without each fold, then that of all folds: the ``LEXICON`` terms of most evidence, ties by term.

    Every term of the sample is judged; at most ``LEXICON`` rows for each lexicon reach the driver.
    """
    totals = np.zeros((2, FOLDS), dtype=int)
    for row in sample.select("doc_id").collect():
        totals[label[row["doc_id"]], _fold_of(row["doc_id"])] += 1

    def judged(without: int) -> Column:
        used = [k for k in range(FOLDS) if k != without]
        toxic, clean = (sum((F.col(c)[k] for k in used), F.lit(0)) for c in ("toxic", "clean"))
        found = evidence(toxic, clean, int(totals[1, used].sum()), int(totals[0, used].sum()))
        return F.struct(F.lit(without).alias("lexicon"), found.alias("evidence"))

    candidates = (
        term_counts(sample, label)
        .select("term", F.explode(F.array(*(judged(k) for k in range(FOLDS + 1)))).alias("j"))
        .select("term", "j.*")
        .filter("evidence IS NOT NULL")
    )
    # Spark keeps the first rows of each lexicon in every task before the few that are left meet.
    best = Window.partitionBy("lexicon").orderBy(F.desc("evidence"), "term")
    out: list[set[str]] = [set() for _ in range(FOLDS + 1)]
    for row in candidates.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= LEXICON).collect():
        out[row["lexicon"]].add(row["term"])
    return [frozenset(x) for x in out]


def learn(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> Model | None:
    """A model from ``docs`` and ``labels`` (doc_id, label), at most ``per_label`` whole texts of each label.

    ``sampled_labels`` says which rows teach; a hash of the id puts each in a fold.  Of rows
    that share an id one text teaches (``one_text_each``).
    With fewer than ``MIN_LEAF`` rows of either label there is no model.
    """
    wanted = sampled_labels(labels, per_label)
    if not wanted:
        return None
    sample = one_text_each(docs, sorted(wanted))
    *lexicons, lexicon = pick_lexicons(sample, wanted)
    schema = arrow_schema(ROW_SCHEMA)

    def run(batches):
        readers = [Reader(lexicon) for lexicon in lexicons]
        for batch in slices(batches):
            out = []
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                k = _fold_of(i)
                out.append((i, wanted[i], k, np.array(readers[k].features(text or "")).tobytes()))
            yield record_batch(out, schema)

    found = sorted((r[0], r[1], r[2], bytes(r[3])) for r in sample.mapInArrow(run, ROW_SCHEMA).collect())
    x = np.array([np.frombuffer(r[3]) for r in found]).reshape(len(found), len(FEATURES))
    y, fold = np.array([r[1] for r in found], dtype=float), np.array([r[2] for r in found])
    if min((y == 1).sum(), (y == 0).sum()) < MIN_LEAF:
        return None
    raw = np.zeros(len(y))
    for k in range(FOLDS):
        mine = fold == k
        if mine.any():
            raw[mine] = boost(x[~mine], y[~mine]).raw(x[mine])
    return Model(lexicon, boost(x, y), isotonic(raw, y))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1, higher for toxic) of every row of ``docs``.

    A null or empty text has features of zero and gets the score of those; without a
    model every score is 0.  Texts are read whole, and words of any length count.  Null ids and repeated rows give a result each; only the
    text is looked at.
    """
    schema = arrow_schema(SCHEMA)

    def run(batches):
        reader = Reader(model.lexicon) if model else None
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            if model:
                found = model.score(np.array([reader.features(t or "") for t in texts]))
            else:
                found = np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], schema=schema)

    return ids_and_texts(docs).mapInArrow(run, SCHEMA)


def keep_clean(docs: DataFrame, model: Model | None, toxic_from: float) -> DataFrame:
    """Rows of ``docs``, with all columns, that score below ``toxic_from``; all of them without a model."""
    if model is None:
        return docs

    def judge():
        reader = Reader(model.lexicon)
        return lambda texts: (model.score(np.array([reader.features(t) for t in texts])) < toxic_from).tolist()

    return filter_texts(docs, judge)
