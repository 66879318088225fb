"""Learned operators: held-out accuracy on planted tables, odd rows, and their parts."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.llm import language, quality, toxicity
from sitelens.llm.common import fold, in_fold, sampled_labels

from .conftest import ODD

BAD = ["grumble", "snarl", "vexatious"]


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_folds_are_crc32(spark):
    df = spark.createDataFrame([(i,) for i in [0, 7, -3, 10**12, None]], "doc_id bigint")
    for r in df.select("doc_id", fold(5).alias("f"), in_fold(5, 0).alias("held")).collect():
        want = None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 5
        assert (r.f, r.held) == (want, want == 0)


def test_sampled_labels(spark):
    given = [(i, i % 2) for i in range(50)] + [(None, 1), (60, None), (1, 0), (70, 3)]
    df = spark.createDataFrame(given, "doc_id bigint, label int")
    chosen = sampled_labels(df, 10)
    assert len(chosen) == 20 and chosen == sampled_labels(df, 10)
    assert sampled_labels(df, 100) == {i: i % 2 for i in range(50)}


# -- 5 -----------------------------------------------------------------------------

def test_smallest_hashes(spark):
    given = [(i, "ab"[i % 3 == 0]) for i in range(3000)] + [(5000, "rare")]
    df = spark.createDataFrame(given, "doc_id bigint, lang string")
    hashed = df.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).collect()
    for n in (1, 7, 100, 10_000):
        found = {tuple(r) for r in language._smallest_hashes(df, n).collect()}
        want = set()
        for lang in ("a", "b", "rare"):
            mine = sorted((r.h, r.doc_id, lang) for r in hashed if r.lang == lang)
            want |= {(i, name) for _, i, name in mine[:n]}
        assert found == want
    assert language._smallest_hashes(df.limit(0), 5).collect() == []


SYLLABLES = {"aa": "ka to ri mu ne", "bb": "sch ung ein lich keit", "cc": "eau oux tre ment que", "dd": "ción ado osa lla ez"}


def in_language(name, seed, n):
    rng = random.Random(seed)
    parts = SYLLABLES[name].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_language(spark, docs_of):
    names = sorted(SYLLABLES)
    given = [(i, in_language(names[i % 4], i, 3 + i % 40)) for i in range(240)]
    docs = docs_of(given + ODD).withColumn("lang", F.expr(f"CASE WHEN doc_id < 240 THEN element_at(array{tuple(names)}, CAST(doc_id % 4 + 1 AS INT)) END"))
    model = language.learn(docs.filter(fold(5) != 0))
    found = rows(language.identify(docs, model))
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([found[i].lang_pred == names[i % 4] for i in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in found.values())
    assert {i for i, r in found.items() if r.lang_pred == "und"} == {900, 901, 902, 903}
    assert found[None].lang_pred in names
    again = rows(language.identify(docs, language.learn(docs.filter(fold(5) != 0))))
    assert again == found
    assert language.learn(docs.filter("lang IS NULL")) is None
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}
    assert language.identify(docs_of([]), model).collect() == []


def test_language_sample_is_bounded(spark, docs_of, monkeypatch):
    """An id teaches once however often it is repeated; many languages share the sample; the rarest go."""
    given = [(i, in_language(n, i, 40), n) for k, n in enumerate(SYLLABLES) for i in range(100 * k, 100 * k + 40 - k)]
    hot = [(-7, in_language("aa", 1, 30) + f" x{i}", "aa") for i in range(3000)]
    docs = spark.createDataFrame(given + hot, "doc_id bigint, text string, lang string")
    taught = []
    monkeypatch.setattr(language, "fit", lambda x, names: taught.extend(names))
    language.learn(docs)
    assert {n: taught.count(n) for n in SYLLABLES} == {"aa": 41, "bb": 39, "cc": 38, "dd": 37}
    taught.clear()
    monkeypatch.setattr(language, "SAMPLE_TEXTS", 20)
    language.learn(docs)
    assert {n: taught.count(n) for n in SYLLABLES} == dict.fromkeys(SYLLABLES, 5)
    taught.clear()
    monkeypatch.setattr(language, "MAX_LANGUAGES", 2)
    language.learn(docs)
    assert sorted(set(taught)) == ["aa", "bb"] and len(taught) == 20


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9, 40])
def test_codewords(n):
    codes = language.codewords(n)
    assert len({tuple(r) for r in codes.tolist()}) == n
    if n > 1:
        assert (np.abs(codes.sum(axis=0)) < n).all()


def test_a_wrong_bit_is_corrected():
    codes = language.codewords(4).astype(np.float32)
    model = language.Model(list("abcd"), codes, np.eye(codes.shape[1], dtype=np.float32), np.zeros(codes.shape[1]), np.ones(codes.shape[1]))
    for k in range(4):
        for bit in range(codes.shape[1]):
            x = 2 * codes[k].copy()
            x[bit] = -x[bit]
            assert model.scores(x[None])[0].argmax() == k


# -- 6 -----------------------------------------------------------------------------


def graded(prose, n):
    given, labels = [], []
    for i in range(n):
        text, good = prose(i % 40, 40 + i % 30), i % 4 != 0
        if not good:
            text = [" ".join(w + "%%%" for w in text.split()), " ".join(text.split()[:3] * 20), text.upper()][i // 4 % 3]
        given.append((i, text))
        labels.append((i, int(good)))
    return given, labels


def test_quality(spark, docs_of, prose):
    given, marks = graded(prose, 240)
    docs = docs_of(given + ODD)
    labels = spark.createDataFrame(marks + [(None, 1), (900, 1), (3, None)], "doc_id bigint, label int")
    model = quality.learn(docs, labels.filter(fold(5) != 0))
    found = rows(quality.score(docs, model))
    held = [(found[i].score >= 0.3) == bool(y) for i, y in marks if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean(held) >= 0.95 and len(held) > 25
    assert all(0 <= r.score <= 1 for r in found.values()) and found[900].score == found[901].score == found[902].score
    assert found == rows(quality.score(docs, quality.learn(docs, labels.filter(fold(5) != 0))))
    assert quality.learn(docs, labels.filter("label = 1")) is None
    assert {r.score for r in quality.score(docs, None).collect()} == {0.5}
    assert quality.score(docs_of([]), model).collect() == []


def plain_bag(text):
    """Buckets of a text by loops over words, pairs and characters."""

    def bucket(number, kind):
        mixed = (number + (kind << 48)) * 0x9E3779B97F4A7C15 % 2**64
        return 1 + (mixed >> 32) % (quality.BUCKETS - 1)

    counts = np.zeros(quality.BUCKETS)
    words = text.split(" ")
    hashes = [zlib.crc32(w.encode()) for w in words]
    for h in hashes:
        counts[bucket(h, 1)] += 1
    for a, b in zip(hashes, hashes[1:]):
        counts[quality.SAME if a == b else bucket(a * int(quality.PRIME) % 2**64 ^ b, 2)] += 1
    for word in words:
        marked = f" {word} "
        for n in quality.NGRAMS:
            for i in range(len(marked) - n + 1):
                gram = 0
                for c in marked[i : i + n]:
                    gram = (gram * int(quality.PRIME) + ord(c)) % 2**64
                counts[bucket(gram, n + 1)] += 1
    return counts


def test_ngrams_are_of_characters():
    for text in ("naïve Straße", "日本語 の テキスト の の", "a", "🙂🙂 x 🙂🙂 🙂🙂"):
        found, want = quality.bag(text), plain_bag(text)
        assert found.sum() == want.sum() and (found == want).all()
    assert quality.bag("é").sum() == quality.bag("e").sum()


def test_quality_score_is_the_softmax_of_the_average():
    rng = np.random.default_rng(2)
    model = quality.Model(rng.normal(size=(quality.BUCKETS, quality.DIM)), rng.normal(size=(quality.DIM, 2)), rng.normal(size=2))
    for text in ["one two two", "é ü", ""]:
        bag = quality.bag(text)
        vectors = [model.table[i] for i in np.flatnonzero(bag) for _ in range(int(bag[i]))]
        hidden = np.mean(vectors, axis=0) if vectors else np.zeros(quality.DIM)
        z = np.exp(hidden @ model.layer + model.bias)
        assert abs(model.scorer()(bag) - z[1] / z.sum()) < 1e-9


def test_bag_is_the_same_in_stretches(monkeypatch, prose):
    text = prose(3, 500) + " same same same"
    whole = quality.bag(text)
    monkeypatch.setattr(quality, "STRETCH", 7)
    assert (quality.bag(text) == whole).all()
    words = text.encode().split()
    grams = sum(max(len(w) + 2 - n + 1, 0) for w in words for n in (3, 4)) + sum(len(w) + 1 for w in words)
    # Two-byte n-grams are shared by the words around a space.
    assert whole.sum() == len(words) + len(words) - 1 + grams
    assert whole[quality.SAME] >= 2


# -- 7 -----------------------------------------------------------------------------


def marked(prose, n):
    rng = random.Random(12)
    given, labels = [], []
    for i in range(n):
        words, bad = prose(i % 60, 60 + i % 50).split(" "), i % 5 == 0
        if bad:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice([*BAD, "zorkig" + rng.choice("aeiou") + rng.choice(["n", "st"])]))
        given.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return given, labels


def test_toxicity(spark, docs_of, prose):
    given, marks = marked(prose, 400)
    docs = docs_of(given + ODD)
    labels = spark.createDataFrame(marks + [(None, 1), (900, 0), (3, None)], "doc_id bigint, label int")
    model = toxicity.learn(docs, labels.filter(fold(3) != 1))
    assert set(BAD) <= model.lexicon and any(t.startswith("zorkig") for t in model.lexicon)
    found = rows(toxicity.score(docs, model))
    held = [(y, found[i].score >= 0.7) for i, y in marks if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(p for y, p in held if y) and not any(p for y, p in held if not y)
    assert all(0 <= r.score <= 1 for r in found.values()) and found[900].score == found[901].score
    kept = toxicity.keep_clean(docs, model, 0.7)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in found.items() if r.score < 0.7}
    assert toxicity.learn(docs, labels.filter("label = 0")) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(docs_of([]), model).collect() == []


def test_long_words_and_repeated_ids_teach(spark, docs_of, prose):
    """A word of any length can be in the lexicon, and an id on many rows teaches once."""
    long_word = "krak" * 25
    given = [(i, prose(i, 40) + (f" {long_word}" if i % 4 == 0 else "")) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in given], "doc_id bigint, label int")
    model = toxicity.learn(docs_of(given), labels)
    assert long_word in model.lexicon
    again = toxicity.learn(docs_of(given + [given[5]] * 300 + [given[8]] * 300), labels)
    assert again.lexicon == model.lexicon and (again.trees.values == model.trees.values).all()


def test_lexicons_equal_a_plain_ranking(spark, docs_of, prose, monkeypatch):
    """Every term is judged, for each fold left out, and the terms of most evidence are taken."""
    monkeypatch.setattr(toxicity, "LEXICON", 7)
    given, marks = marked(prose, 300)
    label = dict(marks)
    sample = docs_of(given).select("doc_id", "text")
    for without, found in enumerate(toxicity.pick_lexicons(sample, label)):
        used = [(i, t) for i, t in given if toxicity._fold_of(i) != without]
        n = [sum(label[i] == y for i, _ in used) for y in (0, 1)]
        held = {}
        for i, text in used:
            for term in {t for w in map(toxicity.plain, text.split()) if len(w) > 2 for t in toxicity.terms(w)}:
                held.setdefault(term, [0, 0])[label[i]] += 1
        share, ranked = n[1] / sum(n), []
        for term, (clean, toxic) in held.items():
            odds = ((toxic + 0.1) / (n[1] + 1)) / ((clean + 0.5) / (n[0] + 1))
            rate = min(max(toxic / (toxic + clean), 1e-9), 1 - 1e-9)
            bound = (toxic + clean) * (rate * np.log(rate / share) + (1 - rate) * np.log((1 - rate) / (1 - share)))
            if toxic >= toxicity.MIN_SUPPORT and odds >= toxicity.MIN_ODDS and rate > share and bound >= toxicity.MIN_EVIDENCE:
                ranked.append((-round(bound, 9), term))
        assert len(ranked) > 7 and found == {term for _, term in sorted(ranked)[:7]}


def test_features():
    reader = toxicity.Reader(frozenset(["snarl", "zork*"]))
    names = dict(zip(toxicity.FEATURES, reader.features("You snarl! ZORKIG sn4rl s-n-a-r-l plaaain")))
    assert names["lexicon_count"] == 4 and round(names["second_person_near"] * 6) == 3
    assert [round(6 * names[k]) for k in ("shouted_words", "stretched", "obfuscated")] == [1, 1, 2]
    assert not any(reader.features(""))


def test_isotonic_never_falls():
    rng = np.random.default_rng(0)
    raw = rng.normal(size=500).round(1)
    y = (rng.random(500) < 1 / (1 + np.exp(-raw))).astype(float)
    value = toxicity.isotonic(raw, y)(np.linspace(-4, 4, 200))
    assert (np.diff(value) >= -1e-12).all() and 0 <= value.min() <= value.max() <= 1
