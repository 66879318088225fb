"""Operators with exact results, against brute force on small tables with every odd case."""

import hashlib
import random
import time

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
import xxhash
from tokenizers import models

from sitelens.llm import components, decontaminate, lines, pieces, queries, repeats, rules, simhash, wordpiece

from .conftest import ODD

SP = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- 1 -----------------------------------------------------------------------------

STRANGE = [
    "a  b ", " a", "▁x▁ y", "\n\n a\n", "a\tb\r\nc", "日本語 😀 é", "<s> <0x0A> <unk>", "\x00a", "a b　c",
    "▁", " ", "  ", "\n", "a\n\n  b", "�", "①ﬁ", "word " * 50 + "y" * 2000,
]


def test_pieces_equal_the_library(docs_of, prose):
    given = ODD + [(i, t) for i, t in enumerate(STRANGE + [prose(1, 3000)])]
    model = pieces.read_model(queries.PIECE_MODEL)
    encoded = pieces.encode_decode(docs_of(given), model)
    want = []
    for i, t in given:
        ids = SP.encode(t or "")
        want.append((i, len(ids), ids, SP.decode(ids)))
    assert rows(encoded) == sorted(want, key=repr)
    want = [(i, n, sha(",".join(map(str, ids)).encode()), sha(d.encode())) for i, n, ids, d in want]
    assert rows(pieces.digests(encoded)) == sorted(want, key=repr)
    assert pieces.encode_decode(docs_of([]), model).collect() == []


def test_pieces_random_texts_and_a_full_table():
    rng = random.Random(5)
    table = pieces.ChunkTable(pieces.read_model(queries.PIECE_MODEL), limit=500)
    for _ in range(300):
        texts = ["".join(rng.choice("ab ▁\n\té日😀.,A1") for _ in range(rng.randint(0, 40))) for _ in range(3)]
        packed = table.encode(texts)
        ids = [np.frombuffer(p, np.int32).tolist() for p in packed]
        assert ids == [SP.encode(t) for t in texts]
        flat = np.frombuffer(b"".join(packed), np.int32)
        assert table.decode(flat, np.array([len(i) for i in ids])) == [SP.decode(i) for i in ids]


# -- 2 -----------------------------------------------------------------------------


def kept_lines(given):
    def key(line):
        k = line.strip(" \t\n\x0b\f\r")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in k)

    owner = {}
    order = lambda i: (i is not None, i or 0)
    for i, t in given:
        for line in (t or "").split("\n"):
            k = key(line)
            if len(k) >= 10 and (k not in owner or order(i) < order(owner[k])):
                owner[k] = i
    out = []
    for i, t in given:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if len(key(x)) < 10 or owner[key(x)] == i]
        out.append((i, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return out


def line_rows(prose):
    rng = random.Random(3)
    shared = [prose(i, 8) for i in range(12)] + ["short", "  UPPER line Ä ß  ", "upper LINE Ä ß", "ééééééééé", "éééééééééé"]
    return ODD + [(i, "\n".join(rng.choice(shared) for _ in range(rng.randint(1, 9)))) for i in range(60)]


@pytest.mark.parametrize("batches", [1, 4, 7])
def test_lines(docs_of, prose, batches):
    given = line_rows(prose)
    want = [(i, n, d, None if t is None else k) for (i, n, d, k), (_, t) in zip(kept_lines(given), given)]
    docs = docs_of(given)
    assert rows(lines.dedup_lines(docs, batches)) == sorted(want, key=repr)
    if batches == 4:
        replaced = lines.replace_lines(docs)
        assert replaced.columns == docs.columns
        assert rows(replaced.select("doc_id", "text")) == sorted([(i, k) for i, _, _, k in want], key=repr)
        assert lines.dedup_lines(docs_of([])).collect() == []


def test_runs_are_levelled_and_disjoint(spark, docs_of, prose, tmp_path):
    runs, names = lines.LineRuns(spark, str(tmp_path)), []
    for i in range(5):
        hashes = lines.line_hashes(docs_of([(10 * i + j, prose(j, 40) + f"\nown line {i} {j}") for j in range(4)]))
        names.append(runs.add(hashes))
        runs.compact()
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    stored = [r.h for level in runs.levels for name in level for r in spark.table(name).collect()]
    assert len(stored) == len(set(stored))
    runs.close([name for level in runs.levels for name in level])


def test_runs_are_merged_not_broadcast(spark, docs_of, prose, monkeypatch):
    """The driver holds none of the index, whatever the size of a run's file."""
    plans, write = [], lines.LineRuns._write
    text_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(lines.LineRuns, "_write", lambda runs, rows: plans.append(text_of(rows)) or write(runs, rows))
    gone = lines.dropped_hashes(docs_of([(i, prose(i % 7, 60)) for i in range(40)]))
    plans.append(text_of(gone))
    assert len(plans) > 4 and any("LeftAnti" in p for p in plans) and "LeftOuter" in plans[-1]
    assert not any("Broadcast" in p for p in plans)


# -- 3 -----------------------------------------------------------------------------


def removed_bytes(given, n):
    seen, out = set(), []
    texts = [(i, (t or "").encode()) for i, t in given]
    marks = {}
    for i, data in sorted(set(texts), key=lambda x: (x[0] is not None, x[0] or 0)):
        gone = np.zeros(len(data), dtype=bool)
        for s in range(len(data) - n + 1):
            w = data[s : s + n]
            if w in seen:
                gone[s : s + n] = True
            seen.add(w)
        marks[i, data] = gone
    for i, data in texts:
        gone = marks[i, data]
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out.append((i, len(data), int(gone.sum()), int((edges == 1).sum()), bytearray(np.frombuffer(data, np.uint8)[~gone].tobytes())))
    return out


def repeat_rows(prose):
    rng = random.Random(9)
    passage = prose(50, 60)
    given = [r for r in ODD if r[0] != 905] + [(905, "x" * 3000), (906, "ab" * 400), (907, "q " * 90)]
    for i in range(40):
        text = prose(i % 25, rng.randint(5, 120))
        if i % 3 == 0:
            at = rng.randint(0, len(text))
            text = text[:at] + passage[rng.randint(0, 30) :] + text[at:]
        if i % 7 == 0:
            text = text[: len(text) // 2] + "é" + text[len(text) // 2 :]
        given.append((i, text))
    return given


@pytest.mark.parametrize("max_bucket", [100_000, 3, 0])
def test_repeats(docs_of, prose, max_bucket):
    given = repeat_rows(prose)
    found = repeats.remove_repeats(docs_of(given), max_bucket=max_bucket)
    assert rows(found) == sorted(removed_bytes(given, 100), key=repr)
    if max_bucket == 3:
        assert repeats.remove_repeats(docs_of([])).collect() == []


def rows_of_few_ids(prose):
    passage = prose(400, 40)
    given = [(None, f"{passage} {prose(401 + i, 60)}") for i in range(3)] + [(None, prose(410 + i, 200)) for i in range(3)]
    given += [(50, f"{prose(420 + i, 30)} {passage}") for i in range(2)] + [(50, f"{passage} {prose(430, 90)}")] * 2
    return given + [(-51, prose(440, 50) + passage), (51, prose(440, 50) + passage), (2**62, prose(410, 200)), (52, None), (52, "")]


@pytest.mark.parametrize("max_bucket", [100_000, 0])
def test_texts_without_or_with_equal_ids_are_documents_of_their_own(docs_of, prose, max_bucket):
    given = [(i, t or "") for i, t in rows_of_few_ids(prose)]
    order = sorted(set(given), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).digest()))
    want = [(given[k][0], *found[1:]) for k, found in enumerate(removed_bytes([(order.index(r), r[1]) for r in given], 100))]
    found = repeats.remove_repeats(docs_of(rows_of_few_ids(prose)), max_bucket=max_bucket)
    assert rows(found) == sorted(want, key=repr)
    assert sum(r[2] > 0 for r in want if r[0] is None) == 2


def test_repeat_groups_tell_rows_without_an_id_apart(docs_of, prose):
    passage = prose(400, 19)
    found = repeats.repeat_groups(docs_of([(None, f"{passage} {prose(401 + i, 20)}") for i in range(2)] + [(-7, passage)]))
    groups = {}
    for r in found.collect():
        groups.setdefault((r.name, r.start), []).append(r.doc_id)
    assert any(sorted(ids, key=repr) == [-7, None, None] for ids in groups.values()), groups


def test_cells_cover_every_window_and_depend_on_content_only(monkeypatch):
    data = np.random.default_rng(1).integers(97, 100, 5000, dtype=np.uint8).tobytes()
    whole = repeats.cells(data)
    monkeypatch.setattr(repeats, "STRETCH", 700)
    cut = repeats.cells(data)

    def anchors(found):
        out = {}
        for key, at in zip(found[0].tolist(), found[1].tolist()):
            start, rest = divmod(at, 1 << 20)
            n, off = divmod(rest, 1 << 10)
            out |= {s: (key, start + off) for s in range(start, start + n)}
        return out

    assert anchors(whole) == anchors(cut) and set(anchors(cut)) == set(range(len(data) - 99))


def test_maximal_repeats_have_all_members():
    texts = [b"xxabcdefyy", b"zzabcdefyy", b"zzabcdegww", b"q"]
    groups = {(tuple(sorted(m)), left, right) for m, left, right in repeats.maximal_repeats([(t, 4) for t in texts[:3]], 4)}
    assert groups == {((0, 1), 2, 6), ((0, 1, 2), 2, 3), ((1, 2), 4, 3)}


def test_repeat_groups_list_all_occurrences(docs_of, prose):
    passage = prose(70, 40)
    given = [(i, f"{prose(100 + i, 20)} {passage} {prose(200 + i, 20)}") for i in range(5)]
    found = rows(repeats.repeat_groups(docs_of(given)))
    covered = {}
    for _, i, start, stop, _ in found:
        covered.setdefault(i, set()).update(range(start, stop))
    for i, text in given:
        at = text.encode().index(passage.encode())
        assert set(range(at, at + len(passage.encode()))) <= covered[i]
    sizes = {}
    for group, i, *_ in found:
        sizes.setdefault(group, set()).add(i)
    assert {frozenset(v) for v in sizes.values()} >= {frozenset(range(5))}


# -- 4 -----------------------------------------------------------------------------


def test_rules(docs_of, prose):
    clean = prose(4, 200)
    shouted = " ".join(w.upper() + "!!" for w in prose(5, 80).split())
    given = ODD + [
        (1, clean),
        (2, " ".join(w + "%%%" for w in prose(6, 90).split())),
        (3, shouted),
        (4, " | ".join(prose(7, 90).split())),
        (5, clean + "\n" + shouted[:200]),
        (6, "one two three " * 40),
        (7, "a b\n a b\na b\n\nÄ é#"),
    ]
    found = {r.doc_id: r for r in rules.clean_lines(docs_of(given)).collect()}
    assert [found[i].kept for i in range(1, 8)] == [True, False, False, False, True, False, False]
    assert found[5].text == clean and found[5].n_punctuation == 1 and found[4].n_navigation >= 1
    assert (found[6].n_repeat_words, found[6].n_words, found[6].base_failed) == (120, 120, True)
    r = found[7]
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (8, 9, 1, 1, 6)
    assert not found[900].kept and found[901].n_words == 0 and found[902].word_chars == 0
    assert len(rules.clean_lines(docs_of(ODD)).collect()) == len(ODD)
    assert rules.clean_lines(docs_of([])).collect() == []


def test_line_rules():
    assert rules.line_rule("Home | About | Contact | Help") == "navigation"
    assert rules.line_rule("Please read our Privacy Policy before use") == "boilerplate"
    assert rules.line_rule("THIS IS ALL IN CAPITAL LETTERS") == "punctuation"
    assert rules.line_rule("Buy!! this!! now!! really!!") == "punctuation"
    assert rules.line_rule("A plain sentence, with a comma.") is None and rules.line_rule(" \t") is None


# -- 8 -----------------------------------------------------------------------------


def test_token_counts_equal_greedy_matching(docs_of, prose):
    vocabulary = [SP.id_to_piece(i) for i in range(SP.vocab_size()) if not (SP.is_byte(i) or SP.is_control(i) or SP.is_unknown(i))]
    initial, following = wordpiece.marked_vocabulary(vocabulary)
    numbered = {p: i for i, p in enumerate([*sorted(initial), *("##" + p for p in sorted(following)), "[UNK]"])}
    model = models.WordPiece(numbered, unk_token="[UNK]", max_input_chars_per_word=10**9, continuing_subword_prefix="##")
    given = ODD + [(i, prose(i, 300)) for i in range(3)] + [(50, "Ünïcödé 日本語 ☃x x☃y")]
    want = []
    for i, t in given:
        words = [w.decode() for w in (t or "").encode().split()]
        cut = [[x.value for x in model.tokenize(w)] if len(w) < 5000 else None for w in words]
        long = wordpiece.LongestMatch(initial, following)
        cut = [c if c is not None else ["x"] * long.count(w) for c, w in zip(cut, words)]
        want.append((i, len(words), sum(map(len, cut)), sum("[UNK]" in c for c in cut)))
    assert rows(wordpiece.count_tokens(docs_of(given), initial, following)) == sorted(want, key=repr)
    assert wordpiece.count_tokens(docs_of([]), initial, following).collect() == []


def test_longest_match_on_random_vocabularies():
    rng = random.Random(2)
    for _ in range(200):
        def some(n):
            return {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(n)}

        initial, following = some(5), some(5)
        automaton = wordpiece.LongestMatch(initial, following)
        for _ in range(30):
            word = "".join(rng.choice("abcd" if rng.random() < 0.1 else "abc") for _ in range(rng.randint(1, 12)))
            at, n = 0, 0
            while at < len(word):
                size = max((len(p) for p in (following if at else initial) if word.startswith(p, at)), default=0)
                if not size:
                    n = 0
                    break
                at, n = at + size, n + 1
            assert automaton.count(word) == n, (word, initial, following)


# -- 9 -----------------------------------------------------------------------------


def near_rows(prose):
    rng = random.Random(8)
    base = [prose(i, 150) for i in range(8)]
    given = list(ODD)
    for i in range(70):
        words = base[i % 8].split(" ")
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(["new", "other", "swap"])
        given.append((i, " ".join(words)))
    return given + [(80, "one two"), (81, "ONE two"), (82, "one two three")]


def test_near_duplicates(docs_of, prose):
    given = near_rows(prose)
    fps = []
    for _, t in given:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        shingles = [b" ".join(words[j : j + 4]) for j in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    group = list(range(len(given)))
    for a in range(len(given)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = group[a], group[b]
                group = [y if g == x else g for g in group]
    order = lambda i: (i is not None, i or 0)
    want = []
    for k, (i, _) in enumerate(given):
        least = min((given[j][0] for j in range(len(given)) if group[j] == group[k]), key=order)
        want.append((i, f"{fps[k]:016x}", least))
    docs = docs_of(given)
    assert rows(simhash.shown(simhash.near_duplicates(docs))) == sorted(want, key=repr)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    first = {least for _, _, least in want}
    assert sorted((r.doc_id for r in kept.collect()), key=order) == sorted(first, key=order)
    assert simhash.near_duplicates(docs_of([])).collect() == []


def test_near_duplicates_without_or_with_equal_ids(docs_of, prose):
    one, two, three, four = (prose(300 + i, 400) for i in range(4))
    near = lambda text, i: text + f" tail{i}"
    given = [
        (None, one), (10, near(one, 1)), (11, near(one, 2)), (None, two), (20, near(two, 1)), (21, near(two, 2)),
        (None, three), (None, near(three, 1)), (None, near(three, 1)), (None, four), (30, prose(310, 90)), (30, prose(311, 90)),
        (31, prose(312, 90)), (31, prose(312, 90)), (32, None), (32, ""), (None, " "),
    ]
    docs = docs_of(given)
    found = simhash.shown(simhash.near_duplicates(docs), "component").collect()
    groups = {}
    for r in found:
        groups.setdefault(r.component, []).append(r)
    ids = lambda values: sorted(values, key=repr)
    assert ids(ids(r.doc_id for r in group) for group in groups.values()) == ids(
        [ids([None, 10, 11]), ids([None, 20, 21]), [None] * 3, [None], [30], [30], [31, 31], ids([32, 32, None])]
    )
    assert ids(group[0].component_id for group in groups.values()) == ids([10, 20, None, None, 30, 30, 31, 32])
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert ids(i for i, _ in got) == ids([10, 20, None, None, 30, 30, 31, 32])
    least = min((three, near(three, 1)), key=lambda t: hashlib.md5(t.encode()).digest())
    assert {t for i, t in got if i is None} == {least, four}
    assert {t for i, t in got if i == 30} == {prose(310, 90), prose(311, 90)}


def test_search_finds_every_pair_of_random_fingerprints(spark):
    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for f in fps[:40]:
        for _ in range(3):
            fps.append(f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    signed = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    df = spark.createDataFrame([(f, f) for f in signed], "fp bigint, grp bigint")
    found = {frozenset((r.a, r.b)) for r in simhash._links(df, simhash.SEGMENTS, 4).collect()}
    want = {frozenset((a, b)) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    assert found == want


def test_search_does_not_broadcast_what_it_explodes(spark, tmp_path):
    """A small file of fingerprints is sized as small after an explode too; the driver must not hold the ball."""
    spark.range(1000).selectExpr("id AS fp", "id AS grp").write.parquet(str(tmp_path / "fps"))
    fps = spark.read.schema("fp bigint, grp bigint").parquet(str(tmp_path / "fps"))
    plan = simhash._links(fps, simhash.SEGMENTS, 4)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components(spark, tmp_path):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(-40, 40), rng.randint(-40, 40)) for _ in range(45)]
    edges += [(500, i) for i in range(501, 540)] + [(7, 7), (8, 7), (7, 8)]
    group = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(200):
        for a, b in edges:
            if a != b:
                group[a] = group[b] = min(group[a], group[b])
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    assert {r.node: r.component for r in components.components(df, str(tmp_path / "g")).collect()} == group
    assert components.components(df.filter("a > 9999"), str(tmp_path / "e")).collect() == []


# -- 10 ----------------------------------------------------------------------------


def distance(pattern, text):
    """Least edit distance to any stretch of the text, by the plain table."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for j, p in enumerate(pattern, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[-1] + 1))
        row, best = new, min(best, new[-1])
    return best


def test_bit_parallel_distance():
    rng = random.Random(1)
    for _ in range(300):
        pattern = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("ab ") for _ in range(rng.randint(0, 60)))
        assert decontaminate.best_match(pattern, text)[0] == distance(pattern, text)


def test_benchmark_items(spark, docs_of, prose):
    rng = random.Random(2)
    items = [(i, prose(300 + i, 30)) for i in range(6)] + [(10, None), (11, " \n "), (None, prose(400, 25)), (12, prose(300, 30))]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    given, want = list(ODD), set()
    for i in range(24):
        item = items[i % 6][1]
        edits = [0, 0, int(len(item) * 0.05), int(len(item) * 0.05) + 25][i % 4]
        chars = list(item.upper() if i % 2 else item.replace(" ", "\n ", 3))
        for at in rng.sample([k for k, c in enumerate(chars) if not c.isspace()], edits):
            chars[at] = "#"
        given.append((i, f"{prose(500 + i, 20)} {''.join(chars)} {prose(600 + i, 20)}"))
    known = [(i, decontaminate.normalised(t)) for i, t in items if t and t.strip()]
    for i, t in given:
        for item_id, item in known:
            if t and len(t) < 5000 and distance(item, decontaminate.normalised(t)) <= int(len(item) * 0.05):
                want.add((i, item_id))
    docs = docs_of(given)
    for block_chars in (4_000_000, 400):
        found = decontaminate.find_items(docs, benchmark, block_chars=block_chars).collect()
        assert {(r.doc_id, r.item_id) for r in found} == want and len(want) > 15
    texts = dict(given)
    for r in found:
        stretch = decontaminate.normalised(texts[r.doc_id])[r.start : r.end]
        item = next(t for i, t in known if i == r.item_id)
        assert distance(item, stretch) == r.distance
    kept = decontaminate.keep_clean(docs, benchmark, block_chars=400)
    assert kept.columns == docs.columns
    bad = {i for i, _ in want}
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(repr(i) for i, _ in given if i not in bad)
    assert decontaminate.find_items(docs, benchmark.filter("item_id < 0")).collect() == []
    assert decontaminate.find_items(docs_of([]), benchmark).collect() == []


def test_every_copy_of_an_item_is_found(spark, docs_of, prose):
    """Copies right after each other are rows of their own, and what is left holds none."""
    item = decontaminate.normalised(prose(700, 14))
    benchmark = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    found = decontaminate.find_items(docs_of([(1, f"{item} {item} {item}"), (2, item * 2)]), benchmark).collect()
    size = len(item)
    assert sorted((r.doc_id, r.distance, r.start, r.end) for r in found) == [
        *((1, 0, k * (size + 1), k * (size + 1) + size) for k in range(3)), (2, 0, 0, size), (2, 0, size, 2 * size)
    ]

    rng = random.Random(8)
    for _ in range(60):
        pattern = "".join(rng.choice("abc ") for _ in range(rng.randint(20, 70)))
        budget, text = len(pattern) // 20, ""
        for _ in range(rng.randint(0, 8)):
            copy = list(pattern)
            for at in rng.sample(range(len(copy)), rng.randint(0, budget + 1)):
                copy[at] = rng.choice(["", "x", copy[at] + "y"])
            text += "".join(copy) + "".join(rng.choice("abc ") for _ in range(rng.choice([0, 0, 1, 30])))
        automaton, known = decontaminate.build([(7, pattern)], 0.05)
        text = decontaminate.normalised(text)
        at, copies = 0, sorted(decontaminate.matches(text, automaton, known), key=lambda m: m[2])
        for _, d, start, end in copies:
            assert at <= start and edits(pattern, text[start:end]) == d <= budget
            assert distance(pattern, text[at:start]) > budget
            at = end
        assert distance(pattern, text[at:]) > budget


def edits(a, b):
    """Edit distance of two whole texts, by the plain table."""
    row = list(range(len(a) + 1))
    for i, c in enumerate(b, 1):
        new = [i]
        for j, p in enumerate(a, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_many_copies_take_linear_time():
    pattern = "".join(random.Random(3).choice("abcdefgh ") for _ in range(60)).strip()
    automaton, known = decontaminate.build([(7, pattern)], 0.05)
    took = []
    for n in (500, 2000):
        started = time.perf_counter()
        assert len(decontaminate.matches(" ".join([pattern] * n), automaton, known)) == n
        took.append(time.perf_counter() - started)
    assert took[1] < 10 * took[0]


def test_equal_rows_of_one_document_cost_no_more_than_others(docs_of, prose):
    """Repeated rows are one document, so their number does not multiply their cells."""
    text, took = prose(77, 700), []
    for n in (100, 400):
        started = time.perf_counter()
        found = repeats.remove_repeats(docs_of([(5, text)] * n + [(None, text)] * n)).collect()
        took.append(time.perf_counter() - started)
        assert len(found) == 2 * n
        # The row without an id comes first and keeps its text; the others repeat it.
        assert sum(1 for r in found if r.n_removed) == n
    assert took[1] < 3 * took[0]
