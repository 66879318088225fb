"""Page text, aligned tokens and conversation prefixes, against brute force."""

import collections
import hashlib
import html as references
import math
import random
import re
import time
import zlib

import pytest

from sitelens.llm import alignment, boilerplate, pieces, prefix_trie, queries

from .conftest import ODD


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- 11 ----------------------------------------------------------------------------

MARKED = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/x">Menu</a><li><a>More</a></ul></nav>
<!-- ad > --><div class="ad">Buy</div><div id="cookie-notice">Cookies!</div>
<article class="post"><header><h1>Head&#8203;line</h1><span>By me</span></header>
<p>One <b>tw</b>o&nbsp;three<br>four<p>Five &lt;b&gt; &amp;amp; <a href='/?a="b>'>six</a><div class=share-bar>Tweet</div>
<form><input name=q>Search</form><blockquote>Seven</blockquote><aside>Side</aside>
<section class="comments"><p>First!</p></section></article><footer>&copy; me</footer>"""


def test_marked_pages():
    text = boilerplate.main_text(boilerplate.blocks(MARKED), None)
    assert text == "Head​line\nOne two three four\nFive <b> &amp; six\nSeven"
    assert boilerplate.main_text(boilerplate.blocks("<main><p>a</p><nav>b</nav></main><p>c"), None) == "a"
    nested = "<main><h2>x</h2><article><p>a<article class=comment>b</article></article></main>"
    assert boilerplate.main_text(boilerplate.blocks(nested), None) == "a"
    assert boilerplate.main_text(boilerplate.blocks("<article><p>a<script>b<p>c"), None) == "a"
    assert [b.text for b in boilerplate.blocks("a < b <p title=Bob's>c</p> d <b")] == ["a < b", "c", "d"]
    assert boilerplate.blocks("") == []


def test_pages_take_linear_time():
    for broken in ("<a b=\"", "<div>", "<!--", "<p><b>", "&amp", "</x>", "<script>"):
        took = []
        for n in (20_000, 80_000):
            started = time.perf_counter()
            boilerplate.blocks(broken * n if broken != "<div>" else (broken + "</div>") * n)
            took.append(time.perf_counter() - started)
        assert took[1] < 12 * took[0] + 0.2, broken


def repeated_by_brute_force(pages):
    """Covered places of each page's stream, by comparing every run with every other page's."""
    streams = {}
    for key, url, html in pages:
        streams[key] = (boilerplate.host_of(url), boilerplate.stream(boilerplate.blocks(html or "")))
    covered = {}
    for key, (host, s) in streams.items():
        others = [t for h, t in streams.values() if h == host and t != s]
        runs = {tuple(t[i:j]) for t in others for i in range(len(t)) for j in range(i + 1, min(len(t), i + boilerplate.DEPTH) + 1)}
        for i in range(len(s)):
            best = max((j - i for j in range(i + 1, min(len(s), i + boilerplate.DEPTH) + 1) if tuple(s[i:j]) in runs), default=0)
            if best:
                covered.setdefault(key, []).append(i * 64 + best)
    return covered


@pytest.mark.parametrize("parts", ["1", "5", "23"])
def test_unmarked_pages_lose_what_their_host_repeats(spark, prose, parts):
    rng = random.Random(11)
    pages = []
    for i in range(120):
        host = f"http://{'www.' if i % 2 else ''}h{i % 3 if i % 4 else 0}.example/p{i}"
        top = "".join(f"<li>{w}</li>" for w in rng.sample(["Home", "News", "About us all", "Shop"], 3))
        body = "".join(f"<p>{prose(rng.randint(0, 60), rng.randint(3, 40), 60)}</p>" for _ in range(rng.randint(1, 5)))
        end = rng.choice(["<div>All rights reserved by the owner</div>", "<div>short</div>", ""])
        pages.append((i, host, f"<ul>{top}</ul>{body}{end}"))
    pages += [(500, None, "<p>no url"), (501, "http://h0.example", None), (502, "http://h0.example", ""), (503, "x", MARKED)]
    pages += [(600 + i, "http://h1.example/copy", pages[1][2]) for i in range(30)] + [(None, None, "<p>no id")] + [pages[5]]
    covered = repeated_by_brute_force([(k, u, h) for k, (_, u, h) in enumerate(pages)])
    want = [(i, u, t := boilerplate.main_text(boilerplate.blocks(h or ""), covered.get(k)), len(t)) for k, (i, u, h) in enumerate(pages)]
    assert any("Home" in h and "Home" not in t for (_, _, h), (_, _, t, _) in zip(pages, want) if h)
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    df = df.selectExpr("*", "1 AS host", "'x' AS page_key", "2 AS `a.b`", "'t' AS text")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert rows(boilerplate.extract(df)) == sorted(want, key=repr)
        assert boilerplate.extract(df.limit(0)).collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_streams_hold_the_articles_too(spark):
    """What an unmarked page repeats of another page's article is found by the suffix array."""
    found = boilerplate.blocks(MARKED)
    assert len(boilerplate.stream(found)) == len(found)
    same = "<p>This offer is valid for all of our customers until the end of the year</p>"
    own = "<p>" + " ".join(f"word{i}" for i in range(60)) + "</p>"
    pages = [(1, "http://h.example/1", f"<article>{same}<p>more of it</p></article>"), (2, "http://h.example/2", same + own)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in boilerplate.extract(df).collect()}
    assert got == {1: "This offer is valid for all of our customers until the end of the year\nmore of it", 2: own[3:-4]}


def test_given_pages_give_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in boilerplate.extract(pages).collect()}
    for r in pages.collect():
        article = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        parts = re.split(r"</?p>|</?h1>", article)
        plain = (" ".join(references.unescape(re.sub("</?b>|<br>", "", p)).split()) for p in parts)
        text = "\n".join(p for p in plain if p)
        assert got[r.page_id] == (text, len(text))


# -- 12 ----------------------------------------------------------------------------

A_JSON = pieces.read_model(queries.BYTE_TOKENIZER).decode()
B_MODEL = pieces.read_model(queries.PIECE_MODEL)
TOKENS = alignment.Tokens(A_JSON, B_MODEL)
BITS = ["a", "b", "The", "  ", "\n", "\t", "é", "日本", "😀", ".", ",", "'s", "12", " word", " ", "　", "\x1c", "<|endoftext|>",
        "</s>", "!", "it's", " and the", "\n\n x", "Mr.Smith", "e.g.", "?!"]


def aligned_by_brute_force(text):
    """(ids of A, of B, groups, links) or None."""
    a = TOKENS.a.encode(" " + text, add_special_tokens=False).ids if text else []
    b = TOKENS.b.encode(text) if text else []
    full = (" " + text).encode() if text else b""
    if not text or TOKENS.spelled_a(a) != full or TOKENS.spelled_b(b) != full:
        return None

    def spans(ids, spell):
        ends = [0]
        for i in ids:
            ends.append(ends[-1] + len(spell([i])))
        return list(zip(ends, ends[1:]))

    on_a, on_b = spans(a, TOKENS.spelled_a), spans(b, TOKENS.spelled_b)
    groups, low = [], 0
    for end in sorted({e for _, e in on_a} & {e for _, e in on_b}):
        sides = [",".join(str(i) for i, s in zip(ids, on) if low < s[1] <= end) for ids, on in ((a, on_a), (b, on_b))]
        groups.append("|".join(sides))
        low = end
    links = [(i, j) for i, s in zip(a, on_a) for j, t in zip(b, on_b) if s[0] < t[1] and t[0] < s[1]]
    return a, b, groups, links


def alignment_by_brute_force(given):
    found = [(i, aligned_by_brute_force(t)) for i, t in given]
    counts = collections.Counter(link for _, x in found if x for link in x[3])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for i, x in found:
        if x is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = x
        best, total = sum(counts[k] == most[k[1]] for k in links), sum(counts[k] for k in links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((i, len(a), len(b), len(groups), len(links), best, total, digest))
    return sorted(out, key=repr), {k: n for k, n in counts.items()}


@pytest.mark.parametrize("stretch", [40, 1 << 15])
def test_alignment(docs_of, stretch):
    rng = random.Random(12)
    strange = ["a  b ", "<s> <0x0A> <unk>", "\x00a", "▁ a", "x ▁▁ y", "�①ﬁ", " a\t b", "x" * 700, "foo\t", "  \t\n", " ", "\n"]
    given = [(i, t if len(t or "") < 1000 else t[:3000]) for i, t in ODD] + list(enumerate(strange, 10))
    given += [(100 + i, "".join(rng.choice(BITS) for _ in range(rng.randint(1, 50)))) for i in range(100)]
    given += [(300 + i, "".join(rng.choice(BITS) for _ in range(500))) for i in range(4)]
    want, counts = alignment_by_brute_force(given)
    found, pairs = alignment.align(docs_of(given), A_JSON, B_MODEL, stretch=stretch)
    assert rows(found) == want
    assert {(r.a, r.b): r.n for r in pairs.collect()} == counts
    empty, no_pairs = alignment.align(docs_of([]), A_JSON, B_MODEL)
    assert empty.collect() == [] and no_pairs.collect() == []


def test_groups_are_the_hashed_text(docs_of):
    given = [(1, "It's one. Two,three"), (2, "")]
    found, _ = alignment.align(docs_of(given), A_JSON, B_MODEL, keep_groups=True, stretch=8)
    for r in found.collect():
        x = aligned_by_brute_force(dict(given)[r.doc_id])
        assert bytes(r.groups).decode() == (";".join(x[2]) if x else "")


def test_fragments_compose_associatively():
    rng = random.Random(3)
    for _ in range(60):
        text = " " + "".join(rng.choice(BITS) for _ in range(120))
        words = alignment.Words(TOKENS)
        ranges = alignment.ranges(text, 25)

        def parts():
            return [alignment.fragment(words, text, *r) for r in ranges]

        def joined(fs):
            while len(fs) > 1:
                k = rng.randrange(len(fs) - 1)
                fs[k : k + 2] = [fs[k].then(TOKENS, fs[k + 1])]
            return fs[0].whole(TOKENS)

        one, two = joined(parts()), joined(parts())
        assert one.row() == two.row()
        assert one.ok and b";".join(one.groups).decode() == ";".join(aligned_by_brute_force(text[1:])[2])


# -- 13 ----------------------------------------------------------------------------


def trie_by_brute_force(given):
    own, members, below, path_of = {}, {}, {}, {}
    for conv, turn, role, text in given:
        if conv is not None:
            own.setdefault(conv, []).append((turn, role or "", text or ""))
    for turns in own.values():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0))
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 9
        first = own.get(conv - int(math.fmod(conv, 5)), [])
        path_of[conv] = tuple(t[1:] for t in first[:h] + turns[h:])
    for conv, path in path_of.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(conv)
            if d:
                below.setdefault(path[: d - 1], set()).add(path[:d])
    out = []

    def visit(path):
        found = [visit(k) for k in below.get(path, ())]
        leaves = sum(f[0] for f in found) or 1
        saved = sum(f[1] for f in found) + ((len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0)
        ends = ",".join(str(c) for c in sorted(members[path]) if path_of[c] == path)
        parent = min(members[path[:-1]]) if path else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(members[path]), len(path), parent, len(members[path]), len(found), leaves, saved, digest))
        return leaves, saved

    if members:
        visit(())
    return sorted(out, key=repr)


@pytest.mark.parametrize("shards", [1, 2, 7, 40])
def test_prefix_trie(spark, shards):
    rng = random.Random(13)
    given = []
    for conv in range(-20, 250):
        for turn in range(rng.choice([0, 1, 2, 3, 5, 12])):
            given.append((conv, turn or None, rng.choice(["u", "a", None]), rng.choice(["x", "é", "yy", None, "z" * 5000])))
    given += [(None, 1, "u", "x")] + [(1000 + i, t, "u", f"same {t}") for i in range(200) for t in range(14)]
    given += [(2000, 1, "u", "twice"), (2000, 1, "u", "twice"), (-(2**63), 1, "u", "least"), (2**63 - 1, 1, "u", "greatest")]
    df = spark.createDataFrame(given, "conv_id bigint, turn bigint, role string, text string")
    df = df.selectExpr("*", "1 AS path", "'x' AS shard", "3 AS `a.b`", "0 AS family")
    assert rows(prefix_trie.prefix_trie(df, shards)) == trie_by_brute_force(given)


def test_prefix_trie_without_conversations(spark):
    df = spark.createDataFrame([(None, 1, "u", "x")], "conv_id bigint, turn bigint, role string, text string")
    assert prefix_trie.prefix_trie(df).collect() == []
    assert prefix_trie.prefix_trie(df.limit(0)).collect() == []
