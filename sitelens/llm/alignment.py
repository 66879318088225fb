"""Alignment of two tokenizers' tokens of the same texts, composed from fragments.

A fragment is what a byte range of a text gives: tokens before its first closed group
(open prefix), closed groups (runs of tokens of both sides between two offsets where
both have a token end) and tokens after the last one (open suffix).  Fragments compose
associatively: the suffix of one and the prefix of the next close to groups of their
own.  White space that follows other characters starts a token of either side, so a
word with the white space before it is a closed fragment; each task keeps those of
distinct words.  Texts over ``STRETCH`` bytes are cut into byte ranges, each moved to
the next place where its tokenizer can be cut (the two differ), encoded as rows of
their own and reduced in two rounds of ``FAN``; a Spark string holds no more than that.

An id pair's count needs all texts.  Rows are gathered in slices of about 2 MB of text;
a slice lists its distinct pairs, and documents point into that list.  Counts join the
lists, never the documents' pairs, and meet the documents of their slice in a sorted stream.
"""

import re
from copy import copy
from hashlib import sha256
from itertools import chain
from uuid import uuid4

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from ..plans.shared import shared_dir
from .common import arrow_schema, ids_and_texts, record_batch, slices

MARK = "▁"
#: Bytes of one range of a long text, and ranges composed in one step.
STRETCH = 32 << 10
FAN = 256
#: Bytes of text in one slice.
SLICE_BYTES = 2 << 20
#: A word with the white space before it; other white space than these two may be inside a piece.
WORD = re.compile(r"\s*\S+(?:[^\S \n]\s*\S+)*(?:[^\S \n]\s*\Z)?|\s+")
#: Places where side A, or B, can be cut: its tokens before and after are found independently.
A_CUT = re.compile(r"(?<=\S)(?=\s)|(?<=[A-Za-z])(?=[.,;:!?])")
B_CUT = re.compile(r"(?<=\S)(?=[ \n])")
#: The word table is emptied when it holds more entries, or characters.
TABLE_WORDS, TABLE_CHARS = 300_000, 8 << 20
#: Words added at once, and their characters encoded as one text.
ADDED_WORDS, JOINED_CHARS = 30_000, 1 << 16
_A = 1 << 20

RANGES = "key binary, doc_id bigint, at bigint, window string, a_from int, a_to int, b_from int, b_to int"
FRAGMENTS = (
    "key binary, doc_id bigint, at bigint, ok boolean, closed boolean, lead_a binary, lead_b binary, tail_a binary, "
    "tail_b binary, groups binary, n_a bigint, n_b bigint, n_groups bigint, pairs binary, counts binary"
)
#: A document (``found`` null), or the distinct pairs of a slice with their counts in it.
ALIGNED = (
    "slice bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "groups binary, places binary, times binary, found array<bigint>, counts array<bigint>"
)
DOCUMENT = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string, groups binary"


def _schema(ddl: str) -> pa.Schema:
    lists = {"array<bigint>": pa.list_(pa.int64())}
    fields = (f.split() for f in ddl.split(", "))
    return pa.schema([(n, lists.get(k) or arrow_schema(f"{n} {k}").field(n).type) for n, k in fields])


def byte_letters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is
    printable in Latin-1, else the next free one from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """The bytes of both tokenizers' ids, built once on the driver; tasks that encode open the tokenizers."""

    def __init__(self, a_json: str, b_model: bytes):
        self.sources = a_json, b_model
        self.open()
        sp = self.b
        letters = byte_letters()
        spelled = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in spelled.items()}
        pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        if any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in pieces):
            raise ValueError("a piece of this model crosses a white space mark or a line feed")
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)
        ]

        self.a_sizes = np.array([len(self.a_bytes.get(i, b"")) for i in range(max(self.a_bytes) + 1)], np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        # Names of ids as they stand in groups: inside a side, then at its end.
        self.b_names = 2 * len(self.a_sizes)
        names = [b"%d%c" % (i, c) for n, stop in ((len(self.a_sizes), b"|"), (len(pieces), b";")) for i in range(n) for c in (b",", stop)]
        self.names = np.frombuffer(b"".join(names), np.uint8)
        self.name_sizes = np.array([len(x) for x in names], np.int64)
        self.name_starts = np.cumsum(self.name_sizes) - self.name_sizes

    def open(self) -> "Tokens":
        a_json, b_model = self.sources
        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        return self

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("a", "b")}

    def spelling_only(self) -> "Tokens":
        """Without the tokenizers' files, which only encoding needs."""
        other = copy(self)
        other.sources = None
        return other

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that start with a space, which the library adds itself, or a line feed."""
        found = self.b.encode([t[1:] if t[:1] == " " else t for t in texts], num_threads=1)
        mark = self.b.piece_to_id(MARK)
        return [ids if t[:1] != " " and not t else ids[1:] if t[:1] != " " else ids or [mark] for t, ids in zip(texts, found)]

    def spelled_a(self, ids) -> bytes:
        return b"".join(map(self.a_bytes.__getitem__, ids))

    def spelled_b(self, ids) -> bytes:
        return b"".join(map(self.b_bytes.__getitem__, ids))

    def align(self, a_ids: list[int], b_ids: list[int]) -> tuple[bytes, int, np.ndarray]:
        """(groups as text, their number, linked pairs) of tokens that spell the same bytes."""
        m = Merged(self, np.array(a_ids, np.int64), np.array(b_ids, np.int64))
        return m.text()[:-1], len(m.common), m.pairs


class Merged:
    """Tokens of both sides over the same bytes, laid on one line of offsets."""

    def __init__(self, tokens: Tokens, a: np.ndarray, b: np.ndarray):
        self.tokens, self.a, self.b = tokens, a, b
        self.ends_a, self.ends_b = np.cumsum(tokens.a_sizes[a]), np.cumsum(tokens.b_sizes[b])
        #: Every offset where a token ends closes one link, of the tokens that lie before it.
        self.ends = np.union1d(self.ends_a, self.ends_b)
        first, second = np.searchsorted(self.ends_a, self.ends), np.searchsorted(self.ends_b, self.ends)
        self.pairs = a[first] * _A + b[second]
        self.common = self.ends_a[np.isin(self.ends_a, self.ends_b, assume_unique=True)]

    def text(self) -> bytes:
        """The groups, each with a semicolon after it."""
        t, n = self.tokens, len(self.a) + len(self.b)
        last_a, last_b = (np.isin(e, self.common, assume_unique=True) for e in (self.ends_a, self.ends_b))
        stops_a, stops_b = np.searchsorted(self.ends_a, self.common) + 1, np.searchsorted(self.ends_b, self.common) + 1
        group_a, group_b = np.searchsorted(self.common, self.ends_a), np.searchsorted(self.common, self.ends_b)
        entry = np.empty(n, np.int64)
        entry[np.arange(len(self.a)) + np.concatenate([[0], stops_b])[group_a]] = 2 * self.a + last_a
        entry[np.arange(len(self.b)) + stops_a[group_b]] = t.b_names + 2 * self.b + last_b
        lengths = t.name_sizes[entry]
        self.name_ends = np.cumsum(lengths)
        self.group_ends = self.name_ends[stops_a + stops_b - 1]
        at = np.repeat(t.name_starts[entry] - (self.name_ends - lengths), lengths) + np.arange(int(lengths.sum()))
        return t.names[at].tobytes()


class Words:
    """Closed fragments of distinct words; ids of words are places in the arrays."""

    def __init__(self, tokens: Tokens):
        self.tokens = tokens
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.chars = 0
        self.ok = np.empty(0, bool)
        self.n_a, self.n_b, self.n_groups, self.start, self.length = (np.empty(0, np.int64) for _ in range(5))
        self.pairs = np.empty(0, np.int64)

    def add(self, fresh: list[str]) -> None:
        # Words that end in white space, or hold a mark, could grow together with the next.
        plain = [w for w in fresh if not w[-1].isspace() and MARK not in w]
        odd = [w for w in fresh if w[-1].isspace() or MARK in w]
        for k in range(0, len(plain), ADDED_WORDS):
            if not self._add_joined(plain[k : k + ADDED_WORDS]):
                odd += plain[k : k + ADDED_WORDS]
        for word in odd:
            self._add_one(word)
        self.chars += sum(map(len, fresh))

    def _append(self, words: list[str], groups: list[bytes], pairs: np.ndarray, **columns) -> None:
        self.ids.update(zip(words, range(len(self.groups), len(self.groups) + len(words))))
        self.groups += groups
        columns["start"] = len(self.pairs) + np.cumsum(columns["length"]) - columns["length"]
        for name, values in columns.items():
            old = getattr(self, name)
            setattr(self, name, np.concatenate([old, np.asarray(values, old.dtype)]))
        self.pairs = np.concatenate([self.pairs, pairs])

    def _add_one(self, word: str) -> None:
        t, data = self.tokens, word.encode()
        (a,), (b,) = t.encode_a([word]), t.encode_b([word])
        ok = t.spelled_a(a) == data and t.spelled_b(b) == data
        groups, n, pairs = t.align(a, b) if ok else (b"", 0, np.empty(0, np.int64))
        sizes = {"n_a": [len(a)], "n_b": [len(b)], "n_groups": [n], "length": np.array([len(pairs)])}
        self._append([word], [groups], pairs, ok=[ok], **sizes)

    def _add_joined(self, words: list[str]) -> bool:
        """Encodes many words as few texts; false if they did not come apart again."""
        if not words:
            return True
        t, sizes = self.tokens, np.cumsum([len(w) for w in words])
        cuts = np.unique(np.searchsorted(sizes, np.arange(0, sizes[-1], JOINED_CHARS), side="right"))
        texts = ["".join(words[a:b]) for a, b in zip(cuts, [*cuts[1:], len(words)])]
        # One by one: a batch would hold the library's whole record of every token at once.
        a, b = (np.fromiter(chain.from_iterable(f([x])[0] for x in texts), np.int64) for f in (t.encode_a, t.encode_b))
        data = "".join(texts).encode()
        if t.spelled_a(a.tolist()) != data or t.spelled_b(b.tolist()) != data:
            return False
        m = Merged(t, a, b)
        stops = np.cumsum([len(w.encode()) for w in words])
        last = np.searchsorted(m.common, stops)
        if not np.array_equal(m.common[np.minimum(last, len(m.common) - 1)], stops):
            return False
        text = m.text()
        ends = m.group_ends[last].tolist()
        groups = [text[x : y - 1] for x, y in zip([0, *ends], ends)]
        counts = {
            name: np.diff(np.searchsorted(of, stops, side="right"), prepend=0)
            for name, of in (("n_a", m.ends_a), ("n_b", m.ends_b), ("n_groups", m.common), ("length", m.ends))
        }
        self._append(words, groups, m.pairs, ok=np.ones(len(words)), **counts)
        return True

    def of(self, texts: list[str]) -> list[np.ndarray]:
        """Word ids of each text; texts start with white space."""
        if len(self.groups) > TABLE_WORDS or self.chars > TABLE_CHARS:
            self.clear()
        cut = [WORD.findall(t) for t in texts]
        fresh = list(set(chain.from_iterable(cut)).difference(self.ids))
        if fresh:
            self.add(fresh)
        return [np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words)) for words in cut]

    def joined(self, ids: np.ndarray) -> bytes:
        return b";".join([self.groups[i] for i in ids.tolist()])

    def linked(self, owners: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct pairs, owner, place among them, times): the pairs of words, each word once for each owner."""
        both, times = np.unique(owners << 32 | ids, return_counts=True)
        owners, ids = both >> 32, both & 0xFFFFFFFF
        # Pairs are sorted for the distinct words only.
        words, which = np.unique(ids, return_inverse=True)
        n = self.length[words]
        ends = np.cumsum(n)
        found, place = np.unique(self.pairs[_runs(self.start[words], n)], return_inverse=True)
        return found, np.repeat(owners, n[which]), place[_runs((ends - n)[which], n[which])], np.repeat(times, n[which])


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every run, one run after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def _planes(values: np.ndarray) -> bytes:
    """Numbers under 2^32 by byte place, so that empty places compress."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their times."""
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(times, first) if len(keys) else times


def _slice_rows(documents: list[tuple], found: np.ndarray, owners: np.ndarray, place: np.ndarray, times: np.ndarray) -> list[tuple]:
    """Rows of ``ALIGNED`` for (doc_id, n_a, n_b, n_groups, n_links, sha256, groups) and their pairs."""
    keys, sums = _summed(owners * max(1, len(found)) + place, times)
    owner, place = np.divmod(keys, max(1, len(found)))
    edges = np.searchsorted(owner, np.arange(len(documents) + 1))
    name = uuid4().int >> 65
    out = []
    for document, low, high in zip(documents, edges, edges[1:]):
        steps = np.diff(place[low:high], prepend=0)
        out.append((name, *document, _planes(steps), _planes(sums[low:high]), None, None))
    if len(found):
        _, totals = _summed(place, sums)
        out.append((name, *[None] * 9, found.tolist(), totals.tolist()))
    return out


def _nothing(doc_id) -> tuple:
    return (None, doc_id, 0, 0, 0, 0, "", b"", b"", b"", None, None)


def _short(docs: DataFrame, tokens: Tokens, keep: bool) -> DataFrame:
    schema = _schema(ALIGNED)

    def run(batches):
        words = Words(tokens.open())
        for batch in slices(batches, "text", SLICE_BYTES):
            ids, texts = (batch.column(c).to_pylist() for c in ("doc_id", "text"))
            out, documents, owned = [], [], []
            cut = words.of([" " + t for t in texts if t])
            given = iter(cut)
            for doc_id, text in zip(ids, texts):
                found = next(given) if text else None
                if found is None or not words.ok[found].all():
                    out.append(_nothing(doc_id))
                    continue
                n_a, n_b, n = (int(x[found].sum()) for x in (words.n_a, words.n_b, words.n_groups))
                groups = words.joined(found)
                documents.append((doc_id, n_a, n_b, n, n_a + n_b - n, sha256(groups).hexdigest(), groups if keep else None))
                owned.append(found)
            if documents:
                owners = np.repeat(np.arange(len(owned)), [len(x) for x in owned])
                out += _slice_rows(documents, *words.linked(owners, np.concatenate(owned)))
            yield record_batch(out, schema)

    return docs.mapInArrow(run, ALIGNED)


def ranges(text: str, stretch: int = STRETCH) -> list[tuple[int, int, int, int]]:
    """(a_from, a_to, b_from, b_to) in characters, for every ``stretch`` bytes of a text."""
    out, a, b, at = [], 0, 0, 0
    data, done = text.encode(), 0
    while a < len(text) or b < len(text):
        part = data[done : done + stretch]
        while part and done + len(part) < len(data) and data[done + len(part)] & 0xC0 == 0x80:
            part = part[:-1]
        done, at = done + len(part), at + len(part.decode())
        next_a, next_b = a, b
        if at > a:
            next_a = m.start() if (m := A_CUT.search(text, at)) else len(text)
        if at > b:
            next_b = m.start() if (m := B_CUT.search(text, at)) else len(text)
        out.append((a, next_a, b, next_b))
        a, b = next_a, next_b
    return out


def _cut_long(docs: DataFrame, stretch: int) -> DataFrame:
    schema = _schema(RANGES)

    def run(batches):
        for batch in slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                text, key, out = " " + text, uuid4().bytes, []
                for k, (a, a_to, b, b_to) in enumerate(ranges(text, stretch)):
                    low = min(a, b)
                    window = text[low : max(a_to, b_to)]
                    out.append((key, doc_id, k, window, a - low, a_to - low, b - low, b_to - low))
                    if len(out) == FAN:
                        yield record_batch(out, schema)
                        out = []
                yield record_batch(out, schema)

    return docs.mapInArrow(run, RANGES)


class Fragment:
    """Open prefix, closed groups (none: ``closed`` is false and all is prefix), open suffix."""

    __slots__ = ("ok", "lead_a", "lead_b", "closed", "groups", "n_a", "n_b", "n_groups", "pairs", "counts", "tail_a", "tail_b")

    def __init__(self, ok=True, lead_a=(), lead_b=()):
        self.ok, self.lead_a, self.lead_b, self.closed = ok, list(lead_a), list(lead_b), False
        self.groups: list[bytes] = []
        self.n_a = self.n_b = self.n_groups = 0
        self.pairs, self.counts = [], []
        self.tail_a, self.tail_b = [], []

    def close(self, groups: bytes, n_a: int, n_b: int, n_groups: int, pairs, counts) -> None:
        """Adds closed groups after those that are there."""
        self.closed = True
        if n_groups:
            self.groups.append(groups)
        self.n_a, self.n_b, self.n_groups = self.n_a + n_a, self.n_b + n_b, self.n_groups + n_groups
        self.pairs.append(np.asarray(pairs, np.int64))
        self.counts.append(np.asarray(counts, np.int64))

    def seam(self, tokens: Tokens, a: list[int], b: list[int]) -> None:
        """Closes tokens that start and end at common offsets."""
        if self.ok and (a or b):
            groups, n, pairs = tokens.align(a, b)
            self.close(groups, len(a), len(b), n, pairs, np.ones(len(pairs)))

    def then(self, tokens: Tokens, other: "Fragment") -> "Fragment":
        """This fragment and the one after it."""
        self.ok = self.ok and other.ok
        if not other.closed:
            a, b = (self.tail_a, self.tail_b) if self.closed else (self.lead_a, self.lead_b)
            a += other.lead_a
            b += other.lead_b
        elif not self.closed:
            other.ok = self.ok
            other.lead_a, other.lead_b = self.lead_a + other.lead_a, self.lead_b + other.lead_b
            return other
        else:
            self.seam(tokens, self.tail_a + other.lead_a, self.tail_b + other.lead_b)
            self.groups += other.groups
            self.n_a, self.n_b, self.n_groups = self.n_a + other.n_a, self.n_b + other.n_b, self.n_groups + other.n_groups
            self.pairs += other.pairs
            self.counts += other.counts
            self.tail_a, self.tail_b = other.tail_a, other.tail_b
        return self

    def whole(self, tokens: Tokens) -> "Fragment":
        """With a document's start before it and its end after it, everything is closed."""
        start, end = Fragment(), Fragment()
        start.closed = end.closed = True
        return start.then(tokens, self).then(tokens, end)

    def linked(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.pairs:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return _summed(np.concatenate(self.pairs), np.concatenate(self.counts))

    def row(self) -> tuple:
        pairs, counts = self.linked()
        packed = (np.array(x, "<i8").tobytes() for x in (self.lead_a, self.lead_b, self.tail_a, self.tail_b))
        sizes = (self.n_a, self.n_b, self.n_groups)
        return (self.ok, self.closed, *packed, b";".join(self.groups), *sizes, pairs.tobytes(), counts.tobytes())

    @classmethod
    def read(cls, ok, closed, lead_a, lead_b, tail_a, tail_b, groups, n_a, n_b, n_groups, pairs, counts) -> "Fragment":
        unpacked = [np.frombuffer(x, "<i8").tolist() for x in (lead_a, lead_b, tail_a, tail_b)]
        f = cls(ok, *unpacked[:2])
        f.tail_a, f.tail_b = unpacked[2:]
        if closed:
            f.close(groups, n_a, n_b, n_groups, np.frombuffer(pairs, np.int64), np.frombuffer(counts, np.int64))
        return f


def fragment(words: Words, window: str, a_from: int, a_to: int, b_from: int, b_to: int) -> Fragment:
    """What one range gives: words that both sides have in full are closed, the rest is open."""
    t = words.tokens
    low, high = max(a_from, b_from), min(a_to, b_to)
    # Side A may be cut inside a word: both are closed only between cuts of side B.
    if 0 < low < len(window) and not B_CUT.match(window, low):
        low = m.start() if (m := B_CUT.search(window, low)) else high
    if low < high < len(window) and not B_CUT.match(window, high):
        high = max((m.start() for m in B_CUT.finditer(window, low, high)), default=low)

    def sided(encode, spelled, start: int, stop: int) -> tuple[list[int], bool]:
        part = window[start:stop]
        ids = encode([part])[0] if part else []
        return ids, spelled(ids) == part.encode()

    def a_side(start, stop):
        return sided(t.encode_a, t.spelled_a, start, stop)

    def b_side(start, stop):
        return sided(t.encode_b, t.spelled_b, start, stop)

    if low >= high:
        (a, ok_a), (b, ok_b) = a_side(a_from, a_to), b_side(b_from, b_to)
        return Fragment(ok_a and ok_b, a, b)
    (a, ok_a), (b, ok_b) = a_side(a_from, low), b_side(b_from, low)
    f = Fragment(ok_a and ok_b, a, b)
    found = words.of([window[low:high]])[0]
    f.ok = f.ok and bool(words.ok[found].all())
    pairs, _, place, times = words.linked(np.zeros(len(found), np.int64), found)
    sizes = (int(x[found].sum()) for x in (words.n_a, words.n_b, words.n_groups))
    f.close(words.joined(found), *sizes, pairs[place], times)
    (f.tail_a, ok_a), (f.tail_b, ok_b) = a_side(high, a_to), b_side(high, b_to)
    f.ok = f.ok and ok_a and ok_b
    return f


def _fragments(cut: DataFrame, tokens: Tokens) -> DataFrame:
    schema = _schema(FRAGMENTS)

    def run(batches):
        words = Words(tokens.open())
        for batch in slices(batches, "window"):
            out = []
            for key, doc_id, at, *place in zip(*(c.to_pylist() for c in batch.columns)):
                out.append((key, doc_id, at, *fragment(words, *place).row()))
            yield record_batch(out, schema)

    return cut.mapInArrow(run, FRAGMENTS)


def _in_order(tokens: Tokens, batches, fan: int | None):
    """Lists of (key, doc_id, block, fragment): fragments of one document and block, composed in order."""
    current, held = None, None
    for batch in slices(batches, "groups"):
        done = []
        for key, doc_id, at, *values in zip(*(c.to_pylist() for c in batch.columns)):
            f, here = Fragment.read(*values), (key, doc_id, at // fan if fan else 0)
            if here != current:
                if current is not None:
                    done.append((*current, held))
                current, held = here, f
            else:
                held = held.then(tokens, f)
        yield done
    if current is not None:
        yield [(*current, held)]


def _composed(fragments: DataFrame, tokens: Tokens) -> DataFrame:
    """Blocks of ``FAN`` fragments."""
    schema = _schema(FRAGMENTS)

    def run(batches):
        for done in _in_order(tokens, batches, FAN):
            yield record_batch([(key, doc_id, at, *f.row()) for key, doc_id, at, f in done], schema)

    dealt = fragments.repartition("key", F.floor(F.col("at") / FAN))
    return dealt.sortWithinPartitions("key", "at").mapInArrow(run, FRAGMENTS)


def _finished(blocks: DataFrame, tokens: Tokens, keep: bool) -> DataFrame:
    """Whole documents from their blocks."""
    schema = _schema(ALIGNED)

    def run(batches):
        for done in _in_order(tokens, batches, None):
            out, documents, pairs, times = [], [], [], []
            for _, doc_id, _, f in done:
                if not f.ok:
                    out.append(_nothing(doc_id))
                    continue
                f = f.whole(tokens)
                groups, n_links = b";".join(f.groups), f.n_a + f.n_b - f.n_groups
                documents.append(
                    (doc_id, f.n_a, f.n_b, f.n_groups, n_links, sha256(groups).hexdigest(), groups if keep else None)
                )
                linked, counted = f.linked()
                pairs.append(linked)
                times.append(counted)
            if documents:
                owners = np.repeat(np.arange(len(documents)), [len(p) for p in pairs])
                found, place = np.unique(np.concatenate(pairs), return_inverse=True)
                out += _slice_rows(documents, found, owners, place, np.concatenate(times))
            yield record_batch(out, schema)

    return blocks.repartition("key").sortWithinPartitions("key", "at").mapInArrow(run, ALIGNED)


def _weighed(aligned: DataFrame, values: DataFrame) -> DataFrame:
    """Documents with the sums over their links, from the values of their slice's pairs."""
    schema = _schema(RESULT)

    def run(batches):
        current, totals, best = None, None, None
        for batch in slices(batches, "places"):
            out = []
            for name, weights, doc_id, n_a, n_b, n, links, digest, groups, places, times in zip(
                *(batch.column(c).to_pylist() for c in ("slice", "values", *DOCUMENT, "groups_sha256", "groups", "places", "times"))
            ):
                if weights is not None:
                    weights = np.array(weights, np.int64)
                    current, totals, best = name, weights >> 1, weights & 1
                    continue
                found, n_times = np.cumsum(_unplaned(places)), _unplaned(times)
                if name != current and len(found):
                    raise ValueError("a slice without its pairs")
                n_best = int((n_times * best[found]).sum()) if len(found) else 0
                counted = int((n_times * totals[found]).sum()) if len(found) else 0
                out.append((doc_id, n_a, n_b, n, links, n_best, counted, digest, groups))
            yield record_batch(out, schema)

    documents = aligned.filter("found IS NULL AND slice IS NOT NULL").drop("found", "counts")
    both = values.unionByName(documents, allowMissingColumns=True)
    return both.repartition("slice").sortWithinPartitions("slice", F.col("values").isNull()).mapInArrow(run, RESULT)


def align(docs: DataFrame, a_json: str, b_model: bytes, keep_groups: bool = False, stretch: int = STRETCH) -> tuple[DataFrame, DataFrame]:
    """Documents with their groups and links, and the id pairs with their counts.

    ``a_json`` is a byte-level tokenizer's file, read with a space before each text;
    ``b_model`` a SentencePiece model, which adds that space.  The first result has, for
    every row of ``docs``, ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``,
    ``n_best`` (links whose pair has the highest count of its B id, ties included),
    ``count_sum`` and ``groups_sha256``, and with ``keep_groups`` the ``groups`` themselves
    (``a1,a2|b1;...`` in bytes).  The second has ``a``, ``b`` and ``n``.  A null or empty
    text, or one that a side does not spell as it is, has no tokens: zeros and ''.  A null
    id is kept, repeated rows count and appear as often as they are there, other columns
    are ignored, an empty table gives empty results.  Very long texts are cut into ranges
    of ``stretch`` bytes, which changes no result; white space is needed to cut side B.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark, "alignment")
    rows = ids_and_texts(docs)
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    tokens = Tokens(a_json, b_model)
    spelling = tokens.spelling_only()
    _short(rows.filter(size < stretch), tokens, keep_groups).write.parquet(f"{folder}/short")
    # Written, since each long text gets a new key when it is cut.
    _cut_long(rows.filter(size >= stretch), stretch).write.parquet(f"{folder}/ranges")
    cut = spark.read.schema(RANGES).parquet(f"{folder}/ranges").repartition("key", "at")
    blocks = _composed(_fragments(cut, tokens), spelling)
    _finished(blocks, spelling, keep_groups).write.parquet(f"{folder}/long")
    aligned = spark.read.schema(ALIGNED).parquet(f"{folder}/short", f"{folder}/long")

    listed = aligned.filter("found IS NOT NULL").select("slice", F.posexplode(F.arrays_zip("found", "counts")).alias("at", "x"))
    listed = listed.select("slice", "at", F.col("x.found").alias("pair"), F.col("x.counts").alias("n"))
    listed.groupBy("pair").agg(F.sum("n").alias("n")).write.parquet(f"{folder}/pairs")
    counted = spark.read.schema("pair bigint, n bigint").parquet(f"{folder}/pairs")
    # One row for each id of side B, at most: bounded by its vocabulary.
    most = F.broadcast(counted.groupBy((F.col("pair") % _A).alias("b")).agg(F.max("n").alias("most")))
    value = (2 * F.col("n") + (F.col("n") == F.col("most")).cast("bigint")).alias("value")
    valued = counted.join(most, F.col("pair") % _A == F.col("b")).select("pair", value)
    per_slice = listed.select("slice", "at", "pair").join(valued, "pair").groupBy("slice")
    values = per_slice.agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("sorted")).select("slice", F.col("sorted.value").alias("values"))
    found = _weighed(aligned, values)
    without = aligned.filter("slice IS NULL").select(
        *DOCUMENT, F.lit(0).cast("bigint").alias("n_best"), F.lit(0).cast("bigint").alias("count_sum"), "groups_sha256", "groups"
    )
    result = found.unionByName(without)
    pairs = counted.select(F.floor(F.col("pair") / _A).alias("a"), (F.col("pair") % _A).alias("b"), "n")
    return (result if keep_groups else result.drop("groups")), pairs
