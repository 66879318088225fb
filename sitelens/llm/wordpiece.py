"""Token counts by a linear longest-match automaton.

Greedy word-piece segmentation takes the longest piece that starts a word, then the
longest continuation pieces.  The automaton is a trie of both kinds of pieces; a
failure link says where to go on when a character has no edge, after popping the
pieces that greedy matching would have fixed by then.  Only their number matters
here, so each node stores a count: a word is read once, character by character, and
no piece is ever built.
"""

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_schema, ids_and_texts, slices

#: Distinct words a task remembers before it forgets them all.
MEMO_WORDS = 1 << 18
MEMO_CHARS = 64
SCHEMA = "doc_id bigint, n_words bigint, n_tokens bigint, n_unknown bigint"
NOWHERE = -1


class LongestMatch:
    """Trie with failure links; node 0 starts a word, node 1 starts a continuation."""

    def __init__(self, initial: set[str], following: set[str]):
        self.edges: list[dict[str, int]] = [{}, {}]
        final = [False, False]
        for root, pieces in ((0, initial), (1, following)):
            for piece in sorted(p for p in pieces if p):
                node = root
                for c in piece:
                    nxt = self.edges[node].get(c)
                    if nxt is None:
                        nxt = len(self.edges)
                        self.edges[node][c] = nxt
                        self.edges.append({})
                        final.append(False)
                    node = nxt
                final[node] = True
        self.fail = [NOWHERE] * len(self.edges)
        self.pops = [0] * len(self.edges)
        queue = deque([0, 1])
        while queue:
            parent = queue.popleft()
            for c, node in self.edges[parent].items():
                queue.append(node)
                if final[node]:
                    # The whole string is a piece: pop it, continue after it.
                    self.fail[node], self.pops[node] = 1, 1
                    continue
                at, popped = self.fail[parent], self.pops[parent]
                while at != NOWHERE and c not in self.edges[at]:
                    popped += self.pops[at]
                    at = self.fail[at]
                if at != NOWHERE:
                    self.fail[node], self.pops[node] = self.edges[at][c], popped

    def count(self, word: str) -> int:
        """Number of pieces of ``word``; 0 when greedy matching gets stuck."""
        edges, fail, pops = self.edges, self.fail, self.pops
        node, popped = 0, 0
        for c in word:
            nxt = edges[node].get(c)
            while nxt is None:
                popped += pops[node]
                node = fail[node]
                if node == NOWHERE:
                    return 0
                nxt = edges[node].get(c)
            node = nxt
        while node != 1:
            popped += pops[node]
            node = fail[node]
            if node == NOWHERE:
                return 0
        return popped


def marked_vocabulary(pieces: list[str], mark: str = "▁") -> tuple[set[str], set[str]]:
    """Word starts and continuations of a vocabulary that marks word starts."""
    initial = {p[1:] for p in pieces if p.startswith(mark) and mark not in p[1:] and len(p) > 1}
    return initial, {p for p in pieces if mark not in p}


def count_tokens(docs: DataFrame, initial: set[str], following: set[str]) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_tokens``, ``n_unknown`` of every row of ``docs``.

    Words are split at ASCII white space.  A word that greedy matching cannot finish is
    one unknown token.  A null or empty text has no words and no tokens; null ids and
    repeated rows give a result each; other columns are ignored.
    """
    schema = arrow_schema(SCHEMA)

    def run(batches):
        automaton = LongestMatch(initial, following)
        memo: dict[bytes, int] = {}
        for batch in slices(batches):
            out = []
            for text in batch.column("text").to_pylist():
                words = (text or "").encode().split()
                tokens = unknown = 0
                for word in words:
                    n = memo.get(word)
                    if n is None:
                        n = automaton.count(word.decode())
                        if len(word) <= MEMO_CHARS:
                            if len(memo) >= MEMO_WORDS:
                                memo.clear()
                            memo[word] = n
                    tokens += n
                    unknown += n == 0
                out.append((len(words), tokens + unknown, unknown))
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")] + [pa.array(c, pa.int64()) for c in columns], schema=schema
            )

    return ids_and_texts(docs).mapInArrow(run, SCHEMA)
