"""SentencePiece encoding and decoding through a table of distinct chunks.

The library marks every space with U+2581 and puts one mark before the text.  When no
piece of the vocabulary holds a mark after another character, no merge can reach over
the start of a run of marks, so a text falls into chunks (a run of marks and what
follows it) that are segmented independently.  Each task keeps a table from chunk to
ids; a chunk is segmented once, and the ids of a document are the table's entries
joined in order of position.  Decoding spells all ids of a row batch at once.  A line feed that is in no piece cuts
texts in the same way as a mark.  Nothing is shuffled: a table of the
whole corpus would have to be joined back to every position, which moves more data
than segmenting frequent words once per task costs.
"""

import re
from array import array

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from .common import arrow_schema, ids_and_texts, slices

MARK = "▁"
#: A run of marks or of line feeds, and what follows it.
CHUNK = re.compile(f"(?:{MARK}+|\n+)[^{MARK}\n]*")
#: Longer chunks are segmented where they occur and not kept.
KEPT_CHARS = 512
#: The table is emptied when it holds this many characters, counting 64 for each entry.
TABLE_CHARS = 32 << 20
SCHEMA = "doc_id bigint, n_tokens bigint, ids array<int>, decoded string"


class ChunkTable:
    """Ids (packed 32-bit) of each distinct chunk met so far."""

    def __init__(self, model: bytes, limit: int = TABLE_CHARS):
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.limit, self.held = limit, 0
        self.entries: dict[str, bytes] = {}
        pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        if any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in pieces):
            raise ValueError("a piece of this model crosses a white space mark or a line feed")
        self.mark = sp.piece_to_id(MARK)
        if sp.encode("a  b \nc") != sum(self._segment([f"{MARK}a", f"{MARK * 2}b", MARK, "\nc"]), []):
            raise ValueError("this model does not keep white space as it is")
        spelled = [
            bytes([int(p[3:5], 16)]) if sp.is_byte(i)
            else sp.decode([i]).encode() if sp.is_unknown(i)
            else b"" if sp.is_control(i)
            else p.replace(MARK, " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.letters = np.frombuffer(b"".join(spelled), np.uint8)
        self.lengths = np.array([len(x) for x in spelled], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def _segment(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks; the library puts a mark before every text but an empty one."""
        found = self.sp.encode([c[1:].replace(MARK, " ") if c[0] == MARK else c for c in chunks], num_threads=1)
        return [
            ids[1:] if c[0] != MARK else ids if len(c) > 1 else [self.mark]
            for c, ids in zip(chunks, found)
        ]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of whole texts."""
        if self.held > self.limit:
            self.entries.clear()
            self.held = 0
        cut = [CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        fresh = list(set().union(*cut).difference(self.entries))
        long = {}
        for chunk, ids in zip(fresh, self._segment(fresh) if fresh else []):
            packed = array("i", ids).tobytes()
            if len(chunk) > KEPT_CHARS:
                long[chunk] = packed
            else:
                self.entries[chunk] = packed
                self.held += len(chunk) + 64
        look_up = self.entries.__getitem__
        if long:
            return [b"".join(long[c] if c in long else look_up(c) for c in chunks) for chunks in cut]
        return [b"".join(map(look_up, chunks)) for chunks in cut]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of consecutive runs of ids, ``counts`` long; the first mark of a run is the library's own."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        shift = np.repeat(self.starts[ids] - (ends - lengths), lengths)
        spelled = self.letters[shift + np.arange(len(shift))].tobytes()
        stops = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [spelled[a + 1 : b].decode("utf-8", "replace") for a, b in zip(stops, stops[1:])]


def encode_decode(docs: DataFrame, model: bytes) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` and ``decoded`` of every row of ``docs``.

    ``model`` is the content of a SentencePiece model file (bounded: one vocabulary).
    Ids are those of the library without begin and end ids.  A null text counts as
    empty and gives no ids and an empty text; a null id is kept; repeated rows give
    repeated results; other columns are ignored; an empty table gives an empty result.
    """
    schema = arrow_schema(SCHEMA)

    def run(batches):
        table = ChunkTable(model)
        for batch in slices(batches):
            packed = table.encode([t or "" for t in batch.column("text").to_pylist()])
            counts = np.array([len(x) // 4 for x in packed], dtype=np.int64)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            values = np.frombuffer(b"".join(packed), dtype=np.int32)
            decoded = table.decode(values, counts)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts), ids, pa.array(decoded, pa.string())], schema=schema
            )

    return ids_and_texts(docs).mapInArrow(run, SCHEMA)


def digests(encoded: DataFrame) -> DataFrame:
    """The compared columns of ``encode_decode``: counts and digests."""
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()
