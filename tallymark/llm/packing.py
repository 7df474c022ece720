"""Token ids in packed sequences: best-fit-decreasing with a segment tree over capacities.

Every text becomes token ids of a public byte-level vocabulary, with an end token after it.
Documents over the sequence length are split into pieces of that length and a rest; nothing is
cut off, and the pieces say where in their document they start.  Pieces go, longest first,
into the fullest sequence that still has room.  A segment tree over remaining capacities
finds it in logarithmic time, whatever the number of open sequences.

A task packs its own rows in blocks of about ``BLOCK_TOKENS`` tokens: no shuffle, and memory is that
of one block and one document.  A block leaves at most its last few sequences half full.

One row is one sequence: its ids as little-endian integers padded to the length (a row of the packed
matrix), the cumulative segment lengths from 0 on, the positions, which start again at 0 in each
segment, and document and first token of each segment.  ``unpack`` reads the texts back.

* null and empty texts have no tokens and stand in no sequence
* rows with equal ``doc_id``, and null ids, are documents of their own when packed
* control strings of the vocabulary inside texts are ordinary text
* an empty table: no sequence; other columns are ignored
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.scratch import short_batches
from tallymark.llm.textscan import chunks

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The id after the last of the vocabulary, free for the end of a document.
END = 50256
LENGTH = 2048
BLOCK_TOKENS = 4 << 20
#: Characters handed to the tokenizer at once; a longer text is cut before white space, where no token crosses.
PIECE_CHARS = 1 << 16

PACKED = (
    "shard int, block int, sequence int, n_tokens int, input_ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, doc_starts array<long>, is_last array<boolean>"
)


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Capacities:
    """Open sequences by room left; a tree of counts over the rooms 0 to ``length``."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.filled = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        at = room + self.size
        while at:
            self.filled[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The sequence with the least room that is at least ``need``, and that room."""
        filled = self.filled
        at = need + self.size
        if not filled[at]:
            # up to the first ancestor with something to its right, then down to the leftmost leaf there
            while at > 1 and (at & 1 or not filled[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at <<= 1
                if not filled[at]:
                    at += 1
        room = at - self.size
        while at:
            filled[at] -= 1
            at >>= 1
        return self.open[room].pop(), room


def best_fit_decreasing(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Numbers of the pieces in each sequence, the longest piece first; ties in order of the input."""
    order = np.argsort(-sizes, kind="stable")
    tree, out = Capacities(length), []
    for i in order.tolist():
        size = int(sizes[i])
        if not 0 < size <= length:
            raise ValueError("a piece has 1 to length tokens")
        found = tree.take(size)
        if found is None:
            out.append([i])
            place, room = len(out) - 1, length
        else:
            place, room = found
            out[place].append(i)
        if room > size:
            tree.add(room - size, place)
    return out


def _pieces_of(text: str, most: int = PIECE_CHARS) -> Iterator[str]:
    """The text in parts whose tokens are those of the whole: cut where a space follows a letter and goes before one."""
    at = 0
    while len(text) - at > most:
        cut = at + most
        while cut < len(text) and not (text[cut] == " " and text[cut - 1].isalpha() and cut + 1 < len(text) and text[cut + 1].isalpha()):
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def token_ids(text: str, path: str = VOCABULARY) -> np.ndarray:
    known = encoding(path)
    if len(text) <= PIECE_CHARS:
        return np.array([*known.encode_ordinary(text), END], dtype=np.int32)
    return np.concatenate([*(np.array(known.encode_ordinary(p), dtype=np.int32) for p in _pieces_of(text)), np.array([END], dtype=np.int32)])


def _pack_block(pieces: list[tuple], length: int, kind: str, at: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    sizes = np.array([len(p[0]) for p in pieces])
    rows: list[tuple] = []
    pad = np.zeros(length, dtype=kind)
    for number, own in enumerate(best_fit_decreasing(sizes, length)):
        ends = np.cumsum([0, *sizes[own]]).astype(np.int32)
        ids, positions = pad.copy(), pad.copy()
        for i, a, b in zip(own, ends[:-1], ends[1:], strict=True):
            ids[a:b] = pieces[i][0]
            positions[a:b] = np.arange(b - a)
        rows.append((*at, number, int(ends[-1]), ids.tobytes(), ends, positions.tobytes(), *([pieces[i][k] for i in own] for k in (1, 2, 3))))
        if len(rows) == 512:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32()] * 4 + [pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in PACKED.split(", ")])


def id_type(largest: int) -> str:
    return "<u2" if largest < 1 << 16 else "<i4"


def _pack(length: int, path: str, block_tokens: int):
    kind = id_type(max(END, length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, held = TaskContext.get().partitionId(), 0, 0
        pieces: list[tuple] = []
        for batch in chunks(batches, "text"):
            for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                said = text.as_py()
                if not said:
                    continue
                ids = token_ids(said, path).astype(kind)
                for start in range(0, len(ids), length):
                    pieces.append((ids[start : start + length], doc.as_py(), start, start + length >= len(ids)))
                    held += min(length, len(ids) - start)
                    if held >= block_tokens:
                        yield from _pack_block(pieces, length, kind, (shard, block))
                        pieces, held, block = [], 0, block + 1
        if pieces:
            yield from _pack_block(pieces, length, kind, (shard, block))

    return run


def pack(docs: DataFrame, length: int = LENGTH, path: str = VOCABULARY, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The packed sequences of ``docs (doc_id, text)``, one a row; ``df.write.parquet`` stores the matrices."""
    if not 0 < length < 1 << 16:
        raise ValueError("a sequence has 1 to 65535 tokens")
    short_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pack(length, path, block_tokens), PACKED)


def segments(packed: DataFrame) -> DataFrame:
    """``doc_id, start, n, is_last, ids`` of every segment of :func:`pack`; ``ids`` are little-endian integers."""
    width = F.when(F.length("input_ids") == 0, 0).otherwise(2 if id_type(END) == "<u2" else 4)
    each = packed.select("input_ids", "cu_seqlens", F.posexplode(F.arrays_zip("doc_ids", "doc_starts", "is_last")).alias("i", "s"))
    first, after = F.expr("cu_seqlens[i]"), F.expr("cu_seqlens[i + 1]")
    return each.select(
        F.col("s.doc_ids").alias("doc_id"),
        F.col("s.doc_starts").alias("start"),
        (after - first).alias("n"),
        F.col("s.is_last").alias("is_last"),
        F.substring("input_ids", first * width + 1, (after - first) * width).alias("ids"),
    )


def decode(ids: bytes, path: str = VOCABULARY) -> str:
    """The text of a whole document's ids, without its end token."""
    numbers = np.frombuffer(ids, dtype=id_type(END))
    return encoding(path).decode(numbers[numbers != END].tolist())


def unpack(packed: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``doc_id, text`` of every packed document; the ids must be unique."""
    whole = segments(packed).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "ids"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode(b"".join(p["ids"] for p in parts), path) for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return whole.mapInArrow(run, "doc_id long, text string")
