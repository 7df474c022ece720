"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

Texts are lower-cased (A-Z) and cut into runs of digits, letters a-z and characters beyond
ASCII.  Every run of ``n`` words of a test item is a window; a shorter item is one window.  The
set of window hashes, with the windows' words, goes to the executors; each document's windows
are looked up in it, and a hit counts only if its words are the same.  A word inside any
occurrence of a window is hit.

The set is bounded: ``WINDOWS_AT_ONCE`` windows.  A larger benchmark is cut into blocks of
items; each block passes over the documents with a set of its own, and what the blocks found
meets by document.  All items are always compared.

* null or empty text: no words, never contaminated
* an item with null or wordless text has no window; one with null ``item_id`` takes no part
* repeated items or windows: each item counts by itself; equal ``item_id``s count once
* rows with equal ``doc_id`` are judged one by one
* other columns are ignored
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.scratch import short_batches, written
from tallymark.llm.textscan import BASES, LOWER, WORD_BYTES, Runs, Words, buffer_of, chunks, signed

NGRAM = 10
#: At most so many windows are broadcast at once: about 250 MB on an executor.
WINDOWS_AT_ONCE = 1_000_000


def _words(column: pa.Array) -> Words:
    data, offsets = buffer_of(column)
    return Words(LOWER[data], offsets, WORD_BYTES)


def _item_windows(n: int):
    """``(item_id, size, hash, words)`` of every window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            words = _words(batch.column("text"))
            runs = Runs(words.hashes(), BASES[0])
            count = words.counts()
            size = np.minimum(count, n)
            many = np.where(count > 0, count - size + 1, 0)
            row = np.repeat(np.arange(len(count)), many)
            start = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + words.first[row]
            end = start + size[row]
            said = [b" ".join(words.word(j) for j in range(a, b)) for a, b in zip(start, end, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("item_id").take(pa.array(row)),
                    pa.array(size[row].astype(np.int32)),
                    pa.array(signed(runs.of(start, end))),
                    pa.array(said, pa.binary()),
                ],
                ["item_id", "size", "hash", "words"],
            )

    return run


class WindowSet:
    """Windows by hash; the words of each and the items that hold it."""

    def __init__(self, rows: list[tuple]):
        by_words: dict[tuple[int, int, bytes], set[str]] = {}
        for item, size, h, words in rows:
            by_words.setdefault((size, h, bytes(words)), set()).add(item)
        self.sizes: dict[int, np.ndarray] = {}
        self.entries: dict[tuple[int, int], list[tuple[bytes, tuple[str, ...]]]] = {}
        for (size, h, words), items in by_words.items():
            self.entries.setdefault((size, h), []).append((words, tuple(items)))
        for size in {s for s, _ in self.entries}:
            self.sizes[size] = np.sort(np.array([h for s, h in self.entries if s == size], dtype=np.int64))

    def find(self, words: Words) -> Iterator[tuple[int, int, tuple[str, ...]]]:
        """First word, size and items of every occurrence."""
        runs, text = Runs(words.hashes(), BASES[0]), words.texts()
        for size, known in self.sizes.items():
            h = signed(runs.every(size))
            place = np.minimum(np.searchsorted(known, h), len(known) - 1)
            for i in np.flatnonzero((known[place] == h) & (text[: len(h)] == text[size - 1 :][: len(h)])):
                said = b" ".join(words.word(j) for j in range(i, i + size))
                for own, items in self.entries[size, int(h[i])]:
                    if own == said:
                        yield int(i), size, items


def _scan(share):
    """``(doc_id, k, n_words, spans, items, text)`` of each document; spans are runs of hit words ``(first, end)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = share.value
        for batch in chunks(batches, "text"):
            words = _words(batch.column("text"))
            text, edge = words.texts(), np.zeros(len(words) + 1, dtype=np.int64)
            items: list[set[str]] = [set() for _ in range(batch.num_rows)]
            for first, size, own in known.find(words):
                edge[first] += 1
                edge[first + size] -= 1
                items[text[first]].update(own)
            hit = np.cumsum(edge[:-1]) > 0
            spans = []
            for i, own in enumerate(items):
                a, b = words.first[i], words.first[i + 1]
                turns = np.flatnonzero(np.diff(np.r_[False, hit[a:b], False])) if own else np.empty(0, np.int64)
                spans.append([int(x) for x in turns])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in batch.schema.names if c != "text"),
                    pa.array(words.counts().astype(np.int64)),
                    pa.array(spans, pa.list_(pa.int32())),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                ],
                [*(c for c in batch.schema.names if c != "text"), "n_words", "spans", "items"],
            )

    return run


def _merge(n_words: int, spans: list, items: list) -> tuple[int, int, str]:
    edge = np.zeros(n_words + 1, dtype=np.int64)
    for own in spans:
        np.add.at(edge, own[0::2], 1)
        np.add.at(edge, own[1::2], -1)
    ids = sorted({x for own in items for x in own})
    return int((np.cumsum(edge) > 0).sum()), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest()


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, items, counts = (batch.column(c).to_pylist() for c in ("spans", "items", "n_words"))
        found = [_merge(n, s or [], i or []) for n, s, i in zip(counts, spans, items, strict=True)]
        hit, n_items, digest = zip(*found, strict=True) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("n_words"),
                pa.array(hit, pa.int64()),
                pa.array(n_items, pa.int64()),
                pa.array(digest, pa.string()),
                pa.array([h > 0 for h in hit], pa.bool_()),
            ],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def window_table(benchmark: DataFrame, n: int = NGRAM) -> DataFrame:
    texts = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    return texts.mapInArrow(_item_windows(n), "item_id string, size int, hash long, words binary")


def _sets(benchmark: DataFrame, n: int, at_once: int) -> Iterator[WindowSet]:
    """The windows in sets of about ``at_once`` at most, one after the other; one empty set if there is none."""
    windows = written(window_table(benchmark, n), "windows")
    total = windows.count()
    blocks = 1 if total <= at_once else -(-total * 5 // (at_once * 4))
    block = F.pmod(F.xxhash64("size", "hash", "words"), F.lit(blocks))
    for i in range(blocks):
        yield WindowSet([tuple(r) for r in windows.where(block == i).collect()])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("doc_id", "text").alias("k1"),
        F.xxhash64("text", F.lit(1), "doc_id").alias("k2"),
        "text",
    )


def find_windows(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, at_once: int = WINDOWS_AT_ONCE) -> DataFrame:
    """``doc_id, k1, k2, n_words, spans, items`` of ``docs (doc_id, text)``: the last two have a list for each block that found something."""
    spark = docs.sparkSession
    short_batches(spark)
    texts = _keyed(docs)
    schema = "doc_id long, k1 long, k2 long, n_words long, spans array<int>, items array<string>"
    sets = _sets(benchmark, n, at_once)
    one, two = next(sets), next(sets, None)
    if two is None:
        found = texts.mapInArrow(_scan(spark.sparkContext.broadcast(one)), schema)
        return found.withColumns({"spans": F.array("spans"), "items": F.array("items")})
    hits = None
    for each in (x for group in ((one, two), sets) for x in group):
        share = spark.sparkContext.broadcast(each)
        own = written(texts.mapInArrow(_scan(share), schema).where(F.size("items") > 0).select("k1", "k2", "spans", "items"), "hits")
        share.unpersist()
        hits = own if hits is None else hits.unionByName(own)
    merged = hits.groupBy("k1", "k2").agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
    counted = texts.mapInArrow(_scan(spark.sparkContext.broadcast(WindowSet([]))), schema).drop("spans", "items")
    return counted.join(merged, ["k1", "k2"], "left").select("doc_id", "k1", "k2", "n_words", "spans", "items")


def report(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, at_once: int = WINDOWS_AT_ONCE) -> DataFrame:
    """One row per document: how many words are hit, by how many items, and by which (as a digest)."""
    found = find_windows(docs, benchmark, n, at_once).select("doc_id", "n_words", "spans", "items")
    return found.mapInArrow(_report, REPORT)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        words = _words(batch.column("text"))
        texts = []
        for i, (text, spans) in enumerate(zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True)):
            cuts = sorted((a, b) for own in spans or [] for a, b in zip(own[0::2], own[1::2], strict=True))
            if not cuts:
                texts.append(text.as_py())
                continue
            raw, _ = buffer_of(batch.column("text").slice(i, 1))
            low = int(buffer_of(batch.column("text").slice(0, i))[1][-1]) if i else 0
            keep, at = [], 0
            for a, b in cuts:
                start, end = (int(words.starts[words.first[i] + a]) - low, int(words.ends[words.first[i] + b - 1]) - low)
                keep.append(raw[at : max(at, start)].tobytes())
                at = max(at, end)
            texts.append(b"".join([*keep, raw[at:].tobytes()]).decode())
        yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string())).drop_columns(["spans"])


def remove_hits(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, at_once: int = WINDOWS_AT_ONCE) -> DataFrame:
    """``docs (doc_id, text)`` with the hit words cut out of their texts, all else unchanged; a null text stays null."""
    found = find_windows(docs, benchmark, n, at_once).where(F.size("items") > 0).select("k1", "k2", "spans").dropDuplicates(["k1", "k2"])
    joined = _keyed(docs).join(found, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_removed, "doc_id long, text string")


def _clean_only(share):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = share.value
        for batch in chunks(batches, "text"):
            words = _words(batch.column("text"))
            text, clean = words.texts(), np.ones(batch.num_rows, dtype=bool)
            for first, _, _ in known.find(words):
                clean[text[first]] = False
            yield batch.filter(pa.array(clean))

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, at_once: int = WINDOWS_AT_ONCE) -> DataFrame:
    """Rows of ``docs`` without a hit word, all columns as they are; nothing is shuffled.

    Of a large benchmark each block drops its own documents, one block after the other.
    """
    short_batches(docs.sparkSession)
    sets = _sets(benchmark, n, at_once)
    left, following = docs, next(sets)
    while following is not None:
        each, following = following, next(sets, None)
        left = left.mapInArrow(_clean_only(docs.sparkSession.sparkContext.broadcast(each)), docs.schema)
        if following is not None:
            left = written(left, "clean")
    return left
