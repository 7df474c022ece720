"""Substring dedup by seed and extend.

Every window of ``length`` words chooses one of its runs of ``seed`` words, the first with the
smallest hash (winnowing), so equal windows choose equal seeds at equal places.  Documents are
joined on these seeds; what is alone in its document goes no further.  A seed that repeats is
extended both ways over all windows that chose it: its *stretch*.  Occurrences with equal
stretches form a class, and all but those in the class's first document are repeats as a whole.
Only where one seed has several classes (at the edges of a repeat, or around an edit) are the
single windows of the classes' first documents compared.  So a passage shared by ``n``
documents costs work in proportion to ``n``, not to its square, and no window is left out.
Neighbouring and overlapping repeats make up the maximal repeats that are cut.

The result is that of comparing all windows, up to collisions of 128-bit hashes.

* null text: no words; an empty or blank text: no words; both come out with ``n_words`` 0
* fewer than ``length`` words: nothing is removed
* null ``doc_id``: the row comes out unchanged and takes words from no other row
* rows with equal ``doc_id``: one document; neither is earlier than the other
* other columns of the input are ignored
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.scratch import short_batches, written
from tallymark.llm.textscan import BASES, NON_SPACE, Runs, Words, buffer_of, chunks, first_minimum, signed

LENGTH = 50
SEED = 16
KEY = ["k1", "k2"]


def _keyed(docs: DataFrame) -> DataFrame:
    """Two hashes that tell rows apart; they are never null, so joins on them keep the scan as it is."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        F.xxhash64("doc_id", "text").alias("k1"),
        F.xxhash64("text", F.lit(1), "doc_id").alias("k2"),
    )


class _Seeds:
    """Windows of some texts and the seed that each of them chose."""

    def __init__(self, batch: pa.RecordBatch, length: int, seed: int):
        self.words = Words(*buffer_of(batch.column("text")), NON_SPACE)
        hashes = self.words.hashes()
        self.runs = [Runs(hashes, base) for base in BASES]
        self.seeds = self.runs[0].every(seed)
        chosen = first_minimum(self.seeds, length - seed + 1)
        text = self.words.texts()
        same = text[: len(chosen)] == text[length - 1 :] if len(chosen) else np.empty(0, bool)
        self.windows = np.flatnonzero(same)
        self.chosen = chosen[self.windows]
        self.text = text[self.windows]
        self.length = length

    def stretches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Seed place, first window and number of windows of each run of windows with one seed."""
        if not len(self.windows):
            none = np.empty(0, np.int64)
            return none, none, none
        new = np.flatnonzero(np.r_[True, (np.diff(self.chosen) != 0) | (np.diff(self.text) != 0)])
        return self.chosen[new], self.windows[new], np.diff(np.r_[new, len(self.windows)])


def _find_seeds(length: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            found = _Seeds(batch, length, seed)
            at, first, _ = found.stretches()
            text = found.words.texts()[at]
            rows = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed(found.seeds[at])),
                    batch.column("doc_id").take(rows),
                    batch.column("k1").take(rows),
                    batch.column("k2").take(rows),
                    pa.array((first - found.words.first[text]).astype(np.int32)),
                ],
                ["seed", "doc_id", "k1", "k2", "first"],
            )

    return run


def _lists(column: pa.Array) -> list[np.ndarray]:
    at = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    return [np.unique(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def _extend(length: int, seed: int):
    """The stretch of each seed that repeats: from its first to its last window, as a 128-bit digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            found = _Seeds(batch, length, seed)
            at, first, count = found.stretches()
            text = found.words.texts()[at]
            asked = [found.words.first[i] + x for i, x in enumerate(_lists(batch.column("firsts")))]
            keep = np.flatnonzero(np.isin(first, np.concatenate(asked)))
            at, first, count, text = at[keep], first[keep], count[keep], text[keep]
            place = (at - first).astype(np.uint64) << np.uint64(32) | count.astype(np.uint64)
            digest = [r.of(first, first + count - 1 + length) ^ (place * np.uint64(b)) for r, b in zip(found.runs, BASES, strict=True)]
            rows = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed(found.seeds[at])),
                    pa.array(signed(digest[0])),
                    pa.array(signed(digest[1])),
                    batch.column("doc_id").take(rows),
                    batch.column("k1").take(rows),
                    batch.column("k2").take(rows),
                    pa.array((first - found.words.first[text]).astype(np.int32)),
                    pa.array(count.astype(np.int32)),
                ],
                ["seed", "d1", "d2", "doc_id", "k1", "k2", "first", "n"],
            )

    return run


def _windows(length: int):
    """The single windows of the stretches asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            words = Words(*buffer_of(batch.column("text")), NON_SPACE)
            hashes = words.hashes()
            runs = [Runs(hashes, base) for base in BASES]
            starts, rows = [], []
            column = batch.column("stretches")
            at, flat = column.offsets.to_numpy(), column.values
            firsts, counts = flat.field("first").to_numpy(), flat.field("n").to_numpy()
            for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                own = np.unique(np.concatenate([np.arange(f, f + c) for f, c in zip(firsts[a:b], counts[a:b], strict=True)]))
                starts.append(own + words.first[i])
                rows.append(np.full(len(own), i))
            start, row = np.concatenate(starts), np.concatenate(rows)
            at_rows = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed(runs[0].of(start, start + length))),
                    pa.array(signed(runs[1].of(start, start + length))),
                    batch.column("doc_id").take(at_rows),
                    batch.column("k1").take(at_rows),
                    batch.column("k2").take(at_rows),
                    pa.array((start - words.first[row]).astype(np.int32)),
                ],
                ["w1", "w2", "doc_id", "k1", "k2", "first"],
            )

    return run


def repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """Windows that also start in a document with a smaller ``doc_id``: ``(k1, k2, first, n)``, ``n`` neighbouring windows from word ``first`` on."""
    if not 0 < seed <= length:
        raise ValueError("a seed is part of a window")
    short_batches(docs.sparkSession)
    texts = _keyed(docs)
    # of a null text or null id there is no window; the condition stands on the seeds, so the scans stay equal
    seeds = texts.where("doc_id is not null").mapInArrow(_find_seeds(length, seed), "seed long, doc_id long, k1 long, k2 long, first int")
    seeds = written(seeds, "seeds")
    shared = seeds.groupBy("seed").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("seed")
    asked = seeds.join(shared, "seed", "left_semi").groupBy(*KEY).agg(F.collect_list("first").alias("firsts"))
    stretches = (
        texts.join(asked, KEY)
        .select("doc_id", "text", *KEY, "firsts")
        .mapInArrow(_extend(length, seed), "seed long, d1 long, d2 long, doc_id long, k1 long, k2 long, first int, n int")
    )
    stretches = written(stretches, "stretches")

    classes = stretches.groupBy("seed", "d1", "d2").agg(F.min("doc_id").alias("earliest"))
    several = classes.groupBy("seed").agg(F.count("*").alias("c")).where("c > 1").select("seed")
    placed = stretches.join(classes, ["seed", "d1", "d2"])
    whole = placed.where("doc_id > earliest").select(*KEY, "first", "n")
    open_ = placed.where("doc_id = earliest").join(several, "seed", "left_semi")
    windows = (
        texts.join(open_.groupBy(*KEY).agg(F.collect_list(F.struct("first", "n")).alias("stretches")), KEY)
        .select("doc_id", "text", *KEY, "stretches")
        .mapInArrow(_windows(length), "w1 long, w2 long, doc_id long, k1 long, k2 long, first int")
    )
    windows = written(windows, "windows")
    earliest = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("earliest"))
    single = windows.join(earliest, ["w1", "w2"]).where("doc_id > earliest").select(*KEY, "first", F.lit(1).alias("n"))
    return whole.unionByName(single)


def _cut(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            texts, spans = batch.column("text"), batch.column("spans")
            n_words, n_removed, digests, kept_texts = [], [], [], []
            for i in range(batch.num_rows):
                words = (texts[i].as_py() or "").encode().split()
                n = len(words)
                removed = 0
                if spans[i].is_valid:
                    own = spans[i].values
                    first, count = own.field("first").to_numpy(), own.field("n").to_numpy()
                    edge = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(edge, first, 1)
                    np.add.at(edge, first + count - 1 + length, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed = int(gone.sum())
                    words = [words[j] for j in np.flatnonzero(~gone)]
                kept = b" ".join(words)
                n_words.append(n)
                n_removed.append(removed)
                digests.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    kept_texts.append(kept.decode())
            out = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                out.append(pa.array(kept_texts, pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def drop_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, with_text: bool = True) -> DataFrame:
    """One row per row of ``docs (doc_id, text)``: ``doc_id, n_words, n_removed, kept_sha256`` and, if asked for, ``kept_text``.

    Words covered by a repeat are removed; the kept words are joined by one space.
    """
    spans = repeats(docs, length, seed).groupBy(*KEY).agg(F.collect_list(F.struct("first", "n")).alias("spans"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return _keyed(docs).join(spans, KEY, "left").select("doc_id", "text", "spans").mapInArrow(_cut(length, with_text), schema)
