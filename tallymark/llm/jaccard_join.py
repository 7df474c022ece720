"""N-gram Jaccard join by chosen paths.

A document is the set of its runs of five words.  Documents with equal sets are one *class*; the
join runs over classes.  In each of several independent runs a set chooses shared tokens by hash: a token
whose hash lies under ``1 / (similarity * size)`` is chosen, so similar sets choose the same ones.
The sets that chose a token are a bucket.  A bucket of more than ``BUCKET`` sets is split again on
the tokens of the next level (the path grows by one); what is left small is compared by brute
force.  A path that hardly splits its bucket (nearly all of its sets are alike) or has no level left
is compared by brute force too, dealt out in blocks, so no bucket is ever one task's work and none is cut.

A pair may meet in several buckets; the first of those the two have in common alone counts it, so links are counted
without ever listing pairs.  Brute force first compares bottom-``SKETCH`` sketches (a pair over the
similarity falls under ``sketch_least`` with a chance below ``SKETCH_LOSS``), and only sets with a
candidate left bring their texts for the exact comparison.

A pair of the least similarity shares on average at least one token in each run, and ``SPLIT_RATE`` at each split.  So it
survives a run with ``(1 - exp(-1)) * (1 - exp(-SPLIT_RATE)) ** splits`` at least; ``runs`` is such that a pair misses
all runs with a chance of ``1 - RECALL`` at most, even if every one of its buckets is split to the last level.
The links found are exact; none is found that is not there.

* words: A-Z lower-cased, runs of digits, letters a-z and characters beyond ASCII
* a text of 1 to 4 words is one token; null, empty and wordless texts have no token, no link, and are classes of their own
* rows with equal ``doc_id`` are documents of their own; a null ``doc_id`` is never a class id unless its whole class has none
* an empty table gives an empty result; other columns are ignored
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.scratch import short_batches, written
from tallymark.llm.textscan import BASES, LOWER, WORD_BYTES, Runs, Words, buffer_of, chunks, mix, signed

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.999999
#: Sets compared at once.
BUCKET = 512
#: Tokens chosen on a path: level 1 and two splits.
LEVELS = 3
#: Times the tokens that a set chooses when a bucket is split, so that a split loses few pairs.
SPLIT_RATE = 3.0
#: A split that leaves more than this share of the bucket together is not worth another.
DENSE = 0.5
SKETCH = 32
#: Chance that the sketches rule out a pair that is linked.
SKETCH_LOSS = 1e-7
#: Hashes of a text at once.
HASHES = 1 << 20
#: Bits of the bitmap of the texts to fetch: for each of them, and at most (16 MB).
SIEVE, SIEVE_BITS = 16, 1 << 27
#: Columns of an incidence matrix at once.
COLUMNS = 4096
KEY = ["d1", "d2"]
PART = ["path", "i", "j"]

_WORDLESS = r"[0-9A-Za-z]|[^\x00-\x7F]"


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct token hashes of each text."""
    data, offsets = buffer_of(column)
    words = Words(LOWER[data], offsets, WORD_BYTES)
    runs = Runs(words.hashes(), BASES[0])
    every = runs.every(SHINGLE)
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= SHINGLE:
            yield np.unique(every[a : b - SHINGLE + 1])
        elif b > a:
            yield runs.of(np.array([a]), np.array([b]))
        else:
            yield np.empty(0, np.uint64)


def _salted(tokens: np.ndarray, salt: int) -> np.ndarray:
    return mix(tokens ^ np.uint64((salt + 1) * BASES[1] & (2**64 - 1)))


def _chosen(tokens: np.ndarray, runs: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens that a set chooses, run after run, first those of level 1 and then 32 bits of those of each split; how many each time."""
    times = LEVELS * runs
    rate = np.repeat([1.0, *[SPLIT_RATE] * (LEVELS - 1)], runs) / (similarity * len(tokens))
    below = np.where(rate < 1, (np.minimum(rate, 1 - 2.0**-53) * 2.0**64).astype(np.uint64), np.uint64(2**64 - 1))
    salts = np.array([(101 + i // runs + LEVELS * (i % runs)) * BASES[1] & (2**64 - 1) for i in range(times)], dtype=np.uint64)
    counts, own, split = [], [], []
    step = max(1, HASHES // len(tokens))
    for low in range(0, times, step):
        hashes = mix(tokens[None, :] ^ salts[low : low + step, None])
        time, at = np.nonzero(hashes <= below[low : low + step, None])
        counts.append(np.bincount(time, minlength=len(hashes)))
        first = time + low < runs
        own.append(tokens[at[first]])
        split.append(hashes[time[~first], at[~first]].astype(np.uint32))
    return signed(np.concatenate(own)), np.concatenate(split).view(np.int32), np.concatenate(counts)


DESCRIBED = "doc_id long, k1 long, k2 long, n int, d1 long, d2 long, sketch array<int>, chosen array<array<long>>, splits array<array<int>>"


def _lists(values: list[np.ndarray], counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Lists of lists: a row of ``counts`` has the lengths of the inner lists of a row."""
    inner = pa.ListArray.from_arrays(np.r_[0, np.cumsum(counts)].astype(np.int32), pa.array(np.concatenate(values), kind))
    return pa.ListArray.from_arrays((np.arange(len(counts) + 1) * counts.shape[1]).astype(np.int32), inner)


def _describe(runs: int, similarity: float):
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
    nothing = np.empty(0, np.int64), np.empty(0, np.int32), np.zeros(LEVELS * runs, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            rows, choices = [], []
            for tokens in shingle_sets(batch.column("text")):
                if not len(tokens):
                    rows.append((0, 0, 0, []))
                    choices.append(nothing)
                    continue
                sums = [int(np.sum(_salted(tokens, s), dtype=np.uint64).view(np.int64)) for s in (0, 1)]
                low = _salted(tokens, 2)
                low = np.sort(np.partition(low, SKETCH - 1)[:SKETCH] if len(low) > SKETCH else low)
                rows.append((len(tokens), *sums, (low >> np.uint64(32)).astype(np.uint32).view(np.int32)))
                choices.append(_chosen(tokens, runs, similarity))
            own, split, counts = zip(*choices, strict=True)
            counts = np.stack(counts)
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "k1", "k2")),
                    *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)),
                    _lists(own, counts[:, :runs], pa.int64()),
                    _lists(split, counts[:, runs:], pa.int32()),
                ],
                [f.split()[0] for f in DESCRIBED.split(", ")],
            )

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("doc_id", "text").alias("k1"),
        F.xxhash64("text", F.lit(1), "doc_id").alias("k2"),
        "text",
    )


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of each bucket part; the input is sorted by it."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in PART])
        if rest:
            last = [rest[-1].column(c)[rest[-1].num_rows - 1].as_py() for c in PART]
            if last != [int(x) for x in keys[:, 0]]:
                yield pa.Table.from_batches(rest)
                rest = []
        cuts = np.flatnonzero(np.any(keys[:, 1:] != keys[:, :-1], axis=0)) + 1
        at = 0
        for cut in cuts:
            yield pa.Table.from_batches([*rest, batch.slice(at, cut - at)])
            rest, at = [], int(cut)
        rest.append(batch.slice(at))
    if rest:
        yield pa.Table.from_batches(rest)


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the sets share, by incidence of the values that stand in several sets."""
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    flat = np.concatenate(sets) if sets else np.empty(0)
    if not len(flat):
        return out
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, n = np.unique(flat, return_inverse=True, return_counts=True)
    several = n[code] > 1
    place = np.cumsum(n > 1) - 1
    code, owner = place[code[several]], owner[several]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        a, b = np.searchsorted(code, [low, low + COLUMNS])
        block = np.zeros((len(sets), COLUMNS if len(sets) > 8 else int(code[b - 1]) - low + 1), dtype=np.float32)
        block[owner[a:b], code[a:b] - low] = 1
        out += block @ block.T
    return out


def _counted_here(table: pa.Table) -> np.ndarray:
    """Pairs (upper half) for which this path is the first that the two sets have in common, and that this part compares."""
    i, j = (table.column(c)[0].as_py() for c in PART[1:])
    leaves = [np.array(own, dtype=np.int64) for own in table.column("leaves").to_pylist()]
    fresh = np.triu(shared_counts(leaves) == 0, 1)
    if i != j:
        block = table.column("block").to_numpy()
        fresh &= block[:, None] != block[None, :]
    return fresh


def sketch_least(similarity: float) -> int:
    """Values that the sketches of two sets of that similarity share but for a chance of ``SKETCH_LOSS``.

    They share fewest where one set holds the other; then each value of the larger one's sketch stands in both with a chance of ``similarity``.
    """
    least, below = 0, 0.0
    while (below := below + math.comb(SKETCH, least) * similarity**least * (1 - similarity) ** (SKETCH - least)) <= SKETCH_LOSS:
        least += 1
    return least


def _candidates(similarity: float):
    """Rows of sets with a partner whose sketch does not rule it out."""
    at_least = sketch_least(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            fresh = _counted_here(table)
            if fresh.any():
                n = table.column("n").to_numpy().astype(np.float64)
                both = n[:, None] + n[None, :]
                fresh &= np.minimum(n[:, None], n[None, :]) >= similarity * np.maximum(n[:, None], n[None, :]) - 1e-9
                sketches = [np.unique(np.array(s, dtype=np.int32)) for s in table.column("sketch").to_pylist()]
                small = np.maximum(n[:, None], n[None, :]) <= SKETCH
                least = np.where(small, np.minimum(at_least, similarity / (1 + similarity) * both - 1e-9), at_least)
                fresh &= shared_counts(sketches) >= least
            wanted = np.flatnonzero(fresh.any(axis=0) | fresh.any(axis=1))
            if len(wanted):
                yield from table.take(pa.array(wanted)).drop_columns(["sketch"]).combine_chunks().to_batches()

    return run


LINKED = "d1 long, d2 long, r1 long, r2 long, links long"


def _verify(similarity: float):
    """Of each set its links counted here, and a set it hangs together with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            table = table.combine_chunks()
            fresh = _counted_here(table)
            sets = [s for batch in chunks(iter(table.to_batches()), "text") for s in shingle_sets(batch.column("text"))]
            shared = shared_counts(sets).astype(np.float64)
            n = np.array([len(s) for s in sets], dtype=np.float64)
            linked = fresh & (shared >= similarity * (n[:, None] + n[None, :] - shared) - 1e-9)
            linked |= linked.T
            if not linked.any():
                continue
            weight = table.column("members").to_numpy().astype(np.float64)
            links = (linked @ weight).astype(np.int64)
            root = np.arange(len(n))
            for start in range(len(n)):
                if root[start] == start and linked[start].any():
                    seen = np.zeros(len(n), bool)
                    front = linked[start]
                    seen[start] = True
                    while (front & ~seen).any():
                        new = front & ~seen
                        seen |= new
                        front = linked[new].any(axis=0)
                    root[seen] = np.minimum(root[seen], start)
            d1, d2 = (table.column(c).to_numpy() for c in KEY)
            own = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(x[y]) for x, y in ((d1, own), (d2, own), (d1, root[own]), (d2, root[own]), (links, own))], [f.split()[0] for f in LINKED.split(", ")])

    return run


def _paths(classes: DataFrame, runs: int, tokens: bool) -> DataFrame:
    """``d1, d2, run, path, above`` of the first level; with ``tokens`` also the run's tokens of each split."""
    def path(own, r):
        further = [F.get("splits", r + k * runs).alias(f"t{k + 1}") for k in range(LEVELS - 1)] if tokens else []
        return F.transform(own, lambda t: F.struct(r.alias("run"), F.xxhash64(r, t).alias("path"), *further))

    return classes.select(*KEY, F.inline(F.flatten(F.transform("chosen", path))), F.lit(0).cast("long").alias("above"))


def _leaves(classes: DataFrame, runs: int, bucket: int) -> DataFrame:
    """``path, d1, d2, blocks`` of all buckets to compare; ``blocks`` is 1 for those of at most ``bucket`` sets.

    A set brings the tokens of its run along with its path, so a split looks up only the few large buckets:
    the sets and their tokens are not dealt out again by set.  Most paths are one set's own: these are counted
    by the path alone, and bitmaps keep them out of all other shuffles.
    """
    rows, full = _paths(classes, runs, False), _paths(classes, runs, True)
    shared = written(rows.groupBy("path").agg(F.count("*").alias("m")).where("m > 1").select("path"), "shared")
    rows = written(_sieved(rows, shared, "path"), "paths0")
    same = ["m", "x1", "x2"]
    done = None
    for level in range(1, LEVELS + 1):
        sizes = rows.groupBy("path", "run").agg(
            F.count("*").alias("m"), F.max("above").alias("above"), F.bit_xor("d1").alias("x1"), F.bit_xor("d2").alias("x2")
        ).where("m > 1")
        sizes = written(sizes, f"sizes{level}")
        # buckets of the same sets are one, which is split by the tokens of every run that it stands for
        merged = sizes.groupBy(*same).agg(F.min("path").alias("path"), F.min("above").alias("above"))
        kept = written(merged, f"buckets{level}")
        split = (F.col("m") > bucket) & ((F.col("above") == 0) | (F.col("m") <= DENSE * F.col("above")))
        if level == LEVELS:
            split = F.lit(False)
        small = kept.where(~split).select("path", "m")
        leaf = _sieved(rows.select("path", *KEY), small, "path").join(small, "path")
        leaf = leaf.select("path", *KEY, F.when(F.col("m") <= bucket, 1).otherwise(F.ceil(F.col("m") * 2 / bucket)).cast("int").alias("blocks"))
        done = leaf if done is None else done.unionByName(leaf)
        if level == LEVELS or not kept.where(split).head(1):
            return done
        into = kept.where(split).select(*same, F.col("path").alias("into"))
        # a path for each run, as a set may have chosen several tokens of one run
        hot = sizes.where(F.col("m") > bucket).groupBy(*same, "run").agg(F.min("path").alias("path")).join(into, same)
        # few rows, written first so that their size is known and the paths stay where they are
        hot = written(hot.select("path", "run", "into", F.col("m").alias("total")), f"hot{level}")
        later = [f"t{k + 1}" for k in range(level, LEVELS - 1)]
        # near copies may stand side by side in the input, so what is to be split is dealt out evenly
        full = (
            _sieved(full, hot, "path")
            .repartition("path", "d1")
            .join(hot, ["path", "run"])
            .select(*KEY, "run", "into", F.col("total").alias("above"), *later, F.explode(f"t{level}").alias("t"))
            .select(*KEY, "run", F.xxhash64("into", "run", "t").alias("path"), "above", *later)
        )
        full = rows = written(full, f"paths{level}")
    return done


def _sieved(rows: DataFrame, asked: DataFrame, key: str = "k1", others: bool = False) -> DataFrame:
    """``rows`` without most of those whose ``key``, a hash, is not in ``asked``; the exact join follows.

    A bitmap of the asked keys goes to all tasks, so rows that nobody asks for are not shuffled.  It has ``SIEVE`` bits
    a key and at most ``SIEVE_BITS``; beyond that it lets more rows pass.  With ``others`` exactly the rows that it stops.
    """
    bits = min(SIEVE_BITS, max(1 << 15, SIEVE * asked.count()))
    at = F.pmod(key, F.lit(bits)) + 1
    # keys are dealt out by their piece of the bitmap, so that no task makes pieces of its own for all of it
    maps = asked.select(at.alias("p")).select(F.bitmap_bucket_number("p").alias("_part"), F.bitmap_bit_position("p").alias("p")).repartition("_part")
    word = F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: F.conv(F.hex(F.substring("_bits", i * 8 + 1, F.lit(8))), 16, -10).cast("long"))
    maps = written(maps.groupBy("_part").agg(F.bitmap_construct_agg("p").alias("_bits")).select("_part", word.alias("_words")), "sieve")
    place = F.bitmap_bit_position(at)
    # eight bytes are a word, the first byte its highest
    bit = 56 - F.shiftright(place, 3).bitwiseAND(F.lit(7)) * 8 + place.bitwiseAND(F.lit(7))
    found = rows.withColumn("_part", F.bitmap_bucket_number(at)).join(F.broadcast(maps), "_part", "left" if others else "inner")
    hit = F.getbit(F.get("_words", F.shiftright(place, 6).cast("int")), bit.cast("int"))
    return found.where(F.coalesce(hit, F.lit(0)) == (0 if others else 1)).select(rows.columns)


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of ``edges (u, v)``: the smallest node it hangs together with.

    Edges are moved to the smallest neighbour, above and below in turn, until nothing moves;
    that takes rounds in proportion to the logarithm of the longest chain.
    """
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 20)))).first()
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        above = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        above = written(above, "above")
        least = above.groupBy("u").agg(F.min("v").alias("m"))
        moved = above.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = written(moved.select("e.*").where("u <> v").distinct(), "edges")


def _described(docs: DataFrame, runs: int, similarity: float) -> DataFrame:
    short_batches(docs.sparkSession)
    return written(_keyed(docs).mapInArrow(_describe(runs, similarity), DESCRIBED), "described")


def _classes(described: DataFrame) -> DataFrame:
    """A row for each set: documents that have it, their smallest id, one of their rows, and what was found of the set.

    Only documents whose set others may have are dealt out with all that; the rest are classes as they stand.
    """
    worded = described.where("n > 0")
    several = written(worded.groupBy(*KEY).agg(F.count("*").alias("members")).where("members > 1").select(*KEY), "several")
    found = ["n", "sketch", "chosen", "splits"]
    copies = (
        _sieved(worded, several, "d1")
        .groupBy(*KEY)
        .agg(
            F.count("*").alias("members"),
            F.min("doc_id").alias("copy_id"),
            F.min(F.struct("k1", "k2")).alias("row"),
            *(F.first(c).alias(c) for c in found),
        )
    )
    alone = _sieved(worded, several, "d1", others=True)
    alone = alone.select(*KEY, F.lit(1).cast("long").alias("members"), F.col("doc_id").alias("copy_id"), F.struct("k1", "k2").alias("row"), *found)
    return alone.unionByName(written(copies, "copies"))


def _solve(docs: DataFrame, described: DataFrame, runs: int, similarity: float, bucket: int) -> DataFrame:
    """``d1, d2, members, copy_id, links, r1, r2`` of every class: documents in it, its smallest id, links, and the class it hangs together with."""
    classes = _classes(described)
    leaves = written(_leaves(classes, runs, bucket), "leaves")
    owned = leaves.groupBy(*KEY).agg(F.collect_set("path").alias("leaves"))
    parts = (
        leaves.join(_sieved(classes.select(*KEY, "n", "members", "row", "sketch"), leaves, "d1").join(owned, KEY), KEY)
        .withColumn("leaves", F.filter("leaves", lambda x: x < F.col("path")))
        .withColumn("block", F.pmod(F.xxhash64("d1", "path"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("path", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", *KEY, "n", "members", "row", "leaves", "sketch")
    )
    shape = "path long, i int, j int, block int, d1 long, d2 long, n int, members long, row struct<k1:long,k2:long>, leaves array<long>"
    wanted = written(parts.repartition(*PART).sortWithinPartitions(*PART).mapInArrow(_candidates(similarity), shape), "wanted")
    asked = written(wanted.select("row.k1", "row.k2").distinct(), "asked")
    # no semi join, which Spark would move below the sieve
    texts = _sieved(_keyed(docs), asked).join(asked, ["k1", "k2"]).select("k1", "k2", "text").dropDuplicates(["k1", "k2"])
    found = (
        wanted.select("*", "row.k1", "row.k2")
        .join(texts, ["k1", "k2"])
        .select(*PART, "block", *KEY, "members", "leaves", "text")
        .repartition(*PART)
        .sortWithinPartitions(*PART)
        .mapInArrow(_verify(similarity), LINKED)
    )
    found = written(found, "links")
    links = found.groupBy(*KEY).agg(F.sum("links").alias("links"))
    together = components(found.select(F.struct(*KEY).alias("u"), F.struct(F.col("r1").alias("d1"), F.col("r2").alias("d2")).alias("v")))
    roots = together.select("node.d1", "node.d2", F.col("root.d1").alias("r1"), F.col("root.d2").alias("r2"))
    solved = (
        classes.select(*KEY, "members", "copy_id", "row")
        .join(links, KEY, "left")
        .join(roots, KEY, "left")
        .select(*KEY, "members", "copy_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("r1", "d1").alias("r1"), F.coalesce("r2", "d2").alias("r2"))
    )
    return written(solved, "solved")


def runs_for(recall: float) -> int:
    if not 0 < recall < 1:
        raise ValueError("a recall lies between 0 and 1")
    missed = 1 - (1 - math.exp(-1)) * (1 - math.exp(-SPLIT_RATE)) ** (LEVELS - 1)
    return max(1, math.ceil(math.log(1 - recall) / math.log(missed)))


def join(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, bucket: int = BUCKET) -> DataFrame:
    """``doc_id, class_id, n_links, copy_id, n_shingles`` of every row of ``docs (doc_id, text)``.

    ``n_links`` counts the other documents of at least that similarity; ``class_id`` is the smallest
    ``doc_id`` that links lead to, ``copy_id`` the smallest with the same set.
    """
    runs = runs_for(recall)
    described = _described(docs, runs, similarity)
    solved = _solve(docs, described, runs, similarity, bucket)
    names = solved.groupBy("r1", "r2").agg(F.min("copy_id").alias("class_id"))
    named = solved.join(names, ["r1", "r2"]).select(*KEY, "class_id", (F.col("links") + F.col("members") - 1).alias("n_links"), "copy_id")
    some = described.where("n > 0").select("doc_id", *KEY, "n").join(named, KEY)
    none = described.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("copy_id"), F.col("n").alias("n_shingles"))
    return some.select("doc_id", "class_id", "n_links", "copy_id", F.col("n").alias("n_shingles")).unionByName(none)


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, bucket: int = BUCKET) -> DataFrame:
    """``docs`` with one document of each group that links hold together, the one with the smallest ``doc_id``; all columns stay.

    Wordless documents belong to no group and all stay; of rows equal in ``doc_id`` and text one stays.
    """
    runs = runs_for(recall)
    described = _described(docs, runs, similarity)
    solved = _solve(docs, described, runs, similarity, bucket)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2"))
    each = described.where("n > 0").groupBy(*KEY).agg(first.alias("w"))
    winners = each.join(solved, KEY).groupBy("r1", "r2").agg(F.min("w").alias("w")).select(F.col("w.k1").alias("__k1"), F.col("w.k2").alias("__k2"))
    key = [F.xxhash64(F.col("doc_id").cast("long"), "text").alias("__k1"), F.xxhash64("text", F.lit(1), F.col("doc_id").cast("long")).alias("__k2")]
    worded = F.coalesce(F.col("text").rlike(_WORDLESS), F.lit(False))
    some = docs.where(worded).select("*", *key).join(winners, ["__k1", "__k2"], "left_semi").dropDuplicates(["__k1", "__k2"])
    return some.select(docs.columns).unionByName(docs.where(~worded))
