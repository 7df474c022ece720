"""Language ID: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased; letters stay, every run of other characters becomes one space, and a
space stands at both ends.  Its features are all runs of 1 to 3 characters, hashed into
``BUCKETS`` buckets.  Training adds up the buckets of each language (sums combine before
the shuffle), so the model is a matrix of languages by buckets whatever the corpus; it is
broadcast, and each batch is scored by gathering its n-grams' log-probabilities and adding them up per text.

The language is the one with the largest sum of all evidence and the prior.  The score is its
posterior, where that sum counts as that of ``EVIDENCE`` n-grams at most; else every longer text would come out as 1.

* null text, or no letter in it: ``und``, score 0; also if nothing was learned
* ties: the language that comes first in order
* empty texts and null languages teach nothing
* more than ``MOST_LANGUAGES`` languages: the matrix is cut into blocks of so many, which are broadcast and
  scored one after the other; each text carries its best sum and the sum of its posteriors from block to block
* other columns are ignored; rows with equal ``doc_id`` are judged one by one
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.scratch import short_batches, written
from tallymark.llm.textscan import chunks

BITS = 16
BUCKETS = 1 << BITS
SIZES = (1, 2, 3)
EVIDENCE = 100
SMOOTHING = 0.5
#: Languages of one broadcast: 256 languages x 65,536 buckets x 8 bytes are 128 MB.
MOST_LANGUAGES = 256
UNKNOWN = "und"

_LETTER = np.full(0x110000, -1, dtype=np.int8)
_FACTORS = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


def _letters(codes: np.ndarray) -> np.ndarray:
    """Which code points are letters; each is asked once per worker."""
    flag = _LETTER[codes]
    if len(flag) and flag.min() < 0:
        for c in np.unique(codes[flag < 0]).tolist():
            _LETTER[c] = chr(c).isalpha()
        flag = _LETTER[codes]
    return flag.view(bool)


def ngrams(texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Buckets of the n-grams of the joined texts, an array for each size; the first character of each text; whether a text has a letter.

    Text ``i`` has the n-grams of a size from its first character to ``size - 1`` before the next text's.
    """
    lowered = [f" {t.lower()} " if t else " " for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    edges = np.cumsum([0, *map(len, lowered)])
    letter = _letters(codes)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of each run of others
    keep[edges[:-1]] = True
    at = np.flatnonzero(keep)
    first = np.searchsorted(at, edges)
    letter = letter[at]
    codes = np.where(letter, codes[at], np.uint32(32))
    found = []
    h = np.zeros(len(codes), dtype=np.uint32)
    for size in SIZES:
        h = h[: max(0, len(codes) - size + 1)] + codes[size - 1 :] * _FACTORS[size - 1]
        x = h ^ (h >> np.uint32(15))
        x *= np.uint32(0x2C1B3C6D) + np.uint32(2 * size)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0x297A2D39)
        x >>= np.uint32(32 - BITS)
        found.append(x)
    some = np.add.reduceat(letter, first[:-1]) > 0 if len(texts) else np.empty(0, bool)
    return found, first, some


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    texts_of: dict[str, int] = {}
    for batch in chunks(batches, "text"):
        by_lang: dict[str, list[str]] = {}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            found, first, some = ngrams(texts)
            sums = total.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
            for size, own in zip(SIZES, found, strict=True):
                sums += np.bincount(own, minlength=BUCKETS)
                across = np.unique(first[1:-1, None] - np.arange(1, size))  # those that reach into the next text
                across = across[(across >= 0) & (across < len(own))]
                sums -= np.bincount(own[across], minlength=BUCKETS)
            texts_of[lang] = texts_of.get(lang, 0) + int(some.sum())
            if len(total) >= MOST_LANGUAGES:  # what is counted so far goes out, to be added up later
                yield from _counted(total, texts_of)
                total, texts_of = {}, {}
    yield from _counted(total, texts_of)


def _counted(total: dict[str, np.ndarray], texts_of: dict[str, int]) -> Iterator[pa.RecordBatch]:
    for lang, sums in total.items():
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * (len(at) + 1)), pa.array(np.r_[at, -1].astype(np.int32)), pa.array(np.r_[sums[at], texts_of[lang]])],
            ["lang", "bucket", "n"],
        )


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    prior: np.ndarray
    log: np.ndarray  # languages x buckets
    #: Blocks of the languages that come after these.
    rest: tuple[Model, ...] = ()

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All evidence and the prior for each language and text; the n-grams of each text; whether it has a letter."""
        found, first, some = ngrams(texts)
        total = np.zeros((len(self.languages), len(texts)))
        count = np.zeros(len(texts))
        for size, own in zip(SIZES, found, strict=True):
            end = first[1:] - size + 1
            filled = np.flatnonzero(end > first[:-1])
            count += np.maximum(end - first[:-1], 0)
            if len(filled):
                cuts = np.stack([first[filled], end[filled]], axis=1).ravel()
                own = np.append(own, np.uint32(0))  # so that the last end is a place too
                for i, row in enumerate(self.log):
                    total[i, filled] += np.add.reduceat(row[own], cuts)[::2]
        return total + self.prior[:, None], count, some

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Predicted language (its number, -1 for none) and posterior of each text."""
        total, count, some = self.sums(texts)
        if not self.languages:
            return np.full(len(texts), -1), np.zeros(len(texts))
        best = total.argmax(axis=0)
        total *= np.minimum(1.0, EVIDENCE / np.maximum(count, 1))
        posterior = 1.0 / np.exp(total - total.max(axis=0)).sum(axis=0)
        return np.where(some, best, -1), np.where(some, posterior, 0.0)


def train(labelled: DataFrame) -> Model:
    """Learn from ``labelled (text, lang)``, all rows; null languages teach nothing."""
    short_batches(labelled.sparkSession)
    rows = (
        labelled.where("lang is not null and text is not null")
        .select("text", F.col("lang").cast("string").alias("lang"))
        .mapInArrow(_count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
    )
    names = [r.lang for r in rows.where("bucket = -1 and n > 0").select("lang").orderBy("lang").collect()]
    if len(names) <= MOST_LANGUAGES:
        return _model(names, rows)
    rows = written(rows, "language-counts")
    used = rows.where("bucket >= 0").select("bucket").distinct().count()
    texts = rows.where("bucket = -1").agg(F.sum("n").alias("n")).first().n
    blocks = []
    for a in range(0, len(names), MOST_LANGUAGES):
        own = names[a : a + MOST_LANGUAGES]
        blocks.append(_model(own, rows.where((F.col("lang") >= own[0]) & (F.col("lang") <= own[-1])), used, texts))
    return replace(blocks[0], rest=tuple(blocks[1:]))


def _model(names: list[str], rows: DataFrame, used: int | None = None, n_texts: int | None = None) -> Model:
    """The model of some languages from ``rows (lang, bucket, n)``; ``used`` buckets and texts of all languages."""
    counts, texts = np.zeros((len(names), BUCKETS)), np.ones(len(names))
    table = rows.toArrow().to_pandas()  # languages x buckets at most
    table = table[table["lang"].isin(names)]
    code = np.searchsorted(np.array(names, dtype=object), table["lang"].to_numpy(dtype=object)) if names else np.empty(0, int)
    bucket, n = table["bucket"].to_numpy(), table["n"].to_numpy()
    inside = bucket >= 0
    counts[code[inside], bucket[inside]] = n[inside]
    texts[code[~inside]] = n[~inside]
    used = used or max(1, int((counts.sum(axis=0) > 0).sum()))
    log = np.log((counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * used))
    return Model(tuple(names), np.log(texts / (n_texts or texts.sum())), log)


#: Columns of the input that a prediction does not carry along.
REPLACED = ("text", "lang_pred", "score")


#: What a text carries from block to block: its best sum and that language, the largest tempered sum, and the posteriors' sum over it.
CARRIED = "struct<best:double,lang:string,top:double,over:double>"


def _block(share):
    """Scores of one block of languages, merged into those of the blocks before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = share.value
        names = np.array(model.languages, dtype=object)
        for batch in chunks(batches, "text"):
            total, count, some = model.sums(batch.column("text").to_pylist())
            seen = batch.column("_carried")
            best, top, over = (seen.field(f).to_numpy(zero_copy_only=False).astype(float) for f in ("best", "top", "over"))
            lang = np.array(seen.field("lang").to_pylist(), dtype=object)
            own, at = total.max(axis=0), total.argmax(axis=0)
            better = some & (own > best)  # of equal ones the first in order stays
            lang[better] = names[at[better]]
            tempered = total * np.minimum(1.0, EVIDENCE / np.maximum(count, 1))
            peak = np.maximum(top, tempered.max(axis=0))
            over = over * np.exp(top - peak) + np.exp(tempered - peak).sum(axis=0)
            merged = pa.StructArray.from_arrays([pa.array(np.maximum(best, own)), pa.array(lang.tolist(), pa.string()), pa.array(peak), pa.array(over)], ["best", "lang", "top", "over"])
            yield batch.set_column(batch.schema.get_field_index("_carried"), "_carried", merged)

    return run


def _in_blocks(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``_lang`` (null for none) and ``_score`` from all blocks of a model."""
    start = F.struct(F.lit(float("-inf")).alias("best"), F.lit(None).cast("string").alias("lang"), F.lit(-1e300).alias("top"), F.lit(0.0).alias("over"))
    out = docs.withColumn("_carried", start.cast(CARRIED))
    for block in (replace(model, rest=()), *model.rest):
        share = docs.sparkSession.sparkContext.broadcast(block)
        out = out.mapInArrow(_block(share), out.schema)
    lang = F.col("_carried.lang")
    return out.withColumns({"_lang": lang, "_score": F.when(lang.isNull(), 0.0).otherwise(1 / F.col("_carried.over"))}).drop("_carried")


def _predict(share):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = share.value
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for batch in chunks(batches, "text"):
            best, score = model.scores(batch.column("text").to_pylist())
            others = [c for c in batch.schema.names if c not in REPLACED]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in others), pa.array(names[best].tolist(), pa.string()), pa.array(score, pa.float64())],
                [*others, "lang_pred", "score"],
            )

    return run


def predict(texts: DataFrame, model: Model) -> DataFrame:
    """The columns of ``texts`` but ``text``, with ``lang_pred`` and ``score``, which replace columns of these names."""
    short_batches(texts.sparkSession)
    if model.rest:
        out = _in_blocks(texts.drop("lang_pred", "score"), model)
        return out.withColumns({"lang_pred": F.coalesce("_lang", F.lit(UNKNOWN)), "score": F.col("_score")}).drop("text", "_lang", "_score")
    share = texts.sparkSession.sparkContext.broadcast(model)
    others = [f for f in texts.schema.fields if f.name not in REPLACED]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "lang_pred string, score double"])
    return texts.mapInArrow(_predict(share), schema)


def _keep(share, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = share.value
        for batch in chunks(batches, "text"):
            best, score = model.scores(batch.column("text").to_pylist())
            yield batch.filter(pa.array((best >= 0) & (score >= least)))

    return run


def keep_known(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """Rows of ``docs`` in a learned language with a score of at least ``least``; all columns, no shuffle."""
    short_batches(docs.sparkSession)
    if model.rest:
        return _in_blocks(docs, model).where((F.col("_score") >= least) & F.col("_lang").isNotNull()).drop("_lang", "_score")
    share = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_keep(share, least), docs.schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept back from training: a quarter, by checksum of its id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
