"""Quality rules: does a document read more like trusted text than like the corpus as a whole?

Tokens are runs of letters and digits (of all characters beyond ASCII, too) and runs of other signs.  Tokens and
pairs of neighbouring tokens are hashed into ``BUCKETS`` buckets (CRC-32 of the token; for a pair, a product of
both), and two multinomials are counted over them: one of the trusted documents, one of all documents.  Both are smoothed by
``SMOOTHING`` counts in every bucket.  A document's score is the mean, over its tokens and pairs, of
the logarithm of the one probability over the other; it is kept if the score is at least ``THRESHOLD``.

The weight of a bucket is a whole number of 1/``SCALE``, so sums are exact: a verdict depends on
neither order nor partitions.  Before the score, fixed rules drop documents of few words or of many repeated
words (``base_failed``).

Everything is DataFrame functions.  Counting is one scan that explodes buckets into a map-side sum;
what is shuffled is at most ``BUCKETS`` rows a task, and what reaches the driver is the ``BUCKETS``
weights, a literal of the scoring scan.  Scoring and all counts of a document are expressions of its own row.

Trusted documents: those with labels, all of them ``quality`` 1 and ``toxic`` 0.  The target is counted
on at most ``TARGET_DOCS`` of them, the first by MD5 of their ids that the table holds; the corpus is counted
over all documents.

* null, empty or wordless text: all counts 0, ``base_failed``; without any trusted document the
  weights are all 0, and ``kept`` is the negation of ``base_failed``
* an empty table gives no rows; repeated rows and equal ids come out as often as they came
* a text of any length is one row's work, n log n in its words
* null ids carry no label; null labels do not make a document trusted, nor do other labels of the same id
* other columns are ignored, whatever their names
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime, so that every bit of a hash counts.
BUCKETS = 16_381
#: Factor of the first of a pair of tokens.
PAIR = 1_000_003
#: Counts that every bucket has besides its own.
SMOOTHING = 1.0
#: Weights are whole numbers of 1 / SCALE.
SCALE = 10_000
#: Least mean log ratio of a document that stays.
THRESHOLD = -0.3
#: Most trusted documents that the target is counted on.
TARGET_DOCS = 20_000

#: Blank, tab, line feed, vertical tab, form feed, carriage return, as a Java class.
SPACE = r"\s"
TOKEN = r"[\p{Alnum}\x{80}-\x{10FFFF}]+|[^\p{Alnum}\s\x{80}-\x{10FFFF}]+"
SYMBOLS = "[#*$%&|<>]"
#: Words of a window that counts as repeated.
WINDOW = 8
#: Fewer words, or more than this share of repeated ones (in hundredths), and a document goes.
LEAST_WORDS, MOST_REPEATED = 20, 30


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The runs between white space."""
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """How many words stand in a window of ``width`` words that the same text holds twice or more."""

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            twins = F.filter(s, lambda e, k: (F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"]))
            return F.sort_array(F.transform(twins, lambda e: e["i"]))

        first = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n"))
        step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(width), i - a["last"])).alias("n"))
        return F.aggregate(_let(placed, starts), first, step)["n"]

    def doubled(span: int, hashes: Column) -> Column:
        """Hashes of runs of ``width`` words from those of ``span``; at the end of the text, of what is left."""
        if span == width:
            return some(F.slice(hashes, 1, F.size(hashes) - width + 1))
        return _let(F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + span))), lambda twice: doubled(2 * span, twice))

    def some(runs: Column) -> Column:
        return _let(runs, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))

    if width & (width - 1):
        raise ValueError("the width must be a power of two")
    hashed = _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: doubled(1, h))
    return F.when(F.size(words) > width, hashed).otherwise(0).cast("long")


def repeated_lines(text: Column) -> Column:
    """How many lines with a word are equal to an earlier one."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"\S"))
    return _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def weight_of(tokens: Column, model: Column, buckets: int = BUCKETS) -> Column:
    """The sum of the weights of the buckets of a text."""

    def summed(c: Column) -> Column:
        at = lambda h: F.get(model, (h % buckets).cast("int"))
        each = F.transform(c, lambda x, i: at(x) + F.coalesce(at(x * PAIR + F.get(c, i + 1)), F.lit(0)))
        return F.aggregate(each, F.lit(0).cast("long"), lambda total, w: total + w)

    return _let(F.transform(tokens, lambda t: F.crc32(t)), summed)


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), 0)


def trusted_ids(docs: DataFrame, labels: DataFrame, most: int = TARGET_DOCS) -> DataFrame:
    """Ids of trusted documents that ``docs`` holds, at most ``most``."""
    good = labels.groupBy("doc_id").agg(F.min((F.col("quality") == 1).cast("int")).alias("q"), F.max(F.coalesce((F.col("toxic") != 0).cast("int"), F.lit(1))).alias("t"))
    good = good.where("q = 1 and t = 0").select("doc_id")
    return good.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(most)


def weights(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING, most: int = TARGET_DOCS) -> list[int]:
    """The log ratio of trusted to all text for each bucket, in whole numbers of 1 / SCALE."""
    marked = F.broadcast(trusted_ids(docs, labels, most).withColumn("trusted", F.lit(1).cast("long")))
    tokens = docs.select("doc_id", _tokens(F.col("text")).alias("tokens")).join(marked, "doc_id", "left")
    # each token beside the next one: two generators in one compiled stage, straight into the map-side sum
    beside = F.arrays_zip(F.col("tokens").alias("x"), F.slice("tokens", 2, F.greatest(F.size("tokens") - 1, F.lit(0))).alias("y"))
    pairs = tokens.select("trusted", F.explode(beside).alias("t")).select("trusted", F.crc32("t.x").alias("x"), F.crc32("t.y").alias("y"))
    both = F.array(F.col("x") % buckets, (F.col("x") * PAIR + F.col("y")) % buckets)
    each = pairs.select("trusted", F.explode(both).alias("bucket")).where("bucket is not null")
    counted = each.groupBy("bucket").agg(F.count("*").alias("raw"), F.coalesce(F.sum("trusted"), F.lit(0)).alias("target")).collect()
    n_raw, n_target = sum(r.raw for r in counted), sum(r.target for r in counted)
    if not n_target:
        return [0] * buckets
    spark = docs.sparkSession
    ratio = F.log((F.col("target") + smoothing) / (n_target + smoothing * buckets)) - F.log((F.col("raw") + smoothing) / (n_raw + smoothing * buckets))
    there = spark.createDataFrame(counted, "bucket long, raw long, target long")
    filled = spark.range(buckets).toDF("bucket").join(there, "bucket", "left").na.fill(0)
    rows = filled.select("bucket", F.round(ratio * SCALE).cast("long").alias("w")).collect()
    out = [0] * buckets
    for r in rows:
        out[r.bucket] = r.w
    return out


def judge(docs: DataFrame, model: list[int], threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id`` with the counts, ``base_failed``, ``score`` (sum of weights), ``n_grams`` and ``kept`` for every row of ``docs (doc_id, text)``."""
    text = F.coalesce("text", F.lit(""))
    # one string that is split when the plan is made: a literal array, not as many expressions
    of = F.split(F.lit(",".join(map(str, model))), ",").cast("array<bigint>")
    split = docs.select("doc_id", text.alias("text"), words_of(text).alias("words"), _tokens(F.col("text")).alias("tokens"))
    score = weight_of(F.col("tokens"), of, len(model))
    counts = split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        repeated_lines(F.col("text")).alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        score.alias("score"),
        F.greatest(2 * F.size("tokens") - 1, F.lit(0)).cast("long").alias("n_grams"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    good = F.col("score") >= F.col("n_grams") * round(threshold * SCALE)
    return counts.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & good)
