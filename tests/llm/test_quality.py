"""Quality rules against plain Python."""

import math
import re
import zlib
from collections import Counter

from tallymark.llm import quality as q

GOOD = "the river runs slowly past the old mill and on to the sea where boats wait for the tide to turn again"
JUNK = "buy*** now### cheap$$$ pills%%% click&&& here*** best### price$$$ wow%%% free&&& deal*** only### today$$$ win%%% big&&& cash*** fast### sign$$$ up%%% call&&&"


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^ \t\n\x0b\x0c\r]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {p for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^ \t\n\x0b\x0c\r]", x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def plain_buckets(text):
    tokens = re.findall("[0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff \t-\r]+", text or "")
    crcs = [zlib.crc32(t.encode()) for t in tokens]
    return [c % q.BUCKETS for c in crcs] + [(a * q.PAIR + b) % q.BUCKETS for a, b in zip(crcs, crcs[1:])]


def plain_weights(docs, trusted):
    raw, target = Counter(), Counter()
    for i, text in docs:
        raw.update(plain_buckets(text))
        if i in trusted:
            target.update(plain_buckets(text))
    def one(b):
        return math.log((target[b] + 1) / (target.total() + q.BUCKETS)) - math.log((raw[b] + 1) / (raw.total() + q.BUCKETS))

    return [round(q.SCALE * one(b)) for b in range(q.BUCKETS)]


TEXTS = [
    None, "", " \n\t", "one", GOOD, JUNK, GOOD + "\n" + GOOD, "a b c d e f g h " * 3, "a " * 40, "x y z " * 7 + GOOD,
    "line one\nline one\n \n \nline two\nline one ", "ÄÖ 漢字 😀 a|b <c> | d", "\x00\x01 w", "p q r s t u v w\np q r s t u v w",
]


def test_counts_of_every_text(spark, docs):
    found = {r.doc_id: r for r in q.judge(docs(list(enumerate(TEXTS))), [0] * q.BUCKETS).collect()}
    for i, text in enumerate(TEXTS):
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_counts(text), text
        assert r.kept == (not r.base_failed) and r.score == 0 and r.n_grams == len(plain_buckets(text))


def test_very_long_text(spark, docs):
    long = " ".join(f"w{i % 9973}" for i in range(200_000))
    apart = " ".join(f"w{i}" for i in range(200_000))
    a, b = q.judge(docs([(1, long), (2, apart)]), [0] * q.BUCKETS).orderBy("doc_id").collect()
    assert (a.n_words, a.n_repeat_words, b.n_words, b.n_repeat_words) == (200_000, 200_000, 200_000, 0)


def test_weights_and_verdicts(spark, docs):
    words = GOOD.split()
    rows = [(i, " ".join(words[(i * 5 + k * (1 + i % 7)) % len(words)] for k in range(30 + i))) for i in range(30)]
    rows += [(100 + i, JUNK + f" n{i}***") for i in range(20)] + [(i, t) for i, t in enumerate(TEXTS, 200)] + [(None, GOOD)]
    labels = [(i, 1, 0) for i in range(20)] + [(100, 0, 0), (101, 0, 1), (21, 1, 1), (22, None, 0), (23, 1, None), (24, 1, 0), (24, 0, 0), (None, 1, 0), (999, 1, 0)]
    table = docs(rows)
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert sorted(r.doc_id for r in q.trusted_ids(table, labelled).collect()) == list(range(20))
    model = q.weights(table, labelled)
    expected = plain_weights(rows, set(range(20)))
    assert model == expected
    for r in q.judge(table, model).collect():
        text = dict(rows)[r.doc_id]
        score = sum(expected[b] for b in plain_buckets(text))
        assert r.score == score and r.kept == (not plain_counts(text)[-1] and score >= r.n_grams * q.THRESHOLD * q.SCALE)
        if r.doc_id is not None and r.doc_id < 30:
            assert r.kept or r.base_failed
        if r.doc_id is not None and 100 <= r.doc_id < 120:
            assert not r.kept and not r.base_failed


def test_bounded_target(spark, docs):
    table = docs([(i, GOOD) for i in range(50)] + [(3, GOOD)])
    labelled = spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    assert q.trusted_ids(table, labelled, 10).count() == 10 and q.trusted_ids(table, labelled).count() == 50


def test_empty_and_clashing(spark):
    schema = "doc_id long, text string, words string, tokens int, trusted string, bucket string, score string, quality int, h int"
    none = spark.createDataFrame([], schema)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert q.judge(none, q.weights(none, labels)).collect() == []
    table = spark.createDataFrame([(1, GOOD, *["1", 1] * 3, 1), (1, GOOD, *["1", 1] * 3, 1)], "doc_id long, text string, words string, tokens int, trusted string, bucket int, score string, quality int, h int")
    model = q.weights(table, labels)
    assert model == [0] * q.BUCKETS and [r.kept for r in q.judge(table, model).collect()] == [True, True]
    # with trusted text and none other, nothing tells the two apart
    assert set(q.weights(table, spark.createDataFrame([(1, 1, 0)], labels.schema))) == {0}


def test_no_python_in_the_plans(spark, docs):
    plan = q.judge(docs([(1, GOOD)]), [0] * q.BUCKETS)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
