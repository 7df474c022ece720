"""Language ID against a plain naive Bayes, and in blocks of languages."""

import math
import random
from collections import Counter

import pytest

from tallymark.llm import language
from tallymark.llm.language import BUCKETS, EVIDENCE, SMOOTHING, keep_known, ngrams, predict, train

ALPHABETS = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklmnop", "dd": "mnopqrst", "ee": "qrstuvwx", "ff": "äöüßabcd", "gg": "漢字仮名交文"}


def texts(n, seed, lengths=(1, 60)):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(ALPHABETS))
        words = ("".join(rng.choice(ALPHABETS[lang]) for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(*lengths)))
        rows.append((i, " ".join(words), lang))
    return rows


def buckets(text):
    """Buckets of one text's n-grams; the normal form and the hash are the operator's, counting and scoring are not."""
    found, first, some = ngrams([text])
    return [int(b) for own in found for b in own], bool(some[0])


def plain(train_rows, rows):
    counts, docs = {}, Counter()
    for _, text, lang in train_rows:
        if text is not None and lang is not None:
            own, some = buckets(text)
            counts.setdefault(lang, Counter()).update(own)
            docs[lang] += some
    names = sorted(x for x in counts if docs[x])
    used = len(set().union(*(counts[x] for x in names)))
    out = {}
    for i, text, _ in rows:
        own, some = buckets(text)
        if not some:
            out[i] = ("und", 0.0)
            continue
        sums = []
        for x in names:
            size = counts[x].total() + SMOOTHING * used
            sums.append(math.log(docs[x] / docs.total()) + sum(math.log((counts[x][b] + SMOOTHING) / size) for b in own))
        tempered = [s * min(1, EVIDENCE / len(own)) for s in sums]
        best = max(range(len(names)), key=lambda j: (sums[j], -j))
        out[i] = (names[best], 1 / sum(math.exp(t - max(tempered)) for t in tempered))
    return out


@pytest.mark.parametrize("most", [256, 3, 1])
def test_against_plain_naive_bayes(spark, monkeypatch, most):
    monkeypatch.setattr(language, "MOST_LANGUAGES", most)
    learned = texts(120, 1) + [(900, None, "aa"), (901, "abc", None), (902, "123", "zz"), (903, "", "yy")]
    asked = texts(60, 2, (1, 4)) + [(100, None, "x"), (101, " 12 ", "x"), (102, "", "x"), (103, "ab " * 5_000, "x"), (104, "efgh", "x")]
    model = train(spark.createDataFrame(learned, "doc_id long, text string, lang string").select("text", "lang"))
    assert len(model.rest) == {256: 0, 3: 2, 1: 6}[most]
    table = spark.createDataFrame([(i, t, "k", 0.5) for i, t, _ in asked], "doc_id long, text string, lang_pred string, score double")
    found = {r.doc_id: (r.lang_pred, r.score) for r in predict(table, model).collect()}
    expected = plain(learned, asked)
    assert {i: x[0] for i, x in found.items()} == {i: x[0] for i, x in expected.items()}
    for i, (_, score) in expected.items():
        assert found[i][1] == pytest.approx(score, abs=1e-9)
    kept = keep_known(table, model, 0.9)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (x, score) in expected.items() if x != "und" and score >= 0.9}


def test_many_misspelt_languages(spark):
    rows = [(f"abc def {i}", "aa" if i % 2 else f"wrong{i}") for i in range(600)] + [("xyz xyz xyz", "zz")] * 30
    model = train(spark.createDataFrame(rows, "text string, lang string").repartition(2))
    assert len(model.rest) == 1 and sum(len(m.languages) for m in (model, *model.rest)) == 302
    asked = spark.createDataFrame([(1, "xyz xyz"), (2, "abc"), (3, "?")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in predict(asked, model).collect()} == {1: "zz", 2: "aa", 3: "und"}
    assert BUCKETS == model.log.shape[1]
