"""Large rule books: what the index finds, against plain Python and against the unrolled rules."""

import random
import re

import pytest

from tallymark.operators import labelling
from tallymark.plans.label_corpus import label_corpus
from tallymark.sources.rules import RuleBook
from tallymark.vocab import MODALITIES, THEMES

SCHEMA = "pmid string, title string, abstract string, year int, record_type string, publication_types string"


def corpus(n, words, seed=5):
    rng = random.Random(seed)
    extra = ["é", "für", "x-ray", "(510k)", "😀", "A.B", "la", "Le"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) if rng.random() < 0.9 else rng.choice(extra) for _ in range(rng.randint(0, 120)))
        rows.append((f"p{i}", " ".join(rng.sample(words, 4)).title(), text, 2020, "PubmedArticle" if i % 17 else "PubmedBookArticle", None))
    return rows


def large_book(n, words, seed=6):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        dictionary, category = ("theme", THEMES[i % len(THEMES)]) if i % 2 else ("modality", MODALITIES[i % len(MODALITIES)])
        # words of which few stand in the text, as in a real book
        w = [rng.choice(words) if rng.random() < 0.02 else f"zz{rng.randrange(10**6)}" for _ in range(3)]
        shape = i % 9
        pattern = [
            ("phrase", w[0]), ("phrase", f"{w[0]} {w[1]}"), ("phrase", w[2].title()), ("regex", rf"(?i)\b{w[0]}s?\b"),
            ("regex", rf"\b({w[0]}|{w[1]}) {w[2]}\b"), ("regex", rf"\b{w[0]}[- ]{w[1]}"), ("phrase", f"{w[0]}, {w[1]}"),
            ("regex", rf"(?i)\b(?:{w[0]}|{w[1]})\b"), ("phrase", w[1]),
        ][shape]
        case = True if shape == 2 else None
        rows.append((dictionary, category, "exclude" if i % 40 == 7 else "include", i, pattern[0], case, pattern[1]))
    # rules that cannot be filed under a word
    rows += [("theme", THEMES[0], "include", n, "phrase", None, "für"), ("theme", THEMES[1], "include", n, "regex", None, r"\d+k\)"), ("theme", THEMES[1], "exclude", n, "regex", None, "[😀]")]
    return RuleBook.of(rows)


def compiled(rule):
    if rule.kind == "phrase":
        tokens = rule.pattern.split()
        body = r"\s+".join(map(re.escape, tokens))
        body = (r"(?<!\w)" if re.match(r"\w", tokens[0][0]) else "") + body + (r"(?!\w)" if re.match(r"\w", tokens[-1][-1]) else "")
        return re.compile(body, 0 if rule.case_flag else re.I)
    return re.compile(rule.pattern)


def expected(rows, book):
    rules = [(r, compiled(r)) for r in book.rules]
    hits = set()
    for pmid, title, abstract, _, kind, _ in rows:
        if kind != "PubmedArticle":
            continue
        text = f"{title or ''}\n\n{abstract or ''}"
        text = labels_text(title, abstract)
        found = {}
        for r, pattern in rules:
            n = sum(1 for _ in pattern.finditer(text))
            if n:
                found[r.ordinal] = (r, n)
        included = {(r.dictionary, r.category) for r, _ in found.values() if r.role == "include"}
        hits |= {(pmid, o, n) for o, (r, n) in found.items() if r.role == "include" or (r.dictionary, r.category) in included}
    return hits


def labels_text(title, abstract):
    from tallymark.vocab import TITLE_ABSTRACT_SEPARATOR

    return (title or "") + TITLE_ABSTRACT_SEPARATOR + (abstract or "")


@pytest.fixture(scope="module")
def words():
    rng = random.Random(4)
    return sorted({"".join(rng.choice("abcdeilmnorst") for _ in range(rng.randint(2, 9))) for _ in range(400)})


def found(annotated):
    rows = annotated.where("reason IS NULL OR reason = 'non_specialty_only'").select("pmid", "fired").collect()
    return {(r.pmid, f.ordinal, f.n_hits) for r in rows for f in r.fired if f.ordinal >= 0}


def test_twenty_thousand_rules(spark, words):
    rows, book = corpus(80, words), large_book(20_000, words)
    records = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert len(book.rules) > 20_000
    run = label_corpus(records, book, details=True)
    assert found(run.annotated) == expected(rows, book)
    plan = run.annotated._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and len(plan) < 2_000_000


@pytest.mark.parametrize("details", [False, True])
def test_index_and_unrolled_rules_agree(spark, words, details, monkeypatch):
    rows, book = corpus(120, words, 8) + [("", "x", None, 2020, "PubmedArticle", None), ("q", None, None, None, "PubmedArticle", "Review")], large_book(300, words, 9)
    rows += rows[:2]  # repeated rows
    records = spark.createDataFrame(rows, SCHEMA)
    outs = []
    for most in (400, 0):
        monkeypatch.setattr(labelling, "UNROLLED", most)
        run = label_corpus(records, book, (2015, 2025), details=details)
        tables = [run.labels, run.ledger] + ([run.hits] if details else [])
        outs.append([sorted(map(str, t.collect())) for t in tables] + [sorted(run.labels.columns)])
    assert outs[0] == outs[1]


def test_no_records_and_no_rules(spark, words, monkeypatch):
    monkeypatch.setattr(labelling, "UNROLLED", 0)
    book = large_book(20, words)
    assert label_corpus(spark.createDataFrame([], SCHEMA), book, details=True).labels.collect() == []
    (row,) = label_corpus(spark.createDataFrame([("1", "a", "b", 2020, "PubmedArticle", None)], SCHEMA), RuleBook.of([("theme", "a b", "include", 0, "phrase", None, "a")])).labels.collect()
    assert row["theme_a b"] == 1 and row["mod_other"] == 1
