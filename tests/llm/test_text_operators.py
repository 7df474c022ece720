"""Operators over texts against plain Python, on small tables with nulls, repeats and edge cases."""

import hashlib
import random
import re

from tallymark.llm.chat import read_back, segments
from tallymark.llm.decontaminate import drop_contaminated, report
from tallymark.llm.language import keep_known, predict, train
from tallymark.llm.substring_dedup import drop_repeats


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_repeats_equal_brute_force(docs):
    r = random.Random(2)
    passages = [[f"w{r.randrange(10**6)}" for _ in range(80)] for _ in range(3)]
    rows = []
    for i in range(30):
        words = [f"x{r.randrange(10**6)}" for _ in range(40)]
        for p in r.sample(passages, r.randint(0, 2)):
            a = r.randint(0, 25)
            words += [*p[a:], f"y{i}"]
        rows.append((i, "  ".join(words)))
    rows += [(30, None), (31, ""), (32, rows[0][1])]
    seen, wanted = set(), {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = [tuple(words[j : j + 50]) for j in range(len(words) - 49)]
        gone = {p for j, w in enumerate(windows) if w in seen for p in range(j, j + 50)}
        seen |= set(windows)
        wanted[i] = (len(words), len(gone), digest(" ".join(w for j, w in enumerate(words) if j not in gone)))
    found = drop_repeats(docs(rows)).collect()
    assert {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in found} == wanted
    assert any(n for _, n, _ in wanted.values())
    assert drop_repeats(docs([])).collect() == []


def test_contaminated_documents(spark, docs):
    item = " ".join(f"q{i}" for i in range(12))
    bench = spark.createDataFrame([(1, item), (2, "short one"), (3, None), (None, "lost item")], "item_id long, text string")
    rows = [(0, "before " + item.upper() + "!"), (1, "a short, one here"), (2, "lost item"), (3, None), (4, "")]
    found = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in report(docs(rows), bench).collect()}
    assert found[0] == (12, 1, digest("1"), True) and found[1] == (2, 1, digest("2"), True)
    assert {found[i] for i in (2, 3, 4)} == {(0, 0, digest(""), False)}
    for at_once in (1_000_000, 2):
        assert sorted(r.doc_id for r in drop_contaminated(docs(rows), bench, at_once=at_once).collect()) == [2, 3, 4]


def test_languages(spark, docs):
    texts = {"xx": "abba abab baba", "yy": "cddc cdcd dcdc"}
    model = train(spark.createDataFrame([(t, x) for x, t in texts.items()] * 5 + [("zzz", None)], "text string, lang string"))
    rows = [(0, "abab!"), (1, "Dcdc cd"), (2, None), (3, "12 34"), (4, "")]
    found = {r.doc_id: (r.lang_pred, r.score) for r in predict(docs(rows), model).collect()}
    assert [found[i][0] for i in range(5)] == ["xx", "yy", "und", "und", "und"] and all(0 <= s <= 1 for _, s in found.values())
    assert sorted(r.doc_id for r in keep_known(docs(rows), model, 0.5).collect()) == [0, 1]


def test_a_long_text_in_a_rare_language_outweighs_the_prior(spark, docs):
    # the two differ in the share of a letter only
    rows = [("aaab aaab aabb " * 20, "often")] * 2_000 + [("aaab aabb aabb " * 20, "rare")]
    model = train(spark.createDataFrame(rows, "text string, lang string"))
    text = "aaab aabb aabb "
    found = {r.doc_id: (r.lang_pred, r.score) for r in predict(docs([(0, "aaab"), (1, text * 2_000)]), model).collect()}
    assert [found[i][0] for i in (0, 1)] == ["often", "rare"] and 0.5 <= found[1][1] <= 1


def test_conversations_read_back(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 1, "assistant", said), (1, 0, "user", "hi <\\|x"), (2, 0, "assistant", None), (2, 0, None, "t")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in read_back(segments(turns)).collect()}
    assert found[1].turns_sha256 == digest(f"user\nhi <\\|x\nassistant\n{said}\n")
    assert (found[1].loss_chars, found[1].loss_sha256, found[1].in_order) == (len(said), digest(said), True)
    assert (found[2].n_turns, found[2].loss_chars, found[2].in_order) == (2, 0, False)
