import math
import random

from pyspark.sql import functions as F

from tallymark.llm import jaccard_join
from tallymark.llm.jaccard_join import LEVELS, RECALL, SPLIT_RATE, components, join, keep_one, runs_for


def shingles(text):
    import re

    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    links = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(len(rows))]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        todo, seen = [i], {i}
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        group[i] = min(rows[j][0] for j in seen)
    return {(r[0], group[i], len(links[i])) for i, r in enumerate(rows)}


def corpus(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    line = [word() for _ in range(30)]  # stands in many texts
    rows = []
    for family in range(12):
        base = [word() for _ in range(r.randint(40, 120))] + line
        for _ in range(r.randint(1, 8)):
            own = list(base)
            for _ in range(r.randint(0, 4)):
                own[r.randrange(len(own))] = word()
            rows.append((len(rows), " ".join(own)))
    return [*rows, (len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, "One two"), (len(rows) + 3, "one, TWO"), (len(rows) + 4, rows[0][1])]


def test_equals_brute_force_in_small_and_in_split_buckets(docs):
    rows = corpus()
    for bucket in (512, 8):
        found = join(docs(rows), bucket=bucket).collect()
        assert {(r.doc_id, r.class_id, r.n_links) for r in found} == brute(rows)
        assert len(found) == len(rows)


def test_groups_with_the_same_shared_tokens_survive_a_split(docs):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    bodies = [" ".join(word() for _ in range(60)) for _ in range(300)]
    rows = [(24 * i + j, f"{body} {word()} {word()}") for i, body in enumerate(bodies) for j in range(24)]
    found = join(docs(rows), bucket=8).collect()
    assert {(x.doc_id, x.class_id, x.n_links) for x in found} == {(i, i - i % 24, 23) for i, _ in rows}


def test_recall_counts_the_loss_of_every_split(docs):
    missed = 1 - (1 - math.exp(-1)) * (1 - math.exp(-SPLIT_RATE)) ** (LEVELS - 1)
    assert RECALL >= 1 - 1e-6
    assert all(missed ** runs_for(recall) <= 1 - recall for recall in (0.5, 0.9, 0.99, 0.999, RECALL))
    # texts that hold a shorter one, just similar enough, in buckets that are split
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    rows = []
    for i in range(200):
        body = [word() for _ in range(84)]
        rows += [(12 * i + j, " ".join(body + [word() for _ in range(20 if j else 0)])) for j in range(12)]
    found = join(docs(rows), bucket=8).collect()
    assert {(x.doc_id, x.class_id, x.n_links) for x in found} == {(i, i - i % 12, 1 if i % 12 else 11) for i, _ in rows}


def test_one_of_each_group_stays_with_all_its_columns(spark):
    rows = corpus()
    table = spark.createDataFrame([(i, t, "x", i) for i, t in rows] + [(0, rows[0][1], "x", 0)], "doc_id long, text string, k1 string, d1 long")
    kept = keep_one(table)
    assert kept.columns == table.columns
    wordless = {i for i, t in rows if not shingles(t)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _ in brute(rows)} | wordless)


def test_empty_table_and_missing_ids(docs):
    assert join(docs([])).collect() == []
    assert keep_one(docs([])).collect() == []
    found = {(r.doc_id, r.class_id, r.n_links) for r in join(docs([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f")])).collect()}
    assert found == {(None, 4, 2), (4, 4, 2)}


def test_components_of_a_long_chain(spark):
    order = list(range(60))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(59)] + [(100, 101), (7, 7)], "u long, v long")
    found = {r.node: r.root for r in components(edges).collect()}
    assert all(found[x] == 0 for x in order) and found[101] == found[100] == 100


def test_sieve_keeps_every_asked_row_and_drops_most_others(spark, monkeypatch):
    rows = spark.range(20_000).select(F.xxhash64("id").alias("k1"), F.xxhash64("id", F.lit(1)).alias("k2"), "id")
    asked = rows.where("id % 20 = 0").select("k1", "k2")
    kept = {r.id for r in jaccard_join._sieved(rows, asked).collect()}
    assert kept >= set(range(0, 20_000, 20)) and len(kept) < 4_000
    monkeypatch.setattr(jaccard_join, "SIEVE_BITS", 40)
    assert {r.id for r in jaccard_join._sieved(rows, asked).collect()} >= set(range(0, 20_000, 20))


def test_lone_sets_are_classes_as_they_stand(docs, monkeypatch):
    rows = [*corpus(), *((1000 + i, "the same text for each of these") for i in range(30)), (5, "own words of this one text"), (5, "own words of this one text")]
    for bits in (jaccard_join.SIEVE_BITS, 40):
        monkeypatch.setattr(jaccard_join, "SIEVE_BITS", bits)
        described = jaccard_join._described(docs(rows), 3, 0.8)
        plain = described.where("n > 0").groupBy("d1", "d2").agg(F.count("*"), F.min("doc_id"), F.min(F.struct("k1", "k2")), F.first("n"), F.first("sketch"), F.first("chosen"), F.first("splits"))
        assert sorted(jaccard_join._classes(described).collect()) == sorted(plain.collect())


def test_sieve_tells_asked_rows_from_the_others(spark):
    rows = spark.range(3_000).select(F.xxhash64("id").alias("path"), "id")
    for asked in (rows.where("id % 7 = 0"), rows.where("false")):
        kept, rest = ({r.id for r in jaccard_join._sieved(rows, asked, "path", others).collect()} for others in (False, True))
        assert kept | rest == set(range(3_000)) and not kept & rest
        assert kept >= {r.id for r in asked.collect()} and len(kept) < 1_000


def shuffled(spark, work):
    """Bytes that the stages of ``work`` wrote for shuffles."""
    context = spark.sparkContext
    group = f"shuffled-{random.random()}"
    context.setJobGroup(group, "")
    work()
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages if tracker.getStageInfo(s))


def test_texts_that_share_nothing_are_hardly_shuffled(spark, docs):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    rows = [(i, " ".join(word() for _ in range(80))) for i in range(3_000)]
    moved = {}
    for n in (1_000, 3_000):
        found = []
        moved[n] = shuffled(spark, lambda n=n, found=found: found.extend(join(docs(rows[:n])).collect()))
        assert {(x.doc_id, x.class_id, x.n_links) for x in found} == {(i, i, 0) for i in range(n)}
    assert moved[3_000] < 800 * 3_000 and moved[3_000] < 3.3 * moved[1_000], moved
