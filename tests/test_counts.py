"""Counts, grids, ranking and de-duplication against plain Python."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallymark.operators import contracts, counts, dedup, grids, ranking

THEMES = ("foundation_models", "multimodal_integration")
MODS = ("mri", "ct", "other")


@pytest.fixture(scope="module")
def table():
    rng = random.Random(3)
    rows = []
    for i in range(400):
        flags = [int(rng.random() < 0.4) for _ in THEMES] + [int(rng.random() < 0.5) for _ in MODS]
        flags[-1] = flags[-1] or int(not any(flags[2:4]))
        domain = "radiology" if flags[2] or flags[3] else "none"
        rows.append((str(i), rng.choice([2018, 2019, 2022]), *flags, domain, int(rng.random() < 0.8)))
    return rows


@pytest.fixture(scope="module")
def labels(spark, table):
    columns = ["pmid string", "year int", *[f"theme_{k} int" for k in THEMES], *[f"mod_{k} int" for k in MODS]]
    return spark.createDataFrame(table, ", ".join([*columns, "domain string", "is_primary_research int"]))


def expected_combos(table, primary=True):
    found = Counter()
    for row in table:
        if primary and not row[-1]:
            continue
        mods = sorted(k for k, f in zip(MODS, row[4:7]) if f)
        for theme, flag in zip(THEMES, row[2:4]):
            if flag and not (primary and theme == "multimodal_integration" and len(mods) < 2):
                found[(theme, "+".join(mods), len(mods))] += 1
    return found


def test_combination_counts_and_ranks(labels, table):
    want = expected_combos(table)
    got = counts.combination_counts(labels).collect()
    assert {(r["theme"], r["modality_set"], r["n_modalities"]): r["n_papers"] for r in got} == dict(want)
    for theme in THEMES:
        block = sorted((r for r in got if r["theme"] == theme), key=lambda r: r["rank_in_theme"])
        assert [r["rank_in_theme"] for r in block] == list(range(1, len(block) + 1))
        keys = [(-r["n_papers"], r["n_modalities"], r["modality_set"]) for r in block]
        assert keys == sorted(keys)


def test_profile_and_labels_give_the_same_counts(labels, rows):
    profile = counts.label_profile(labels)
    assert rows(counts.combination_counts(profile)) == rows(counts.combination_counts(labels))
    assert rows(counts.theme_year_counts(profile)) == rows(counts.theme_year_counts(labels))


def test_theme_years_are_dense_and_partition(labels, rows):
    series = counts.theme_year_counts(labels, partial_year=2022)
    assert series.count() == len(THEMES) * 5 * 5
    assert contracts.domains_sum_to_all(series).isEmpty()
    assert rows(series.where("partial_year = 1").select("year").distinct()) == [(2022,)]
    assert rows(series.where("year = 2020").select("n_papers").distinct()) == [(0,)]
    assert counts.theme_year_counts(labels, years=(2017, 2023)).where("year = 2017").count() == 10


def test_count_identities_hold(labels):
    profile = counts.label_profile(labels)
    totals = counts.label_totals(profile).where("kind = 'theme' AND key NOT LIKE '(%'")
    held = counts.minimum_shortfalls(profile)
    combos = counts.combination_counts(profile)
    assert contracts.combos_sum_to_theme(combos, totals, held).isEmpty()
    assert not contracts.combos_sum_to_theme(combos.limit(1), totals, held).isEmpty()


def test_empty_labels_give_empty_tables(labels):
    none = labels.where("pmid = 'x'")
    assert counts.combination_counts(none).isEmpty()
    assert counts.theme_year_counts(none).isEmpty()


def test_top_combinations_rule(spark, rows):
    def combos(sizes):
        return spark.createDataFrame(
            [("t", f"s{i}", 1 + i % 2, n) for i, n in enumerate(sizes)],
            "theme string, modality_set string, n_modalities int, n_papers bigint",
        )

    # enough sets above the floor: the singletons go to the remainder
    many = combos([5, 4, 1, 1])
    assert rows(counts.top_combinations(many, 2), "modality_set") == [("s0",), ("s1",)]
    # too few: singletons fill the block, richer sets first
    few = combos([5, 1, 1, 1])
    got = counts.top_combinations(few, 3).orderBy("position").collect()
    assert [r["modality_set"] for r in got] == ["s0", "s1", "s3"]
    tail = counts.tail_summary(few, 3).first()
    assert (tail["shown_sets"], tail["remainder_sets"], tail["remainder_papers"]) == (3, 1, 1)


def test_leading_zero_run(spark, rows):
    series = spark.createDataFrame(
        [("a", y, n) for y, n in zip(range(2010, 2016), [0, 0, 0, 1, 0, 2])]
        + [("b", y, n) for y, n in zip(range(2010, 2016), [0, 0, 1, 1, 0, 2])]
        + [("c", y, 0) for y in range(2010, 2016)],
        "k string, year int, n int",
    )
    assert rows(grids.leading_zero_run(series, ["k"], "n", 3)) == [("a", 2010, 2012)]


def test_keep_first_takes_blank_ids_as_copies(spark, rows):
    data = [("", "f2", 1), (None, "f1", 9), ("", "f1", 12), ("a", "f2", 0), ("a", "f1", 3), ("b", None, 1)]
    df = spark.createDataFrame(data, "id string, file string, pos int")
    first = dedup.keep_first(df, "id", ["file", "pos"]).na.fill("", ["file"])
    assert rows(first, "file", "pos") == [("", 1), ("f1", 3), ("f1", 9)]
    n = dedup.duplicate_count(df, "id").first()
    assert (n["n_rows"], n["n_unique"], n["n_duplicates"]) == (6, 3, 3)


def test_top_per_group_with_a_hot_group(spark):
    rng = random.Random(5)
    data = [("hot" if rng.random() < 0.7 else f"g{rng.randint(0, 9)}", rng.random(), i) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, v double, i int").repartition(6)
    got = ranking.top_per_group(df, ["g"], [F.col("v"), F.col("i")], 7, "pos", salts=8).collect()
    groups = defaultdict(list)
    for g, v, i in data:
        groups[g].append((v, i))
    want = {(g, n, i) for g, rows_ in groups.items() for n, (v, i) in enumerate(sorted(rows_)[:7], 1)}
    assert {(r["g"], r["pos"], r["i"]) for r in got} == want


@pytest.mark.parametrize("partitions", [1, 5])
def test_numbered_listing_equals_a_full_sort(spark, partitions):
    rng = random.Random(9)
    data = [("x" if rng.random() < 0.8 else "y", rng.randint(0, 5), i) for i in rng.sample(range(5000), 800)]
    df = spark.createDataFrame(data, "g string, d int, i int").repartition(7)
    got = ranking.numbered(df, ["d", "i"], "pos", ["g"], partitions).collect()
    for g in ("x", "y"):
        block = sorted((r for r in got if r["g"] == g), key=lambda r: r["pos"])
        assert [r["pos"] for r in block] == list(range(1, len(block) + 1))
        assert [(r["d"], r["i"]) for r in block] == sorted((d, i) for gg, d, i in data if gg == g)


def test_small_side_is_broadcast_and_a_large_one_is_not(spark):
    from tallymark.operators.joins import small

    side = spark.range(100)
    big = spark.range(1000)
    plan = lambda df: df._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(big.join(small(side), "id"))
    assert "broadcast" not in plan(big.join(small(side, 99), "id"))
