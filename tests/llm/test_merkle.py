"""The Merkle manifest against a plain tree in Python."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tallymark.llm.merkle import folded, leaf_digest, lower_ascii, manifest, siblings


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(digests):
    """The root over ``digests`` and, for each of them, its path of (left, right)."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for i, p in enumerate(paths):
            run, k = level[at[i] // 16 * 16 : at[i] // 16 * 16 + 16], at[i] % 16
            p.append(("".join(run[:k]), "".join(run[k + 1 :])))
            at[i] //= 16
        level = [h(*level[i : i + 16]) for i in range(0, len(level), 16)]
    return (level[0] if level else None), paths


def plain(rows):
    """(doc_id, leaf, subroot, root, path) of rows (doc_id, source, text)."""
    trees = {}
    for i, source, text in rows:
        trees.setdefault(source, []).append((i is not None, i or 0, leaf(i, source, text), i))
    sources = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    grown = {s: climb([d for _, _, d, _ in sorted(trees[s], key=lambda x: x[:3])]) for s in sources}
    root, over = climb([grown[s][0] for s in sources])
    return sorted(
        (repr(i), d, grown[s][0], root, p + q)
        for s, q in zip(sources, over)
        for (_, _, d, i), p in zip(sorted(trees[s], key=lambda x: x[:3]), grown[s][1])
    )


def built(df, carry=()):
    rows = df.withColumn("leaf", leaf_digest(F.col("doc_id"), F.col("source"), F.col("text")))
    return manifest(rows, "source", ["doc_id"], carry=carry)


def collected(df):
    return sorted((repr(r.doc_id), r.leaf, r.subroot, r.root, [(s.left, s.right) for s in r.path]) for r in df.collect())


SCHEMA = "doc_id long, source string, text string"


@pytest.mark.parametrize("sizes", [(1,), (2,), (16,), (17, 1), (256, 3), (257, 16, 1), (700, 40, 5)])
def test_trees_of_all_heights(spark, sizes):
    rows = [(i * 7 % 1009, f"s{g}", f"text {g} {i}") for g, n in enumerate(sizes) for i in range(n)]
    assert collected(built(spark.createDataFrame(rows[::-1], SCHEMA).repartition(5))) == plain(rows)


def test_many_groups(spark):
    rows = [(i, f"é{i % 300}" if i % 2 else f"z{i % 300}", "x") for i in range(600)]
    assert collected(built(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_edge_cases(spark):
    long = "Wörter 漢字 " * 50_000
    rows = [(1, None, None), (1, None, None), (1, None, ""), (None, "a", "x"), (None, None, "x"), (2, "", long), (3, "", "x"), (3, "", "y"), (3, "", "x")]
    table = spark.createDataFrame([(*r, "t", 1, "b", "i", 2) for r in rows], SCHEMA + ", tree string, at int, below string, it string, levels int")
    assert collected(built(table)) == plain(rows)
    assert built(spark.createDataFrame([], SCHEMA)).collect() == []
    (only,) = built(spark.createDataFrame(rows[:1], SCHEMA)).collect()
    assert only.root == only.subroot == only.leaf and only.path == []


def test_tampered_rows_miss_the_root(spark):
    rows = [(i, "a" if i % 3 else "b", "Text" if i % 2 else "text") for i in range(100)]
    seen = leaf_digest(F.col("doc_id"), F.col("source"), lower_ascii(F.col("text")))
    proofs = built(spark.createDataFrame(rows, SCHEMA).withColumn("seen", seen), ["seen"])
    out = proofs.select("doc_id", (folded(F.col("seen"), F.col("path")) == F.col("root")).alias("ok"), siblings(F.col("path")).alias("beside"))
    for r in out.collect():
        assert r.ok == (r.doc_id % 2 == 0) and len(r.beside) % 64 == 0
