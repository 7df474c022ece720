import math

import numpy as np
from pyspark.sql import functions as F

from tallymark.llm.neighbours import chi_square, nearest


def every_twentieth():
    return F.col("vec_id") % 20 == 0


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def brute(ids, vectors, query, k):
    scores = vectors @ vectors[np.flatnonzero(ids == query)[0]]
    order = [i for i in np.lexsort((ids, -scores)) if ids[i] != query][:k]
    return [int(ids[i]) for i in order]


def test_recall_and_scores_over_several_cells(spark):
    r = np.random.default_rng(1)
    vectors = (r.standard_normal((900, 24)) * r.uniform(0.5, 2, (900, 1))).astype(np.float32).astype(float)
    vectors[300:340] = vectors[5]
    ids = np.arange(900)
    found = nearest(table(spark, [(int(i), v.tolist()) for i, v in zip(ids, vectors, strict=True)]), every_twentieth(), cell_rows=100).collect()
    hits = 0
    for q in ids[::20]:
        own = sorted((x for x in found if x.query_id == q), key=lambda x: x.rank)
        assert [x.rank for x in own] == list(range(1, 21))
        assert [(-x.score, x.vec_id) for x in own] == sorted((-x.score, x.vec_id) for x in own)
        assert all(math.isclose(x.score, float(vectors[x.vec_id] @ vectors[q]), rel_tol=1e-12, abs_tol=1e-12) for x in own)
        hits += len({x.vec_id for x in own} & set(brute(ids, vectors, q, 20)))
    assert hits >= 0.9 * 20 * len(ids[::20])


def test_unusable_vectors_take_no_part_and_few_candidates_all_come(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [math.nan, 1.0])]
    rows += [(8, [math.inf, 1.0]), (9, [1.0, 1.0, 1.0]), (None, [1.0, 1.0]), (20, [-1.0, 0.0]), (40, None)]
    found = {(r.query_id, r["rank"], r.vec_id, r.score) for r in nearest(table(spark, rows), every_twentieth()).collect()}
    assert found == {(0, 1, 1, 0.5), (0, 2, 2, 0.5), (0, 3, 20, -1.0), (20, 1, 1, -0.5), (20, 2, 2, -0.5), (20, 3, 0, -1.0)}


def test_empty_table(spark):
    assert nearest(table(spark, []), every_twentieth()).collect() == []


def test_chi_square_quantiles():
    assert abs(chi_square(0.95, 12) - 21.03) < 0.05 and abs(chi_square(0.9, 8) - 13.36) < 0.05
