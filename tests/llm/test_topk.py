import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfloom.llm import topk
from tests.llm.common import found, with_extra


def by_hand(rows, k, asked):
    usable = [
        (i, [math.floor(1024 * float(x)) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    best = {}
    for i, v in usable:
        if asked(i):
            best[i] = max(best.get(i, (-1, [])), (len(v), v))
    result = []
    for q, (dim, v) in best.items():
        scores = [(-sum(a * b for a, b in zip(v, c)), i) for i, c in usable if i != q and len(c) == dim]
        result += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(result, key=repr)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def made(n, dim, seed, ties=False):
    draw = random.Random(seed)
    pick = (lambda: draw.choice([0.0, 0.5, -0.25])) if ties else (lambda: draw.uniform(-1, 1))
    # Rounded to what a float holds.
    return [(i, [round(pick() * 4096) / 4096 for _ in range(dim)]) for i in range(n)]


@pytest.mark.parametrize("ties", [False, True])
def test_all_queries_as_by_hand(spark, ties):
    rows = made(700, 6, 1, ties) + [(800, [0.5] * 6)] * 30 + [(900, [0.5] * 6)]
    result = topk.top_k(with_extra(vectors(spark, rows)), k=10, query_block=3, candidate_block=64)
    assert found(result, "query_id", "rank", "vec_id", "score") == by_hand(rows, 10, lambda i: i % 100 == 0)


def test_every_query_gets_all_its_rows(spark):
    draw = np.random.default_rng(9)
    units = draw.normal(size=(3000, 64))
    units = (units / np.linalg.norm(units, axis=1, keepdims=True)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(units)]
    whole = np.floor(1024 * units.astype(float)).astype(np.int64)
    expected = []
    for q in range(150):
        scores = whole @ whole[q]
        best = [i for i in np.lexsort((np.arange(len(rows)), -scores)).tolist() if i != q][:10]
        expected += [(q, n, i, int(scores[i])) for n, i in enumerate(best, 1)]
    result = topk.top_k(vectors(spark, rows), is_query=lambda i: i < 150, candidate_block=1024)
    result = result.collect()
    assert set(Counter(r["query_id"] for r in result).values()) == {10}
    assert sorted(map(tuple, result)) == expected


def test_every_vector_of_a_query_id_is_asked(spark):
    # Five vectors of one id, two of them equal, one of another dimension; and an id of many vectors.
    rows = made(400, 4, 5) + [(500, v) for _, v in made(3, 4, 6)] + [(500, [-1.0, 1.0, 0.5, 0.0])] * 2
    rows += [(500, [1.0, 2.0]), (501, [2.0, 1.0]), (502, [-1.0, 4.0])] + [(600, v) for _, v in made(90, 4, 7)]
    whole = [(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows]
    scores = {}
    for q, v in set(whole):
        if q % 100 == 0:
            scores.setdefault(q, []).extend(
                (-sum(a * b for a, b in zip(v, c)), i) for i, c in whole if i != q and len(c) == len(v)
            )
    expected = [(q, n, i, -s) for q, all_ in scores.items() for n, (s, i) in enumerate(sorted(all_)[:10], 1)]
    result = topk.top_k(vectors(spark, rows), query_block=8, candidate_block=64)
    assert found(result, "query_id", "rank", "vec_id", "score") == sorted(expected, key=repr)


def test_unusable_vectors_and_few_candidates(spark):
    rows = [
        (0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]),
        (5, [-3.0, 0.5]), (None, [1.0, 1.0]), (6, [1.0]), (100, [1.0]), (200, []), (7, []),
    ]
    result = topk.top_k(vectors(spark, rows))
    assert found(result, "query_id", "rank", "vec_id", "score") == by_hand(rows, 10, lambda i: i % 100 == 0)


def test_other_queries_and_k(spark):
    rows = made(120, 4, 2)
    result = topk.top_k(vectors(spark, rows), k=3, is_query=lambda i: i < 5)
    assert found(result, "query_id", "rank", "vec_id", "score") == by_hand(rows, 3, lambda i: i < 5)


def test_large_components_are_scored_exactly(spark):
    # Scores beyond 2^53 that differ in their last bits, one component of 3e38, and long ranges.
    rows = made(300, 5, 3) + [(1000 + i, [2.0**20, -(2.0**20) + i, 2.0**21, 3.0, -5.0]) for i in range(40)]
    rows += [(2000, [0.0] * 4 + [3e38]), (2001, [1e9, 1e9, 0.0, 0.0, 0.0])]
    rows += [(2003, [1.0, 1.0, 2e6, -2e6, 0.0]), (2004, [0.0, 0.0, -2e6, 0.0, 0.0])]
    rows = [(i, np.float32(v).tolist()) for i, v in rows]
    rows = [(i, v[:4] + [0.0]) if i < 2000 else (i, v) for i, v in rows]
    asked = lambda i: i % 100 == 0 or i in (2001, 2003)
    result = topk.top_k(vectors(spark, rows), is_query=lambda i: (i % 100 == 0) | i.isin(2001, 2003), candidate_block=64)
    assert found(result, "query_id", "rank", "vec_id", "score") == by_hand(rows, 10, asked)


def test_exact_scores_of_every_size():
    draw = np.random.default_rng(4)
    for bits in (20, 26, 30, 40, 70):
        q, c = (np.floor(draw.normal(size=(n, 5000)) * 2.0**bits) for n in (3, 4))
        q[0], c[0] = 0, 0
        if bits > 24:
            # Only small ones meet the large ones, or two large ones that cancel.
            q[1:, 6:], c[1:, :3], c[1:, 4:] = 0, 1, np.floor(draw.normal(size=4996) * 2.0**20)
            q[1:, :6] = [2.0**bits, -(2.0**bits), 7, -9, 0, 0]
            c[1:, :4] = [2.0**40, 2.0**40, -(2.0**30), 5]
        expected = [[sum(int(a) * int(b) for a, b in zip(x, y)) for y in c] for x in q]
        assert topk._exact_scores(q, c, np.ones((3, 4), dtype=bool)).tolist() == expected


def test_empty_table_and_large_components(spark):
    assert topk.top_k(vectors(spark, [])).count() == 0
    huge = vectors(spark, [(0, [1e9, 1.0]), (1, [1e9, 1.0])])
    with pytest.raises(Exception, match="too large for exact scores"):
        topk.top_k(huge).count()
    assert topk.whole_vectors(vectors(spark, [(0, [1.5])]), "vec_id", "embedding").select(
        F.element_at("values", 1)
    ).first()[0] == 1536
