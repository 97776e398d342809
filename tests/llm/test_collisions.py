import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfloom.llm import collisions
from shelfloom.llm.components import components, unite
from tests.llm.common import found

SCHEMA = "vec_id long, embedding array<float>, label int"
COLUMNS = ("vec_id", "n_links", "component_id", "kept")


def links_by_hand(rows, cosine=0.98):
    groups = defaultdict(list)
    for i, v, label in rows:
        if i is not None and label is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            groups[label, len(v)].append((i, np.array(v, dtype=np.float32).astype(float)))
    pairs = set()
    for members in groups.values():
        ids, m = [i for i, _ in members], np.stack([v for _, v in members])
        m = m / np.abs(m).max(axis=1, keepdims=True)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(m @ m.T >= cosine)):
            if a < b:
                pairs.add((ids[a], ids[b], a, b))
    return pairs


def by_hand(rows):
    pairs = links_by_hand(rows)
    root, count = {i: i for i, _, _ in rows}, defaultdict(int)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b, _, _ in pairs:
        count[a] += 1
        count[b] += 1
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return sorted(((i, count[i], find(i), i == find(i)) for i, _, _ in rows), key=repr)


def vectors(seed, groups, copies, spread, dim=64, labels=2):
    draw, rows = np.random.default_rng(seed), []
    for g in range(groups):
        centre = draw.standard_normal(dim)
        for _ in range(int(draw.integers(1, copies + 1))):
            rows.append((len(rows) * 3, (centre + draw.uniform(0, spread) * draw.standard_normal(dim)).tolist(), g % labels))
    draw.shuffle(rows)
    return [(int(i), v, int(label)) for i, v, label in rows]


def near(spark, rows, **settings):
    return collisions.near_vectors(spark.createDataFrame(rows, SCHEMA), **settings)


def test_links_as_by_hand(spark):
    rows = vectors(1, groups=150, copies=6, spread=0.1)
    assert found(near(spark, rows), *COLUMNS) == by_hand(rows)


def test_recall_and_precision_over_many_small_cells(spark):
    rows = vectors(2, groups=500, copies=8, spread=0.2)
    hand, result = by_hand(rows), found(near(spark, rows, cell=64), *COLUMNS)
    wanted, got = sum(r[1] for r in hand), sum(r[1] for r in result)
    assert all(b[1] <= a[1] for a, b in zip(hand, result))  # no link that is none
    assert got >= 0.99 * wanted > 1000


def test_many_near_copies_of_one_vector_are_dealt_in_blocks(spark):
    draw = np.random.default_rng(3)
    centre = draw.standard_normal(16)
    rows = [(i, (centre + 0.02 * draw.standard_normal(16)).tolist(), 1) for i in range(600)]
    rows += [(1000 + i, draw.standard_normal(16).tolist(), 1) for i in range(600)]
    rows += [(3000 + i, [1.0] * 16, 1) for i in range(300)]
    result = found(near(spark, rows, cell=40), *COLUMNS)
    hand = by_hand(rows)
    assert sum(r[1] for r in result) >= 0.995 * sum(r[1] for r in hand)
    assert [r[2] for r in result] == [r[2] for r in hand]
    assert [r for r in result if r[0] >= 3000] == [(3000 + i, 299, 3000, i == 0) for i in range(300)]


def test_nulls_zeros_and_other_vectors_that_cannot_be_compared(spark):
    far, nan = [1e30, 0.0], float("nan")
    rows = [
        (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 2), (3, [2.0, 0.0], 1), (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1),
        (7, [0.0, -0.0], 1), (8, [1.0, None], 1), (9, [nan, 1.0], 1), (10, [float("inf"), 0.0], 1), (11, far, 1),
        (12, [1.0, 0.0, 0.0], 1), (14, [-0.0, 1.0], 2), (13, [0.0, 1.0], 2), (15, [-1.0, 0.0], 1), (16, [1e-30, 0.0], 1),
    ]
    result = found(near(spark, rows), *COLUMNS)
    assert result == by_hand(rows)
    assert dict((r[0], r[1]) for r in result)[1] == 3
    extra = near(spark, [(None, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1)])
    assert found(extra, *COLUMNS) == sorted([(None, 0, None, True), (3, 1, 3, True), (3, 1, 3, True)], key=repr)


def test_empty_table_and_extra_columns(spark):
    assert near(spark, []).count() == 0
    rows = vectors(4, groups=20, copies=4, spread=0.05)
    extra = {n: F.lit("x") for n in ("id", "node", "key", "vector", "times", "cells", "n_links", "table")}
    docs = spark.createDataFrame(rows, SCHEMA).withColumns(extra)
    assert found(collisions.near_vectors(docs), *COLUMNS) == by_hand(rows)


def test_counts_are_those_of_windows():
    places = np.random.default_rng(5).standard_normal((700, 7))
    wanted = (np.abs(places[:, None] - places[None]) <= 0.3).sum(axis=2)
    for first in (None, 250):
        for start, others, counts in collisions.window_counts(places, 0.3, first):
            assert (counts == wanted[start : start + len(counts), others:]).all()


def test_bounds_of_the_filters():
    share = collisions.normal_share(2.0)
    least = collisions.least_count(32, share, 0.002)
    chances = [math.comb(32, k) * share**k * (1 - share) ** (32 - k) for k in range(33)]
    assert sum(chances[:least]) <= 0.002 < sum(chances[: least + 1])
    for cuts in range(1, 12):
        missed = 1 - (1 - math.acos(0.98) / math.pi) ** cuts
        assert missed ** collisions.tables_for(cuts, 0.98, 0.002) <= 0.002


@pytest.mark.parametrize("seed", range(3))
def test_components_of_both_kinds(spark, seed):
    draw = np.random.default_rng(seed)
    links = draw.integers(0, 400, (300, 2))
    root = list(range(400))
    for _ in range(400):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    parent = np.arange(400)
    for part in np.array_split(links, 3):
        parent = unite(parent, part[:, 0], part[:, 1])
    assert parent.tolist() == root
    rows = components(spark.createDataFrame([tuple(map(int, p)) for p in links], "u long, v long"))
    assert dict(found(rows, "node", "root")) == {i: r for i, r in enumerate(root) if i != r}
