import hashlib
from collections import defaultdict

import pytest

from shelfloom.llm import exact
from tests.llm.common import ascii_lower, documents, found, with_extra

LONG = "Word " * 60_000
TEXTS = [
    (1, "A b"), (2, "a B"), (3, "É"), (4, "é"), (5, None), (6, ""), (7, LONG), (8, LONG.upper()),
    (9, "x "), (10, "x"), (11, "a b"), (None, "a b"), (None, "lone"),
]


def expected(texts, keep):
    groups = defaultdict(list)
    for i, t in texts:
        groups[ascii_lower(t)].append(i)
    best = {t: keep([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    rows = []
    for i, t in texts:
        norm = ascii_lower(t)
        sha = hashlib.sha256(norm.encode()).hexdigest()
        rows.append((i, best[norm], len(groups[norm]), i == best[norm], sha))
    return sorted(rows, key=repr)


@pytest.mark.parametrize("keep, best", [("largest", max), ("smallest", min)])
@pytest.mark.parametrize("runs, fan_in", [(64, 8), (7, 2), (1, 8)])
def test_copies_as_by_hand(spark, keep, best, runs, fan_in):
    result = exact.exact_copies(documents(spark, TEXTS), keep=keep, runs=runs, fan_in=fan_in)
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert found(result, *columns) == expected(TEXTS, best)


def test_repeated_rows_keep_one(spark):
    docs = documents(spark, [(1, "a"), (1, "a"), (1, "A"), (2, "b")])
    result = found(exact.exact_copies(docs), "doc_id", "group_size", "kept")
    assert result == [(1, 3, False), (1, 3, False), (1, 3, True), (2, 1, True)]
    assert exact.drop_copies(docs).count() == 2


def test_drop_keeps_all_columns_and_one_of_each(spark):
    docs = with_extra(documents(spark, TEXTS))
    kept = exact.drop_copies(docs)
    assert kept.schema == docs.schema
    stays = [r for r in expected(TEXTS, max) if r[3]]
    assert found(kept, "doc_id") == sorted(((r[0],) for r in stays), key=repr)


def test_empty_table(spark):
    docs = documents(spark, [])
    assert exact.exact_copies(docs).count() == 0
    assert exact.drop_copies(docs).count() == 0


def test_hot_group_meets_only_as_digest_rows(spark):
    docs = documents(spark, [(i, "same" if i % 3 else f"t{i}") for i in range(3000)])
    result = exact.exact_copies(docs)
    assert result.where("kept").count() == 1001
    assert result.where("NOT kept").select("keep_id").distinct().count() == 1
