import random

import pytest

from shelfloom.llm import substrings
from tests.llm.common import documents, found, with_extra, words


def by_hand(texts, depth):
    first = {}
    for i, t in texts:
        w = words(t)
        for k in range(len(w) - depth + 1):
            key = tuple(w[k : k + depth])
            first[key] = min(first.get(key, i), i)
    rows = []
    for i, t in texts:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - depth + 1):
            if first[tuple(w[k : k + depth])] < i:
                gone[k : k + depth] = [True] * depth
        rows.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(rows, key=repr)


def corpus(seed, n=60):
    """Texts with passages of each other, some of them within a document twice."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 9 == 0 else f"w{i}" for i in range(60)]
    passages = [[draw.choice(vocabulary) for _ in range(draw.randint(5, 90))] for _ in range(8)]
    texts = []
    for i in range(n):
        parts = []
        for _ in range(draw.randint(1, 6)):
            if draw.random() < 0.5:
                parts += draw.choice(passages)
            else:
                parts += [draw.choice(vocabulary) for _ in range(draw.randint(0, 40))]
        texts.append((i * 3, draw.choice([" ", "\n", " \t "]).join(parts)))
    draw.shuffle(texts)
    return texts


COLUMNS = ("doc_id", "n_words", "n_removed", "kept")


@pytest.mark.parametrize("depth", [50, 7, 1])
@pytest.mark.parametrize("group", [substrings.GROUP, 10])
def test_removal_as_by_hand(spark, depth, group):
    texts = corpus(depth)
    result = substrings.remove_repeats(with_extra(documents(spark, texts)), depth=depth, group=group)
    assert found(result, *COLUMNS) == by_hand(texts, depth)


def test_nulls_empty_long_and_repeated(spark):
    run = " ".join(f"a{i}" for i in range(60))
    long = "b " * 20_000
    texts = [(1, run), (1, run), (2, "x " + run + " y"), (3, None), (4, ""), (5, " \n "), (6, long), (7, long + "end")]
    rows = found(substrings.remove_repeats(documents(spark, texts + [(None, run)])), *COLUMNS)
    assert rows == sorted(
        [(1, 60, 0, run), (1, 60, 0, run), (2, 62, 60, "x y"), (3, 0, 0, ""), (4, 0, 0, ""), (5, 0, 0, ""),
         (6, 20_000, 0, long.strip()), (7, 20_001, 20_000, "end"), (None, 60, 0, run)], key=repr)


def test_empty_table(spark):
    assert substrings.remove_repeats(documents(spark, [])).count() == 0


def test_rows_of_one_id_and_different_length(spark):
    run = " ".join(f"a{i}" for i in range(60))
    rows = found(substrings.remove_repeats(documents(spark, [(1, run), (2, "z z " + run), (2, "short"), (3, "q r")])), *COLUMNS)
    assert rows[0] == (1, 60, 0, run) and rows[-1] == (3, 2, 0, "q r")
    assert (2, 62, 60, "z z") in rows


def test_second_hashes_tell_windows_apart(spark):
    """A document whose windows have the nodes of another one, as by a collision, keeps its words."""
    import numpy as np
    import pyarrow as pa

    texts = pa.array(["a b c d e f", "a b c d e g a b c d"])
    found_ = substrings._Suffixes(texts, 4)
    checks, nodes = found_.checks(), found_.named()[3]
    place, owner = found_.named()[:2]
    own = checks[found_.before[owner] + place]
    # Equal windows agree in both hashes, others in neither.
    equal = nodes[:, None] == nodes[None, :]
    assert (equal == (own[:, None] == own[None, :])).all() and equal.sum() > len(nodes)
    assert not np.isin(own, nodes).any()
