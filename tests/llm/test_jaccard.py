import random
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfloom.llm import jaccard
from shelfloom.llm.components import components
from shelfloom.session import materialise
from tests.llm.common import ascii_lower, documents, found, with_extra, words


def by_hand(texts, width=4, percent=85):
    sets, where = {}, defaultdict(list)
    for i, t in texts:
        w = words(ascii_lower(t))
        grams = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
        sets[i] = sets.get(i, set()) | grams
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, grams in sets.items():
        shared = Counter(k for g in grams for k in where[g])
        for k, n in shared.items():
            if 100 * n >= percent * (len(grams) + len(sets[k]) - n):
                a, b = find(i), find(k)
                root[max(a, b)] = min(a, b)
        for g in grams:
            where[g].append(i)
    return sorted(((i, len(sets[i]), find(i)) for i in sets), key=repr)


def corpus(seed, groups=40, copies=6):
    """Groups of copies with a few changed words, beside short and unrelated texts."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(groups):
        base = [draw.choice(vocabulary) for _ in range(draw.choice([3, 5, 30, 120]))]
        for _ in range(draw.randint(1, copies)):
            own = list(base)
            for _ in range(draw.choice([0, 0, 1, 2, 4])):
                own[draw.randrange(len(own))] = draw.choice(vocabulary)
            texts.append(" ".join(own))
    draw.shuffle(texts)
    return list(enumerate(texts))


COLUMNS = ("doc_id", "n_shingles", "component_id")


@pytest.mark.parametrize("width, percent", [(4, 85), (5, 80)])
def test_components_as_by_hand(spark, width, percent):
    texts = corpus(1)
    result = jaccard.near_components(with_extra(documents(spark, texts)), width=width, percent=percent)
    assert found(result, *COLUMNS) == by_hand(texts, width, percent)


def test_large_regions_are_joined_about_centres(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "REGION", 5)
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    texts = corpus(2, groups=6, copies=90)
    result = jaccard.near_components(documents(spark, texts))
    assert found(result, *COLUMNS) == by_hand(texts)
    # Pivots dealt over several tasks.
    monkeypatch.setattr(jaccard, "SALTED", 10)
    result = jaccard.near_components(documents(spark, texts))
    assert found(result, *COLUMNS) == by_hand(texts)


def test_links_returned_grow_with_documents_not_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "REGION", 20)
    monkeypatch.setattr(jaccard, "BLOCK", 100)
    found_links, plain = [], jaccard.components
    monkeypatch.setattr(jaccard, "components", lambda links: (found_links.append(links.count()), plain(links))[1])
    for copies in (300, 1200):
        draw = random.Random(copies)
        base = [f"w{draw.randrange(500)}" for _ in range(150)]
        texts = []
        for i in range(copies):
            own = list(base)
            for _ in range(draw.randrange(5)):
                own[draw.randrange(150)] = f"x{draw.randrange(9999)}"
            texts.append((i, " ".join(own)))
        result = jaccard.near_components(documents(spark, texts))
        assert found(result, *COLUMNS) == by_hand(texts)
    # A forest per pivot and block: four times the documents, about as many times the edges.
    assert found_links[1] < 5 * found_links[0]


def near_copies(seed, copies, words=150):
    draw = random.Random(seed)
    base = [f"w{draw.randrange(500)}" for _ in range(words)]
    texts = []
    for i in range(copies):
        own = list(base)
        for _ in range(draw.randrange(5)):
            own[draw.randrange(words)] = f"x{draw.randrange(9999)}"
        texts.append((i, " ".join(own)))
    return texts


def test_a_set_goes_to_its_cluster_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "REGION", 20)
    sent, plain = spark.sparkContext.accumulator(0), jaccard._block_forest

    def counted(percent):
        run = plain(percent)

        def add(group):
            sent.add(group.num_rows)
            return run(group)

        return add

    monkeypatch.setattr(jaccard, "_block_forest", counted)
    # Copies of one text share many large regions; the others share only a line with each other.
    draw = random.Random(4)
    line = " ".join(f"line{k}" for k in range(60))
    others = [(500 + i, f"{line} " + " ".join(f"y{draw.randrange(10**6)}" for _ in range(60))) for i in range(200)]
    texts = near_copies(1, 300) + others
    result = jaccard.near_components(documents(spark, texts))
    assert found(result, *COLUMNS) == by_hand(texts)
    assert 0 < sent.value < 400


def test_regions_beyond_a_block_of_sketches(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "REGION", 4)
    monkeypatch.setattr(jaccard, "SKETCHES", 9)
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    texts = corpus(6, groups=8, copies=40) + [(5000 + i, t) for i, t in near_copies(2, 25, words=1500)]
    for width, percent in ((4, 85), (2, 100)):
        result = jaccard.near_components(documents(spark, texts), width=width, percent=percent)
        assert found(result, *COLUMNS) == by_hand(texts, width, percent)


def test_sketches_differ_no_more_than_sets():
    draw = np.random.default_rng(3)
    sets = []
    for n in (1, 40, 900, 1024, 1025, 1200, 2100, 40_000):
        grams = np.unique(draw.integers(0, 1 << 63, n).astype(np.uint64))
        sets += [grams, grams[: max(1, n - n // 9)], np.unique(draw.integers(0, 1 << 63, n).astype(np.uint64))]
    sketches = pa.array([jaccard._sketch(g).tobytes() for g in sets], pa.binary())
    places = [(i, j) for i in range(len(sets)) for j in range(len(sets))]
    left, right = (sketches.take(pa.array([p[k] for p in places])) for k in (0, 1))
    for (i, j), apart in zip(places, jaccard._apart(left, right).to_pylist()):
        assert apart <= len(np.setxor1d(sets[i], sets[j])) and (i != j or apart == 0)
    # Unlike sets are told apart at every size up to the largest sketch.
    for k in range(3, len(sets), 3):
        total = len(sets[k]) + len(sets[k + 2])
        one, two = (sketches.slice(x, 1) for x in (k, k + 2))
        assert jaccard._apart(one, two)[0].as_py() > jaccard._most_apart(total, 85)


def test_shuffle_files_go_with_their_step(spark):
    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def files():
        names = (f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.getAllFiles()))
        return {n for n in names if n.startswith("shuffle_")}

    before = files()
    sums = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    kept = materialise(sums, "freed", free=True)
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before
    assert kept.agg(F.sum("count")).first()[0] == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_overlaps_of_all_pairs():
    draw = np.random.default_rng(1)
    sets = [np.unique(draw.integers(0, 9000, n).astype(np.uint64)) for n in (0, 5, 900, 7000, 8000)]
    wanted = [[len(np.intersect1d(a, b)) for b in sets] for a in sets[:3]]
    assert jaccard.overlaps(sets[:3], sets).tolist() == wanted


def test_nulls_empty_short_long_and_repeated(spark):
    texts = [
        (5, "A b"), (3, "a B"), (9, "a b c"), (1, None), (2, ""), (4, " \n"), (7, "x " * 30_000), (6, "X " * 29_000),
        (8, "a b c"), (8, "a b c"),
    ]
    rows = found(jaccard.near_components(documents(spark, texts + [(None, "a b"), (None, None)])), *COLUMNS)
    assert rows == sorted(
        [(5, 1, 3), (3, 1, 3), (9, 1, 8), (1, 0, 1), (2, 0, 2), (4, 0, 4), (7, 1, 6), (6, 1, 6), (8, 1, 8), (8, 1, 8),
         (None, 1, None), (None, 0, None)], key=repr)


def test_empty_table(spark):
    assert jaccard.near_components(documents(spark, [])).count() == 0


def test_links_are_followed_along_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (5, 5)], "u long, v long")
    roots = dict(found(components(links), "node", "root"))
    assert roots == {i: 1 for i in range(2, 61)} | {101: 100}


@pytest.mark.parametrize("percent", [85, 80, 50])
def test_bounds_hold_for_every_linked_pair_of_sizes(percent):
    for a in range(1, 60):
        for b in range(1, a + 1):
            for common in range(b + 1):
                if 100 * common >= percent * (a + b - common):
                    assert common >= jaccard.least_common(a + b, percent)
                    assert a - common <= jaccard.spare_as_larger(a, percent)
                    assert b - common <= jaccard.spare_as_smaller(b, percent)


def test_one_of_each_group_stays(spark):
    texts = corpus(3)
    docs = with_extra(documents(spark, texts + [(None, "null id stays")]))
    kept = jaccard.drop_near_copies(docs, width=5, percent=80)
    assert kept.schema == docs.schema
    wanted = [(i,) for i, _, root in by_hand(texts, 5, 80) if i == root] + [(None,)]
    assert found(kept, "doc_id") == sorted(wanted, key=repr)
