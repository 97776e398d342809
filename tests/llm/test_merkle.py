import hashlib
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from shelfloom.llm import merkle
from tests.llm.common import SCHEMA, ascii_lower, found, with_extra


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])))


def grow(digests):
    """The root of one tree, and the siblings (before, after) of each leaf up to it."""
    proofs, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for i, place in enumerate(at):
            run = place - place % 16
            proofs[i].append(("".join(digests[run:place]), "".join(digests[place + 1 : run + 16])))
            at[i] = place // 16
        digests = [digest(*digests[i : i + 16]) for i in range(0, len(digests), 16)]
    return digests[0], proofs


def by_hand(rows):
    trees = defaultdict(list)
    for row in rows:
        trees[row[3]].append((row[0] is not None, row[0] or 0, leaf_of(row), row))
    grown = {source: grow([t[2] for t in sorted(leaves, key=lambda t: t[:3])]) for source, leaves in trees.items()}
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    root, upper = grow([grown[s][0] for s in order])
    result = []
    for place, source in enumerate(order):
        for (_, _, leaf, row), proof in zip(sorted(trees[source], key=lambda t: t[:3]), grown[source][1]):
            path = proof + upper[place]
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[1] is not None
            fold = leaf_of((row[0], ascii_lower(row[1]), *row[2:])) if hit else leaf
            for before, after in path:
                fold = digest(before, fold, after)
            siblings = digest(*(before + after for before, after in path))
            result.append((row[0], leaf, grown[source][0], root, siblings, fold, fold == root))
    return sorted(result, key=repr)


def entries(docs):
    changed = {"text": merkle.tampered(F.col("text"), F.col("doc_id"))}
    found_ = merkle.manifest(docs, changed=changed).withColumn("fold", merkle.fold(F.col("changed"), F.col("path")))
    proof, verified = merkle.proof(F.col("path")), F.col("fold") == F.col("root")
    return found(found_.select("id", "leaf", "subroot", "root", proof, "fold", verified), "*")


def rows_of(sizes):
    rows, doc = [], 0
    for source, size in sizes.items():
        for _ in range(size):
            doc += 7
            rows.append((doc % 1009, f"Text {doc} ÄB", "en", source, doc))
    return rows


def test_trees_of_many_sizes(spark):
    sizes = {None: 17, "one": 1, "é": 16, "z": 257, "a": 33, "": 2} | {f"s{i}": 1 + i % 3 for i in range(20)}
    rows = rows_of(sizes)
    assert entries(spark.createDataFrame(rows, SCHEMA)) == by_hand(rows)


def test_one_source_is_the_root_and_a_single_row_its_own(spark):
    rows = rows_of({"only": 40})
    assert entries(spark.createDataFrame(rows, SCHEMA)) == by_hand(rows)
    rows = [(10, "Alone", None, None, None)]
    assert entries(spark.createDataFrame(rows, SCHEMA)) == by_hand(rows)


def test_nulls_empty_long_repeated_and_extra_columns(spark):
    rows = [
        (None, "A", None, "s", None), (3, None, "en", "s", 0), (3, "", "en", "s", 0), (8, "X" * 300_000, "", "s", 3),
        (8, "same", "en", "s", 4), (8, "same", "en", "s", 4), (5, "UP", "en", None, 2), (-7, "Ä", "en", "", 1),
    ] * 3
    docs = with_extra(spark.createDataFrame(rows, SCHEMA))
    docs = docs.withColumns({n: F.lit("x") for n in ("id", "leaf", "tree", "place", "path", "kids")})
    assert entries(docs) == by_hand(rows)


def test_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_changed_leaf_never_leads_to_the_root(spark):
    rows = rows_of({"a": 50, "b": 3})
    for doc, leaf, _, root, _, fold, verified in entries(spark.createDataFrame(rows, SCHEMA)):
        tampered = zlib.crc32(str(doc).encode()) % 5 == 0
        assert verified is not tampered and (fold == root) is verified
