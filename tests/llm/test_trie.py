import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shelfloom.llm import trie
from shelfloom.session import materialise
from tests.llm.common import found, words

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = (
    "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
)


def turns_by_hand(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, digest[:32], (role, text)))
    return {c: [t[-1] for t in sorted(ts)] for c, ts in own.items()}


def rebuilt_by_hand(rows):
    own, result = turns_by_hand(rows), {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        result[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    return result


def trie_by_hand(conversations):
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, inside in members.items():
        own = (len(inside) - 1) * len(words(node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += own
            leaves[node[:d]] += node not in children
    rows = []
    for node, inside in members.items():
        ends = ",".join(map(str, sorted(c for c in inside if len(conversations[c]) == len(node))))
        up = min(members[node[:-1]]) if node else None
        rows.append((min(inside), len(node), up, len(inside), children[node], leaves[node], saved[node],
                     hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


def corpus(seed, conversations=300, texts=4):
    draw, rows = random.Random(seed), []
    for c in range(conversations):
        for turn in range(draw.choice([1, 2, 2, 3, 5, 9])):
            rows.append((c, turn, draw.choice(["user", "assistant"]), "a b " * draw.randrange(texts)))
    draw.shuffle(rows)
    return rows


def conversations(spark, rows, rebuilt=True):
    turns = materialise(trie.turn_arrays(spark.createDataFrame(rows, SCHEMA)), "turns")
    return trie.graft(turns) if rebuilt else turns


@pytest.mark.parametrize("run_bytes", [1, 40, 2_000, 4 << 20])
def test_nodes_as_by_hand_whatever_the_runs(spark, run_bytes):
    rows = corpus(run_bytes)
    assert found(trie.prefix_trie(conversations(spark, rows), run_bytes), *COLUMNS) == trie_by_hand(rebuilt_by_hand(rows))


def test_nulls_ties_repeated_rows_and_conversations_without_turns(spark):
    rows = [
        (1, 0, "user", "x y"), (1, None, None, None), (1, 1, "user", "tie"), (1, 1, "user", "eit"), (1, 1, "user", "tie"),
        (2, 0, "u", "ser x"), (3, 0, "us", "er x"), (21, 5, "user", "only"), (22, 5, "user", "only"), (None, 0, "user", "x"),
        (-3, 0, "user", ""), (1 << 40, 0, "user", "far"), (47, 0, "user", "gone"),
    ]
    hand = trie_by_hand(rebuilt_by_hand(rows))
    assert found(trie.prefix_trie(conversations(spark, rows), 50), *COLUMNS) == hand
    # 21 gives one turn up and there is no conversation 20 to take turns from.
    assert () in rebuilt_by_hand(rows).values()


def test_empty_table(spark):
    assert trie.prefix_trie(conversations(spark, [])).count() == 0


def test_one_first_turn_and_one_conversation_shared_by_many(spark):
    draw, rows = random.Random(4), []
    for c in range(900):
        rows.append((c, 0, "system", "very common"))
        if c % 3:  # the others are all the same conversation
            rows += [(c, 1 + k, "user", f"{draw.randrange(300)} {k}") for k in range(draw.randrange(4))]
    result = trie.prefix_trie(conversations(spark, rows, rebuilt=False), 3_000)
    hand = trie_by_hand({c: tuple(t) for c, t in turns_by_hand(rows).items()})
    assert found(result, *COLUMNS) == hand


def test_long_conversations_with_long_common_starts(spark):
    rows = [(c, t, "user", f"word {t if t < 90 else t * c}") for c in range(5) for t in range(90 + 20 * c)]
    rows += [(9, 0, "user", "one text " * 50_000)]
    result = trie.prefix_trie(conversations(spark, rows, rebuilt=False), 3_000)
    assert found(result, *COLUMNS) == trie_by_hand({c: tuple(t) for c, t in turns_by_hand(rows).items()})


def test_other_columns_are_ignored(spark):
    rows = corpus(7, conversations=30)
    extra = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("x") for n in ("t", "key", "words", "ends", "_head", "depth")})
    result = trie.prefix_trie(trie.graft(materialise(trie.turn_arrays(extra), "turns")))
    assert found(result, *COLUMNS) == trie_by_hand(rebuilt_by_hand(rows))


def test_members_of_a_node_in_several_blocks(spark):
    ids = [5, 70_000, 65_535, 65_536, -1, -70_000, 1 << 33]
    result = trie.prefix_trie(conversations(spark, [(i, 0, "user", "same") for i in ids], rebuilt=False))
    wanted = hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    assert found(result.where("depth = 1"), "conv_id", "n_convs", "ends_sha256") == [(-70_000, 7, wanted)]


def test_layouts_grow_and_keep_their_children():
    for count in (4, 5, 16, 17, 48, 49, 256):
        keys = sorted(bytes([b * 255 // max(1, count - 1)]) + bytes(15) for b in range(count))
        root = trie.radix_tree(keys)
        assert root.layout == next(n for n in (4, 16, 48, 256) if n >= count)
        assert [bytes([b]) for b, _ in root.items()] == [k[:1] for k in keys]
        assert all(root.get(k[0]).row == i for i, k in enumerate(keys))


def test_keys_that_end_within_the_paths_of_others():
    keys = [b"", b"a" * 16, b"a" * 32, b"a" * 31 + b"b" + b"c" * 16]
    for order in (keys, keys[::-1]):
        root = trie.Branch(b"")
        for row, key in enumerate(order):
            trie.insert(root, key, row)
        for row, key in enumerate(order):
            node, at = root, 0
            while (at := at + len(node.path)) < len(key):
                node, at = node.get(key[at]), at + 1
            assert node.row == row
