"""Prefix trie of conversations, from adaptive radix trees over runs of sorted keys.

A turn is a fixed-width big-endian id, the first 16 bytes of the digest of its role and text, and a
conversation is the key of its turn ids in a row. Equal keys become one row with a count before they
travel. Distinct keys are range-partitioned and sorted; a task reads them in runs of bounded size and
builds an adaptive radix tree of each: nodes of 4, 16, 48 or 256 slots that grow with their children,
and compressed paths. Branches may lie within a turn id; only byte depths that end a turn are nodes of
the trie.

Runs are pieces of one order, so a node that two runs share lies on the path of the first or last key
of each. Those paths leave a run as one row per key with what the run adds to their nodes, and are
folded in order of keys. All other nodes are whole within their run. So a prefix that a third of all
conversations share is counted by many tasks, and none of them holds it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfloom.llm.mixing import word_count
from shelfloom.session import materialise

# Bytes of a turn id, and about how many bytes of keys make a run.
TURN = 16
RUN = 4 << 20
# Ids of the members of a node are first joined in blocks of consecutive ids.
_BLOCK_BITS = 16
_LAYOUTS = (4, 16, 48, 256)


class Branch:
    """A node of the radix tree: a compressed path, then children by their next byte.

    Up to 16 children lie in order beside their sorted bytes; up to 48 are found through an index of
    256 bytes; beyond that each byte has its slot. ``first`` and ``last`` are the rows of the smallest
    and largest key below, ``row`` that of the key that ends here.
    """

    __slots__ = ("path", "layout", "index", "slots", "row", "first", "last")

    def __init__(self, path: bytes, row: int | None = None):
        self.path, self.row = path, row
        self.layout, self.index, self.slots = 4, bytearray(), []
        self.first = self.last = row

    def get(self, byte: int) -> Branch | None:
        if self.layout <= 16:
            at = self.index.find(byte)
            return self.slots[at] if at >= 0 else None
        if self.layout == 48:
            at = self.index[byte]
            return self.slots[at - 1] if at else None
        return self.slots[byte]

    def put(self, byte: int, child: Branch) -> None:
        """Set the child of a byte, in a larger layout if this one is full."""
        if self.layout <= 16:
            at = self.index.find(byte)
            if at >= 0:
                self.slots[at] = child
                return
            if len(self.slots) == self.layout:
                self._grow()
                return self.put(byte, child)
            at = sum(b < byte for b in self.index)
            self.index.insert(at, byte)
            self.slots.insert(at, child)
        elif self.layout == 48:
            if self.index[byte]:
                self.slots[self.index[byte] - 1] = child
            elif len(self.slots) == 48:
                self._grow()
                self.slots[byte] = child
            else:
                self.slots.append(child)
                self.index[byte] = len(self.slots)
        else:
            self.slots[byte] = child

    def _grow(self) -> None:
        held, self.layout = list(self.items()), _LAYOUTS[_LAYOUTS.index(self.layout) + 1]
        if self.layout == 48:
            self.index, self.slots = bytearray(256), [c for _, c in held]
            for at, (byte, _) in enumerate(held):
                self.index[byte] = at + 1
        elif self.layout == 256:
            self.index, self.slots = None, [None] * 256
            for byte, child in held:
                self.slots[byte] = child

    def items(self) -> Iterator[tuple[int, Branch]]:
        """Children in order of their bytes."""
        if self.layout <= 16:
            yield from zip(self.index, self.slots)
        elif self.layout == 48:
            yield from ((b, self.slots[at - 1]) for b, at in enumerate(self.index) if at)
        else:
            yield from ((b, c) for b, c in enumerate(self.slots) if c is not None)


def shared_length(a: bytes, b: bytes) -> int:
    """Bytes that both start with."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    low, high = 0, most  # a[:low] agrees, a[:high] does not
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def insert(root: Branch, key: bytes, row: int) -> None:
    """Add a new key, with the number of its row."""
    node, at = root, 0
    while True:
        node.first = row if node.first is None else min(node.first, row)
        node.last = row if node.last is None else max(node.last, row)
        path = node.path
        if key[at : at + len(path)] != path:
            same = shared_length(path, key[at:])
            below = Branch(path[same + 1 :], node.row)
            below.layout, below.index, below.slots = node.layout, node.index, node.slots
            # The rows below are those from before this key came.
            below.first, below.last = _ends(below)
            node.path, node.row = path[:same], None
            node.layout, node.index, node.slots = 4, bytearray(), []
            node.put(path[same], below)
            path = node.path
        at += len(path)
        if at == len(key):
            node.row = row
            return
        child = node.get(key[at])
        if child is None:
            node.put(key[at], Branch(key[at + 1 :], row))
            return
        node, at = child, at + 1


def _ends(node: Branch) -> tuple[int, int]:
    rows = [r for r in (node.row,) if r is not None]
    for _, child in node.items():
        rows += [child.first, child.last]
    return min(rows), max(rows)


def radix_tree(keys: list[bytes]) -> Branch:
    """The tree of distinct keys; rows are their places in the list."""
    root = Branch(b"")
    for row, key in enumerate(keys):
        insert(root, key, row)
    return root


_PIECE = pa.schema(
    [
        # A whole node; its parent is one of the same run, or named by the digest of its prefix.
        ("conv_id", pa.int64()),
        ("depth", pa.int64()),
        ("parent_conv_id", pa.int64()),
        ("parent_ref", pa.binary()),
        ("n_convs", pa.int64()),
        ("n_children", pa.int64()),
        ("n_leaves", pa.int64()),
        ("saved_tokens", pa.int64()),
        ("ends", pa.binary()),
        # A path along the edge of a run: what the run adds to each node from depth ``since`` on.
        ("key", pa.binary()),
        ("since", pa.int64()),
        ("low", pa.list_(pa.int64())),
        ("convs", pa.list_(pa.int64())),
        ("children", pa.list_(pa.int64())),
        ("leaves", pa.list_(pa.int64())),
        ("saved", pa.list_(pa.int64())),
        ("words", pa.list_(pa.int64())),
        ("ended", pa.list_(pa.binary())),
    ]
)
_DDL = (
    "conv_id long, depth long, parent_conv_id long, parent_ref binary, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends binary, key binary, since long, low array<long>, convs array<long>, "
    "children array<long>, leaves array<long>, saved array<long>, words array<long>, ended array<binary>"
)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    columns = [pa.array([r.get(f.name) for r in rows], type=f.type) for f in _PIECE]
    return pa.RecordBatch.from_arrays(columns, schema=_PIECE)


def reference(prefix: bytes) -> bytes:
    """The name of a node that several runs may hold: the digest of its prefix."""
    return hashlib.blake2b(prefix, digest_size=16).digest()


def run_nodes(run: list[dict]) -> Iterator[dict]:
    """The nodes of one run of sorted distinct keys, then the paths along its two edges."""
    keys, last = [r["key"] for r in run], len(run) - 1
    order, parents, ends = [radix_tree(keys)], [-1], []
    for at, node in enumerate(order):  # grows: parents come before their children
        begin = 0 if parents[at] < 0 else ends[parents[at]] + 1
        ends.append(begin + len(node.path))
        for _, child in node.items():
            order.append(child)
            parents.append(at)
    size = len(order)
    convs, low, leaves, saved, tops = [0] * size, [None] * size, [0] * size, [0] * size, [0] * size
    below = [0] * size
    shape = []  # first and last turn depth that ends on the path of a node, and whether it is open
    for at, node in enumerate(order):
        begin = -1 if parents[at] < 0 else ends[parents[at]]
        # Depths of turns that end after the parent's last byte, up to this node's last byte.
        shape.append((begin // TURN + 1, ends[at] // TURN, node.first == 0 or node.last == last))
    for at in range(size - 1, -1, -1):
        node, (top, bottom, open_) = order[at], shape[at]
        if node.row is not None:
            row = run[node.row]
            convs[at] += row["n"]
            low[at] = row["low"] if low[at] is None else min(low[at], row["low"])
        if top <= bottom:
            below[at], tops[at] = tops[at], int(not open_)
            if not open_:
                leaves[at] = leaves[at] or 1
                words = run[node.first]["words"][max(top, 1) - 1 : bottom]
                saved[at] += (convs[at] - 1) * sum(words)
        if (up := parents[at]) >= 0:
            convs[up] += convs[at]
            low[up] = low[at] if low[up] is None else min(low[up], low[at])
            leaves[up] += leaves[at]
            saved[up] += saved[at]
            tops[up] += tops[at]
    anchors, paths = [None] * size, ({}, {})
    for at, node in enumerate(order):
        (top, bottom, open_), sample = shape[at], run[node.first]
        anchor = anchors[parents[at]] if parents[at] >= 0 else None
        ended = run[node.row]["ends"] if node.row is not None else None
        if top <= bottom and open_:
            for depth in range(top, bottom + 1):
                # Nodes on both edges go with the first one.
                paths[node.first != 0][depth] = {
                    "low": low[at],
                    "convs": convs[at],
                    "children": below[at] if depth == bottom else 0,
                    "leaves": leaves[at],
                    "saved": saved[at],
                    "words": sample["words"][depth - 1] if depth else 0,
                    "ended": ended if depth == bottom else None,
                }
            anchor = (None, reference(sample["key"][: bottom * TURN]))
        elif top <= bottom:
            total = saved[at]
            for depth in range(top, bottom + 1):
                yield {
                    "conv_id": low[at],
                    "depth": depth,
                    "parent_conv_id": anchor[0],
                    "parent_ref": anchor[1],
                    "n_convs": convs[at],
                    "n_children": below[at] if depth == bottom else 1,
                    "n_leaves": leaves[at],
                    "saved_tokens": total,
                    "ends": ended if depth == bottom else None,
                }
                total -= (convs[at] - 1) * sample["words"][depth - 1]
                anchor = (low[at], None)
        anchors[at] = anchor
    for key, path in zip((keys[0], keys[-1]), paths):
        if path:
            depths = sorted(path)
            fields = ("low", "convs", "children", "leaves", "saved", "words", "ended")
            yield {"key": key, "since": depths[0]} | {f: [path[d][f] for d in depths] for f in fields}


def _emit(rows: Iterator[dict], most: int = 20_000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _runs(limit: int):
    """Build the tree of each run of sorted keys; holds one run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                held.append(row)
                size += len(row["key"]) + TURN
                if size >= limit:
                    yield from _emit(run_nodes(held))
                    held, size = [], 0
        if held:
            yield from _emit(run_nodes(held))

    return run


def fold_paths(paths: Iterator[dict]) -> Iterator[dict]:
    """The nodes on the edges of runs, whole, from their paths in order of keys; holds one path."""
    stack, key = [], b""

    def close() -> dict:
        node = stack.pop()
        n_children = node["children"] + node["open_children"]
        n_leaves = node["open_leaves"] + (n_children == 0)
        own = node["open_saved"] + (node["convs"] - 1) * node["words"]
        depth = len(stack)
        if stack:
            up = stack[-1]
            up["open_children"] += 1
            up["open_leaves"] += n_leaves
            up["open_saved"] += own
        return {
            "ref": reference(key[: depth * TURN]),
            "parent_ref": reference(key[: (depth - 1) * TURN]) if depth else None,
            "conv_id": node["low"],
            "depth": depth,
            "n_convs": node["convs"],
            "n_children": n_children,
            "n_leaves": node["leaves"] + n_leaves,
            "saved_tokens": node["saved"] + own,
            "ends": node["ended"],
        }

    for path in paths:
        same = shared_length(key, path["key"]) // TURN
        while len(stack) > same + 1:
            yield close()
        key = path["key"]
        for at, depth in enumerate(range(path["since"], path["since"] + len(path["low"]))):
            part = {f: path[f][at] for f in ("low", "convs", "children", "leaves", "saved", "words", "ended")}
            if depth < len(stack):
                node = stack[depth]
                node["low"] = min(node["low"], part["low"])
                for f in ("convs", "children", "leaves", "saved"):
                    node[f] += part[f]
                node["ended"] = node["ended"] or part["ended"]
            else:
                stack.append(part | {"open_children": 0, "open_leaves": 0, "open_saved": 0})
    while stack:
        yield close()


_FOLDED = pa.schema(
    [("ref", pa.binary()), ("parent_ref", pa.binary()), ("ends", pa.binary())]
    + [(c, pa.int64()) for c in ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens")]
)
_FOLDED_DDL = (
    "ref binary, parent_ref binary, ends binary, conv_id long, depth long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long"
)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for node in fold_paths(path for batch in batches for path in batch.to_pylist()):
        rows.append(node)
        if len(rows) == 20_000:
            yield pa.RecordBatch.from_pylist(rows, schema=_FOLDED)
            rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_FOLDED)


def turn_arrays(rows: DataFrame) -> DataFrame:
    """``conv_id, turns``: the turns of each conversation as ids (hex) and word counts, in order.

    Turns go in order of ``turn``, null first, equal ones in order of their ids. A null role or text
    is empty, rows without a conversation take no part, repeated rows are turns each, other columns
    are ignored. Texts stay where they are read. One conversation is one row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    role = F.coalesce(F.col("role"), F.lit(""))
    # The length of the role says where it ends.
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.substring(digest, 1, 2 * TURN).alias("id"),
        word_count(text).alias("words"),
    )
    rows = rows.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def graft(conversations: DataFrame, every: int = 20, choices: int = 4) -> DataFrame:
    """Conversations that begin with turns of the first of their block of ``every`` ids.

    Conversation c takes the first h turns of c - c % every (fewer if it has fewer, none if it is
    absent) and its own turns after the first h, where h is the crc32 of c in decimal modulo
    ``choices``.
    """
    heads = conversations.select(
        F.col("conv_id").alias("_head"), F.slice("turns", 1, choices - 1).alias("_turns")
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % choices).cast("int")
    rebuilt = conversations.withColumn("_head", F.col("conv_id") - F.col("conv_id") % every).join(heads, "_head", "left")
    head = F.coalesce(F.slice("_turns", F.lit(1), h), F.slice("turns", 1, 0))
    own = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    return rebuilt.select("conv_id", F.concat(head, own).alias("turns"))


def _end_digests(ended: DataFrame) -> DataFrame:
    """``ends, ends_sha256``: the digest of the ids that end at a node, in order, joined by commas.

    Ids are joined in blocks first; a digest reads its text from the front to the end, so the blocks
    of a node stream through one task, which holds one of them.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("ends", pa.binary()), ("ends_sha256", pa.string())])
        node, state = None, None
        for batch in batches:
            done = []
            for ends, ids in zip(batch.column("ends").to_pylist(), batch.column("ids").to_pylist()):
                if ends != node:
                    if node is not None:
                        done.append((node, state.hexdigest()))
                    node, state = ends, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], schema=schema)
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], schema=schema)

    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string"))
    blocks = ended.groupBy("ends", F.shiftright("conv_id", _BLOCK_BITS).alias("block")).agg(F.array_join(ids, ",").alias("ids"))
    ordered = blocks.repartition("ends").sortWithinPartitions("ends", "block").select("ends", "ids")
    return ordered.mapInArrow(digest, "ends binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, run_bytes: int = RUN) -> DataFrame:
    """The prefix trie of ``conv_id, turns`` (see ``turn_arrays``; ids are distinct).

    One row per distinct sequence of first turns, the empty one too: ``conv_id`` (its smallest
    member), ``depth``, ``parent_conv_id`` (null at the root), ``n_convs``, ``n_children``,
    ``n_leaves`` (nodes without children in its subtree), ``saved_tokens`` (words that need no second
    reading: over its subtree, members but one times the words of the last turn) and ``ends_sha256``
    of the ids that end there. A conversation without turns ends at the root. Without conversations
    there is no row.
    """
    keyed = conversations.select(
        "conv_id",
        F.unhex(F.array_join("turns.id", "")).alias("key"),
        F.col("turns.words").alias("words"),
    ).withColumn("ends", F.unhex(F.sha2("key", 256)))
    keyed = materialise(keyed, "trie-keys")
    distinct = keyed.groupBy("key", "words", "ends").agg(F.min("conv_id").alias("low"), F.count(F.lit(1)).alias("n"))
    ordered = distinct.repartitionByRange("key").sortWithinPartitions("key")
    pieces = materialise(ordered.mapInArrow(_runs(run_bytes), _DDL), "trie-pieces")
    # Two paths per run of keys, each folded as it comes.
    paths = pieces.where("key IS NOT NULL").select(
        "key", "since", "low", "convs", "children", "leaves", "saved", "words", "ended"
    )
    edges = paths.repartition(1).sortWithinPartitions("key", "since").mapInArrow(_fold, _FOLDED_DDL)
    edges = materialise(edges, "trie-edges")
    columns = ["conv_id", "depth", "parent_ref", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    inner = pieces.where("conv_id IS NOT NULL").select("parent_conv_id", *columns)
    outer = edges.select(F.lit(None).cast("long").alias("parent_conv_id"), *columns)
    named = edges.select(F.col("ref").alias("parent_ref"), F.col("conv_id").alias("_up"))
    nodes = _with(inner.unionByName(outer), named, "parent_ref", "_up")
    nodes = _with(nodes, _end_digests(keyed.select("ends", "conv_id")), "ends", "ends_sha256")
    return nodes.select(
        "conv_id",
        "depth",
        F.coalesce("parent_conv_id", "_up").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def _with(rows: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """Rows with the value of their key; the many without one stay out of the join."""
    without = rows.where(F.col(key).isNull()).withColumn(value, F.lit(None).cast(table.schema[value].dataType))
    return rows.where(F.col(key).isNotNull()).join(table, key, "left").unionByName(without)
