"""Exact join of near copies by the Jaccard similarity of word n-grams, and its components.

The space is that of n-gram sets with the Jaccard distance. Prefix filtering replaces Voronoi regions
of document pivots, which hold nearly all documents each, since most pairs of texts are at or near
distance 1 (figures in the README). N-grams have one global order, those of many documents last, and a
document lists the first of its set: as many as a partner within the distance may lack, and a few more,
since a linked pair then meets in that many lists. The documents that list an n-gram, here called a
pivot, are its region. Small regions list the pairs that can still be linked; large ones compare the
sketches of their documents, block by block, and return a spanning forest of the pairs that no sketch
rules out. What these candidates connect, over all regions, is a cluster, and every link lies within one.

Only documents in clusters become whole sets, and a set goes to its cluster once, in however many
regions its document is. A large cluster is dealt in blocks, each with the same few central documents. A
task measures all documents of its block and the centres against each other and returns a spanning
forest of their links, never the links. Documents that this connects with the first centre are connected
with each other; only the others, the outsiders of their block, meet all blocks of the cluster.

Sets are sets of 64-bit hashes; documents of equal 128-bit set digests share one representative.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfloom.llm.components import clusters, components, unite
from shelfloom.llm.words import (
    LOWER,
    mix,
    run_hashes,
    slices,
    text_bytes,
    word_hashes,
    word_spans,
)
from shelfloom.session import materialise

# Regions in which a linked pair meets, if its documents are large enough.
MEETINGS = 3
# Documents in a region whose pairs are listed at once; sketches in a block of a larger one.
REGION, SKETCHES = 16, 1024
# Centres of a large cluster, documents they are chosen from, and documents and n-grams in a block of it.
CENTRES, TRIED, BLOCK, BLOCK_GRAMS = 4, 64, 512, 1 << 20
# Documents of a pivot from which its rows are dealt over several tasks.
SALTED = 1 << 14
_COLUMNS = 4096
# N-grams in at least this share of documents come last in the order; the list has a fixed bound.
COMMON_SHARE, COMMON_MOST = 0.0005, 1 << 18
_CHUNK = 1 << 22
# Classes of the smallest and largest sketch, and n-grams a class of those between, all as bits.
_FEWEST, _MOST, _FILL = 7, 14, 3

# Linked: 100 * common >= percent * union. All bounds below follow from it in whole numbers.
PERCENT = 85


def least_common(total, percent: int = PERCENT):
    """N-grams that two linked documents with ``total`` n-grams together must share."""
    both = 100 + percent
    return (percent * total + both - 1) // both


def spare_as_larger(n, percent: int = PERCENT):
    """N-grams of a document of size ``n`` that a linked one, not larger, can lack."""
    smallest = (percent * n + 99) // 100
    return n - least_common(n + smallest, percent)


def spare_as_smaller(n, percent: int = PERCENT):
    """The same for a linked document that is not smaller."""
    return n - least_common(2 * n, percent)


def sets_of(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted set of hashed ``width``-word n-grams of each text, A-Z lower-cased.

    A text with fewer words has one n-gram, all of it; one without words has none.
    """
    data, offsets = text_bytes(texts)
    data = LOWER[data]
    starts, ends, before = word_spans(data, offsets)
    hashes = word_hashes(data, starts, ends)
    grams = run_hashes(hashes, width)
    for a, b in zip(before[:-1], before[1:]):
        if b - a >= width:
            yield np.unique(grams[a : b - width + 1])
        elif b > a:
            yield run_hashes(hashes[a:b], int(b - a))
        else:
            yield np.zeros(0, dtype=np.uint64)


def _digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _short(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    arrays = [
        pa.array(columns[f.name], type=f.type) if f.name in columns else pa.nulls(size, f.type)
        for f in schema
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


_PROFILE = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n", pa.int32()),
        ("digest", pa.binary()),
        ("key", pa.int64()),
        ("sketch", pa.binary()),
        ("gram", pa.int64()),
        ("docs", pa.int64()),
    ]
)


def _profile(width: int):
    """Size, digest and sketch of every set, and the n-grams that are common in a chunk of documents.

    An n-gram with a share of all documents has at least that share in one of the chunks.
    """

    def common(chunk: list[np.ndarray]) -> pa.RecordBatch | None:
        grams, counts = np.unique(np.concatenate(chunk), return_counts=True)
        often = counts >= max(3, COMMON_SHARE * len(chunk))
        if not often.any():
            return None
        return _rows(_PROFILE, gram=grams[often].view(np.int64), docs=counts[often])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                found = list(sets_of(part.column("text"), width))
                digests = [_digest(g) for g in found]
                yield _rows(
                    _PROFILE,
                    doc_id=part.column("doc_id").to_pylist(),
                    n=[len(g) for g in found],
                    digest=digests,
                    key=[_short(d) for d in digests],
                    sketch=[_sketch(g).tobytes() if len(g) else None for g in found],
                )
                chunk += [g for g in found if len(g)]
                held += sum(map(len, found))
                if held >= _CHUNK:
                    if (rows := common(chunk)) is not None:
                        yield rows
                    chunk, held = [], 0
        if chunk and (rows := common(chunk)) is not None:
            yield rows

    return run


_WINDOW = pa.schema(
    [("pivot", pa.int64()), ("salt", pa.int32()), ("key", pa.int64()), ("n", pa.int32()), ("rank", pa.int32())]
)


def _windows(width: int, percent: int, shared, salted: int):
    """The pivots within each document's window, with its size and the pivot's rank in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, place, docs = shared.value
        # A pivot of very many documents is dealt by them as well.
        salts = docs // salted + 1
        seen = set()  # of the documents of this task
        for batch in batches:
            for part in slices(batch, "text"):
                pivots, keys, sizes, dealt = [], [], [], []
                for grams in sets_of(part.column("text"), width):
                    digest = _digest(grams)
                    if not len(grams) or digest in seen:
                        continue
                    seen.add(digest)
                    n, key = len(grams), _short(digest)
                    at = np.searchsorted(common, grams)
                    last = common[np.minimum(at, len(common) - 1)] == grams if len(common) else np.zeros(n, bool)
                    later = grams[last][np.argsort(place[at[last]])] if last.any() else grams[:0]
                    window = np.concatenate([grams[~last], later])[: spare_as_larger(n, percent) + MEETINGS]
                    pivots.append(window)
                    salt = np.zeros(len(window), dtype=np.int32)
                    if len(later) and salts.max() > 1:
                        at = np.minimum(np.searchsorted(common, window), len(common) - 1)
                        many = np.where(common[at] == window, salts[at], 1)
                        salt = np.where(many > 1, 1 + (key & 0xFFFFFFFF) % many, 0).astype(np.int32)
                    dealt.append(salt)
                    keys.append(key)
                    sizes.append(n)
                if pivots:
                    counts = [len(w) for w in pivots]
                    yield _rows(
                        _WINDOW,
                        pivot=np.concatenate(pivots).view(np.int64),
                        salt=np.concatenate(dealt),
                        key=np.repeat(np.array(keys, dtype=np.int64), counts),
                        n=np.repeat(np.array(sizes, dtype=np.int32), counts),
                        rank=np.concatenate([np.arange(c, dtype=np.int32) for c in counts]),
                    )

    return run


_MEETING = pa.schema(
    [
        ("a", pa.int64()),
        ("b", pa.int64()),
        ("total", pa.int32()),
        ("pivot", pa.int64()),
        ("key", pa.int64()),
        ("rank", pa.int32()),
    ]
)


def _list_pairs(percent: int, region: int, pivot, key, n, rank) -> Iterator[pa.RecordBatch]:
    """Rows of whole regions in order of pivot, size and key: pairs, or the rows of large regions."""
    fresh = np.ones(len(pivot), dtype=bool)
    fresh[1:] = (pivot[1:] != pivot[:-1]) | (key[1:] != key[:-1])
    pivot, key, n, rank = (x[fresh] for x in (pivot, key, n, rank))
    if not len(pivot):
        return
    starts = np.flatnonzero(np.append(True, pivot[1:] != pivot[:-1]))
    sizes = np.diff(np.append(starts, len(pivot)))
    per_row = np.repeat(sizes, sizes)
    large = per_row > region
    if large.any():
        yield _rows(_MEETING, pivot=pivot[large], key=key[large], rank=rank[large])
    small = (per_row > 1) & ~large
    pivot, key, n, rank = (x[small] for x in (pivot, key, n, rank))
    n, rank = n.astype(np.int64), rank.astype(np.int64)
    for step in range(1, region):
        first = np.flatnonzero(pivot[:-step] == pivot[step:]) if step < len(pivot) else []
        if not len(first):
            break
        second = first + step  # the larger one
        total = n[first] + n[second]
        after = np.minimum(n[first] - rank[first], n[second] - rank[second]) - 1
        can = (
            (percent * n[second] <= 100 * n[first])
            & (rank[first] < spare_as_smaller(n[first], percent) + MEETINGS)
            & (MEETINGS + after >= least_common(total, percent))
        )
        one, two = key[first[can]], key[second[can]]
        if len(one):
            yield _rows(_MEETING, a=np.minimum(one, two), b=np.maximum(one, two), total=total[can])


def _regions(percent: int, region: int):
    """Join each region; holds one batch and at most one small region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("pivot", "key", "n", "rank")
        held = [np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int32, np.int32)]
        large = None  # the pivot of a region that has already outgrown its bound
        for batch in batches:
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            salted = batch.column("salt").to_numpy() > 0
            if salted.any():  # a part of a region: joined with the other parts later
                yield _rows(_MEETING, **{c: x[salted] for c, x in zip(names, rows)})
                rows = [x[~salted] for x in rows]
            if large is not None:
                more = rows[0] == large
                if more.any():
                    yield _rows(_MEETING, **{c: x[more] for c, x in zip(names, rows)})
                    rows = [x[~more] for x in rows]
            rows = [np.concatenate([h, x]) for h, x in zip(held, rows)]
            if not len(rows[0]):
                held = rows
                continue
            cut = int(np.searchsorted(rows[0], rows[0][-1], side="left"))
            yield from _list_pairs(percent, region, *(x[:cut] for x in rows))
            held = [x[cut:] for x in rows]
            if len(np.unique(held[1])) > region:
                large = held[0][0]
                yield _rows(_MEETING, **dict(zip(names, held)))
                held = [x[:0] for x in held]
        yield from _list_pairs(percent, region, *held)

    return run


def _sets(width: int):
    """Set of each document whose text gives the digest that it was chosen for, once."""
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("grams", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for part in slices(batch, "text"):
                nodes, digests = part.column("node").to_pylist(), part.column("digest").to_pylist()
                rows = []
                for node, digest, grams in zip(nodes, digests, sets_of(part.column("text"), width)):
                    if _digest(grams) == digest and (node, digest) not in seen:
                        seen.add((node, digest))
                        rows.append((_short(digest), node, grams.tobytes()))
                if rows:
                    yield _rows(schema, **dict(zip(schema.names, zip(*rows))))

    return run


def _sketch(grams: np.ndarray) -> np.ndarray:
    """N-grams per class of hashes, up to 15, two classes a byte. Sketches differ by no more than the sets do.

    Larger sets have more classes, so that unlike ones stay apart.
    """
    bits = min(_MOST, max(_FEWEST, (len(grams) - 1).bit_length() - _FILL))
    classes = (mix(grams) >> np.uint64(64 - bits)).astype(np.int64)
    counts = np.minimum(np.bincount(classes, minlength=1 << bits), 15).astype(np.uint8)
    return counts[::2] | counts[1::2] << 4


def _folded(sketches: pa.Array, sizes: np.ndarray, size: int) -> np.ndarray:
    """Sketches as rows of ``2 * size`` classes; ``sizes`` and ``size`` are in bytes.

    Neighbouring classes of larger ones are added up, again to 15, as a smaller sketch would count them.
    """
    rows = np.zeros((len(sketches), 2 * size), dtype=np.int8)
    for own in np.unique(sizes):
        at = np.flatnonzero(sizes == own)
        packed = np.frombuffer(b"".join(sketches.take(pa.array(at)).to_pylist()), dtype=np.uint8)
        whole = np.stack([packed & 15, packed >> 4], axis=-1)
        rows[at] = np.minimum(whole.reshape(len(at), 2 * size, own // size).sum(axis=2, dtype=np.int32), 15)
    return rows


def _apart(left: pa.Array, right: pa.Array) -> pa.Array:
    """By how much sketches differ."""
    sizes = [pc.binary_length(x).to_numpy(zero_copy_only=False) for x in (left, right)]
    smaller = np.minimum(*sizes)
    apart = np.zeros(len(left), dtype=np.int64)
    for size in np.unique(smaller):
        at = np.flatnonzero(smaller == size)
        for rows in np.array_split(at, len(at) * size // _CHUNK + 1):
            a, b = (_folded(x.take(pa.array(rows)), s[rows], int(size)) for x, s in zip((left, right), sizes))
            apart[rows] = np.abs(a - b).sum(axis=1)
    return pa.array(apart)


def _most_apart(total, percent: int):
    """By how much the sets of two linked documents with ``total`` n-grams together can differ."""
    return total - 2 * least_common(total, percent)


def _promising(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches do not rule out a link.

    Both sides grow with the corpus, so they meet by a sort-merge join at every size.
    """
    for key in ("a", "b"):
        side = sketches.select(F.col("key").alias(key), F.col("n").alias(f"n_{key}"), F.col("sketch").alias(f"x_{key}"))
        pairs = pairs.join(side.hint("merge"), key)
    total = F.col("n_a") + F.col("n_b")
    most = total - 2 * F.ceil(F.lit(percent) * total / (100 + percent))
    apart = F.arrow_udf(_apart, "long")
    return pairs.where(apart("x_a", "x_b") <= most).select("a", "b").distinct()


def _sketch_forest(percent: int):
    """Pairs of a block that no sketch rules out, as a forest of keys."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("n", "ascending"), ("key", "ascending")]).combine_chunks()
        key, n = (group.column(c).to_numpy().astype(np.int64) for c in ("key", "n"))
        sketches = group.column("sketch").combine_chunks()
        sizes = pc.binary_length(sketches).to_numpy(zero_copy_only=False)
        ends = np.searchsorted(percent * n, 100 * n, side="right")
        parent = np.arange(len(key))
        for size in np.unique(sizes):
            # Those of this size meet the larger ones, folded alike.
            first = int(np.searchsorted(sizes, size))
            last = int(np.searchsorted(sizes, size, side="right"))
            upto = int(ends[last - 1])
            rows = _folded(sketches.slice(first, upto - first), sizes[first:upto], int(size))
            for i in range(first, last):
                other = i + 1 + np.flatnonzero(parent[i + 1 : ends[i]] != parent[i])
                if len(other):
                    apart = np.abs(rows[other - first] - rows[i - first]).sum(axis=1)
                    near = other[apart <= _most_apart(n[other] + n[i], percent)]
                    parent = unite(parent, np.full(len(near), i), near)
        tied = np.flatnonzero(parent != np.arange(len(key)))
        return pa.table({"a": key[tied], "b": key[parent[tied]]})

    return run


def _hot_candidates(hot: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """``a, b``: keys that connect what the pairs connect that meet in large regions and have like sketches.

    ``hot`` has ``pivot, key``. A region of more than a block is parted into bands of sizes, each with
    the band below, as linked sizes lie in the same band or in neighbouring ones; all blocks of a band meet.
    """
    width = max(math.log(100 / percent), 1e-3) * (1 + 1e-9)
    many = hot.groupBy("pivot").agg(F.count(F.lit(1)).alias("docs")).where("docs > 1")
    placed = hot.select("pivot", "key").join(many, "pivot")
    groups = ["pivot", "band", "one", "two"]
    small = placed.where(F.col("docs") <= SKETCHES)
    small = small.withColumns({"band": F.lit(-1), "one": F.lit(0), "two": F.lit(0)}).select(*groups, "key")
    band = F.floor(F.log("n") / F.lit(width)).cast("int")
    large = placed.where(F.col("docs") > SKETCHES).join(sketches.select("key", "n").distinct().hint("merge"), "key")
    large = large.select("pivot", "key", F.explode(F.array(band, band + 1)).alias("band"))
    blocks = large.groupBy("pivot", "band").agg(F.ceil(F.count(F.lit(1)) / SKETCHES).cast("int").alias("blocks"))
    large = large.join(blocks, ["pivot", "band"]).withColumns(
        {
            "own": F.pmod(F.xxhash64("key", "pivot"), "blocks").cast("int"),
            "other": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)),
        }
    )
    large = large.withColumns({"one": F.least("own", "other"), "two": F.greatest("own", "other")}).select(*groups, "key")
    # Sketches come last, so that they are shuffled to their groups alone.
    rows = small.unionByName(large).join(sketches.hint("merge"), "key").select(*groups, "key", "n", "sketch")
    return rows.groupBy(*groups).applyInArrow(_sketch_forest(percent), "a long, b long").distinct()


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right.

    Sets become rows of zeros and ones, some thousand n-grams at a time, whose products count.
    """
    sides = [np.concatenate(x) if x else np.zeros(0, dtype=np.uint64) for x in (left, right)]
    owners = [np.repeat(np.arange(len(x)), [len(g) for g in x]) for x in (left, right)]
    both = np.intersect1d(*[np.unique(x) for x in sides], assume_unique=True)
    counts = np.zeros((len(left), len(right)), dtype=np.float32)
    places = []
    for grams, owner in zip(sides, owners):
        at = np.searchsorted(both, grams)
        known = np.flatnonzero(both[np.minimum(at, len(both) - 1)] == grams) if len(both) else []
        order = np.argsort(at[known], kind="stable")
        places.append((at[known][order], owner[known][order]))
    for begin in range(0, len(both), _COLUMNS):
        tiles = []
        for (at, owner), count in zip(places, counts.shape):
            a, b = np.searchsorted(at, [begin, begin + _COLUMNS])
            tile = np.zeros((count, min(_COLUMNS, len(both) - begin)), dtype=np.float32)
            tile[owner[a:b], at[a:b] - begin] = 1
            tiles.append(tile)
        counts += tiles[0] @ tiles[1].T
    return counts.astype(np.int64)


def _linked(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the sets on the left and right that are linked."""
    common = overlaps(left, right)
    total = np.array([len(g) for g in left])[:, None] + np.array([len(g) for g in right])[None, :]
    return np.nonzero(100 * common >= percent * (total - common))


def _read_sets(group: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    grams = [np.frombuffer(g, dtype=np.uint64) for g in group.column("grams").to_pylist()]
    return group.column("node").to_numpy(), grams


_FOUND_DDL = "u long, v long, pivot long, block int, node long"


def _forest(node: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest place each place is linked with, and the places that differ from it."""
    parent = unite(np.arange(len(node)), a, b)
    return parent, np.flatnonzero(parent != np.arange(len(node)))


def _found(group: pa.Table, node: np.ndarray, parent: np.ndarray, tied: np.ndarray, out: np.ndarray) -> pa.Table:
    """Edges of the forest, then the outsiders of the block."""
    edges, count = len(tied), len(out)
    none = pa.nulls(edges, pa.int64())
    return pa.table(
        {
            "u": pa.concat_arrays([pa.array(node[tied], pa.int64()), pa.nulls(count, pa.int64())]),
            "v": pa.concat_arrays([pa.array(node[parent[tied]], pa.int64()), pa.nulls(count, pa.int64())]),
            "pivot": pa.concat_arrays([none, pa.array([group.column("pivot")[0].as_py()] * count, pa.int64())]),
            "block": pa.concat_arrays(
                [pa.nulls(edges, pa.int32()), pa.array([group.column("block")[0].as_py()] * count, pa.int32())]
            ),
            "node": pa.concat_arrays([none, pa.array(node[out], pa.int64())]),
        }
    )


def _block_forest(percent: int):
    """Links within a block and its centres, as a forest; outsiders: those the first centre does not reach."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("centre", "ascending"), ("node", "ascending")])
        node, grams = _read_sets(group)
        parent, tied = _forest(node, *_linked(grams, grams, percent))
        own = group.column("centre").to_numpy() == CENTRES
        inner = node[parent == parent[0]]
        out = np.flatnonzero(own & ~np.isin(node, inner))
        return _found(group, node, parent, tied, out)

    return run


def _outside_forest(percent: int):
    """Links between the outsiders of other blocks and a block, as a forest."""

    def run(group: pa.Table) -> pa.Table:
        node, grams = _read_sets(group)
        outside = group.column("outside").to_numpy(zero_copy_only=False).astype(bool)
        x, y = np.flatnonzero(outside), np.flatnonzero(~outside)
        a, b = _linked([grams[i] for i in x], [grams[i] for i in y], percent)
        parent, tied = _forest(node, x[a], y[b])
        return _found(group, node, parent, tied, np.zeros(0, dtype=int))

    return run


def _central(group: pa.Table) -> pa.Table:
    """Of some documents of a cluster those that differ least from the others, by their sketches."""
    group = group.sort_by("key")
    sketches = group.column("sketch").combine_chunks()
    sizes = pc.binary_length(sketches).to_numpy(zero_copy_only=False)
    rows = _folded(sketches, sizes, int(sizes.min()))
    apart = np.array([np.abs(rows - one).sum() for one in rows])
    best = np.argsort(apart, kind="stable")[:CENTRES]
    return pa.table(
        {
            "pivot": group.column("pivot").take(pa.array(best)),
            "centre": pa.array(np.arange(len(best)), pa.int32()),
            "key": group.column("key").take(pa.array(best)),
        }
    )


def _cluster_links(rows: DataFrame, sets: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """``u, v``: links that connect what the links within clusters connect.

    ``rows`` has ``pivot, key, n, rank``, the pivot being the name of the cluster and the rank that of the
    first pivot of a large region. Centres are chosen among the documents of low rank, which hold few
    n-grams of their own. All groups are bounded in documents and n-grams.
    """
    regions = rows.groupBy("pivot").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_GRAMS)).cast("int").alias("blocks")
    )
    placed = rows.select("pivot", "key", "rank").join(regions, "pivot")
    tried = F.struct(F.coalesce("rank", F.lit((1 << 31) - 1)).alias("rank"), "key")
    tried = placed.where("blocks > 1").groupBy("pivot", F.pmod(F.xxhash64("key"), F.lit(TRIED))).agg(F.min(tried)["key"].alias("key"))
    tried = tried.select("pivot", "key").join(sketches.select("key", "sketch").hint("merge"), "key")
    centres = tried.groupBy("pivot").applyInArrow(_central, "pivot long, centre int, key long")
    placed = placed.drop("rank").withColumn("block", F.pmod(F.xxhash64("key", "pivot"), "blocks").cast("int"))
    central = centres.join(regions, "pivot").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = placed.withColumn("centre", F.lit(CENTRES)).unionByName(central)
    found = sets.select("key", "node", "grams").hint("merge")
    met = met.join(found, "key").select("pivot", "block", "centre", "node", "grams")
    forests = met.groupBy("pivot", "block").applyInArrow(_block_forest(percent), _FOUND_DDL)
    first = materialise(forests, "block-forests", free=True)
    out = first.where("node IS NOT NULL").select("pivot", F.col("block").alias("home"), "node")
    strays = materialise(
        out.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")).join(regions, "pivot"),
        "outsider-counts",
        free=True,
    )
    strays = strays.where("blocks > 1")
    outside = out.join(strays, "pivot").withColumns(
        {
            "part": F.pmod(F.xxhash64("node", "pivot"), "parts").cast("int"),
            "block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)),
            "outside": F.lit(True),
        }
    )
    outside = outside.where("block != home").join(found.drop("key"), "node")
    inside = placed.drop("blocks").join(strays, "pivot").withColumns(
        {"part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "outside": F.lit(False)}
    )
    inside = inside.join(found, "key")
    columns = ["pivot", "block", "part", "outside", "node", "grams"]
    second = outside.select(columns).unionByName(inside.select(columns))
    second = second.groupBy("pivot", "block", "part").applyInArrow(_outside_forest(percent), _FOUND_DDL)
    return first.where("u IS NOT NULL").select("u", "v").unionByName(second.select("u", "v"))


def near_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 4,
    percent: int = PERCENT,
) -> DataFrame:
    """``id, n_shingles, component_id`` per row: the size of its set and the smallest linked id.

    Two documents are linked when the n-grams they share make up ``percent`` of 100 of those that
    either has. Links are followed to the end. Documents without words have an empty set and stand alone,
    as do rows of null id, whose component is null. Rows that repeat an id or a text are returned
    each. Other columns of ``docs`` are ignored, and an empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    profile = materialise(
        texts.mapInArrow(
            _profile(width), "doc_id long, n int, digest binary, key long, sketch binary, gram long, docs long"
        ),
        "set-profile",
    )
    members = profile.where("digest IS NOT NULL").select("doc_id", "n", "digest", "key")
    nodes = materialise(
        members.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(
            F.min("doc_id").alias("node"), F.max("n").alias("n"), F.max("key").alias("key")
        ),
        "set-nodes",
        free=True,
    )
    documents = members.count()
    often = (
        profile.where("gram IS NOT NULL")
        .groupBy("gram")
        .agg(F.sum("docs").alias("docs"))
        .where(F.col("docs") >= COMMON_SHARE * documents)
        .orderBy(F.desc("docs"), "gram")
        .limit(COMMON_MOST)
        .collect()
    )
    grams = np.array([r[0] for r in often], dtype=np.int64).view(np.uint64)
    counts = np.array([r[1] for r in often], dtype=np.int64)
    by_gram = np.argsort(grams)
    # Place from the rarest to the most common.
    shared = spark.sparkContext.broadcast((grams[by_gram], -by_gram, counts[by_gram]))

    known = texts.where("doc_id IS NOT NULL")
    windows = known.select("text").mapInArrow(
        _windows(width, percent, shared, SALTED), "pivot long, salt int, key long, n int, rank int"
    )
    meetings = materialise(
        windows.repartition("pivot", "salt")
        .sortWithinPartitions("pivot", "salt", "n", "key")
        .mapInArrow(_regions(percent, REGION), "a long, b long, total int, pivot long, key long, rank int"),
        "meetings",
        free=True,
    )
    needed = F.least(F.lit(MEETINGS), F.ceil(F.lit(percent) * F.col("total") / (100 + percent)))
    pairs = meetings.where("a IS NOT NULL").groupBy("a", "b", "total").agg(F.count(F.lit(1)).alias("met"))
    pairs = materialise(pairs.where(F.col("met") >= needed).select("a", "b").distinct(), "pairs", free=True)
    hot = meetings.where("a IS NULL").groupBy("pivot", "key").agg(F.min("rank").alias("rank"))
    hot = materialise(hot, "large-regions", free=True)

    keys = [pairs.select(F.col(c).alias("key")) for c in "ab"]
    wanted = keys[0].unionByName(keys[1]).unionByName(hot.select("key")).distinct()
    sketches = profile.where("n > 0 AND doc_id IS NOT NULL").select("key", "n", "sketch")
    sketches = materialise(sketches.join(wanted, "key", "left_semi").distinct(), "sketches", free=True)
    candidates = _promising(pairs, sketches, percent).unionByName(_hot_candidates(hot, sketches, percent))
    candidates = materialise(candidates, "candidates", free=True)
    placed = clusters(candidates.select(F.col("a").alias("u"), F.col("b").alias("v")))
    placed = placed.select(F.col("root").alias("pivot"), F.col("node").alias("key"))
    ranks = hot.groupBy("key").agg(F.min("rank").alias("rank"))
    placed = placed.join(sketches.select("key", "n").distinct(), "key").join(ranks, "key", "left")
    placed = materialise(placed, "clusters", free=True)

    chosen = nodes.join(placed.select("key").distinct(), "key").select("node", F.col("digest").alias("own_digest"))
    found = known.join(chosen.hint("merge"), F.col("doc_id") == F.col("node")).select(
        "node", "text", F.col("own_digest").alias("digest")
    )
    sets = materialise(found.mapInArrow(_sets(width), "key long, node long, grams binary"), "sets", free=True)
    roots = components(_cluster_links(placed, sets, sketches, percent))
    labelled = nodes.join(roots, "node", "left").select(
        F.col("digest").alias("own"), F.coalesce("root", "node").alias("root")
    )
    joined = members.join(labelled, F.col("digest") == F.col("own"), "left")
    return joined.select(
        F.col("doc_id").alias(id_col),
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"),
    )


def drop_near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
) -> DataFrame:
    """The documents without near copies, all columns as they came: of each component of
    ``near_components`` the smallest id stays. Rows of null id stay."""
    found = near_components(docs, id_col, text_col, width, percent)
    gone = found.where(F.col(f"`{id_col}`") != F.col("component_id"))
    gone = gone.select(F.col(f"`{id_col}`").alias("_gone")).distinct()
    rows = docs.select(F.struct("*").alias("_row"), F.col(f"`{id_col}`").alias("_id"))
    return rows.join(gone, F.col("_id") == F.col("_gone"), "left_anti").select("_row.*")
