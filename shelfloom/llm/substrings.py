"""Removal of long repeated passages by hashes of word windows, grouped by minimisers.

A suffix is a document from one word on; its node is the hash of its first 50 words, for two suffixes
that agree so far meet at that depth of a suffix tree. No tree is built and no suffix is sorted: only
windows of 50 words are removed, so whether two suffixes agree in their first 50 words is all that is
asked, and neither deeper nor branching nodes are looked for. Windows are grouped by a name, the
smallest hash of the 10-word pieces in them (a minimiser). Equal windows have equal names, so no repeat
crosses groups; windows of one group need not share a prefix. Few different names arise per document.
Names that only one document has end there. Each further group is small enough for the memory of one
task, which sorts its hashes and so learns which windows repeat an earlier document; neighbouring ones
make a run. A group that is too large is split by the hashes of whole windows, where a window's smallest
document is a plain minimum.

Words are compared by 64-bit hashes; windows that count as equal agree in two hashes, in a group in
its name and the node, in a split group in the node and a second hash of all words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfloom.llm.words import M2, mix, run_hashes, sliding, slices, text_bytes, word_hashes, word_spans
from shelfloom.session import materialise

# Words of a piece that names a window, and windows that a group sorted in one task may hold.
PIECE, GROUP = 10, 1 << 16


class _Suffixes:
    """The words of a slice of texts, the hashes of their windows (nodes) and the names of those."""

    def __init__(self, texts: pa.Array, depth: int):
        self.data, offsets = text_bytes(texts)
        self.starts, self.ends, self.before = word_spans(self.data, offsets)
        self.depth = depth
        self.hashes = word_hashes(self.data, self.starts, self.ends)

    def checks(self) -> np.ndarray:
        """A second hash of every window, of other hashes of its words."""
        return run_hashes(mix(self.hashes ^ M2), self.depth).view(np.int64)

    def named(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Place, text, name and node of every suffix with enough words."""
        nodes = run_hashes(self.hashes, self.depth)
        piece = min(PIECE, self.depth)
        names = sliding(run_hashes(self.hashes, piece), self.depth - piece + 1, np.minimum)
        counts = np.diff(self.before)
        owner = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(owner)) - self.before[owner]
        whole = np.flatnonzero(place + self.depth <= counts[owner])
        return place[whole], owner[whole], names[whole].view(np.int64), nodes[whole].view(np.int64)


def _names(depth: int):
    """``name, doc_id, n``: the names in a document and how many of its windows have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                _, owner, names, _ = _Suffixes(part.column("text"), depth).named()
                order = np.lexsort((names, owner))
                owner, names = owner[order], names[order]
                first = np.flatnonzero(
                    np.append(True, (owner[1:] != owner[:-1]) | (names[1:] != names[:-1]))[: len(owner)]
                )
                counts = np.diff(np.append(first, len(owner)))
                ids = part.column("doc_id").take(pa.array(owner[first]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[first]), ids, pa.array(counts)], ["name", "doc_id", "n"]
                )

    return run


_SUFFIX = pa.schema(
    [
        ("name", pa.int64()),
        ("doc_id", pa.int64()),
        ("start", pa.int32()),
        ("nodes", pa.binary()),
        ("node", pa.int64()),
        ("check", pa.int64()),
    ]
)


def _shared_suffixes(depth: int):
    """Windows whose name other documents have too.

    Neighbours of one name make one row with all their nodes; in a group that is split further,
    each window is a row with its node and the second hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                suffixes = _Suffixes(part.column("text"), depth)
                place, owner, names, nodes = suffixes.named()
                cuts = np.searchsorted(owner, np.arange(part.num_rows + 1))
                ids = part.column("doc_id").to_pylist()
                packed, single, checks = [], [], None
                for i in range(part.num_rows):
                    row = slice(cuts[i], cuts[i + 1])
                    for kind, into in (("small", packed), ("large", single)):
                        wanted = part.column(kind)[i].values.to_numpy(zero_copy_only=False)
                        at = np.flatnonzero(np.isin(names[row], wanted)) + cuts[i]
                        if not len(at):
                            continue
                        if kind == "large":
                            checks = suffixes.checks() if checks is None else checks
                            into.append((ids[i], place[at], nodes[at], checks[suffixes.before[owner[at]] + place[at]]))
                            continue
                        first = np.flatnonzero(
                            np.append(True, (np.diff(at) > 1) | (names[at[1:]] != names[at[:-1]]))
                        )
                        for a, b in zip(first, np.append(first[1:], len(at))):
                            into.append((names[at[a]], ids[i], place[at[a]], nodes[at[a:b]].tobytes()))
                if packed:
                    columns = [pa.array(c, type=t) for c, t in zip(zip(*packed), _SUFFIX.types)]
                    yield pa.RecordBatch.from_arrays([*columns, *[pa.nulls(len(packed), pa.int64())] * 2], schema=_SUFFIX)
                for doc, starts, found, checked in single:
                    size = len(starts)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.nulls(size, pa.int64()),
                            pa.array(np.full(size, doc)),
                            pa.array(starts.astype(np.int32)),
                            pa.nulls(size, pa.binary()),
                            pa.array(found),
                            pa.array(checked),
                        ],
                        schema=_SUFFIX,
                    )

    return run


def _repeats(doc: np.ndarray, start: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    """Runs of neighbouring windows that a document of a smaller id has too."""
    order = np.lexsort((doc, node))
    doc, start, node = doc[order], start[order], node[order]
    first = np.append(True, node[1:] != node[:-1])[: len(node)]
    lowest = doc[first][np.cumsum(first) - 1]
    later = doc > lowest
    doc, start = doc[later], start[later]
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1))[: len(doc)]
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(doc)) - 1
    columns = (doc[begin], start[begin], start[end] if len(begin) else start[:0])
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "first", "last"])


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repeats of each group; rows come in order of name. Holds a batch and one group."""

    def settle(rows: pa.Table) -> pa.RecordBatch:
        held = [np.frombuffer(n.as_buffer(), dtype=np.int64) for n in rows.column("nodes")]
        counts = [len(h) for h in held]
        doc = np.repeat(rows.column("doc_id").to_numpy(), counts)
        base = np.repeat(rows.column("start").to_numpy(), counts)
        within = np.concatenate([np.arange(c, dtype=np.int32) for c in counts])
        return _repeats(doc, base + within, np.concatenate(held))

    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        if not rows.num_rows:
            continue
        names = rows.column("name").to_numpy()
        cut = int(np.searchsorted(names, names[-1], side="left"))
        if cut:
            yield settle(rows.slice(0, cut))
        held = rows.slice(cut)
    if held is not None and held.num_rows:
        yield settle(held)


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 50, group: int = GROUP
) -> DataFrame:
    """``doc_id, first, last``: runs of words at which a window of ``depth`` words starts that also
    starts in a document of a smaller id. Runs of one document may touch.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")
    ).where("doc_id IS NOT NULL AND text IS NOT NULL")
    names = materialise(texts.mapInArrow(_names(depth), "name long, doc_id long, n long"), "prefix-names")
    shared = (
        names.groupBy("name")
        .agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.sum("n").alias("n"))
        .where("low < high")
        .select("name", (F.col("n") > group).alias("split"))
    )
    shared = materialise(shared, "shared-prefixes")
    wanted = names.join(shared, "name").groupBy("doc_id").agg(
        F.collect_set(F.when(~F.col("split"), F.col("name"))).alias("small"),
        F.collect_set(F.when(F.col("split"), F.col("name"))).alias("large"),
    )
    suffixes = materialise(
        texts.join(wanted, "doc_id").mapInArrow(
            _shared_suffixes(depth), "name long, doc_id long, start int, nodes binary, node long, check long"
        ),
        "shared-suffixes",
    )
    grouped = suffixes.where("name IS NOT NULL").select("name", "doc_id", "start", "nodes")
    spans = grouped.repartition(partitions, "name").sortWithinPartitions("name").mapInArrow(
        _subtrees, "doc_id long, first int, last int"
    )
    single = suffixes.where("node IS NOT NULL").select("node", "check", "doc_id", "start")
    lowest = materialise(single.groupBy("node", "check").agg(F.min("doc_id").alias("lowest")), "deep-nodes")
    later = single.join(lowest, ["node", "check"]).where("doc_id > lowest")
    return spans.unionByName(later.select("doc_id", F.col("start").alias("first"), F.col("start").alias("last")))


def _remove(depth: int):
    """Words, removed words and the kept text of each text with its runs."""

    def run(texts: pa.Array, spans: pa.Array) -> pa.Array:
        rows = pa.RecordBatch.from_arrays([texts, spans], ["text", "spans"])
        parts = [one(p) for p in slices(rows, "text")]
        return pa.concat_arrays(parts) if parts else pa.array([], type=kind)

    kind = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def one(part: pa.RecordBatch) -> pa.Array:
        words = _Suffixes(part.column("text"), depth)
        edge = np.zeros(len(words.starts) + 1, dtype=np.int64)
        for i, spans in enumerate(part.column("spans")):
            if spans.is_valid and len(spans):
                first, last = (spans.values.field(f).to_numpy(zero_copy_only=False) for f in ("first", "last"))
                # Rows that share an id may be of different length.
                np.add.at(edge, np.minimum(words.before[i] + first, words.before[i + 1]), 1)
                np.add.at(edge, np.minimum(words.before[i] + last + depth, words.before[i + 1]), -1)
        kept = np.flatnonzero(np.cumsum(edge)[:-1] == 0)
        # Every kept word is followed by a blank, which the last one of a text then loses.
        sizes = words.ends[kept] - words.starts[kept] + 1
        past = np.cumsum(sizes)
        total = int(past[-1]) if len(past) else 0
        data = words.data[np.arange(total) + np.repeat(words.starts[kept] - (past - sizes), sizes)]
        data[past - 1] = 0x20
        cuts = np.append(0, past)[np.searchsorted(kept, words.before)]
        whole = data.tobytes()
        texts = [whole[a : max(a, b - 1)].decode() for a, b in zip(cuts[:-1], cuts[1:])]
        n_words = np.diff(words.before)
        n_kept = np.diff(np.searchsorted(kept, words.before))
        columns = [pa.array(n_words), pa.array(n_words - n_kept), pa.array(texts, type=pa.string())]
        return pa.StructArray.from_arrays(columns, fields=list(kind))

    return run


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 50, group: int = GROUP
) -> DataFrame:
    """``id, n_words, n_removed, kept`` per row of ``docs``.

    A word goes if a window of ``depth`` words covers it whose words also stand in a row, anywhere,
    in a document with a smaller id; the first document keeps them. Windows are those of the texts
    as they came. ``kept`` joins the other words by one blank. Null texts have no words and an
    empty kept text; rows of null id neither lose words nor make others lose them; rows that share
    an id do not affect each other and lose what any of them loses. An empty table gives no rows;
    other columns of ``docs`` are ignored.
    """
    runs = repeated_spans(docs, id_col, text_col, depth, group)
    spans = runs.groupBy("doc_id").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    joined = rows.join(spans, F.col("_id").cast("long") == F.col("doc_id"), "left")
    remove = F.arrow_udf(_remove(depth), "n_words long, n_removed long, kept string")
    done = joined.select("_id", remove("_text", "spans").alias("r"))
    return done.select(F.col("_id").alias(id_col), "r.n_words", "r.n_removed", "r.kept")
