"""Sampled segmentation into the pieces of a SentencePiece vocabulary, and lossless decoding.

All ways to cut a text into pieces form a lattice. A forward pass sums the weights of the paths that
lead to each node; a backward pass then draws a path, arc by arc, so that a segmentation comes up
with its share of the total weight. Draws are a hash of the row key, of the place in the text and
of the step, so a key always gives the same segmentation, whatever it is batched with.

No piece has a blank after another character, or a line feed or tab beside one, so the lattice falls apart into segments: blanks
with what follows them, and single line feeds and tabs. A segment has the same lattice
wherever it stands; tasks keep the lattices of segments that they have met and draw for all
segments of a slice at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    IntegerType,
    LongType,
    StructField,
    StructType,
)

from shelfloom.llm.words import M1, M2, M3, mix, slices, text_bytes, word_hashes

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"

_BLANK = "▁"  # how vocabularies write a blank
_SLICE = 2 << 20
_MOST_NODES = 1_500_000


@dataclass(frozen=True)
class Vocabulary:
    """Pieces as plain text with their log weights, and the ids of the 256 byte pieces."""

    pieces: dict[str, tuple[int, float]]
    byte_ids: np.ndarray
    byte_weight: float
    texts: list[bytes]

    @property
    def width(self) -> int:
        return max(map(len, self.pieces))


def load_vocabulary(path: str = DEFAULT_MODEL, smoothing: float = 1.0) -> Vocabulary:
    """Read a model file with byte pieces.

    A piece's probability falls with its rank, which merge vocabularies give as a negative score:
    weight = -smoothing * log(2 + rank). Control pieces take no part. A blank stands for the
    vocabulary's blank sign; the sign itself, in a text, is spelled in bytes.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, texts, byte_ids = {}, [], np.zeros(256, dtype=np.int32)
    for i in range(model.get_piece_size()):
        texts.append(b"")
        if model.is_byte(i):
            value = int(model.id_to_piece(i)[3:5], 16)
            byte_ids[value], texts[i] = i, bytes([value])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            piece = model.id_to_piece(i).replace(_BLANK, " ")
            if " " in piece.lstrip(" ") or (len(piece) > 1 and set(piece) & set("\n\t")):
                raise ValueError(f"piece {i} goes beyond a segment")
            pieces[piece] = (i, -smoothing * float(np.log(2.0 - model.get_score(i))))
            texts[i] = piece.encode()
    byte_weight = -smoothing * float(np.log(2.0 + model.get_piece_size()))
    return Vocabulary(pieces, byte_ids, byte_weight, texts)


class _Trie:
    """Hash table of all beginnings of pieces: which are pieces, and their ids and weights."""

    def __init__(self, vocabulary: Vocabulary):
        entries: dict[str, tuple[int, float]] = {}
        for piece, value in vocabulary.pieces.items():
            for n in range(1, len(piece)):
                entries.setdefault(piece[:n], (-1, 0.0))
            entries[piece] = value
        keys = self._keys(list(entries))
        order = np.argsort(keys)
        keys = keys[order]
        assert len(np.unique(keys)) == len(keys), "two beginnings share a hash"
        self.ids = np.array([i for i, _ in entries.values()], dtype=np.int32)[order]
        self.weights = np.array([w for _, w in entries.values()], dtype=np.float32)[order]
        # Slots by the top bits, with the few keys that share them in a row.
        self.shift = np.uint64(64 - 20)
        slots = (keys >> self.shift).astype(np.int64)
        self.first = np.searchsorted(slots, np.arange((1 << 20) + 1)).astype(np.int32)
        self.depth = int(np.diff(self.first).max())
        self.keys = np.append(keys, np.zeros(self.depth, dtype=np.uint64))

    @staticmethod
    def _keys(texts: list[str]) -> np.ndarray:
        """The hash that growing each text letter by letter gives."""
        sizes = np.array([len(t) for t in texts])
        firsts = np.cumsum(sizes) - sizes
        points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        hashes = np.zeros(len(texts), dtype=np.uint64)
        for n in range(int(sizes.max())):
            on = np.flatnonzero(sizes > n)
            hashes[on] = _Trie.extend(hashes[on], points[firsts[on] + n])
        return hashes

    @staticmethod
    def extend(hashes: np.ndarray, points: np.ndarray) -> np.ndarray:
        return mix((hashes ^ points) * M1 + M3)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 without one."""
        slots = (hashes >> self.shift).astype(np.int64)
        at, found = self.first[slots], np.full(len(hashes), -1, dtype=np.int64)
        for step in range(self.depth):
            here = self.keys[at + step] == hashes
            found[here] = at[here] + step
        return found


class Sampler:
    """Encodes slices of texts; keeps the lattices of the segments it has met up to a bound.

    Nodes are numbered through all segments. The arcs that end at a node stand in a row, the longest
    first, each with its piece, its length and the chance that the path comes by it or one before.
    """

    def __init__(self, vocabulary: Vocabulary, most_nodes: int = _MOST_NODES):
        self.vocabulary, self.trie, self.width = vocabulary, _Trie(vocabulary), vocabulary.width
        self.most_nodes = most_nodes
        self._reset()

    def _reset(self) -> None:
        self.first_arc = np.zeros(1, dtype=np.int64)  # of each node, and one past the last
        self.chances = np.zeros(0, dtype=np.float32)
        self.ids = np.zeros(0, dtype=np.int32)
        self.lengths = np.zeros(0, dtype=np.int8)
        self.known = np.zeros(0, dtype=np.uint64)
        self.base = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)

    @staticmethod
    def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end bytes of segments and how many come before each text."""
        size = int(offsets[-1])
        b = data[:size]
        control, blank = (b == 0x0A) | (b == 0x09), b == 0x20
        first = control | blank
        first[1:] &= control[1:] | ~blank[:-1]
        first[1:] |= control[:-1]
        first[offsets[:-1][offsets[:-1] < size]] = True
        starts = np.flatnonzero(first)
        return starts, np.append(starts[1:], size), np.searchsorted(starts, offsets)

    def _arcs(self, points: np.ndarray, segment: np.ndarray, limit: np.ndarray):
        """End node, length, piece and weight of every arc over the code points of segments."""
        found = []
        at, wide = np.arange(len(points)), points.astype(np.uint64)
        grown = np.zeros(len(points), dtype=np.uint64)
        for n in range(1, self.width + 1):
            # Beginnings that still are beginnings of pieces grow by one letter.
            grown = self.trie.extend(grown, wide[at + n - 1])
            entry = self.trie.find(grown)
            ids = np.where(entry >= 0, self.trie.ids[entry], -1)
            piece, end = ids >= 0, at + segment[at] + n
            found.append((end[piece], np.full(int(piece.sum()), n), ids[piece], self.trie.weights[entry[piece]]))
            if n == 1 and not piece.all():
                code = points[~piece].astype(np.int64)
                spelled = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
                single = self.vocabulary.byte_ids[np.minimum(code, 0x7F)]
                ids = np.where(code < 0x80, single, -code)
                found.append((end[~piece], np.ones(len(code), np.int64), ids, self.vocabulary.byte_weight * spelled))
            on = (entry >= 0) & (at + n < limit[at])
            at, grown = at[on], grown[on]
            if not len(at):
                break
        return (np.concatenate(x) for x in zip(*found))

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        """Add the lattices of new segments."""
        sizes = ends - starts
        past = np.cumsum(sizes)
        raw = data[np.arange(past[-1]) + np.repeat(starts - (past - sizes), sizes)]
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
        lengths = np.add.reduceat(((raw & 0xC0) != 0x80).astype(np.int64), past - sizes)
        firsts = np.cumsum(lengths) - lengths
        segment = np.repeat(np.arange(len(lengths)), lengths)
        bases = firsts + np.arange(len(lengths))
        nodes = len(points) + len(lengths)
        end, length, ids, weight = self._arcs(points, segment, (firsts + lengths)[segment])
        # Forward, for all nodes of one offset at a time: the total weight of the paths to each.
        offset = np.arange(nodes) - np.repeat(bases, lengths + 1)
        order = np.lexsort((-length, end, offset[end]))
        end, length, ids, weight = end[order], length[order], ids[order], weight[order]
        total, chances = np.zeros(nodes), np.zeros(len(end), dtype=np.float32)
        levels = np.searchsorted(offset[end], np.arange(1, int(lengths.max()) + 2))
        for a, b in zip(levels[:-1], levels[1:]):
            here = end[a:b]
            paths = total[here - length[a:b]] + weight[a:b]
            first = np.flatnonzero(np.append(True, here[1:] != here[:-1]))
            count = np.diff(np.append(first, len(here)))
            top = np.maximum.reduceat(paths, first)
            parts = np.exp(paths - np.repeat(top, count))
            running = np.cumsum(parts)
            running -= np.repeat(running[first] - parts[first], count)
            sums = running[first + count - 1]
            total[here[first]] = top + np.log(sums)
            chances[a:b] = running / np.repeat(sums, count)
        by_node = np.argsort(end, kind="stable")
        arcs = np.cumsum(np.bincount(end, minlength=nodes)) + self.first_arc[-1]
        known = np.concatenate([self.known, hashes])
        base = np.concatenate([self.base, bases + len(self.first_arc) - 1])
        size = np.concatenate([self.size, lengths])
        self.first_arc = np.concatenate([self.first_arc, arcs])
        self.chances = np.concatenate([self.chances, chances[by_node]])
        self.ids = np.concatenate([self.ids, ids[by_node].astype(np.int32)])
        self.lengths = np.concatenate([self.lengths, length[by_node].astype(np.int8)])
        order = np.argsort(known, kind="stable")
        self.known, self.base, self.size = known[order], base[order], size[order]

    def _look_up(self, data, starts, ends, hashes) -> tuple[np.ndarray, np.ndarray]:
        """First node and length of the lattice of each distinct segment."""
        if len(self.first_arc) > self.most_nodes:
            self._reset()
        at = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), dtype=bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != hashes[inside]
        if new.any():
            self._learn(data, starts[new], ends[new], hashes[new])
            at = np.searchsorted(self.known, hashes)
        return self.base[at], self.size[at]

    def _draw(self, node: np.ndarray, draws: np.ndarray) -> np.ndarray:
        """The arc of each node that its draw falls on."""
        arc, last = self.first_arc[node], self.first_arc[node + 1] - 1
        open_ = np.arange(len(arc))
        while len(open_):
            on = (self.chances[arc[open_]] <= draws[open_]) & (arc[open_] < last[open_])
            open_ = open_[on]
            arc[open_] += 1
        return arc

    def encode(self, texts: pa.Array, keys: np.ndarray) -> pa.ListArray:
        """The sampled pieces of each text; ``keys`` are the rows' 64-bit keys."""
        data, offsets = text_bytes(texts)
        starts, ends, before = self.segments(data, offsets)
        if not len(starts):
            return pa.ListArray.from_arrays(np.zeros(len(texts) + 1, np.int32), pa.array([], pa.int32()))
        hashes = word_hashes(data, starts, ends)
        distinct, example, kind = np.unique(hashes, return_index=True, return_inverse=True)
        base, length = self._look_up(data, starts[example], ends[example], distinct)
        owner = np.repeat(np.arange(len(texts)), np.diff(before))
        place = (np.arange(len(starts)) - before[owner]).astype(np.uint64)
        seed = mix(keys[owner].astype(np.uint64) * M1 + place * M2)
        base, node = base[kind], length[kind].copy()
        # Backward: one arc per step for every segment that is not done.
        live, steps, step = np.arange(len(starts)), [], 0
        while len(live):
            number = M3 * np.array([step], dtype=np.uint64)
            draws = (mix(mix(seed[live] + number)) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
            arc = self._draw(base[live] + node[live], draws)
            steps.append((live, self.ids[arc]))
            node[live] -= self.lengths[arc]
            live, step = live[node[live] > 0], step + 1
        # The last step of a segment is its first piece.
        taken = np.bincount(np.concatenate([s for s, _ in steps]), minlength=len(starts))
        past = np.cumsum(taken)
        ids = np.empty(int(past[-1]), dtype=np.int32)
        for n, (segment, found) in enumerate(steps):
            ids[past[segment] - 1 - n] = found
        total = np.append(0, past)[before]
        if (ids < 0).any():
            ids, total = self._spell(ids, total)
        return pa.ListArray.from_arrays(total.astype(np.int32), pa.array(ids))

    def _spell(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put byte pieces in place of letters without a piece."""
        size = np.ones(len(ids), dtype=np.int64)
        odd = np.flatnonzero(ids < 0)
        spelled = [chr(-ids[i]).encode() for i in odd]
        size[odd] = [len(s) for s in spelled]
        at = np.append(0, np.cumsum(size))
        result = np.repeat(ids, size)
        for i, s in zip(odd, spelled):
            result[at[i] : at[i] + len(s)] = self.vocabulary.byte_ids[list(s)]
        return result, at[ends]


class Decoder:
    """Gives texts back from pieces."""

    def __init__(self, texts: list[bytes]):
        self.bytes = np.frombuffer(b"".join(texts) or b"\0", dtype=np.uint8)
        self.sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def decode(self, rows: pa.ListArray) -> pa.Array:
        """One text per list; null lists give null."""
        ids = rows.flatten().to_numpy(zero_copy_only=False)
        counts = np.array([len(r) if r.is_valid else 0 for r in rows], dtype=np.int64)
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        shift = np.repeat(self.starts[ids] - (ends - sizes), sizes)
        data = self.bytes[np.arange(len(shift)) + shift].tobytes()
        cuts = np.append(0, ends)[np.append(0, np.cumsum(counts))]
        texts = (
            data[a:b].decode() if r.is_valid else None
            for r, a, b in zip(rows, cuts[:-1], cuts[1:])
        )
        return pa.array(texts, type=pa.string())


_SAMPLERS: dict[tuple, Sampler] = {}


def _sampler(vocabulary: Vocabulary) -> Sampler:
    """The sampler of this process: a worker keeps what it has learned from task to task."""
    key = (len(vocabulary.pieces), vocabulary.byte_weight)
    if key not in _SAMPLERS:
        _SAMPLERS.clear()
        _SAMPLERS[key] = Sampler(vocabulary)
    return _SAMPLERS[key]


def _coded(
    docs: DataFrame, id_col: str, text_col: str, model_path: str, smoothing: float, seed: int
) -> DataFrame:
    """``id, n_pieces, lossless, pieces`` per row, in small batches however large those that come."""
    vocabulary = load_vocabulary(model_path, smoothing)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    own_id = F.col(f"`{id_col}`")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    rows = docs.select(own_id.alias("id"), F.xxhash64(own_id, F.lit(seed)).alias("key"), text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, decoder = _sampler(shared.value), Decoder(shared.value.texts)
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                keys = part.column("key").to_numpy(zero_copy_only=False)
                found = sampler.encode(part.column("text"), keys)
                same = pc.equal(decoder.decode(found), part.column("text"))
                counts = pc.list_value_length(found).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), counts, same, found], ["id", "n_pieces", "lossless", "pieces"]
                )

    schema = StructType(
        [
            StructField("id", rows.schema["id"].dataType),
            StructField("n_pieces", LongType()),
            StructField("lossless", BooleanType()),
            StructField("pieces", ArrayType(IntegerType())),
        ]
    )
    return rows.mapInArrow(run, schema)


def decoder(spark, vocabulary: Vocabulary):
    """A function of a column of pieces to their text."""
    shared = spark.sparkContext.broadcast(vocabulary.texts)

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Decoder(shared.value)
        for rows in batches:
            # In parts, since an index per byte is made.
            step = 64
            parts = [own.decode(rows.slice(i, step)) for i in range(0, len(rows), step)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return decode


def encode_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    model_path: str = DEFAULT_MODEL,
    smoothing: float = 1.0,
    seed: int = 0,
) -> DataFrame:
    """``id, n_pieces, lossless, pieces`` per row: a segmentation of the whole text drawn by the id.

    ``lossless`` says whether decoding the pieces gave the text back, to the byte; unlike in the usual
    encoder no blank is put before a text. Null and empty texts have no pieces. Rows that repeat an
    id and text get the same pieces; null ids share a draw. An empty table gives no rows; other
    columns are ignored.
    """
    coded = _coded(docs, id_col, text_col, model_path, smoothing, seed)
    return coded.withColumnRenamed("id", id_col)


def decode_documents(
    coded: DataFrame, pieces_col: str = "pieces", model_path: str = DEFAULT_MODEL
) -> DataFrame:
    """The rows with ``text``, decoded from their pieces; null pieces give a null text."""
    decode = decoder(coded.sparkSession, load_vocabulary(model_path))
    return coded.withColumn("text", decode(F.col(f"`{pieces_col}`")))
