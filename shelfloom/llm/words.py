"""Words and their hashes over whole Arrow batches of texts, without a Python step per word."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes that part words: blank and the five controls from tab to carriage return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

# Odd multipliers of the hash: digits of the golden ratio and of other irrational numbers.
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_LONG_WORD = 256


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``most`` bytes of text; a longer text is a part of its own."""
    texts = batch.column(column)
    if len(texts) == 0:
        return
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset + 1 :][: len(texts)]
    at, base = 0, np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset]
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, upto - at)
        at, base = upto, ends[upto - 1]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as bytes, with 8 spare ones at the end, and the offsets; null counts as empty."""
    if len(texts) == 0:
        return np.zeros(8, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    if texts.null_count:
        texts = texts.fill_null("")
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, dtype=np.int32)[texts.offset :][: len(texts) + 1].astype(np.int64)
    size = int(offsets[-1] - offsets[0])
    padded = np.zeros(size + 8, dtype=np.uint8)
    if size:
        padded[:size] = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return padded, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and how many words come before each text."""
    size = int(offsets[-1])
    inside = ~SPACE[data[:size]]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < size)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(32))) * M2
    return h ^ (h >> np.uint64(29))


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes in order."""
    return mix(a * M1 + b * M3 + (a >> np.uint64(31)))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash per word, eight bytes at a time over all words at once."""
    lengths = ends - starts
    hashes = lengths.astype(np.uint64) * M3
    if len(data) > 8:
        lanes = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data.data, strides=(1,))
        words = np.flatnonzero(lengths <= _LONG_WORD)
        lane = 0
        while len(words):
            left = lengths[words] - 8 * lane
            piece = lanes[starts[words] + 8 * lane] & _MASKS[np.minimum(left, 8)]
            hashes[words] = mix((hashes[words] ^ piece) * M1)
            words, lane = words[left > 8], lane + 1
        for i in np.flatnonzero(lengths > _LONG_WORD):
            digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
            hashes[i] = np.frombuffer(digest, dtype="<u8")[0]
    return hashes


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` neighbours, by doubling; shorter input gives none."""
    count = len(hashes) - length + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    result, taken, power, block = None, 0, 1, hashes
    while power <= length:
        if length & power:
            part = block[taken : taken + count]
            result = part.copy() if result is None else join(result, part)
            taken += power
        if 2 * power <= length:
            block = join(block[:-power], block[power:])
        power *= 2
    return mix(result + np.uint64(length))


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """Minimum or maximum (``pick``) of every ``width`` neighbours."""
    count = len(values) - width + 1
    if count <= 0:
        return values[:0]
    power, block = 1, values
    while 2 * power <= width:
        block = pick(block[:-power], block[power:])
        power *= 2
    return pick(block[:count], block[width - power : width - power + count])
