import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from shelfloom.llm import pieces
from tests.llm.common import documents, found, with_extra

TEXTS = [
    "Hello  world\n▁x\ta 😀é\u0000z", "", " ", "a", "   lead", "trail  ", "\r\r;\r\n", "日本語テキスト" * 40, "ab" * 700,
    "\n\n\n", "don't </s> <0x41>", "ÅÅ ﬁ é", " " * 40,
]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load_vocabulary()


def test_decoding_gives_back_any_text(vocabulary):
    sampler, decoder = pieces.Sampler(vocabulary, most_nodes=50), pieces.Decoder(vocabulary.texts)
    for seed in range(4):
        rows = sampler.encode(pa.array(TEXTS), np.arange(len(TEXTS)) + seed)
        assert decoder.decode(rows).to_pylist() == TEXTS


def test_pieces_depend_on_the_key_alone(vocabulary):
    together = pieces.Sampler(vocabulary).encode(pa.array(TEXTS), np.arange(len(TEXTS)))
    fresh = pieces.Sampler(vocabulary, most_nodes=1)
    alone = [fresh.encode(pa.array([t]), np.array([i]))[0].as_py() for i, t in enumerate(TEXTS)]
    assert together.to_pylist() == alone
    other = fresh.encode(pa.array(TEXTS), np.arange(len(TEXTS)) + 99)
    assert other.to_pylist() != alone


def all_paths(text, vocabulary):
    if not text:
        return {(): 0.0}
    paths = {}
    for n in range(1, len(text) + 1):
        if text[:n] in vocabulary.pieces:
            piece, weight = vocabulary.pieces[text[:n]]
            for rest, more in all_paths(text[n:], vocabulary).items():
                paths[(piece, *rest)] = weight + more
    return paths


def test_draws_follow_the_weights_of_all_paths():
    vocabulary = pieces.load_vocabulary(smoothing=0.25)
    for text in (" there", "ing"):
        paths = all_paths(text, vocabulary)
        total = sum(math.exp(w) for w in paths.values())
        draws = 20_000
        rows = pieces.Sampler(vocabulary).encode(pa.array([text] * draws), np.arange(draws))
        counts = Counter(map(tuple, rows.to_pylist()))
        assert set(counts) <= set(paths)
        for path, weight in paths.items():
            share = math.exp(weight) / total
            assert abs(counts[path] / draws - share) < 5 * math.sqrt(share / draws) + 1e-3


def test_documents(spark):
    texts = [(i, t) for i, t in enumerate(TEXTS)] + [(50, None), (None, "no id"), (3, "a"), (60, "long " * 40_000)]
    coded = pieces.encode_documents(with_extra(documents(spark, texts)))
    rows = found(coded, "doc_id", "n_pieces", "lossless")
    assert len(rows) == len(texts) and all(r[2] for r in rows)
    assert (50, 0, True) in rows
    back = found(pieces.decode_documents(coded), "doc_id", "text")
    assert back == sorted(((i, t or "") for i, t in texts), key=repr)


def test_empty_table(spark):
    coded = pieces.encode_documents(documents(spark, []))
    assert pieces.decode_documents(coded).count() == 0
