import pytest

from shelfloom.llm import mixing
from tests.llm.common import documents, found, with_extra, words


def targets_by_hand(sizes, weights=(5, 2, 1), most=3):
    """Share the whole by weight, hold who is above and share the rest anew."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, held = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in held)
        open_ = [s for s in order if s not in held]
        share = {s: weight[s] * rest / sum(weight[o] for o in open_) for s in open_}
        above = {s for s in open_ if share[s] > most * sizes[s]}
        if not above:
            return share | {s: float(most * sizes[s]) for s in held}
        held |= above


TEXTS = [(i, "w " * (1 + i * 7 % 13)) for i in range(400)] + [(1000, None), (1001, ""), (None, "a b")]
SOURCES = {i: ["b", "a", "Z", "é", None, "tiny"][min(i % 7, 5) if i % 50 == 5 else i % 5] for i in range(400)}


def test_targets_and_sizes(spark):
    docs = documents(spark, TEXTS, SOURCES | {1000: "void", 1001: "void", None: "b"})
    rows = mixing.mix_report(docs).join(docs.select("doc_id", "source", "text"), "doc_id").collect()
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
    wanted = targets_by_hand(sizes)
    assert any(wanted[s] == 3 * sizes[s] for s in sizes if sizes[s])
    for r in rows:
        assert (r.size, r.source_size) == (len(words(r.text)), sizes[r.source])
        assert r.target == pytest.approx(wanted[r.source])
        assert r.taken % max(1, r.size) == 0 and 0 <= r.taken <= 3 * r.size
    for s in sizes:
        taken = sum(r.taken for r in rows if r.source == s)
        assert abs(taken - wanted[s]) <= 0.2 * wanted[s] + 40


def test_mix_repeats_rows_as_reported(spark):
    docs = with_extra(documents(spark, TEXTS[:200], SOURCES))
    mixed = mixing.mix(docs)
    assert mixed.schema == docs.schema
    counts = dict(found(mixed.groupBy("doc_id").count(), "doc_id", "count"))
    for i, size, taken in found(mixing.mix_report(docs), "doc_id", "size", "taken"):
        assert counts.get(i, 0) * size == taken
    again = dict(found(mixing.mix(docs.repartition(5)).groupBy("doc_id").count(), "doc_id", "count"))
    assert again == counts


def test_empty_tables_and_texts(spark):
    assert mixing.mix_report(documents(spark, [])).count() == 0
    assert mixing.mix(documents(spark, [])).count() == 0
    nothing = documents(spark, [(1, None), (2, "")])
    assert found(mixing.mix_report(nothing), "size", "target", "taken") == [(0, 0.0, 0)] * 2
    assert mixing.mix(nothing).count() == 0


def test_repeated_rows_and_one_source(spark):
    docs = documents(spark, [(1, "a b c")] * 3, {1: "only"})
    assert found(mixing.mix_report(docs), "size", "source_size", "target", "taken") == [(3, 9, 9.0, 3)] * 3


def test_long_texts_keep_their_sizes(spark):
    separators = [" ", "\t", "\n\n", "\x0b", "\x0c", "\r", "\u00a0", "\u3000"]
    long = "".join(f"w{i}" + separators[i % len(separators)] for i in range(200_000))
    docs = documents(spark, [(1, long), (2, "x" * 500_000), (3, " " * 100_000)], {1: "a", 2: "b", 3: None})
    report = {r.doc_id: r for r in mixing.mix_report(docs).collect()}
    assert {i: r.size for i, r in report.items()} == {1: len(words(long)), 2: 1, 3: 0}
    assert all(r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size for r in report.values())
