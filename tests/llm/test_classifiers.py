import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfloom.llm import quality, toxicity
from tests.llm.common import documents, found, with_extra

NICE = "the quick river ran along green fields while birds sang near old stone walls".split()
RUDE = ["blockhead", "numbskull", "nitwit"]


def labelled(seed, n=400):
    """Texts of ordinary words; toxic ones hold an insult, poor ones shout in one word."""
    draw = random.Random(seed)
    texts, rows = [], []
    for i in range(n):
        words = [draw.choice(NICE) for _ in range(draw.randint(20, 60))]
        rude, poor = draw.random() < 0.3, draw.random() < 0.3
        if rude:
            for _ in range(3):
                words[draw.randrange(len(words))] = draw.choice(RUDE)
        if poor:
            words = [f"{words[0].upper()}!!"] * len(words) if not rude else [w.upper() + "!!" for w in words]
        texts.append((i, " ".join(words)))
        rows.append((i, int(not poor), int(rude)))
    return texts, rows


def tables(spark, texts, rows):
    return documents(spark, texts), spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


ODD = [(1001, None), (1002, ""), (None, "blockhead nitwit"), (1003, "x" * 300_000), (1004, "NITWIT Blockhead river")]


def test_toxicity_learns_and_holds_out(spark):
    texts, rows = labelled(1)
    docs, labels = tables(spark, texts + ODD + texts[:3], rows + rows[:5] + [(None, 1, 1), (7777, 1, None)])
    result = toxicity.score_toxicity(with_extra(docs), labels).collect()
    assert len(result) == len(texts) + len(ODD) + 3
    truth = {i: t for i, _, t in rows}
    for r in result:
        assert 0.0 <= r.score <= 1.0 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    tested = [r for r in result if r.held_out and r.doc_id in truth]
    assert len(tested) > 50
    assert sum(r.predicted == truth[r.doc_id] for r in tested) >= 0.95 * len(tested)
    by_id = {r.doc_id: r for r in result}
    assert by_id[1001].score == by_id[1002].score < 0.5
    assert by_id[1004].predicted == 1


def test_toxicity_never_sees_held_out_labels(spark):
    texts, rows = labelled(2, 150)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in rows]
    scores = [
        found(toxicity.score_toxicity(*tables(spark, texts, r)), "doc_id", "score") for r in (rows, flipped)
    ]
    assert scores[0] == scores[1]


def test_toxicity_without_labels_or_documents(spark):
    docs, labels = tables(spark, [(1, "a"), (2, "b c")], [])
    assert found(toxicity.score_toxicity(docs, labels), "predicted") == [(0,), (0,)]
    assert toxicity.score_toxicity(*tables(spark, [], [])).count() == 0


def plain_buckets(text):
    """The buckets of all 3- to 5-grams, counted letter by letter."""
    letters, mask = [ord(c) for c in f" {(text or '').lower()} "], (1 << 64) - 1
    result = set()
    for n in (3, 4, 5):
        for at in range(len(letters) - n + 1):
            gram = 0
            for k, letter in enumerate(letters[at : at + n]):
                gram = letter if k == 0 else (gram * int(toxicity.M1) + letter) & mask
            result.add((((gram ^ (gram >> 32)) * int(toxicity.M1)) & mask) >> (64 - toxicity.BUCKET_BITS))
    return sorted(result)


def test_toxicity_scores_as_by_hand(spark):
    texts, rows = labelled(5, 60)
    labels = {i: t for i, _, t in rows if zlib.crc32(str(i).encode()) % 5}
    found_ = {i: plain_buckets(t) for i, t in texts}
    counts = np.zeros((2, toxicity.BUCKETS))
    for i, label in labels.items():
        counts[label, found_[i]] += 1
    p, q = counts[1] + 1, counts[0] + 1
    ratios = np.log(p / p.sum()) - np.log(q / q.sum())
    ratios[np.abs(ratios) < 0.5] = 0
    used = np.flatnonzero(ratios)
    x = np.zeros((len(texts), len(used)))
    for k, (i, _) in enumerate(texts):
        own = np.isin(used, found_[i])
        x[k, own] = ratios[used[own]] / np.sqrt((ratios[found_[i]] ** 2).sum() + 1)
    taught = [k for k, (i, _) in enumerate(texts) if i in labels]
    y = np.array([labels[texts[k][0]] for k in taught], dtype=float)
    w = np.append(np.zeros(len(used)), np.log((y.sum() + 0.5) / (len(y) - y.sum() + 1)))
    m, v = np.zeros_like(w), np.zeros_like(w)
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    for step in range(1, 61):
        error = share * (1 / (1 + np.exp(-(x[taught] @ w[:-1] + w[-1]))) - y)
        slope = np.append(x[taught].T @ error + 3e-4 * w[:-1], error.sum())
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        w = w - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    by_hand = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    scores = dict(found(toxicity.score_toxicity(*tables(spark, texts, rows)), "doc_id", "score"))
    assert [scores[i] for i, _ in texts] == pytest.approx(by_hand.tolist(), abs=1e-6)


def test_toxicity_sample_is_bounded_in_buckets(spark):
    texts, rows = labelled(6, 200)
    docs, labels = tables(spark, texts, rows)
    taught = labels.select("doc_id", F.col("toxic").alias("label"))
    few = toxicity.fit(docs.select("doc_id", "text"), taught, max_buckets=3000)
    all_ = toxicity.fit(docs.select("doc_id", "text"), taught)
    # Ratios count every labelled text, whatever the bound of the fit.
    assert (few.squares == all_.squares).all() and (few.weights != all_.weights).any()


def test_quality_posteriors_as_by_hand(spark):
    texts, rows = labelled(4, 120)
    sources = {i: f"host{i % 7 % 3}" for i, _ in texts}
    docs = documents(spark, texts, sources).withColumn("lang", F.concat(F.lit("l"), F.col("doc_id") % 2))
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    result = quality.score_quality(docs, labels).collect()
    p = {r.doc_id: r.evidence for r in result}
    overall = (sum(p.values()) + 1) / (len(p) + 2)

    def grouped(key):
        groups = {}
        for i, v in p.items():
            groups.setdefault(key(i), []).append(v)
        return groups

    def worth(groups, mean):
        n = sum(map(len, groups.values()))
        spread = sum(len(v) * (sum(v) / len(v) - mean(k)) ** 2 for k, v in groups.items())
        noise = sum(mean(k) * (1 - mean(k)) for k in groups)
        single = sum(len(v) * mean(k) * (1 - mean(k)) for k, v in groups.items())
        return min(1e6, max(1.0, single / n / max((spread - noise) / n, 1e-9) - 1))

    hosts = grouped(lambda i: sources[i])
    of_hosts = worth(hosts, lambda k: overall)
    host = {k: (sum(v) + of_hosts * overall) / (len(v) + of_hosts) for k, v in hosts.items()}
    paths = grouped(lambda i: (sources[i], i % 2))
    of_paths = worth(paths, lambda k: host[k[0]])
    logit = lambda x: np.log(x / (1 - x))
    for r in result:
        own = paths[sources[r.doc_id], r.doc_id % 2]
        path = (sum(own) - r.evidence + of_paths * host[sources[r.doc_id]]) / (len(own) - 1 + of_paths)
        odds = logit(np.clip(r.evidence, 1e-6, 1 - 1e-6)) + logit(path) - logit(overall)
        assert r.host_posterior == pytest.approx(host[sources[r.doc_id]])
        assert r.path_posterior == pytest.approx(path)
        assert r.quality == pytest.approx(1 / (1 + np.exp(-odds))) and r.kept == (r.quality >= 0.5)


def test_quality_learns_and_keeps(spark):
    texts, rows = labelled(3)
    docs, labels = tables(spark, texts + ODD + texts[:3], rows + rows[:5] + [(None, 1, 1)])
    docs = with_extra(docs)
    result = quality.score_quality(docs, labels).collect()
    assert len(result) == len(texts) + len(ODD) + 3
    truth = {i: q for i, q, _ in rows}
    right = sum(r.kept == bool(truth[r.doc_id]) for r in result if r.doc_id in truth)
    assert right >= 0.97 * len(texts)
    good = quality.keep_good(docs, labels)
    assert good.schema == docs.schema
    assert found(good, "doc_id") == sorted(((r.doc_id,) for r in result if r.kept), key=repr)


def test_sites_shrink_towards_their_host_and_the_whole(spark):
    rows = [("big", f"p{i % 2}", 0.9) for i in range(400)] + [("bad", "p0", 0.1)] * 400 + [("new", "p0", 0.1)]
    scored = spark.createDataFrame(rows, "_host string, _path string, _p double")
    sites, worth = quality.site_posteriors(scored)
    found_ = {(r["_host"], r["_path"]): r for r in sites.collect()}
    mean = found_["big", "p0"]["_overall"]
    assert 0.45 < mean < 0.55 and worth >= 1.0
    assert found_["big", "p0"]["_host_posterior"] > 0.85
    assert found_["bad", "p0"]["_host_posterior"] < 0.15
    # A single poor document says less about its host than four hundred do.
    assert found_["bad", "p0"]["_host_posterior"] < found_["new", "p0"]["_host_posterior"] < mean


def test_a_bad_site_lowers_a_doubtful_document(spark):
    rows = [(i, h, "p", 0.95 if h == "good" else 0.05) for i, h in enumerate(["good", "bad"] * 200)]
    rows += [(1000, "good", "p", 0.5), (1001, "bad", "p", 0.5)]
    scored = spark.createDataFrame(rows, "_id long, _host string, _path string, _p double")
    sites, _ = quality.site_posteriors(scored)
    judged = dict(found(quality._judge(scored, sites, 0.5).where("_id >= 1000"), "_id", "_quality"))
    assert judged[1000] > 0.5 > judged[1001]


@pytest.mark.parametrize("host", [None, "h"])
def test_quality_without_labels_or_documents(spark, host):
    docs, labels = tables(spark, [(1, "a b"), (2, None)], [])
    docs = docs.withColumn("source", F.lit(host).cast("string"))
    rows = quality.score_quality(docs, labels).collect()
    assert [r.kept for r in rows] == [True, True]
    for r in rows:
        assert r.evidence == pytest.approx(0.75) and r.quality == pytest.approx(0.75, abs=0.1)
        assert 0 < r.host_posterior < 1 and 0 < r.path_posterior < 1
    assert quality.score_quality(*tables(spark, [], [])).count() == 0
    assert quality.keep_good(*tables(spark, [], [])).count() == 0
