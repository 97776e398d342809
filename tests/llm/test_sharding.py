from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shelfloom.llm import sharding
from tests.llm.common import documents, found, with_extra


def check(rows, limit):
    """Shards are prefix-free, fit, and exist only where the bucket above them does not fit."""
    size, count = defaultdict(int), defaultdict(int)
    for key, n, shard, depth, total, docs in rows:
        assert len(shard) == depth
        size[shard] += n
        count[shard] += 1
    for key, n, shard, depth, total, docs in rows:
        assert (size[shard], count[shard]) == (total, docs)
        assert total <= limit or docs == 1
    for shard in size:
        for n in range(len(shard)):
            assert shard[:n] not in size
        if shard:
            above = [s for s in size if s.startswith(shard[:-1])]
            assert sum(size[s] for s in above) > limit


COLUMNS = ("key", "n_bytes", "shard", "depth", "shard_bytes", "shard_rows")


@pytest.mark.parametrize("limit, round_bits", [(400, 8), (90, 1), (10**6, 8)])
def test_directory_rules(spark, limit, round_bits):
    texts = [(i, "x" * (i * 37 % 60)) for i in range(500)] + [(900, None), (901, "y" * 3000), (None, "z")]
    result = sharding.assign_shards(documents(spark, texts), limit, round_bits=round_bits)
    rows = found(result, *COLUMNS)
    assert len(rows) == len(texts)
    check(rows, limit)


def test_one_key_with_too_many_rows_is_parted(spark):
    docs = documents(spark, [(1, "x" * 50)] * 200 + [(i, "y" * 50) for i in range(2, 50)])
    rows = found(sharding.assign_shards(docs, 1000), *COLUMNS)
    check(rows, 1000)
    assert max(r[3] for r in rows) > 60


def test_empty_table(spark):
    assert sharding.assign_shards(documents(spark, [])).count() == 0


def test_written_shards_hold_every_row(spark, tmp_path):
    docs = with_extra(documents(spark, [(i, "x" * 30) for i in range(300)]))
    sharding.write_shards(docs, str(tmp_path / "s"), max_bytes=1000)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert found(back, *docs.columns) == found(docs, *docs.columns)
    sizes = back.groupBy("shard_prefix").agg({"doc_id": "count"}).collect()
    assert len(sizes) > 8 and max(r[1] for r in sizes) * 30 <= 1000


def test_shards_ignore_other_columns_and_take_long_texts(spark):
    texts = [(i, "é" * (i % 40)) for i in range(200)] + [(900, "z" * 3_000_000), (901, "")]
    names = ["key", "bits", "shard", "depth", "n_bytes", "cell", "_cell", "s"]
    docs = documents(spark, texts).withColumns({n: F.lit("x") for n in names})
    rows = found(sharding.assign_shards(docs, 600), *COLUMNS)
    check(rows, 600)
    assert rows == found(sharding.assign_shards(documents(spark, texts), 600), *COLUMNS)


def test_writing_repeated_keys_is_an_error_and_clashing_columns_stay(spark, tmp_path):
    docs = documents(spark, [(1, "x"), (1, "y"), (2, "z")])
    with pytest.raises(ValueError, match="repeat"):
        sharding.write_shards(docs, str(tmp_path / "r"))
    names = ["_key", "_own", "_row", "shard", "shard_prefix"]
    docs = documents(spark, [(i, "x" * 30) for i in range(90)] + [(None, "n")]).withColumns({n: F.lit("x") for n in names})
    sharding.write_shards(docs, str(tmp_path / "c"), max_bytes=600)
    back = spark.read.parquet(str(tmp_path / "c"))
    assert back.count() == 91 and back.where("_key = 'x' AND _own = 'x' AND _row = 'x' AND shard = 'x'").count() == 91
    assert back.where("shard_prefix = 'x'").count() == 0


def test_directory_lists_each_shard_once(spark):
    shards = sharding.assign_shards(documents(spark, [(i, "x" * 40) for i in range(100)]), 500)
    assert sharding.directory(shards).count() == shards.select("shard").distinct().count()
