import pytest
from pyspark.sql import functions as F

from shelfloom.sources.request_files import read_request_files, request_manifest, write_request_files


def lines(spark, n, width=10):
    return spark.range(n).repartition(4).select(F.lpad(F.col("id").cast("string"), width, "0").alias("value"))


def read(spark, folder):
    return sorted(r[0] for r in read_request_files(spark, folder).collect())


def test_files_close_at_lines_and_bytes(spark, tmp_path):
    for limits in ({"max_lines": 7}, {"max_bytes": 64}, {"max_lines": 7, "max_bytes": 64}):
        folder = str(tmp_path / "-".join(limits))
        write_request_files(lines(spark, 200), folder, **limits)
        files = request_manifest(spark, folder).collect()
        assert max(f["lines"] for f in files) == min(limits.get("max_lines", 99), limits.get("max_bytes", 9999) // 11)
        assert sum(f["lines"] for f in files) == 200 and sum(f["bytes"] for f in files) == 2200
        assert read(spark, folder) == [f"{i:010d}" for i in range(200)]


def test_a_task_that_fails_halfway_leaves_nothing_visible(spark, tmp_path):
    folder = str(tmp_path / "broken")
    bad = F.when(F.col("value") == "0000000150", F.lit("x" * 100)).otherwise(F.col("value")).alias("value")
    with pytest.raises(Exception, match="exceeds the limit"):
        write_request_files(lines(spark, 200).select(bad), folder, max_lines=7, max_bytes=64)
    assert not (tmp_path / "broken" / "manifest.jsonl").exists()
    write_request_files(lines(spark, 30), folder, max_lines=7, max_bytes=64)
    with pytest.raises(Exception, match="exceeds the limit"):
        write_request_files(lines(spark, 200).select(bad), folder, max_lines=7, max_bytes=64)
    assert read(spark, folder) == [f"{i:010d}" for i in range(30)]


def test_a_new_manifest_replaces_the_old_one(spark, tmp_path):
    folder = str(tmp_path / "twice")
    write_request_files(lines(spark, 20), folder)
    write_request_files(lines(spark, 5), folder)
    assert len(read(spark, folder)) == 5


def test_no_lines_null_lines_and_long_ones(spark, tmp_path):
    write_request_files(spark.createDataFrame([], "value string"), str(tmp_path / "none"))
    assert read(spark, str(tmp_path / "none")) == []
    rows = spark.createDataFrame([(None,), ("ä" * 100_000,)], "value string")
    write_request_files(rows, "file:" + str(tmp_path / "some"), max_bytes=200_001)
    assert read(spark, str(tmp_path / "some")) == ["", "ä" * 100_000]


def test_one_text_column_and_positive_limits(spark, tmp_path):
    with pytest.raises(Exception, match="one text column"):
        write_request_files(spark.range(1), str(tmp_path / "x"))
    with pytest.raises(Exception, match="positive"):
        write_request_files(lines(spark, 1), str(tmp_path / "x"), max_lines=0)


def test_driver_holds_one_entry_per_task_and_readers_list_no_files(spark, tmp_path):
    folder = str(tmp_path / "many")
    write_request_files(lines(spark, 400), folder, max_lines=2)
    # About 200 files, written by 4 tasks.
    assert request_manifest(spark, folder).count() >= 200
    assert len((tmp_path / "many" / "manifest.jsonl").read_text().splitlines()) == 4
    assert len(read_request_files(spark, folder).inputFiles()) == 4
    assert read(spark, folder) == [f"{i:010d}" for i in range(400)]


def test_lines_longer_than_a_block_and_carriage_returns_stay_whole(spark, tmp_path):
    texts = ["x" * (5 << 20), "", "a\rb", "y" * (9 << 20), "z"]
    rows = spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1)
    write_request_files(rows, str(tmp_path / "long"))
    assert read(spark, str(tmp_path / "long")) == sorted(texts)
