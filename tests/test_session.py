from types import SimpleNamespace

import pytest

from harborline import session


def fake(master, configured=None, checkpoint=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: configured or default),
        sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: checkpoint),
    )


def test_the_named_folder_is_used():
    assert session.shared_folder(fake("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    assert session.shared_folder(fake("local[2]", "/shared")) == "/shared"
    assert session.shared_folder(fake("yarn", None, "s3a://b/c")) == "s3a://b/c"


def test_a_cluster_without_a_folder_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(fake("spark://host:7077"))


def test_local_work_gets_one_temporary_folder():
    assert session.shared_folder(fake("local[*]")) == session.shared_folder(fake("local"))


def test_materialised_rows_are_read_from_files(spark):
    stored = session.materialise(spark.range(5).selectExpr("id", "CAST(id AS DECIMAL(28,4)) AS d"), "t")
    assert stored.schema.simpleString() == "struct<id:bigint,d:decimal(28,4)>"
    assert stored.count() == 5 and stored.inputFiles()
    assert session.fresh_path(spark, "t") != session.fresh_path(spark, "t")


def test_partitions_follow_the_stored_size():
    gb, tb = 1 << 30, 1 << 40
    assert session.shuffle_partitions(0, 200) == session.shuffle_partitions(gb, 200) == 200
    assert session.shuffle_partitions(tb, 200) == 8192
    assert session.shuffle_partitions(100 * tb, 200) == session.MAX_SHUFFLE_PARTITIONS
    assert session.shuffle_partitions(tb, 50_000) == 50_000
    assert session.scan_bytes(tb) == session.PARTITION_BYTES
    assert session.scan_bytes(100 * tb) == session.MAX_SCAN_BYTES


def test_sizing_raises_the_settings(spark, tmp_path, monkeypatch):
    first = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    split = "spark.sql.files.maxPartitionBytes"
    (tmp_path / "f").write_bytes(b"x" * 4000)
    assert session.stored_bytes(spark, str(tmp_path)) == 4000
    assert session.stored_bytes(spark, str(tmp_path / "*")) == 4000
    assert spark.conf.get(split) == session.DEFAULT_SPLIT
    session.size_for(spark, str(tmp_path))
    assert spark.conf.get(first, None) is None
    assert spark.conf.get(split) == session.DEFAULT_SPLIT
    monkeypatch.setattr(session, "PARTITION_BYTES", 100)
    monkeypatch.setattr(session, "MAX_SCAN_TASKS", 10)
    try:
        session.size_for(spark, str(tmp_path / "f"))
        assert (spark.conf.get(first), spark.conf.get(split)) == ("40", "400")
        monkeypatch.setattr(session, "PARTITION_BYTES", 1 << 40)
        session.size_for(spark, str(tmp_path / "f"))
        assert (spark.conf.get(first, None), spark.conf.get(split)) == (None, session.DEFAULT_SPLIT)
        monkeypatch.setattr(session, "PARTITION_BYTES", 100)
        spark.conf.set(split, "2g")
        session.size_for(spark, str(tmp_path / "f"))
        assert spark.conf.get(split) == "2g"
    finally:
        spark.conf.unset(first)
        spark.conf.unset(split)


def test_wide_rows_get_more_and_smaller_partitions(spark, tmp_path, monkeypatch):
    first, size = session.FIRST_PARTITIONS, session.ADVISORY
    (tmp_path / "f").write_bytes(b"x" * 4000)
    monkeypatch.setattr(session, "PARTITION_BYTES", 100)
    before = spark.conf.get(size, None)
    try:
        spark.conf.unset(size)
        session.size_for(spark, str(tmp_path / "f"))
        assert (spark.conf.get(first), spark.conf.get(size, None)) == ("40", None)
        session.size_for(spark, str(tmp_path / "f"), spread=8)
        assert (spark.conf.get(first), spark.conf.get(size)) == ("320", f"{16 << 20}b")
        spark.conf.set(size, "1g")
        session.size_for(spark, str(tmp_path / "f"), spread=8)
        assert spark.conf.get(size) == "1g"
    finally:
        spark.conf.unset(first)
        spark.conf.unset(f"harborline.raised.{first}")
        spark.conf.unset(size) if before is None else spark.conf.set(size, before)
