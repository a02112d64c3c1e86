"""Numbered lines over any splits, commits that count once, and state by key."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from parchment.sources import commits, lines

SCHEMA = StructType([StructField("id", LongType(), False), StructField("v", StringType())])


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "997")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lines_keep_their_numbers(spark, tmp_path, small_splits):
    want = {}
    for name, end, last in (("a", "\n", ""), ("b", "\r\n", "\r\n"), ("c", "\n", "\n\n\n")):
        text = [f"{name}{i}" + "x" * (i * 37 % 211) if i % 7 else "" for i in range(300)]
        (tmp_path / f"{name}.jsonl").write_bytes((end.join(text) + last).encode())
        want |= {(name, i): line for i, line in enumerate((end.join(text) + last).replace("\r\n", "\n").removesuffix("\n").split("\n"), 1)}
    got = lines.numbered_lines(spark, str(tmp_path))
    assert got.select("file", F.spark_partition_id()).distinct().count() > 3
    assert {(r.file.rsplit("/", 1)[1][0], r.number): r.line for r in got.collect()} == want
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20  # each file lay in many splits


def test_typed_rows_name_the_bad_line(spark, tmp_path, small_splits):
    path = str(tmp_path / "rows.jsonl")
    good = [f'{{"id": {i}, "v": "{"y" * (i % 50)}"}}' for i in range(1, 400)]
    with open(path, "w") as f:
        f.write("\n\n".join(good) + "\n")
    rows = lines.typed_rows(spark, path, SCHEMA)
    assert {(r.number, r.id) for r in rows.collect()} == {(2 * i - 1, i) for i in range(1, 400)} and rows.columns == ["file", "number", "id", "v"]
    bad = {101: '{"id": "x"}', 103: '{"id": 1, "more": 2}', 105: '{"v": "a"}', 107: '{"id": null}', 109: "[1]", 111: '{"id": 1', 113: "plain", 115: '{"id": 1, "v": null}', 117: '{"id": 3}'}
    for n, x in bad.items():
        good[(n + 1) // 2 - 1] = x
    with open(path, "w") as f:
        f.write("\n\n".join(good) + "\n")
    found = {r.number: r.problem for r in lines.bad_lines(spark, path, SCHEMA).collect()}
    types = "not an object of the schema's types"
    assert found == {101: types, 103: "unknown fields more", 105: "no value for id", 107: "no value for id", 109: types, 111: types, 113: types}
    with pytest.raises(Exception, match=r"rows.jsonl:1\d\d: "):
        lines.typed_rows(spark, path, SCHEMA).collect()
    assert lines.numbered_lines(spark, path).where("number = 799").count() == 0
    (tmp_path / "empty.jsonl").write_text("")
    assert lines.typed_rows(spark, str(tmp_path / "empty.jsonl"), SCHEMA).count() == 0


def test_commits_count_once(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(100).select("id", F.concat(F.lit("é\n"), F.col("id").cast("string")).alias("v"))
    assert commits.read(spark, path, SCHEMA).count() == 0
    assert commits.append(df.repartition(4), path, "first") == 100 and commits.append(df, path, "first") == 0 and commits.append(df.limit(3), path, "second") == 3
    assert sorted((r.id, r.v) for r in commits.read(spark, path, SCHEMA).collect())[:2] == [(0, "é\n0"), (0, "é\n0")]
    assert commits.overwrite(df.where("id < 5"), path) == 5 and commits.read(spark, path, SCHEMA).count() == 5
    assert commits.read(spark, path, SCHEMA, 1).count() == 100  # an earlier commit
    assert commits.append(df.where("false"), path) == 0 and commits.append(df.where("false"), path, "none") == 0
    left = commits.vacuum(path)
    assert left > 0 and commits.read(spark, path, SCHEMA).count() == 5
    with pytest.raises(ValueError):
        commits.Table("nowhere://x")


def test_a_task_that_fails_leaves_no_rows(spark, tmp_path):
    """A write whose task fails halfway adds nothing, though its other tasks had written files; run again it adds all once."""
    path, flag = str(tmp_path / "t"), str(tmp_path / "flag")
    assert commits.append(spark.range(10).select("id", F.lit("a").alias("v")), path, "one") == 10

    def fail_once(batches):
        for b in batches:
            yield b
            if b.num_rows and 150 in b.column(0).to_pylist() and not os.path.exists(flag):
                open(flag, "w").close()
                raise RuntimeError("lost")

    rows = spark.range(0, 200, 1, 8).mapInArrow(fail_once, "id long").select("id", F.lit("b").alias("v"))
    with pytest.raises(Exception, match="lost"):
        commits.append(rows, path, "two")
    assert commits.read(spark, path, SCHEMA).count() == 10
    assert commits.append(rows, path, "two") == 200 and commits.append(rows, path, "two") == 0
    ids = [r.id for r in commits.read(spark, path, SCHEMA).where("v = 'b'").collect()]
    assert sorted(ids) == list(range(200))


def test_attempts_and_writers_at_once(tmp_path):
    """Two attempts of a task write two files, of which the commit names one; two commits at once get two numbers."""
    path = str(tmp_path / "t")
    import pyarrow as pa

    batch = [pa.RecordBatch.from_arrays([pa.array(['{"id": 1}'])], names=["value"])]
    writer = commits._BatchWriter(path, None, False)
    first, second = writer.write(iter(batch)), writer.write(iter(batch))
    assert first.files[0][0] != second.files[0][0]
    writer.commit([second, None])
    table = commits.Table(path)
    assert table.manifest()["files"] == [list(second.files[0])]
    assert not table._create({"number": 1, "files": [], "batches": []})  # the number is taken
    assert table.commit([first], None, False) and table.manifest()["number"] == 2 and len(table.manifest()["files"]) == 2


def test_a_stream_commits_each_batch_once(spark, tmp_path):
    path, source = str(tmp_path / "t"), str(tmp_path / "in")
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).select("id", F.lit("s").alias("v")).coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema(SCHEMA).json(source)
        commits.append_stream(stream, path, str(tmp_path / "cp")).awaitTermination()
        assert commits.read(spark, path, SCHEMA).count() == 10 * (i + 1)
    # A batch that is run again, as after a crash between its commit and the checkpoint's, adds nothing.
    assert not commits.Table(path).commit([commits.Written([("x.jsonl", 1)])], "stream-1", False)
    assert commits.read(spark, path, SCHEMA).count() == 30
