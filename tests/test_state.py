"""Keyed state of a stream against the last rows of the whole log."""

import random
import time

from parchment.operators.joins import latest
from parchment.streaming import log, state

SCHEMA = "k string, seq long, v string, x double"


def write(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.mode("append").parquet(path)


def run(spark, base):
    stream = spark.readStream.schema(SCHEMA).parquet(f"{base}/in")
    state.keep_latest(stream, ["k"], "seq", f"{base}/out", f"{base}/cp").awaitTermination()


def test_latest_by_state(spark, tmp_path):
    """Late, repeated and missing orders over three starts from one checkpoint; one key has most rows."""
    rng, every = random.Random(2), []
    for batch in range(3):
        rows = [(rng.choice(["hot"] * 9 + [f"k{i}" for i in range(20)]), seq := rng.randrange(1000), f"v{seq}", None if seq % 3 else seq / 2) for _ in range(800)]
        rows = list({(r[0], r[1]): r for r in rows}.values())
        rows += rows[:20] + [("none", None, "x", 1.0)] + [(k, 2000 + batch, f"b{batch}", 0.5) for k in ("new", "hot") if batch != 1]
        write(spark, f"{tmp_path}/in", rows)
        every += rows
        run(spark, tmp_path)
        known = [r for r in every if r[1] is not None]
        best = {}
        for r in known:
            if r[0] not in best or r[1] > best[r[0]][1]:
                best[r[0]] = r
        assert {r.k: (r.k, r.seq, r.v, r.x) for r in state.read_state(spark, f"{tmp_path}/cp", ["k"]).collect()} == best
    changes = spark.read.schema(SCHEMA).parquet(f"{tmp_path}/out")
    assert {r.k: (r.k, r.seq, r.v, r.x) for r in latest(changes, ["k"], "seq").collect()} == best
    assert changes.groupBy("k", "seq").count().where("count > 1").count() == 0  # a repeated row is no change
    run(spark, tmp_path)  # nothing new
    assert spark.read.schema(SCHEMA).parquet(f"{tmp_path}/out").count() == changes.count()


def test_windows_and_late_rows(spark, tmp_path):
    """Tumbling windows; a row later than the watermark is dropped."""
    schema = "at timestamp, k string, v long"
    rows = [[("2024-01-01 00:10:00", "a", 1), ("2024-01-01 00:50:00", "a", 2), ("2024-01-01 01:10:00", "b", 5)], [("2024-01-01 04:00:00", "a", 7)], [("2024-01-01 00:20:00", "a", 100), ("2024-01-01 03:55:00", "a", 1)], [("2024-01-01 09:00:00", "z", 0)], [("2024-01-01 09:01:00", "z", 0)]]
    for batch in rows:
        df = spark.createDataFrame(batch, "at string, k string, v long").selectExpr("to_timestamp(at) at", "k", "v").coalesce(1)
        df.write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        q = log.windowed(stream, "at", ["k"], "v").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted((str(r.start)[11:16], r.k, r.n, r.total) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("00:00", "a", 2, 3), ("01:00", "b", 1, 5), ("03:00", "a", 1, 1), ("04:00", "a", 1, 7)]


def test_state_forgets(spark, tmp_path):
    """A key for which no row came in the time to live is forgotten: an older row of it is a change again."""
    out = lambda: sorted(r.seq for r in spark.read.schema(SCHEMA).parquet(f"{tmp_path}/out").collect())
    write(spark, f"{tmp_path}/in", [("a", 5, "x", 1.0)])
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    query = state.keep_latest(stream, ["k"], "seq", f"{tmp_path}/out", f"{tmp_path}/cp", ttl_ms=4000)

    def until(n):
        for _ in range(60):
            if (tmp_path / "out" / "_spark_metadata").exists() and len(out()) == n:
                return True
            time.sleep(0.5)
        return False

    try:
        assert until(1)
        time.sleep(6)
        write(spark, f"{tmp_path}/in", [("a", 1, "older, but after the key was forgotten", 1.0)])
        assert until(2) and out() == [1, 5]
    finally:
        query.stop()
