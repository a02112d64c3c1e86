"""Streams over append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.joins import latest


def latest_view(stream: DataFrame, keys: list[str], order: str, path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Keeps the last row of each key of a log under path, by buckets of keys: a batch rewrites only the buckets that its
    keys fall in, each under a new version. read_view() reads the newest version of each bucket."""

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        fresh = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        hit = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # at most `buckets`
        if not hit:
            return
        known = _newest(spark, path, n)
        old = {b: v for b, v in known.items() if b in hit}
        if old:
            stored = spark.read.schema(fresh.schema).parquet(*[f"{path}/bucket{b}/v{v}" for b, v in sorted(old.items())])
            fresh = fresh.unionByName(stored)
        kept = latest(fresh, keys, order)
        for b in hit:
            kept.where(F.col("bucket") == b).coalesce(1).write.mode("overwrite").parquet(f"{path}/bucket{b}/v{n}")
        for b, v in old.items():  # the version before the last is no longer read by anyone
            for older in _versions(spark, f"{path}/bucket{b}"):
                if older < v:
                    _remove(spark, f"{path}/bucket{b}/v{older}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _folder(spark, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _remove(spark, path: str) -> None:
    p, fs = _folder(spark, path)
    fs.delete(p, True)


def _names(spark, path: str, prefix: str) -> list[int]:
    p, fs = _folder(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(x.removeprefix(prefix)) for x in names if x.startswith(prefix))


def _versions(spark, path: str) -> list[int]:
    return [v for v in _names(spark, path, "v") if _folder(spark, f"{path}/v{v}/_SUCCESS")[1].exists(_folder(spark, f"{path}/v{v}/_SUCCESS")[0])]


def _newest(spark, path: str, below: int | None = None) -> dict[int, int]:
    """The newest whole version of each bucket, before batch `below`, so that a batch that is run again starts anew."""
    found = {b: [v for v in _versions(spark, f"{path}/bucket{b}") if below is None or v < below] for b in _names(spark, path, "bucket")}
    return {b: v[-1] for b, v in found.items() if v}


def read_view(spark, path: str) -> DataFrame:
    """The view that latest_view() keeps."""
    return spark.read.parquet(*[f"{path}/bucket{b}/v{v}" for b, v in sorted(_newest(spark, path).items())]).drop("bucket")


def resume(stream: DataFrame, done: DataFrame, keys: list[str], error: str = "error") -> DataFrame:
    """Rows of a stream of work whose keys `done` doesn't hold without an error: a static log that each start reads anew."""
    return stream.join(done.where(F.col(error).isNull()).select(*keys).distinct(), keys, "left_anti")


def windowed(stream: DataFrame, at: str, keys: list[str], value: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums by tumbling windows; rows later than the watermark are dropped by Spark."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")
