"""Shared pieces: scratch tables in the cluster's shared folder, and byte-level numpy views of text columns."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Whitespace that separates words: space and \t \n \v \f \r.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, everything else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Setting by which Spark removes an execution's shuffle files at its end.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not got.isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="parchment-"))
            got = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = got.get()
    return base.rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive any executor.

    drop() removes those that no later step reads; what a returned DataFrame still reads stays.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.at = spark, f"{shared_dir(spark)}/parchment-{what}-{uuid.uuid4().hex}"
        self.names: list[str] = []

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """The rows of df as a table. Its shuffle files go as soon as it is written: nothing reads them again."""
        self._write(df.write.mode("overwrite"), name)
        return self.spark.read.schema(df.schema).parquet(f"{self.at}/{name}")

    def add(self, df: DataFrame, name: str, *by: str) -> None:
        """Adds the rows of df to a table in folders by the values of columns, which read() and drop() take one by one."""
        self._write(df.write.mode("append").partitionBy(*by), name)

    def _write(self, writer, name: str) -> None:
        before = self.spark.conf.get(CLEAN)
        self.spark.conf.set(CLEAN, "true")
        try:
            writer.option("compression", "zstd").parquet(f"{self.at}/{name}")
        finally:
            self.spark.conf.set(CLEAN, before)
        self.names.append(name)

    def read(self, name: str, schema: T.StructType) -> DataFrame:
        """A table or one of its folders; empty if no row went there."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.at}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


    def drop_all_but(self, *keep: str) -> None:
        self.drop(*(n for n in self.names if n not in keep))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nullable(df: DataFrame) -> T.StructType:
    """The schema of df, with all columns nullable."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])


def crc_mod(column: str, m: int):
    """crc32 of a column as text, modulo m; null counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % m


def parts(df: DataFrame) -> int:
    """Shuffle partitions of the session, for repartition() calls that need a number."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Keys with more rows than this, or than a 100,000th of all rows, don't travel to one task: at most 100,000 of them exist.
OFTEN, SHARE = 10_000, 100_000


def often_from(rows: int) -> int:
    """From how many rows on a key is met by broadcast, of so many rows in all."""
    return max(OFTEN, rows // SHARE)


def meet(rows: DataFrame, known: DataFrame, key: list[str], most: int, how: str = "inner") -> DataFrame:
    """rows joined with known (key, each once, n, ...), without n: n is how many rows have the key. Keys with over `most`
    rows, so few that they are broadcast, leave their rows where they are; all others bring at most `most` rows to a task."""
    hot, rest = known.where(F.col("n") > most), known.where(F.col("n") <= most).drop("n").hint("shuffle_merge")
    if hot.isEmpty():
        return rows.join(rest, key, how)
    cold = rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(rest, key, how)
    return cold.unionByName(rows.join(F.broadcast(hot.drop("n")), key, how))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's UTF-8 bytes end to end, and the n + 1 offsets of its rows. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, most: int):
    """(first, last) row ranges of up to `most` bytes each; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of True that don't cross rows, and the number of runs of each row."""
    n = len(is_word)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(is_word[:-1], out=first[1:])
    cut = offsets[:-1][(offsets[:-1] > 0) & (offsets[:-1] < n)]
    first[cut] = True
    first &= is_word
    last = np.empty(n, bool)
    last[-1] = True
    np.logical_not(is_word[1:], out=last[:-1])
    last[cut - 1] = True
    last &= is_word
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RollingHash:
    """Polynomial hashes modulo 2**64 of any spans of a byte array, by prefix sums over random values of the bytes."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.of = rng.integers(0, 2**64, 256, np.uint64)
        self.base = int(rng.integers(0, 2**61, dtype=np.uint64)) * 8 + 5
        self.back = pow(self.base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            up, down = np.full(n, self.base, np.uint64), np.full(n, self.back, np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.of[data] * self.up[: len(data)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((sums[ends] - sums[starts]) * self.down[starts])
