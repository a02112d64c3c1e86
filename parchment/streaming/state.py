"""The latest row of each key of a log, as keyed state of a stream.

The state store holds a row a key, spread over the cluster by key and written as changes, so that a batch costs what its
own keys cost, not what the view holds. State is RocksDB's, in the checkpoint, from which a restart goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "last"


class _Latest(StatefulProcessor):
    """Keeps the row of the largest order of a key; gives it whenever a batch brings a larger one."""

    def __init__(self, keys: list[str], order: str, schema: StructType, ttl_ms: int | None):
        self.order, self.ttl_ms = order, ttl_ms
        self.stored = StructType([f for f in schema if f.name not in keys])
        self.names, self.kept = [f.name for f in schema], [f.name for f in self.stored]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState(STATE, self.stored, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        best = None
        for row in rows:
            # Of equal orders the first row seen counts, as of a repeated delivery.
            if best is None or row[self.order] > best[self.order]:
                best = row
        if best is not None and (not self.state.exists() or best[self.order] > self.state.get()[self.kept.index(self.order)]):
            self.state.update(tuple(best[c] for c in self.kept))
            yield Row(**{c: best[c] for c in self.names})

    def close(self) -> None:
        pass


def _combined(keys: list[str], order: str):
    """Of each Arrow batch the rows that can still be a key's latest: a key of very many rows reaches its state as few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch]).append_column("_i", pa.array(range(batch.num_rows)))
            by = t.group_by(keys).aggregate([(order, "max")])
            top = t.select([*keys, order, "_i"]).join(by.rename_columns([*keys, order]), [*keys, order], join_type="inner") if not any(t.column(c).null_count for c in [*keys, order]) else t.select(["_i"])
            keep = pc.sort_indices(top.column("_i"))
            yield batch.take(top.column("_i").take(keep).combine_chunks())

    return run


def latest_changes(stream: DataFrame, keys: list[str], order: str, ttl_ms: int | None = None) -> DataFrame:
    """The rows of a stream that are the latest of their key when they come: late and repeated ones give none.

    keys are its keys, order grows with each version; rows without an order are left out. With ttl_ms, a key that no row has
    come for in that time is forgotten, and its next row counts as new. Needs the RocksDB state store (use_rocks())."""
    schema = stream.schema
    slim = stream.where(F.col(order).isNotNull()).mapInArrow(_combined(keys, order), schema)
    processor = _Latest(keys, order, schema, ttl_ms)
    return slim.groupBy(*keys).transformWithState(processor, schema, "Append", "ProcessingTime" if ttl_ms else "None")


def use_rocks(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def keep_latest(stream: DataFrame, keys: list[str], order: str, path: str, checkpoint: str, ttl_ms: int | None = None) -> StreamingQuery:
    """Runs a stream through latest_changes(); the changes are appended to a Parquet table under path, each batch once, by the
    sink's own log. Without ttl_ms the query ends with what has come so far; with it, it goes on until it is stopped, as time
    passes without rows too."""
    use_rocks(stream.sparkSession)
    changes = latest_changes(stream, keys, order, ttl_ms)
    writer = changes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime="500 milliseconds") if ttl_ms else writer.trigger(availableNow=True)).start()


def read_state(spark: SparkSession, checkpoint: str, keys: list[str]) -> DataFrame:
    """The view as the state store holds it: a row a key, straight from the checkpoint's last batch."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", STATE).load()
    return state.select(*(F.col(f"key.{k}").alias(k) for k in keys), "value.*")
