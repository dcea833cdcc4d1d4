"""Keeping a record table fresh from a stream of changes."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from chronofold.operators.incremental import upsert


def start_refresh(changes: DataFrame, table: str, checkpoint: str, key: str = "id", order: str = "last_updated") -> StreamingQuery:
    """Add a stream of record versions to the table at `table`, then stop.

    A batch writes only its own latest rows, into its own folder: the work grows
    with the changes, not with the table, and a batch run again replaces itself.
    """

    def one_batch(batch: DataFrame, number: int) -> None:
        upsert(batch, [key], [order]).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return (changes.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_latest(spark: SparkSession, table: str, key: str = "id", order: str = "last_updated") -> DataFrame:
    """The newest row of every key over all batches."""
    return upsert(spark.read.parquet(table).drop("batch"), [key], [order])


def compact(spark: SparkSession, table: str, target: str, key: str = "id", order: str = "last_updated") -> None:
    """Write the newest rows as the first batch of a new table."""
    read_latest(spark, table, key, order).write.mode("overwrite").parquet(f"{target}/batch=0")


class Newest(StatefulProcessor):
    """Keeps the newest version of a key and passes on each version that is newer than all before it."""

    def __init__(self, schema: T.StructType, order: str, keep_ms: int | None) -> None:
        self.schema, self.order, self.keep_ms = schema, order, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", self.schema, self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timer) -> Iterator[Row]:
        stored = self.newest.get() if self.newest.exists() else None
        at = self.schema.fieldNames().index(self.order)
        best = stored
        for row in rows:
            # A null order is older than any other.
            if row[at] is not None and (best is None or best[at] is None or tuple_of(row[at]) > tuple_of(best[at])) or best is None:
                best = row
        if best is not None and best is not stored:
            self.newest.update(tuple(best))
            yield best

    def close(self) -> None:
        pass


def tuple_of(value: object) -> tuple:
    """A value that can be compared; a struct comes as a row or as a dict in the order of its fields."""
    return tuple(value.values()) if isinstance(value, dict) else tuple(value) if isinstance(value, tuple) else (value,)


def start_newest(changes: DataFrame, table: str, checkpoint: str, key: str = "id", order: str = "last_updated",
                 keep_ms: int | None = None) -> StreamingQuery:
    """Add a stream of record versions to the table at `table`, then stop; only versions newer than all seen before are written.

    The newest version of every key is the stream's state, so a late older one is passed over, no batch reads the table, and
    read_newest reads one row a key whatever the history.  keep_ms: forget a key that has no new version for so long.  The state needs
    the RocksDB provider, which is set while the stream starts.  Started again with the same checkpoint, it goes on.
    """
    spark = changes.sparkSession
    newest = changes.groupBy(key).transformWithState(Newest(changes.schema, order, keep_ms), changes.schema, "Update", "ProcessingTime" if keep_ms else "None")

    def one_batch(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    name, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return (newest.writeStream.outputMode("update").foreachBatch(one_batch).option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start())
    finally:
        spark.conf.set(name, before)


def read_newest(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The newest version of every key, out of the state of a stream that start_newest began."""
    state = spark.read.format("statestore").option("stateVarName", "newest").load(checkpoint)
    return state.where(F.col("value").isNotNull()).select("value.*")
