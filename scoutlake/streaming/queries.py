"""Running streaming queries to the end of their input, and their progress."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scoutlake.session import new_folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
END_S = float(1 << 33)  # event time of the row that ends a bounded stream, in the year 2242
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Custom state needs the RocksDB store; the session's setting is put back after."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def finish(query: StreamingQuery, timeout_s: float | None = None) -> StreamingQuery:
    """Wait for a bounded run; without a timeout until the input is drained."""
    done = query.awaitTermination(timeout_s) if timeout_s is not None else query.awaitTermination()
    if done is False:
        query.stop()
    return query


def drain(stream: DataFrame, name: str, output_mode: str = "append") -> DataFrame:
    """Run ``stream`` over all input there is now into a table and return that table."""
    spark = stream.sparkSession
    path = new_folder(spark, name)
    finish(
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", new_folder(spark, f"{name}-checkpoint"))
        .outputMode(output_mode)
        .trigger(availableNow=True)
        .start()
    )
    return spark.read.schema(stream.schema).parquet(path)


def drain_whole(rows: DataFrame, build: Callable[[DataFrame], DataFrame], name: str, ts: str = "ts_s") -> DataFrame:
    """``build`` over a bounded stream, what is still open at its end included.

    When the input is drained, one row far in the future (``ts``; all else null) follows.
    It moves the watermark past every window, session, timer and waiting row, so all of
    them are emitted; its own stay open and never show up. The stream has ended then: rows
    that come later to the same checkpoint are late. ``build`` must set the watermark.
    """
    spark = rows.sparkSession
    markers = new_folder(spark, f"{name}-end")
    spark.createDataFrame([], rows.schema).write.parquet(markers)
    stream = build(rows.unionByName(spark.readStream.schema(rows.schema).parquet(markers)))
    path, checkpoint = new_folder(spark, name), new_folder(spark, f"{name}-checkpoint")

    def run() -> None:
        writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        finish(writer.outputMode("append").trigger(availableNow=True).start())

    run()
    end = [F.lit(END_S if f.name == ts else None).cast(f.dataType).alias(f.name) for f in rows.schema.fields]
    spark.range(1).select(*end).write.mode("append").parquet(markers)
    run()
    return spark.read.schema(stream.schema).parquet(path)


def each_batch(
    stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """``fn`` on every micro-batch: drained once, or triggered ``every`` interval."""
    writer = stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return writer.trigger(**trigger).start()


def progress(query: StreamingQuery) -> list[dict]:
    """Rows and latency of every evaluation so far."""
    return [
        {
            "batch": p["batchId"],
            "input_rows": p["numInputRows"],
            "latency_ms": p["durationMs"].get("triggerExecution"),
        }
        for p in query.recentProgress
    ]
