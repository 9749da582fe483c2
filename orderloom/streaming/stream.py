"""Streams of messages and orders (ids W1-W3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from orderloom.operators.resolve import SPELLING, joined_spellings, resolve_spellings
from orderloom.plans.orders import parse_messages
from orderloom.sources.staging import remove, scratch


class Spellings:
    """Spellings of places that a stream has resolved, as a table that grows.

    A version holds all spellings up to a batch. A batch that brings new ones writes
    the next version, whole, and then removes the versions before the last, so the folder
    holds two at most; a batch without new ones writes nothing. A batch that
    runs again finds what it has resolved before.
    """

    def __init__(self, spark: SparkSession, path: str, records: DataFrame, threshold: float = 84.0):
        self.spark, self.path, self.records, self.threshold = spark, path.rstrip("/"), records, threshold

    def versions(self) -> list[int]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = [f.getPath() for f in fs.listStatus(at)] if fs.exists(at) else []
        mark = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(p.getName().split("=")[1]) for p in done if fs.exists(mark(p, "_SUCCESS")))

    def resolved(self, addresses: DataFrame) -> DataFrame:
        """Addresses with ``resolved``; only spellings that no batch had before are scored."""
        have = self.versions()
        known = self.spark.read.parquet(f"{self.path}/version={have[-1]}") if have else None
        asked = addresses.select(*SPELLING).distinct()
        if known is not None:
            seen = known.select(*[F.col(c).alias(f"__{c}") for c in SPELLING])
            same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in SPELLING]
            asked = asked.join(seen.hint("merge"), same[0] & same[1] & same[2], "left_anti")
        if known is None or not asked.isEmpty():
            new = resolve_spellings(asked, self.records)
            after = have[-1] + 1 if have else 0
            (new if known is None else known.unionByName(new)).write.mode("overwrite").parquet(f"{self.path}/version={after}")
            for old in have[:-1]:
                remove(self.spark, f"{self.path}/version={old}")
            known = self.spark.read.parquet(f"{self.path}/version={after}")
        return joined_spellings(addresses, known, self.threshold)


def parse_stream(messages: DataFrame, records: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Parsed orders of each micro-batch, written under its batch number, so that a
    batch that runs again after a loss replaces its own output. Resolution ranks within
    an address, which a stream cannot do by itself, hence the batch function; it scores
    the spellings that no batch before had, which stay in a table beside the checkpoint. What a
    batch stages for itself is removed when it is done."""
    spellings = Spellings(messages.sparkSession, f"{checkpoint.rstrip('/')}-spellings", records)

    def batch(df: DataFrame, number: int) -> None:
        with scratch(df.sparkSession):
            parse_messages(df, records, resolve=spellings.resolved).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def dedupe_stream(messages: DataFrame, within: str = "1 hour", ts: str = "ts") -> DataFrame:
    """The first of equal texts within the watermark."""
    return messages.withColumns({"input_hash": F.sha2("text", 256), ts: F.col(ts).cast("timestamp")}).withWatermark(ts, within).dropDuplicatesWithinWatermark(["input_hash"])


def orders_per_minute(orders: DataFrame, every: str = "1 minute", late: str = "5 minutes", ts: str = "ts") -> DataFrame:
    """Orders in each tumbling window."""
    # watermarks need a timestamp with zone; one without is read in the session's
    counted = orders.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, every)).agg(F.count(F.lit(1)).alias("orders"))
    return counted.select(F.col("window.start").alias("minute"), "orders")
