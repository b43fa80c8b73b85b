"""Purchases as a stream: repeats dropped, visits, counts, and the context of the next item."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from lanewright.runtime import kept_path


def read_stream(spark: SparkSession, path: str, schema: str | StructType, files: int = 1, size: int | None = None) -> DataFrame:
    """New Parquet files of a folder, ``files`` at a time, or, with ``size``, as many as hold about so many bytes
    (at least one): a batch costs seconds however small it is, and a folder may hold thousands of small files."""
    limit = ("maxFilesPerTrigger", files) if size is None else ("maxBytesPerTrigger", size)
    return spark.readStream.schema(schema).option(*limit).parquet(path)


def distinct_purchases(stream: DataFrame, at: str = "pulled_at", late: str = "1 day") -> DataFrame:
    """Each purchase once, if its repeats come within ``late`` of each other."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(["match_id", "player_slot", "buy_index"])


def visits(stream: DataFrame, at: str, gap: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """Purchases of a seat at most ``gap`` apart, as sessions."""
    grouped = stream.withWatermark(at, late).groupBy("match_id", "player_slot", F.session_window(at, gap).alias("visit"))
    return grouped.agg(F.count(F.lit(1)).alias("n"))


def counts(stream: DataFrame, at: str, keys: list[str], window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts by key and tumbling window; late rows within the watermark are counted."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("since"), *keys, "n")


def contexts(stream: DataFrame, at: str = "pulled_at", late: str = "1 hour", keep_s: int = 7200) -> DataFrame:
    """Each purchase with the two before it in its seat, in order of arrival; state is two ids a seat.

    State of a seat that stays silent for ``keep_s`` of event time is dropped."""

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        one, two = state.get if state.exists else (-1, -1)
        for batch in batches:
            rows = []
            for item in batch.sort_values(["buy_time_s", "buy_index"])["item_id"]:
                rows.append((*key, int(item), one, two))
                one, two = int(item), one
            yield pd.DataFrame(rows, columns=["match_id", "player_slot", "item_id", "prev_one", "prev_two"])
        state.update((one, two))
        state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + keep_s * 1000)

    known = stream.withWatermark(at, late).where("match_id is not null and player_slot is not null and item_id is not null").select("match_id", "player_slot", "item_id", "buy_time_s", "buy_index", at)
    return known.groupBy("match_id", "player_slot").applyInPandasWithState(follow, "match_id long, player_slot int, item_id long, prev_one long, prev_two long", "prev_one long, prev_two long", "append", GroupStateTimeout.EventTimeTimeout)


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """What a stream gives once all that is there now has been read: the last state (``complete``) or all rows (``append``).

    Every batch is written to the shared folder together with the stream's checkpoint, so a lost driver or executor
    costs a batch done again."""
    spark = stream.sparkSession
    path = kept_path(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        # a batch done again replaces its own folder
        batch.write.mode("overwrite").parquet(f"{path}/rows/" + ("last" if mode == "complete" else f"n={number}"))

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows/last" if mode == "complete" else f"{path}/rows/*")
