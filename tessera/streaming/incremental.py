"""Linking records that arrive: each new record against the standing ones, by the equi-join views.

The stream side is normalized by the same expressions as a batch; views without counts join a stream to a standing
table as they are. Records that come twice within the watermark are taken once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessera.functions import text as T
from tessera.operators import blocking


def arriving(stream: DataFrame, time: str = "arrived", delay: str = "1 hour") -> DataFrame:
    """Normalized records of a stream, each id once within the delay."""
    once = stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(["entity_id"])
    return T.normalized(once)


def candidates(stream: DataFrame, standing: DataFrame) -> DataFrame:
    """Pairs by exact name, exact address, and number with street word."""
    pairs = [blocking.exact_name(stream, standing), blocking.exact_address(stream, standing), blocking.street(stream, standing)]
    return pairs[0].unionByName(pairs[1]).unionByName(pairs[2])


def start(stream: DataFrame, standing: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes the distinct pairs of every batch as Parquet under ``batch=number``, until all that is there has been read. A
    batch that is tried again replaces what its first try wrote."""

    def write(batch: DataFrame, number: int) -> None:
        batch.distinct().write.mode("overwrite").parquet(f"{out}/batch={number}")

    pairs = candidates(arriving(stream), T.normalized(standing))
    return pairs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
