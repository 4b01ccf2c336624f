"""A stream of block updates applied to a stored snapshot, an extension of the batch refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.nowcast import refresh


def last_update(updates: DataFrame) -> DataFrame:
    """The newest update (block, new_date, new_yoy) of each block in a batch; of equal months the largest."""
    newest = updates.groupBy("block").agg(F.max(F.struct("new_date", "new_yoy")).alias("x"))
    return newest.select("block", "x.new_date", "x.new_yoy")


def apply_batch(snapshots: str, batch: DataFrame, batch_id: int) -> None:
    """Write version batch_id + 1 of the snapshot from version batch_id. A batch that runs again writes the same
    version again, so updates are applied once."""
    spark = batch.sparkSession
    before = spark.read.parquet(f"{snapshots}/version={batch_id}")
    after = refresh(before, last_update(batch)).select(*before.columns)
    after.write.mode("overwrite").parquet(f"{snapshots}/version={batch_id + 1}")


def stream_refresh(updates: DataFrame, snapshots: str, checkpoint: str) -> StreamingQuery:
    """Apply a stream of updates to versioned snapshots; version=0 must be there."""
    writer = updates.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(lambda batch, n: apply_batch(snapshots, batch, n)).start()
