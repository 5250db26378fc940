"""Arriving snapshots as a stream: each batch is compared with the current table, which it then updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lexweave.operators.changes import snapshot_diff, upsert
from lexweave.operators.joins import keep_first
from lexweave.sources.sinks import append, exists


def ingest_stream(spark: SparkSession, arriving: str, table: str, changes: str, checkpoint: str, schema: StructType, key: str, fields: list[str], order: str) -> StreamingQuery:
    """Reads new parquet files of `arriving`. Table versions lie side by side in `table`/v=N and the newest counts, so a
    batch that is repeated after a failure writes its own version again and nothing else."""

    def one(batch: DataFrame, number: int) -> None:
        newest = keep_first(batch, [key], [batch[order].desc()])
        before = f"{table}/v={number - 1}"
        old = spark.read.schema(schema).parquet(before) if exists(spark, before) else spark.createDataFrame([], schema)
        seen = old.join(newest.select(key), key, "left_semi")
        append(snapshot_diff(seen, newest, key, fields, f"batch-{number}", None), f"{changes}/batch={number}") if not exists(spark, f"{changes}/batch={number}") else None
        upsert(old, newest, key).write.mode("overwrite").parquet(f"{table}/v={number}")

    return spark.readStream.schema(schema).parquet(arriving).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
