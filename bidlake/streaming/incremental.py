"""Structured Streaming on top of the batch operators (an extension, not part of the parity set)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from bidlake.operators.chunking import token_chunks
from bidlake.operators.relational import last_per_key
from bidlake.plans.ingest import Embedder, default_embedder


def stream_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def start_chunk_sync(
    documents: DataFrame, target: str, checkpoint: str, id_column: str = "doc_id", text_column: str = "text",
    size: int = 200, overlap: int = 30, dim: int = 64, embed: Embedder | None = None, order_column: str | None = None,
) -> StreamingQuery:
    """Chunk and embed arriving documents into ``target``, one folder per micro-batch.

    A repeated batch overwrites its own folder, so a restart neither loses nor doubles chunks. Of several
    versions of a document in one batch, that of the largest ``order_column`` stays; without such a
    column repeated rows count once and unlike texts fail the batch, as nothing tells which is newer.
    """
    embed = embed or default_embedder(dim)

    def write(batch: DataFrame, batch_id: int) -> None:
        if order_column is None:
            one, text = Window.partitionBy(id_column), F.coalesce(F.col(text_column), F.lit(""))
            several = F.raise_error(F.concat(F.lit("several versions in one batch of document "), F.col(id_column).cast("string")))
            batch = batch.withColumn("_differ", F.min(text).over(one) != F.max(text).over(one))
            batch = batch.filter(F.when(F.col("_differ"), several.cast("boolean")).otherwise(True)).drop("_differ")
            batch = batch.dropDuplicates([id_column])
        else:
            batch = last_per_key(batch, id_column, order_column)
        rows = token_chunks(batch, id_column, text_column, size, overlap)
        rows = rows.select("id", F.col(id_column), "chunk_index", "text", embed(F.col("text")).alias("embedding"))
        rows.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return (documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def current_chunks(spark: SparkSession, target: str, id_column: str = "doc_id") -> DataFrame:
    """The newest version of every document's chunks. A document that became shorter in a later
    batch loses the surplus chunks of its earlier version."""
    stored = spark.read.parquet(target)
    newest = stored.groupBy(id_column).agg(F.max("batch_id").alias("batch_id"))
    return last_per_key(stored.join(newest, [id_column, "batch_id"]), "id", "batch_id")


def daily_activity(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events, users and value per day and type. Users are counted approximately, because exact
    distinct counts are not available on streams."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
        .groupBy(F.window("ts", "1 day").alias("day"), "event_type")
        .agg(F.count(F.lit(1)).alias("n_events"), F.approx_count_distinct("user_id").alias("n_users"),
             F.sum("value").alias("total_value"))
        .select(F.col("day.start").alias("day"), "event_type", "n_events", "n_users", "total_value"))


def start_activity(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (daily_activity(events).writeStream.outputMode("append").foreachBatch(sink)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
