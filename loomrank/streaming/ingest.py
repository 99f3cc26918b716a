"""Streaming ingestion: files in, one row per content out."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_id
from ..operators.chunking import chunk_documents


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the rows of Parquet files that arrive below ``path``, deduplicated by content for as long as the stream's state is kept."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    one_file = not spark.read.format("binaryFile").option("pathGlobFilter", name).load(folder).select("path").where(F.col("path").endswith("/" + name)).isEmpty() if name.endswith(".parquet") else False
    stream = source.option("pathGlobFilter", name).parquet(folder) if one_file else source.parquet(path)
    return stream.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("candidate_id", content_id(F.col("text"))).dropDuplicates(["candidate_id"])


def state_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    base = named.rstrip("/") if named else f"file://{tempfile.mkdtemp(prefix='loomrank-stream-')}"
    return f"{base}/stream-{uuid.uuid4().hex}"


def ingest(stream: DataFrame, chunks_path: str, status_path: str, checkpoint: str):
    """Starts a query that appends the chunks of each new content and then its status; a batch that is run again replaces its own files."""

    def batch(df: DataFrame, epoch: int) -> None:
        rows = chunk_documents(df)
        rows.write.mode("overwrite").parquet(f"{chunks_path}/epoch={epoch}")
        df.select("doc_id", "candidate_id", F.lit("done").alias("status")).write.mode("overwrite").parquet(f"{status_path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_available(spark: SparkSession, path: str) -> DataFrame:
    """Takes in all that is there now and returns candidate_id, status, n_chunks."""
    base = state_folder(spark)
    ingest(uploads(spark, path), f"{base}/chunks", f"{base}/status", f"{base}/checkpoint").awaitTermination()
    n = spark.read.parquet(f"{base}/chunks").groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    return spark.read.parquet(f"{base}/status").join(n, "candidate_id", "left").select("candidate_id", "status", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))
