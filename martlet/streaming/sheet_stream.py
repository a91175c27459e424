"""Stage arriving sheet files, then refresh the tables from the staged rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from martlet.operators.ingest import Domains, IngestResult, ingest
from martlet.schema import FLAT_SCHEMA
from martlet.sources.flat import read_flat


def stage_sheet_stream(spark: SparkSession, source_dir: str, store_dir: str,
                       checkpoint_location: str, fmt: str = "csv",
                       available_now: bool = True,
                       max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start a query that copies each new sheet file under ``source_dir`` into
    ``store_dir`` (parquet, partitioned by micro-batch id).

    A replayed micro-batch overwrites its own partition (dynamic partition
    overwrite), so the store holds every arrived row exactly once.  CSV columns are found by
    each file's header; the files of a micro-batch are listed on the driver (bound them with
    ``max_files_per_trigger``).  One store
    belongs to one query (one checkpoint location): batch ids are its own.  With
    ``available_now`` the query processes what is there and stops.
    """
    reader = spark.readStream.format("text" if fmt == "csv" else fmt)
    if fmt != "csv":
        reader = reader.schema(FLAT_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(source_dir)
    if fmt == "csv":
        stream = stream.select(F.col("_metadata.file_path").alias("file"))

    def stage(batch: DataFrame, epoch_id: int) -> None:
        if fmt == "csv":  # each file by its own header, whatever the order of its columns
            files = sorted(r["file"] for r in batch.distinct().collect())
            if not files:
                return
            batch = reduce(DataFrame.unionByName, [read_flat(batch.sparkSession, f) for f in files])
        (batch.withColumn("epoch", F.lit(epoch_id))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("epoch").parquet(store_dir))

    writer = (stream.writeStream.foreachBatch(stage)
              .option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else \
        writer.trigger(processingTime="1 minute")
    return writer.start()


def refresh_from_store(spark: SparkSession, store_dir: str,
                       domains: Domains = Domains()) -> IngestResult:
    """The six tables and rejects from every staged sheet row (full refresh)."""
    return ingest(spark.read.parquet(store_dir).drop("epoch"), domains)
