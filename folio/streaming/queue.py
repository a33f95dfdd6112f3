"""The work queue of pending pages as a file stream: each new page row is handed on once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schemas import PAGE


def pending_pages(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(PAGE).option("maxFilesPerTrigger", files_at_once).parquet(folder).where(~F.col("ocr_completed") & (F.col("image_file") != ""))


def drain(pages: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Works off what is there and ends; a batch that is run again after a failure replaces its own results."""

    def batch(rows: DataFrame, number: int) -> None:
        work(rows).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
