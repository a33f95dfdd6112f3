"""Page recognition as one pass over pending pages.

The engine is a parameter, (path, content, language) -> (text, confidence, rotation), as OCR
programs are no part of this library. Completed pages don't reach it; a page that fails keeps
its state and carries its error, so one bad page ends nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..schemas import OCR_RESULT

Engine = Callable[[str, bytes, str], tuple[str, float, float]]


def recognize(pages: DataFrame, documents: DataFrame, contents: DataFrame, engine: Engine, tasks: int | None = None) -> DataFrame:
    """OCR_RESULT of each page: ok, already_processed, malformed_id, missing_file or failed.

    contents: (path, content), as the binaryFile source gives them.
    """
    language = documents.select(F.col("id").alias("__document"), "languages")
    joined = pages.join(language, F.col("document_id") == F.col("__document")).join(contents.select(F.col("path").alias("__path"), "content"), F.col("image_file") == F.col("__path"), "left")
    done = F.col("ocr_completed")
    outcome = F.when(~text.is_uuid(F.col("id")), "malformed_id").when(done, "already_processed").when(F.col("content").isNull(), "missing_file")
    sorted_out = joined.withColumn("outcome", outcome)
    settled = sorted_out.where("outcome is not null").select(
        F.col("id").alias("page_id"), "outcome", (F.col("outcome") == "already_processed").alias("success"),
        F.when(done, "OCR already completed").alias("message"),
        F.when(F.col("outcome") == "malformed_id", F.concat(F.lit("Invalid UUID format: "), F.col("id"))).when(F.col("outcome") == "missing_file", F.concat(F.lit("No file for page "), F.col("id"))).alias("error"),
        F.when(done, F.col("ocr_text")).alias("text"), F.when(done, F.col("ocr_confidence")).alias("confidence"), F.when(done, F.col("rotation_applied")).alias("rotation_applied"),
    )
    pending = sorted_out.where("outcome is null").select("id", "image_file", "content", "languages")
    if tasks:
        pending = pending.repartition(tasks)  # pages cost far more than moving them

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page, path, content, languages in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                try:
                    said, confidence, rotation = engine(path, content, languages)
                    rows.append({"page_id": page, "outcome": "ok", "success": True, "message": "OCR completed successfully", "error": None, "text": said.strip(), "confidence": float(confidence), "rotation_applied": float(rotation)})
                except Exception as e:  # noqa: BLE001 - any failure of the engine is this page's result
                    rows.append({"page_id": page, "outcome": "failed", "success": False, "message": None, "error": f"OCR processing failed for page {page}: {e}", "text": None, "confidence": None, "rotation_applied": None})
            fields = [("page_id", pa.string()), ("outcome", pa.string()), ("success", pa.bool_()), ("message", pa.string()), ("error", pa.string()), ("text", pa.string()), ("confidence", pa.float64()), ("rotation_applied", pa.float64())]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))

    return settled.unionByName(pending.mapInArrow(run, OCR_RESULT))


def store(pages: DataFrame, results: DataFrame) -> DataFrame:
    """pages with the results of those that were recognized."""
    new = results.where("outcome = 'ok'").select(F.col("page_id").alias("__page"), F.col("text").alias("__text"), F.col("confidence").alias("__confidence"), F.col("rotation_applied").alias("__rotation"))
    hit = F.col("__page").isNotNull()
    taken = {"ocr_text": F.col("__text"), "ocr_confidence": F.col("__confidence"), "rotation_applied": F.col("__rotation"), "ocr_completed": F.lit(True)}
    joined = pages.join(new, F.col("id") == F.col("__page"), "left")
    return joined.select(*(F.when(hit, taken[c]).otherwise(F.col(c)).alias(c) if c in taken else F.col(c) for c in pages.columns))
