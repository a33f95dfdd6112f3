"""Documents and their pages: rollups, readiness, validation and bulk actions.

documents: (id, ocr_completed, extraction_completed, ...); pages: (document_id, page_number,
ocr_completed, image_file, ocr_text, ...). One aggregation by document answers all counts, so
no row is looked up by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def combined_text(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, combined_text): the texts of completed pages that aren't blank, by number, each under a heading; empty where there is none."""
    good = pages.where(F.col("ocr_completed") & text.not_blank(F.col("ocr_text")))
    headed = good.select(F.col("document_id"), "page_number", F.concat(F.lit("=== Page "), F.col("page_number").cast("string"), F.lit(" ===\n"), F.col("ocr_text")).alias("section"))
    joined = headed.groupBy("document_id").agg(F.expr("listagg(section, '\n\n') within group (order by page_number)").alias("combined_text"))
    return documents.select("id").join(joined, F.col("id") == F.col("document_id"), "left").select("id", F.coalesce("combined_text", F.lit("")).alias("combined_text"))


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("document_id").agg(F.count("*").alias("total"), F.count_if("ocr_completed").alias("completed"))


def status(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """documents with total, completed, percentage (null without pages), derived status, the monotone stored one, and readiness."""
    counted = documents.join(page_counts(pages), F.col("id") == F.col("document_id"), "left").drop("document_id")
    total, done = F.coalesce("total", F.lit(0)), F.coalesce("completed", F.lit(0))
    derived = (total > 0) & (done == total)
    return (
        counted.withColumn("total", total)
        .withColumn("completed", done)
        .withColumn("percentage", text.percentage(F.col("completed"), F.nullif("total", F.lit(0))))
        .withColumn("derived_completed", derived)
        .withColumn("stored_completed", F.col("ocr_completed") | derived)
        .withColumn("can_process", (F.col("total") > 0) & ~F.col("ocr_completed") & (F.col("completed") < F.col("total")))
        .withColumn("can_extract", F.col("ocr_completed") & ~F.col("extraction_completed"))
    )


def progress(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, progress): a struct of completed, total and percentage; null, not zero, where a document has no pages."""
    s = status(documents, pages)
    return s.select("id", F.when(F.col("total") > 0, F.struct("completed", "total", "percentage")).alias("progress"))


def with_pages(documents: DataFrame, pages: DataFrame) -> DataFrame:
    return documents.join(pages, documents["id"] == pages["document_id"], "left_semi")


def without_pages(documents: DataFrame, pages: DataFrame) -> DataFrame:
    return documents.join(pages, documents["id"] == pages["document_id"], "left_anti")


def page_error() -> Column:
    """Why a page can't be processed, the first reason that holds; null if it can."""
    return F.when(F.col("ocr_completed"), "OCR already completed for this page").when(F.coalesce("image_file", F.lit("")) == "", "No image file attached to process")


def can_process_page() -> Column:
    return (F.coalesce("image_file", F.lit("")) != "") & ~F.col("ocr_completed")


def status_label(done: Column) -> Column:
    return F.when(done, "Completed").otherwise("Pending")


def bulk_process(pages: DataFrame) -> DataFrame:
    """One row: how many pages are processed, skipped as completed, and in error for want of a file."""
    return pages.agg(F.count_if(can_process_page()).alias("processed"), F.count_if("ocr_completed").alias("skipped"), F.count_if(~F.col("ocr_completed") & page_error().isNotNull()).alias("errors"))


def bulk_extract(documents: DataFrame) -> DataFrame:
    """(id, task_id) of all documents: a name for a task where extraction may start, else null."""
    return documents.select("id", F.when(F.col("ocr_completed") & ~F.col("extraction_completed"), F.concat(F.lit("extraction-task-"), F.col("id").cast("string"))).alias("task_id"))


def fan_out(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, message, pages_processed) of each document's pending pages."""
    pending = pages.where(~F.col("ocr_completed")).groupBy("document_id").agg(F.count("*").alias("pending"))
    n = F.coalesce("pending", F.lit(0))
    message = F.when(n > 0, F.concat(F.lit("OCR processing started for "), n.cast("string"), F.lit(" pages"))).otherwise("No pages to process")
    return documents.select("id").join(pending, F.col("id") == F.col("document_id"), "left").select("id", message.alias("message"), n.alias("pages_processed"))


def look_up(requested: DataFrame, table: DataFrame) -> DataFrame:
    """(wanted, outcome) of requested ids: found, not_found, or malformed where an id is no UUID."""
    found = requested.join(table.select(F.col("id").alias("there")).distinct(), F.col("wanted") == F.col("there"), "left")
    return found.select("wanted", F.when(~text.is_uuid(F.col("wanted")), "malformed").when(F.col("there").isNull(), "not_found").otherwise("found").alias("outcome"))
