"""Uploads: documents and pages from files, and recognition of what was uploaded, as one chain."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..schemas import DOCUMENT, PAGE
from ..sources.shared import cut
from . import numbering, pages, recognition, snapshots

LANGUAGES = "eng+nld"
SAMPLE_PREFIX = "Demo: "


def upload(files: DataFrame, single_document: bool = True, languages: str = LANGUAGES, title: str | None = None, folder: str = "document_pages", now: datetime | None = None, salt: str | None = None) -> tuple[DataFrame, DataFrame]:
    """New (documents, pages), as DOCUMENT and PAGE have them, from files (batch, pos, name).

    Numbers, titles and what is left out are those of plan_upload(); a title given holds for
    each batch that becomes one document. Ids are digests of batch, document and file under a
    salt, a random one unless given, so both tables, and a task that is run again, agree on
    them. Of a batch without a file of a known type there is nothing.
    """
    salt = uuid.uuid4().hex if salt is None else salt
    when = F.lit((now or datetime.now(UTC)).isoformat()).cast("timestamp")
    plan = numbering.plan_upload(files, single_document, extra=["pos"])
    key = [F.col("batch").cast("string"), F.col("document_key").cast("string")]
    plan = plan.withColumn("owner", text.uuid_of(F.lit(salt), *key))
    named = F.lit(title) if title is not None and single_document else F.col("title")
    documents = plan.groupBy(F.col("owner").alias("id")).agg(F.min(named).alias("title")).withColumns(
        {"languages": F.lit(languages), "upload_date": when, "ocr_completed": F.lit(False), "extraction_completed": F.lit(False)}
    )
    rows = plan.select(
        text.uuid_of(F.lit(salt), *key, F.col("pos").cast("string")).alias("id"), F.col("owner").alias("document_id"), "page_number", F.concat(F.lit(f"{folder}/"), "name").alias("image_file"),
        F.lit(False).alias("ocr_completed"), F.lit("").alias("ocr_text"), F.lit(None).cast("double").alias("ocr_confidence"), F.lit(0.0).alias("rotation_applied"),
        F.col("name").alias("original_filename"), when.alias("created_at"), when.alias("updated_at"),
    )
    return documents.select(DOCUMENT.fieldNames()), rows.select(PAGE.fieldNames())


def refresh(documents: DataFrame, page_rows: DataFrame) -> DataFrame:
    """documents with their status derived anew from their pages; one that is complete stays so."""
    done = pages.status(documents.select("id", "ocr_completed", "extraction_completed"), page_rows).select(F.col("id").alias("__id"), "stored_completed")
    joined = documents.join(done, F.col("id") == F.col("__id"))
    return joined.select(*(F.col("stored_completed").alias(c) if c == "ocr_completed" else F.col(c) for c in documents.columns))


def process(documents: DataFrame, page_rows: DataFrame, contents: DataFrame, engine: recognition.Engine, chosen: Column | None = None, tasks: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, pages, results) after recognition of the pages that may be processed, of the chosen ones where given.

    The engine runs once: its results are cut in the shared folder, and pages and documents follow from them.
    """
    ready = pages.can_process_page() if chosen is None else pages.can_process_page() & F.coalesce(chosen, F.lit(False))
    results = cut(recognition.recognize(page_rows.where(ready), documents, contents, engine, tasks))
    after = recognition.store(page_rows, results)
    return refresh(documents, after), after, results


def reprocess(documents: DataFrame, page_rows: DataFrame, chosen: Column, contents: DataFrame, engine: recognition.Engine, tasks: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """process() of the chosen pages after they are reset, completed ones too. A page without a file is reset and not recognized."""
    return process(documents, snapshots.reset_pages(page_rows, chosen), contents, engine, chosen, tasks)


def samples(documents: DataFrame, page_rows: DataFrame, files: DataFrame, engine: recognition.Engine, languages: str = LANGUAGES, salt: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, pages, results) with each file (path, content, ...) as a fresh sample document of one page, recognized at once in its own language; earlier samples go, with their pages."""
    old = F.startswith("title", F.lit(SAMPLE_PREFIX))
    documents, page_rows, _ = snapshots.delete_cascading(documents, old, page_rows, "document_id")
    named = files.select(F.lit(0).alias("batch"), F.col("path").alias("pos"), text.basename(F.col("path")).alias("name"))
    new_documents, new_pages = upload(named, single_document=False, languages=languages, salt=salt)
    first = new_pages.select(F.col("document_id").alias("__owner"), "original_filename")
    titled = new_documents.join(first, F.col("id") == F.col("__owner")).withColumn("title", text.sample_title(F.col("original_filename"), F.col("languages"))).select(new_documents.columns)
    content = files.select(F.concat(F.lit("document_pages/"), text.basename(F.col("path"))).alias("path"), "content")
    done = process(titled, new_pages, content, engine)
    return snapshots.insert(documents, done[0]), snapshots.insert(page_rows, done[1]), done[2]
