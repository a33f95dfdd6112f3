"""Page numbers from file names: at upload, and as a repair of stored pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..schemas import EXTENSIONS

TEMPORARY = 10_000  # repaired pages pass through numbers from here on


def plan_upload(files: DataFrame, single_document: bool = True, extra: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """(batch, document_key, title, page_number, page_order, name) from files (batch, pos, name), and extra columns of these.

    Files of other types are left out. In one document a file without a number gets its place
    among the valid ones, and the first valid file gives the title; otherwise each file is a
    document of one page. page_order sorts by number, equal numbers by upload.
    """
    valid = files.where(text.accepted(F.col("name"), EXTENSIONS))
    if not single_document:
        return valid.select("batch", F.col("pos").alias("document_key"), text.title_from_name(F.col("name")).alias("title"), F.lit(1).alias("page_number"), F.lit(1).alias("page_order"), "name", *extra)
    by_upload = Window.partitionBy("batch").orderBy("pos")
    numbered = valid.withColumn("place", F.row_number().over(by_upload)).withColumn("page_number", F.coalesce(text.uploaded_page_number(F.col("name")), F.col("place")))
    first = F.first("name").over(by_upload.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    order = F.row_number().over(Window.partitionBy("batch").orderBy("page_number", "pos"))
    return numbered.select("batch", F.lit(0).cast("long").alias("document_key"), text.title_from_name(first).alias("title"), "page_number", order.alias("page_order"), "name", *extra)


def duplicate_keys(table: DataFrame, *key: str) -> DataFrame:
    return table.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def conflicts(table: DataFrame, rows: DataFrame, *key: str) -> DataFrame:
    """(*key, there, new) of keys that new rows would share with each other or with rows of the table; a key with a null clashes with nothing."""
    whole = rows.dropna(subset=list(key))
    new = whole.groupBy(*key).agg(F.count("*").alias("new"))
    wanted = new.select(*(F.col(k).alias(f"__{k}") for k in key))
    same = [F.col(k) == F.col(f"__{k}") for k in key]
    there = table.join(wanted, same, "left_semi").groupBy(*(F.col(k).alias(f"__{k}") for k in key)).agg(F.count("*").alias("there"))
    joined = new.join(there, same, "left").select(*key, F.coalesce("there", F.lit(0)).alias("there"), "new")
    return joined.where((F.col("there") > 0) | (F.col("new") > 1))


def repair_plan(pages: DataFrame) -> DataFrame:
    """pages (id, document_id, page_number, original_filename) with what their names say and whether their document can take it.

    action is `update`, `same`, `no_number`, or `conflict`: then two pages of the document
    would share a number, or a number is too large, and all of its updates are off. Final and
    temporary numbers are computed at once; the temporary ones only matter where a final
    number reaches them.
    """
    said = text.stored_page_number(F.col("original_filename"))
    marked = pages.withColumn("said", said).withColumn("too_large", text.too_large_number(F.col("original_filename"), F.col("said")))
    moves = F.coalesce(F.col("said") != F.col("page_number"), F.lit(False))
    # Moved and sorted once, by document and number, which suits the windows of both; what they need is computed above the sort, so that it holds no more than the pages.
    marked = marked.repartition("document_id").withColumn("final", F.when(moves, F.col("said")).otherwise(F.col("page_number"))).sortWithinPartitions("document_id", "final")
    number, document = Window.partitionBy("document_id", "final"), Window.partitionBy("document_id")
    marked = marked.withColumn("clash", (F.count("*").over(number) > 1) & (F.max(moves.cast("int")).over(number) == 1))
    marked = marked.withColumns({"bad": F.max((F.col("clash") | F.col("too_large")).cast("int")).over(document), "moving": F.count_if(moves).over(document), "nearest": F.min(F.when(F.col("final") >= TEMPORARY, F.col("final"))).over(document)})
    # A temporary number clashes with a page that stays, or with a final number set while it is still in use.
    into_temporary = (F.col("moving") > 0) & (F.col("nearest") < F.col("moving") + TEMPORARY)
    blocked = (F.col("bad") == 1) | into_temporary
    action = F.when(F.col("said").isNull(), "no_number").when(~moves, "same").when(blocked, "conflict").otherwise("update")
    return marked.select("id", "document_id", "page_number", "original_filename", "said", action.alias("action"))


def temporary_numbers(plan: DataFrame) -> DataFrame:
    """The numbers that updated pages pass through, from TEMPORARY on in each document."""
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("page_number", "id"))
    return plan.where("action in ('update', 'conflict')").select("id", "document_id", (place - 1 + TEMPORARY).alias("temporary"))


def apply_repair(plan: DataFrame) -> DataFrame:
    return plan.withColumn("page_number", F.when(F.col("action") == "update", F.col("said")).otherwise(F.col("page_number")))


def repair_summary(plan: DataFrame, dry_run: bool = False) -> DataFrame:
    """One row of counts. A dry run sets nothing, so it meets no conflict."""
    moves = F.col("action").isin("update", "conflict") if dry_run else F.col("action") == "update"
    errors = F.col("action") == "no_number" if dry_run else F.col("action").isin("no_number", "conflict")
    return plan.agg(F.count_if(moves).alias("updated"), F.count_if(errors).alias("errors"), F.count_if(F.col("action") == "same").alias("unchanged"))


def moves_by_document(plan: DataFrame) -> DataFrame:
    """(document_id, moves): the pages to update, listed by document in page order."""
    return plan.where("action = 'update'").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "said"))).alias("moves"))
