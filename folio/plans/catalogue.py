"""The operators as registered queries over the driver's tables, each with its SQL.

The tables stand in for the ones the operators are made for: conversations are documents
(conv_id) with pages (turn) of text, of which the assistant's are completed; orders are
documents and line items their pages, completed where the line status is F; parts are
uploaded files; customers are persons, and a customer's parent is the one with half its key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import kin, listing, numbering, pages, recognition, snapshots, upload
from ..schemas import OLD_LANGUAGES
from ..sources.files import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# --- Stand-ins ---


def talk_documents(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "conversations").select(F.col("conv_id").alias("id")).distinct()


def talk_pages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page_number"), F.col("text").alias("ocr_text"), (F.col("role") == "assistant").alias("ocr_completed"))


def order_documents(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("ocr_completed"), (F.col("o_orderpriority") == "1-URGENT").alias("extraction_completed"))


def line_pages(s: SparkSession, d: str) -> DataFrame:
    file = F.when(F.col("l_returnflag") == "A", F.lit("")).otherwise(F.concat(F.lit("scan/"), F.col("l_partkey").cast("string"), F.lit(".pdf")))
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page_number"), (F.col("l_linestatus") == "F").alias("ocr_completed"), file.alias("image_file"), "l_partkey", "l_suppkey", "l_quantity")


LINE_PAGES = """lp AS (SELECT l_orderkey AS document_id, l_linenumber AS page_number, l_linestatus = 'F' AS ocr_completed,
  CASE WHEN l_returnflag = 'A' THEN '' ELSE 'scan/' || l_partkey::VARCHAR || '.pdf' END AS image_file, l_partkey, l_suppkey, l_quantity FROM lineitem)"""
ORDER_DOCUMENTS = "od AS (SELECT o_orderkey AS id, o_orderstatus = 'F' AS ocr_completed, o_orderpriority = '1-URGENT' AS extraction_completed FROM orders)"
STATUS = f"""WITH {LINE_PAGES}, {ORDER_DOCUMENTS},
  c AS (SELECT document_id, count(*) AS total, count(*) FILTER (WHERE ocr_completed) AS completed FROM lp GROUP BY 1),
  st AS (SELECT id, ocr_completed, extraction_completed, coalesce(total, 0) AS total, coalesce(completed, 0) AS completed FROM od LEFT JOIN c ON id = document_id)"""


def upload_files(s: SparkSession, d: str) -> DataFrame:
    """Batches of ten parts, with names of several kinds."""
    ending = F.when(F.col("p_type") == "ECONOMY", ".pdf").when(F.col("p_type") == "SMALL", ".JPG").when(F.col("p_type") == "LARGE", ".txt").otherwise(".tif")
    middle = F.when(F.col("p_size") > 30, F.concat(F.lit("_"), F.lpad(F.col("p_size").cast("string"), 3, "0"))).when(F.col("p_size") > 10, F.concat(F.lit("-"), F.col("p_size").cast("string"))).otherwise(F.lit(""))
    return table(s, d, "part").select(F.floor(F.col("p_partkey") / 10).alias("batch"), F.col("p_partkey").alias("pos"), F.concat(F.translate("p_name", " ", "_"), middle, ending).alias("name"))


FILES = """f AS (SELECT floor(p_partkey / 10)::BIGINT AS batch, p_partkey AS pos, replace(p_name, ' ', '_')
  || CASE WHEN p_size > 30 THEN '_' || lpad(p_size::VARCHAR, 3, '0') WHEN p_size > 10 THEN '-' || p_size::VARCHAR ELSE '' END
  || CASE p_type WHEN 'ECONOMY' THEN '.pdf' WHEN 'SMALL' THEN '.JPG' WHEN 'LARGE' THEN '.txt' ELSE '.tif' END AS name FROM part)"""


def stored_pages(s: SparkSession, d: str) -> DataFrame:
    """Line items under stored names: a number first for some, last for others, none for the rest."""
    n = F.col("l_partkey") % 40 + 1
    name = F.when(F.col("l_returnflag") == "A", F.concat(F.lpad(n.cast("string"), 3, "0"), F.lit("_fwl.pdf"))).when(F.col("l_returnflag") == "R", F.concat(F.lit("scan_"), n.cast("string"), F.lit(".pdf"))).otherwise(F.lit("cover.pdf"))
    return table(s, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string")).alias("id"), F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page_number"), name.alias("original_filename"))


STORED = r"""sp AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d'), l_extendedprice::DECIMAL(18,2)) AS id, l_orderkey AS document_id, l_linenumber AS page_number,
  CASE l_returnflag WHEN 'A' THEN lpad((l_partkey % 40 + 1)::VARCHAR, 3, '0') || '_fwl.pdf' WHEN 'R' THEN 'scan_' || (l_partkey % 40 + 1)::VARCHAR || '.pdf' ELSE 'cover.pdf' END AS original_filename FROM lineitem)"""


def _stored_number(name: str) -> str:
    stem = rf"regexp_replace({name}, '(?s)\.[^.]*$', '')"
    return "coalesce(" + ", ".join(f"try_cast(nullif(regexp_extract({stem}, '{p}', 1), '') AS INTEGER)" for p in (r"^(\d{3})_", r"(\d{3})$", r"^(\d+)_", r"(\d+)$")) + ")"


_EXT = r"regexp_extract({n}, '(?s)^(?:.*/)?\.*[^./][^/]*?(\.[^./]*)$', 1)"


def _stem(name: str) -> str:
    return f"left({name}, (length({name}) - length({_EXT.format(n=name)}))::BIGINT)"


def _upload_number(name: str) -> str:
    return "coalesce(" + ", ".join(f"try_cast(nullif(regexp_extract({_stem(name)}, '{p}', 1), '') AS INTEGER)" for p in (r"(\d{3})$", r"(\d+)$")) + ")"


def _title(name: str) -> str:
    runs = rf"regexp_extract_all(regexp_replace({_stem(name)}, '[_-]', ' ', 'g'), '(?s)(\p{{L}}+|\P{{L}}+)', 1)"
    return f"array_to_string(list_transform({runs}, lambda r: upper(left(r, 1)) || lower(substr(r, 2))), '')"


PLAN = f"""WITH {STORED}, m AS (SELECT *, {_stored_number("original_filename")} AS said FROM sp),
  n AS (SELECT *, coalesce(said <> page_number, false) AS moves, CASE WHEN coalesce(said <> page_number, false) THEN said ELSE page_number END AS final FROM m),
  w AS (SELECT *, count(*) OVER (PARTITION BY document_id, final) > 1 AND max(moves::INT) OVER (PARTITION BY document_id, final) = 1 AS bad FROM n),
  b AS (SELECT *, max(bad::INT) OVER (PARTITION BY document_id) = 1 AS blocked FROM w),
  p AS (SELECT id, document_id, page_number, original_filename, said, CASE WHEN said IS NULL THEN 'no_number' WHEN NOT moves THEN 'same' WHEN blocked THEN 'conflict' ELSE 'update' END AS action FROM b)"""


def persons(s: SparkSession, d: str) -> DataFrame:
    maiden = F.when(F.col("c_acctbal") < 2000, F.col("c_mktsegment")).otherwise(F.lit(""))
    return table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.initcap("c_mktsegment").alias("given_names"), F.col("c_name").alias("surname"), maiden.alias("maiden_name"))


PERSONS = "ps AS (SELECT c_custkey AS id, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS given_names, c_name AS surname, CASE WHEN c_acctbal < 2000 THEN c_mktsegment ELSE '' END AS maiden_name FROM customer)"
NAMES = f"{PERSONS}, nm AS (SELECT id AS person_id, surname, given_names, concat_ws(' ', given_names, CASE WHEN maiden_name <> '' THEN '(' || maiden_name || ')' END, surname) AS person_name FROM ps)"
KINDS = {"0": "Marriage", "1": "Registered Partnership", "2": "Cohabitation"}
EVENTS = {"view": "Birth", "click": "Baptism", "purchase": "Marriage", "signup": "Death"}


def partnerships(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A partnership for each supplier, of the customers with the same key and twice that."""
    own = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 3).cast("string").alias("partnership_type"))
    bridge = own.select(F.col("id").alias("left_id"), F.explode(F.array("id", F.col("id") * 2)).alias("right_id")).distinct()
    return own, bridge


PARTNERSHIPS = f"""{NAMES}, pt AS (SELECT s_suppkey AS id, CASE s_nationkey % 3 WHEN 0 THEN 'Marriage' WHEN 1 THEN 'Registered Partnership' ELSE 'Cohabitation' END AS kind FROM supplier),
  br AS (SELECT id AS left_id, id AS right_id FROM pt UNION SELECT id, id * 2 FROM pt),
  pl AS (SELECT id, coalesce((SELECT string_agg(person_name, ' & ' ORDER BY surname, given_names, person_id) FROM br JOIN nm ON person_id = right_id WHERE left_id = id), '') || ' (' || kind || ')' AS label FROM pt)"""


# --- Documents and pages ---


@query(r"""WITH t AS (SELECT conv_id AS id, string_agg('=== Page ' || turn::VARCHAR || ' ===' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS x FROM conversations
  WHERE role = 'assistant' AND regexp_matches(text, '\S') GROUP BY 1) SELECT DISTINCT conv_id AS id, coalesce(x, '') AS combined_text FROM conversations LEFT JOIN t ON t.id = conv_id""")
def combined_document_text(s: SparkSession, d: str) -> DataFrame:
    return pages.combined_text(talk_documents(s, d), talk_pages(s, d))


@query(f"{STATUS} SELECT id, total AS page_count FROM st")
def page_count(s: SparkSession, d: str) -> DataFrame:
    return pages.status(order_documents(s, d), line_pages(s, d)).select("id", F.col("total").alias("page_count"))


@query(f"{STATUS} SELECT id, CASE WHEN total > 0 THEN completed END AS completed, CASE WHEN total > 0 THEN total END AS total, CASE WHEN total > 0 THEN round(completed::DOUBLE / total * 100, 6) END AS percentage FROM st")
def ocr_progress(s: SparkSession, d: str) -> DataFrame:
    return pages.progress(order_documents(s, d), line_pages(s, d)).select("id", "progress.completed", "progress.total", F.round("progress.percentage", 6).alias("percentage"))


@query(f"{STATUS} SELECT id, total > 0 AND completed = total AS derived_completed, ocr_completed OR (total > 0 AND completed = total) AS stored_completed FROM st")
def ocr_status_rollup(s: SparkSession, d: str) -> DataFrame:
    return pages.status(order_documents(s, d), line_pages(s, d)).select("id", "derived_completed", "stored_completed")


@query(f"{STATUS} SELECT id, total > 0 AND NOT ocr_completed AND completed < total AS can_process, ocr_completed AND NOT extraction_completed AS can_extract FROM st")
def document_readiness(s: SparkSession, d: str) -> DataFrame:
    return pages.status(order_documents(s, d), line_pages(s, d)).select("id", "can_process", "can_extract")


@query("SELECT o_orderkey AS id FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def docs_with_pages(s: SparkSession, d: str) -> DataFrame:
    return pages.with_pages(order_documents(s, d), line_pages(s, d)).select("id")


@query("SELECT o_orderkey AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def docs_without_pages(s: SparkSession, d: str) -> DataFrame:
    return pages.without_pages(order_documents(s, d), line_pages(s, d)).select("id")


@query(f"""WITH {LINE_PAGES} SELECT document_id, page_number, CASE WHEN ocr_completed THEN 'OCR already completed for this page' WHEN image_file = '' THEN 'No image file attached to process' END AS error,
  image_file <> '' AND NOT ocr_completed AS can_process FROM lp""")
def page_validation(s: SparkSession, d: str) -> DataFrame:
    return line_pages(s, d).select("document_id", "page_number", pages.page_error().alias("error"), pages.can_process_page().alias("can_process"))


@query(f"""WITH {LINE_PAGES} SELECT count(*) FILTER (WHERE image_file <> '' AND NOT ocr_completed) AS processed, count(*) FILTER (WHERE ocr_completed) AS skipped,
  count(*) FILTER (WHERE NOT ocr_completed AND image_file = '') AS errors FROM lp""")
def bulk_process_summary(s: SparkSession, d: str) -> DataFrame:
    return pages.bulk_process(line_pages(s, d))


@query(f"WITH {ORDER_DOCUMENTS} SELECT id, CASE WHEN ocr_completed AND NOT extraction_completed THEN 'extraction-task-' || id::VARCHAR END AS task_id FROM od")
def bulk_extract(s: SparkSession, d: str) -> DataFrame:
    return pages.bulk_extract(order_documents(s, d))


@query(f"""{STATUS} SELECT id, CASE WHEN total > completed THEN 'OCR processing started for ' || (total - completed)::VARCHAR || ' pages' ELSE 'No pages to process' END AS message,
  total - completed AS pages_processed FROM st""")
def fan_out(s: SparkSession, d: str) -> DataFrame:
    return pages.fan_out(order_documents(s, d), line_pages(s, d))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'Pending' ELSE 'Completed' END AS status FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def extraction_status(s: SparkSession, d: str) -> DataFrame:
    docs, labels = table(s, d, "documents"), table(s, d, "labels").select(F.col("doc_id").alias("l_id"))
    return docs.join(labels, F.col("doc_id") == F.col("l_id"), "left").select("doc_id", pages.status_label(F.col("l_id").isNotNull()).alias("status"))


@query("""WITH r AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'bad-' || c_custkey::VARCHAR ELSE md5((c_custkey * 2)::VARCHAR) END AS wanted FROM customer), t AS (SELECT md5(c_custkey::VARCHAR) AS id FROM customer)
  SELECT wanted, CASE WHEN wanted LIKE 'bad-%' THEN 'malformed' WHEN id IS NULL THEN 'not_found' ELSE 'found' END AS outcome FROM r LEFT JOIN t ON id = wanted""")
def task_lookup(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer")
    wanted = c.select(F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("bad-"), F.col("c_custkey").cast("string"))).otherwise(F.md5((F.col("c_custkey") * 2).cast("string"))).alias("wanted"))
    return pages.look_up(wanted, c.select(F.md5(F.col("c_custkey").cast("string")).alias("id")))


# --- Uploads and recognition ---


def _uuid(*parts: str) -> str:
    return rf"regexp_replace(md5(concat_ws('|', {', '.join(parts)})), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\1-\2-\3-\4-\5')"


SALT = "uploads"
UPLOADED = f"""WITH {FILES}, v AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY pos) AS place FROM f WHERE lower({_EXT.format(n="name")}) IN ('.pdf', '.jpg', '.jpeg', '.png', '.tiff', '.tif')),
  n AS (SELECT *, coalesce({_upload_number("name")}, place)::INTEGER AS page_number, first_value(name) OVER (PARTITION BY batch ORDER BY pos) AS first, {_uuid(f"'{SALT}'", "batch::VARCHAR", "'0'")} AS document_id FROM v)"""


@query(f"{UPLOADED} SELECT DISTINCT document_id AS id, {_title('first')} AS title, 'nld' AS languages, FALSE AS ocr_completed, FALSE AS extraction_completed FROM n")
def uploaded_documents(s: SparkSession, d: str) -> DataFrame:
    return upload.upload(upload_files(s, d), languages="nld", salt=SALT)[0].drop("upload_date")


@query(f"""{UPLOADED} SELECT {_uuid(f"'{SALT}'", "batch::VARCHAR", "'0'", "pos::VARCHAR")} AS id, document_id, page_number, 'document_pages/' || name AS image_file, FALSE AS ocr_completed, '' AS ocr_text,
  NULL::DOUBLE AS ocr_confidence, 0.0::DOUBLE AS rotation_applied, name AS original_filename FROM n""")
def uploaded_pages(s: SparkSession, d: str) -> DataFrame:
    return upload.upload(upload_files(s, d), languages="nld", salt=SALT)[1].drop("created_at", "updated_at")


def scans(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, pages, contents): web pages as scans, ten a document; some are done, some have no file, no path, or no proper id."""
    page, k = table(s, d, "pages"), F.col("page_id")
    rows = page.select(
        F.when(k % 11 == 0, F.concat(F.lit("bad-"), k.cast("string"))).otherwise(text.uuid_of(k.cast("string"))).alias("id"), text.uuid_of(F.lit("d"), F.floor(k / 10).cast("string")).alias("document_id"),
        (k % 10 + 1).cast("int").alias("page_number"), F.when(k % 17 == 0, "").otherwise(F.concat(F.lit("scan/"), k.cast("string"))).alias("image_file"), (k % 5 == 0).alias("ocr_completed"),
        F.when(k % 5 == 0, "kept").otherwise("").alias("ocr_text"), F.when(k % 5 == 0, 50.0).alias("ocr_confidence"), F.lit(0.0).alias("rotation_applied"),
    )
    documents = rows.select(F.col("document_id").alias("id")).distinct().select("id", F.when(F.col("id") < "8", "eng").otherwise("nld").alias("languages"), F.lit(False).alias("ocr_completed"), F.lit(False).alias("extraction_completed"))
    return documents, rows, page.where(k % 7 != 0).select(F.concat(F.lit("scan/"), k.cast("string")).alias("path"), F.col("html").cast("binary").alias("content"))


def reader(path: str, content: bytes, languages: str) -> tuple[str, float, float]:
    """Stands in for an OCR program: says how much there is to read, and fails at each 13th size."""
    if len(content) % 13 == 0:
        raise ValueError("unreadable")
    return f" {languages} {len(content)}\n", float(len(content) % 100), float(len(content) % 4 * 90)


SCANS = f"""WITH sc AS (SELECT page_id AS k, CASE WHEN page_id % 11 = 0 THEN 'bad-' || page_id::VARCHAR ELSE {_uuid("page_id::VARCHAR")} END AS id, {_uuid("'d'", "(page_id // 10)::VARCHAR")} AS document_id,
    CASE WHEN page_id % 17 = 0 THEN '' ELSE 'scan/' || page_id::VARCHAR END AS image_file, page_id % 5 = 0 AS done, strlen(html) AS size, page_id % 7 <> 0 AND page_id % 17 <> 0 AS there FROM pages),
  so AS (SELECT *, CASE WHEN document_id < '8' THEN 'eng' ELSE 'nld' END AS languages,
    CASE WHEN k % 11 = 0 THEN 'malformed_id' WHEN done THEN 'already_processed' WHEN NOT there THEN 'missing_file' WHEN size % 13 = 0 THEN 'failed' ELSE 'ok' END AS outcome FROM sc)"""
SCANNED = "CASE WHEN outcome = 'ok' THEN languages || ' ' || size::VARCHAR"


@query(f"""{SCANS} SELECT id AS page_id, outcome, outcome IN ('ok', 'already_processed') AS success,
  CASE outcome WHEN 'ok' THEN 'OCR completed successfully' WHEN 'already_processed' THEN 'OCR already completed' WHEN 'malformed_id' THEN CASE WHEN done THEN 'OCR already completed' END END AS message,
  CASE outcome WHEN 'malformed_id' THEN 'Invalid UUID format: ' || id WHEN 'missing_file' THEN 'No file for page ' || id WHEN 'failed' THEN 'OCR processing failed for page ' || id || ': unreadable' END AS error,
  {SCANNED} WHEN done THEN 'kept' END AS text, CASE WHEN outcome = 'ok' THEN (size % 100)::DOUBLE WHEN done THEN 50.0 END AS confidence, CASE WHEN outcome = 'ok' THEN (size % 4 * 90)::DOUBLE WHEN done THEN 0.0 END AS rotation_applied FROM so""")
def page_results(s: SparkSession, d: str) -> DataFrame:
    documents, rows, contents = scans(s, d)
    return recognition.recognize(rows, documents, contents, reader)


@query(f"""{SCANS} SELECT id, document_id, image_file, done OR outcome = 'ok' AND image_file <> '' AS ocr_completed, {SCANNED} WHEN done THEN 'kept' ELSE '' END AS ocr_text,
  CASE WHEN outcome = 'ok' THEN (size % 100)::DOUBLE WHEN done THEN 50.0 END AS ocr_confidence, CASE WHEN outcome = 'ok' THEN (size % 4 * 90)::DOUBLE ELSE 0.0 END AS rotation_applied FROM so""")
def recognized_pages(s: SparkSession, d: str) -> DataFrame:
    documents, rows, contents = scans(s, d)
    return upload.process(documents, rows, contents, reader)[1].drop("page_number")


@query(f"{SCANS} SELECT document_id AS id, bool_and(done OR outcome = 'ok') AS ocr_completed FROM so GROUP BY 1")
def recognized_documents(s: SparkSession, d: str) -> DataFrame:
    documents, rows, contents = scans(s, d)
    return upload.process(documents, rows, contents, reader)[0].select("id", "ocr_completed")


@query(f"""{SCANS}, re AS (SELECT *, CASE WHEN done AND k % 2 = 0 AND k % 11 <> 0 AND there AND size % 13 <> 0 THEN 'ok' END AS again FROM so)
  SELECT id, CASE WHEN k % 2 = 0 THEN coalesce(again, outcome) = 'ok' ELSE done END AS ocr_completed,
    CASE WHEN k % 2 = 0 AND coalesce(again, outcome) = 'ok' THEN languages || ' ' || size::VARCHAR WHEN k % 2 = 1 AND done THEN 'kept' ELSE '' END AS ocr_text FROM re""")
def reprocessed_pages(s: SparkSession, d: str) -> DataFrame:
    """Every page with an even number on it is read again, done or not."""
    documents, rows, contents = scans(s, d)
    return upload.reprocess(documents, rows, F.col("page_number") % 2 == 1, contents, reader)[1].select("id", "ocr_completed", "ocr_text")


# --- Names and numbers ---


@query(f"WITH {FILES} SELECT pos, name, {_EXT.format(n='name')} AS extension, {_upload_number('name')} AS page_number, lower({_EXT.format(n='name')}) IN ('.pdf', '.jpg', '.jpeg', '.png', '.tiff', '.tif') AS accepted FROM f")
def page_number_from_name(s: SparkSession, d: str) -> DataFrame:
    n = F.col("name")
    return upload_files(s, d).select("pos", "name", text.extension(n).alias("extension"), text.uploaded_page_number(n).alias("page_number"), text.accepted(n, numbering.EXTENSIONS).alias("accepted"))


@query(f"SELECT page_id, list_extract(string_split(url, '/'), -1) AS filename, {_stored_number('url')} AS page_number, {_upload_number('url')} AS uploaded_number, lower(url) LIKE '%.pdf' AS is_pdf FROM pages")
def repair_page_number(s: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(s, d, "pages").select("page_id", text.basename(u).alias("filename"), text.stored_page_number(u).alias("page_number"), text.uploaded_page_number(u).alias("uploaded_number"), text.is_pdf(u).alias("is_pdf"))


@query(f"WITH {FILES} SELECT pos, {_title('name')} AS title FROM f")
def title_from_name(s: SparkSession, d: str) -> DataFrame:
    return upload_files(s, d).select("pos", text.title_from_name(F.col("name")).alias("title"))


@query(f"WITH {FILES} SELECT f.pos, 'Demo: ' || {_stem('name')} || ' - ' || p_brand AS title FROM f JOIN part ON p_partkey = pos WHERE starts_with('Demo: ' || {_stem('name')} || ' - ' || p_brand, 'Demo: small')")
def sample_titles(s: SparkSession, d: str) -> DataFrame:
    """Titles of samples, found again by their beginning."""
    described = upload_files(s, d).join(table(s, d, "part").select("p_partkey", "p_brand"), F.col("pos") == F.col("p_partkey"))
    titled = described.select("pos", text.sample_title(F.concat(F.lit("samples/"), F.col("name")), F.col("p_brand")).alias("title"))
    return titled.where(F.startswith("title", F.lit("Demo: small")))


@query(f"""WITH {FILES}, v AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY pos) AS place FROM f WHERE lower({_EXT.format(n="name")}) IN ('.pdf', '.jpg', '.jpeg', '.png', '.tiff', '.tif')),
  n AS (SELECT *, coalesce({_upload_number("name")}, place) AS page_number, first_value(name) OVER (PARTITION BY batch ORDER BY pos) AS first FROM v)
  SELECT batch, {_title("first")} AS title, page_number::INTEGER AS page_number, (row_number() OVER (PARTITION BY batch ORDER BY page_number, pos))::INTEGER AS page_order, name FROM n""")
def upload_single_document(s: SparkSession, d: str) -> DataFrame:
    return numbering.plan_upload(upload_files(s, d)).drop("document_key")


@query(f"WITH {FILES} SELECT batch, pos AS document_key, {_title('name')} AS title, 1 AS page_number, name FROM f WHERE lower({_EXT.format(n='name')}) IN ('.pdf', '.jpg', '.jpeg', '.png', '.tiff', '.tif')")
def upload_multiple_documents(s: SparkSession, d: str) -> DataFrame:
    return numbering.plan_upload(upload_files(s, d), single_document=False).drop("page_order")


@query("SELECT l_orderkey AS document_id, l_linenumber AS page_number, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(s: SparkSession, d: str) -> DataFrame:
    return numbering.duplicate_keys(line_pages(s, d), "document_id", "page_number")


@query(f"{PLAN} SELECT * FROM p")
def fix_numbers_plan(s: SparkSession, d: str) -> DataFrame:
    return numbering.repair_plan(stored_pages(s, d))


@query(f"{PLAN} SELECT id, CASE WHEN action = 'update' THEN said ELSE page_number END AS page_number FROM p")
def fix_numbers_apply(s: SparkSession, d: str) -> DataFrame:
    return numbering.apply_repair(numbering.repair_plan(stored_pages(s, d))).select("id", "page_number")


@query(f"{PLAN} SELECT count(*) FILTER (WHERE action = 'update') AS updated, count(*) FILTER (WHERE action IN ('no_number', 'conflict')) AS errors, count(*) FILTER (WHERE action = 'same') AS unchanged FROM p")
def fix_numbers_summary(s: SparkSession, d: str) -> DataFrame:
    return numbering.repair_summary(numbering.repair_plan(stored_pages(s, d)))


@query(f"{PLAN} SELECT count(*) FILTER (WHERE action IN ('update', 'conflict')) AS updated, count(*) FILTER (WHERE action = 'no_number') AS errors, count(*) FILTER (WHERE action = 'same') AS unchanged FROM p")
def fix_numbers_dry_run(s: SparkSession, d: str) -> DataFrame:
    return numbering.repair_summary(numbering.repair_plan(stored_pages(s, d)), dry_run=True)


@query(f"{PLAN} SELECT id, document_id, (row_number() OVER (PARTITION BY document_id ORDER BY page_number, id) - 1 + 10000)::INTEGER AS temporary FROM p WHERE action IN ('update', 'conflict')")
def temporary_numbers(s: SparkSession, d: str) -> DataFrame:
    return numbering.temporary_numbers(numbering.repair_plan(stored_pages(s, d)))


@query(f"{PLAN} SELECT document_id, string_agg(page_number::VARCHAR || '>' || said::VARCHAR, ',' ORDER BY page_number, said) AS moves FROM p WHERE action = 'update' GROUP BY 1")
def moves_by_document(s: SparkSession, d: str) -> DataFrame:
    moves = numbering.moves_by_document(numbering.repair_plan(stored_pages(s, d)))
    return moves.select("document_id", F.concat_ws(",", F.transform("moves", lambda m: F.concat_ws(">", m["page_number"].cast("string"), m["said"].cast("string")))).alias("moves"))


@query("SELECT l_orderkey, round(coalesce(avg(l_linenumber - 3) FILTER (WHERE l_linenumber > 3), 0), 6) AS confidence, printf('%.1f', coalesce(avg(l_linenumber - 3) FILTER (WHERE l_linenumber > 3), 0)) AS shown FROM lineitem GROUP BY 1")
def mean_positive(s: SparkSession, d: str) -> DataFrame:
    lists = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_linenumber") - 3).alias("x"))
    mean = text.mean_positive(F.col("x"))
    return lists.select("l_orderkey", F.round(mean, 6).alias("confidence"), text.one_decimal(mean).alias("shown"))


@query("SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN user_id::INTEGER ELSE 0 END AS rotation FROM events")
def rotation_from_report(s: SparkSession, d: str) -> DataFrame:
    told = F.concat(F.lit("Page: 1\nRotate: "), F.col("user_id").cast("string"), F.lit("\nRotate: 7"))
    report = F.when(F.col("event_type") == "view", told).when(F.col("event_type") == "click", F.concat(F.lit("x\n"), told)).when(F.col("event_type") == "error", "Rotate: none").otherwise("Script: Latin")
    return table(s, d, "events").select("event_id", text.rotation(report).alias("rotation"))


@query(r"""SELECT doc_id, regexp_replace(replace(left(text, 100), chr(10), ' '), '^[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+|[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+$', '', 'g') || CASE WHEN length(text) > 100 THEN '...' ELSE '' END AS preview, length(text) AS characters FROM documents""")
def text_preview(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"), F.length("text").cast("long").alias("characters"))


# --- Persons and places ---


@query("SELECT n_nationkey, concat_ws(', ', n_name, nullif(CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE n_name || ' City' END, ''), r_name) AS label FROM nation JOIN region ON r_regionkey = n_regionkey")
def place_label(s: SparkSession, d: str) -> DataFrame:
    town = F.when(F.col("n_nationkey") % 2 == 0, "").otherwise(F.concat("n_name", F.lit(" City")))
    places = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return places.select("n_nationkey", text.place_label(F.col("n_name"), town, F.col("r_name")).alias("label"))


@query(f"WITH {NAMES} SELECT person_id, person_name FROM nm")
def person_full_name(s: SparkSession, d: str) -> DataFrame:
    return kin.person_names(persons(s, d)).select("person_id", "person_name")


@query(f"WITH {PARTNERSHIPS} SELECT id, label FROM pl")
def partnership_label(s: SparkSession, d: str) -> DataFrame:
    own, bridge = partnerships(s, d)
    return kin.partnership_labels(own, bridge, persons(s, d), KINDS)


@query(f"""WITH {PARTNERSHIPS} SELECT e.event_id AS id, CASE event_type WHEN 'view' THEN 'Birth' WHEN 'click' THEN 'Baptism' WHEN 'purchase' THEN 'Marriage' WHEN 'signup' THEN 'Death' ELSE event_type END || ': ' ||
  coalesce(CASE WHEN event_type IN ('view', 'click', 'signup') THEN person_name END, CASE WHEN event_type = 'purchase' THEN pl.label END, 'None') AS label
  FROM events e LEFT JOIN nm ON person_id = user_id LEFT JOIN pl ON pl.id = user_id""")
def event_label(s: SparkSession, d: str) -> DataFrame:
    own, bridge = partnerships(s, d)
    who = F.when(F.col("event_type").isin("view", "click", "signup"), F.col("user_id"))
    events = table(s, d, "events").select(F.col("event_id").alias("id"), "event_type", who.alias("person_id"), F.when(F.col("event_type") == "purchase", F.col("user_id")).alias("partnership_id"))
    everyone = persons(s, d)
    return kin.event_labels(events, everyone, kin.partnership_labels(own, bridge, everyone, KINDS), EVENTS)


@query(f"""WITH {NAMES} SELECT c.person_id AS child_id, p.person_id AS parent_id, c.person_name || ' - ' || CASE WHEN c.person_id % 2 = 0 THEN 'biological' ELSE 'adopted' END || ' child of ' || p.person_name AS label
  FROM nm c JOIN nm p ON p.person_id = c.person_id // 2 WHERE c.person_id > 0""")
def parent_child_label(s: SparkSession, d: str) -> DataFrame:
    links = kinship(s, d).withColumn("relationship_type", F.when(F.col("child_id") % 2 == 0, "bio").otherwise("adopted"))
    return kin.kinship_labels(links, persons(s, d), {"bio": "Biological", "adopted": "Adopted"})


def kinship(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").where("c_custkey > 0").select(F.col("c_custkey").alias("child_id"), F.floor(F.col("c_custkey") / 2).alias("parent_id"))


@query("""WITH RECURSIVE up(id, ancestor, generations) AS (SELECT c_custkey, c_custkey, 0 FROM customer UNION ALL SELECT id, ancestor // 2, generations + 1 FROM up WHERE ancestor > 0)
  SELECT id, ancestor, min(generations)::INTEGER AS generations FROM up WHERE generations > 0 GROUP BY 1, 2""")
def ancestors(s: SparkSession, d: str) -> DataFrame:
    return kin.ancestors(kinship(s, d), table(s, d, "customer").select(F.col("c_custkey").alias("id")))


@query("SELECT conv_id, turn, 'Conversation ' || conv_id::VARCHAR || ' - Page ' || turn::VARCHAR AS label FROM conversations")
def page_label(s: SparkSession, d: str) -> DataFrame:
    docs = talk_documents(s, d).select("id", F.concat(F.lit("Conversation "), F.col("id").cast("string")).alias("title"))
    joined = talk_pages(s, d).join(docs, F.col("document_id") == F.col("id"))
    return joined.select(F.col("id").alias("conv_id"), F.col("page_number").alias("turn"), text.page_label(F.col("title"), F.col("page_number")).alias("label"))


@query("SELECT DISTINCT c_custkey AS id, o_orderkey AS document_id, o_orderpriority AS title FROM customer JOIN orders ON o_custkey = c_custkey")
def source_documents(s: SparkSession, d: str) -> DataFrame:
    orders = table(s, d, "orders")
    bridge = orders.select(F.col("o_custkey").alias("left_id"), F.col("o_orderkey").alias("right_id"))
    return kin.sources_of(persons(s, d), bridge, orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title")))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN b.n_name || ', ' || br.r_name END AS birth_place, CASE WHEN c_custkey % 4 = 0 THEN t.n_name || ', ' || tr.r_name END AS death_place
  FROM customer LEFT JOIN nation b ON b.n_nationkey = c_nationkey LEFT JOIN region br ON br.r_regionkey = b.n_regionkey
  LEFT JOIN nation t ON t.n_nationkey = (c_nationkey + 1) % 30 LEFT JOIN region tr ON tr.r_regionkey = t.n_regionkey""")
def person_places(s: SparkSession, d: str) -> DataFrame:
    """Persons with where they were born and died, where that is known; a few of these places don't exist."""
    places = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    places = places.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("").alias("locality"), F.lit("").alias("region"), F.col("r_name").alias("country"))
    k = F.col("c_custkey")
    people = table(s, d, "customer").select("c_custkey", F.when(k % 3 > 0, F.col("c_nationkey")).alias("birth_place_id"), F.when(k % 4 == 0, (F.col("c_nationkey") + 1) % 30).alias("death_place_id"))
    return kin.with_places(people, places, {"birth_place_id": "birth_place", "death_place_id": "death_place"}).select("c_custkey", "birth_place", "death_place")


# --- Lists ---


@query("SELECT c_custkey, c_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE (lower(c_name) LIKE '%11%' OR lower(c_mktsegment) LIKE '%11%' OR lower(n_name) LIKE '%11%') AND (lower(c_name) LIKE '%auto%' OR lower(c_mktsegment) LIKE '%auto%' OR lower(n_name) LIKE '%auto%')")
def search_people(s: SparkSession, d: str) -> DataFrame:
    people = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return listing.search(people, "11 Auto", ["c_name", "c_mktsegment", "n_name"]).select("c_custkey", "c_name")


@query("SELECT DISTINCT r_name FROM region")
def facet_values(s: SparkSession, d: str) -> DataFrame:
    return listing.facet_values(table(s, d, "region"), "r_name")


@query("SELECT event_id FROM events WHERE event_type = 'click' AND ts::DATE > DATE '2024-01-15' - 7 AND ts::DATE <= DATE '2024-01-15'")
def facet_filter(s: SparkSession, d: str) -> DataFrame:
    return listing.optional_filter(table(s, d, "events"), "event_type", "click").where(listing.date_facet(F.col("ts"), "2024-01-15", "week")).select("event_id")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND starts_with(o_orderpriority, '1')")
def selected_rows(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & F.startswith("o_orderpriority", F.lit("1"))).select("o_orderkey", "o_totalprice")


@query("SELECT event_id, row_number() OVER (ORDER BY CASE WHEN event_type = 'view' THEN ts END NULLS LAST, event_type, event_id) AS place FROM events QUALIFY place > 100 AND place <= 200")
def event_list_page(s: SparkSession, d: str) -> DataFrame:
    """The second page of the list, in default order: undated events come last."""
    events = table(s, d, "events").withColumn("date", F.when(F.col("event_type") == "view", F.col("ts")))
    page = listing.page_of(events, ["date", "event_type", "event_id"], 2)
    from pyspark.sql import Window

    return page.select("event_id", (F.row_number().over(Window.orderBy(F.col("date").asc_nulls_last(), "event_type", "event_id")) + 100).cast("long").alias("place"))


@query("SELECT event_type, arg_max(event_id, ts) AS event_id, max(ts) AS ts FROM events GROUP BY 1")
def latest_per_type(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").groupBy("event_type").agg(F.max_by("event_id", "ts").alias("event_id"), F.max("ts").alias("ts"))


@query("SELECT o_orderkey, l_linenumber, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey ORDER BY 1, 2")
def pages_of_documents(s: SparkSession, d: str) -> DataFrame:
    joined = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return listing.default_order(joined, "o_orderkey", "l_linenumber").select("o_orderkey", "l_linenumber", "l_partkey")


# --- Changes ---


@query("SELECT l_orderkey AS document_id, l_linenumber AS page_number, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE starts_with(o_orderpriority, '1'))")
def cascade_delete_keep(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority")
    return snapshots.delete_cascading(docs, F.startswith("o_orderpriority", F.lit("1")), line_pages(s, d), "document_id")[1].select("document_id", "page_number", "l_partkey")


@query("SELECT count(*) AS deleted FROM orders WHERE starts_with(o_orderpriority, '1')")
def cascade_delete_count(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority")
    return snapshots.delete_cascading(docs, F.startswith("o_orderpriority", F.lit("1")), line_pages(s, d), "document_id")[2]


TREE = """WITH gone AS (SELECT c_custkey FROM customer WHERE c_nationkey % 5 = 0), go AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM gone)),
  gl AS (SELECT l_orderkey, l_linenumber, l_partkey, l_orderkey IN (FROM go) OR l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_suppkey IN (FROM gone)) AS gone FROM lineitem)"""


def tree(s: SparkSession, d: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Customers with their orders and suppliers of the same key, and the line items of both."""
    tables = {
        "customer": table(s, d, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey"), "orders": table(s, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey"),
        "supplier": table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("of")), "lineitem": table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
    }
    references = [("orders", "o_custkey", "customer"), ("supplier", "of", "customer"), ("lineitem", "l_orderkey", "orders"), ("lineitem", "l_suppkey", "supplier")]
    return snapshots.delete_tree(tables, "customer", F.col("c_nationkey") % 5 == 0, references)


@query(f"{TREE} SELECT l_orderkey, l_linenumber, l_partkey FROM gl WHERE NOT gone")
def tree_delete_keep(s: SparkSession, d: str) -> DataFrame:
    return tree(s, d)[0]["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey")


@query(f"{TREE} SELECT o_orderkey AS id FROM go")
def tree_delete_gone(s: SparkSession, d: str) -> DataFrame:
    return tree(s, d)[1]["orders"]


@query("""WITH n AS (SELECT l_suppkey AS document_id, l_linenumber AS page_number, count(*) AS new FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),
  t AS (SELECT l_orderkey AS document_id, l_linenumber AS page_number, count(*) AS there FROM lineitem GROUP BY 1, 2)
  SELECT document_id, page_number, coalesce(there, 0) AS there, new FROM n LEFT JOIN t USING (document_id, page_number) WHERE new > 1 OR there > 0""")
def refused_keys(s: SparkSession, d: str) -> DataFrame:
    """New pages whose numbers their documents have already, or that they would share."""
    new = table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("document_id"), F.col("l_linenumber").alias("page_number"))
    return numbering.conflicts(line_pages(s, d), new, "document_id", "page_number")


@query("SELECT c_custkey, CASE WHEN c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey > 1) THEN c_nationkey END AS c_nationkey FROM customer")
def set_null(s: SparkSession, d: str) -> DataFrame:
    left = table(s, d, "nation").where("n_regionkey > 1").select(F.col("n_nationkey").alias("id"))
    return snapshots.set_null(table(s, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", left)


@query("SELECT conv_id AS document_id, turn AS page_number, CASE WHEN turn > 2 THEN '' ELSE text END AS ocr_text, CASE WHEN turn > 2 THEN FALSE ELSE role = 'assistant' END AS ocr_completed, CASE WHEN turn > 2 THEN NULL ELSE 90.0::DOUBLE END AS ocr_confidence, CASE WHEN turn > 2 THEN 0.0::DOUBLE ELSE 1.5::DOUBLE END AS rotation_applied FROM conversations")
def reset_pages(s: SparkSession, d: str) -> DataFrame:
    done = talk_pages(s, d).withColumns({"ocr_confidence": F.lit(90.0), "rotation_applied": F.lit(1.5)})
    return snapshots.reset_pages(done, F.col("page_number") > 2)


@query("SELECT p_partkey, p_name, CASE WHEN s_suppkey IS NOT NULL THEN s_acctbal ELSE p_retailprice END AS p_retailprice FROM part LEFT JOIN supplier ON s_suppkey = p_partkey")
def patch_columns(s: SparkSession, d: str) -> DataFrame:
    changes = table(s, d, "supplier").select(F.col("s_suppkey").alias("p_partkey"), F.col("s_acctbal").alias("p_retailprice"))
    return snapshots.patch(table(s, d, "part").select("p_partkey", "p_name", "p_retailprice"), changes, "p_partkey", ["p_retailprice"])


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'eng' WHEN 'nl' THEN 'nld' ELSE lang END AS languages, NULL::VARCHAR AS file FROM documents")
def migrate_language_codes(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").withColumnRenamed("lang", "languages")
    moved = snapshots.migrate(snapshots.recoded(docs, "languages", OLD_LANGUAGES), drop=("text", "source", "n_chars"), add={"file": F.lit(None).cast("string")})
    return moved.select("doc_id", "languages", "file")


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation")
def insert_rows(s: SparkSession, d: str) -> DataFrame:
    return snapshots.insert(table(s, d, "region"), table(s, d, "nation").select(F.col("n_nationkey").alias("r_regionkey"), F.col("n_name").alias("r_name")))
