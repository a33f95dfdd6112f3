"""Operators on small tables of the shapes they are made for."""

import uuid

import pytest
from pyspark.sql import functions as F

from folio.operators import kin, listing, numbering, pages, recognition, snapshots, upload
from folio.operators.engine import PageEngine
from folio.schemas import DOCUMENT, PAGE
from folio.sources import files
from folio.streaming import queue

A, B, C = (str(uuid.UUID(int=i)) for i in (1, 2, 3))
P = [str(uuid.UUID(int=10 + i)) for i in range(6)]


def some_pages(spark, rows):
    """rows: (id, document, number, file, done, text)."""
    full = [(i, d, n, f, done, t, 95.0 if done else None, 0.0, f.rsplit("/", 1)[-1], None, None) for i, d, n, f, done, t in rows]
    df = spark.createDataFrame(full, "id string, document_id string, page_number int, image_file string, ocr_completed boolean, ocr_text string, ocr_confidence double, rotation_applied double, original_filename string, created_at timestamp, updated_at timestamp")
    return df.withColumns({"created_at": F.lit("2024-01-01").cast("timestamp"), "updated_at": F.lit("2024-01-01").cast("timestamp")})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(A, "A", "eng", False, False), (B, "B", "eng+nld", True, False), (C, "C", "nld", False, False)], "id string, title string, languages string, ocr_completed boolean, extraction_completed boolean")


@pytest.fixture(scope="module")
def page_rows(spark):
    return some_pages(spark, [(P[0], A, 2, "f/2.pdf", True, "two"), (P[1], A, 1, "f/1.pdf", True, "one"), (P[2], A, 3, "f/3.pdf", True, "  \n"), (P[3], A, 4, "f/4.pdf", False, "four"), (P[4], B, 1, "", False, ""), (P[5], B, 2, "f/5.pdf", True, "x")])


def test_combined_text(docs, page_rows):
    got = {r.id: r.combined_text for r in pages.combined_text(docs, page_rows).collect()}
    assert got == {A: "=== Page 1 ===\none\n\n=== Page 2 ===\ntwo", B: "=== Page 2 ===\nx", C: ""}


def test_status(docs, page_rows):
    got = {r.id: r for r in pages.status(docs, page_rows).collect()}
    assert got[A].percentage == 75 and got[A].can_process and not got[A].stored_completed
    assert got[B].stored_completed and not got[B].derived_completed and not got[B].can_process and got[B].can_extract  # set once, never cleared
    assert got[C].percentage is None and not got[C].can_process and not got[C].derived_completed
    assert [r.progress for r in pages.progress(docs, page_rows).where(F.col("id") == C).collect()] == [None]


def test_bulk(docs, page_rows):
    assert tuple(pages.bulk_process(page_rows).first()) == (1, 4, 1)
    assert {r.id: r.task_id for r in pages.bulk_extract(docs).collect()} == {A: None, B: f"extraction-task-{B}", C: None}
    assert {r.id: r.pages_processed for r in pages.fan_out(docs, page_rows).collect()} == {A: 1, B: 1, C: 0}


def test_upload(spark):
    f = spark.createDataFrame([(0, 1, "document_003.pdf"), (0, 2, "document_001.pdf"), (0, 3, "notes.txt"), (0, 4, "cover.pdf"), (0, 5, "document_002.PDF")], "batch long, pos long, name string")
    got = numbering.plan_upload(f).orderBy("page_order").collect()
    assert [(r.page_number, r.name) for r in got] == [(1, "document_001.pdf"), (2, "document_002.PDF"), (3, "document_003.pdf"), (3, "cover.pdf")] and {r.title for r in got} == {"Document 003"}
    assert numbering.duplicate_keys(numbering.plan_upload(f), "batch", "page_number").count() == 1
    assert numbering.plan_upload(f, single_document=False).select("title").distinct().count() == 4


def test_repair(spark):
    rows = [(P[0], A, 5, "001_a.pdf", True, ""), (P[1], A, 2, "x.pdf", True, ""), (P[2], A, 3, "003_b.pdf", True, ""), (P[3], B, 1, "002_a.pdf", True, ""), (P[4], B, 2, "y.pdf", True, "")]
    plan = numbering.repair_plan(some_pages(spark, rows))
    got = {r.id: (r.said, r.action) for r in plan.collect()}
    assert got == {P[0]: (1, "update"), P[1]: (None, "no_number"), P[2]: (3, "same"), P[3]: (2, "conflict"), P[4]: (None, "no_number")}
    assert tuple(numbering.repair_summary(plan).first()) == (1, 3, 1) and tuple(numbering.repair_summary(plan, dry_run=True).first()) == (2, 2, 1)
    assert {r.id: r.page_number for r in numbering.apply_repair(plan).collect()} == {P[0]: 1, P[1]: 2, P[2]: 3, P[3]: 1, P[4]: 2}
    too_large = numbering.repair_plan(some_pages(spark, [(P[0], A, 5, "001_a.pdf", True, ""), (P[1], A, 6, "99999999999_b.pdf", True, "")]))
    assert {r.action for r in too_large.collect()} == {"conflict", "no_number"}
    swap = numbering.repair_plan(some_pages(spark, [(P[0], A, 1, "002_a.pdf", True, ""), (P[1], A, 2, "001_b.pdf", True, "")]))
    assert {r.action for r in swap.collect()} == {"update"}


def test_repair_sorts_once(spark):
    """Windows of a document and of its numbers share one sort, so a task holds its pages once."""
    d = "id int, document_id int, page_number int, original_filename string"
    rows = [(1, 1, 5, "001_a.pdf"), (2, 1, 10000, "x.pdf"), (3, 2, 5, "001_a.pdf"), (4, 2, 10001, "x.pdf"), (5, 3, 5, "001_a.pdf"), (6, 3, 6, "002_b.pdf"), (7, 3, 10001, "x.pdf"), (8, 4, 5, "10000_a.pdf")]
    rows += [(9, 5, None, "001_a.pdf"), (10, 5, 2, None), (11, 5, 3, "004_a.pdf"), (12, 5, None, None), (13, None, 7, "008_a.pdf"), (14, 6, 1, None), (15, 6, 2, "001_a.pdf"), (16, 7, 10000, "x.pdf"), (17, 7, 3, "003_a.pdf")]
    plan = numbering.repair_plan(spark.createDataFrame(rows, d))
    update = {3, 11, 13}
    conflict = {1, 5, 6, 8, 15}
    same = {9, 17}
    assert {r.id: r.action for r in plan.collect()} == {i: "update" if i in update else "conflict" if i in conflict else "same" if i in same else "no_number" for i in range(1, 18)}
    listed = numbering.moves_by_document(plan)
    assert sorted((r.document_id or 0, [tuple(m) for m in r.moves]) for r in listed.collect()) == [(0, [(7, 8)]), (2, [(5, 1)]), (5, [(3, 4)])]
    for df in (plan, listed):
        physical = df._jdf.queryExecution().executedPlan().initialPlan().toString()
        assert physical.count("- Sort [") == 1 and physical.count("- Window [") == 2


def test_kin(spark):
    people = spark.createDataFrame([(1, "Anna", "Jansen", "de Vries"), (2, "Jan", "Bakker", ""), (3, "Piet", "Bakker", "")], "id long, given_names string, surname string, maiden_name string")
    own = spark.createDataFrame([(7, "m"), (8, "m")], "id long, partnership_type string")
    bridge = spark.createDataFrame([(7, 1), (7, 2)], "left_id long, right_id long")
    names = kin.partnership_labels(own, bridge, people, {"m": "Marriage"})
    assert {r.id: r.label for r in names.collect()} == {7: "Jan Bakker & Anna (de Vries) Jansen (Marriage)", 8: " (Marriage)"}
    events = spark.createDataFrame([(1, "b", 1, 7), (2, "m", None, 7), (3, "b", None, None)], "id long, event_type string, person_id long, partnership_id long")
    assert {r.id: r.label for r in kin.event_labels(events, people, names, {"b": "Birth", "m": "Wedding"}).collect()} == {1: "Birth: Anna (de Vries) Jansen", 2: "Wedding: Jan Bakker & Anna (de Vries) Jansen (Marriage)", 3: "Birth: None"}
    links = spark.createDataFrame([(3, 2), (2, 1), (3, 1)], "child_id long, parent_id long")
    got = {(r.id, r.ancestor, r.generations) for r in kin.ancestors(links, spark.createDataFrame([(3,)], "id long")).collect()}
    assert got == {(3, 2, 1), (3, 1, 1)}


def test_ancestors_without_bounds(spark):
    """Two parents in every generation for 40 of them, a cycle, a chain of hundreds, and ids that lead nowhere."""
    both = [(10 * g + c, 10 * (g + 1) + p) for g in range(40) for c in (0, 1) for p in (0, 1)]
    cycle = [(1001, 1002), (1002, 1003), (1003, 1001), (1003, 1003)]
    chain = [(i, i + 1) for i in range(2000, 2030)]
    links = spark.createDataFrame(both + cycle + chain + [(5, None), (None, 6), both[0]], "child_id long, parent_id long")
    starts = spark.createDataFrame([(0,), (1001,), (2000,), (5,), (None,), (0,)], "id long")
    got = [tuple(r) for r in kin.ancestors(links, starts).collect()]
    want = {(0, 10 * g + p, g) for g in range(1, 41) for p in (0, 1)} | {(1001, 1002, 1), (1001, 1003, 2), (1001, 1001, 3)} | {(2000, 2000 + i, i) for i in range(1, 31)}
    assert len(got) == len(want) and set(got) == want
    assert kin.ancestors(links.limit(0), starts).collect() == [] and kin.ancestors(links, starts.limit(0)).collect() == []


def test_ancestors_of_very_many(spark):
    """More pairs than Spark's own recursion may give rows."""
    people = spark.range(1, 80_001)
    links = people.select(F.col("id").alias("child_id"), F.floor(F.col("id") / 2).alias("parent_id"))
    got = kin.ancestors(links, people)
    assert got.count() == sum(int(i).bit_length() for i in range(1, 80_001)) > 1_000_000
    assert got.agg(F.max("generations")).first()[0] == 17


def test_places(spark):
    places = spark.createDataFrame([(1, "Dom", "Utrecht", "", "NL"), (2, "Kerk", "", "Zeeland", "NL")], "id long, name string, locality string, region string, country string")
    people = spark.createDataFrame([("a", 1, 2), ("b", None, 9), ("c", 2, None)], "id string, birth_place_id long, death_place_id long")
    got = kin.with_places(people, places, {"birth_place_id": "born", "death_place_id": "died"})
    assert got.columns == ["id", "birth_place_id", "death_place_id", "born", "died"]
    assert sorted((r.id, r.born, r.died) for r in got.collect()) == [("a", "Dom, Utrecht, NL", "Kerk, Zeeland, NL"), ("b", None, None), ("c", "Kerk, Zeeland, NL", None)]


def reader(path, content, languages):
    if b"bad" in content:
        raise ValueError("unreadable")
    return f"{languages} {content.decode()}", 80.0, 0.0


def test_upload_to_status(spark):
    """Files become documents and pages with ids and defaults; recognition reads what it can; a document is complete when all of its pages are."""
    files_df = spark.createDataFrame([(0, 1, "letter_002.pdf"), (0, 2, "letter_001.pdf"), (0, 3, "notes.txt"), (1, 4, "bad.png"), (1, 5, "good.png"), (2, 6, "x.doc")], "batch long, pos long, name string")
    documents, rows = upload.upload(files_df, languages="eng", salt="s")
    assert documents.columns == DOCUMENT.fieldNames() and rows.columns == PAGE.fieldNames() and [f.dataType for f in rows.schema] == [f.dataType for f in PAGE]
    d = {r.title: r for r in documents.collect()}
    assert set(d) == {"Letter 002", "Bad"} and all((r.languages, r.ocr_completed, r.extraction_completed) == ("eng", False, False) and r.upload_date for r in d.values())
    p = {r.original_filename: r for r in rows.collect()}
    assert {n: (r.page_number, r.ocr_text, r.ocr_confidence, r.rotation_applied, r.ocr_completed) for n, r in p.items()} == {"letter_001.pdf": (1, "", None, 0.0, False), "letter_002.pdf": (2, "", None, 0.0, False), "bad.png": (1, "", None, 0.0, False), "good.png": (2, "", None, 0.0, False)}
    assert {r.document_id for r in p.values()} == {r.id for r in d.values()} and all(uuid.UUID(r.id) for r in [*d.values(), *p.values()]) and len({r.id for r in p.values()}) == 4
    other = upload.upload(files_df)[0].collect()
    assert len(other) == 2 and not {r.id for r in other} & {r.id for r in d.values()}
    contents = spark.createDataFrame([(f"document_pages/{n}", bytearray(n.encode())) for n in p], "path string, content binary")
    after, done, results = upload.process(documents, rows, contents, reader)
    assert {r.title: r.ocr_completed for r in after.collect()} == {"Letter 002": True, "Bad": False}
    assert {r.original_filename: r.ocr_text for r in done.collect()} == {"letter_001.pdf": "eng letter_001.pdf", "letter_002.pdf": "eng letter_002.pdf", "bad.png": "", "good.png": "eng good.png"}
    assert sorted(r.outcome for r in results.collect()) == ["failed", "ok", "ok", "ok"]
    assert upload.process(after, done, contents, reader)[2].count() == 1  # what is done isn't read again
    again, redone, results = upload.reprocess(after, done, F.col("page_number") == 2, contents, lambda *a: ("new", 10.0, 90.0))
    assert {r.original_filename: (r.ocr_text, r.rotation_applied) for r in redone.collect()}["letter_002.pdf"] == ("new", 90.0) and results.count() == 2
    assert {r.title: r.ocr_completed for r in again.collect()} == {"Letter 002": True, "Bad": False}


def test_upload_modes(spark):
    files_df = spark.createDataFrame([(0, 1, "a_b.pdf"), (0, 2, "c.JPG")], "batch long, pos long, name string")
    documents, rows = upload.upload(files_df, single_document=False)
    assert sorted(r.title for r in documents.collect()) == ["A B", "C"] and {r.page_number for r in rows.collect()} == {1} and rows.select("document_id").distinct().count() == 2
    assert [r.title for r in upload.upload(files_df, title="Own")[0].collect()] == ["Own"]
    none, empty = upload.upload(files_df.limit(0))
    assert none.collect() == [] and empty.collect() == []


def test_samples(spark, docs, page_rows):
    docs = docs.withColumn("upload_date", F.lit("2024-01-01").cast("timestamp")).select(DOCUMENT.fieldNames())
    found = spark.createDataFrame([("x/025.pdf", bytearray(b"one")), ("x/032.pdf", bytearray(b"bad"))], "path string, content binary")
    once = upload.samples(docs, page_rows, found, reader, "nld", "s")
    twice = upload.samples(*once[:2], found, reader, "nld", "t")
    for documents, rows, results in (once, twice):
        titles = {r.title: r for r in documents.collect()}
        assert set(titles) == {"A", "B", "C", "Demo: 025 - nld", "Demo: 032 - nld"} and titles["Demo: 025 - nld"].ocr_completed and not titles["Demo: 032 - nld"].ocr_completed
        assert rows.count() == page_rows.count() + 2 and "nld one" in {r.ocr_text for r in rows.collect()} and results.count() == 2


class Program:
    """An OCR program that notes what it is asked for; an image is its history."""

    def __init__(self, broken=(), report="Page: 0\nRotate: 90\nRotate: 5", images=1, confidences=("71", "0", "-1", "84")):
        self.broken, self.report, self.images, self.found, self.asked = broken, report, images, confidences, []

    def _(self, name, *args):
        self.asked.append((name, *args))
        if name in self.broken:
            raise OSError(name)

    def image(self, content):
        self._("image")
        return [content]

    def pdf_images(self, content, first, last):
        self._("pdf_images", first, last)
        return [[content]] * self.images

    def grey(self, image):
        return [*image, "grey"]

    def orientation(self, image, config):
        self._("orientation", config)
        return self.report

    def turned(self, image, degrees):
        return [*image, degrees]

    def enhanced(self, image, contrast, sharpness):
        self._("enhanced", contrast, sharpness)
        return [*image, "enhanced"]

    def text(self, image, languages, config):
        self._("text", languages, config)
        return f"  {image} "

    def confidences(self, image, languages, config):
        self._("confidences", languages, config)
        return self.found


def test_engine():
    p = Program()
    assert PageEngine(p)("a/X.PDF", b"c", "eng+nld") == ("[b'c', 'grey', -90.0, 'enhanced']", 77.5, 90.0)
    assert p.asked == [("pdf_images", 1, 1), ("orientation", "--psm 0"), ("enhanced", 1.2, 1.1), ("text", "eng+nld", "--oem 3 --psm 3"), ("confidences", "eng+nld", "--oem 3 --psm 3")]
    p = Program(broken=("orientation", "enhanced", "confidences"))
    assert PageEngine(p, "--psm 6")("a.pdf.png", b"c", "eng") == ("[b'c', 'grey']", 0.0, 0.0) and p.asked[0] == ("image",) and p.asked[-1][-1] == "--psm 6"
    assert PageEngine(Program(report="Rotate: none", confidences=("x",)))("a.tif", b"c", "eng")[1:] == (0.0, 0.0)
    assert PageEngine(Program(report="", confidences=()))("a.tif", b"c", "eng")[1:] == (0.0, 0.0)
    with pytest.raises(ValueError, match="from PDF"):
        PageEngine(Program(images=0))("a.pdf", b"c", "eng")
    for broken in ("text", "image"):
        with pytest.raises(OSError, match=broken):
            PageEngine(Program(broken=(broken,)))("a.png", b"c", "eng")


def test_engine_as_a_page_function(spark, docs):
    rows = some_pages(spark, [(P[0], A, 1, "a.pdf", False, ""), (P[1], A, 2, "b.png", False, "")])
    contents = spark.createDataFrame([("a.pdf", bytearray(b"x")), ("b.png", bytearray(b"y"))], "path string, content binary")
    got = {r.page_id: r for r in recognition.recognize(rows, docs, contents, PageEngine(Program(images=0))).collect()}
    assert got[P[0]].outcome == "failed" and "Could not extract image from PDF" in got[P[0]].error and (got[P[1]].outcome, got[P[1]].confidence) == ("ok", 77.5)


def test_unique_keys(spark, docs, page_rows, tmp_path):
    new = some_pages(spark, [("n1", A, 9, "f", False, ""), ("n2", B, 9, "f", False, "")])
    key = ("document_id", "page_number")
    assert snapshots.insert(page_rows, new, key).count() == page_rows.count() + 2
    with pytest.raises(ValueError, match="must be unique"):
        snapshots.insert(page_rows, new.unionByName(new), key)
    with pytest.raises(ValueError, match=A):
        snapshots.insert(page_rows, some_pages(spark, [("n1", A, 1, "f", False, "")]), key)
    path = str(tmp_path / "pages")
    files.append(new, path, key)
    with pytest.raises(ValueError, match="must be unique"):
        files.append(new, path, key)
    files.append(some_pages(spark, [("n3", C, 9, "f", False, "")]), path, key)
    assert spark.read.parquet(path).count() == 3
    files.append(new, path)
    assert spark.read.parquet(path).count() == 5
    twice = spark.createDataFrame([(A, "x"), (A, "y")], "id string, title string")
    with pytest.raises(Exception, match="must be unique"):
        snapshots.patch(docs, twice, "id", ["title"]).collect()


def test_delete_tree(spark):
    t = {
        "person": spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "id long, name string"),
        "event": spark.createDataFrame([(10, 1), (11, 2), (12, None)], "id long, person_id long"),
        "link": spark.createDataFrame([(20, 1, 2), (21, 2, 3), (22, 2, 4), (23, 1, 3)], "id long, child_id long, parent_id long"),
        "link_source": spark.createDataFrame([(20, "d"), (22, "d"), (23, "e")], "left_id long, right_id string"),
    }
    left, gone = snapshots.delete_tree(t, "person", F.col("name") == "x", [("event", "person_id", "person"), ("link", "child_id", "person"), ("link", "parent_id", "person"), ("link_source", "left_id", "link")])
    assert {n: sorted(r[0] for r in df.collect()) for n, df in left.items()} == {"person": [2], "event": [11, 12], "link": [22], "link_source": [22]}
    assert {n: sorted(r.id for r in df.collect()) for n, df in gone.items()} == {"person": [1, 3], "event": [10], "link": [20, 21, 23]}
    same, none = snapshots.delete_tree(t, "person", F.col("name") == "z", [("event", "person_id", "person")])
    assert same["event"].count() == 3 and none["event"].count() == 0


def test_lists(spark):
    t = spark.createDataFrame([(1, None, "Élan"), (2, "2024-01-15", "de Vries"), (3, "2024-01-08", "Zee"), (4, "2023-12-31", None)], "id int, d string, n string")
    assert [r.id for r in listing.default_order(t, "d", "id").collect()] == [4, 3, 2, 1]
    assert [r.id for r in listing.search(t, "VRIES de", ["n", "d"]).collect()] == [2] and listing.search(t, "", ["n"]).count() == 4
    found = {b: {r.id for r in t.where(listing.date_facet(F.col("d"), "2024-01-15", b)).collect()} for b in ("any", "today", "week", "month", "year")}
    assert found == {"any": {1, 2, 3, 4}, "today": {2}, "week": {2}, "month": {2, 3}, "year": {2, 3}}
    assert [r.id for r in listing.page_of(t, ["id"], 2, 3).collect()] == [4] and listing.optional_filter(t, "id", None).count() == 4


def test_snapshots(spark, docs, page_rows):
    stay, left, count = snapshots.delete_cascading(docs, F.col("title").startswith("A"), page_rows, "document_id")
    assert {r.id for r in stay.collect()} == {B, C} and {r.document_id for r in left.collect()} == {B} and count.first().deleted == 1
    reset = {r.id: r for r in snapshots.reset_pages(page_rows, F.col("page_number") == 2).collect()}
    assert (reset[P[0]].ocr_completed, reset[P[0]].ocr_text, reset[P[0]].ocr_confidence, reset[P[0]].rotation_applied) == (False, "", None, 0.0) and reset[P[1]].ocr_text == "one"
    changes = spark.createDataFrame([(A, None)], "id string, title string")
    assert {r.id: r.title for r in snapshots.patch(docs, changes, "id", ["title"]).collect()} == {A: None, B: "B", C: "C"}
    assert [r.document_id for r in snapshots.set_null(page_rows, "document_id", docs.where("title = 'B'")).orderBy("id").collect()] == [None] * 4 + [B] * 2


def test_recognition(spark, docs):
    def engine(path, content, language):
        if b"bad" in content:
            raise ValueError("unreadable")
        return f" {language}:{content.decode()} ", 85.5, 90.0

    rows = [(P[0], A, 1, "a", False, ""), (P[1], A, 2, "b", False, ""), (P[2], B, 1, "c", True, "kept"), (P[3], B, 2, "gone", False, ""), ("odd", C, 1, "a", False, "")]
    page_df = some_pages(spark, rows)
    contents = spark.createDataFrame([("a", bytearray(b"text")), ("b", bytearray(b"bad")), ("c", bytearray(b"c"))], "path string, content binary")
    results = recognition.recognize(page_df, docs, contents, engine, tasks=2)
    got = {r.page_id: r for r in results.collect()}
    assert {k: r.outcome for k, r in got.items()} == {P[0]: "ok", P[1]: "failed", P[2]: "already_processed", P[3]: "missing_file", "odd": "malformed_id"}
    assert got[P[0]].text == "eng:text" and "unreadable" in got[P[1]].error and got[P[2]].text == "kept"
    stored = {r.id: r for r in recognition.store(page_df, results).collect()}
    assert stored[P[0]].ocr_completed and stored[P[0]].ocr_confidence == 85.5 and not stored[P[1]].ocr_completed


def test_files(spark, tmp_path):
    for n in ("a_001.pdf", "b.JPG", "c.txt"):
        (tmp_path / n).write_bytes(n.encode())
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.page_files(spark, str(tmp_path)).collect()) == ["a_001.pdf", "b.JPG"]
    assert files.sample_files(spark, str(tmp_path), ["b.JPG", "gone.pdf"]).count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.sample_files(spark, str(tmp_path / "gone"), ["b.JPG"]).count()


def test_queue(spark, page_rows, tmp_path):
    page_rows.write.mode("append").parquet(str(tmp_path / "in"))
    stream = queue.pending_pages(spark, str(tmp_path / "in"))
    q = queue.drain(stream, lambda df: df.select("id"), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(60)
    q.stop()
    assert [r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [P[3]]


def test_schemas():
    assert PAGE["ocr_confidence"].nullable and not PAGE["ocr_text"].nullable and DOCUMENT["id"].dataType.simpleString() == "string"
