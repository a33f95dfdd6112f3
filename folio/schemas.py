"""Declared schemas of the tables, and the labels of their codes. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import BooleanType, DataType, DateType, DecimalType, DoubleType, IntegerType, StringType, StructType, TimestampType

_TYPES: dict[str, DataType] = {"string": StringType(), "int": IntegerType(), "double": DoubleType(), "boolean": BooleanType(), "date": DateType(), "timestamp": TimestampType(), "decimal(9;6)": DecimalType(9, 6)}


def _schema(ddl: str) -> StructType:
    """From `name type [not null], ...`; unlike Spark's own parser, without a session."""
    out = StructType()
    for field in ddl.split(", "):
        name, kind, *rest = field.split(" ")
        out = out.add(name, _TYPES[kind], nullable=not rest)
    return out


DOCUMENT = _schema("id string not null, title string not null, languages string not null, upload_date timestamp not null, ocr_completed boolean not null, extraction_completed boolean not null")
PAGE = _schema("id string not null, document_id string not null, page_number int not null, image_file string not null, ocr_completed boolean not null, ocr_text string not null, ocr_confidence double, rotation_applied double not null, original_filename string not null, created_at timestamp not null, updated_at timestamp not null")
PLACE = _schema("id string not null, name string not null, locality string not null, region string not null, country string not null, latitude decimal(9;6), longitude decimal(9;6)")
PERSON = _schema("id string not null, given_names string not null, surname string not null, maiden_name string not null, gender string not null, birth_date date, birth_date_estimated boolean not null, death_date date, death_date_estimated boolean not null, birth_place_id string, death_place_id string, lineage_id string not null, created_at timestamp not null, updated_at timestamp not null")
PARTNERSHIP = _schema("id string not null, partnership_type string not null, start_date date, start_date_estimated boolean not null, end_date date, end_date_estimated boolean not null, start_place_id string, end_reason string not null, created_at timestamp not null, updated_at timestamp not null")
EVENT = _schema("id string not null, event_type string not null, person_id string, partnership_id string, date date, date_estimated boolean not null, place_id string, description string not null, created_at timestamp not null, updated_at timestamp not null")
PARENT_CHILD = _schema("id string not null, child_id string not null, parent_id string not null, relationship_type string not null, partnership_id string, created_at timestamp not null")
#: The many-to-many relations: partners, and the source documents of persons, partnerships, events and parent-child links.
BRIDGE = _schema("left_id string not null, right_id string not null")
OCR_RESULT = _schema("page_id string, outcome string, success boolean, message string, error string, text string, confidence double, rotation_applied double")

#: Keys that a table's rows must not share.
UNIQUE = {"page": ("document_id", "page_number"), "place": ("name", "locality", "region", "country"), "parent_child": ("child_id", "parent_id")}

LANGUAGES = {"eng": "English", "nld": "Dutch", "eng+nld": "English + Dutch"}
#: Codes of older rows; applied only when asked for.
OLD_LANGUAGES = {"en": "eng", "nl": "nld", "en+nl": "eng+nld"}
EXTENSIONS = (".pdf", ".jpg", ".jpeg", ".png", ".tiff", ".tif")
