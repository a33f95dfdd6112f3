"""Scalar functions as column expressions, all within the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTENSION = r"(?s)^(?:.*/)?\.*[^./][^/]*?(\.[^./]*)$"
WHITE_ENDS = r"(?U)^\s+|\s+$"


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, WHITE_ENDS, "")


def not_blank(x: Column) -> Column:
    return F.length(strip(x)) > 0


def extension(name: Column) -> Column:
    """With its dot, or empty; dots that a name starts with begin none."""
    return F.regexp_extract(name, EXTENSION, 1)


def stem(name: Column) -> Column:
    return F.left(name, F.length(name) - F.length(extension(name)))


def loose_stem(name: Column) -> Column:
    """All before the last dot, even where that is nothing."""
    return F.regexp_replace(name, r"(?s)\.[^.]*$", "")


def basename(path: Column) -> Column:
    return F.coalesce(F.element_at(F.split(path, "/"), -1), F.lit(""))


def capitalized(x: Column) -> Column:
    """Each run of letters with its first in upper and the others in lower case."""
    runs = F.regexp_extract_all(x, F.lit(r"(?s)(\p{L}+|\P{L}+)"), F.lit(1))
    return F.concat_ws("", F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substr(r, F.lit(2))))))


def title_from_name(name: Column) -> Column:
    return capitalized(F.regexp_replace(stem(name), "[_-]", " "))


def number(text: Column, pattern: str) -> Column:
    """The first match of the pattern's group as an integer; null if there is none or it is too large."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("int")


def uploaded_page_number(name: Column) -> Column:
    """Three digits at the end of the stem, or else all digits there."""
    return F.coalesce(number(stem(name), r"(\d{3})$"), number(stem(name), r"(\d+)$"))


def stored_page_number(name: Column) -> Column:
    """For names that storage has changed: three digits at the front before an underscore, three at the end, then any number there."""
    s = loose_stem(name)
    return F.coalesce(*(number(s, p) for p in (r"^(\d{3})_", r"(\d{3})$", r"^(\d+)_", r"(\d+)$")))


def too_large_number(name: Column, said: Column) -> Column:
    """Whether a stored name, which says the page number `said`, has only a number that fits no integer: its document can't be repaired."""
    s = loose_stem(name)
    return said.isNull() & (F.regexp_like(s, F.lit(r"^\d+_")) | F.regexp_like(s, F.lit(r"\d+$")))


def is_pdf(path: Column) -> Column:
    return F.lower(path).endswith(".pdf")


def accepted(name: Column, extensions: tuple[str, ...]) -> Column:
    return F.lower(extension(name)).isin(*extensions)


def label(code: Column, labels: dict[str, str]) -> Column:
    """A code's label, or the code itself where it has none."""
    pairs = [F.lit(x) for pair in labels.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[code] if pairs else F.lit(None), code)


def percentage(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double")) * 100


def one_decimal(x: Column) -> Column:
    """Halves go to the even digit."""
    return F.format_string("%.1f", F.bround(x, 1))


def mean_positive(numbers: Column) -> Column:
    """The mean of an array's positive integers, 0 if there are none."""
    good = F.filter(numbers, lambda x: x > 0)
    total = F.aggregate(good, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    return F.coalesce(F.try_divide(total.cast("double"), F.nullif(F.size(good), F.lit(0)).cast("double")), F.lit(0.0))


def mean_confidence(texts: Column) -> Column:
    """mean_positive() of numbers in text; 0 if one of them is no integer."""
    parsed = F.transform(texts, lambda x: F.trim(x).try_cast("int"))
    return F.when(F.exists(parsed, lambda x: x.isNull()), F.lit(0.0)).otherwise(mean_positive(parsed))


def rotation(report: Column) -> Column:
    """The angle in the first line that has `Rotate:`; 0 where none can be read."""
    line = F.try_element_at(F.filter(F.split(report, "\n"), lambda x: x.contains("Rotate:")), F.lit(1))
    return F.coalesce(F.trim(F.try_element_at(F.split(line, ":"), F.lit(2))).try_cast("int"), F.lit(0))


def preview(text: Column, width: int = 100) -> Column:
    """The first characters on one line, stripped, with dots where there is more."""
    return F.concat(strip(F.translate(F.left(text, F.lit(width)), "\n", " ")), F.when(F.length(text) > width, "...").otherwise(""))


def place_label(name: Column, *parts: Column) -> Column:
    return F.concat_ws(", ", name, *(F.nullif(p, F.lit("")) for p in parts))


def full_name(given: Column, surname: Column, maiden: Column) -> Column:
    """Given names, the maiden name in brackets where there is one, surname."""
    return F.concat_ws(" ", given, F.when(maiden != "", F.concat(F.lit("("), maiden, F.lit(")"))), surname)


def event_label(kind: Column, person: Column, partnership: Column) -> Column:
    return F.concat(kind, F.lit(": "), F.coalesce(person, partnership, F.lit("None")))


def kinship_label(child: Column, kind: Column, parent: Column) -> Column:
    return F.concat(child, F.lit(" - "), F.lower(kind), F.lit(" child of "), parent)


def page_label(title: Column, page: Column) -> Column:
    return F.concat(title, F.lit(" - Page "), page.cast("string"))


def sample_title(name: Column, description: Column) -> Column:
    return F.concat(F.lit("Demo: "), stem(basename(name)), F.lit(" - "), description)


def uuid_of(*parts: Column) -> Column:
    """A UUID that follows from the parts."""
    return F.regexp_replace(F.md5(F.concat_ws("|", *parts)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def is_uuid(x: Column) -> Column:
    """As text with or without hyphens, in any case."""
    return F.coalesce(F.regexp_like(F.regexp_replace(F.lower(x), "^urn:uuid:|[{}-]", ""), F.lit("^[0-9a-f]{32}$")), F.lit(False))
