"""Persons, partnerships, events and parent-child links: labels through joins, and the kinship graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.shared import cut

GENERATIONS = 4


def person_names(persons: DataFrame) -> DataFrame:
    return persons.select(F.col("id").alias("person_id"), "surname", "given_names", text.full_name(F.col("given_names"), F.col("surname"), F.col("maiden_name")).alias("person_name"))


def partnership_labels(partnerships: DataFrame, partners: DataFrame, persons: DataFrame, labels: dict[str, str]) -> DataFrame:
    """(id, label): the partners' names in the order of surname and given names, and the kind; without partners, the kind alone."""
    named = partners.join(person_names(persons), F.col("right_id") == F.col("person_id"))
    names = named.groupBy("left_id").agg(F.array_sort(F.collect_list(F.struct("surname", "given_names", "person_id", "person_name"))).alias("p"))
    joined = partnerships.join(names, F.col("id") == F.col("left_id"), "left")
    who = F.coalesce(F.concat_ws(" & ", F.col("p.person_name")), F.lit(""))
    return joined.select("id", F.concat(who, F.lit(" ("), text.label(F.col("partnership_type"), labels), F.lit(")")).alias("label"))


def event_labels(events: DataFrame, persons: DataFrame, partnership_names: DataFrame, labels: dict[str, str]) -> DataFrame:
    """(id, label): the kind and the person, or else the partnership, or else None."""
    p = person_names(persons).select("person_id", "person_name").withColumnRenamed("person_id", "p_id")
    c = partnership_names.select(F.col("id").alias("c_id"), F.col("label").alias("c_label"))
    joined = events.join(p, F.col("person_id") == F.col("p_id"), "left").join(c, F.col("partnership_id") == F.col("c_id"), "left")
    return joined.select("id", text.event_label(text.label(F.col("event_type"), labels), F.col("person_name"), F.col("c_label")).alias("label"))


def kinship_labels(links: DataFrame, persons: DataFrame, labels: dict[str, str]) -> DataFrame:
    child, parent = (person_names(persons).select(F.col("person_id").alias(f"{x}_person"), F.col("person_name").alias(f"{x}_name")) for x in ("child", "parent"))
    joined = links.join(child, F.col("child_id") == F.col("child_person")).join(parent, F.col("parent_id") == F.col("parent_person"))
    return joined.select("child_id", "parent_id", text.kinship_label(F.col("child_name"), text.label(F.col("relationship_type"), labels), F.col("parent_name")).alias("label"))


def sources_of(table: DataFrame, bridge: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, document_id, title) of each record's source documents."""
    return table.select("id").join(bridge, F.col("id") == F.col("left_id")).join(documents.select(F.col("id").alias("document_id"), "title"), F.col("right_id") == F.col("document_id")).select("id", "document_id", "title")


def with_places(table: DataFrame, places: DataFrame, references: dict[str, str]) -> DataFrame:
    """table with the label of the place that each optional reference names, as {foreign key: new column}; null where there is none. places: (id, name, locality, region, country)."""
    columns = table.columns
    labels = places.select(F.col("id").alias("__place"), text.place_label(F.col("name"), F.col("locality"), F.col("region"), F.col("country")).alias("__label"))
    for foreign_key, out in references.items():
        table = table.join(labels, F.col(foreign_key) == F.col("__place"), "left").withColumnRenamed("__label", out).drop("__place")
    return table.select(*columns, *references.values())


def ancestors(links: DataFrame, starts: DataFrame) -> DataFrame:
    """(id, ancestor, generations) along child_id -> parent_id from the ids of starts, each by its shortest way, however long.

    GENERATIONS steps make a round, after which only pairs that are new go on, so a pedigree
    that collapses doesn't multiply, a cycle ends, and no step needs more than the pairs found.
    Each round is cut in the shared folder. Null ids and links with a null end lead nowhere; in
    a cycle one is one's own ancestor.
    """
    up = cut(links.select(F.col("child_id").alias("__child"), F.col("parent_id").alias("__parent")).dropna().distinct())
    edge = starts.select(F.col("id"), F.col("id").alias("ancestor"), F.lit(0).alias("generations")).dropna().distinct()
    found: DataFrame | None = None
    reached = 0
    while True:
        step, steps = edge, []
        for _ in range(GENERATIONS):
            step = step.join(up, F.col("ancestor") == F.col("__child")).select("id", F.col("__parent").alias("ancestor"), (F.col("generations") + 1).alias("generations"))
            steps.append(step)
        new = reduce(DataFrame.unionByName, steps).groupBy("id", "ancestor").agg(F.min("generations").alias("generations"))
        new = cut(new if found is None else new.join(found.select("id", "ancestor"), ["id", "ancestor"], "left_anti"))
        found = new if found is None else found.unionByName(new)
        reached += GENERATIONS
        edge = new.where(F.col("generations") == reached)
        if edge.isEmpty():
            return found
