"""Changes to tables as snapshots: the old state comes in, the new one goes out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import conflicts

RESET = {"ocr_completed": False, "ocr_text": "", "ocr_confidence": None, "rotation_applied": 0.0}


def insert(table: DataFrame, rows: DataFrame, unique: Sequence[str] = ()) -> DataFrame:
    """table with the new rows; with a key that must be unique, an error if it would not be. Looking it up costs a job, as a constraint does."""
    refuse(conflicts(table, rows, *unique) if unique else None, unique)
    return table.unionByName(rows.select(table.columns))


def refuse(found: DataFrame | None, key: Sequence[str]) -> None:
    """An error that names a few of the keys found."""
    some = found.select(*key).limit(3).collect() if found is not None else []
    if some:
        raise ValueError(f"{', '.join(key)} must be unique: {', '.join(str(tuple(r)) for r in some)}")


def patch(table: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """table with the given columns from the row of `changes` with its key, where there is one; a null in a change is set. Two changes of one key are an error when the result is computed."""
    n = F.count("*").over(Window.partitionBy(key))
    changes = changes.withColumn(key, F.when(n > 1, F.raise_error(F.concat(F.lit(f"{key} must be unique: "), F.col(key).cast("string"))).cast(changes.schema[key].dataType)).otherwise(F.col(key)))
    new = changes.select(F.col(key).alias("__key"), F.lit(True).alias("__hit"), *(F.col(c).alias(f"__{c}") for c in columns))
    joined = table.join(new, F.col(key) == F.col("__key"), "left")
    return joined.select(*(F.when(F.col("__hit"), F.col(f"__{c}").cast(table.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns))


def reset_pages(pages: DataFrame, chosen: Column) -> DataFrame:
    """Chosen pages as if they had never been processed."""
    return pages.select(*(F.when(chosen, F.lit(RESET[c]).cast(pages.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in RESET else F.col(c) for c in pages.columns))


def delete_cascading(parents: DataFrame, doomed: Column, children: DataFrame, foreign_key: str, key: str = "id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parents and children that stay, and a row with how many parents go."""
    gone = parents.where(F.coalesce(doomed, F.lit(False)))
    stay = parents.where(~F.coalesce(doomed, F.lit(False)))
    left = children.join(gone.select(F.col(key).alias("__gone")), F.col(foreign_key) == F.col("__gone"), "left_anti")
    return stay, left, gone.agg(F.count("*").alias("deleted"))


def delete_tree(tables: dict[str, DataFrame], start: str, doomed: Column, references: Sequence[tuple[str, str, str]], key: str = "id") -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """All tables without the doomed rows of `start` and what depends on them, over any number of levels; and (key) of what goes from each table that has that column.

    references: (child, foreign key, parent), each parent before its own children. A child row
    goes with any of its parents; a null reference depends on nothing.
    """
    gone = {start: [tables[start].where(F.coalesce(doomed, F.lit(False)))]}
    for child, foreign_key, parent in references:
        if parent in gone:
            ids = reduce(DataFrame.unionByName, (g.select(F.col(key).alias("__gone")) for g in gone[parent])).distinct()
            gone.setdefault(child, []).append(tables[child].join(ids, F.col(foreign_key) == F.col("__gone"), "left_semi"))
    left = dict(tables)
    left[start] = tables[start].where(~F.coalesce(doomed, F.lit(False)))
    for child, foreign_key, parent in references:
        if parent in gone:
            ids = reduce(DataFrame.unionByName, (g.select(F.col(key).alias("__gone")) for g in gone[parent])).distinct()
            left[child] = left[child].join(ids, F.col(foreign_key) == F.col("__gone"), "left_anti")
    return left, {name: reduce(DataFrame.unionByName, (g.select(key) for g in parts)).distinct() for name, parts in gone.items() if key in tables[name].columns}


def set_null(children: DataFrame, foreign_key: str, parents: DataFrame, key: str = "id") -> DataFrame:
    """Children with their reference set to null where its parent isn't there any more."""
    there = parents.select(F.col(key).alias("__there")).distinct()
    joined = children.join(there, F.col(foreign_key) == F.col("__there"), "left")
    return joined.select(*(F.col("__there").alias(c) if c == foreign_key else F.col(c) for c in children.columns))


def recoded(table: DataFrame, column: str, codes: dict[str, str]) -> DataFrame:
    """Old codes as new ones; others stay."""
    pairs = [F.lit(x) for p in codes.items() for x in p]
    return table.withColumn(column, F.coalesce(F.create_map(*pairs)[F.col(column)], F.col(column)))


def migrate(table: DataFrame, drop: tuple[str, ...] = (), add: dict[str, Column] | None = None) -> DataFrame:
    return table.drop(*drop).withColumns(add or {})
