"""Blocks: rows with one key, which are compared with each other in one task.

A key that very many rows share is no one task's: its rows are dealt into tiles by a hash, and
every two tiles meet in a block of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel

ROWS = 16_384  # of a tile
BLOCK = ["lo", "hi"]


def tiled(rows: DataFrame, key: str, node: str, most: int | None = None, keys: DataFrame | None = None) -> DataFrame:
    """rows with (lo, hi, tile), so that any two rows with one key have an equal (key, lo, hi), and no such block has many more than 2 * most rows.

    Two rows of different tiles meet once; two of one tile meet once in the block with lo = hi,
    and in others too. keys has the key of every row, where rows are dear to compute; rows
    with one key and one node may be in any number.
    """
    most = ROWS if most is None else most
    many = (rows if keys is None else keys).groupBy(key).count().where(F.col("count") > most)
    many = kernel.small(many.select(F.col(key).alias("many_key"), F.ceil(F.col("count") / most).cast("int").alias("tiles")))
    if many.isEmpty():
        return rows.withColumns({c: F.lit(0) for c in (*BLOCK, "tile")})
    joined = rows.join(many, F.col(key) == F.col("many_key"), "left").withColumn("tile", F.coalesce(F.pmod(F.xxhash64(F.lit("tile"), node), "tiles").cast("int"), F.lit(0)))
    with_ = F.transform(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1), lambda j: F.struct(F.least(j, "tile").alias("lo"), F.greatest(j, "tile").alias("hi")))
    return joined.withColumn("meets", F.explode(with_)).select(*rows.columns, "meets.*", "tile")


def each(rows: DataFrame, keys: list[str], work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, order: tuple[str, ...] = (), tasks: int | None = None, apply: Callable = DataFrame.mapInArrow) -> DataFrame:
    """Applies work to tables that hold whole blocks, sorted by keys and order, many small ones at once. A block that Arrow batches cut is put together again. tasks: how many, where the size of the rows doesn't tell the work. apply: kernel.stored to have the result as a table, and its path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = begins(pa.Table.from_batches([batch]), keys)
            last = int(starts[-1])  # the last block may go on in the next batch
            if last:
                yield from work(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            elif held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys):
                yield from work(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(last))
        if held:
            yield from work(pa.Table.from_batches(held))

    return apply(rows.repartition(*([tasks] if tasks else []), *keys).sortWithinPartitions(*keys, *order), run, schema)


def begins(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where each block of a sorted table begins."""
    new = np.ones(table.num_rows, bool)
    if table.num_rows > 1:
        columns = [table.column(k).to_numpy() for k in keys]
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def portions(table: pa.Table, keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Whole blocks of a sorted table, as many at once as have about so many rows; a larger block is one portion."""
    starts = np.append(begins(table, keys), table.num_rows)
    lo = 0
    while lo < len(starts) - 1:
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + rows, "right")) - 1)
        yield table.slice(starts[lo], starts[hi] - starts[lo])
        lo = hi


def spanning(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the edges (p, q), some that join what all of them join, beyond what label has as one already; and the new labels."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(p):
        # Joins each group with its least partner, once; what is then within one group goes.
        apart = label[p] != label[q]
        p, q = p[apart], q[apart]
        if not len(p):
            break
        lo, hi = np.minimum(label[p], label[q]), np.maximum(label[p], label[q])
        order = np.lexsort((lo, hi))
        first = order[np.concatenate([[True], hi[order][1:] != hi[order][:-1]])]
        a.append(p[first])
        b.append(q[first])
        to = np.arange(len(label))
        to[hi[first]] = lo[first]
        while (to[to] != to).any():
            to = to[to]
        label = to[label]
    return np.concatenate(a), np.concatenate(b), label
