"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled (by a keyed digest of their ids), and a document gets a
virtual finish time: its source's tokens up to and including it, divided by the source's
target weight. Documents are taken in the order of (finish time, source, digest) until the
next would go beyond the total budget, so at any point sources stand in their target ratio,
as far as they last.

No step sorts one source, or all documents, in one task: running sums are taken within
slices of the digest range, above a summary with one row for each slice, and the cut needs a
running sum only over the few documents around the finish time at which the sources
together reach the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernel

DEFAULT_WEIGHT = 1.0
BUDGET_FRACTION = 0.5
SEED = 42
SLICE_DIGITS = 3  # 16**3 slices of the digest range for each source


def n_tokens(text: Column) -> Column:
    """Blank-separated words; 0 for a null or empty text."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r]+")), F.lit(0)).cast("long")


def digest(doc_id: Column, text: Column, seed: int) -> Column:
    """Of the id, or where it is null, of the text."""
    return F.md5(F.coalesce(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), F.concat(F.lit(f"{seed}#"), text.cast("string")), F.lit(str(seed))))


def weight(source: Column, weights: dict[str, float], default: float) -> Column:
    if default <= 0 or any(w <= 0 for w in weights.values()):
        raise ValueError("target weights must be positive")
    out = F.lit(float(default))
    for name, w in weights.items():
        out = F.when(source == name, F.lit(float(w))).otherwise(out)
    return out


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = DEFAULT_WEIGHT, budget_fraction: float = BUDGET_FRACTION, budget_tokens: int | None = None, seed: int = SEED, ordered: bool = True) -> DataFrame:
    """The chosen documents as (doc_id, source, n_tokens, finish), range-sorted by finish.

    A source that weights doesn't name has default_weight. The budget is budget_tokens, or where
    that is None, budget_fraction of all tokens.

    Defined cases: a null source is a source of its own, with the default weight; a null or
    empty text has no tokens and finishes with the document before it; where the id is
    null the text stands for it; rows with equal source and id share one finish time, that
    after all of them, and are taken or left together, identical rows included; an empty table gives no rows;
    other columns of docs are not looked at. Ties of finish time go by source, then digest.
    """
    weights = weights or {}
    rows = docs.select(
        F.col("doc_id"), F.col("source"), n_tokens(F.col("text")).alias("n_tokens"), digest(F.col("doc_id"), F.col("text"), seed).alias("h")
    ).withColumn("slice", F.substring("h", 1, SLICE_DIGITS))
    rows = rows.repartition("source", "slice")
    slices = rows.groupBy("source", "slice").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.withColumn("offset", F.coalesce(F.sum("tokens").over(before), F.lit(0))).select(F.col("source").alias("o_source"), F.col("slice").alias("o_slice"), "offset")
    # Rows of a source and slice lie together already, so this join moves only the summary. A null source has its own key.
    within = Window.partitionBy("source", "slice").orderBy("h")
    timed = (
        rows.withColumn("run", F.sum("n_tokens").over(within))
        .join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("slice") == F.col("o_slice")))
        .withColumn("finish", (F.col("run") + F.col("offset")).cast("double") / weight(F.col("source"), weights, default_weight))
        .select("doc_id", "source", "n_tokens", "finish", "h")
    )
    timed = kernel.cut(timed)  # four short columns; all that follows reads them, and none of it the texts

    # One row for each source. By time v a source has given min(weight * v, all it has); these
    # together reach the budget at `level`. So all that finishes by then fits, exactly.
    share = F.max(weight(F.col("source"), weights, default_weight))
    sources = timed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), share.alias("w"))
    total = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens"))
    budget = F.lit(int(budget_tokens)) if budget_tokens is not None else F.floor(F.col("all_tokens") * F.lit(float(budget_fraction)))
    by_end = Window.orderBy(F.col("tokens") / F.col("w"), "source")  # over the sources alone
    level = (
        sources.crossJoin(F.broadcast(total.select(budget.cast("long").alias("budget"))))
        .withColumn("end", F.col("tokens") / F.col("w"))
        .withColumn("done", F.coalesce(F.sum("tokens").over(by_end.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("w").over(by_end.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("done")) / F.col("open"))
        .agg(F.max("budget").alias("budget"), F.max(F.when(F.col("level") <= F.col("end"), F.col("level"))).alias("level"), F.max("end").alias("last"))
        .select("budget", (F.coalesce("level", F.col("last") + 1) * F.lit(1 - 1e-9)).alias("level"))
    )
    placed = timed.crossJoin(F.broadcast(level))
    safe = F.col("finish") <= F.col("level")
    # What is beyond fits only while its own source's excess does, a few documents of each source.
    base = placed.where(safe).agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("base"))
    room = kernel.small(placed.where(safe).groupBy("source").agg(F.sum("n_tokens").alias("had")).withColumnRenamed("source", "r_source"))
    edge = (
        placed.where(~safe).crossJoin(F.broadcast(base))
        .join(room, F.col("source").eqNullSafe(F.col("r_source")), "left")
        .withColumn("excess", F.col("finish") * weight(F.col("source"), weights, default_weight) - F.coalesce("had", F.lit(0)))
        .where(F.col("excess") <= F.col("budget") - F.col("base") + 1)
    )
    order = Window.orderBy("finish", "source", "h")
    edge = edge.withColumn("running", F.sum("n_tokens").over(order) + F.col("base")).where(F.col("running") <= F.col("budget"))
    columns = ["doc_id", "source", "n_tokens", "finish", "h"]
    taken = placed.where(safe).select(columns).unionByName(edge.select(columns))
    if ordered:
        taken = taken.orderBy("finish", "source", "h")
    return taken


def keep_mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns, that mix_sources takes.

    Within a source what is taken is a prefix of the digest order, so one cut-off for each
    source decides every row where it lies: texts are not shuffled.

    Defined cases: rows with equal source and id stay or go together, whatever their texts, and
    with a null id those with equal source and text; null and empty texts cost nothing; a null source is
    a source of its own; other columns may have any names; an empty table gives no rows.
    """
    seed = options.get("seed", SEED)
    cutoffs = mix_sources(docs, ordered=False, **options).groupBy("source").agg(F.max("h").alias("cutoff"))
    source, cutoff = kernel.fresh(docs, "mix_source", "mix_cutoff")
    cutoffs = kernel.small(cutoffs.select(F.col("source").alias(source), F.col("cutoff").alias(cutoff)))
    return docs.join(cutoffs, docs["source"].eqNullSafe(F.col(source)) & (digest(docs["doc_id"], docs["text"], seed) <= F.col(cutoff)), "left_semi")


def oracle_sql(weights: dict[str, float]) -> str:
    case = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + f" ELSE {DEFAULT_WEIGHT} END"
    return f"""
    WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0)::BIGINT AS n_tokens,
                      md5(coalesce('{SEED}:' || doc_id::VARCHAR, '{SEED}#' || text, '{SEED}')) AS h FROM documents),
    c AS (SELECT *, (sum(n_tokens) OVER (PARTITION BY source ORDER BY h))::DOUBLE / ({case})::DOUBLE AS finish FROM d),
    r AS (SELECT *, sum(n_tokens) OVER (ORDER BY finish, source NULLS FIRST, h) AS running FROM c)
    SELECT doc_id, source, n_tokens, finish FROM r
    WHERE running <= (SELECT floor(sum(n_tokens) * {BUDGET_FRACTION}) FROM d)"""
