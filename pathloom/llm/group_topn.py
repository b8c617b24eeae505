"""The N best items of every group, however large a group is.

Each partition of the scan reduces its rows to distinct (group, item) pairs
with their best score. Where it holds N or more items of a group, its own N-th
best score is a lower bound of the group's final N-th score: those N items
score at least as much in the end. The greatest bound of a group, joined to
its rows, removes what cannot be among the best N before anything is shuffled;
the survivors are merged and ranked. A group with a third of all rows
therefore reaches the shuffle as a few rows a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Bounds are broadcast up to this size, a bound taking so many bytes beside its group's id; beyond it they are joined by a
#: shuffle of the pre-aggregated items.
BROADCAST_BYTES, BOUND_ROW_BYTES = 32 << 20, 64
#: Rows a worker gathers before it reduces them.
GATHER_ROWS = 1_000_000


def _flat(batch: pa.RecordBatch) -> pa.Table:
    """(group, ids, scores) with lists to (group, item, score) without; null and NaN scores and null ids drop out."""
    ids, scores = batch.column(1), batch.column(2)
    parents = pc.list_parent_indices(ids)
    flat = pa.table(
        {"grp": batch.column(0).take(parents), "item": pc.list_flatten(ids), "score": pc.list_flatten(scores)}
    )
    sound = pc.and_(pc.is_valid(flat["item"]), pc.is_valid(flat["score"]))
    return flat.filter(pc.and_(sound, pc.invert(pc.fill_null(pc.is_nan(flat["score"]), True))))


def _best(table: pa.Table) -> pa.Table:
    out = table.group_by(["grp", "item"], use_threads=False).aggregate([("score", "max")])
    return pa.table({"grp": out["grp"], "item": out["item"], "score": out["score_max"]})


def _ordered(best: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """Rows by group and falling rank, and the rank of each."""
    codes = best["grp"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    best = best.append_column("g", pa.array(codes))
    best = best.take(pc.sort_indices(best, [("g", "ascending"), ("score", "descending"), ("item", "ascending")]))
    g = best["g"].to_numpy()
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.r_[first, len(g)])
    rank = np.arange(len(g)) - np.repeat(first, sizes) + 1
    return best.drop_columns(["g"]), rank


def _reduce(n: int, emit):
    """Gather a partition, keep the local N best of each group while it grows, and emit from what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0

        def shrink() -> pa.Table:
            best = _best(pa.concat_tables(held))
            ordered, rank = _ordered(best)
            return ordered.filter(pa.array(rank <= n))

        for batch in batches:
            flat = _flat(batch)
            held.append(flat)
            rows += len(flat)
            if rows >= GATHER_ROWS + (len(held[0]) if held else 0):
                held = [shrink()]
                rows = 0
        if held:
            ordered, rank = _ordered(_best(pa.concat_tables(held)))
            yield from emit(ordered, rank).to_batches()

    return run


def _bounds_only(n: int):
    def emit(ordered: pa.Table, rank) -> pa.Table:
        at = ordered.filter(pa.array(rank == n))
        return pa.table({"grp": at["grp"], "bound": at["score"]})

    return emit


def _local_best(n: int):
    return lambda ordered, rank: ordered.filter(pa.array(rank <= n))


def top_items(
    scored: DataFrame, group_col: str, ids_col: str, scores_col: str, n: int = 10, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``(group_col, rank_no, item_id)``: the ``n`` best distinct items of each group.

    ``ids_col`` and ``scores_col`` are arrays of equal length (a nested field
    of an array of structs serves). An item's score is its greatest one that
    is neither null nor NaN; without one, or without an id, it is no item;
    null groups drop out. Order: score falling, then id in string order, so
    ties and repeated rows have one result. Null and empty arrays and empty
    tables give no rows.
    """
    rows = scored.select(
        F.col(group_col).cast("string").alias("grp"),
        F.col(ids_col).cast("array<string>").alias("ids"),
        F.col(scores_col).cast("array<double>").alias("scores"),
    ).filter("grp is not null and size(ids) > 0")
    bounds = (
        rows.mapInArrow(_reduce(n, _bounds_only(n)), "grp string, bound double").groupBy("grp").agg(F.max("bound").alias("bound"))
    )
    bounds = written(bounds)
    size = bounds.agg(F.sum(F.octet_length("grp") + BOUND_ROW_BYTES).alias("n")).first()["n"] or 0
    small = size <= broadcast_bytes
    local = rows.mapInArrow(_reduce(n, _local_best(n)), "grp string, item string, score double")
    kept = local.join(F.broadcast(bounds) if small else bounds, "grp", "left").filter(
        F.col("bound").isNull() | (F.col("score") >= F.col("bound"))
    )
    # One shuffle, by group, serves the merge and the ranking: at most n rows of a group come from each partition.
    best = kept.repartition("grp").groupBy("grp", "item").agg(F.max("score").alias("score"))
    order = Window.partitionBy("grp").orderBy(F.col("score").desc(), F.col("item"))
    return (
        best.withColumn("rank_no", F.row_number().over(order))
        .filter(F.col("rank_no") <= n)
        .select(F.col("grp").alias(group_col), "rank_no", F.col("item").alias("item_id"))
    )
