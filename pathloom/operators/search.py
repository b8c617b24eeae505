"""Top-k vector search: exact for a stated query set, through an index of cells for all rows.

Exact: a slice of the query vectors of bounded size is broadcast; every
partition of the candidates multiplies it block by block and keeps its own best
k for each query, so that the shuffle carries k rows a query and partition. A
larger query set is searched in more slices, each with its own pass.

Indexed: candidates lie in cells around centroids, a query meets those of its
nearest cells, tile by tile, so the work grows far below all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Bytes of query vectors broadcast at once, and candidates multiplied at once.
SLICE_BYTES, BLOCK_ROWS = 32 << 20, 2048
#: Blocks whose best are kept before they are merged.
MERGED_BLOCKS = 16
#: Index: candidates a cell should have, cells a query is compared with, and rows of the sample that places the cells.
CELL_ROWS, PROBES, SAMPLE_ROWS = 1000, 12, 1 << 16
#: Most rows of either side of a tile.
TILE_ROWS = 8192

METRICS = ("cosine", "l2")


def _rows(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length == 0, 1e-9, length)


def _scores(q: np.ndarray, x: np.ndarray, k: int | None, metric: str, decimals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, rounded score) of the k best candidates of each query with ties at the last, or of all pairs."""
    if metric == "cosine":
        score = np.round(q @ x.T, decimals)
    else:
        lengths = (q**2).sum(axis=1)[:, None] + (x**2).sum(axis=1)
        score = 1.0 - (lengths - 2 * (q @ x.T))
    if k is None or k >= len(x):
        i, j = (v.ravel() for v in np.indices(score.shape))
    else:
        kth = np.partition(score, len(x) - k, axis=1)[:, len(x) - k]
        # products of near vectors cancel: whatever may be among the best is computed from differences below
        room = 0.0 if metric == "cosine" else 1e-12 * lengths + 10.0**-decimals
        i, j = np.nonzero(score >= kth[:, None] - room)
    if metric == "cosine":
        return i, j, score[i, j] + 0.0
    exact = np.concatenate([((q[i[s : s + 65536]] - x[j[s : s + 65536]]) ** 2).sum(axis=1) for s in range(0, max(1, len(i)), 65536)])
    return i, j, np.round(1.0 - exact, decimals) + 0.0


def _best(i: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of each query, higher scores first, then smaller ids."""
    names, rank = np.unique(ids, return_inverse=True)
    order = np.lexsort((rank, -score, i))
    i, rank, score = i[order], rank[order], score[order]
    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, dtype=np.int64)
    within = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
    return i[within < k], names[rank[within < k]], score[within < k]


_FOUND = pa.schema([("query_id", pa.string()), ("id", pa.string()), ("score", pa.float64())])


def _partial(shared, k: int | None, metric: str, decimals: int):
    """A mapInArrow function: the k best of a partition for each query, or with no k the scores of all pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = shared.value
        names = np.array(names, dtype=object)
        kept: list[tuple] = []

        def rows(i, ids, score) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names[i], pa.string()), pa.array(ids, pa.string()), pa.array(score)], schema=_FOUND)

        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                x = _rows(part.column(1))
                i, j, score = _scores(q, _unit(x) if metric == "cosine" else x, k, metric, decimals)
                ids = np.array(part.column(0).to_pylist(), dtype=object)[j]
                if k is None:
                    yield rows(i, ids, score)
                    continue
                kept.append((i, ids, score))
                if len(kept) == MERGED_BLOCKS:
                    kept = [_best(*map(np.concatenate, zip(*kept)), k)]
        if kept:
            yield rows(*_best(*map(np.concatenate, zip(*kept)), k))

    return run


def _searched(queries: DataFrame, candidates: DataFrame, k: int | None, metric: str, decimals: int, slice_bytes: int) -> DataFrame:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}, expected one of {METRICS}")
    spark = queries.sparkSession
    queries = queries.toDF("query_id", "v")
    candidates = candidates.toDF("id", "v")
    total = queries.agg(F.coalesce(F.sum(8 * F.size("v") + 64), F.lit(0)).alias("n")).first()["n"]
    slices = max(1, -(-int(total) // slice_bytes))
    kind = "query_id string, id string, score double"
    found = spark.createDataFrame([], kind)
    for s in range(slices):
        part = queries if slices == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == s)
        table = part.toArrow()
        if not table.num_rows:
            continue
        v = _rows(pc.cast(table["v"].combine_chunks(), pa.list_(pa.float64())))
        shared = spark.sparkContext.broadcast((table["query_id"].to_pylist(), _unit(v) if metric == "cosine" else v))
        found = found.unionByName(candidates.mapInArrow(_partial(shared, k, metric, decimals), kind))
    return found


def all_scores(queries: DataFrame, candidates: DataFrame, metric: str = "cosine", decimals: int = 6, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``(query_id, id, score)`` of each of a stated set of queries with every candidate, as ``exact_topk`` scores them; nothing is shuffled."""
    return _searched(queries, candidates, None, metric, decimals, slice_bytes)


def exact_topk(
    queries: DataFrame, candidates: DataFrame, k: int, metric: str = "cosine", decimals: int = 6, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """``(query_id, id, score, rank_no)``: the best ``k`` candidates of each query.

    Both sides are (string id, vector) with sound vectors of one length and
    distinct ids. ``cosine`` has zero vectors at similarity 0, ``l2`` gives one
    minus the squared distance. Scores are rounded, ties go to the smaller id.
    Fewer candidates give fewer rows; no queries or no candidates give none.
    """
    found = _searched(queries, candidates, k, metric, decimals, slice_bytes)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank_no", F.row_number().over(order)).filter(F.col("rank_no") <= k)


def fuse(parts: list[tuple[DataFrame, int]], k: int) -> DataFrame:
    """Union of ranked results, each cut to its own k, ranked again and cut to ``k``."""
    union = None
    for part, own in parts:
        cut = part.filter(F.col("rank_no") <= own).drop("rank_no")
        union = cut if union is None else union.unionByName(cut)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return union.withColumn("rank_no", F.row_number().over(order)).filter(F.col("rank_no") <= k)


def _centroids(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; the first centroids are rows far from one another in the order of a sketch."""
    x = np.unique(np.round(_unit(sample), 6), axis=0)
    c = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
    for _ in range(rounds):
        own = np.concatenate([(x[s : s + 4096] @ c.T).argmax(axis=1) for s in range(0, len(x), 4096)])
        hit, inverse = np.unique(own, return_inverse=True)
        sums = np.zeros((len(hit), x.shape[1]))
        np.add.at(sums, inverse, x)
        c = _unit(sums)
    return c


def _cells(shared, probes: int):
    """A mapInArrow function: each (id, vector) with its ``probes`` nearest cells, a row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        n = min(probes, len(c))
        for batch in (b.slice(s, 1024) for b in batches for s in range(0, b.num_rows, 1024)):
            near = _unit(_rows(batch.column(1))) @ c.T
            cell = np.argpartition(-near, n - 1, axis=1)[:, :n]
            at = pa.array(np.repeat(np.arange(batch.num_rows), n))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(cell.ravel().astype(np.int32))], names=["id", "v", "cell"])

    return run


def indexed_topk(queries: DataFrame, candidates: DataFrame, k: int, metric: str = "cosine", decimals: int = 6, probes: int = PROBES, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``(query_id, id, score, rank_no)``: like ``exact_topk`` for any number of queries, through an index.

    Every candidate is in the cell of its nearest centroid. The centroids come
    from a sample of at most ``SAMPLE_ROWS`` candidates; their number grows with
    that of the candidates up to a sixteenth of that sample, with its root
    beyond. A query is compared with its ``probes`` nearest cells, so a near
    candidate in another cell may be missed; ``l2`` expects vectors of about
    one length. Cells and queries of a cell are split into tiles of at most
    ``TILE_ROWS`` rows.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}, expected one of {METRICS}")
    spark = queries.sparkSession
    queries, candidates = queries.toDF("id", "v"), candidates.toDF("id", "v")
    n = candidates.count()
    found_kind = "query_id string, id string, score double"
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    cells, most = max(1, -(-n // cell_rows)), SAMPLE_ROWS // 16
    cells = cells if cells <= most else int((cells * most) ** 0.5)
    sample = candidates.orderBy(F.xxhash64("id"), "id").limit(min(SAMPLE_ROWS, 32 * cells)).select("v").toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], found_kind + ", rank_no int")
    shared = spark.sparkContext.broadcast(_centroids(_rows(pc.cast(sample["v"].combine_chunks(), pa.list_(pa.float64()))), cells))
    kind = f"id string, v {candidates.schema['v'].dataType.simpleString()}, cell int"
    placed = written(candidates.mapInArrow(_cells(shared, 1), kind))
    asked = written(queries.mapInArrow(_cells(shared, probes), kind.replace(candidates.schema["v"].dataType.simpleString(), queries.schema["v"].dataType.simpleString())))
    count = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / TILE_ROWS).cast("int").alias(name))
    sizes = F.broadcast(count(placed, "n_c").join(count(asked, "n_q"), "cell"))  # a row a cell
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    left = asked.join(sizes, "cell").select("cell", "id", "v", own("n_q").alias("q_no"), spread("n_c").alias("c_no"))
    right = placed.join(sizes, "cell").select("cell", "id", "v", spread("n_q").alias("q_no"), own("n_c").alias("c_no"))

    def tile(q: pa.Table, x: pa.Table) -> pa.Table:
        if not len(q) or not len(x):
            return _FOUND.empty_table()
        a, b = (_rows(t["v"].combine_chunks()) for t in (q, x))
        if metric == "cosine":
            a, b = _unit(a), _unit(b)
        names, ids = (np.array(t["id"].to_pylist(), dtype=object) for t in (q, x))
        parts = []
        for s in range(0, len(a), 512):
            i, j, score = _scores(a[s : s + 512], b, k, metric, decimals)
            i, found, score = _best(i, ids[j], score, k)
            parts.append((names[s + i], found, score))
        return pa.table([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*parts), _FOUND)], schema=_FOUND)

    keys = ["cell", "q_no", "c_no"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(tile, found_kind)
    return found.withColumn("rank_no", F.row_number().over(order)).filter(F.col("rank_no") <= k)
