"""The k most similar vectors of a collection for every vector.

A block matrix join. Vectors are put into cells around centroids, and each one
meets the candidates of its own cell first, then those of the cells nearest to
it, tile by tile. A tile multiplies int8 codes; with the exact quantisation
residues this brackets every cosine, so only pairs whose upper bound reaches
the query's k-th lower bound survive. Survivors are recomputed in double
precision, and the short ordered lists of a query's tiles are merged. The k-th
best of the own cell bounds the rest of the search: a cell is left out where
the plane between the two centroids is further from the query than any better
candidate can be, which loses nothing. Equal vectors are one candidate with
its smallest ids, so a vector that a third of all ids share costs no more than
another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Candidates a cell should have, and the cells each vector is compared with.
CELL_ROWS, PROBES = 1500, 8
#: Up to so many cells grow in number with the candidates, beyond that with the square root of their number, and in size
#: likewise; so the work grows with the power 1.5 of the vectors, for placing them and for the tiles alike.
FIRST_CELLS = 4096
#: Rows of the sample that places the centroids, per cell, and in all (64 MB that reach the driver).
SAMPLE_PER_CELL, SAMPLE_ROWS = 16, 1 << 18
#: Numbers of a matrix of some vectors by all cells.
MATRIX = 1 << 21
#: Most rows of either side of a tile, and query rows multiplied at once.
TILE_CANDIDATES, TILE_QUERIES, CHUNK_QUERIES = 8192, 16384, 512
#: Room for the rounding of single-precision sums, in cosine.
FLOAT_SLACK = 1e-5


def _matrix(column, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(-1, dims)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True) if len(x) else 1.0
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            keep = pc.fill_null(pc.equal(pc.list_value_length(lists), dims), False)
            batch = batch.filter(keep)
            flat = batch.column(2).flatten()
            x = flat.cast(pa.float32()).to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dims)
            good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            x = np.ascontiguousarray(x[good])
            at = pa.array(np.flatnonzero(good), pa.int64())
            vec = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), vec], names=["id", "target", "vec"])

    return run


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means from the first distinct directions of ``sample``; cells without a row of it are left out."""
    x = _unit(sample).astype(np.float32)
    x = x[np.sort(np.unique(np.round(x, 6) + np.float32(0), axis=0, return_index=True)[1])]
    c = x[:cells].copy()
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        order = np.argsort(own, kind="stable")
        first = np.flatnonzero(np.r_[True, own[order][1:] != own[order][:-1]])
        sums = np.zeros_like(c)
        sums[own[order][first]] = np.add.reduceat(x[order], first, axis=0)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-9), c)
    own = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
    return c[np.unique(own)]


def cell_number(candidates: int, cell_rows: int = CELL_ROWS) -> int:
    """How many cells so many distinct candidates get."""
    wanted = max(1, -(-candidates // cell_rows))
    return wanted if wanted <= FIRST_CELLS else math.isqrt(wanted * FIRST_CELLS)


def _slices(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """Parts small enough for a matrix of a row by all cells."""
    rows = max(1, min(CHUNK_QUERIES, MATRIX // cells))
    return (b.slice(i, rows) for b in batches for i in range(0, max(1, b.num_rows), rows))


def _home(centroids, dims: int):
    """Add the nearest cell of each vector: there it is found as a candidate, and there its search begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centroids.value
        for batch in _slices(batches, len(c)):
            x = _unit(_matrix(batch.column("vec"), dims)).astype(np.float32)
            cell = (x @ c.T).argmax(axis=1) if len(x) else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=[*batch.schema.names, "cell"])

    return run


def _further(centroids, probes: int, dims: int):
    """A row for each further cell in which a vector may have candidates better than the k-th of its own cell.

    A candidate x of cell c is no nearer to the own centroid h than to c, and
    one better than ``kth`` lies within sqrt(2 - 2 kth) of the query q; so c is
    left out if q lies deeper on h's side of the plane between them than that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centroids.value.astype(np.float64)
        for batch in _slices(batches, len(c)):
            q = _unit(_matrix(batch.column("vec"), dims))
            if not len(q):
                continue
            home = batch.column("cell").to_numpy()
            reach = np.sqrt(np.maximum(0.0, 2 - 2 * batch.column("kth").to_numpy())) + 1e-4
            near = q @ c.T
            depth = near[np.arange(len(q)), home][:, None] - near
            apart = np.sqrt(np.maximum(0.0, 2 - 2 * (c[home] @ c.T)))
            open_ = depth <= reach[:, None] * apart + 1e-6
            open_[np.arange(len(q)), home] = False
            if probes < len(c):
                open_ &= near >= np.partition(near, len(c) - probes, axis=1)[:, len(c) - probes][:, None]
            i, cell = np.nonzero(open_)
            at = pa.array(i)
            columns = [batch.column(n).take(at) for n in ("h1", "h2", "vec", "kth")]
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *columns], names=["cell", "h1", "h2", "vec", "kth"])

    return run


def _quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, their scales, and the norm of what each code leaves out."""
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(unit - codes * scale[:, None], axis=1)


def _products(q_codes: np.ndarray, codes: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """int8 products of a tile, each times its candidate's scale.

    They run as single-precision matrix products: the sums are whole numbers,
    below 2**24 up to a thousand dimensions, so those hold them exactly.
    """
    out = q_codes.astype(np.float32) @ codes
    out *= scale
    return out


def _slack(q_scale: np.ndarray, q_left: np.ndarray, worst: float, rounding: int) -> np.ndarray:
    """How far a product may be from the rounded cosine, in units of the query's scale; ``worst`` is left out of a candidate."""
    return (q_left * (1 + worst) + worst + FLOAT_SLACK + 10.0**-rounding) / q_scale


def _tile(k: int, dims: int, rounding: int, opening: bool):
    """The k best candidates of each query of a tile; of all of them if it is the ``opening``, else of those at ``kth`` or above.

    The opening tile also passes on the vector and the least similarity that the k-th best of all will have.
    """
    kind = pa.list_(pa.struct([("d", pa.float64()), ("id", pa.string())]))
    fields = [("h1", pa.int64()), ("h2", pa.int64()), ("near", kind)]
    schema = pa.schema(fields + [("vec", pa.binary()), ("kth", pa.float64()), ("cell", pa.int32()), ("c_no", pa.int32())] * opening)

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not len(queries):
            return schema.empty_table()
        if not len(candidates):
            if not opening:
                return schema.empty_table()
            none = pa.array([[]] * len(queries), kind)
            kept = [queries[n] for n in ("vec", "cell", "c_no")]
            return pa.table([queries["h1"], queries["h2"], none, kept[0], pa.array([-1.0] * len(queries)), *kept[1:]], schema=schema)
        # candidates in the order of their first id; owned[at[j] : at[j + 1]] are all ids of candidate j
        ids = candidates["ids"].combine_chunks()
        order = np.array(pc.sort_indices(pc.list_element(ids, 0)))
        ids = ids.take(pa.array(order))
        counts = np.array(pc.list_value_length(ids), dtype=np.int64)
        at = np.r_[0, np.cumsum(counts)]
        owned = ids.flatten()
        id_rank = np.empty(len(owned), dtype=np.int64)
        id_rank[np.array(pc.sort_indices(owned))] = np.arange(len(owned))
        x = _unit(_matrix(candidates["found"], dims))[order]
        q_all = _unit(_matrix(queries["vec"], dims))
        codes, scale, left_out = _quantised(x)
        worst = float(left_out.max())
        block, scale = np.ascontiguousarray(codes.T, dtype=np.float32), scale.astype(np.float32)
        take = min(k, len(x))
        groups = max(1, len(x) // 64)
        lengths, flat_d, flat_at = [], [], []
        known = None if opening else queries["kth"].to_numpy()
        for start in range(0, len(q_all), CHUNK_QUERIES):
            q = q_all[start : start + CHUNK_QUERIES]
            q_codes, q_scale, q_left = _quantised(q)
            rough = _products(q_codes, block, scale)
            slack = _slack(q_scale, q_left, worst, rounding)
            if opening:
                # the take-th best of the groups' maxima is a lower bound of the take-th best
                if groups > 2 * take:
                    whole = rough[:, : len(x) // groups * groups].reshape(len(q), -1, groups).max(axis=1)
                else:
                    whole = rough
                floor = np.partition(whole, whole.shape[1] - take, axis=1)[:, whole.shape[1] - take] - 2 * slack.astype(np.float32)
            else:
                floor = (known[start : start + CHUNK_QUERIES] / q_scale - slack).astype(np.float32)
            flat = np.flatnonzero(rough >= floor[:, None])
            i, j = np.divmod(flat, len(x))
            cosine = np.empty(len(i))
            for s in range(0, len(i), 1 << 18):
                part = slice(s, s + (1 << 18))
                cosine[part] = np.einsum("ij,ij->i", q[i[part]], x[j[part]])
            d = -np.round(cosine, rounding)
            best = np.lexsort((j, d, i))
            i, j, d = i[best], j[best], d[best]
            first = np.searchsorted(i, np.arange(len(q)))
            within = np.arange(len(i)) - first[i]
            i, j, d = (v[within < take] for v in (i, j, d))
            reps = counts[j]
            which = np.repeat(at[j], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            i, d = np.repeat(i, reps), np.repeat(d, reps)
            if len(which) > len(j):  # equal vectors under several ids
                best = np.lexsort((id_rank[which], d, i))
                i, d, which = i[best], d[best], which[best]
                first = np.searchsorted(i, np.arange(len(q)))
                short = np.arange(len(i)) - first[i] < k
                i, d, which = i[short], d[short], which[short]
            lengths.append(np.bincount(i, minlength=len(q)))
            flat_d.append(d)
            flat_at.append(which)
        names_of = owned.take(pa.array(np.concatenate(flat_at)))
        struct = pa.StructArray.from_arrays([pa.array(np.concatenate(flat_d)), names_of], ["d", "id"])
        near = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.concatenate(lengths))], pa.int32()), struct)
        columns = [queries["h1"], queries["h2"], near]
        if not opening:
            some = pc.greater(pc.list_value_length(near), 0)
            return pa.table(columns, schema=schema).filter(some)
        # one rounding step below the k-th distance of this tile; without k candidates anything may be better
        counts_ = np.concatenate(lengths)
        last = np.cumsum(counts_) - 1
        distance = np.concatenate(flat_d)
        kth = np.where(counts_ >= k, -distance[np.maximum(last, 0)] - 10.0**-rounding, -1.0) if len(distance) else np.full(len(counts_), -1.0)
        return pa.table([*columns, queries["vec"], pa.array(kth), queries["cell"], queries["c_no"]], schema=schema)

    return run


def nearest(
    vectors: DataFrame,
    target: str = "entities",
    k: int = 5,
    dims: int = 64,
    probes: int | None = PROBES,
    collection_col: str = "collection",
    id_col: str = "id",
    vector_col: str = "embedding",
    rounding: int = 6,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """``(vector_id, neighbour_id, rank_no)``: the ``k`` nearest usable ids of collection ``target`` for every usable id.

    Usable are vectors of ``dims`` finite numbers that are not all zero; null
    ids and all other vectors are neither searched for nor found. Cosine in
    double precision, rounded; ties go to the smaller id; an id is not its own
    neighbour. Repeated rows and equal vectors under several ids are whole
    cases. Fewer candidates give fewer rows, none give none. ``probes`` cells
    are searched for each vector; None searches all of them, which is exact.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(collection_col) == target, F.lit(False)).alias("target"), F.col(vector_col)
    ).filter(F.col("id").isNotNull())
    usable = rows.mapInArrow(_usable(dims), "id string, target boolean, vec binary")
    # two independent hashes stand for the vector from here on
    usable = written(usable.withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(7), "vec")}))
    vectors_once = usable.filter("target").groupBy("h1", "h2").agg(F.first("vec").alias("vec"))
    n = vectors_once.count()
    cells = cell_number(n, cell_rows)
    picked = vectors_once.orderBy("h1", "h2").limit(min(SAMPLE_PER_CELL * cells, max(SAMPLE_ROWS, cells)))
    sample = [r["vec"] for r in picked.select("vec").collect()]
    out = "vector_id string, neighbour_id string, rank_no int"
    if not sample:
        return spark.createDataFrame([], out)
    centroids = fit_centroids(np.frombuffer(b"".join(sample), dtype=np.float32).reshape(-1, dims), cells)
    probes = len(centroids) if probes is None else min(probes, len(centroids))
    shared = spark.sparkContext.broadcast(centroids)

    smallest = Window.partitionBy("h1", "h2").orderBy("id")
    names = (
        usable.filter("target").select("h1", "h2", "id").distinct()
        .withColumn("n", F.row_number().over(smallest)).filter(F.col("n") <= k + 1)
        .groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    )
    distinct = usable.groupBy("h1", "h2").agg(F.first("vec").alias("vec")).join(names, ["h1", "h2"], "left")
    placed = written(distinct.mapInArrow(_home(shared, dims), "h1 bigint, h2 bigint, vec binary, ids array<string>, cell int"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    tile = ["cell", "c_no", "q_no"]
    row = "h1 bigint, h2 bigint, near array<struct<d:double,id:string>>"

    def tiles(asked: DataFrame, first: bool) -> DataFrame:
        """Compare the vectors of ``asked`` with the candidates of their ``cell``, in tiles of bounded size."""
        home = placed.filter("ids is not null").groupBy("cell").agg(F.count("*").alias("c"))
        sizes = asked.groupBy("cell").agg(F.count("*").alias("q")).join(home, "cell", "left" if first else "inner").select(
            "cell",
            F.ceil(F.greatest(F.coalesce("c", F.lit(1)), F.lit(1)) / TILE_CANDIDATES).cast("int").alias("n_c"),
            F.ceil(F.col("q") / TILE_QUERIES).cast("int").alias("n_q"),
        )
        sizes = F.broadcast(written(sizes))  # a row a cell
        candidates = (
            placed.filter("ids is not null").select("cell", "h1", F.col("vec").alias("found"), "ids").join(sizes, "cell")
            .select(F.col("cell").alias("cell"), F.pmod("h1", F.col("n_c")).cast("int").alias("c_no"), upto("n_q").alias("q_no"), F.col("found"), F.col("ids").alias("ids"))
        )
        queries = asked.join(sizes, "cell").withColumn("c_no", upto("n_c")).withColumn("q_no", F.pmod("h2", F.col("n_q")).cast("int")).drop("n_c", "n_q")
        kind = row + (", vec binary, kth double, cell int, c_no int" if first else "")
        return queries.groupBy(*tile).cogroup(candidates.groupBy(*tile)).applyInArrow(_tile(k + 1, dims, rounding, first), kind)

    own = written(tiles(placed.select("cell", "h1", "h2", "vec"), True))
    # where a cell has several candidate tiles, the best of their bounds holds
    bounds = own.filter("c_no > 0").groupBy("h1", "h2").agg(F.max("kth").alias("other"))
    begun = own.filter("c_no = 0").join(bounds, ["h1", "h2"], "left")
    begun = begun.select("cell", "h1", "h2", "vec", F.greatest("kth", F.coalesce("other", F.lit(-1.0))).alias("kth"))
    onward = begun.mapInArrow(_further(shared, probes, dims), "cell int, h1 bigint, h2 bigint, vec binary, kth double")
    near = own.select("h1", "h2", "near").unionByName(tiles(written(onward), False))
    merged = near.groupBy("h1", "h2").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))
    searched = usable.select("id", "h1", "h2").distinct()
    others = searched.join(merged, ["h1", "h2"]).select(
        F.col("id").alias("vector_id"),
        F.posexplode(F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)).alias("pos", "x"),
    )
    return others.select("vector_id", F.col("x.id").alias("neighbour_id"), (F.col("pos") + 1).alias("rank_no"))
