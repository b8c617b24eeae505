"""Graph operators over ``edges(head, predicate, tail)``: capped edges, entity pairs, path patterns, bounded BFS.

Everything is equi-joins on edge keys; skewed hubs are left to adaptive skew
joins and, where a cap is part of the operator, cut by ``row_number`` filters
that Spark applies in part before its shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

# The caps that define the operators' results.
CLAIMS_PER_PROPERTY, EDGES_PER_NODE = 5, 50
PAIR_ENTITIES, BFS_ENTITIES = 10, 3
PATHS_PER_PAIR, BFS_DEPTH, BFS_PATHS = 100, 3, 5


def capped_edges(edges: DataFrame, claims: int = CLAIMS_PER_PROPERTY, per_node: int = EDGES_PER_NODE) -> DataFrame:
    """``(head, predicate, tail, edge_ord)``: the first claims of each property, then the first edges of each node.

    Order: property, then tail. Repeated edges count once.
    """
    first = Window.partitionBy("head", "predicate").orderBy("tail")
    node = Window.partitionBy("head").orderBy("predicate", "tail")
    kept = edges.select("head", "predicate", "tail").distinct().withColumn("c", F.row_number().over(first)).filter(F.col("c") <= claims)
    return kept.withColumn("edge_ord", F.row_number().over(node)).filter(F.col("edge_ord") <= per_node).drop("c")


def entity_pairs(lists: DataFrame, key: str, ids: str, first: int = PAIR_ENTITIES) -> DataFrame:
    """``(key, pair_ord, s, e)``: unordered pairs of the first entities of each list, in list order; ids may repeat."""
    head = F.slice(F.col(ids), 1, first)
    pairs = F.flatten(
        F.transform(head, lambda a, i: F.transform(F.slice(head, i + 2, F.lit(first)), lambda b: F.struct(a.alias("s"), b.alias("e"))))
    )
    rows = lists.filter(F.size(ids) >= 2).select(F.col(key), F.posexplode(pairs).alias("pair_ord", "p"))
    return rows.select(key, "pair_ord", F.col("p.s").alias("s"), F.col("p.e").alias("e"))


def _capped(paths: DataFrame, order: list[str], limit: int) -> DataFrame:
    pair = Window.partitionBy("s", "e").orderBy(*order)
    return paths.distinct().withColumn("n", F.row_number().over(pair)).filter(F.col("n") <= limit).drop("n")


def _out(edges: DataFrame, n: int) -> DataFrame:
    """Edges under the column names ``h<n> p<n> t<n>``."""
    return edges.select(F.col("head").alias(f"h{n}"), F.col("predicate").alias(f"p{n}"), F.col("tail").alias(f"t{n}"))


def paths_1hop(pairs: DataFrame, edges: DataFrame, limit: int = PATHS_PER_PAIR) -> DataFrame:
    """``(s, e, p1)``: an edge either way, or one property over a node in between from e to s."""
    pairs = pairs.select("s", "e").distinct()
    a = _out(edges, 1)
    forward = pairs.join(a, (F.col("s") == F.col("h1")) & (F.col("e") == F.col("t1"))).select("s", "e", "p1")
    back = pairs.join(a, (F.col("e") == F.col("h1")) & (F.col("s") == F.col("t1"))).select("s", "e", "p1")
    same = (
        pairs.join(a, F.col("t1") == F.col("s"))
        .join(_out(edges, 2), (F.col("h2") == F.col("e")) & (F.col("t2") == F.col("h1")) & (F.col("p2") == F.col("p1")))
        .select("s", "e", "p1")
    )
    return _capped(forward.unionByName(back).unionByName(same), ["p1"], limit)


def paths_2hop(pairs: DataFrame, edges: DataFrame, limit: int = PATHS_PER_PAIR) -> DataFrame:
    """``(s, e, p1, m1, p2)``: s to m to e, e to m to s, or m to both; m is neither end."""
    pairs = pairs.select("s", "e").distinct()
    a, b = _out(edges, 1), _out(edges, 2)
    inner = (F.col("m1") != F.col("s")) & (F.col("m1") != F.col("e"))

    def branch(start: str, end: str, shared: bool) -> DataFrame:
        first = F.col("t1" if shared else "h1") == F.col(start)
        middle = F.col("h1" if shared else "t1")
        return (
            pairs.join(a, first)
            .withColumn("m1", middle)
            .filter(inner)
            .join(b, (F.col("h2") == F.col("m1")) & (F.col("t2") == F.col(end)))
            .select("s", "e", "p1", "m1", "p2")
        )

    found = branch("s", "e", False).unionByName(branch("e", "s", False)).unionByName(branch("s", "e", True))
    return _capped(found, ["p1", "m1", "p2"], limit)


def paths_3hop(pairs: DataFrame, edges: DataFrame, limit: int = PATHS_PER_PAIR) -> DataFrame:
    """``(s, e, p1, m1, p2, m2, p3)``: a chain from s to e, or one from e to s in either order of writing.

    The last two edges are joined once for each end, not for each pair; the
    first edge of a pair meets them on both its inner node and the pair's end.
    """
    pairs = pairs.select("s", "e").distinct()
    both = pairs.unionByName(pairs.select(F.col("e").alias("s"), F.col("s").alias("e"))).distinct()
    inner = lambda m: (F.col(m) != F.col("s")) & (F.col(m) != F.col("e"))
    first = both.join(_out(edges, 1), F.col("h1") == F.col("s")).withColumnRenamed("t1", "m1").filter(inner("m1"))
    last = _out(edges, 3).join(both.select(F.col("e").alias("t3")).distinct(), "t3", "left_semi")
    ending = _out(edges, 2).join(last, F.col("h3") == F.col("t2")).withColumnRenamed("t2", "m2")
    third = first.join(ending, (F.col("h2") == F.col("m1")) & (F.col("t3") == F.col("e"))).filter(inner("m2"))
    chains = written(third.select("s", "e", "p1", "m1", "p2", "m2", "p3"))  # read three times
    forward = chains.join(pairs, ["s", "e"], "left_semi")
    turned = chains.select(F.col("e").alias("s"), F.col("s").alias("e"), "p1", "m1", "p2", "m2", "p3").join(pairs, ["s", "e"], "left_semi")
    mirrored = turned.select(
        "s", "e", F.col("p3").alias("p1"), F.col("m2").alias("m1"), "p2", F.col("m1").alias("m2"), F.col("p1").alias("p3")
    )
    return _capped(forward.unionByName(turned).unionByName(mirrored), ["p1", "m1", "p2", "m2", "p3"], limit)


def _steps(names: list[str]) -> Column:
    kinds = ["entity" if i % 2 == 0 else "predicate" for i in range(len(names))]
    return F.array(*[F.struct(F.lit(k).alias("kind"), F.col(n).alias("id")) for k, n in zip(kinds, names)])


def find_paths(pairs: DataFrame, edges: DataFrame, max_hops: int = 3, limit: int = PATHS_PER_PAIR) -> DataFrame:
    """``(s, e, hops, steps)``: distinct paths of each distinct pair up to ``max_hops``, as arrays of (kind, id)."""
    if not 1 <= max_hops <= 3:
        raise ValueError("max_hops is 1, 2 or 3")
    parts = [
        (paths_1hop, ["s", "p1", "e"]),
        (paths_2hop, ["s", "p1", "m1", "p2", "e"]),
        (paths_3hop, ["s", "p1", "m1", "p2", "m2", "p3", "e"]),
    ]
    found = None
    pairs = written(pairs.select("s", "e").distinct())  # read by every branch of every search
    for hops, (search, names) in enumerate(parts[:max_hops], 1):
        part = search(pairs, edges, limit).select("s", "e", F.lit(hops).alias("hops"), _steps(names).alias("steps"))
        found = part if found is None else found.unionByName(part)
    return found


def path_key(steps: Column) -> Column:
    """The ids of a path, joined by ``|``."""
    return F.array_join(F.transform(steps, lambda x: x["id"]), "|")


def _base(depth: int, per_node: int) -> int:
    """The base in which a walk's edge ordinals are digits, so that the order of walks is that of numbers."""
    if (per_node + 1) ** depth >= 2**63:
        raise ValueError(f"walks of {depth} edges with {per_node} ordinals a node do not fit a bigint")
    return per_node + 1


def _walked(found: DataFrame, step: DataFrame, depth: int, base: int, keys: list[str]) -> DataFrame:
    """``s``, ``keys`` and the ``path`` of walks of ``depth`` edges: the edges behind the digits of ``walk``, from ``s`` on."""
    kind = "array<struct<source:string,target:string,prop:string>>"
    rows = found.withColumn("at", F.col("s")).withColumn("path", F.array().cast(kind))
    for n in range(depth):
        digit = F.expr(f"walk div {base ** (depth - 1 - n)}L % {base}L").cast("int")
        triple = F.struct(F.col("h").alias("source"), F.col("tail").alias("target"), F.col("predicate").alias("prop"))
        rows = (
            rows.withColumn("edge", digit)
            .join(step, (F.col("at") == F.col("h")) & (F.col("edge") == F.col("edge_ord")))
            .select("s", *keys, "walk", F.col("tail").alias("at"), F.concat("path", F.array(triple)).alias("path"))
        )
    return rows.select("s", *keys, "path")


def bfs_pair_paths(pairs: DataFrame, capped: DataFrame, max_depth: int = BFS_DEPTH, per_node: int = EDGES_PER_NODE) -> DataFrame:
    """``(s, e, depth, path)``: the path a bounded breadth-first search from s finds first at e, as triples.

    First in queue order means least in the order of the edge ordinals along
    the path, among the shortest paths; so each level is the join of the walks
    of still open pairs with the capped edges, kept down to the least walk per
    (s, node). A walk is one number, its ordinals the digits, and its edges are
    looked up for found paths only. A pair of equal ends has no path.
    ``per_node`` is the cap the edges were made with.
    """
    base = _base(max_depth, per_node)
    open_ = pairs.select("s", "e").distinct().filter("s <> e")
    step = capped.select(F.col("head").alias("h"), "predicate", "tail", "edge_ord")
    lean = step.drop("predicate")
    walks = open_.select("s").distinct().select("s", F.col("s").alias("node"), F.lit(0).cast("long").alias("walk"))
    grown = F.col("walk") * base + F.col("edge_ord")
    found = None
    for depth in range(1, max_depth + 1):
        # the last edge is joined on both of its ends, so the widest level is never spread out
        last = open_.join(walks, "s").join(lean, (F.col("node") == F.col("h")) & (F.col("e") == F.col("tail")))
        hit = last.groupBy("s", "e").agg(F.min(grown).alias("walk"))
        hit = written(hit) if depth < max_depth else hit  # what is read twice
        part = _walked(hit, step, depth, base, ["e"]).select("s", "e", F.lit(depth).alias("depth"), "path")
        found = part if found is None else found.unionByName(part)
        if depth < max_depth:
            open_ = open_.join(hit.select("s", "e"), ["s", "e"], "left_anti")
            onward = walks.join(open_.select("s").distinct(), "s", "left_semi").join(lean, F.col("node") == F.col("h"))
            walks = onward.groupBy("s", F.col("tail").alias("node")).agg(F.min(grown).alias("walk"))
            walks = written(walks) if depth < max_depth - 1 else walks
    return found


def bfs_single_paths(
    starts: DataFrame, capped: DataFrame, depth: int = BFS_DEPTH, limit: int = BFS_PATHS, per_node: int = EDGES_PER_NODE
) -> DataFrame:
    """``(s, path_no, path)``: the first ``limit`` paths of exactly ``depth`` edges of a breadth-first search from s.

    A node is reached once, by its first path in queue order; nodes reached at
    an earlier level are not reached again. See ``bfs_pair_paths`` for walks.
    """
    base = _base(depth, per_node)
    step = capped.select(F.col("head").alias("h"), "predicate", "tail", "edge_ord")
    frontier = starts.select("s").distinct().select("s", F.col("s").alias("node"), F.lit(0).cast("long").alias("walk"))
    visited = frontier.select("s", "node")
    for level in range(depth):
        onward = frontier.join(step.drop("predicate"), F.col("node") == F.col("h"))
        onward = onward.select("s", F.col("tail").alias("node"), (F.col("walk") * base + F.col("edge_ord")).alias("walk"))
        frontier = onward.groupBy("s", "node").agg(F.min("walk").alias("walk")).join(visited, ["s", "node"], "left_anti")
        if level < depth - 1:
            frontier = written(frontier)
            visited = visited.unionByName(frontier.select("s", "node"))
    order = Window.partitionBy("s").orderBy("walk")
    first = frontier.withColumn("path_no", F.row_number().over(order)).filter(F.col("path_no") <= limit)
    return _walked(first.select("s", "path_no", "walk"), step, depth, base, ["path_no"])
