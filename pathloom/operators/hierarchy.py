"""Parent-child links to full hierarchies.

Rounds of bottom-up peeling. Every leaf sends the size of its subtree to its
parent and goes. What remains of long chains would go one node a round, so a
round also takes a share of the nodes that have one child left: the child
takes over the node's size and id and hangs on the node's parent from then on.
Each round takes off a constant share of any tree or cycle, so the rounds are
logarithmic in the number of nodes whatever their shape. A cycle shrinks to a
node that is its own parent and carries the cycle's smallest id. The reverse
order of the rounds hands root, depth and path down again. The last
``LOCAL_NODES`` nodes, a constant however large the whole, are done in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, written

# Relations that state the hierarchy.
CHILD_OF, PARENT_OF = "P9104117", "P9107342"
#: The rounds end when so few nodes are left; these are finished in one task.
LOCAL_NODES = 1000

_FINISHED = "node string, root string, depth int, path string, below bigint, ring boolean"


def _clean(c: Column) -> Column:
    return F.nullif(F.upper(F.regexp_replace(c, r"^\s+|\s+$", "")), F.lit(""))


def hierarchy_links(
    triples: DataFrame,
    head_col: str = "head_id",
    relation_col: str = "relation_id",
    tail_col: str = "tail_id",
    child_of: str = CHILD_OF,
    parent_of: str = PARENT_OF,
) -> DataFrame:
    """Distinct ``(child, parent)`` links of both directions, ids trimmed and in upper case.

    Rows with a null or blank end and rows of other or null relations are no
    links. If a child has several parents, the smallest in string order holds
    and ``other_parents`` gives the rest.
    """
    stated = _stated(triples, head_col, relation_col, tail_col, child_of, parent_of)
    return stated.groupBy("child").agg(F.min("parent").alias("parent"))


def other_parents(triples: DataFrame, **names: str) -> DataFrame:
    """Distinct ``(child, parent)`` links that ``hierarchy_links`` leaves out, as their child has a smaller parent too; parameters like there."""
    columns = {"head_col": "head_id", "relation_col": "relation_id", "tail_col": "tail_id", "child_of": CHILD_OF, "parent_of": PARENT_OF}
    return _stated(triples, **{**columns, **names}).distinct().join(hierarchy_links(triples, **names), ["child", "parent"], "left_anti")


def _stated(triples: DataFrame, head_col: str, relation_col: str, tail_col: str, child_of: str, parent_of: str) -> DataFrame:
    """Every ``(child, parent)`` that a row states."""
    head, tail = _clean(F.col(head_col)), _clean(F.col(tail_col))
    up = _clean(F.col(relation_col)) == child_of
    return (
        triples.filter(_clean(F.col(relation_col)).isin(child_of, parent_of))
        .select(F.when(up, head).otherwise(tail).alias("child"), F.when(up, tail).otherwise(head).alias("parent"))
        .filter("child is not null and parent is not null")
    )


def _start(links: DataFrame) -> DataFrame:
    """The state of every id before the first round.

    ``open`` counts the children left, ``below`` the nodes known below. ``via``
    and ``hops`` are the nodes taken out between a node and its present parent,
    ``extra`` their number with all that hangs on them, ``low`` the smallest id
    among the node and them.
    """
    own = links.select(F.col("child").alias("node"), "parent", F.lit(0).cast("long").alias("open"))
    above = links.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("open"))
    above = above.select("node", F.lit(None).cast("string").alias("parent"), "open")
    merged = own.unionByName(above).groupBy("node").agg(F.max("parent").alias("parent"), F.sum("open").alias("open"))
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    return merged.select("*", zero.alias("below"), zero.alias("extra"), none.alias("via"), F.lit(0).alias("hops"), F.col("node").alias("low"))


_STATE = ("node", "parent", "open", "below", "extra", "via", "hops", "low")


def _round(state: DataFrame, number: int) -> DataFrame:
    """One round: the nodes with children after their leaves have gone.

    Nodes with ``gone`` leave the tree between their child and their parent;
    ``out`` of that child's row is what placing them again takes. Of two
    neighbours at most one goes, by a coin that each round tosses anew.
    """
    leaves = state.filter("open = 0 and parent is not null")
    sent = leaves.groupBy(F.col("parent").alias("node")).agg(F.sum(F.col("below") + 1 + F.col("extra")).alias("got"), F.count("*").alias("children"))
    rest = state.filter("open > 0").join(sent, "node", "left")
    rest = rest.withColumns(
        {"open": F.col("open") - F.coalesce("children", F.lit(0)), "below": F.col("below") + F.coalesce("got", F.lit(0))}
    ).drop("got", "children")
    coin = lambda c: F.xxhash64(c, F.lit(number)).bitwiseAND(1)
    gone = F.coalesce((F.col("open") == 1) & (F.col("parent") != F.col("node")) & (coin("node") == 1) & (coin("parent") == 0), F.lit(False))
    rest = rest.withColumn("gone", gone)
    c = rest.alias("c")
    v = rest.filter("gone").select(F.col("node").alias("at"), F.struct(*_STATE).alias("v"))
    joined = c.join(v, F.col("c.parent") == F.col("at"), "left")
    out = F.when(F.col("at").isNotNull(), F.struct("v.node", "v.parent", "v.below", "v.via", "v.hops", F.col("c.node").alias("child"), F.col("c.extra").alias("between")))
    return joined.select(
        "c.node",
        F.when(F.col("at").isNull(), F.col("c.parent")).otherwise(F.col("v.parent")).alias("parent"),
        "c.open",
        "c.below",
        (F.col("c.extra") + F.coalesce(F.col("v.below") + 1 + F.col("v.extra"), F.lit(0))).alias("extra"),
        F.when(F.col("at").isNull(), F.col("c.via")).otherwise(F.concat_ws("/", "v.via", "at", "c.via")).alias("via"),
        (F.col("c.hops") + F.coalesce(F.col("v.hops") + 1, F.lit(0))).alias("hops"),
        F.least("c.low", "v.low").alias("low"),
        "c.gone",
        out.alias("out"),
    )


def _finish_locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Peel a bounded rest to the end and assign root, depth and path from the top."""
    state: dict[str, dict] = {}
    for batch in batches:
        state.update((row["node"], row) for row in batch.to_pylist())
    children: dict[str, list[str]] = {}
    for node, row in state.items():
        if row["parent"] is not None:
            children.setdefault(row["parent"], []).append(node)
    unpeeled = {node: len(children.get(node, ())) for node in state}
    order = [node for node, n in unpeeled.items() if n == 0]
    for node in order:  # grows while it is read
        row = state[node]
        up = row["parent"]
        if up is not None:
            state[up]["below"] += row["below"] + 1 + row["extra"]
            unpeeled[up] -= 1
            if unpeeled[up] == 0:
                order.append(up)
    peeled = set(order)
    rows: list[dict] = []
    size = 0

    def batch_of() -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.bool_())
        names = ["node", "root", "depth", "path", "below", "ring"]
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names=names)

    def placed(node: str, root: str, depth: int, path: str, ring: bool = False) -> dict:
        return {"node": node, "root": root, "depth": depth, "path": path, "below": state[node]["below"], "ring": ring}

    def walk(top: dict):
        """The peeled nodes below ``top``; their paths are held only as far as they still wait."""
        stack = [top]
        while stack:
            at = stack.pop()
            yield at
            for c in children.get(at["node"], ()):
                if c in peeled:
                    row = state[c]
                    looped = at["depth"] < 0
                    path = "" if looped else "/".join(x for x in (at["path"], row["via"], c) if x)
                    stack.append(placed(c, at["root"], -1 if looped else at["depth"] + row["hops"] + 1, path))

    def results():
        for node in order:
            if state[node]["parent"] is None:
                yield from walk(placed(node, node, 0, node))
        done: set[str] = set()
        for node in state:
            if node in peeled or node in done:
                continue
            ring = [node]
            while state[ring[-1]]["parent"] != node:
                ring.append(state[ring[-1]]["parent"])
            done.update(ring)
            root = min(state[m]["low"] for m in ring)
            total = sum(state[m]["below"] + 1 + state[m]["extra"] for m in ring)
            for m in ring:
                state[m]["below"] = total - 1
            for m in ring:
                yield from walk(placed(m, root, -1, "", True))

    for row in results():
        rows.append(row)
        size += len(row["path"]) + 64
        if size > 8 << 20:
            yield batch_of()
            rows, size = [], 0
    yield batch_of()


def _placed(level: DataFrame, done: DataFrame, spliced: bool) -> DataFrame:
    """Nodes of one round under their parents in ``done``; ``spliced`` ones lie between such a parent and their child."""
    top = done.select(F.col("node").alias("parent"), "root", F.col("depth").alias("d"), F.col("path").alias("above"))
    below, ring = F.col("below"), F.lit(False)
    if spliced:
        child = done.select(F.col("node").alias("child"), F.col("below").alias("under"), F.col("ring").alias("on_ring"))
        level = level.join(child, "child")
        below = F.when(F.col("on_ring"), F.col("under")).otherwise(F.col("below") + 1 + F.col("between") + F.col("under"))
        ring = F.col("on_ring")
    in_tree = F.col("d") >= 0
    return level.join(top, "parent").select(
        "node",
        "root",
        F.when(in_tree, F.col("d") + F.col("hops") + 1).otherwise(-1).cast("int").alias("depth"),
        F.when(in_tree, F.concat_ws("/", "above", "via", "node")).otherwise("").alias("path"),
        below.alias("below"),
        ring.alias("ring"),
    )


def build_hierarchy(links: DataFrame, local_nodes: int = LOCAL_NODES) -> DataFrame:
    """``(node_id, root_id, depth, node_path, n_descendants)`` of every id in ``(child, parent)`` links.

    Nodes on or below a cycle (a self-link is one) have the cycle's smallest
    id as root, depth -1 and the empty path. ``n_descendants`` counts the
    distinct other nodes below. No links give no rows. A child must have one
    parent, as ``hierarchy_links`` sees to. ``local_nodes`` bounds the rest one
    task may take; with 0 the rounds go on to the end.
    """
    state = written(_start(links))
    rounds: list[tuple[DataFrame, DataFrame]] = []  # leaves and spliced nodes of each round
    finished = "parent is null and open = 0 or parent = node and open = 1"
    while True:
        left = state.agg(F.count("*").alias("n"), F.count_if(F.expr(finished)).alias("over")).first()
        if left["n"] <= local_nodes or left["n"] == left["over"]:
            break
        after = written(_round(state, len(rounds)))
        rounds.append((state.filter("open = 0"), after.filter("out is not null").select("out.*")))
        state = after.filter("not gone").select(*_STATE)
    if left["n"] <= local_nodes:
        done = state.coalesce(1).mapInArrow(_finish_locally, _FINISHED)
    else:
        tree = F.col("parent").isNull()
        done = state.select(
            "node",
            F.when(tree, F.col("node")).otherwise(F.col("low")).alias("root"),
            F.when(tree, 0).otherwise(-1).cast("int").alias("depth"),
            F.when(tree, F.col("node")).otherwise("").alias("path"),
            (F.col("below") + F.col("extra")).alias("below"),
            (~tree).alias("ring"),
        )
    if rounds:
        done = written(done)
    for n, (leaves, spliced) in enumerate(reversed(rounds), 1):
        # one table of all that is placed, written anew: a round adds a constant share, so all of them write a multiple of the last
        done = done.unionByName(written(_placed(spliced, done, True)))
        tops = leaves.filter("parent is null").select(
            "node", F.col("node").alias("root"), F.lit(0).alias("depth"), F.col("node").alias("path"), "below", F.lit(False).alias("ring")
        )
        done = done.unionByName(_placed(leaves, done, False)).unionByName(tops)
        done = done if n == len(rounds) else written(done)
    return done.select(
        F.col("node").alias("node_id"),
        F.col("root").alias("root_id"),
        "depth",
        F.col("path").alias("node_path"),
        F.col("below").alias("n_descendants"),
    )


def descendant_pairs(hierarchy: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """``(node_id, descendant_id)``: every node with each distinct other node below it, one row each.

    Ancestors in trees are those on the path; on and below cycles they follow
    the ``(child, parent)`` ``links`` the hierarchy is of. Without ``links`` a
    node with descendants on or below a cycle is an error.
    """
    ids = F.split("node_path", "/")
    in_trees = hierarchy.filter("depth > 0").select(
        F.explode(F.slice(ids, 1, F.size(ids) - 1)).alias("node_id"), F.col("node_id").alias("descendant_id")
    )
    if links is None:
        if hierarchy.filter("depth < 0 and n_descendants > 0").limit(1).count():
            raise ValueError("the hierarchy has cycles, their descendants need its links")
        return in_trees
    looped = hierarchy.filter("depth < 0").select(F.col("node_id").alias("child"))
    pairs = cut(links.join(looped, "child", "left_semi").select(F.col("parent").alias("node_id"), F.col("child").alias("descendant_id")).distinct())
    last, n = -1, pairs.count()
    while n != last:  # each round doubles the reach
        up, down = pairs.alias("up"), pairs.alias("down")
        further = up.join(down, F.col("up.descendant_id") == F.col("down.node_id")).select("up.node_id", "down.descendant_id")
        pairs = cut(pairs.unionByName(further).distinct())
        last, n = n, pairs.count()
    return in_trees.unionByName(pairs.filter("node_id <> descendant_id"))
