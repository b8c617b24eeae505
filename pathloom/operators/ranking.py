"""Ranking, labelling and formatting of paths and triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: how many paths of a question remain.
TOP_PATHS = 2


def predicate_vocab(paths: DataFrame, steps: str = "steps") -> DataFrame:
    """Distinct property ids of all paths."""
    step = paths.select(F.explode(steps).alias("x"))
    return step.filter("x.kind = 'predicate'").select(F.col("x.id").alias("predicate")).distinct()


def path_score(steps: Column) -> Column:
    """Number of properties on the path: every one is in the vocabulary of the same paths, so this is its hop count."""
    return F.size(F.filter(steps, lambda x: x["kind"] == "predicate"))


def prune_paths(paths: DataFrame, key: str, score: str, order: list[str], keep: int = TOP_PATHS) -> DataFrame:
    """The best ``keep`` paths of each key by score, then by ``order``, with ``rank_no``."""
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), *order)
    return paths.withColumn("rank_no", F.row_number().over(w)).filter(F.col("rank_no") <= keep)


def label_paths(paths: DataFrame, labels: DataFrame, steps: str = "steps") -> DataFrame:
    """Adds ``text``: ``L (Q) --[L] (P)--> L (Q)``; an id without a label stands for its label.

    ``paths`` must have distinct rows. The distinct steps are labelled, not the
    paths: one join on ids, one aggregation back to the paths.
    """
    columns = paths.columns
    flat = paths.select(*columns, F.posexplode(steps).alias("i", "x"))
    named = flat.join(labels.select(F.col("id").alias("lid"), "label"), F.col("x.id") == F.col("lid"), "left")
    name = F.coalesce("label", "x.id")
    part = F.when(F.col("x.kind") == "entity", F.concat(name, F.lit(" ("), F.col("x.id"), F.lit(")"))).otherwise(
        F.concat(F.lit("--["), name, F.lit("] ("), F.col("x.id"), F.lit(")-->"))
    )
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", part.alias("t")))), lambda s: s["t"]), " ")
    return named.groupBy(*columns).agg(text.alias("text"))


def label_bfs_paths(paths: DataFrame, labels: DataFrame, path: str = "path") -> DataFrame:
    """Adds ``text``: ``S (Q), P (P), T (Q)`` joined by `` -> ``; an id without a label stands for its label."""
    columns = paths.columns
    flat = paths.select(*columns, F.posexplode(path).alias("i", "x"))
    for part in ("source", "prop", "target"):
        lookup = labels.select(F.col("id").alias(f"{part}_id"), F.col("label").alias(f"{part}_label"))
        flat = flat.join(lookup, F.col(f"x.{part}") == F.col(f"{part}_id"), "left")
    one = lambda p: F.concat(F.coalesce(f"{p}_label", f"x.{p}"), F.lit(" ("), F.col(f"x.{p}"), F.lit(")"))
    triple = F.concat_ws(", ", one("source"), one("prop"), one("target"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", triple.alias("t")))), lambda s: s["t"]), " -> ")
    return flat.groupBy(*columns).agg(text.alias("text"))


def joined(rows: DataFrame, key: list[str], order: list[str], text: str, separator: str = " | ") -> DataFrame:
    """Texts of each key in ``order``, joined."""
    pack = F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    return rows.groupBy(*key).agg(F.array_join(F.transform(pack, lambda s: s["_t"]), separator).alias(text))


def label_triples(triples: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds the labels of head, relation and tail (null where there is none) and ``english_triplet``, null unless all are known."""
    out = triples
    for part in ("head", "relation", "tail"):
        lookup = labels.select(F.col("id").alias(f"{part}_id"), F.col("label").alias(f"{part}_label"))
        out = out.join(lookup, f"{part}_id", "left")
    h, r, t = (F.col(f"{p}_label") for p in ("head", "relation", "tail"))
    text = F.concat(F.lit("<"), h, F.lit(", "), r, F.lit(", "), t, F.lit(">"))
    return out.withColumn("english_triplet", text)


def label_worklist(triples: DataFrame) -> DataFrame:
    """Distinct ids of entities and properties in the triples that need a label."""
    ids = triples.select(F.explode(F.array("head_id", "relation_id", "tail_id")).alias("id"))
    return ids.filter(F.col("id").rlike(r"^[QP]\d+$")).distinct()


def valid_triples(triples: DataFrame, strict: bool) -> DataFrame:
    """Triples with ids at all three places; ``strict`` wants entity, property, entity."""
    if strict:
        return triples.filter(F.col("head_id").startswith("Q") & F.col("relation_id").startswith("P") & F.col("tail_id").startswith("Q"))
    filled = [F.col(c).isNotNull() & (F.col(c) != "") for c in ("head_id", "relation_id", "tail_id")]
    return triples.filter(filled[0] & filled[1] & filled[2])


def link_mentions(mentions: DataFrame, labels: DataFrame, key: str | list[str], mention: str = "mention", pos: str = "pos") -> DataFrame:
    """``(key, entity_ids)``, by one key column or several: each mention's smallest id with that label (case and outer blanks aside), unresolved ones dropped."""
    norm = lambda c: F.lower(F.trim(c))
    best = labels.filter("label is not null").groupBy(norm(F.col("label")).alias("m")).agg(F.min("id").alias("entity_id"))
    found = mentions.withColumn("m", norm(F.col(mention))).join(best, "m")
    keys = [key] if isinstance(key, str) else key
    return joined(found.select(*keys, pos, F.col("entity_id").alias("entity_ids")), keys, [pos], "entity_ids", ", ")


def link_top1(mentions: DataFrame, labels: DataFrame, mention: str = "mention") -> DataFrame:
    """``(mention, entity_id)`` of every distinct mention, null where no label equals it."""
    norm = lambda c: F.lower(F.trim(c))
    best = labels.filter("label is not null").groupBy(norm(F.col("label")).alias("m")).agg(F.min("id").alias("entity_id"))
    distinct = mentions.select(mention).distinct()
    return distinct.withColumn("m", norm(F.col(mention))).join(best, "m", "left").select(mention, "entity_id")
