"""The project's tables as the inputs the operators expect: graph, labels, questions, vectors, triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..session import table

# A comma-written triple and a hop within a packed path; the end of one may start the next.
TRIPLE = r"\((Q\d+)\), [^()]*\((P\d+)\), [^()]*(?=\((Q\d+)\))"
HOP = r"\((Q\d+)\) --\[[^()]*\] \((P\d+)\)--> [^()]*(?=\((Q\d+)\))"
DIMS = 64

#: Named inputs, as a data set registry.
DATASETS = ("question_sheet", "context_variants", "similarity_results", "vector_collection", "snomed_parent_child_triples_metadata", "path_runs")


def dataset(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A registered table; an unknown name is an error."""
    if name not in DATASETS:
        raise ValueError(f"unknown dataset {name!r}, expected one of {sorted(DATASETS)}")
    return table(spark, sf_dir, name)


def questions(spark: SparkSession, d: str) -> DataFrame:
    """Question sheet without its repeated rows (same content, other load time)."""
    return table(spark, d, "question_sheet").drop("loaded_at", "asked_at").distinct()


def contexts(spark: SparkSession, d: str) -> DataFrame:
    """``(pair_id, variant, paths)`` without repeated rows."""
    return table(spark, d, "context_variants").select("pair_id", "variant", "paths").distinct()


def edges(spark: SparkSession, d: str) -> DataFrame:
    """``(head, predicate, tail)``: the distinct triples of all packed paths, comma-written or as hops."""
    cells = table(spark, d, "question_sheet").select(F.col("wikidata_paths_llm").alias("c"))
    cells = cells.unionByName(table(spark, d, "context_variants").select(F.col("paths").alias("c")))
    written = lambda pattern: F.arrays_zip(
        *[F.regexp_extract_all("c", F.lit(pattern), F.lit(i)).alias(n) for i, n in enumerate(("head", "predicate", "tail"), 1)]
    )
    hits = cells.filter("c is not null").select(F.explode(F.concat(written(TRIPLE), written(HOP))).alias("m"))
    return hits.select("m.head", "m.predicate", "m.tail").distinct()


def entity_labels(spark: SparkSession, d: str) -> DataFrame:
    """``(id, label)`` of entities with a document or metadata text."""
    rows = table(spark, d, "vector_collection").filter("collection = 'entities' and id is not null")
    label = F.coalesce(F.nullif(F.trim("document"), F.lit("")), F.nullif(F.trim(F.col("metadata")["text"]), F.lit("")))
    return rows.select("id", label.alias("label")).groupBy("id").agg(F.max("label").alias("label")).filter("label is not null")


def property_labels(spark: SparkSession, d: str) -> DataFrame:
    """``(id, label)`` of properties, from the scored relations."""
    scored = table(spark, d, "similarity_results").select(F.explode("similar_relations").alias("r"))
    named = scored.filter("r.id is not null and r.text is not null")
    return named.groupBy(F.col("r.id").alias("id")).agg(F.min("r.text").alias("label"))


def labels(spark: SparkSession, d: str) -> DataFrame:
    return entity_labels(spark, d).unionByName(property_labels(spark, d))


def usable_vectors(spark: SparkSession, d: str, collection: str) -> DataFrame:
    """``(id, v)``: one sound vector for each id of a collection."""
    rows = table(spark, d, "vector_collection").filter((F.col("collection") == collection) & F.col("id").isNotNull())
    return rows.filter(vx.usable(F.col("embedding"), DIMS)).groupBy("id").agg(F.first("embedding").alias("v"))


def question_entities(spark: SparkSession, d: str) -> DataFrame:
    """``(question_id, ids)``: entity ids of each question's cell, in order."""
    cells = questions(spark, d).select("question_id", "wikidata_entities").distinct()
    return cells.select("question_id", F.coalesce(tx.entity_ids(F.col("wikidata_entities")), F.array().cast("array<string>")).alias("ids"))


def triples_3(spark: SparkSession, d: str) -> DataFrame:
    """``(triple_id, head_id, relation_id, tail_id)`` of source 3, repeated rows once."""
    return table(spark, d, "snomed_parent_child_triples_metadata").select("triple_id", "head_id", "relation_id", "tail_id").distinct()
