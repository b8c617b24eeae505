"""Records of graph nodes: labels and descriptions by language, claims in document order.

A record is JSON with ``labels`` and ``descriptions`` (language to ``value``)
and ``claims`` (property to a list of claims, whose ``mainsnak.datavalue`` has a
``type`` and a ``value``). Positions in the record are kept, since the caps on
claims go by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import CLAIMS_PER_PROPERTY, EDGES_PER_NODE

# The type of claims that point to a node, the properties whose objects say what a node is, how many of each.
ENTITY_TYPE = "wikibase-entityid"
TYPE_PROPERTIES, TYPES_PER_PROPERTY = ("P31", "P279"), 3

_TEXTS = "map<string,struct<value:string>>"
_CLAIMS = "map<string,array<struct<mainsnak:struct<datavalue:struct<type:string,value:string>>>>>"
_NODE = f"struct<labels:{_TEXTS},descriptions:{_TEXTS},claims:{_CLAIMS}>"


def read_nodes(records: DataFrame, id_col: str = "id", record_col: str = "record") -> DataFrame:
    """``(id, labels, descriptions, claims)`` of JSON records; a null or broken record leaves all three null.

    A claim that does not have the expected shape is null by itself, the rest
    of its record stays.
    """
    return records.select(F.col(id_col).alias("id"), F.from_json(F.col(record_col), _NODE).alias("n")).select("id", "n.labels", "n.descriptions", "n.claims")


def fetch_nodes(ids: DataFrame, nodes: DataFrame, id_col: str = "id") -> DataFrame:
    """The nodes of the distinct ``ids``, with nulls where there is no record."""
    wanted = ids.select(F.col(id_col).alias("id")).filter("id is not null").distinct()
    return wanted.join(nodes, "id", "left")


def _text(texts: Column, language: str) -> Column:
    """The text in ``language``, else the first one that is not blank; null if there is none."""
    filled = F.filter(F.map_values(texts), lambda t: F.coalesce(F.trim(t["value"]) != "", F.lit(False)))
    own = F.nullif(F.trim(texts[language]["value"]), F.lit(""))
    return F.coalesce(own, F.trim(F.get(filled, F.lit(0))["value"]))


def node_labels(nodes: DataFrame, language: str = "en", any_language: bool = True) -> DataFrame:
    """``(id, label)``: in ``language``, else in the first language there is unless ``any_language`` is off; null without one."""
    own = F.nullif(F.trim(F.col("labels")[language]["value"]), F.lit(""))
    return nodes.select("id", (_text(F.col("labels"), language) if any_language else own).alias("label"))


def node_texts(nodes: DataFrame, language: str = "en") -> DataFrame:
    """``(id, full_text)``: ``label. description.``, each in ``language`` or else in the first one; the id if both are missing."""
    a, b = (F.coalesce(_text(F.col(c), language), F.lit("")) for c in ("labels", "descriptions"))
    return nodes.select("id", F.when((a == "") & (b == ""), F.col("id")).otherwise(F.concat(a, F.lit(". "), b, F.lit("."))).alias("full_text"))


def node_claims(nodes: DataFrame) -> DataFrame:
    """``(head, predicate, prop_ord, claim_ord, is_entity, tail)``: every claim, positions from 0; ``tail`` is null where none is named."""
    props = nodes.select(F.col("id").alias("head"), F.posexplode(F.map_entries("claims")).alias("prop_ord", "p"))
    claims = props.select("head", F.col("p.key").alias("predicate"), "prop_ord", F.posexplode("p.value").alias("claim_ord", "c"))
    value = F.col("c.mainsnak.datavalue")
    tail = F.nullif(F.get_json_object(value["value"], "$.id"), F.lit(""))
    is_entity = F.coalesce(value["type"] == ENTITY_TYPE, F.lit(False)) & tail.isNotNull()
    return claims.select("head", "predicate", "prop_ord", "claim_ord", is_entity.alias("is_entity"), tail.alias("tail"))


def capped_claims(claims: DataFrame, per_property: int = CLAIMS_PER_PROPERTY, per_node: int = EDGES_PER_NODE) -> DataFrame:
    """``(head, predicate, tail, edge_ord)``: of the first claims of each property those that point to a node, the first of each node.

    The first claims are counted before the test of their type, as the record
    has them; ``edge_ord`` counts the kept edges of a node from 1.
    """
    node = Window.partitionBy("head").orderBy("prop_ord", "claim_ord")
    kept = claims.filter((F.col("claim_ord") < per_property) & F.col("is_entity"))
    return kept.withColumn("edge_ord", F.row_number().over(node)).filter(F.col("edge_ord") <= per_node).select("head", "predicate", "tail", "edge_ord")


def type_labels(
    labels: DataFrame, claims: DataFrame, types: tuple[str, ...] = TYPE_PROPERTIES, per_type: int = TYPES_PER_PROPERTY
) -> DataFrame:
    """``(id, labels)`` of each id of ``labels`` (id, label): its label, or else its id, then the objects of its type properties.

    Of each property in ``types``, in that order, the first claims that have an
    object count. At most ``per_type`` of each, so a list stays short.
    """
    rank = F.create_map(*[x for n, t in enumerate(types) for x in (F.lit(t), F.lit(n))])
    first = claims.filter(F.col("predicate").isin(*types) & (F.col("claim_ord") < per_type) & F.col("tail").isNotNull())
    pack = F.sort_array(F.collect_list(F.struct(rank[F.col("predicate")].alias("p"), "claim_ord", "tail")))
    objects = first.groupBy(F.col("head").alias("id")).agg(F.transform(pack, lambda x: x["tail"]).alias("objects"))
    name = F.array(F.coalesce("label", "id"))
    return labels.join(objects, "id", "left").select("id", F.concat(name, F.coalesce("objects", F.array().cast("array<string>"))).alias("labels"))
