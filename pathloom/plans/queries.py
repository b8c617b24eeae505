"""Registry of the core queries: each takes (spark, data folder) and returns a DataFrame over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import graph, hierarchy, matching, nested, packed, ranking, search
from ..session import table, written
from ..sources import catalog as cat
from ..sources import files, nodes
from .oracle import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# General data problems


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every value of the packed fields in a row of its own."""
    fields = ("wikidata_entities", "wikidata_paths_llm", "paths")
    none = F.lit(None).cast("string")
    sheet = table(spark, d, "question_sheet").select("pair_id", F.lit("").alias("variant"), *fields[:2], none.alias("paths"))
    variants = table(spark, d, "context_variants").select(
        "pair_id", F.coalesce("variant", F.lit("")).alias("variant"), *[none.alias(f) for f in fields[:2]], "paths"
    )
    keep = {"wikidata_entities": "entity", "wikidata_paths_llm": "path", "paths": "path"}
    return packed.split_packed(sheet.unionByName(variants), keep)


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Root, depth, path and number of descendants of every node."""
    return hierarchy.build_hierarchy(hierarchy.hierarchy_links(table(spark, d, "snomed_parent_child_triples_metadata")))


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Every step of every raw path with the run, question and path it belongs to."""
    steps = nested.flatten_runs(table(spark, d, "path_runs"), "steps")
    return steps.select("run_id", "max_hops", "question_id", "path_no", "step_no", "kind", "member_id")


# Sources


@query
def load_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entry lines (id, tab, text) to rows; lines without a tab drop out."""
    rows = table(spark, d, "vector_collection").filter("collection = 'entities'")
    return files.parse_entries(rows.select(F.concat_ws("\t", "id", F.nullif("document", F.lit(""))).alias("value"))).distinct()


@query
def scan_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Every vector with its length and norm."""
    rows = files.require_columns(table(spark, d, "embeddings"), "vec_id", "embedding")
    return rows.select("vec_id", F.size("embedding").alias("dims"), F.round(vx.norm(F.col("embedding")), 4).alias("norm"))


def _source_2(spark: SparkSession, d: str) -> DataFrame:
    """Source 2: the graph's triples, indexed by their order."""
    rows = files.index_rows(cat.edges(spark, d), ["head", "predicate", "tail"], "i")
    return rows.select(
        F.concat(F.lit("triplet2_"), F.col("i").cast("string")).alias("triple_id"),
        F.col("head").alias("head_id"), F.col("predicate").alias("relation_id"), F.col("tail").alias("tail_id"),
    )


def _sources(spark: SparkSession, d: str) -> DataFrame:
    two = _source_2(spark, d).withColumn("source", F.lit(2))
    return two.unionByName(cat.triples_3(spark, d).withColumn("source", F.lit(3)))


@query
def triple_sources_union(spark: SparkSession, d: str) -> DataFrame:
    """Triples of both sources with the ordinal of their source."""
    return _sources(spark, d)


@query
def normalize_paths(spark: SparkSession, d: str) -> DataFrame:
    """Path cells as lists: null, single text or JSON list."""
    listed = cat.contexts(spark, d).withColumn("list", tx.normalise_paths(F.col("paths")))
    return listed.select("pair_id", "variant", F.size("list").alias("n_paths"), F.get("list", F.lit(0)).alias("first_path"))


@query
def full_text(spark: SparkSession, d: str) -> DataFrame:
    """Label and description of every entity as one text."""
    rows = table(spark, d, "vector_collection").filter("collection = 'entities' and id is not null")
    text = tx.full_text(F.col("metadata")["text"], F.col("document"), F.col("id"))
    return rows.select("id", text.alias("full_text")).distinct()


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    """(pair_id, variant, pos, mention) of all triple contexts: their members, as a model would list them."""
    cells = cat.contexts(spark, d).filter(F.col("variant").isin(*TRIPLE_VARIANTS) & F.col("paths").isNotNull())
    plain = F.regexp_replace("paths", r"""[<>"'\[\]|;\r\n\t]+""", ",")
    return cells.select("pair_id", "variant", F.posexplode(tx.parse_mentions(plain)).alias("pos", "mention"))


@query
def entity_link_top1(spark: SparkSession, d: str) -> DataFrame:
    """The entity of every distinct mention."""
    return ranking.link_top1(_mentions(spark, d), cat.entity_labels(spark, d))


@query
def enumerate_ids(spark: SparkSession, d: str) -> DataFrame:
    """All entity ids in order with their page of 500."""
    return files.id_page(table(spark, d, "vector_collection").filter("collection = 'entities'"), prefix="Q")


# Sinks


@query
def collection_ids(spark: SparkSession, d: str) -> DataFrame:
    """Row ids of a collection upload."""
    ids = table(spark, d, "vector_collection").filter("id is not null").select("collection", "id").distinct()
    return files.collection_rows(ids).select("collection", "id", "row_id")


def _ranked_relations(spark: SparkSession, d: str) -> DataFrame:
    """(question_id, rank_no, id, text, score): the ten best scored relations of every question."""
    r = table(spark, d, "similarity_results").filter("question_id is not null").select("question_id", F.explode("similar_relations").alias("r"))
    sound = r.filter("r.id is not null and r.score is not null and not isnan(r.score)")
    best = sound.groupBy("question_id", F.col("r.id").alias("id")).agg(F.max("r.score").alias("score"), F.min("r.text").alias("text"))
    order = Window.partitionBy("question_id").orderBy(F.col("score").desc(), "id")
    return best.withColumn("rank_no", F.row_number().over(order)).filter("rank_no <= 10")


@query
def result_json(spark: SparkSession, d: str) -> DataFrame:
    """The ranked relations of a question as one JSON record."""
    pack = F.sort_array(F.collect_list(F.struct(F.col("rank_no").alias("rank"), "id")))
    rows = _ranked_relations(spark, d).groupBy("question_id").agg(pack.alias("results"))
    return rows.select("question_id", F.to_json(F.struct("question_id", "results")).alias("record"))


@query
def similarity_report(spark: SparkSession, d: str) -> DataFrame:
    """The ranked relations of a question as report lines."""
    return files.similarity_report(_ranked_relations(spark, d))


# Projections and filters


@query
def generate_questions(spark: SparkSession, d: str) -> DataFrame:
    """The matching question of every pair."""
    q = tx.generate_question(F.col("src_attr"), F.col("src_desc"), F.col("tgt_attr"), F.col("tgt_desc"))
    return table(spark, d, "question_sheet").select("pair_id", q.alias("question")).distinct()


VARIANTS = ("entity_bfs", "entity_bfs_top1", "kg_triples", "kg_triples_top1", "kg_triples_top2", "llm_paths", "vector_bfs", "vector_bfs_top1", "vector_bfs_top2")
TRIPLE_VARIANTS = tuple(v for v in VARIANTS if v.startswith("kg_triples"))


def select_variant(contexts: DataFrame, variant: str) -> DataFrame:
    """Rows of one context variant; an unknown name is an error."""
    if variant not in VARIANTS:
        raise ValueError(f"unknown context variant {variant!r}, expected one of {sorted(VARIANTS)}")
    return contexts.filter(F.col("variant") == variant)


@query
def context_variant(spark: SparkSession, d: str) -> DataFrame:
    """Context of the entity search variant."""
    return select_variant(cat.contexts(spark, d), "entity_bfs").select("pair_id", "paths")


@query
def parse_entity_cell(spark: SparkSession, d: str) -> DataFrame:
    """Ids of comma-separated entity cells with their position."""
    rows = cat.questions(spark, d).select("pair_id", "wikidata_entities").distinct()
    return rows.select("pair_id", F.posexplode(tx.parse_entity_cell(F.col("wikidata_entities"))).alias("pos", "entity_id"))


@query
def arity_stats(spark: SparkSession, d: str) -> DataFrame:
    """How many questions have no entity, one, or more."""
    n = F.size("ids")
    arity = F.when(n == 0, "empty").when(n == 1, "single").otherwise("pair")
    return cat.question_entities(spark, d).groupBy(arity.alias("arity")).agg(F.count("*").alias("n"))


@query
def valid_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of triples that are valid entity or property ids as they stand."""
    ids = table(spark, d, "snomed_parent_child_triples_metadata").select(F.explode(F.array("head_id", "relation_id", "tail_id")).alias("id"))
    return ids.filter(tx.is_valid_id(F.col("id"))).distinct()


@query
def uri_to_id(spark: SparkSession, d: str) -> DataFrame:
    """Ids taken back from entity and property addresses; other text drops out."""
    t = table(spark, d, "snomed_parent_child_triples_metadata")
    base = "http://www.wikidata.org/"
    uris = t.select(
        "triple_id",
        F.explode(F.array(F.concat(F.lit(base + "entity/"), "head_id"), F.concat(F.lit(base + "prop/direct/"), "relation_id"))).alias("uri"),
    )
    return uris.withColumn("id", tx.uri_to_id(F.col("uri"))).filter("id is not null").distinct()


@query
def triple_id_filter(spark: SparkSession, d: str) -> DataFrame:
    """Triples of both sources whose ids are fit for labelling."""
    rows = _sources(spark, d)
    two = ranking.valid_triples(rows.filter("source = 2"), strict=False)
    return two.unionByName(ranking.valid_triples(rows.filter("source = 3"), strict=True))


@query
def capped_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges under the caps for properties and nodes."""
    return graph.capped_edges(cat.edges(spark, d))


#: What says of a node what it is, in this project's data: the child-of links of source 3 beside the general properties.
TYPES = (*nodes.TYPE_PROPERTIES, hierarchy.CHILD_OF)


@query
def node_label_list(spark: SparkSession, d: str) -> DataFrame:
    """Label of each node followed by up to three objects of each of its type properties."""
    child = cat.triples_3(spark, d).filter((F.col("relation_id") == hierarchy.CHILD_OF) & F.col("head_id").rlike(r"^Q\d+$") & F.col("tail_id").rlike(r"^Q\d+$"))
    edges = cat.edges(spark, d).unionByName(child.select(F.col("head_id").alias("head"), F.col("relation_id").alias("predicate"), F.col("tail_id").alias("tail"))).distinct()
    first = Window.partitionBy("head", "predicate").orderBy("tail")
    claims = edges.filter(F.col("predicate").isin(*TYPES)).withColumn("claim_ord", F.row_number().over(first) - 1)
    named = edges.select(F.col("head").alias("id")).distinct().join(cat.entity_labels(spark, d), "id", "left")
    return nodes.type_labels(named, claims, TYPES).select("id", F.array_join("labels", ", ").alias("labels"))


# Vectors


@query
def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    """The stand-in vector of every question text, as signs."""
    v = vx.hash_embed(F.col("question"))
    signs = F.array_join(F.transform(v, lambda x: F.when(x > 0, "1").otherwise("0")), "")
    return cat.questions(spark, d).select("pair_id", "question").distinct().select("pair_id", signs.alias("signs"))


@query
def mean_pool(spark: SparkSession, d: str) -> DataFrame:
    """Mean vector of each label, dimension by dimension."""
    flat = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    return flat.groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Components of the unit vectors of the sound question vectors."""
    unit = cat.usable_vectors(spark, d, "questions").select("id", F.posexplode(vx.l2_normalize(F.col("v"))).alias("dim", "x"))
    return unit.select("id", "dim", F.round("x", 6).alias("x"))


@query
def l2_normalize_safe(spark: SparkSession, d: str) -> DataFrame:
    """Norm of the unit vector of every vector; zero vectors keep norm zero."""
    rows = table(spark, d, "vector_collection").filter(F.size("embedding") == cat.DIMS)
    finite = rows.filter(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return finite.select("collection", "id", F.round(vx.norm(vx.l2_normalize_safe(F.col("embedding"))), 4).alias("norm")).distinct()


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("v"), "label", "vec_id")


def _probes(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 100."""
    return _embeddings(spark, d).filter("vec_id % 100 = 0").select("id", "v")


@query
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of each stated query and every vector."""
    return search.all_scores(_probes(spark, d), _embeddings(spark, d).select("id", "v"), decimals=5)


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set of exact searches: the questions whose number is divisible by 100."""
    number = F.regexp_extract("id", r"^question_(\d+)$", 1)
    return cat.usable_vectors(spark, d, "questions").filter((number != "") & (number.try_cast("bigint") % 100 == 0))


@query
def cosine_topk_entities(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest entities of each stated question, exact."""
    return search.exact_topk(_asked(spark, d), cat.usable_vectors(spark, d, "entities"), 10)


@query
def indexed_topk_entities(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest entities of every question, through the index."""
    return search.indexed_topk(cat.usable_vectors(spark, d, "questions"), cat.usable_vectors(spark, d, "entities"), 10)


@query
def cosine_topk_relations(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors of each stated query, itself included."""
    return search.exact_topk(_probes(spark, d), _embeddings(spark, d).select("id", "v"), 10)


@query
def l2_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest entities of each stated question by squared distance; similarity is one minus it."""
    return search.exact_topk(_asked(spark, d), cat.usable_vectors(spark, d, "entities"), 10, "l2", 5)


def _triple_search(spark: SparkSession, d: str, two: bool, k: int) -> DataFrame:
    rows = _embeddings(spark, d).filter("label < 7" if two else "label >= 7")
    rows = rows.select(F.concat(F.lit("triplet2_" if two else "triplet3_"), "id").alias("id"), "v")
    return search.exact_topk(_probes(spark, d), rows, k)


@query
def triple_top7(spark: SparkSession, d: str) -> DataFrame:
    """The seven nearest triples of source 2."""
    return _triple_search(spark, d, True, 7)


@query
def triple_top3(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest triples of source 3."""
    return _triple_search(spark, d, False, 3)


@query
def triple_fused_top10(spark: SparkSession, d: str) -> DataFrame:
    """Both sources fused and ranked again."""
    return search.fuse([(triple_top7(spark, d), 7), (triple_top3(spark, d), 3)], 10)


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    rows = triple_fused_top10(spark, d).join(_sources(spark, d).withColumnRenamed("triple_id", "id"), "id")
    return ranking.label_triples(rows, cat.labels(spark, d))


@query
def triple_labelled(spark: SparkSession, d: str) -> DataFrame:
    """Fused triples with all labels known; the rank keeps its gaps, a dense rank stands beside it."""
    kept = _labelled(spark, d).filter("english_triplet is not null")
    dense = Window.partitionBy("query_id").orderBy("rank_no")
    return kept.select("query_id", "rank_no", F.dense_rank().over(dense).alias("dense_no"), "id", "english_triplet")


@query
def triple_skipped(spark: SparkSession, d: str) -> DataFrame:
    """How many fused triples lack a label."""
    return _labelled(spark, d).agg(F.count_if(F.col("english_triplet").isNull()).alias("skipped"), F.count("*").alias("total"))


@query
def label_worklist(spark: SparkSession, d: str) -> DataFrame:
    """Ids of all triples that need a label."""
    return ranking.label_worklist(_sources(spark, d))


# Graph


def _pairs(spark: SparkSession, d: str, first: int = graph.PAIR_ENTITIES) -> DataFrame:
    return graph.entity_pairs(cat.question_entities(spark, d), "question_id", "ids", first)


@query
def entity_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Entity pairs of every question."""
    return _pairs(spark, d)


@query
def paths_1hop(spark: SparkSession, d: str) -> DataFrame:
    """Paths of one property between the entity pairs."""
    return graph.paths_1hop(_pairs(spark, d), written(cat.edges(spark, d)))


@query
def paths_2hop(spark: SparkSession, d: str) -> DataFrame:
    """Paths over one node."""
    return graph.paths_2hop(_pairs(spark, d), written(cat.edges(spark, d)))


@query
def paths_3hop(spark: SparkSession, d: str) -> DataFrame:
    """Paths over two nodes."""
    return graph.paths_3hop(_pairs(spark, d), written(cat.edges(spark, d)))


def _found(spark: SparkSession, d: str) -> DataFrame:
    """(s, e, hops, steps, path) of the distinct pairs, up to three hops."""
    found = graph.find_paths(_pairs(spark, d), written(cat.edges(spark, d)))
    return found.withColumn("path", graph.path_key(F.col("steps")))


@query
def find_paths(spark: SparkSession, d: str) -> DataFrame:
    """All paths of up to three hops."""
    return _found(spark, d).select("s", "e", "hops", "path")


@query
def path_node_stats(spark: SparkSession, d: str) -> DataFrame:
    """Distinct entities and properties on the paths of up to three hops, with their paths."""
    step = _found(spark, d).select("path", F.explode("steps").alias("x"))
    return step.groupBy(F.col("x.kind").alias("kind"), F.col("x.id").alias("id")).agg(F.count_distinct("path").alias("n_paths"))


@query
def bfs_pair_path(spark: SparkSession, d: str) -> DataFrame:
    """The path a bounded search finds for each pair of the first three entities."""
    capped = written(graph.capped_edges(cat.edges(spark, d)))
    found = graph.bfs_pair_paths(_pairs(spark, d, graph.BFS_ENTITIES), capped)
    return found.select("s", "e", "depth", _triples_text("path").alias("path"))


def _triples_text(path: str):
    return F.array_join(F.transform(path, lambda t: F.concat_ws(" ", t["source"], t["prop"], t["target"])), " > ")


def _single(spark: SparkSession, d: str) -> DataFrame:
    starts = cat.question_entities(spark, d).filter(F.size("ids") == 1).select(F.col("ids")[0].alias("s"))
    return graph.bfs_single_paths(starts, written(graph.capped_edges(cat.edges(spark, d))))


@query
def bfs_single_paths(spark: SparkSession, d: str) -> DataFrame:
    """The first paths of three edges from the only entity of a question."""
    return _single(spark, d).select("s", "path_no", _triples_text("path").alias("path"))


def _bfs_texts(spark: SparkSession, d: str) -> DataFrame:
    """(s, e, text) of the pair search, labelled."""
    capped = written(graph.capped_edges(cat.edges(spark, d)))
    found = written(graph.bfs_pair_paths(_pairs(spark, d, graph.BFS_ENTITIES), capped).select("s", "e", "path"))
    return ranking.label_bfs_paths(found, cat.labels(spark, d)).select("s", "e", "text")


@query
def format_bfs_paths(spark: SparkSession, d: str) -> DataFrame:
    """Found search paths as labelled text."""
    return _bfs_texts(spark, d)


@query
def bfs_row_context(spark: SparkSession, d: str) -> DataFrame:
    """The labelled search paths of each question in the order of its pairs."""
    rows = _pairs(spark, d, graph.BFS_ENTITIES).join(_bfs_texts(spark, d), ["s", "e"])
    return ranking.joined(rows, ["question_id"], ["pair_ord"], "text").withColumnRenamed("text", "context")


# Ranking, labels, formats


@query
def predicate_vocab(spark: SparkSession, d: str) -> DataFrame:
    """Properties on the paths of up to three hops."""
    return ranking.predicate_vocab(_found(spark, d))


@query
def path_score(spark: SparkSession, d: str) -> DataFrame:
    """Score of each path of up to three hops."""
    return _found(spark, d).select("s", "e", "path", ranking.path_score(F.col("steps")).alias("score"))


def _question_paths(spark: SparkSession, d: str) -> DataFrame:
    """(question_id, path, steps, score) of questions with a sound vector, each path once."""
    pairs = _pairs(spark, d).select("question_id", "s", "e").distinct()
    known = cat.usable_vectors(spark, d, "questions").select(F.col("id").alias("question_id"))
    rows = pairs.join(_found(spark, d), ["s", "e"]).join(known, "question_id", "left_semi")
    return rows.select("question_id", "path", "steps", ranking.path_score(F.col("steps")).alias("score")).distinct()


@query
def path_rank_top2(spark: SparkSession, d: str) -> DataFrame:
    """The two best paths of each question, labels and scores joined."""
    best = written(ranking.prune_paths(_question_paths(spark, d), "question_id", "score", ["path"]))
    best = ranking.label_paths(best, cat.labels(spark, d))
    pack = F.sort_array(F.collect_list(F.struct("rank_no", "text", F.col("score").cast("string").alias("s"))))
    rows = best.groupBy("question_id").agg(pack.alias("p"))
    text = lambda c: F.array_join(F.transform("p", lambda x: x[c]), " | ")
    return rows.select("question_id", text("text").alias("path_labels"), text("s").alias("score"))


@query
def label_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Labels of all ids of the graph, null where none is known."""
    edges = cat.edges(spark, d)
    ids = edges.select(F.explode(F.array("head", "predicate", "tail")).alias("id")).distinct()
    return ids.join(cat.labels(spark, d), "id", "left").select("id", "label")


@query
def format_pattern_paths(spark: SparkSession, d: str) -> DataFrame:
    """Labelled text of every pair's paths of up to three hops; pairs without one say so."""
    texts = ranking.label_paths(_found(spark, d), cat.labels(spark, d)).select("s", "e", "path", "text")
    pairs = _pairs(spark, d).select("s", "e").distinct()
    return pairs.join(texts, ["s", "e"], "left").select("s", "e", F.coalesce("text", F.lit(tx.NO_PATH)).alias("text"))


# Aggregates and model surface


@query
def run_stats(spark: SparkSession, d: str) -> DataFrame:
    """Totals of a path run of up to three hops."""
    found = _found(spark, d)
    step = found.select("s", "e", "hops", "path", F.explode("steps").alias("x"))
    pairs = _pairs(spark, d).select("s", "e").distinct().agg(F.count("*").alias("pairs"))
    stats = step.agg(
        F.count_distinct("s", "e", "path").alias("paths"),
        F.count_distinct(F.when(F.col("x.kind") == "entity", F.col("x.id"))).alias("entities"),
        F.count_distinct(F.when(F.col("x.kind") == "predicate", F.col("x.id"))).alias("relations"),
    )
    return pairs.join(stats)


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    rows = cat.questions(spark, d).select("pair_id", "label", "wikidata_paths_llm").distinct()
    return rows.withColumn("prediction", tx.extract_label(F.col("wikidata_paths_llm")))


@query
def extract_label(spark: SparkSession, d: str) -> DataFrame:
    """The label read from each reply."""
    return _predictions(spark, d).select("pair_id", "prediction")


@query
def match_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the labels read from the replies."""
    scores = metrics.match_metrics(_predictions(spark, d))
    return scores.select(*[F.round(c, 6).alias(c) for c in scores.columns])


@query
def kg_prompt(spark: SparkSession, d: str) -> DataFrame:
    """Prompt of each pair and variant, with its context."""
    q = cat.questions(spark, d).select("pair_id", "question").distinct()
    rows = q.join(cat.contexts(spark, d), "pair_id")
    return rows.select("pair_id", "variant", tx.kg_prompt(F.col("question"), F.col("paths")).alias("prompt"))


@query
def plain_prompt(spark: SparkSession, d: str) -> DataFrame:
    """Prompt of each pair without context."""
    q = cat.questions(spark, d).select("pair_id", "question").distinct()
    return q.select("pair_id", tx.plain_prompt(F.col("question")).alias("prompt"))


@query
def parse_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Mentions of each triple context."""
    return _mentions(spark, d)


@query
def link_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the mentions of each triple context, in order."""
    return ranking.link_mentions(_mentions(spark, d), cat.entity_labels(spark, d), ["pair_id", "variant"])


@query
def parse_llm_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths of each reply, split at bars."""
    rows = cat.questions(spark, d).select("pair_id", "wikidata_paths_llm").distinct()
    return rows.select("pair_id", F.posexplode(tx.parse_llm_paths(F.col("wikidata_paths_llm"))).alias("pos", "path"))


@query
def respond(spark: SparkSession, d: str) -> DataFrame:
    """Replies of the stub responder to the plain prompts."""
    return matching.respond(plain_prompt(spark, d), tx.SYSTEM_PLAIN).select("pair_id", "reply")


@query
def match_predictions(spark: SparkSession, d: str) -> DataFrame:
    """The whole match query with the stub responder and one context variant."""
    context = select_variant(cat.contexts(spark, d), "entity_bfs").select("pair_id", "paths")
    q = cat.questions(spark, d).select("pair_id", "label", "question").distinct().join(context, "pair_id", "left")
    return matching.predict(q, paths="paths").select("pair_id", "label", "reply", "prediction")
