"""Queries of the operators in this subpackage, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import broken_pairs, group_topn, leakage, repetition, tokenize, vector_topk


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Defective question-answer pairs with the type of their defect."""
    examples = broken_pairs.language_examples(table(spark, d, "documents"), "text", "lang")
    found = broken_pairs.broken_pairs(table(spark, d, "question_sheet"), examples)
    return found.filter(F.col("defect").isin(*broken_pairs.DEFECTS))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The ten best relations of every question."""
    scored = table(spark, d, "similarity_results")
    best = group_topn.top_items(scored, "question_id", "similar_relations.id", "similar_relations.score", n=10)
    return best.select("question_id", "rank_no", F.col("item_id").alias("relation_id"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest entities of every question and entity vector."""
    near = vector_topk.nearest(table(spark, d, "vector_collection"), "entities", k=5)
    return near.select("vector_id", F.col("neighbour_id").alias("entity_id"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tokenize.encode_corpus(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the evaluation items that leaked into them."""
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents of which at least three tenths are repeated runs."""
    return repetition.repetitive_documents(table(spark, d, "documents"))


def p9_flags(spark: SparkSession, d: str) -> DataFrame:
    """The measures of every document and the rules of the whole threshold table."""
    docs = repetition.repetition_flags(table(spark, d, "documents").select("doc_id", "text"))
    shares = ("repeated_share", "repeated_line_share", "symbol_share", "stop_word_share")
    flags = [f"is_{t.name}" for t in repetition.THRESHOLDS]
    return docs.select("doc_id", "n_words", *[F.round(c, 6).alias(c) for c in shares], *flags)


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p7_ids": p7_ids, "p8_found": p8_found, "p9_found": p9_found, "p9_flags": p9_flags}

_STOP = ", ".join(f"'{w}'" for w in sorted(set(repetition.STOP_WORDS)))
_LINE_END = r"\r\n|[\n\x0b\f\r\x{85}\x{2028}\x{2029}]"

ORACLE_SQL = {
    "p9_flags": rf"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, list_transform(regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}]+'), lambda x: lower(x)) AS w,
                   list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '{_LINE_END}'), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines
            FROM documents),
        g AS (
            SELECT doc_id, p, array_to_string(list_slice(w, p, p + 4), ' ') AS g
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d WHERE len(w) >= 5)),
        later AS (
            SELECT doc_id, p FROM (SELECT doc_id, p, min(p) OVER (PARTITION BY doc_id, g) AS first FROM g) WHERE p > first),
        covered AS (
            SELECT doc_id, count(DISTINCT p + k) AS n FROM later, (SELECT unnest(range(0, 5)) AS k) GROUP BY 1),
        m AS (
            SELECT doc_id, CAST(len(w) AS INTEGER) AS n_words,
                   coalesce(CAST(coalesce(n, 0) AS DOUBLE) / nullif(len(w), 0), 0) AS repeated_share,
                   coalesce(CAST(len(lines) - len(list_distinct(lines)) AS DOUBLE) / nullif(len(lines), 0), 0) AS repeated_line_share,
                   coalesce(CAST(length(regexp_replace(t, '[\p{{L}}\p{{N}} \t\n\x0b\f\r]+', '', 'g')) AS DOUBLE) / nullif(length(t), 0), 0) AS symbol_share,
                   coalesce(CAST(len(list_filter(w, lambda x: x IN ({_STOP}))) AS DOUBLE) / nullif(len(w), 0), 0) AS stop_word_share
            FROM d LEFT JOIN covered USING (doc_id))
        SELECT doc_id, n_words, round(repeated_share, 6) AS repeated_share, round(repeated_line_share, 6) AS repeated_line_share,
               round(symbol_share, 6) AS symbol_share, round(stop_word_share, 6) AS stop_word_share,
               repeated_share >= 0.3 AS is_repeated_runs, repeated_line_share >= 0.3 AS is_repeated_lines, symbol_share >= 0.5 AS is_mostly_symbols,
               stop_word_share <= 0.0 AS is_no_stop_words, n_words <= 3 AS is_very_short
        FROM m
    """,
    "p2_found": """
        WITH scored AS (
            SELECT question_id, r.id AS relation_id, max(r.score) AS score
            FROM (SELECT question_id, unnest(similar_relations) AS r FROM similarity_results)
            WHERE question_id IS NOT NULL AND r.id IS NOT NULL AND r.score IS NOT NULL AND NOT isnan(r.score)
            GROUP BY 1, 2),
        ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, relation_id) AS INTEGER) AS rank_no
            FROM scored)
        SELECT question_id, rank_no, relation_id FROM ranked WHERE rank_no <= 10
    """,
    "p8_found": r"""
        WITH d AS (
            SELECT doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w
            FROM documents WHERE text IS NOT NULL),
        i AS (
            SELECT item_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w
            FROM eval_items WHERE text IS NOT NULL),
        dg AS (
            SELECT doc_id, array_to_string(list_slice(w, p, p + 11), ' ') AS g
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS p FROM d WHERE len(w) >= 12)),
        ig AS (
            SELECT item_id, array_to_string(list_slice(w, p, p + 11), ' ') AS g
            FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS p FROM i WHERE len(w) >= 12))
        SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
    """,
    "p9_found": r"""
        WITH d AS (
            SELECT doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w
            FROM documents WHERE text IS NOT NULL),
        g AS (
            SELECT doc_id, p, array_to_string(list_slice(w, p, p + 4), ' ') AS g
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d WHERE len(w) >= 5)),
        later AS (
            SELECT doc_id, p FROM (
                SELECT doc_id, p, min(p) OVER (PARTITION BY doc_id, g) AS first FROM g) WHERE p > first),
        covered AS (
            SELECT doc_id, count(DISTINCT p + k) AS n
            FROM later, (SELECT unnest(range(0, 5)) AS k) GROUP BY 1)
        SELECT DISTINCT doc_id FROM covered JOIN d USING (doc_id) WHERE n / len(w) >= 0.3
    """,
}
