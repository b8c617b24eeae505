"""SQL for DuckDB that checks the core queries, with the same columns."""

from __future__ import annotations

# Common table expressions the queries share.
# A cell cut at its opening parentheses: a triple is three pieces in a row, comma-written or as a hop.
_EDGES = r"""
    cells AS (SELECT wikidata_paths_llm AS c FROM question_sheet UNION SELECT paths FROM context_variants),
    pieces AS (SELECT string_split(c, '(') AS t FROM cells WHERE c IS NOT NULL),
    spots AS (SELECT t[i] AS a, t[i + 1] AS b, t[i + 2] AS c FROM (SELECT t, unnest(range(2, len(t) - 1)) AS i FROM pieces)),
    edges AS (SELECT DISTINCT regexp_extract(a, '^Q\d+') AS head, regexp_extract(b, '^P\d+') AS predicate, regexp_extract(c, '^Q\d+') AS tail
        FROM spots WHERE regexp_matches(c, '^Q\d+\)')
          AND (regexp_matches(a, '^Q\d+\), [^)]*$') AND regexp_matches(b, '^P\d+\), [^)]*$')
               OR regexp_matches(a, '^Q\d+\) --\[[^)]*\] $') AND regexp_matches(b, '^P\d+\)--> [^)]*$')))"""
_CAPPED = """
    first5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY head, predicate ORDER BY tail) AS c FROM edges) WHERE c <= 5),
    capped AS (SELECT head, predicate, tail, edge_ord FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY head ORDER BY predicate, tail) AS INTEGER) AS edge_ord FROM first5) WHERE edge_ord <= 50)"""
_ENTITY_LABELS = """
    entity_labels AS (SELECT * FROM (
        SELECT id, max(coalesce(nullif(trim(document), ''), nullif(trim(metadata['text']), ''))) AS label
        FROM vector_collection WHERE collection = 'entities' AND id IS NOT NULL GROUP BY id) WHERE label IS NOT NULL)"""
_LABELS = _ENTITY_LABELS + """,
    relation AS (SELECT unnest(similar_relations) AS r FROM similarity_results),
    labels AS (SELECT id, label FROM entity_labels UNION ALL
               SELECT r.id, min(r.text) FROM relation WHERE r.id IS NOT NULL AND r.text IS NOT NULL GROUP BY 1)"""
_LISTS = r"""
    lists AS (SELECT question_id, coalesce(regexp_extract_all(wikidata_entities, '\bQ\d+\b'), []) AS ids
              FROM (SELECT DISTINCT question_id, wikidata_entities FROM question_sheet))"""


def _pairs(first: int) -> str:
    return _LISTS + f""",
    listed AS (SELECT question_id, ids[1:{first}] AS ids, unnest(range(1, least(len(ids), {first}) + 1)) AS i FROM lists),
    cross_ids AS (SELECT question_id, ids, i, unnest(range(i + 1, len(ids) + 1)) AS j FROM listed),
    pairs AS (SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id, ids ORDER BY i, j) - 1 AS INTEGER) AS pair_ord,
                     ids[i] AS s, ids[j] AS e FROM cross_ids),
    pair AS (SELECT DISTINCT s, e FROM pairs)"""


_HOP1 = """
    hop1 AS (SELECT s, e, p1 FROM (SELECT *, row_number() OVER (PARTITION BY s, e ORDER BY p1) AS n FROM (
        SELECT s, e, predicate AS p1 FROM pair JOIN edges ON head = s AND tail = e
        UNION SELECT s, e, predicate FROM pair JOIN edges ON head = e AND tail = s
        UNION SELECT s, e, a.predicate FROM pair JOIN edges a ON a.tail = s
              JOIN edges b ON b.head = e AND b.tail = a.head AND b.predicate = a.predicate)) WHERE n <= 100)"""
_HOP2 = """
    hop2 AS (SELECT s, e, p1, m1, p2 FROM (SELECT *, row_number() OVER (PARTITION BY s, e ORDER BY p1, m1, p2) AS n FROM (
        SELECT s, e, a.predicate AS p1, a.tail AS m1, b.predicate AS p2
        FROM pair JOIN edges a ON a.head = s JOIN edges b ON b.head = a.tail AND b.tail = e WHERE a.tail NOT IN (s, e)
        UNION SELECT s, e, a.predicate, a.tail, b.predicate
        FROM pair JOIN edges a ON a.head = e JOIN edges b ON b.head = a.tail AND b.tail = s WHERE a.tail NOT IN (s, e)
        UNION SELECT s, e, a.predicate, a.head, b.predicate
        FROM pair JOIN edges a ON a.tail = s JOIN edges b ON b.head = a.head AND b.tail = e WHERE a.head NOT IN (s, e))) WHERE n <= 100)"""
_HOP3 = """
    forward AS (SELECT s, e, a.predicate AS p1, a.tail AS m1, b.predicate AS p2, b.tail AS m2, c.predicate AS p3
        FROM pair JOIN edges a ON a.head = s JOIN edges b ON b.head = a.tail JOIN edges c ON c.head = b.tail AND c.tail = e
        WHERE a.tail NOT IN (s, e) AND b.tail NOT IN (s, e)),
    backward AS (SELECT s, e, a.predicate AS p1, a.tail AS m1, b.predicate AS p2, b.tail AS m2, c.predicate AS p3
        FROM pair JOIN edges a ON a.head = e JOIN edges b ON b.head = a.tail JOIN edges c ON c.head = b.tail AND c.tail = s
        WHERE a.tail NOT IN (s, e) AND b.tail NOT IN (s, e)),
    hop3 AS (SELECT s, e, p1, m1, p2, m2, p3 FROM (
        SELECT *, row_number() OVER (PARTITION BY s, e ORDER BY p1, m1, p2, m2, p3) AS n FROM (
            SELECT * FROM forward UNION SELECT * FROM backward UNION SELECT s, e, p3, m2, p2, m1, p1 FROM backward)) WHERE n <= 100)"""
_FOUND = _HOP1 + "," + _HOP2 + "," + _HOP3 + """,
    found AS (SELECT s, e, 1 AS hops, s || '|' || p1 || '|' || e AS path FROM hop1
              UNION ALL SELECT s, e, 2, s || '|' || p1 || '|' || m1 || '|' || p2 || '|' || e FROM hop2
              UNION ALL SELECT s, e, 3, s || '|' || p1 || '|' || m1 || '|' || p2 || '|' || m2 || '|' || p3 || '|' || e FROM hop3)"""
_TEXTS = """
    step AS (SELECT s, e, path, ids, unnest(range(1, len(ids) + 1)) AS i FROM (SELECT s, e, path, string_split(path, '|') AS ids FROM found)),
    texts AS (SELECT s, e, path, string_agg(CASE WHEN i % 2 = 1 THEN coalesce(label, ids[i]) || ' (' || ids[i] || ')'
                 ELSE '--[' || coalesce(label, ids[i]) || '] (' || ids[i] || ')-->' END, ' ' ORDER BY i) AS text
              FROM step LEFT JOIN labels ON id = ids[i] GROUP BY s, e, path)"""
_BFS = """
    level1 AS (SELECT s, node, ord, path FROM (
        SELECT s, tail AS node, [edge_ord] AS ord, [{'s': s, 'p': predicate, 't': tail}] AS path,
               row_number() OVER (PARTITION BY s, tail ORDER BY edge_ord) AS n
        FROM (SELECT DISTINCT s FROM pair WHERE s <> e) JOIN capped ON head = s) WHERE n = 1),
    level2 AS (SELECT s, node, ord, path FROM (
        SELECT s, tail AS node, list_append(ord, edge_ord) AS ord, list_append(path, {'s': node, 'p': predicate, 't': tail}) AS path,
               row_number() OVER (PARTITION BY s, tail ORDER BY list_append(ord, edge_ord)) AS n
        FROM level1 JOIN capped ON head = node) WHERE n = 1),
    level3 AS (SELECT s, node, ord, path FROM (
        SELECT s, tail AS node, list_append(ord, edge_ord) AS ord, list_append(path, {'s': node, 'p': predicate, 't': tail}) AS path,
               row_number() OVER (PARTITION BY s, tail ORDER BY list_append(ord, edge_ord)) AS n
        FROM level2 JOIN capped ON head = node) WHERE n = 1),
    levels AS (SELECT 1 AS depth, * FROM level1 UNION ALL SELECT 2, * FROM level2 UNION ALL SELECT 3, * FROM level3),
    bfs AS (SELECT s, e, depth, path FROM (
        SELECT p.s, p.e, depth, path, row_number() OVER (PARTITION BY p.s, p.e ORDER BY depth) AS n
        FROM pair p JOIN levels l ON l.s = p.s AND l.node = p.e WHERE p.s <> p.e) WHERE n = 1)"""
_BFS_TEXTS = """
    triple AS (SELECT s, e, path, unnest(range(1, len(path) + 1)) AS i FROM bfs),
    bfs_texts AS (SELECT s, e, string_agg(coalesce(a.label, path[i].s) || ' (' || path[i].s || '), ' || coalesce(b.label, path[i].p) || ' (' || path[i].p
                     || '), ' || coalesce(c.label, path[i].t) || ' (' || path[i].t || ')', ' -> ' ORDER BY i) AS text
                  FROM triple LEFT JOIN labels a ON a.id = path[i].s LEFT JOIN labels b ON b.id = path[i].p LEFT JOIN labels c ON c.id = path[i].t
                  GROUP BY s, e)"""
_TRIPLE_TEXT = "list_transform(path, lambda t: t.s || ' ' || t.p || ' ' || t.t)"
_USABLE = """
    usable AS (SELECT collection, id, first(embedding) AS v FROM vector_collection
        WHERE id IS NOT NULL AND len(embedding) = 64
          AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
          AND list_bool_or(list_transform(embedding, lambda x: x <> 0)) GROUP BY 1, 2)"""
_DV = "CAST({} AS DOUBLE[])"


def _topk(queries: str, rows: str, k: int, score: str, cte: str = "") -> str:
    return f"""WITH {cte + ',' if cte else ''} q AS ({queries}), r AS ({rows}),
        scored AS (SELECT query_id, id, {score} AS score FROM q, r)
        SELECT query_id, id, score, rank_no FROM (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank_no FROM scored) WHERE rank_no <= {k}"""


_COSINE = "round(list_cosine_similarity(CAST(qv AS DOUBLE[]), CAST(rv AS DOUBLE[])), {}) + 0.0"
_L2 = "round(1.0 - list_sum(list_transform(list_zip(CAST(qv AS DOUBLE[]), CAST(rv AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 5) + 0.0"
_PROBES = "SELECT CAST(vec_id AS VARCHAR) AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0"
_QV = r"""SELECT id AS query_id, v AS qv FROM usable
    WHERE collection = 'questions' AND TRY_CAST(regexp_extract(id, '^question_(\d+)$', 1) AS BIGINT) % 100 = 0"""
_EV = "SELECT id, v AS rv FROM usable WHERE collection = 'entities'"
_TWO = "SELECT 'triplet2_' || vec_id AS id, embedding AS rv FROM embeddings WHERE label < 7"
_THREE = "SELECT 'triplet3_' || vec_id AS id, embedding AS rv FROM embeddings WHERE label >= 7"
_TOP7, _TOP3 = _topk(_PROBES, _TWO, 7, _COSINE.format(6)), _topk(_PROBES, _THREE, 3, _COSINE.format(6))
_FUSED = f"""
    both_tops AS (SELECT query_id, id, score FROM ({_TOP7}) UNION ALL SELECT query_id, id, score FROM ({_TOP3})),
    fused AS (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank_no FROM both_tops)"""
_SOURCES = """
    sources AS (
        SELECT 'triplet2_' || (row_number() OVER (ORDER BY head, predicate, tail) - 1) AS triple_id,
               head AS head_id, predicate AS relation_id, tail AS tail_id, 2 AS source FROM edges
        UNION ALL SELECT DISTINCT triple_id, head_id, relation_id, tail_id, 3 FROM snomed_parent_child_triples_metadata)"""
_LABELLED = f"""WITH {_EDGES}, {_SOURCES}, {_FUSED}, {_LABELS},
    labelled AS (SELECT query_id, rank_no, f.id, '<' || h.label || ', ' || r.label || ', ' || t.label || '>' AS english_triplet
        FROM fused f JOIN sources ON triple_id = f.id LEFT JOIN labels h ON h.id = head_id
        LEFT JOIN labels r ON r.id = relation_id LEFT JOIN labels t ON t.id = tail_id)"""
_RANKED = """
    relation AS (SELECT question_id, unnest(similar_relations) AS r FROM similarity_results WHERE question_id IS NOT NULL),
    best AS (SELECT question_id, r.id AS id, max(r.score) AS score, min(r.text) AS text FROM relation
             WHERE r.id IS NOT NULL AND r.score IS NOT NULL AND NOT isnan(r.score) GROUP BY 1, 2),
    ranked AS (SELECT * FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS INTEGER) AS rank_no FROM best) WHERE rank_no <= 10)"""
_MENTIONS = r"""
    cells AS (SELECT DISTINCT pair_id, variant, paths FROM context_variants WHERE variant IN ('kg_triples', 'kg_triples_top1', 'kg_triples_top2') AND paths IS NOT NULL),
    listed AS (SELECT pair_id, variant, list_filter(list_transform(string_split(regexp_replace(paths, '[<>"''\[\]|;\r\n\t]+', ',', 'g'), ','), lambda x: trim(x, e' \t\r\n')),
                   lambda x: lower(x) NOT IN ('', 'null')) AS l FROM cells),
    mentions AS (SELECT pair_id, variant, l, unnest(range(0, len(l))) AS pos FROM listed),
    mention AS (SELECT pair_id, variant, CAST(pos AS INTEGER) AS pos, l[pos + 1] AS mention FROM mentions)"""
_LINKS = "links AS (SELECT lower(trim(label)) AS m, min(id) AS entity_id FROM entity_labels GROUP BY 1)"
_SCORES = r"""
    rows AS (SELECT DISTINCT pair_id, label, wikidata_paths_llm AS a, src_attr, tgt_attr FROM question_sheet),
    predicted AS (SELECT pair_id, label, coalesce(CAST(nullif(regexp_extract(a, '[01]'), '') AS INTEGER), -1) AS prediction
                  FROM (SELECT DISTINCT pair_id, label, a FROM rows))"""

ORACLE_SQL: dict[str, str] = {
    "p5_found": """
        WITH RECURSIVE clean AS (
            SELECT nullif(upper(trim(head_id)), '') AS h, nullif(upper(trim(tail_id)), '') AS t, relation_id AS r
            FROM snomed_parent_child_triples_metadata WHERE relation_id IN ('P9104117', 'P9107342')),
        link AS (
            SELECT child, min(parent) AS parent FROM (
                SELECT CASE WHEN r = 'P9104117' THEN h ELSE t END AS child,
                       CASE WHEN r = 'P9104117' THEN t ELSE h END AS parent
                FROM clean WHERE h IS NOT NULL AND t IS NOT NULL) GROUP BY 1),
        node AS (SELECT child AS id FROM link UNION SELECT parent FROM link),
        down AS (
            SELECT id AS node_id, id AS root_id, 0 AS depth, id AS node_path FROM node WHERE id NOT IN (SELECT child FROM link)
            UNION ALL
            SELECT l.child, d.root_id, d.depth + 1, d.node_path || '/' || l.child FROM down d JOIN link l ON l.parent = d.node_id),
        above AS (
            SELECT child AS id, parent AS up FROM link WHERE child NOT IN (SELECT node_id FROM down)
            UNION
            SELECT a.id, l.parent FROM above a JOIN link l ON l.child = a.up),
        ring AS (SELECT id FROM above WHERE id = up),
        placed AS (
            SELECT node_id, root_id, depth, node_path FROM down
            UNION ALL
            SELECT id, min(up), -1, '' FROM above WHERE up IN (SELECT id FROM ring) GROUP BY id),
        below AS (
            SELECT up, count(*) AS n FROM (
                SELECT up, id FROM above WHERE up <> id
                UNION ALL
                SELECT unnest(string_split(node_path, '/')[1:-2]), node_id FROM down) GROUP BY up)
        SELECT node_id, root_id, CAST(depth AS INTEGER) AS depth, node_path, coalesce(n, 0) AS n_descendants
        FROM placed LEFT JOIN below ON up = node_id
    """,
    "load_entries": """
        SELECT DISTINCT id, trim(document, e' \\t\\r\\n') AS text FROM vector_collection
        WHERE collection = 'entities' AND id IS NOT NULL AND trim(coalesce(document, ''), e' \\t\\r\\n') <> ''
    """,
    "scan_embeddings": """
        SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dims,
               round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 4) AS norm FROM embeddings
    """,
    "triple_sources_union": f"WITH {_EDGES}, {_SOURCES} SELECT * FROM sources",
    "normalize_paths": """
        WITH c AS (SELECT DISTINCT pair_id, variant, paths FROM context_variants),
        l AS (SELECT pair_id, variant, CASE WHEN paths IS NULL THEN CAST([] AS VARCHAR[])
                  WHEN starts_with(trim(paths, e' \\t\\r\\n'), '[') AND json_valid(paths) THEN CAST(CAST(paths AS JSON) AS VARCHAR[]) ELSE [paths] END AS list FROM c)
        SELECT pair_id, variant, CAST(len(list) AS INTEGER) AS n_paths, list[1] AS first_path FROM l
    """,
    "full_text": """
        WITH t AS (SELECT id, trim(coalesce(metadata['text'], '')) AS a, trim(coalesce(document, '')) AS b
                   FROM vector_collection WHERE collection = 'entities' AND id IS NOT NULL)
        SELECT DISTINCT id, CASE WHEN a = '' AND b = '' THEN id ELSE a || '. ' || b || '.' END AS full_text FROM t
    """,
    "entity_link_top1": f"""WITH {_MENTIONS}, {_ENTITY_LABELS}, {_LINKS}
        SELECT mention, entity_id FROM (SELECT DISTINCT mention FROM mention) LEFT JOIN links ON m = lower(trim(mention))""",
    "enumerate_ids": """
        SELECT id, CAST((row_number() OVER (ORDER BY id) - 1) // 500 AS BIGINT) AS page
        FROM (SELECT DISTINCT id FROM vector_collection WHERE collection = 'entities' AND starts_with(id, 'Q'))
    """,
    "collection_ids": """
        SELECT collection, id, collection || '_' || (row_number() OVER (PARTITION BY collection ORDER BY id) - 1) AS row_id
        FROM (SELECT DISTINCT collection, id FROM vector_collection WHERE id IS NOT NULL)
    """,
    "result_json": f"""WITH {_RANKED}
        SELECT question_id, CAST(to_json({{'question_id': question_id, 'results': list({{'rank': rank_no, 'id': id}} ORDER BY rank_no)}}) AS VARCHAR) AS record
        FROM ranked GROUP BY question_id""",
    "similarity_report": f"""WITH {_RANKED}
        SELECT question_id, string_agg('- ' || id || ': ' || coalesce(text, '') || ' (Score: ' || printf('%.4f', score) || ')', chr(10) ORDER BY rank_no) AS report
        FROM ranked GROUP BY question_id""",
    "generate_questions": """
        SELECT DISTINCT pair_id, 'Attribute 1 ' || coalesce(src_attr, 'nan') || ' and its description 1 ' || coalesce(src_desc, 'nan') || ' ' || chr(10)
            || 'Attribute 2 ' || coalesce(tgt_attr, 'nan') || ' and its description 2 ' || coalesce(tgt_desc, 'nan') || ' ' || chr(10)
            || 'Do attribute 1 and attribute 2 are semantically matched with each other?' AS question FROM question_sheet
    """,
    "context_variant": "SELECT DISTINCT pair_id, paths FROM context_variants WHERE variant = 'entity_bfs'",
    "parse_entity_cell": """
        WITH c AS (SELECT DISTINCT pair_id, wikidata_entities AS w FROM question_sheet WHERE wikidata_entities IS NOT NULL),
        l AS (SELECT pair_id, list_filter(list_transform(string_split(w, ','), lambda x: trim(x, e' \\t\\r\\n')), lambda x: starts_with(x, 'Q')) AS l FROM c),
        p AS (SELECT pair_id, l, unnest(range(0, len(l))) AS pos FROM l)
        SELECT pair_id, CAST(pos AS INTEGER) AS pos, l[pos + 1] AS entity_id FROM p
    """,
    "arity_stats": f"""WITH {_LISTS}
        SELECT CASE WHEN len(ids) = 0 THEN 'empty' WHEN len(ids) = 1 THEN 'single' ELSE 'pair' END AS arity, count(*) AS n FROM lists GROUP BY 1""",
    "valid_ids": r"""
        SELECT DISTINCT id FROM (SELECT unnest([head_id, relation_id, tail_id]) AS id FROM snomed_parent_child_triples_metadata)
        WHERE regexp_matches(id, '^[QP]\d+$')
    """,
    "uri_to_id": r"""
        WITH u AS (SELECT triple_id, unnest(['http://www.wikidata.org/entity/' || head_id, 'http://www.wikidata.org/prop/direct/' || relation_id]) AS uri
                   FROM snomed_parent_child_triples_metadata),
        i AS (SELECT DISTINCT triple_id, uri, coalesce(nullif(regexp_extract(uri, '/prop/direct/(P\d+)$', 1), ''), nullif(regexp_extract(uri, '/entity/(Q\d+)$', 1), '')) AS id FROM u)
        SELECT triple_id, uri, id FROM i WHERE id IS NOT NULL
    """,
    "triple_id_filter": f"""WITH {_EDGES}, {_SOURCES}
        SELECT * FROM sources WHERE (source = 2 AND head_id <> '' AND relation_id <> '' AND tail_id <> '')
            OR (source = 3 AND starts_with(head_id, 'Q') AND starts_with(relation_id, 'P') AND starts_with(tail_id, 'Q'))""",
    "capped_edges": f"WITH {_EDGES}, {_CAPPED} SELECT * FROM capped",
    "node_label_list": rf"""WITH {_EDGES}, {_ENTITY_LABELS},
        claims AS (SELECT head, predicate, tail FROM edges UNION SELECT head_id, relation_id, tail_id FROM snomed_parent_child_triples_metadata
            WHERE relation_id = 'P9104117' AND regexp_matches(head_id, '^Q\d+$') AND regexp_matches(tail_id, '^Q\d+$')),
        n AS (SELECT head, predicate, tail, row_number() OVER (PARTITION BY head, predicate ORDER BY tail) AS n FROM claims
            WHERE predicate IN ('P31', 'P279', 'P9104117')),
        o AS (SELECT head, string_agg(tail, ', ' ORDER BY list_position(['P31', 'P279', 'P9104117'], predicate), n) AS t FROM n WHERE n <= 3 GROUP BY head)
        SELECT h.head AS id, concat_ws(', ', coalesce(label, h.head), t) AS labels
        FROM (SELECT DISTINCT head FROM claims) h LEFT JOIN o ON o.head = h.head LEFT JOIN entity_labels ON id = h.head""",
    "hash_embed": """
        SELECT pair_id, lpad(bin(CAST('0x' || substr(sha256(coalesce(question, '')), 1, 4) AS BIGINT)), 16, '0') AS signs
        FROM (SELECT DISTINCT pair_id, question FROM question_sheet)
    """,
    "mean_pool": """
        WITH p AS (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
        SELECT label, CAST(i - 1 AS INTEGER) AS dim, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS mean FROM p GROUP BY 1, 2
    """,
    "l2_normalize": f"""WITH {_USABLE},
        p AS (SELECT id, CAST(v AS DOUBLE[]) AS v, unnest(range(1, len(v) + 1)) AS i FROM usable WHERE collection = 'questions')
        SELECT id, CAST(i - 1 AS INTEGER) AS dim, round(v[i] / sqrt(list_dot_product(v, v)), 6) AS x FROM p""",
    "l2_normalize_safe": """
        SELECT DISTINCT collection, id, CASE WHEN list_bool_or(list_transform(embedding, lambda x: x <> 0)) THEN 1.0 ELSE 0.0 END::DOUBLE AS norm
        FROM vector_collection WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    """,
    "cosine_pairs": f"""WITH q AS ({_PROBES}), r AS (SELECT CAST(vec_id AS VARCHAR) AS id, embedding AS rv FROM embeddings)
        SELECT query_id, id, {_COSINE.format(5)} AS score FROM q, r""",
    "cosine_topk_entities": _topk(_QV, _EV, 10, _COSINE.format(6), _USABLE),
    "cosine_topk_relations": _topk(_PROBES, "SELECT CAST(vec_id AS VARCHAR) AS id, embedding AS rv FROM embeddings", 10, _COSINE.format(6)),
    "l2_topk": _topk(_QV, _EV, 10, _L2, _USABLE),
    "triple_top7": _TOP7,
    "triple_top3": _TOP3,
    "triple_fused_top10": f"WITH {_FUSED} SELECT query_id, id, score, rank_no FROM fused WHERE rank_no <= 10",
    "triple_labelled": f"""{_LABELLED}
        SELECT query_id, rank_no, CAST(dense_rank() OVER (PARTITION BY query_id ORDER BY rank_no) AS INTEGER) AS dense_no, id, english_triplet
        FROM labelled WHERE english_triplet IS NOT NULL""",
    "triple_skipped": f"{_LABELLED} SELECT count(*) FILTER (english_triplet IS NULL) AS skipped, count(*) AS total FROM labelled",
    "label_worklist": rf"""WITH {_EDGES}, {_SOURCES}
        SELECT DISTINCT id FROM (SELECT unnest([head_id, relation_id, tail_id]) AS id FROM sources) WHERE regexp_matches(id, '^[QP]\d+$')""",
    "entity_pairs": f"WITH {_pairs(10)} SELECT question_id, pair_ord, s, e FROM pairs",
    "paths_1hop": f"WITH {_EDGES}, {_pairs(10)}, {_HOP1} SELECT * FROM hop1",
    "paths_2hop": f"WITH {_EDGES}, {_pairs(10)}, {_HOP2} SELECT * FROM hop2",
    "paths_3hop": f"WITH {_EDGES}, {_pairs(10)}, {_HOP3} SELECT * FROM hop3",
    "find_paths": f"""WITH {_EDGES}, {_pairs(10)}, {_FOUND} SELECT s, e, hops, path FROM found""",
    "path_node_stats": f"""WITH {_EDGES}, {_pairs(10)}, {_FOUND},
        step AS (SELECT path, ids, unnest(range(1, len(ids) + 1)) AS i FROM (SELECT DISTINCT path, string_split(path, '|') AS ids FROM found))
        SELECT CASE WHEN i % 2 = 1 THEN 'entity' ELSE 'predicate' END AS kind, ids[i] AS id, count(DISTINCT path) AS n_paths FROM step GROUP BY 1, 2""",
    "bfs_pair_path": f"""WITH {_EDGES}, {_CAPPED}, {_pairs(3)}, {_BFS}
        SELECT s, e, depth, array_to_string({_TRIPLE_TEXT}, ' > ') AS path FROM bfs""",
    "bfs_single_paths": f"""WITH {_EDGES}, {_CAPPED}, {_LISTS},
        pair AS (SELECT DISTINCT ids[1] AS s, '' AS e FROM lists WHERE len(ids) = 1),
        level1 AS (SELECT s, node, ord, path FROM (
            SELECT s, tail AS node, [edge_ord] AS ord, [{{'s': s, 'p': predicate, 't': tail}}] AS path,
                   row_number() OVER (PARTITION BY s, tail ORDER BY edge_ord) AS n FROM pair JOIN capped ON head = s WHERE tail <> s) WHERE n = 1),
        level2 AS (SELECT s, node, ord, path FROM (
            SELECT l.s, tail AS node, list_append(ord, edge_ord) AS ord, list_append(path, {{'s': node, 'p': predicate, 't': tail}}) AS path,
                   row_number() OVER (PARTITION BY l.s, tail ORDER BY list_append(ord, edge_ord)) AS n
            FROM level1 l JOIN capped ON head = node WHERE tail <> l.s AND NOT EXISTS (SELECT 1 FROM level1 v WHERE v.s = l.s AND v.node = tail)) WHERE n = 1),
        level3 AS (SELECT s, node, ord, path FROM (
            SELECT l.s, tail AS node, list_append(ord, edge_ord) AS ord, list_append(path, {{'s': node, 'p': predicate, 't': tail}}) AS path,
                   row_number() OVER (PARTITION BY l.s, tail ORDER BY list_append(ord, edge_ord)) AS n
            FROM level2 l JOIN capped ON head = node WHERE tail <> l.s AND NOT EXISTS (SELECT 1 FROM level1 v WHERE v.s = l.s AND v.node = tail)
                 AND NOT EXISTS (SELECT 1 FROM level2 v WHERE v.s = l.s AND v.node = tail)) WHERE n = 1)
        SELECT s, path_no, array_to_string({_TRIPLE_TEXT}, ' > ') AS path FROM (
            SELECT s, path, CAST(row_number() OVER (PARTITION BY s ORDER BY ord) AS INTEGER) AS path_no FROM level3) WHERE path_no <= 5""",
    "format_bfs_paths": f"WITH {_EDGES}, {_CAPPED}, {_pairs(3)}, {_LABELS}, {_BFS}, {_BFS_TEXTS} SELECT s, e, text FROM bfs_texts",
    "bfs_row_context": f"""WITH {_EDGES}, {_CAPPED}, {_pairs(3)}, {_LABELS}, {_BFS}, {_BFS_TEXTS}
        SELECT question_id, string_agg(text, ' | ' ORDER BY pair_ord, text) AS context FROM pairs JOIN bfs_texts USING (s, e) GROUP BY question_id""",
    "predicate_vocab": f"""WITH {_EDGES}, {_pairs(10)}, {_FOUND}
        SELECT DISTINCT p AS predicate FROM (SELECT unnest([string_split(path, '|')[2], string_split(path, '|')[4], string_split(path, '|')[6]]) AS p FROM found) WHERE p IS NOT NULL""",
    "path_score": f"WITH {_EDGES}, {_pairs(10)}, {_FOUND} SELECT s, e, path, hops AS score FROM found",
    "path_rank_top2": f"""WITH {_EDGES}, {_pairs(10)}, {_FOUND}, {_LABELS}, {_USABLE}, {_TEXTS},
        q AS (SELECT DISTINCT question_id, t.path, hops AS score, text FROM (SELECT DISTINCT question_id, s, e FROM pairs) p
              JOIN texts t USING (s, e) JOIN found f USING (s, e, path)
              WHERE question_id IN (SELECT id FROM usable WHERE collection = 'questions')),
        r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, path) AS n FROM q)
        SELECT question_id, string_agg(text, ' | ' ORDER BY n) AS path_labels, string_agg(CAST(score AS VARCHAR), ' | ' ORDER BY n) AS score
        FROM r WHERE n <= 2 GROUP BY question_id""",
    "label_lookup": f"""WITH {_EDGES}, {_LABELS}, i AS (SELECT DISTINCT unnest([head, predicate, tail]) AS id FROM edges)
        SELECT i.id, label FROM i LEFT JOIN labels l ON l.id = i.id""",
    "format_pattern_paths": f"""WITH {_EDGES}, {_pairs(10)}, {_FOUND}, {_LABELS}, {_TEXTS}
        SELECT s, e, coalesce(text, 'No path found') AS text FROM pair LEFT JOIN texts USING (s, e)""",
    "run_stats": f"""WITH {_EDGES}, {_pairs(10)}, {_FOUND},
        step AS (SELECT ids, unnest(range(1, len(ids) + 1)) AS i FROM (SELECT string_split(path, '|') AS ids FROM found))
        SELECT (SELECT count(*) FROM pair) AS pairs, (SELECT count(*) FROM found) AS paths,
               count(DISTINCT CASE WHEN i % 2 = 1 THEN ids[i] END) AS entities, count(DISTINCT CASE WHEN i % 2 = 0 THEN ids[i] END) AS relations FROM step""",
    "extract_label": f"WITH {_SCORES} SELECT pair_id, prediction FROM predicted",
    "match_metrics": f"""WITH {_SCORES},
        c AS (SELECT CAST(count(*) FILTER (prediction = 1 AND label = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (prediction = 1 AND label = 0) AS DOUBLE) AS fp,
                     CAST(count(*) FILTER (prediction = 0 AND label = 1) AS DOUBLE) AS fn, CAST(count(*) FILTER (prediction = label) AS DOUBLE) AS ok,
                     CAST(count(*) FILTER (prediction >= 0 AND label IS NOT NULL) AS DOUBLE) AS n, CAST(count(label) AS DOUBLE) AS known FROM predicted)
        SELECT round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
               round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce(ok / nullif(n, 0), 0), 6) AS accuracy,
               round(coalesce(n / nullif(known, 0), 0), 6) AS coverage FROM c""",
    "kg_prompt": """
        SELECT DISTINCT q.pair_id, c.variant, 'Question:' || chr(10) || question || chr(10) || chr(10) || 'Graph facts:' || chr(10)
            || CASE WHEN paths IS NULL OR lower(trim(paths, e' \\t\\r\\n')) IN ('', 'null') THEN '(none; decide from the attributes alone)' ELSE paths END
            || chr(10) || chr(10) || 'Answer with 1 or 0.' AS prompt
        FROM question_sheet q JOIN context_variants c ON c.pair_id = q.pair_id
    """,
    "plain_prompt": """
        SELECT DISTINCT pair_id, 'Question:' || chr(10) || question || chr(10) || chr(10) || 'Answer with 1 or 0.' AS prompt FROM question_sheet
    """,
    "parse_mentions": f"WITH {_MENTIONS} SELECT pair_id, variant, pos, mention FROM mention",
    "link_mentions": f"""WITH {_MENTIONS}, {_ENTITY_LABELS}, {_LINKS}
        SELECT pair_id, variant, string_agg(entity_id, ', ' ORDER BY pos, entity_id) AS entity_ids FROM mention JOIN links ON m = lower(trim(mention)) GROUP BY pair_id, variant""",
    "parse_llm_paths": """
        WITH c AS (SELECT DISTINCT pair_id, wikidata_paths_llm AS a FROM question_sheet WHERE wikidata_paths_llm IS NOT NULL),
        l AS (SELECT pair_id, list_filter(list_transform(string_split(a, '|'), lambda x: trim(x, e' \\t\\r\\n')), lambda x: lower(x) NOT IN ('', 'null')) AS l FROM c),
        p AS (SELECT pair_id, l, unnest(range(0, len(l))) AS pos FROM l)
        SELECT pair_id, CAST(pos AS INTEGER) AS pos, l[pos + 1] AS path FROM p
    """,
}
