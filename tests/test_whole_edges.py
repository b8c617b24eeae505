"""The graph holds every written triple: comma-written ones and hops, chained ones too."""

from pathloom.plans import queries
from pathloom.sources import catalog

HOPS = '["a (Q1) --[p one] (P1)--> b (Q2) --[p two] (P2)--> c | d (Q3) --[p three] (P3)--> e (Q4)"]'
COMMAS = "a (Q5), p (P5), b (Q6) -> b (Q6), p (P6), c (Q7), p (P7), d (Q8)\nx (Q9), p (P9), cut"
MIXED = "a (Q10) --[p] (P10)--> b (Q11)\r\nc (Q12), p (P12), d (Q13) ;; e (Q14) --[p] (P14)--> cut off"
EDGES = {
    ("Q1", "P1", "Q2"), ("Q2", "P2", "Q3"), ("Q3", "P3", "Q4"), ("Q5", "P5", "Q6"), ("Q6", "P6", "Q7"),
    ("Q7", "P7", "Q8"), ("Q10", "P10", "Q11"), ("Q12", "P12", "Q13"),
}


def test_hops_and_chained_triples_are_edges(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(COMMAS,), (None,)], "wikidata_paths_llm string").write.parquet(f"{d}/question_sheet.parquet")
    spark.createDataFrame([(HOPS,), (MIXED,), (HOPS,), (None,), ("",)], "paths string").write.parquet(f"{d}/context_variants.parquet")
    rows = [tuple(r) for r in catalog.edges(spark, d).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == EDGES
    assert {(r.head, r.predicate, r.tail) for r in queries.QUERIES["capped_edges"](spark, d).collect()} == EDGES


def test_the_given_cells_lose_no_hop(spark, sf_dir):
    from pathloom.session import table

    cells = [r[0] for r in table(spark, sf_dir, "context_variants").select("paths").collect() if r[0]]
    steps = [c.split(")--> ") for c in cells]
    ends = lambda before, after: (before.rsplit("(Q", 1)[1].split(")")[0], before.rsplit("(P", 1)[1], after)
    want = set()
    for parts in steps:
        for before, after in zip(parts, parts[1:]):
            head, sep, rest = after.partition(" (Q")
            if sep and "(" not in head:
                q, p, _ = ends(before, after)
                want.add((f"Q{q}", f"P{p}", f"Q{rest.split(')')[0]}"))
    assert want and want <= {tuple(r) for r in catalog.edges(spark, sf_dir).collect()}
