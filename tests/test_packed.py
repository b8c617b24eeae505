import pytest

from pathloom.operators.packed import split_cell, split_packed

A = "clinic key (Q1), refers to (P1), bed list (Q2)"
B = "clinic key (Q1), refers to (P1), bed list (Q2) -> bed list (Q2), part of (P2), ward (Q3)"
D = "clinic key (Q1) --[refers to] (P1)--> bed list (Q2) --[part of] (P2)--> ward (Q3)"


def first(text, paths):
    return [slot[0][0] for slot in split_cell(text, paths)]


@pytest.mark.parametrize("sep", [", ", ",", " ,", "; ", ";", " | ", "|", "/", " / ", "\n", "\t", "\r\n"])
def test_bare_ids(sep):
    assert first(sep.join(["Q1", "Q22", "Q3"]), False) == ["Q1", "Q22", "Q3"]


@pytest.mark.parametrize("sep", [", ", "; ", " | ", "\n"])
def test_labelled_entities(sep):
    assert first(sep.join(["bed list (Q1)", "ward's key (Q2)"]), False) == ["bed list (Q1)", "ward's key (Q2)"]


@pytest.mark.parametrize(
    "cell",
    ['["a, b (Q1)", "c \\"d\\" (Q2)", "e (Q3)"]', '"a, b (Q1)", "c ""d"" (Q2)", "e (Q3)"', "['a, b (Q1)', 'c \"d\" (Q2)', \"e (Q3)\"]", ' ["a, b (Q1)","c \\"d\\" (Q2)","e (Q3)"]\n'],
)
def test_quoted_spans_are_atomic(cell):
    assert first(cell, False) == ["a, b (Q1)", 'c "d" (Q2)', "e (Q3)"]


@pytest.mark.parametrize("sep", [" | ", "|", "; ", ";", " ;; ", "\n", "\r\n", "\t", " || "])
@pytest.mark.parametrize("one, two", [(A, B), (B, A), (D, A), (B, D)])
def test_paths(sep, one, two):
    assert first(one + sep + two, True) == [one, two]


@pytest.mark.parametrize("mark", ["• ", "* ", "- ", "1. ", "2) ", "(3) "])
def test_list_marks_and_headings(mark):
    assert first(f"Relevant paths:\n{mark}{A}\n{mark}{B}", True) == [A, B]


@pytest.mark.parametrize("edge", ["| {} |", " ;{} ;", "{}|| ", "\n{}\n", "  {} "])
def test_stray_delimiters(edge):
    assert first(edge.format(A), True) == [A]


def test_broken_pieces():
    assert first(A + " | bed list (Q2), part of (P2)", True) == [A]
    assert first(A + " | bed li", True) == [A]
    assert first(A + " -> bed list (Q2), part of (P2)", True) == [A + " -> bed list (Q2), part of (P2)"]
    assert first(A + " -> bed list (Q2), part of (P2) | " + B, True) == [A + " -> bed list (Q2), part of (P2)", B]
    assert first(A + " -> bed li", True) == [A + " -> bed li"]
    assert first("clinic key (Q1), refers to (P1), bed li", True) == []
    assert first("clinic key (Q1), refers to (P1) | " + B, True) == [B]


def test_angle_triples():
    assert first("<a, b, c>, <d, e, f g>", True) == ["<a, b, c>", "<d, e, f g>"]
    assert first("<a, b, c> <d, e> <f, g", True) == ["<a, b, c>"]


@pytest.mark.parametrize("cell", [None, "", "  ", "nan", "None", "null", "[]", '[""]', "No path found", "No path found | No path found"])
def test_nothing(cell):
    assert first(cell, True) == [] == first(cell, False)


def test_escapes():
    assert first('["caf\\u00e9 \\ud83d\\ude42 (Q1)", "half \\ud83d (Q2)"]', False) == ["café 🙂 (Q1)", "half \ufffd (Q2)"]


def test_very_long_cell():
    assert len(first(" | ".join([B] * 5000), True)) == 5000
    assert first("x" * 200_000, True) == []
    assert first("|" * 50_000 + A, True) == [A]


def test_split_packed(spark):
    rows = [(1, "", "Q1, Q2", None), (1, "", "Q1, Q2", None), (2, "v", None, A + " | " + B), (3, "v", None, None), (4, "v", "nan", "")]
    cells = spark.createDataFrame(rows, "pair_id bigint, variant string, wikidata_entities string, paths string")
    got = sorted(tuple(r) for r in split_packed(cells).collect())
    assert got == [
        (1, "wikidata_entities", "", 1, "Q1"), (1, "wikidata_entities", "", 2, "Q2"),
        (2, "paths", "v", 1, A), (2, "paths", "v", 2, B),
    ]
    assert split_packed(cells.limit(0)).collect() == []


def test_frequencies_decide_contested_splits(spark):
    label = "visit, secondary list (Q7)"
    sure = [(i, "", f'"{label}"') for i in range(5)] + [(10 + i, "", "list (Q8)") for i in range(5)]
    open_ = [(100, "", f"bed (Q1); {label}"), (101, "", "bed (Q1); note, list (Q8)"), (102, "", "bed (Q1); new, thing (Q9)")]
    cells = spark.createDataFrame(sure + open_, "pair_id bigint, variant string, wikidata_entities string")
    got = {(r.pair_id, r.pos): r["item"] for r in split_packed(cells).collect()}
    assert got[(100, 2)] == label  # known as a whole
    assert got[(101, 2)] == "list (Q8)"  # known without the piece before it
    assert got[(102, 2)] == "new, thing (Q9)"  # nothing known: nothing is left over
