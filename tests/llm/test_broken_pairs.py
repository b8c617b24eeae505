import pytest

from pathloom.llm import broken_pairs as bp

EXAMPLES = [
    ("the clinic keeps a record of every visit and the bed list refers to the ward", "en"),
    ("first attribute described as the start of the payment, second attribute described as the number of rows", "en"),
    ("do both attributes carry one and the same meaning; links one order to its claim key", "en"),
    ("die spalte enthält für jeden fall nur den eintrag und das bett gehört zu der station", "de"),
    ("zwischen laborwert und versichertennummer besteht kein sicherer zusammenhang, solange pflegestufe fehlt", "de"),
    ("la colonne contient pour chaque séjour le lit occupé, mais jamais la ligne de facture", "fr"),
    ("nous gardons le motif de sortie à part, puisque le dossier patient change chaque jour", "fr"),
    ("таблица содержит номер полиса и карта пациента удаляется через день", "ru"),
]
Q = "First attribute a-key_x, described as the start of the payment \nSecond attribute b-key_y, described as the bed list of the clinic \nDo both attributes carry one and the same meaning?"
A = "clinic record (Q1), refers to (P1), bed list (Q2)"
B = A + " -> bed list (Q2), keeps the (P2), claim key (Q3)"


@pytest.fixture(scope="module")
def model():
    return bp.LanguageModel(EXAMPLES)


@pytest.mark.parametrize("answer", [None, "", " ", "\n", "nan", "None", "N/A", "null", "-", ".", "[]", '[""]', '""', "  \t", "{}", "```\n```"])
def test_empty(model, answer):
    assert bp.classify(Q, answer, model) == "empty"


@pytest.mark.parametrize(
    "answer",
    [
        A, B, A + " | " + B, f'["{A}", "{B}"]', f"['{A}', '{B}']", f'"{A}";"{B}"', f"Relevant paths:\n• {A}\n• {B}", f"1. {A}\n2. {B}",
        A + " |", " ;" + A + " ;", A + "|| ", f"```\n{A}\n```", f' ["{A}"]\n', "<clinic, refers to, bed list>", "clinic (Q1) --[refers to] (P1)--> bed list (Q2)",
        "treatment refusal version (Q4), refers to (P1), unable to work status (Q5)", "visit, the list (Q4), refers to (P1), bed; the claim (Q5)",
        f'["{A}", "bed | the view (Q3), keeps the (P2), claim key (Q4)"]', f'["{A}"',
    ],
)
def test_sound(model, answer):
    assert bp.classify(Q, answer, model) is None


@pytest.mark.parametrize("cut", range(8, len(B)))
def test_every_cut_inside_a_path_is_found(model, cut):
    at_end = B[:cut].rstrip() == A
    assert bp.classify(Q, B[:cut], model) == (None if at_end else "truncated")


@pytest.mark.parametrize("tail", [" | clinic rec", "\nclinic record (Q1), ref", '", "bed li', " ;; bed list (Q2), keeps the (P2)", " -> bed list (Q2"])
def test_cut_behind_a_whole_path(model, tail):
    lead = '["' if tail.startswith('"') else ""
    assert bp.classify(Q, lead + A + tail, model) == "truncated"


@pytest.mark.parametrize(
    "answer",
    [
        "I'm sorry, but I can't help with matching a-key_x to anything.", "My guidelines keep me from answering questions about a-key_x.",
        "This request cannot be fulfilled.", "> I must decline to answer, because b-key_y needs review. (mentioned: bed list)",
        "1. Without further context it is impossible for me to provide an answer on a-key_x.", "[system] No answer will be given here.",
        "AS AN ASSISTANT I AM NOT ABLE TO LOOK INTO THE GRAPH.", "Es tut mir leid, aber a-key_x liegt außerhalb meiner Aufgaben.",
        "Lo siento, no puedo ofrecer rutas para a-key_x.", "Je dois refuser de répondre à cette demande.",
    ],
)
def test_refusals(model, answer):
    assert bp.classify(Q, answer, model) == "refusal"


@pytest.mark.parametrize("answer", [Q, Q.lower(), Q.upper(), "Q: " + Q, Q.rsplit("\n", 1)[0], Q.rsplit("\n", 1)[0].replace(" \n", " "), "You asked:\n" + Q, Q + "\n" + Q.rsplit("\n", 1)[1]])
def test_copies(model, answer):
    assert bp.classify(Q, answer, model) == "copied_question"


@pytest.mark.parametrize(
    "answer",
    [
        "Zwischen Laborwert und Pflegestufe besteht kein sicherer Zusammenhang.", "Nous gardons le dossier patient à part, puisque le lit change chaque jour.",
        "номер полиса (Q1), содержит (P1), карта пациента (Q2)", "Laborwert (Q1), gehört zu (P1), Pflegestufe (Q2)",
        '["\\u043d\\u043e\\u043c\\u0435\\u0440 (Q1), \\u0441\\u043e (P1), \\u043a\\u0430 (Q2)"]',
    ],
)
def test_other_language(model, answer):
    assert bp.classify(Q, answer, model) == "other_language"


def test_own_language_is_sound(model):
    german = "Erstes Attribut a-key_x, die spalte enthält für jeden fall nur den eintrag \nZweites Attribut b-key_y, das bett gehört zu der station"
    assert bp.classify(german, "Laborwert (Q1), gehört zu (P1), Pflegestufe (Q2)", model) is None
    assert bp.classify(german, A, model) == "other_language"


def test_tiling():
    assert bp.tiled_share(list("abcdef"), list("xxabcdefyy")) == 1.0
    assert bp.tiled_share(list("abcxyz"), list("abc")) == 0.5
    assert bp.tiled_share(list("ab"), list("ab")) == 0.0
    assert bp.tiled_share([], list("ab")) == 0.0 == bp.tiled_share(list("ab"), [])
    assert bp.tiled_share(list("abcabc"), list("abc")) == 1.0


def test_table(spark):
    kind = "pair_id bigint, question string, wikidata_paths_llm string, defect string, key int"
    rows = [(1, Q, A, "x", 1), (2, Q, None, "x", 2), (2, Q, None, "y", 3), (3, None, A, "x", 1), (4, None, None, "x", 1), (5, Q, "clinic rec", None, None), (None, Q, "", "x", 1), (6, Q, "word " * 50_000, "x", 1)]
    df = spark.createDataFrame(rows, kind)
    got = {tuple(r) for r in bp.broken_pairs(df, EXAMPLES).collect()}
    assert {(2, "empty"), (4, "empty"), (5, "truncated"), (None, "empty")} <= got and not {1, 3} & {g[0] for g in got}
    assert bp.broken_pairs(df.limit(0), EXAMPLES).collect() == []
    assert {tuple(r) for r in bp.broken_pairs(df.filter("pair_id < 3"), []).collect()} == {(2, "empty")}


def test_examples_are_bounded(spark):
    rows = [(f"text {i}", "en" if i % 2 else "EN-gb") for i in range(50)] + [("x", None), (None, "de"), ("y", "und"), ("z", "")]
    got = bp.language_examples(spark.createDataFrame(rows, "text string, lang string"), "text", "lang", 7)
    assert len(got) == 7 and {lang for _, lang in got} == {"en"}
