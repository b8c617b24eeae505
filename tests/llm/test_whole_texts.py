from pathloom.llm.broken_pairs import LanguageModel, language_examples


def test_examples_are_whole_texts(spark):
    text = "word " * 2000 + "end"
    df = spark.createDataFrame([(text, "en")], "text string, lang string")
    assert language_examples(df, "text", "lang") == [(text, "en")]


def test_grams_reach_the_end_of_a_long_word():
    assert any("xyz" in g for g in LanguageModel.grams("a" * 60 + "xyz"))
