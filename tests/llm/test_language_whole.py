"""Every text with letters gets a learned language, however many there are."""

from __future__ import annotations

from marketloom.llm import language


def test_unknown_script_gets_the_most_frequent_language(spark):
    train = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, "eine katze", "de")], "doc_id long, text string, lang string")
    docs = spark.createDataFrame([(1, "東京都庁"), (2, "zzqq"), (3, "123"), (4, None), (5, "the cat")], "doc_id long, text string")
    got = {r.doc_id: tuple(r.found) for r in language.identify(docs, language.train(train)).collect()}
    assert got[1] == ("de", 0.0) and got[2][0] in ("de", "en")
    assert got[3] == got[4] == ("und", 0.0) and got[5][0] == "en"


def test_labels_without_n_grams_still_name_a_language(spark):
    train = spark.createDataFrame([(1, "1 2", "en")], "doc_id long, text string, lang string")
    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert [tuple(r.found) for r in language.identify(docs, language.train(train)).collect()] == [("en", 0.0)]


def test_more_than_64_languages(spark):
    word = lambda i: f"{chr(97 + i % 26) * 3}{chr(97 + i // 26) * 3}q"
    train = spark.createDataFrame([(i, " ".join([word(i)] * 5), f"l{i:03d}") for i in range(140)], "doc_id long, text string, lang string")
    model = language.train(train)
    assert len(model.planes) == 3
    langs, score = model.decide([word(i) for i in range(140)])
    assert langs == [f"l{i:03d}" for i in range(140)] and (score > 0).all()
