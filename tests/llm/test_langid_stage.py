import corpus_pipeline
from graphloom.llm import langid

SCHEMA = "doc_id long, text string, lang string"


def test_unlabelled_corpus_keeps_every_text_with_a_letter(spark):
    rows = [(1, "plain english words", None), (2, None, None), (3, "123 ...", None), (4, "été", None), (5, "", None)]
    kept = corpus_pipeline.language_id(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4]


def test_language_with_long_texts_only_is_learned(spark):
    long_text = "der schnelle braune Fuchs springt über den faulen Hund " * 2000
    assert len(long_text) > langid.SAMPLE_TEXT
    rows = [(None, long_text, "de"), (None, "the quick brown fox jumps over the lazy dog", "en")]
    model = langid.fit_languages(spark.createDataFrame(rows, SCHEMA))
    assert model.langs == ("de", "en")
    assert langid.identify(model, ["der faule Hund springt über den Fuchs"])[0] == ["de"]


def test_every_label_is_learned(spark):
    rows = [(None, f"word{k} " * 5, f"l{k:03}") for k in range(230)]
    assert len(langid.fit_languages(spark.createDataFrame(rows, SCHEMA)).langs) == 230
