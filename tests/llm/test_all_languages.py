from __future__ import annotations

from sievelake.llm.labelled import LONGEST
from sievelake.llm.language_id import fit_languages, language_id

SCHEMA = "doc_id bigint, text string, lang string"


def test_rare_languages_are_learned(spark):
    rows = [(i, f"word{i} " * 3, f"l{i:03}") for i in range(420)]
    book = fit_languages(spark.createDataFrame(rows, SCHEMA))
    assert book.languages == [f"l{i:03}" for i in range(420)]


def test_language_of_long_texts_only(spark):
    short = [(i, "the cat and the dog went out to sea " * 3, "en") for i in range(5)] + [(5, "der hund und die katze sind im garten " * 3, "de")]
    long = [(9, "le chat et le chien sont dans la maison " * (LONGEST // 40 + 50), "fr"), (10, "der " * LONGEST, "de")]
    docs = spark.createDataFrame(short + long, SCHEMA)
    book = fit_languages(docs)
    assert book.languages == ["de", "en", "fr"]
    told = {r["doc_id"]: r["lang_pred"] for r in language_id(docs, book).collect()}
    assert told[9] == "fr" and told[0] == "en" and told[5] == "de"
