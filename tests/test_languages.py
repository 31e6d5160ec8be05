"""Languages of short questions and of texts in other scripts; dictionaries as tables."""

import pytest
from pyspark.sql import functions as F

from brindle.functions import language as L

CASES = [
    ("hi", "en"),
    ("thanks, that's helpful!", "en"),
    ("what books do we have?", "en"),
    ("summarize Frankenstein in a few sentences of the book", "en"),
    ("Who is Sun Wukong's master in Journey to the West?", "en"),
    ("In The Speckled Band, what killed Julia Stoner?", "en"),
    ("¿Cómo se llama el caballo de Don Quijote?", "es"),
    ("¿Quién escribió Cien años de soledad?", "es"),
    ("Comment meurt Emma Bovary ?", "fr"),
    ("Peux-tu résumer Madame Bovary ?", "fr"),
    ("La mise en scène est belle ?", "fr"),
    ("In was verwandelt sich Gregor Samsa?", "de"),
    ("Fasse den Roman in wenigen Sätzen zusammen", "de"),
    ("Chi è il conte di montecristo?", "it"),
    ("Quem escreveu os maias?", "pt"),
    ("Wie heet de vrouw in het zwart?", "nl"),
    ("Kto jest Pan Tadeusz?", "pl"),
    ("Fatih'te kim yaşar?", "tr"),
    ("Sino si Maria Clara?", "tl"),
    ("Ano ang sinulat ng mga tauhan?", "tl"),
    ("Кто такой Эола?", "ru"),
    ("Ποιος είναι ο Οδυσσέας;", "el"),
    ("孫悟空の兵器は何か？", "ja"),
    ("孫悟空的兵器是什麼？", "zh"),
    ("손오공의 무기는 무엇입니까?", "ko"),
    ("ใครเป็นคนเขียนหนังสือเล่มนี้", "th"),
    ("यह किताब किसने लिखी?", "hi"),
    ("من كتب هذا الكتاب؟", "ar"),
    ("מי כתב את הספר?", "he"),
    ("The title of the book is 三國演義 in the catalogue", "en"),
    ("tu", None),
    ("42", None),
    ("AW-2000", None),
    ("... ?!", None),
    ("   ", None),
    ("", None),
    (None, None),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, text string")
    got = {r.i: r.lang for r in df.select("i", L.detected_language(F.col("text")).alias("lang")).collect()}
    assert [(t, got[i]) for i, (t, _) in enumerate(CASES)] == CASES


def test_the_order_of_the_tables_does_not_matter(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, text string")
    turned = L.detected_language(F.col("text"), dict(reversed(list(L.STOPS.items()))), dict(reversed(list(L.MARKS.items()))))
    assert df.where(~turned.eqNullSafe(L.detected_language(F.col("text")))).count() == 0


def test_a_dictionary_from_a_table(spark, monkeypatch):
    rows = [("sv", "Och", False), ("sv", "och", None), ("sv", "å", True), ("sv", "inte", True), ("en", "and", False), ("en", "", False), (None, "x", True)]
    words = spark.createDataFrame(rows, "lang string, word string, mark boolean")
    stops, marks = L.dictionary(words)
    assert stops == {"en": ["and"], "sv": ["och"]} and marks == {"en": [], "sv": ["inte", "å"]}
    df = spark.createDataFrame([("and och och",), ("and och",), ("and inteligens",), ("å",), ("the",)], "text string")
    assert [r.lang for r in df.select(L.detected_language(F.col("text"), stops, marks).alias("lang")).collect()] == ["sv", "en", "sv", "sv", None]
    monkeypatch.setattr(L, "DICTIONARY_MOST", 3)
    with pytest.raises(ValueError, match="over 3"):
        L.dictionary(words)
