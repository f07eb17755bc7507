import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.functions.readingform import LOOKALIKES, for_collation, reading_form, reading_form_col, reading_form_sql, same_alphabet_form, unfolded


def test_what_makes_no_difference_and_what_does():
    assert reading_form("Ｆｏｒｍ　１０－Ｋ") == "Form 10-K"
    assert reading_form("of­ﬁ​ce﻿") == "office"
    assert reading_form("café") == "café"
    assert reading_form("Ё") == "Ë" == reading_form("Ё")  # Cyrillic with diaeresis and the Latin letter
    assert reading_form("a b c d") == "a b c d"
    assert reading_form("Velmοra Ѕуstem") == "Velmora System"
    for a, b in (("Cafe", "café"), ("m²", "m2"), ("a.", "a"), ("A", "a"), ("…", "..."), ("½", "1/2")):
        assert reading_form(a) != reading_form(b)
    assert same_alphabet_form("ﬁ Ｒｏсt\u200b е\u0301") == "fi Roсt е\u0301" and same_alphabet_form(None) is None
    assert reading_form(None) is None and reading_form("") == ""
    assert reading_form("a\U0001d173b\U000e0041") == "ab"  # signs beyond the first plane that cannot be seen


def test_the_collation_tells_texts_apart_exactly_as_reading_does(spark):
    rows = []
    for c in [*range(1, 0xD800), *range(0xE000, 0x1FFFF, 3), *range(0xE0000, 0xE0200)]:
        if unicodedata.category(chr(c)) != "Cn":
            for form in ("NFC", "NFD"):
                text = "a" + unicodedata.normalize(form, chr(c)) + "b"
                rows.append((for_collation(unfolded(text)), reading_form(text)))
    spark.createDataFrame(rows, "t string, f string").createOrReplaceTempView("texts")
    assert spark.sql("SELECT count(*) FROM texts GROUP BY t COLLATE UNICODE HAVING count(DISTINCT f) > 1").isEmpty()
    assert spark.sql("SELECT count(*) FROM texts GROUP BY f HAVING count(DISTINCT t COLLATE UNICODE) > 1").isEmpty()
    assert not spark.sql("SELECT count(*) FROM texts GROUP BY f HAVING count(DISTINCT t) > 1").isEmpty()  # the characters alone do not tell


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_it_is_stable_and_composed(text):
    once = reading_form(text)
    assert reading_form(once) == once
    assert unicodedata.is_normalized("NFC", once)
    assert not set(once) & set(LOOKALIKES)
    assert once.count("\n") == text.count("\n")


def test_the_same_in_sql():
    import duckdb

    texts = ["Ｆｏｒｍ　１０－Ｋ", "of­ﬁ​ce﻿", "cafe\u0301", "Velmοra Ѕуstem", "a\u00a0b\u2009c", "it's ＇so＇", "", "Ё é m² …"]
    sql = reading_form_sql("t")
    assert [duckdb.execute(f"SELECT {sql} FROM (SELECT ? AS t)", [t]).fetchone()[0] for t in texts] == [reading_form(t) for t in texts]


def test_column_keeps_nulls(spark):
    df = spark.createDataFrame([("ａ​",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(reading_form_col("t")).collect()] == ["a", None, ""]
