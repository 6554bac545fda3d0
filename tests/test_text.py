from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weftlink.functions import text


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("value", "expected"),
    [("Société Élan", "societe elan"), ("A & B", "a and b"), ("O'Neil-Sons", "o neil sons"), ("nan", ""), ("NaN", "nan"), ("Acme™", "acmeTM"), (None, ""), ("", ""), ("  x \t y\n", "x y"), ("a_b", "a_b"), ("हिन्दी", "ह नद")],
)
def test_clean_text(spark, value, expected):
    assert one(spark, value, text.clean_text) == expected


@pytest.mark.parametrize(("value", "expected"), [("Group Holdings", "group holdings"), ("Zenith Pvt Ltd", "zenith"), ("Ste Omega", "omega"), (None, ""), ("Big Big Inc", "big big")])
def test_clean_name(spark, value, expected):
    assert one(spark, value, text.clean_name) == expected


@pytest.mark.parametrize(("value", "expected"), [("12 Oak St", "12 oak street"), ("Ste 4", "suite 4"), ("PO Box 7", "po box 7"), (None, "")])
def test_clean_address(spark, value, expected):
    assert one(spark, value, text.clean_address) == expected


def test_codes_and_numbers(spark):
    assert one(spark, "75001 560001", text.postal_codes) == ["560001", "75001"]
    assert one(spark, "1234567", text.postal_codes) == []
    assert one(spark, "10001 10001", text.postal_codes) == ["10001"]
    assert sorted(one(spark, "12 a34 5", text.numbers)) == ["12", "5"]
    assert one(spark, None, text.numbers) == []


def test_ngrams_and_words(spark):
    assert one(spark, "ab", text.char_ngrams) == ["ab"]
    assert one(spark, "ab cd", text.char_ngrams) == ["abc", "bcd"]
    assert one(spark, "", text.char_ngrams) == []
    assert one(spark, "nan", text.char_ngrams) == []
    assert one(spark, "a b a", text.word_tokens) == ["a", "b", "a"]


def test_vocabularies():
    assert len(text.LEGAL_FORMS) == 47
    assert len(text.ADDRESS_WORDS) == 22
