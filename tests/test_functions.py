import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orderledger.functions import (
    append_names,
    decimal_amount,
    is_blank,
    iso_date,
    merge_maps,
    normalize_names,
    positive_number,
    strip,
    title_case,
    whole_number,
)

TEXTS = [
    None, "", " ", "\t\xa0", "\x1c\x1f x  ", "0", "alice johnson", "o'neil mary-jane 3rd",
    "4-NOT SPECIFIED", "école ÉCOLE", "中a", "ΑΣ ΣΑΣ", "bß", "it's 5x", "a\tb", "a  b", "a_b", "x1y2",
    "éa", "ªb ʰc", "İstanbul",
]
NUMBERS = [
    None, "", " 5 ", "0", "-1", "2.5", "abc", "nan", "-nan", "inf", "-inf", "Infinity", "1e3", "1.", ".5",
    "1_000", "1__0", "_1", "1.5d", "1f", "0x10", "+7", "+ 7", "1e400", "1e-400", "9" * 25, "1_0.5_0",
]


def values(spark, items, expression):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i int, v string")
    rows = frame.select("i", expression(F.col("v")).alias("out")).collect()
    return [r.out for r in sorted(rows, key=lambda r: r.i)]


def test_text_agrees_with_python(spark):
    assert values(spark, TEXTS, strip) == [None if t is None else t.strip() for t in TEXTS]
    assert values(spark, TEXTS, is_blank) == [not (t or "").strip() for t in TEXTS]
    expected = [None if t is None else t.strip().lower().title() for t in TEXTS]
    assert values(spark, TEXTS, title_case) == expected


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.characters(codec="ascii", exclude_characters="\0"), max_size=20), min_size=20, max_size=60))
def test_title_case_agrees_with_python_on_any_ascii(spark, items):
    assert values(spark, items, title_case) == [t.strip().lower().title() for t in items]


def python_positive(text):
    try:
        number = float(str(text).strip())
    except ValueError:
        return None
    return number if number > 0 else None


def python_int(text):
    try:
        number = int(str(text).strip())
    except ValueError:
        return None
    return number if abs(number) < 2**63 else None


def test_numbers_agree_with_python(spark):
    assert values(spark, NUMBERS, positive_number) == [python_positive(n) for n in NUMBERS]
    assert values(spark, NUMBERS, whole_number) == [python_int(n) for n in NUMBERS]


def test_amounts_round_half_up_once(spark):
    texts = ["3.50", "0.125", "2.674999999999999999", "1e2", " 7 ", "nan", "inf", "abc", None, "1e17", "1_0.5"]
    got = [None if v is None else str(v) for v in values(spark, texts, decimal_amount)]
    assert got == ["3.50", "0.13", "2.67", "100.00", "7.00", None, None, None, None, None, "10.50"]


def test_amounts_stay_within_a_cent_of_python(spark):
    texts = [f"{i * 0.37:.4f}" for i in range(200)]
    for text, value in zip(texts, values(spark, texts, decimal_amount)):
        assert math.isclose(float(value), round(float(text), 2), abs_tol=0.0101)


def test_dates_are_strict(spark):
    texts = ["2026-06-01", " 2026-06-01 ", "2026-6-1", "2026", "2026-02-30", "0000-01-01", "2026-06-01x", "", None]
    got = [None if v is None else v.isoformat() for v in values(spark, texts, iso_date)]
    assert got == ["2026-06-01", "2026-06-01", None, None, None, None, None, None, None]


def test_name_lists_and_maps(spark):
    frame = spark.createDataFrame(
        [([" a ", "b", "", "a"], ["c", "b "], {"x": "1", "y": "2"}, {"y": "3"}), (None, None, None, {"z": None})],
        "a array<string>, b array<string>, m map<string,string>, n map<string,string>",
    )
    rows = frame.select(
        normalize_names(F.col("a")).alias("na"),
        append_names(F.col("a"), F.col("b")).alias("ab"),
        merge_maps(F.col("m"), F.col("n")).alias("mn"),
    ).collect()
    assert rows[0] == (["a", "b"], ["a", "b", "c"], {"x": "1", "y": "3"})
    assert rows[1] == ([], [], {"z": None})
