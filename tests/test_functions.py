"""Scalar functions, rules and formulas on small literal frames."""

from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from sparkqual.functions import formula, kinds, rules, text, values


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(build(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "value, expected",
    [("a_b1 9", "LLDSD"), ("Émile", "LLLL"), ("x-y", "LSL"), ("", ""), (None, None), ("1.5", "DSD"), ("日本1", "D")],
)
def test_mask(spark, value, expected):
    assert one(spark, value, text.mask) == expected


@pytest.mark.parametrize(
    "value, expected",
    [("a 12-b3", "W-S-N-S"), ("Kelly, Mr. James", "W-W"), ("", ""), ("12", "S-N"), ("a.b", ""), ("x;y_z", "W-W-W")],
)
def test_pattern(spark, value, expected):
    assert one(spark, value, text.pattern) == expected


@pytest.mark.parametrize("value, expected", [("a  b\tc", "W-W-W"), ("", ""), (" x ", "W")])
def test_word_pattern(spark, value, expected):
    assert one(spark, value, text.word_pattern) == expected


def test_length_mask(spark):
    assert one(spark, "abc", text.length_mask) == "L3"
    assert one(spark, None, text.length_mask) == "L"


def test_strip_and_classes(spark):
    assert one(spark, "\t a b \n", text.strip) == "a b"
    assert one(spark, "äö", text.is_alpha) is True
    assert one(spark, "a1", text.is_alnum) is True
    assert one(spark, "a 1", text.is_alnum) is False
    assert one(spark, "12", text.is_digits) is True
    assert one(spark, "ref-7-col-a", text.split_reference).asDict() == {"ref": "ref", "id": "7", "column": "col-a"}


def test_numbers_and_dates(spark):
    assert one(spark, "1e3", values.to_number) == 1000.0
    assert one(spark, "122,875", values.to_number) is None
    assert one(spark, "x", values.to_number) is None
    assert one(spark, 2.5, lambda c: values.half_even(c, 0), "double") == 2.0
    assert one(spark, "03/02/2024", values.parse_time) == dt.datetime(2024, 2, 3)
    assert one(spark, "31-12-2023", values.parse_time) == dt.datetime(2023, 12, 31)
    assert one(spark, "2024-01-05T10:11:12.000001Z", values.parse_instant) == dt.datetime(2024, 1, 5, 10, 11, 12, 1)
    assert one(spark, float("inf"), values.finite_or_zero, "double") == 0.0
    assert one(spark, float("nan"), values.finite_or_zero, "double") == 0.0
    assert one(spark, ["a"], lambda c: values.overlaps(c, ["b", "a"]), "array<string>") is True
    assert one(spark, None, values.shown) == "None"


def test_type_labels(spark):
    df = spark.createDataFrame([], "a int, b string, c timestamp, d boolean, year string, e array<int>, f decimal(9,2)")
    labels = {f.name: kinds.type_label(f) for f in df.schema}
    assert labels == {"a": "Numeric", "b": "Alphanumeric", "c": "DateTime", "d": "Boolean", "year": "Numeric",
                      "e": "Other", "f": "Numeric"}
    assert kinds.flat_columns(df) == ["a", "b", "c", "d", "year", "f"]
    assert kinds.nominal_columns(df) == ["b", "d", "year"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=12), min_size=1, max_size=30))
def test_mask_is_never_longer_than_the_value(spark, words):
    rows = spark.createDataFrame([(w,) for w in words], "v string")
    got = rows.select(text.mask(F.col("v")).alias("m"), F.length("v").alias("n")).collect()
    assert all(len(r["m"]) <= r["n"] and set(r["m"]) <= set("LDS") for r in got)


def condition(operand, operator, value="", condition="", operand2="", group=()):
    return {"operand1": operand, "operator1": operator, "operand2": operand2, "value": value,
            "condition": condition, "operator2": "", "group": list(group)}


def broken(spark, rows, schema, branches, **options):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.filter(formula.violated(branches, **options)).select("id").collect()]


ROWS = [(1, 10, "F", 5.0), (2, 20, "F", 50.0), (3, 30, "O", 5.0), (4, None, "F", None), (5, 20, None, 5.0)]
SCHEMA = "id int, a int, s string, p double"


def test_formula_if_then(spark):
    branches = [{"logic": "If", "operand": "p", "operator": ">", "value": "10", "formula": [condition("s", "==", "F")]}]
    assert broken(spark, ROWS, SCHEMA, branches) == [1, 4]


def test_formula_and_or_precedence(spark):
    # s = F OR (s = O AND a > 100)
    conds = [condition("s", "==", "F", "OR"), condition("s", "==", "O", "AND"), condition("a", ">", "100")]
    branches = [{"logic": "If", "operand": "p", "operator": "<", "value": "2.5", "formula": conds}]
    assert broken(spark, ROWS, SCHEMA, branches) == [1, 2, 4]


def test_formula_group_is_parenthesised(spark):
    # a = 20 AND (s = F OR s = O)
    group = [condition("s", "==", "F", "AND"), condition("s", "==", "O", "OR")]
    branches = [{"logic": "If", "operand": "p", "operator": "<", "value": "0", "formula": [condition("a", "==", "20", group=group)]}]
    assert broken(spark, ROWS, SCHEMA, branches) == [2]


def test_formula_branches_and_null_as_zero(spark):
    branches = [
        {"logic": "If", "operand": "p", "operator": ">=", "value": "50", "formula": [condition("a", "<", "25")]},
        {"logic": "Else if", "operand": "p", "operator": "=", "value": "5", "formula": [condition("a", "==", "20")]},
    ]
    assert broken(spark, ROWS, SCHEMA, branches) == [1]
    numbers = [(i, a, p) for i, a, _, p in ROWS]
    assert broken(spark, numbers, "id int, a int, p double", branches, null_as=0) == [1, 4]


def test_formula_two_columns_and_plain_text(spark):
    two = [{"logic": "If", "operand": "s", "operator": "==", "value": "O", "formula": [condition("a", ">", operand2="p")]}]
    assert broken(spark, ROWS, SCHEMA, two) == [1, 5]
    plain = [{"logic": "", "formula": [], "formulaText": 'a >= 20 & s == "F"'}]
    assert broken(spark, ROWS, SCHEMA, plain) == [1, 3, 4, 5]


def test_unknown_operator_is_an_error(spark):
    with pytest.raises(ValueError):
        formula.violated([{"logic": "If", "operand": "p", "operator": "~", "value": "1", "formula": [condition("a", "<", "1")]}])
    with pytest.raises(ValueError):
        rules.compares(F.col("a"), "near", "1")


def test_numeric_rule_accepts_negative_numbers_and_exponents(spark):
    df = spark.createDataFrame([("-1.5",), ("1e5",), ("12a",), (None,)], "v string")
    got = [r[0] for r in df.select(rules.data_type_fits(df, "v", "Numeric")).collect()]
    assert got == [True, True, False, False]


def test_key_outliers(spark):
    for value, kind, expected in (("abc", "Text", False), ("a1", "Text", True), ("12", "Numeric", False),
                                  ("1.2", "Numeric", True), ("a1", "Alphanumeric", False), ("x", "Datetime", True)):
        assert one(spark, value, lambda c: rules.key_is_outlier(c, kind)) is expected


def test_texts_in_conditions_stay_as_they_are(spark):
    names = ["AT&T", "a==b", "O'Brien", 'say "hi"', "a|b", "back\\slash", "plain"]
    df = spark.createDataFrame([(n, k) for k, n in enumerate(names)], "name string, k int")
    cases = {
        'name == "AT&T"': [0], 'name = "a==b"': [1], 'name == "O\'Brien"': [2], "name == 'O''Brien'": [2],
        'name == "say ""hi"""': [3], "name == 'say \"hi\"' | k == 6": [3, 6], 'name == "a|b" & k > 1': [4],
        "name == 'back\\slash'": [5], "`name` == 'plain' && k >= 0 || k = 0": [0, 6],
    }
    for condition, want in cases.items():
        found = df.filter(rules.conjunction([condition])).select("k").collect()
        assert sorted(r["k"] for r in found) == want, condition
    read = formula.columns_read("`a b` > 1 & name == 'value' | K < 3", ["a b", "a", "name", "value", "k"])
    assert read == ["a b", "name", "k"]


def test_text_and_number_tests(spark):
    df = spark.createDataFrame([("abc\n",), ("1\n2",), ("1d",), ("0x1p3",), (" 1.5e3 ",), ("-.5",), ("NaN",), ("1f",), ("7.",)], "t string")
    found = df.select(
        text.is_alpha(F.col("t")).alias("a"), text.is_alnum(F.col("t")).alias("n"), values.to_number(F.col("t")).alias("v")
    ).collect()
    assert [r["a"] for r in found] == [False] * 6 + [True, False, False]
    assert [r["n"] for r in found][:3] == [False, False, True]
    assert [r["v"] for r in found] == [None, None, None, None, 1500.0, -0.5, None, None, 7.0]
