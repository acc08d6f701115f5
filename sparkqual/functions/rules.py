"""Quality rules as Columns.

A rule set is a list of `{"column", "data_type", "rules": [{"rule", "value", "operator",
"dimension", "format"}]}`. Each rule compiles to a `Check`; all checks of a rule set are
evaluated in one scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..plans.longform import quoted
from . import formula as formulas
from . import text
from .values import to_number

COMPARISONS = {
    "equalto": lambda a, b: a == b,
    "Shouldbe": lambda a, b: a == b,
    "notequalto": lambda a, b: a != b,
    "greaterthan": lambda a, b: a > b,
    "greaterthanequalto": lambda a, b: a >= b,
    "lessthan": lambda a, b: a < b,
    "lessthanequalto": lambda a, b: a <= b,
    "=": lambda a, b: a == b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
}

# Which score a rule counts towards when it names none.
DIMENSIONS = {
    "DataType": "Validity",
    "Length": "Validity",
    "MinLength": "Validity",
    "MaxLength": "Validity",
    "Value": "Accuracy",
    "Formula": "Accuracy",
    "ReferenceCDE": "Integrity",
}


@dataclass(frozen=True)
class Check:
    """One compiled rule: `applies` rows are counted, `passes` of them are right."""

    rule_id: str
    column: str
    rule: str
    dimension: str
    applies: Column
    passes: Column
    observed: Column

    @property
    def violated(self) -> Column:
        return self.applies & ~self.passes


def _sure(c: Column) -> Column:
    """A condition that is never null: unknown counts as false."""
    return F.coalesce(c, F.lit(False))


def data_type_fits(df: DataFrame, name: str, wanted: str) -> Column:
    """Letters and digits for Text and Alphanumeric, a parsable number for Numeric,
    a parsable date for Datetime (Q5, Q6)."""
    kind, c = df.schema[name].dataType, quoted(name)
    label = wanted.lower()
    if label in ("text", "alphanumeric"):
        return text.is_alnum(c.cast("string"))
    if label == "numeric":
        return F.lit(True) if isinstance(kind, T.NumericType) else to_number(c).isNotNull()
    if label == "datetime":
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return F.lit(True)
        return F.try_to_timestamp(c.cast("string")).isNotNull()
    raise ValueError(f"unknown data type {wanted}")


def measured_length(df: DataFrame, name: str) -> Column:
    """Digits of a numeric column, characters of any other."""
    c = quoted(name)
    if isinstance(df.schema[name].dataType, T.NumericType):
        return text.count_digits(c)
    return text.text_length(c)


def compares(c: Column, operator: str, value: str) -> Column:
    """Compare as numbers where `value` is one, else as text (Q10)."""
    if operator not in COMPARISONS:
        raise ValueError(f"unknown operator {operator}")
    number = formulas.as_number(value)
    if number is not None:
        return COMPARISONS[operator](to_number(c), F.lit(number))
    return COMPARISONS[operator](c.cast("string"), F.lit(value))


def numeric_relation(c: Column, conditions: Sequence[Mapping[str, object]]) -> Column:
    """All of `{"operator", "value"}` conditions; `between` takes a closed (low, high)."""
    out = F.lit(True)
    for cond in conditions:
        if cond["operator"] == "between":
            low, high = cond["value"]
            out = out & c.between(low, high)
        else:
            out = out & COMPARISONS[cond["operator"]](c, F.lit(cond["value"]))
    return out


def conjunction(conditions: Mapping[str, str] | Sequence[str]) -> Column:
    """SQL condition texts joined by AND (F4); `==`, `&`, `|` and double quotes are accepted."""
    texts = conditions.values() if isinstance(conditions, Mapping) else conditions
    out = F.lit(True)
    for cond in texts:
        out = out & F.expr(formulas.to_sql(cond))
    return out


def _check(df: DataFrame, name: str, rule: Mapping, rule_id: str, null_as: object) -> Check:
    c, kind, value = quoted(name), rule["rule"], rule.get("value")
    present, everyone = c.isNotNull(), F.lit(True)
    if kind == "DataType":
        applies, passes = present, data_type_fits(df, name, value)
    elif kind in ("Length", "MinLength", "MaxLength"):
        size, n = measured_length(df, name), int(float(value))
        passes = {"Length": size == n, "MinLength": size >= n, "MaxLength": size <= n}[kind]
        applies = present
    elif kind == "Value":
        applies, passes = everyone, compares(c, rule["operator"], str(value))
    elif kind == "Formula":
        applies = everyone
        passes = ~formulas.violated(value, null_as)
    else:
        raise ValueError(f"unknown rule {kind}")
    return Check(
        rule_id,
        name,
        kind,
        rule.get("dimension") or DIMENSIONS[kind],
        applies,
        _sure(passes),
        c.cast("string"),
    )


def compile_rules(
    df: DataFrame, ruleset: Sequence[Mapping], null_as: object = None
) -> list[Check]:
    """Row-level checks of a rule set; reference rules are joins and are left out here.

    `null_as` replaces nulls inside formulas; by default an unknown condition is false.
    """
    checks = []
    for entry in ruleset:
        for i, rule in enumerate(entry["rules"]):
            if rule["rule"] != "ReferenceCDE":
                rule_id = f"{entry['column']}:{rule['rule']}:{i}"
                checks.append(_check(df, entry["column"], rule, rule_id, null_as))
    return checks


def reference_rules(ruleset: Sequence[Mapping]) -> list[tuple[str, str, str, str]]:
    """(rule_id, column, reference id, reference column) of every reference rule."""
    found = []
    for entry in ruleset:
        for i, rule in enumerate(entry["rules"]):
            if rule["rule"] == "ReferenceCDE":
                _, ref_id, ref_column = str(rule["value"]).split("-", 2)
                found.append((f"{entry['column']}:ReferenceCDE:{i}", entry["column"], ref_id, ref_column))
    return found


def key_is_outlier(c: Column, data_type: str) -> Column:
    """Key value that does not fit the key's declared type (Q15); unknown types never fit."""
    fits = {
        "Alphanumeric": text.is_alnum,
        "Text": text.is_alpha,
        "Numeric": text.is_number_text,
    }.get(data_type, lambda _: F.lit(False))
    return ~_sure(fits(c.cast("string")))
