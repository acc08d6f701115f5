"""IF / THEN formulas given as nested dictionaries, compiled to Columns (Q11, Q12).

A formula is a list of branches. A branch has `logic`, a list `formula` of conditions and a
consequence `operand operator value`. A condition compares `operand1` by `operator1` with
the column `operand2` or the literal `value`; `condition` (AND / OR) ties it to the next one,
and `group` holds nested conditions appended in parentheses, each with its own AND / OR.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from ..plans.longform import quoted

# Operator spellings of formulas.
_OPERATORS = {
    "==": "=", "=": "=", "equalto": "=", "!=": "<>", "<>": "<>", "notequalto": "<>",
    ">": ">", "greaterthan": ">", ">=": ">=", "greaterthanequalto": ">=",
    "<": "<", "lessthan": "<", "<=": "<=", "lessthanequalto": "<=",
}


def as_number(value: object) -> float | None:
    """The literal as a number, if it is written as one."""
    text = str(value).strip()
    return float(text) if re.fullmatch(r"[-+]?\d+(\.\d+)?([eE][-+]?\d+)?", text) else None


# A quoted text ("" and '' inside stand for the quote), a quoted name, or text between them.
_PARTS = re.compile(r"""\"((?:[^"]|"")*)\"|'((?:[^']|'')*)'|(`[^`]*`)|([^"'`]+|.)""", re.DOTALL)


def _parts(condition: str) -> list[tuple[str, str]]:
    """(kind, content) of a condition's parts: text, name or code."""
    out = []
    for double, single, name, code in _PARTS.findall(condition):
        if code or name:
            out.append(("code", code) if code else ("name", name))
        else:
            out.append(("text", double.replace('""', '"') if double else single.replace("''", "'")))
    return out


def to_sql(condition: str) -> str:
    """Accept `&`, `|`, `==` and double-quoted texts in a condition; texts themselves stay as they are."""
    out = []
    for kind, content in _parts(condition):
        if kind == "text":
            escaped = content.replace("\\", "\\\\").replace("'", "\\'")
            content = f"'{escaped}'"
        elif kind == "code":
            content = re.sub(r"&+", " AND ", content)
            content = re.sub(r"\|+", " OR ", content).replace("==", "=")
        out.append(content)
    return "".join(out)


def columns_read(branches: Sequence[Mapping] | str, names: Sequence[str]) -> list[str]:
    """Which of the columns `names` a formula reads (as `violated` evaluates it)."""
    if isinstance(branches, str):
        words = set()
        for kind, content in _parts(branches):
            found = {"name": [content.strip("`")], "code": re.findall(r"\w+", content)}
            words.update(w.lower() for w in found.get(kind, ()))
        return [n for n in names if n.lower() in words]
    if not any(str(b.get("logic", "")).lower() == "if" for b in branches):
        return columns_read(branches[-1]["formulaText"], names)
    read = set()
    for branch in branches:
        read.add(branch["operand"])
        for spec in branch["formula"]:
            for condition in (spec, *(spec.get("group") or [])):
                read.update(filter(None, (condition["operand1"], condition.get("operand2"))))
    return [n for n in names if n in read]


def _operand(name: str, null_as: object) -> Column:
    c = quoted(name)
    return c if null_as is None else F.coalesce(c, F.lit(null_as))


def _compare(left: Column, operator: str, right: object, is_column: bool, null_as: object) -> Column:
    sign = _OPERATORS.get(str(operator).strip())
    if sign is None:
        raise ValueError(f"unknown operator {operator}")
    if is_column:
        other = _operand(str(right), null_as)
    else:
        number = as_number(right)
        other = F.lit(str(right)) if number is None else F.lit(number)
        left = left.cast("string") if number is None else left.try_cast("double")
    return {
        "=": left == other, "<>": left != other, ">": left > other,
        ">=": left >= other, "<": left < other, "<=": left <= other,
    }[sign]


def _condition(spec: Mapping, null_as: object) -> Column:
    other = spec.get("operand2")
    is_column = bool(other)
    return _compare(
        _operand(spec["operand1"], null_as),
        spec["operator1"],
        other if is_column else spec.get("value"),
        is_column,
        null_as,
    )


def _is_or(word: object) -> bool:
    return str(word or "AND").strip().upper() in ("OR", "|", "||")


def _fold(terms: Sequence[tuple[object, Column]]) -> Column:
    """(word before the term, term) pairs; AND binds before OR, as in the written text."""
    alternatives: list[Column] = []
    for word, term in terms:
        if alternatives and not _is_or(word):
            alternatives[-1] = alternatives[-1] & term
        else:
            alternatives.append(term)
    return functools.reduce(lambda a, b: a | b, alternatives)


def _chain(conditions: Sequence[Mapping], null_as: object) -> Column:
    """A condition names the word after it, a nested one the word before it."""
    terms: list[tuple[object, Column]] = []
    word: object = None
    for spec in conditions:
        terms.append((word, _condition(spec, null_as)))
        word = spec.get("condition") or spec.get("operator2")
        nested = spec.get("group") or []
        if nested:
            inner = [(n.get("condition") or n.get("operator2"), _condition(n, null_as)) for n in nested]
            terms.append((inner[0][0] or word, _fold(inner)))
    return _fold(terms)


def _certain(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def holds(branches: Sequence[Mapping], null_as: object = None) -> tuple[Column, Column]:
    """(some IF holds, some branch holds with its THEN)."""
    triggered, satisfied = F.lit(False), F.lit(False)
    for branch in branches:
        cond = _certain(_chain(branch["formula"], null_as))
        then = _certain(
            _compare(_operand(branch["operand"], null_as), branch["operator"], branch["value"], False, null_as)
        )
        triggered, satisfied = triggered | cond, satisfied | (cond & then)
    return triggered, satisfied


def violated(branches: Sequence[Mapping] | str, null_as: object = None) -> Column:
    """Rows that break the formula.

    With an IF: the condition holds and no branch's consequence does. Without one: the last
    branch's `formulaText` (or the text itself) is a predicate that has to hold.
    """
    if isinstance(branches, str):
        return ~_certain(F.expr(to_sql(branches)))
    if any(str(b.get("logic", "")).lower() == "if" for b in branches):
        triggered, satisfied = holds(branches, null_as)
        return triggered & ~satisfied
    return ~_certain(F.expr(to_sql(branches[-1]["formulaText"])))
