"""Quality rule, scorecard and classification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as rl
from ..operators import classify, quality, suggest
from . import Suite, table
from .rounding import rounded

suite = Suite()

_ORDERS = """(SELECT o_orderkey, o_custkey, o_orderstatus, NULLIF(o_orderpriority, '5-LOW') AS o_orderpriority,
    CASE WHEN o_orderpriority = '2-HIGH' THEN NULL ELSE o_totalprice END AS o_totalprice, o_orderdate FROM orders)"""


def dirty_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        F.expr("nullif(o_orderpriority, '5-LOW')").alias("o_orderpriority"),
        F.expr("CASE WHEN o_orderpriority = '2-HIGH' THEN NULL ELSE o_totalprice END").alias("o_totalprice"),
        "o_orderdate",
    )


_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate")


@suite.add(
    "completeness",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(100.0 * count({c}) / count(*), 6) AS completeness,
        count(*) - count({c}) AS nulls FROM {_ORDERS}"""
        for c in _COLUMNS
    ),
)
def completeness(spark, sf_dir):
    return rounded(quality.completeness(dirty_orders(spark, sf_dir)))


@suite.add(
    "uniqueness",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(100.0 * count(*) / sum(n), 6) AS uniqueness,
        CAST(sum(n - 1) AS BIGINT) AS repeats FROM (SELECT {c}, count(*) AS n FROM {_ORDERS} GROUP BY 1)"""
        for c in _COLUMNS
    ),
)
def uniqueness(spark, sf_dir):
    return rounded(quality.uniqueness(dirty_orders(spark, sf_dir)))


@suite.add(
    "null_rows",
    f"""SELECT o_orderkey, c || ':NotNull' AS rule_id, c AS "column", CAST(NULL AS VARCHAR) AS observed FROM (
      SELECT o_orderkey, 'o_orderpriority' AS c FROM {_ORDERS} WHERE o_orderpriority IS NULL
      UNION ALL SELECT o_orderkey, 'o_totalprice' FROM {_ORDERS} WHERE o_totalprice IS NULL)""",
)
def null_rows(spark, sf_dir):
    return quality.null_rows(dirty_orders(spark, sf_dir), ["o_orderpriority", "o_totalprice"], ["o_orderkey"])


def _rule(rule, value, operator="Shouldbe", dimension=None):
    return {"rule": rule, "value": value, "operator": operator, "dimension": dimension, "format": ""}


# rule id -> (rows the rule applies to, rows that pass), in SQL
_SQL_CHECKS = {
    "o_orderpriority:DataType:0": ("o_orderpriority IS NOT NULL", r"regexp_full_match(o_orderpriority, '[\p{L}\p{N}]+')"),
    "o_orderpriority:MinLength:1": ("o_orderpriority IS NOT NULL", "length(o_orderpriority) >= 6"),
    "o_orderpriority:MaxLength:2": ("o_orderpriority IS NOT NULL", "length(o_orderpriority) <= 8"),
    "o_orderstatus:DataType:0": ("o_orderstatus IS NOT NULL", r"regexp_full_match(o_orderstatus, '[\p{L}\p{N}]+')"),
    "o_orderstatus:Length:1": ("o_orderstatus IS NOT NULL", "length(o_orderstatus) = 1"),
    "o_orderstatus:Value:2": ("true", "o_orderstatus = 'O'"),
    "o_totalprice:DataType:0": ("o_totalprice IS NOT NULL", "true"),
    "o_totalprice:Value:1": ("true", "o_totalprice >= 50000"),
    "o_totalprice:Value:2": ("true", "o_totalprice < 300000.5"),
    "o_custkey:Length:0": ("o_custkey IS NOT NULL", "length(CAST(o_custkey AS VARCHAR)) = 3"),
}
_RULES = [
    {"column": "o_orderpriority", "data_type": "Text",
     "rules": [_rule("DataType", "Text"), _rule("MinLength", "6"), _rule("MaxLength", "8")]},
    {"column": "o_orderstatus", "data_type": "Text",
     "rules": [_rule("DataType", "Alphanumeric"), _rule("Length", "1", "equalto"), _rule("Value", "O", "equalto")]},
    {"column": "o_totalprice", "data_type": "Numeric",
     "rules": [_rule("DataType", "Numeric"), _rule("Value", "50000", "greaterthanequalto"),
               _rule("Value", "300000.5", "lessthan")]},
    {"column": "o_custkey", "data_type": "Numeric", "rules": [_rule("Length", "3", "equalto")]},
]
_DIMENSION = {"DataType": "Validity", "Length": "Validity", "MinLength": "Validity",
              "MaxLength": "Validity", "Value": "Accuracy", "Formula": "Accuracy"}


def _score_sql(checks, source):
    return " UNION ALL ".join(
        f"""SELECT '{i}' AS rule_id, '{i.split(':')[0]}' AS "column", '{i.split(':')[1]}' AS rule,
        '{_DIMENSION[i.split(':')[1]]}' AS dimension, count(*) FILTER (WHERE {a}) AS checked,
        count(*) FILTER (WHERE {a} AND NOT coalesce({p}, false)) AS failed,
        round(100.0 * count(*) FILTER (WHERE {a} AND coalesce({p}, false)) / count(*) FILTER (WHERE {a}), 6) AS pass_pct
        FROM {source}"""
        for i, (a, p) in checks.items()
    )


@suite.add("rule_scores", _score_sql(_SQL_CHECKS, _ORDERS))
def rule_scores(spark, sf_dir):
    return rounded(quality.rule_scores(dirty_orders(spark, sf_dir), _RULES))


@suite.add(
    "rule_violations",
    " UNION ALL ".join(
        f"""SELECT o_orderkey, '{i}' AS rule_id, '{i.split(':')[0]}' AS "column",
        CAST({'CAST(o_totalprice AS DECIMAL(18, 2))' if i.startswith('o_totalprice') else i.split(':')[0]} AS VARCHAR) AS observed
        FROM {_ORDERS} WHERE {a} AND NOT coalesce({p}, false)"""
        for i, (a, p) in _SQL_CHECKS.items()
    ),
)
def rule_violations(spark, sf_dir):
    found = quality.violations(dirty_orders(spark, sf_dir), _RULES, ["o_orderkey"])
    # Both engines write fractions in their own way, so prices are compared with two digits.
    price = F.col("observed").try_cast("double").cast("decimal(18, 2)").cast("string")
    return found.withColumn("observed", F.when(F.col("column") == "o_totalprice", price).otherwise(F.col("observed")))


_LAUNCH = " UNION ALL ".join(
    [
        f"""SELECT 'null' AS kind, o_orderkey, o_orderstatus AS key_value, '{c}:NotNull' AS rule_id, '{c}' AS "column",
        CAST(NULL AS VARCHAR) AS observed FROM {_ORDERS} WHERE {c} IS NULL"""
        for c in ("o_orderpriority", "o_totalprice")
    ]
    + [
        f"""SELECT 'rule', o_orderkey, o_orderstatus, '{i}', '{i.split(':')[0]}', CAST({i.split(':')[0]} AS VARCHAR)
        FROM {_ORDERS} WHERE {a} AND NOT coalesce({p}, false)"""
        for i, (a, p) in _SQL_CHECKS.items()
        if not i.startswith("o_totalprice")
    ]
    + [
        f"""SELECT 'duplicate', o_orderkey, o_orderstatus, 'o_custkey,o_orderdate:Unique', 'o_custkey,o_orderdate', NULL
        FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey, o_orderdate) AS n FROM {_ORDERS}) WHERE n > 1""",
        f"""SELECT 'reference', o_orderkey, o_orderstatus, 'o_custkey:Reference', 'o_custkey', CAST(o_custkey AS VARCHAR) FROM {_ORDERS}
        WHERE o_custkey IS NULL OR o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
    ]
)


@suite.add("launch_violations", f"SELECT *, 'o_orderstatus' AS key_column FROM ({_LAUNCH})")
def launch_violations(spark, sf_dir):
    solvent = table(spark, sf_dir, "customer").filter("c_acctbal > 0")
    return quality.launch_violations(
        dirty_orders(spark, sf_dir), "o_orderstatus", [r for r in _RULES if r["column"] != "o_totalprice"], ["o_orderkey"],
        null_columns=["o_orderpriority", "o_totalprice"], unique_columns=["o_custkey", "o_orderdate"],
        references={"o_custkey": (solvent, "c_custkey")},
    )


def _cond(operand, operator, value, condition="", group=()):
    return {"operand1": operand, "operator1": operator, "operand2": "", "value": value,
            "condition": condition, "operator2": "", "group": list(group)}


_IF_THEN = [
    {"logic": "If", "operand": "o_totalprice", "operator": ">", "value": "100000",
     "formula": [_cond("o_orderstatus", "==", "F", "AND"),
                 _cond("o_custkey", ">", "100", "",
                       [_cond("o_orderpriority", "==", "1-URGENT", "AND"), _cond("o_orderpriority", "==", "2-HIGH", "OR")])]},
    {"logic": "Else if", "operand": "o_totalprice", "operator": "<=", "value": "250000.75",
     "formula": [_cond("o_orderstatus", "==", "O")]},
]
_IF_SQL = """coalesce((o_orderstatus = 'F' AND o_custkey > 100 AND (o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH')), false)"""
_IF_BROKEN = f"""(({_IF_SQL} OR coalesce(o_orderstatus = 'O', false))
    AND NOT (({_IF_SQL} AND coalesce(o_totalprice > 100000, false))
             OR (coalesce(o_orderstatus = 'O', false) AND coalesce(o_totalprice <= 250000.75, false))))"""


def _formula_rules(formula):
    return [{"column": "o_totalprice", "rules": [_rule("Formula", formula)]}]


@suite.add("formula_if", _score_sql({"o_totalprice:Formula:0": ("true", f"NOT {_IF_BROKEN}")}, _ORDERS))
def formula_if(spark, sf_dir):
    return rounded(quality.rule_scores(dirty_orders(spark, sf_dir), _formula_rules(_IF_THEN)))


@suite.add("formula_if_rows", f"SELECT o_orderkey, o_orderstatus FROM {_ORDERS} WHERE {_IF_BROKEN}")
def formula_if_rows(spark, sf_dir):
    found = quality.violations(dirty_orders(spark, sf_dir), _formula_rules(_IF_THEN), ["o_orderkey", "o_orderstatus"])
    return found.select("o_orderkey", "o_orderstatus")


_PLAIN = [{"logic": "", "formula": [], "formulaText": '(o_totalprice > 30000 & o_orderstatus == "F") | o_custkey < 700'}]
_PLAIN_SQL = "coalesce((o_totalprice > 30000 AND o_orderstatus = 'F') OR o_custkey < 700, false)"


@suite.add("formula_plain", _score_sql({"o_totalprice:Formula:0": ("true", _PLAIN_SQL)}, _ORDERS))
def formula_plain(spark, sf_dir):
    return rounded(quality.rule_scores(dirty_orders(spark, sf_dir), _formula_rules(_PLAIN)))


@suite.add(
    "condition_filters",
    f"""SELECT o_orderkey FROM {_ORDERS} WHERE o_totalprice BETWEEN 50000 AND 200000 AND o_custkey >= 300
    AND o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT'""",
)
def condition_filters(spark, sf_dir):
    df = dirty_orders(spark, sf_dir)
    numbers = rl.numeric_relation(F.col("o_totalprice"), [{"operator": "between", "value": (50000, 200000)}])
    keys = rl.numeric_relation(F.col("o_custkey"), [{"operator": ">=", "value": 300}])
    words = rl.conjunction({"a": 'o_orderstatus == "F"', "b": "o_orderpriority != '1-URGENT'"})
    return df.filter(numbers & keys & words).select("o_orderkey")


_CUSTOMERS = "(SELECT c_custkey FROM customer WHERE c_acctbal >= 0)"


def _solvent(spark, sf_dir):
    return table(spark, sf_dir, "customer").filter("c_acctbal >= 0").select("c_custkey")


@suite.add(
    "reference_scores",
    f"""SELECT 'o_custkey' AS "column", count(*) AS checked,
    count(*) FILTER (WHERE o_custkey IN (SELECT c_custkey FROM {_CUSTOMERS})) AS members,
    round(100.0 * count(*) FILTER (WHERE o_custkey IN (SELECT c_custkey FROM {_CUSTOMERS})) / count(*), 6) AS integrity
    FROM orders""",
)
def reference_scores(spark, sf_dir):
    return rounded(
        quality.reference_scores(table(spark, sf_dir, "orders"), "o_custkey", _solvent(spark, sf_dir), "c_custkey")
    )


@suite.add(
    "reference_violations",
    f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM {_CUSTOMERS})",
)
def reference_violations(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return quality.reference_violations(orders, "o_custkey", _solvent(spark, sf_dir), "c_custkey")


@suite.add(
    "key_outliers",
    r"""SELECT p_type AS key_value, count(*) AS rows, NOT regexp_full_match(p_type, '\p{L}+') AS is_outlier
    FROM (SELECT p_type || CASE WHEN p_size > 40 THEN ' big' ELSE '' END AS p_type FROM part) GROUP BY 1""",
)
def key_outliers(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(
        F.expr("p_type || CASE WHEN p_size > 40 THEN ' big' ELSE '' END").alias("p_type")
    )
    return quality.key_outliers(parts, "p_type", "Text")


_CARD_COLUMNS = ("o_orderstatus", "o_orderpriority", "o_price", "o_custkey")
_CARD_SOURCE = f"""(SELECT o_orderstatus, o_orderpriority, floor(o_totalprice / 100000) AS o_price, o_custkey FROM {_ORDERS})"""
_CARD_KEYS = ("o_orderstatus", "o_orderpriority")
_CARD_RULES = [
    {"column": "o_orderstatus", "data_type": "Text", "rules": [_rule("DataType", "Text"), _rule("Length", "1", "equalto")]},
    {"column": "o_orderpriority", "data_type": "Text", "rules": [_rule("DataType", "Text"), _rule("MaxLength", "8")]},
    {"column": "o_price", "rules": [_rule("Value", "1", "greaterthanequalto"),
                                    _rule("Formula", 'o_price < 4 | o_orderstatus == "O"')]},
    {"column": "o_custkey", "rules": [_rule("ReferenceCDE", "ref-C1-c_custkey"), _rule("Length", "3", "equalto")]},
]


def _card_sql(key, misfit):
    def pct(test, base="true"):
        return (f"(100.0 * count(*) FILTER (WHERE ({base}) AND coalesce({test}, false))"
                f" / nullif(count(*) FILTER (WHERE {base}), 0))")

    alnum = r"regexp_full_match({c}, '[\p{{L}}\p{{N}}]+')"
    validity = [
        pct(alnum.format(c="o_orderstatus"), "o_orderstatus IS NOT NULL"),
        pct("length(o_orderstatus) = 1", "o_orderstatus IS NOT NULL"),
        pct(alnum.format(c="o_orderpriority"), "o_orderpriority IS NOT NULL"),
        pct("length(o_orderpriority) <= 8", "o_orderpriority IS NOT NULL"),
        pct("length(CAST(o_custkey AS VARCHAR)) = 3", "o_custkey IS NOT NULL"),
    ]
    nulls = " + ".join(f"CAST({c} IS NULL AS INT)" for c in _CARD_COLUMNS)
    member = f"o_custkey IN (SELECT c_custkey FROM {_CUSTOMERS})"
    mean = f"list_avg(list_filter([{', '.join(validity)}], lambda x: x IS NOT NULL))"
    return f"""SELECT key_column, key_value, rows, "Completeness", "Uniqueness", "Validity", "Integrity", "Accuracy",
      round_even(("Completeness" + "Uniqueness" + "Validity" + "Integrity" + "Accuracy") / 5, 2) AS overall, is_outlier
    FROM (SELECT '{key}' AS key_column, {key} AS key_value, count(*) AS rows,
      100 - round_even(100.0 * sum({nulls}) / (count(*) * 4), 2) AS "Completeness",
      round_even(100 - 100.0 * (count(*) - count(DISTINCT ({', '.join(_CARD_COLUMNS)}))) / count(*), 2) AS "Uniqueness",
      round_even({mean}, 2) AS "Validity", round_even({pct(member)}, 2) AS "Integrity",
      round_even(({pct("o_price >= 1")} + {pct("o_price < 4 OR o_orderstatus = 'O'")}) / 2, 2) AS "Accuracy",
      coalesce({misfit}, true) AS is_outlier FROM {_CARD_SOURCE} GROUP BY {key})"""


_CARD_SQL = " UNION ALL ".join(_card_sql(k, rf"NOT regexp_full_match({k}, '\p{{L}}+')") for k in _CARD_KEYS)


def _card(spark, sf_dir):
    orders = dirty_orders(spark, sf_dir).select(
        "o_orderstatus", "o_orderpriority", F.expr("floor(o_totalprice / 100000)").alias("o_price"), "o_custkey"
    )
    return quality.group_scorecard(orders, _CARD_KEYS, _CARD_RULES, {"C1": _solvent(spark, sf_dir)}, _CARD_COLUMNS)


@suite.add("group_scorecard", _CARD_SQL)
def group_scorecard(spark, sf_dir):
    return rounded(_card(spark, sf_dir))


_LAUNCH_SQL = f"""WITH long AS (UNPIVOT ({_CARD_SQL}) ON "Completeness", "Uniqueness", "Validity", "Integrity", "Accuracy"
      INTO NAME dimension VALUE score),
    per AS (SELECT key_column, dimension, round_even(avg(score), 2) AS score FROM long GROUP BY 1, 2)
    SELECT * FROM per UNION ALL SELECT NULL, dimension, round_even(avg(score), 2) FROM per GROUP BY 2"""


@suite.add("launch_scores", _LAUNCH_SQL)
def launch_scores(spark, sf_dir):
    return rounded(quality.launch_scores(_card(spark, sf_dir)))


_TOLERANCES = [("Managers", "Completeness", 80.0), ("Managers", "Integrity", 95.0),
               ("Analysts", "Validity", 50.0), ("Analysts", "Uniqueness", 0.0)]


@suite.add(
    "tolerance_alerts",
    f"""SELECT key_column, category, bool_and(score >= minimum) AS passed,
    coalesce(list_sort(list(dimension) FILTER (WHERE score < minimum)), []) AS missed
    FROM ({_LAUNCH_SQL}) JOIN (VALUES {', '.join(str(t) for t in _TOLERANCES)}) t(category, dim, minimum) ON dim = dimension
    GROUP BY key_column, category""",
)
def tolerance_alerts(spark, sf_dir):
    limits = spark.createDataFrame(_TOLERANCES, "category string, dimension string, minimum double")
    return quality.tolerance_alerts(quality.launch_scores(_card(spark, sf_dir)), limits, ["key_column"])


@suite.add(
    "column_scorecard",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round_even(100.0 * count({c}) / count(*), 2) AS "Completeness",
        round_even(v, 2) AS "Validity", CAST(NULL AS DOUBLE) AS "Consistency", CAST(NULL AS DOUBLE) AS "Timeliness",
        CAST(NULL AS DOUBLE) AS "Accuracy",
        round_even((round_even(100.0 * count({c}) / count(*), 2) + round_even(v, 2)) / 2, 2) AS overall
        FROM {_ORDERS}, (SELECT ({share} + 100.0 * ({kinds} - 1)) / {kinds} AS v FROM {_ORDERS}) GROUP BY v"""
        for c, kinds, share in (
            ("o_orderkey", 3, "100.0"),
            ("o_orderstatus", 2, "100.0"),
            ("o_orderpriority", 3,
             r"100.0 * count(*) FILTER (WHERE regexp_full_match(o_orderpriority, '[\p{L}\p{N}]+')) / count(o_orderpriority)"),
            ("o_orderdate", 2, "100.0"),
        )
    ),
)
def column_scorecard(spark, sf_dir):
    names = ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate"]
    return rounded(quality.column_scorecard(dirty_orders(spark, sf_dir), names))


def _suggest_sql(c, table_name, kind, length):
    return f"""SELECT '{c}' AS "column", unnest(CASE WHEN lo = hi
      THEN [{{'rule': 'DataType', 'value': '{kind}', 'operator': 'Shouldbe'}}, {{'rule': 'Length', 'value': hi, 'operator': 'equalto'}}]
      ELSE [{{'rule': 'DataType', 'value': '{kind}', 'operator': 'Shouldbe'}}, {{'rule': 'MaxLength', 'value': hi, 'operator': 'equalto'}},
            {{'rule': 'MinLength', 'value': lo, 'operator': 'equalto'}}] END, recursive := true), 'Validity' AS dimension
    FROM (SELECT CAST(min({length}) AS VARCHAR) AS lo, CAST(max({length}) AS VARCHAR) AS hi FROM {table_name})"""


_CHARS, _DIGITS = "length({c})", "length(regexp_replace(CAST({c} AS VARCHAR), '[^0-9]', '', 'g'))"
_SUGGESTED = (("c_custkey", "Numeric", _DIGITS), ("c_name", "Text", _CHARS), ("c_nationkey", "Numeric", _DIGITS),
              ("c_mktsegment", "Text", _CHARS))


@suite.add(
    "suggest_rules",
    " UNION ALL ".join(_suggest_sql(c, "customer", k, e.format(c=c)) for c, k, e in _SUGGESTED),
)
def suggest_rules(spark, sf_dir):
    return suggest.default_rules(table(spark, sf_dir, "customer"), [c for c, _, _ in _SUGGESTED])


@suite.add(
    "suggest_standard_rules",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", 'Format' AS rule, '{f}' AS "value", count({c}) AS non_null FROM {_ORDERS}"""
        for c, f in (("o_orderkey", "###.##"), ("o_custkey", "###.##"), ("o_orderstatus", "WWWDDD"),
                     ("o_orderpriority", "WWWDDD"), ("o_totalprice", "###.##"), ("o_orderdate", "%d-%m-%Y"))
    ),
)
def suggest_standard_rules(spark, sf_dir):
    return suggest.standard_rules(dirty_orders(spark, sf_dir))


@suite.add(
    "suggest_merge_rules",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{r}' AS rule, '{v}' AS "value", count({c}) AS non_null FROM {_ORDERS}"""
        for c in _COLUMNS if c != "o_orderkey" for r, v in (("ANY", "NONEMPTY"), ("DIFF", "S1"))
    ),
)
def suggest_merge_rules(spark, sf_dir):
    return suggest.merge_rules(dirty_orders(spark, sf_dir), "o_orderkey")


@suite.add(
    "ruleset_status",
    """SELECT o_orderkey, CASE WHEN DATE '1998-06-01' BETWEEN CAST(o_orderdate AS DATE) AND CAST(o_orderdate AS DATE) + 365 THEN 'Active'
    WHEN CAST(o_orderdate AS DATE) >= DATE '1998-06-01' THEN 'Inactive' ELSE 'Expired' END AS status FROM orders""",
)
def ruleset_status(spark, sf_dir):
    status = quality.ruleset_status(
        F.col("o_orderdate"), F.date_add(F.to_date("o_orderdate"), 365), F.lit("1998-06-01").cast("date")
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"))


def _class_sql(c, t, kind):
    """The decision table on measured facts."""
    mid = f"avg(length(coalesce({c}, '  ')))" if kind == "text" else "0"
    span = f"(min({c}) BETWEEN 1900 AND 2050 AND max({c}) BETWEEN 1900 AND 2050)" if kind == "whole" else "false"
    return f"""SELECT '{c}' AS "column", CASE
      WHEN d = 1 OR nulls >= 0.9 * n THEN 'delete'
      WHEN d = 2 THEN {"'string_bool'" if kind == "text" else "'num_bool'" if kind != "time" else "'date'"}
      WHEN '{kind}' = 'text' THEN CASE
        WHEN mid >= 30 AND f <= floor(0.9 * n) THEN 'nlp' WHEN f >= 15 AND f <= floor(0.9 * n) THEN 'discrete_string'
        WHEN f >= 15 AND f = n THEN 'id' WHEN f < 15 THEN CASE WHEN d = n THEN 'id' ELSE 'cat' END
        WHEN mid >= 30 THEN 'nlp' ELSE 'discrete_string' END
      WHEN '{kind}' = 'whole' THEN CASE WHEN span THEN 'date' WHEN d = n THEN 'id' ELSE 'int' END
      WHEN '{kind}' = 'fraction' THEN 'continuous' ELSE 'date' END AS class
    FROM (SELECT count(*) AS n, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS d,
      count(DISTINCT {c}) + CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END AS f, {mid} AS mid, {span} AS span FROM {t})"""


_CLASSES = {
    "documents": {"doc_id": "whole", "text": "text", "lang": "text", "source": "text", "n_chars": "whole"},
    "part": {"p_partkey": "whole", "p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "whole",
             "p_retailprice": "fraction"},
    "lineitem": {"l_linenumber": "whole", "l_quantity": "fraction", "l_linestatus": "text", "l_returnflag": "text",
                 "l_shipdate": "time"},
}


@suite.add(
    "classify_columns",
    " UNION ALL ".join(_class_sql(c, t, k) for t, cols in _CLASSES.items() for c, k in cols.items()),
)
def classify_columns(spark, sf_dir):
    frames = [classify.classify_columns(table(spark, sf_dir, t), list(cols)) for t, cols in _CLASSES.items()]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def _small_sql(c, t):
    return f"""SELECT '{c}' AS "column", CASE WHEN count(*) < 25 AND min(n) > 9 THEN 'cat' ELSE 'int' END AS class
    FROM (SELECT {c}, count(*) AS n FROM {t} GROUP BY 1)"""


@suite.add(
    "integer_categories",
    f"""{_small_sql('l_linenumber', 'lineitem')} UNION ALL {_small_sql('l_suppkey', 'lineitem')}
    UNION ALL {_small_sql('l_partkey', 'lineitem')}""",
)
def integer_categories(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_suppkey", "l_partkey")
    return classify.integer_categories(lines, classify.classify_columns(lines))


def _report_sql(c, t, kind, stats):
    listed = "', '".join(stats)
    grows = f"CASE WHEN class IN ('cat', 'string_bool', 'num_bool') THEN ['{listed}', 'Frequency'] ELSE ['{listed}'] END"
    whole = f"(SELECT '{c}' AS \"column\", class FROM ({_class_sql(c, t, kind)}))"
    if kind == "whole":
        whole = f"""(SELECT a."column", CASE WHEN a.class = 'int' THEN b.class ELSE a.class END AS class
          FROM ({_class_sql(c, t, kind)}) a, ({_small_sql(c, t)}) b)"""
    return f"""SELECT "column", unnest({grows}) AS statistic FROM {whole}"""


_REPORTED = (("l_linenumber", "whole", ("ValueStatistics", "LengthStatistics", "Outliers")),
             ("l_quantity", "fraction", ("ValueStatistics", "LengthStatistics", "Outliers")),
             ("l_returnflag", "text", ("LengthStatistics",)),
             ("l_shipdate", "time", ("ValueStatistics", "Outliers")))


@suite.add("suggest_report_rules", " UNION ALL ".join(_report_sql(c, "lineitem", k, s) for c, k, s in _REPORTED))
def suggest_report_rules(spark, sf_dir):
    return suggest.report_rules(table(spark, sf_dir, "lineitem"), [c for c, _, _ in _REPORTED])


_AUDIENCE = """(SELECT c_name AS "user", [c_mktsegment, CASE WHEN c_acctbal < 0 THEN 'Analysts' ELSE 'Managers' END] AS categories FROM customer)"""


@suite.add(
    "alert_recipients",
    f"""SELECT DISTINCT key_column, category, passed, "user" FROM (
      SELECT key_column, category, bool_and(score >= minimum) AS passed
      FROM ({_LAUNCH_SQL}) JOIN (VALUES {', '.join(str(t) for t in _TOLERANCES)}) t(category, dim, minimum) ON dim = dimension
      GROUP BY key_column, category) JOIN (SELECT "user", unnest(categories) AS category FROM {_AUDIENCE}) USING (category)""",
)
def alert_recipients(spark, sf_dir):
    limits = spark.createDataFrame(_TOLERANCES, "category string, dimension string, minimum double")
    alerts = quality.tolerance_alerts(quality.launch_scores(_card(spark, sf_dir)), limits, ["key_column"])
    users = table(spark, sf_dir, "customer").selectExpr(
        "c_name AS user", "array(c_mktsegment, CASE WHEN c_acctbal < 0 THEN 'Analysts' ELSE 'Managers' END) AS categories"
    )
    return quality.alert_recipients(alerts, users).select("key_column", "category", "passed", "user")
