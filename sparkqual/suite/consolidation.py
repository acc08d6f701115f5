"""Master-data queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mdm
from . import Suite, table
from .rounding import rounded

suite = Suite()

_VENDORS = {
    "a": """(SELECT CASE WHEN c_nationkey <> 7 THEN c_custkey END AS c_custkey, c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_acctbal END AS c_acctbal,
        c_mktsegment FROM customer WHERE c_nationkey <> 5)""",
    "b": """(SELECT c_custkey, upper(c_name) AS c_name, c_acctbal + 1 AS c_acctbal,
        CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment
        FROM (SELECT * FROM customer UNION ALL SELECT * FROM customer WHERE c_nationkey = 3) WHERE c_nationkey <> 9)""",
    "c": "(SELECT c_custkey, 'third' AS c_name, CAST(NULL AS DOUBLE) AS c_acctbal, 'NONE' AS c_mktsegment FROM customer)",
}


def _vendor(spark, sf_dir, which):
    """`a` has records without key, `b` repeats some of its records."""
    customers = table(spark, sf_dir, "customer")
    if which == "a":
        return customers.filter("c_nationkey <> 5").selectExpr(
            "CASE WHEN c_nationkey <> 7 THEN c_custkey END AS c_custkey", "c_name", "CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_acctbal END AS c_acctbal", "c_mktsegment"
        )
    if which == "b":
        twice = customers.unionByName(customers.filter("c_nationkey = 3"))
        return twice.filter("c_nationkey <> 9").selectExpr(
            "c_custkey", "upper(c_name) AS c_name", "c_acctbal + 1 AS c_acctbal",
            "CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment",
        )
    return customers.selectExpr("c_custkey", "'third' AS c_name", "CAST(NULL AS DOUBLE) AS c_acctbal", "'NONE' AS c_mktsegment")


_MERGE = [
    {"column": "c_name", "rules": [{"rule": "ANY", "value": "NONEMPTY"}, {"rule": "DIFF", "value": "S2"}]},
    {"column": "c_acctbal", "rules": [{"rule": "ANY", "value": "NONEMPTY"}]},
    {"column": "c_mktsegment", "rules": [{"rule": "ANY", "value": "S2"}, {"rule": "DIFF", "value": "S1"}]},
]
_GOLDEN = f"""(SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey,
    CASE WHEN a.c_name <> b.c_name THEN b.c_name ELSE coalesce(a.c_name, b.c_name) END AS c_name,
    round(coalesce(a.c_acctbal, b.c_acctbal), 2) AS c_acctbal,
    CASE WHEN a.c_mktsegment <> b.c_mktsegment THEN a.c_mktsegment ELSE b.c_mktsegment END AS c_mktsegment
    FROM {_VENDORS['a']} a FULL JOIN (SELECT DISTINCT * FROM {_VENDORS['b']}) b ON a.c_custkey = b.c_custkey)"""


def _golden(spark, sf_dir):
    a, b = _vendor(spark, sf_dir, "a"), _vendor(spark, sf_dir, "b")
    return rounded(mdm.golden_copy(a, b, "c_custkey", _MERGE), 2)


@suite.add("golden_two", f"SELECT * FROM {_GOLDEN}")
def golden_two(spark, sf_dir):
    return _golden(spark, sf_dir)


_EACH = " UNION ALL ".join(f"SELECT {i} AS rank, * FROM {s}" for i, s in enumerate(_VENDORS.values()))


@suite.add(
    "golden_n",
    f"""SELECT c_custkey, arg_min(c_name, rank) FILTER (WHERE c_name IS NOT NULL) AS c_name,
    round(arg_min(c_acctbal, rank) FILTER (WHERE c_acctbal IS NOT NULL), 2) AS c_acctbal,
    arg_min(c_mktsegment, rank) FILTER (WHERE c_mktsegment IS NOT NULL) AS c_mktsegment FROM ({_EACH})
    WHERE c_custkey IS NOT NULL GROUP BY c_custkey
    UNION ALL SELECT c_custkey, c_name, round(c_acctbal, 2), c_mktsegment FROM ({_EACH}) WHERE c_custkey IS NULL""",
)
def golden_n(spark, sf_dir):
    sources = [_vendor(spark, sf_dir, v) for v in ("a", "b", "c")]
    return rounded(mdm.golden_copy_of(sources, "c_custkey"), 2)


_DIFF_COLUMNS = ("c_name", "c_mktsegment")


@suite.add(
    "layer_diff",
    " UNION ALL ".join(
        f"""SELECT coalesce(a.c_custkey, g.c_custkey) AS c_custkey, '{c}' AS "column", a.{c} AS "before", g.{c} AS "after"
        FROM {_VENDORS['a']} a FULL JOIN {_GOLDEN} g ON a.c_custkey = g.c_custkey WHERE a.{c} IS DISTINCT FROM g.{c}"""
        for c in _DIFF_COLUMNS
    ),
)
def layer_diff(spark, sf_dir):
    layers = mdm.layer_view(_vendor(spark, sf_dir, "a"), _vendor(spark, sf_dir, "b"), _golden(spark, sf_dir))
    narrow = {k: layers[k].select("c_custkey", *_DIFF_COLUMNS) for k in ("basic", "golden")}
    return mdm.layer_diff(narrow["basic"], narrow["golden"], "c_custkey")


_MAPPING = {"BB_c_custkey": "PRIMARY ID", "BB_c_name": "NAME", "BB_c_acctbal": "LAST PRICE", "BB_c_mktsegment": "INDUSTRY SECTOR"}


@suite.add(
    "standard_layer",
    """SELECT c_custkey AS "PRIMARY ID", c_name AS "NAME", c_acctbal AS "LAST PRICE", c_mktsegment AS "INDUSTRY SECTOR",
    c_nationkey AS "BB_c_nationkey" FROM customer""",
)
def standard_layer(spark, sf_dir):
    vendor = mdm.add_prefix(table(spark, sf_dir, "customer"), "BB_")
    return rounded(mdm.to_standard_layer(vendor, _MAPPING), 2)


@suite.add("vendor_prefix", "SELECT s_suppkey AS suppkey, s_name AS name, s_nationkey AS nationkey, s_acctbal AS acctbal FROM supplier")
def vendor_prefix(spark, sf_dir):
    renamed = mdm.strip_prefix(table(spark, sf_dir, "supplier"), 2)
    return rounded(mdm.strip_prefix(mdm.add_prefix(renamed, "RE_"), 3), 2)


_SUPPLIERS = """(SELECT s_suppkey, CASE WHEN s_nationkey < 12 THEN '  ' || lower(s_name) ELSE upper(s_name) || ' ' || chr(9) END AS s_name,
    NULLIF(s_nationkey, 3) AS s_nationkey, s_acctbal FROM supplier)"""


def _suppliers(spark, sf_dir):
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey",
        "CASE WHEN s_nationkey < 12 THEN '  ' || lower(s_name) ELSE upper(s_name) || ' ' || chr(9) END AS s_name",
        "nullif(s_nationkey, 3) AS s_nationkey",
        "s_acctbal",
    )


def _format(column, operator, value=None):
    return {"column": column, "rules": [{"rule": "Format", "operator": operator, "value": value}]}


@suite.add(
    "standardise",
    f"""SELECT s_suppkey, upper(regexp_replace(s_name, '^\\s+|\\s+$', '', 'g')) AS s_name,
    CAST(s_nationkey AS VARCHAR) || '-N' AS s_nationkey, s_acctbal FROM {_SUPPLIERS}""",
)
def standardise(spark, sf_dir):
    rules = [_format("s_name", "trim"), _format("s_name", "toUpperCase"), _format("s_nationkey", "toString"),
             _format("s_nationkey", "concat", "-N")]
    return mdm.standardise(_suppliers(spark, sf_dir), rules)


@suite.add(
    "standardise_parts",
    f"""SELECT s_suppkey, lower(substring(replace(trim(s_name, ' ' || chr(9)), '#', '_'), 2, 9)) AS s_name FROM {_SUPPLIERS}""",
)
def standardise_parts(spark, sf_dir):
    rules = [_format("s_name", "trim"), _format("s_name", "replace", "#=>_"), _format("s_name", "substring", "2,9"),
             _format("s_name", "toLowerCase")]
    return mdm.standardise(_suppliers(spark, sf_dir), rules, ["s_suppkey", "s_name"])


@suite.add(
    "computed_column",
    "SELECT l_orderkey, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem",
)
def computed_column(spark, sf_dir):
    rule = {"rule": "Transformation", "operator": "", "value": [{"formulaText": "net = l_extendedprice * (1 - l_discount)"}]}
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    found = mdm.standardise(lines, [{"column": "net", "rules": [rule]}])
    return rounded(found.select("l_orderkey", "net"), 4)


def _keys_sql(t, names, limit=10):
    import itertools

    combos = [c for size in range(1, len(names) + 1) for c in itertools.combinations(names, size)]
    tested = " UNION ALL ".join(
        f"SELECT {i} AS pos, {list(c)} AS columns, (SELECT count(DISTINCT ({', '.join(c)}, 0)) = count(*) FROM {t}) AS is_key"
        for i, c in enumerate(combos)
    )
    return f"""SELECT row_number() OVER (ORDER BY pos) AS position, columns FROM ({tested}) WHERE is_key
    QUALIFY row_number() OVER (ORDER BY pos) <= {limit}"""


@suite.add("candidate_keys", _keys_sql("customer", ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")))
def candidate_keys(spark, sf_dir):
    return rounded(mdm.candidate_key_table(table(spark, sf_dir, "customer")))


@suite.add("candidate_keys_parts", _keys_sql("part", ("p_name", "p_brand", "p_type", "p_size", "p_retailprice")))
def candidate_keys_parts(spark, sf_dir):
    names = ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
    return rounded(mdm.candidate_key_table(table(spark, sf_dir, "part"), columns=names))
