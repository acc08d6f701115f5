"""Association queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import association
from . import Suite, table
from .rounding import rounded

suite = Suite()

_LINES = """(SELECT l_linenumber, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS l_quantity,
    l_extendedprice, l_discount, l_tax, 1 AS flat FROM lineitem)"""
_NUMBERS = ("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "flat")


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_linenumber",
        F.expr("CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END").alias("l_quantity"),
        "l_extendedprice",
        "l_discount",
        F.lit(1).alias("flat"),
    )


def _pairs(names):
    return [(i, j) for i in names for j in names]


def _pearson_sql(i, j, source):
    if i == j:
        value = f"CASE WHEN min({i}) < max({i}) THEN 1.0 ELSE 0.0 END"
    elif "flat" in (i, j):
        value = "0.0 * count(*)"
    else:
        value = f"corr({i}, {j})"
    return f"""SELECT '{i}' AS column_i, '{j}' AS column_j, CAST(round({value}, 6) AS DOUBLE) AS "value" FROM {source}"""


@suite.add("corr_pearson", " UNION ALL ".join(_pearson_sql(i, j, _LINES) for i, j in _pairs(_NUMBERS)))
def corr_pearson(spark, sf_dir):
    return rounded(association.correlation(_lines(spark, sf_dir), _NUMBERS))


_ORDERED = ("p_size", "p_retailprice", "p_partkey", "half")
_PARTS = "(SELECT p_size, p_retailprice, p_partkey, CASE WHEN p_size > 25 THEN p_size END AS half FROM part)"


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_size", "p_retailprice", "p_partkey", F.expr("CASE WHEN p_size > 25 THEN p_size END").alias("half")
    )


def _spearman_sql(i, j):
    def rank(c):
        return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"

    return f"""SELECT '{i}' AS column_i, '{j}' AS column_j, CAST(round(corr(a, b), 6) AS DOUBLE) AS "value" FROM (
    SELECT {rank('x')} AS a, {rank('y')} AS b FROM (
      SELECT {i} AS x, {j} AS y FROM {_PARTS} WHERE {i} IS NOT NULL AND {j} IS NOT NULL))"""


@suite.add("corr_spearman", " UNION ALL ".join(_spearman_sql(i, j) for i, j in _pairs(_ORDERED)))
def corr_spearman(spark, sf_dir):
    return rounded(association.correlation(_parts(spark, sf_dir), _ORDERED, "spearman"))


# Few distinct pairs, so that comparing all cells with all cells stays possible in SQL.
_SMALL = ("l_linenumber", "l_discount", "l_tax")


def _kendall_pair_sql(i, j):
    return f"""SELECT '{i}' AS column_i, '{j}' AS column_j, (
    WITH cells AS (SELECT {i} AS x, {j} AS y, count(*) AS n FROM {_LINES}
                   WHERE {i} IS NOT NULL AND {j} IS NOT NULL GROUP BY ALL),
    total AS (SELECT sum(n) * (sum(n) - 1) / 2.0 AS pairs FROM cells),
    tx AS (SELECT sum(m * (m - 1) / 2.0) AS t FROM (SELECT sum(n) AS m FROM cells GROUP BY x)),
    ty AS (SELECT sum(m * (m - 1) / 2.0) AS t FROM (SELECT sum(n) AS m FROM cells GROUP BY y)),
    diff AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y) * a.n * b.n) / 2.0 AS d FROM cells a, cells b)
    SELECT CAST(round(d / (sqrt(pairs - tx.t) * sqrt(pairs - ty.t)), 6) AS DOUBLE) FROM diff, total, tx, ty) AS "value" """


@suite.add("corr_kendall", " UNION ALL ".join(_kendall_pair_sql(i, j) for i, j in _pairs(_SMALL)))
def corr_kendall(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(*_SMALL)
    return rounded(association.correlation(lines, _SMALL, "kendall"))


@suite.add("corr_kendall_wide")
def corr_kendall_wide(spark, sf_dir):
    """Many distinct pairs: too slow for SQL, tested against brute force on a fixture."""
    return rounded(association.correlation(_parts(spark, sf_dir), _ORDERED, "kendall"))


_ORDERS = """(SELECT NULLIF(o_orderpriority, '5-LOW') AS o_orderpriority, o_orderstatus,
    CASE WHEN o_totalprice > 250000 THEN 'high' ELSE 'low' END AS price,
    CASE WHEN o_totalprice > 100000 THEN o_orderstatus ELSE 'cheap' END AS mixed, o_totalprice, o_custkey FROM orders)"""
_CATS = ("o_orderpriority", "o_orderstatus", "price", "mixed")
_NUMS = ("o_totalprice", "o_custkey")


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.expr("nullif(o_orderpriority, '5-LOW')").alias("o_orderpriority"),
        "o_orderstatus",
        F.expr("CASE WHEN o_totalprice > 250000 THEN 'high' ELSE 'low' END").alias("price"),
        F.expr("CASE WHEN o_totalprice > 100000 THEN o_orderstatus ELSE 'cheap' END").alias("mixed"),
        "o_totalprice",
        "o_custkey",
    )


def _entropy_sql(given, target, source):
    """S(target), S(target | given) and U for rows where both are present."""
    return f"""SELECT '{given}' AS given, '{target}' AS target, h AS entropy, c AS conditional,
    CASE WHEN h = 0 THEN 1.0 ELSE (h - c) / h END AS u FROM (
      WITH cells AS (SELECT {given} AS g, {target} AS t, count(*) AS n FROM {source} GROUP BY ALL),
      size AS (SELECT sum(n) AS n FROM cells)
      SELECT (SELECT -sum(m / size.n * ln(m / size.n)) FROM (SELECT sum(n) AS m FROM cells GROUP BY t), size) AS h,
        (SELECT sum(cells.n / size.n * ln(o.m / cells.n)) FROM cells, size, (SELECT g, sum(n) AS m FROM cells GROUP BY g) o
          WHERE cells.g = o.g) AS c)"""


_FILLED = f"(SELECT coalesce(o_orderpriority, '0.0') AS o_orderpriority, o_orderstatus, price, mixed, o_totalprice, o_custkey FROM {_ORDERS})"
_COMPLETE = f"(SELECT * FROM {_ORDERS} WHERE o_orderpriority IS NOT NULL)"


def _all_entropies(source):
    return " UNION ALL ".join(_entropy_sql(g, t, source) for g, t in _pairs(_CATS) if g != t)


@suite.add(
    "conditional_entropy",
    f"""SELECT given, target, round(entropy, 6) AS entropy, round(conditional, 6) AS conditional, round(u, 6) AS u
    FROM ({_all_entropies(_FILLED)})""",
)
def conditional_entropy(spark, sf_dir):
    return rounded(association.entropies(_orders(spark, sf_dir), _CATS))


@suite.add(
    "conditional_entropy_complete_rows",
    f"""SELECT given, target, round(entropy, 6) AS entropy, round(conditional, 6) AS conditional, round(u, 6) AS u
    FROM ({_all_entropies(_COMPLETE)})""",
)
def conditional_entropy_complete_rows(spark, sf_dir):
    return rounded(association.entropies(_orders(spark, sf_dir), _CATS, missing="drop_samples"))


_U_SQL = f"""SELECT given AS column_i, target AS column_j, round(u, 6) AS "value" FROM ({_all_entropies(_FILLED)})
    UNION ALL SELECT unnest(['{"', '".join(_CATS)}']), unnest(['{"', '".join(_CATS)}']), 1.0"""


@suite.add("theils_u", _U_SQL)
def theils_u(spark, sf_dir):
    return rounded(association.theils_u(_orders(spark, sf_dir), _CATS))


def _cramer_sql(i, j, source, corrected):
    """Chi-square spelled out over the full cross of margins, empty cells included."""
    value = "sqrt(phi / least(k - 1, r - 1))"
    if corrected:
        rr, kk = "(r - (r - 1) * (r - 1) / (n - 1))", "(k - (k - 1) * (k - 1) / (n - 1))"
        phi = "greatest(0, phi - (k - 1) * (r - 1) / (n - 1))"
        value = f"CASE WHEN least({kk} - 1, {rr} - 1) <= 1e-12 THEN 0 ELSE sqrt({phi} / least({kk} - 1, {rr} - 1)) END"
    return f"""SELECT '{i}' AS column_i, '{j}' AS column_j, CAST(round({value}, 6) AS DOUBLE) AS "value" FROM (
      WITH cells AS (SELECT {i} AS x, {j} AS y, count(*) AS o FROM {source} GROUP BY ALL),
      mx AS (SELECT x, sum(o) AS r FROM cells GROUP BY x), my AS (SELECT y, sum(o) AS c FROM cells GROUP BY y),
      s AS (SELECT CAST(sum(o) AS DOUBLE) AS n FROM cells),
      d AS (SELECT CAST((SELECT count(*) FROM mx) AS DOUBLE) AS r, CAST((SELECT count(*) FROM my) AS DOUBLE) AS k),
      full_cells AS (SELECT coalesce(o, 0) AS o, mx.r * my.c / s.n AS e FROM mx, my, s
                     LEFT JOIN cells ON cells.x = mx.x AND cells.y = my.y)
      SELECT d.r, d.k, s.n, (SELECT sum(CASE WHEN d.r = 2 AND d.k = 2
          THEN pow(greatest(abs(o - e) - 0.5, 0), 2) / e ELSE pow(o - e, 2) / e END) FROM full_cells) / s.n AS phi FROM d, s)"""


def _all_cramer(source, corrected):
    return " UNION ALL ".join(_cramer_sql(i, j, source, corrected) for i, j in _pairs(_CATS) if i != j)


@suite.add("cramers_v", _all_cramer(_COMPLETE, True))
def cramers_v(spark, sf_dir):
    return rounded(association.cramers_v(_orders(spark, sf_dir), _CATS, True, missing="drop_samples"))


@suite.add("cramers_v_plain", _all_cramer(_FILLED, False))
def cramers_v_plain(spark, sf_dir):
    return rounded(association.cramers_v(_orders(spark, sf_dir), _CATS, False))


def _eta_sql(c, v, source):
    return f"""SELECT '{c}' AS category, '{v}' AS number, round(sqrt(b / t), 6) AS "value" FROM (
      WITH d AS (SELECT {c} AS c, {v} AS v FROM {source}), m AS (SELECT avg(v) AS m FROM d)
      SELECT (SELECT sum(n * pow(a - m.m, 2)) FROM (SELECT count(*) AS n, avg(v) AS a FROM d GROUP BY c), m) AS b,
             (SELECT sum(pow(v - m.m, 2)) FROM d, m) AS t)"""


_ETA_SQL = " UNION ALL ".join(_eta_sql(c, v, _FILLED) for c in _CATS for v in _NUMS)


@suite.add("correlation_ratio", _ETA_SQL)
def correlation_ratio(spark, sf_dir):
    return rounded(association.correlation_ratio(_orders(spark, sf_dir), _CATS, _NUMS))


_NUM_SQL = " UNION ALL ".join(_pearson_sql(i, j, _ORDERS) for i, j in _pairs(_NUMS))
_MIXED_SQL = f"""{_NUM_SQL} UNION ALL {_U_SQL}
    UNION ALL SELECT category, number, "value" FROM ({_ETA_SQL})
    UNION ALL SELECT number, category, "value" FROM ({_ETA_SQL})"""


@suite.add("association_mixed", _MIXED_SQL)
def association_mixed(spark, sf_dir):
    return rounded(association.associations(_orders(spark, sf_dir), _CATS, _NUMS))


@suite.add(
    "association_mixed_cramer",
    f"""{_NUM_SQL} UNION ALL {_all_cramer(_FILLED, False)}
    UNION ALL SELECT unnest(['{"', '".join(_CATS)}']), unnest(['{"', '".join(_CATS)}']), 1.0
    UNION ALL SELECT category, number, "value" FROM ({_ETA_SQL})
    UNION ALL SELECT number, category, "value" FROM ({_ETA_SQL})""",
)
def association_mixed_cramer(spark, sf_dir):
    return rounded(association.associations(_orders(spark, sf_dir), _CATS, _NUMS, nominal="cramer"))


@suite.add(
    "top_correlated",
    f"""WITH listed AS (SELECT column_i, sign, rank, column_j, round("value", 2) AS "value" FROM (
      SELECT *, row_number() OVER (PARTITION BY column_i, sign ORDER BY abs("value") DESC, column_j) AS rank
      FROM (SELECT *, CASE WHEN "value" >= 0 THEN 'positive' ELSE 'negative' END AS sign
            FROM ({_MIXED_SQL}) WHERE column_i <> column_j)) WHERE rank <= 10)
    SELECT column_i AS "column", sign, rank, column_j AS other, "value" FROM listed WHERE column_i NOT IN (
      SELECT column_i FROM listed GROUP BY 1 HAVING min("value") >= 0 AND min("value") = max("value"))""",
)
def top_correlated(spark, sf_dir):
    matrix = rounded(association.associations(_orders(spark, sf_dir), _CATS, _NUMS))
    return rounded(association.top_correlated(matrix))
