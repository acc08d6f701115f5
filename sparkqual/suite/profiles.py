"""Profile and frequency queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx, values as vx
from ..operators import frequency, profile
from . import Suite, table
from .rounding import rounded

suite = Suite()

# Dirt the tables lack, derived the same way on both sides.
_DIRTY_ORDERS = """(SELECT o_orderkey, o_custkey,
    NULLIF(o_orderpriority, '5-LOW') AS o_orderpriority,
    CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END AS o_orderstatus,
    o_orderdate FROM orders)"""


def dirty_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.expr("nullif(o_orderpriority, '5-LOW')").alias("o_orderpriority"),
        F.expr("CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END").alias("o_orderstatus"),
        "o_orderdate",
    )


_DIRTY_LINES = """(SELECT l_orderkey, l_partkey, l_linenumber,
    CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS l_quantity,
    l_extendedprice, l_returnflag, l_linestatus FROM lineitem)"""


def dirty_lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_linenumber",
        F.expr("CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END").alias("l_quantity"),
        "l_extendedprice",
        "l_returnflag",
        "l_linestatus",
    )


def _scalar_sql(name: str, kind: str, source: str) -> str:
    number = name if kind == "Numeric" else "CAST(NULL AS DOUBLE)"
    missing = f"{name} IS NULL" + (f" OR {name} = ''" if kind == "Alphanumeric" else "")
    length = f"length(CAST({name} AS VARCHAR))"
    return f"""SELECT '{name}' AS "column", '{kind}' AS type, count(*) AS n,
    count(*) FILTER (WHERE {missing}) AS missing,
    CAST(min({name}) AS VARCHAR) AS "min", CAST(max({name}) AS VARCHAR) AS "max",
    round(avg({number}), 6) AS mean, round(stddev_samp({number}), 6) AS std,
    min({length}) AS min_length, max({length}) AS max_length, round(avg({length}), 6) AS mean_length,
    count(DISTINCT {name}) AS "distinct", round(CAST(median({number}) AS DOUBLE), 6) AS median
    FROM {source}"""


_LINE_KINDS = {
    "l_orderkey": "Numeric",
    "l_partkey": "Numeric",
    "l_linenumber": "Numeric",
    "l_quantity": "Numeric",
    "l_extendedprice": "Numeric",
    "l_returnflag": "Alphanumeric",
    "l_linestatus": "Alphanumeric",
}


@suite.add("profile_scalars", " UNION ALL ".join(_scalar_sql(c, k, _DIRTY_LINES) for c, k in _LINE_KINDS.items()))
def profile_scalars(spark, sf_dir):
    return rounded(profile.scalar_profile(dirty_lines(spark, sf_dir)))


@suite.add("profile_estimates")
def profile_estimates(spark, sf_dir):
    return profile.scalar_profile(dirty_lines(spark, sf_dir), exact=False)


@suite.add("approx_distinct")
def approx_distinct(spark, sf_dir):
    return profile.distinct_estimates(table(spark, sf_dir, "lineitem"))


_SHAPE = "l_returnflag, l_linestatus, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS l_quantity"


@suite.add(
    "table_counts",
    f"""SELECT CAST(sum(n) AS BIGINT) AS row_count, CAST(3 AS BIGINT) AS column_count,
    count(*) FILTER (WHERE n > 1) AS duplicate_groups, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows,
    CAST(sum(CASE WHEN l_quantity IS NULL THEN n ELSE 0 END) AS BIGINT) AS missing_cells
    FROM (SELECT l_returnflag, l_linestatus, l_quantity, count(*) AS n
          FROM (SELECT {_SHAPE} FROM lineitem) GROUP BY ALL)""",
)
def table_counts(spark, sf_dir):
    lines = dirty_lines(spark, sf_dir).select("l_returnflag", "l_linestatus", "l_quantity")
    return profile.table_counts(lines)


@suite.add(
    "duplicate_documents",
    """SELECT CAST(sum(n) AS BIGINT) AS row_count, CAST(2 AS BIGINT) AS column_count,
    count(*) FILTER (WHERE n > 1) AS duplicate_groups, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows,
    CAST(sum(CASE WHEN text = '' THEN n ELSE 0 END) AS BIGINT) AS missing_cells
    FROM (SELECT text, lang, count(*) AS n FROM documents GROUP BY text, lang)""",
)
def duplicate_documents(spark, sf_dir):
    return profile.table_counts(table(spark, sf_dir, "documents").select("text", "lang"))


@suite.add(
    "missing_counts",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} IS NULL OR CAST({c} AS VARCHAR) = '') AS missing,
        round(100.0 * count(*) FILTER (WHERE {c} IS NULL OR CAST({c} AS VARCHAR) = '') / count(*), 6) AS missing_pct
        FROM {_DIRTY_ORDERS}"""
        for c in ("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_orderdate")
    ),
)
def missing_counts(spark, sf_dir):
    return rounded(profile.missing_counts(dirty_orders(spark, sf_dir)))


def _length_sql(name: str, source: str) -> str:
    length = f"length(CAST({name} AS VARCHAR))"
    return f"""SELECT '{name}' AS "column", min({length}) AS min_length, max({length}) AS max_length,
    round(avg({length}), 6) AS mean_length, CAST(median({length}) AS DOUBLE) AS median_length FROM {source}"""


@suite.add(
    "length_stats",
    " UNION ALL ".join(_length_sql(c, "documents") for c in ("doc_id", "text", "lang", "source", "n_chars")),
)
def length_stats(spark, sf_dir):
    return rounded(profile.length_profile(table(spark, sf_dir, "documents")))


def _text_sql(name: str, source: str) -> str:
    alpha, numeric, alnum = (f"regexp_full_match(v, '{p}')" for p in (r"\p{L}+", r"\p{N}+", r"[\p{L}\p{N}]+"))
    return f"""SELECT "column", non_null, nulls, "distinct", min_length, max_length, round(mean_length, 6) AS mean_length,
    median_length, alphabetic, numeric, alphanumeric, alphabetic_pct, numeric_pct, alphanumeric_pct,
    CASE WHEN alphabetic >= numeric AND alphabetic >= alphanumeric THEN 'Alphabetic'
         WHEN numeric >= alphanumeric THEN 'Numeric' ELSE 'Alphanumeric' END AS suggested_type,
    non_null - "distinct" AS duplicates,
    coalesce(least(CASE WHEN alphabetic_pct > 0 AND alphabetic_pct < 4 THEN alphabetic_pct END,
                   CASE WHEN numeric_pct > 0 AND numeric_pct < 4 THEN numeric_pct END,
                   CASE WHEN alphanumeric_pct > 0 AND alphanumeric_pct < 4 THEN alphanumeric_pct END), 0.0) AS outlier_pct
    FROM (SELECT *, round_even(100.0 * alphabetic / non_null, 2) AS alphabetic_pct,
            round_even(100.0 * numeric / non_null, 2) AS numeric_pct,
            round_even(100.0 * alphanumeric / non_null, 2) AS alphanumeric_pct
      FROM (SELECT '{name}' AS "column", CAST(sum(n) FILTER (WHERE v IS NOT NULL) AS BIGINT) AS non_null,
            CAST(coalesce(sum(n) FILTER (WHERE v IS NULL), 0) AS BIGINT) AS nulls, count(v) AS "distinct",
            min(length(v)) AS min_length, max(length(v)) AS max_length, avg(length(v)) AS mean_length,
            CAST(median(length(v)) AS DOUBLE) AS median_length,
            CAST(coalesce(sum(n) FILTER (WHERE {alpha}), 0) AS BIGINT) AS alphabetic,
            CAST(coalesce(sum(n) FILTER (WHERE {numeric}), 0) AS BIGINT) AS numeric,
            CAST(coalesce(sum(n) FILTER (WHERE {alnum}), 0) - coalesce(sum(n) FILTER (WHERE {alpha}), 0)
                 - coalesce(sum(n) FILTER (WHERE {numeric}), 0) AS BIGINT) AS alphanumeric
          FROM (SELECT {name} AS v, count(*) AS n FROM {source} GROUP BY {name})))"""


_PARTS = """(SELECT p_name, p_brand, NULLIF(p_type, 'ECONOMY') AS p_type,
    CASE WHEN p_size = 7 THEN CAST(p_size AS VARCHAR) ELSE p_type END AS p_mixed FROM part)"""


def dirty_parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_name",
        "p_brand",
        F.expr("nullif(p_type, 'ECONOMY')").alias("p_type"),
        F.expr("CASE WHEN p_size = 7 THEN CAST(p_size AS STRING) ELSE p_type END").alias("p_mixed"),
    )


@suite.add("profile_text", " UNION ALL ".join(_text_sql(c, _PARTS) for c in ("p_name", "p_brand", "p_type", "p_mixed")))
def profile_text(spark, sf_dir):
    return rounded(profile.text_profile(dirty_parts(spark, sf_dir)))


@suite.add(
    "profile_dates",
    """SELECT 'o_orderdate' AS "column", count(*) AS records,
    count(*) FILTER (WHERE o_orderdate IS NULL) AS nulls,
    strftime(min(o_orderdate), '%d/%m/%Y') AS "first", strftime(max(o_orderdate), '%d/%m/%Y') AS "last",
    'DD/MM/YYYY' AS mask
    FROM (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderdate END AS o_orderdate FROM orders)""",
)
def profile_dates(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.expr("CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderdate END").alias("o_orderdate")
    )
    return profile.time_profile(orders)


@suite.add(
    "date_frequency",
    """SELECT 'o_orderdate' AS "column", strftime(o_orderdate, '%d/%m/%Y') AS "value", count(*) AS n
    FROM orders GROUP BY ALL""",
)
def date_frequency(spark, sf_dir):
    return profile.time_frequency(table(spark, sf_dir, "orders"))


_FREQ_COLUMNS = ("o_custkey", "o_orderpriority", "o_orderstatus")
_ORDER_FREQ = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS "value", count(*) AS n FROM {_DIRTY_ORDERS} GROUP BY {c}"""
    for c in _FREQ_COLUMNS
)


@suite.add("frequency_all", _ORDER_FREQ)
def frequency_all(spark, sf_dir):
    return frequency.value_frequency(dirty_orders(spark, sf_dir), _FREQ_COLUMNS)


@suite.add(
    "frequency_every_column",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS "value", count(*) AS n FROM lineitem GROUP BY {c}"""
        for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                  "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    ),
)
def frequency_every_column(spark, sf_dir):
    return frequency.value_frequency(table(spark, sf_dir, "lineitem"))


def _top_sql(k: int) -> str:
    return f"""SELECT "column", "value", n, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, "value") AS rank
    FROM ({_ORDER_FREQ}) WHERE "value" IS NOT NULL) WHERE rank <= {k}"""


@suite.add("frequency_top15", _top_sql(15))
def frequency_top15(spark, sf_dir):
    return rounded(frequency.top_values(dirty_orders(spark, sf_dir), _FREQ_COLUMNS, 15))


@suite.add(
    "frequency_top3_share",
    f"""WITH shown AS (SELECT o_orderpriority, strftime(o_orderdate, '%d-%m-%Y') AS o_orderdate FROM {_DIRTY_ORDERS}),
    freq AS (SELECT 'o_orderpriority' AS "column", o_orderpriority AS "value", count(*) AS n FROM shown GROUP BY ALL
             UNION ALL SELECT 'o_orderdate', o_orderdate, count(*) FROM shown GROUP BY ALL)
    SELECT "column", "value", n, rank, round_even(100.0 * n / (SELECT count(*) FROM shown), 4) AS share FROM (
      SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, "value") AS rank
      FROM freq WHERE "value" IS NOT NULL) WHERE rank <= 3""",
)
def frequency_top3_share(spark, sf_dir):
    return rounded(frequency.top_shares(dirty_orders(spark, sf_dir), ["o_orderpriority", "o_orderdate"]))


_MASK_SQL = r"""translate(regexp_replace(regexp_replace({c}, '[^\p{{L}}\p{{N}}_]', chr(1), 'g'),
    '[^A-Za-z0-9' || chr(1) || ']', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789' || chr(1), '{classes}')""".replace(
    "{classes}", "L" * 52 + "D" * 10 + "S"
)
_PATTERN_SQL = r"""array_to_string(list_filter(list_transform(regexp_split_to_array({c}, '[-,;_ ]'),
    lambda t: CASE WHEN regexp_full_match(t, '\p{{L}}+') THEN 'W' WHEN regexp_full_match(t, '\p{{N}}+') THEN 'S-N'
                   WHEN regexp_full_match(t, '[\p{{L}}\p{{N}}]+') THEN 'S' END), lambda k: k IS NOT NULL), '-')"""


def _spread_sql(expression: str, label: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {expression.format(c=c)} AS {label}, count(*) AS n FROM {t} GROUP BY ALL"""
        for c, t in columns.items()
    )


@suite.add("mask_distribution", _spread_sql(_MASK_SQL, "mask", {"event_type": "events", "props": "events"}))
def mask_distribution(spark, sf_dir):
    return frequency.mask_distribution(table(spark, sf_dir, "events"))


@suite.add("mask_documents", _spread_sql(_MASK_SQL, "mask", {"text": "documents", "source": "documents"}))
def mask_documents(spark, sf_dir):
    return frequency.mask_distribution(table(spark, sf_dir, "documents"), ["text", "source"])


@suite.add("pattern_distribution", _spread_sql(_PATTERN_SQL, "pattern", {"p_name": "part", "p_brand": "part", "p_type": "part"}))
def pattern_distribution(spark, sf_dir):
    return frequency.pattern_distribution(table(spark, sf_dir, "part"))


@suite.add("pattern_documents", _spread_sql(_PATTERN_SQL, "pattern", {"text": "documents"}))
def pattern_documents(spark, sf_dir):
    return frequency.pattern_distribution(table(spark, sf_dir, "documents"), ["text"])


@suite.add(
    "mask_top15",
    f"""SELECT 'p_name' AS "column", {_MASK_SQL.format(c='v')} AS mask, CAST(sum(n) AS BIGINT) AS n FROM (
      SELECT v, n, row_number() OVER (ORDER BY n DESC, v) AS r FROM (SELECT p_name AS v, count(*) AS n FROM part GROUP BY 1))
    WHERE r <= 15 GROUP BY ALL""",
)
def mask_top15(spark, sf_dir):
    return frequency.mask_distribution(table(spark, sf_dir, "part"), ["p_name"], top_n=15)


@suite.add(
    "length_mask",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", coalesce('L' || length({c}), 'L') AS mask, count(*) AS n FROM {_PARTS} GROUP BY ALL"""
        for c in ("p_name", "p_brand", "p_type", "p_mixed")
    ),
)
def length_mask(spark, sf_dir):
    return frequency.length_distribution(dirty_parts(spark, sf_dir))


@suite.add(
    "word_pattern",
    r"""SELECT 'text' AS "column", array_to_string(list_transform(list_filter(regexp_split_to_array(text, '\s+'),
        lambda w: w <> ''), lambda w: 'W'), '-') AS pattern, count(*) AS n FROM documents GROUP BY ALL""",
)
def word_pattern(spark, sf_dir):
    return frequency.word_distribution(table(spark, sf_dir, "documents"), ["text"])


@suite.add(
    "mask_lengths",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", coalesce(min(length(m)) FILTER (WHERE contains(m, 'D')), 0) AS digit_min,
        coalesce(max(length(m)) FILTER (WHERE contains(m, 'D')), 0) AS digit_max,
        coalesce(min(length(m)) FILTER (WHERE contains(m, 'L')), 0) AS letter_min,
        coalesce(max(length(m)) FILTER (WHERE contains(m, 'L')), 0) AS letter_max
        FROM (SELECT DISTINCT {_MASK_SQL.format(c=c)} AS m FROM {_PARTS} WHERE {c} IS NOT NULL)"""
        for c in ("p_name", "p_mixed")
    ),
)
def mask_lengths(spark, sf_dir):
    return frequency.mask_lengths(dirty_parts(spark, sf_dir), ["p_name", "p_mixed"])


@suite.add(
    "outliers_3sigma",
    """WITH b AS (SELECT avg(value) - 3 * stddev_pop(value) AS lo, avg(value) + 3 * stddev_pop(value) AS hi FROM events)
    SELECT event_id, 'value' AS "column", value FROM events, b WHERE value > hi OR value < lo""",
)
def outliers_3sigma(spark, sf_dir):
    return profile.outliers(table(spark, sf_dir, "events"), ["value"], keep=["event_id"])


def _share_sql(columns: dict[str, str], dev: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE x > hi OR x < lo) AS outliers,
        round(100.0 * count(*) FILTER (WHERE x > hi OR x < lo) / count(x), 6) AS outlier_pct,
        round(100.0 * (count(x) - count(*) FILTER (WHERE x > hi OR x < lo)) / count(x), 6) AS normal_pct
        FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {t}),
             (SELECT avg({c}) - 3 * {dev}({c}) AS lo, avg({c}) + 3 * {dev}({c}) AS hi FROM {t})"""
        for c, t in columns.items()
    )


_EVENT_NUMBERS = {"event_id": "events", "user_id": "events", "value": "events"}


@suite.add("outlier_shares", _share_sql(_EVENT_NUMBERS, "stddev_pop"))
def outlier_shares(spark, sf_dir):
    return rounded(profile.outlier_shares(table(spark, sf_dir, "events")))


@suite.add("outlier_shares_sample", _share_sql(_EVENT_NUMBERS, "stddev_samp"))
def outlier_shares_sample(spark, sf_dir):
    return rounded(profile.outlier_shares(table(spark, sf_dir, "events"), ddof=1))


@suite.add(
    "prediction_targets",
    """SELECT * FROM (""" + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS "distinct" FROM lineitem"""
        for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                  "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    ) + """) WHERE "distinct" <= 10""",
)
def prediction_targets(spark, sf_dir):
    return profile.prediction_targets(table(spark, sf_dir, "lineitem"))


def _digest_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", coalesce(CAST(sum(n) FILTER (WHERE v IS NULL) AS BIGINT), 0) AS nulls,
    count(v) AS "distinct", max(v) FILTER (WHERE r = 1) AS first_value, max(n) FILTER (WHERE r = 1) AS first_n,
    max(v) FILTER (WHERE r = 2) AS second_value, max(n) FILTER (WHERE r = 2) AS second_n
    FROM (SELECT v, n, row_number() OVER (ORDER BY v IS NULL, n DESC, v) AS r FROM (
      SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {_DIRTY_ORDERS} GROUP BY 1))"""


@suite.add("column_digest", " UNION ALL ".join(_digest_sql(c) for c in _FREQ_COLUMNS))
def column_digest(spark, sf_dir):
    return frequency.column_digest(dirty_orders(spark, sf_dir), _FREQ_COLUMNS)


@suite.add(
    "chart_hints",
    f"""SELECT "column", count(*) AS listed, count(*) BETWEEN 2 AND 5 AS show_chart FROM ({_top_sql(15)}) GROUP BY 1""",
)
def chart_hints(spark, sf_dir):
    return frequency.chart_hints(dirty_orders(spark, sf_dir), _FREQ_COLUMNS)


_DOC_WORDS = r"""SELECT doc_id, regexp_full_match(source, '\p{L}+') AS alpha, regexp_full_match(source, '\p{N}+') AS numeric,
    regexp_full_match(source, '[\p{L}\p{N}]+') AS alnum, regexp_full_match(lang, '\p{Nd}+') AS digits,
    regexp_replace(text, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g') AS stripped, length(regexp_replace(text, '[^0-9]', '', 'g')) AS digit_count,
    replace(source, '.', '') AS undotted, regexp_matches(text, '(?i)the') AS has_the, length(text) AS text_length FROM documents"""


@suite.add("text_functions", _DOC_WORDS)
def text_functions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    source, words = F.col("source"), F.col("text")
    return rounded(
        docs.select(
            "doc_id",
            tx.is_alpha(source).alias("alpha"),
            tx.is_number_text(source).alias("numeric"),
            tx.is_alnum(source).alias("alnum"),
            tx.is_digits(F.col("lang")).alias("digits"),
            tx.strip(words).alias("stripped"),
            tx.count_digits(words).alias("digit_count"),
            tx.drop_dots(source).alias("undotted"),
            tx.contains_pattern(words, "the").alias("has_the"),
            tx.text_length(words).alias("text_length"),
        )
    )


@suite.add(
    "value_functions",
    """SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k,
    try_cast(event_type AS DOUBLE) AS no_number, round_even(value, 1) AS value_1,
    strftime(ts, '%d-%m-%Y') AS day, CAST(ts AS DATE) = DATE '2024-01-15' AS mid_month,
    round(ln(value), 6) AS log_value, round(sqrt(value), 6) AS root_value,
    coalesce(NULLIF(event_type, 'click'), 'None') AS shown FROM events""",
)
def value_functions(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select(
        "event_id",
        vx.to_number(vx.json_field(F.col("props"), "$.k")).alias("k"),
        vx.to_number(F.col("event_type")).alias("no_number"),
        vx.half_even(F.col("value"), 1).alias("value_1"),
        vx.day_text(F.col("ts")).alias("day"),
        (F.to_date("ts") == F.lit("2024-01-15").cast("date")).alias("mid_month"),
        F.round(F.log("value"), 6).alias("log_value"),
        F.round(F.sqrt("value"), 6).alias("root_value"),
        vx.shown(F.expr("nullif(event_type, 'click')")).alias("shown"),
    )


@suite.add("frequency_ordered", _ORDER_FREQ)
def frequency_ordered(spark, sf_dir):
    return frequency.by_frequency(frequency.value_frequency(dirty_orders(spark, sf_dir), _FREQ_COLUMNS))


@suite.add(
    "reference_and_time_functions",
    """SELECT o_orderkey, 'ref' AS ref, CAST(o_custkey AS VARCHAR) AS id, 'c-' || o_orderpriority AS "column",
    CAST(o_orderdate AS TIMESTAMP) AS instant, CASE WHEN o_totalprice < 100000 THEN 0.0 ELSE o_totalprice END AS finite,
    o_orderstatus IN ('F', 'P') AS overlap, CASE WHEN o_custkey = 7 THEN NULL ELSE o_totalprice / (o_custkey - 7) END AS quotient
    FROM orders""",
)
def reference_and_time_functions(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    reference = F.concat_ws("-", F.lit("ref"), F.col("o_custkey"), F.lit("c"), F.col("o_orderpriority"))
    instant = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    price = F.expr("CASE WHEN o_totalprice < 50000 THEN double('inf') WHEN o_totalprice < 100000 THEN double('nan') ELSE o_totalprice END")
    return orders.select(
        "o_orderkey",
        tx.split_reference(reference).alias("r"),
        vx.parse_instant(instant).cast("timestamp_ntz").alias("instant"),
        vx.finite_or_zero(price).alias("finite"),
        vx.overlaps(F.array("o_orderstatus"), ["F", "P"]).alias("overlap"),
        vx.ratio(F.col("o_totalprice"), F.col("o_custkey") - 7).alias("quotient"),
    ).select("o_orderkey", "r.*", "instant", "finite", "overlap", "quotient")


_DOCUMENT_COLUMNS = {"c_custkey": "Numeric", "c_name": "Alphanumeric", "c_nationkey": "Numeric", "c_mktsegment": "Alphanumeric"}


@suite.add(
    "profile_document",
    " UNION ALL ".join(
        f"""SELECT 'columns' AS part, "column", 'distinct' AS item, CAST("distinct" AS DOUBLE) AS "value" FROM ({_scalar_sql(c, k, 'customer')})"""
        for c, k in _DOCUMENT_COLUMNS.items()
    )
    + " UNION ALL "
    + " UNION ALL ".join(
        f"""SELECT 'masks', '{c}', {_MASK_SQL.format(c=c)}, CAST(count(*) AS DOUBLE) FROM customer GROUP BY ALL"""
        for c in ("c_name", "c_mktsegment")
    )
    + """ UNION ALL SELECT 'correlations', 'c_custkey', 'c_nationkey', round(corr(c_custkey, c_nationkey), 6) FROM customer
    UNION ALL SELECT 'table', 'rows', 'row_count', CAST(count(*) AS DOUBLE) FROM customer""",
)
def profile_document(spark, sf_dir):
    """Parts of the whole document in one long table."""
    parts = profile.profile_document(table(spark, sf_dir, "customer").select(*_DOCUMENT_COLUMNS))

    def part(name, column, item, value):
        return parts[name].select(
            F.lit(name).alias("part"), column.alias("column"), item.alias("item"), value.cast("double").alias("value")
        )

    c = F.col
    pair = (c("column_i") == "c_custkey") & (c("column_j") == "c_nationkey")
    parts["correlations"] = parts["correlations"].filter(pair)
    return rounded(
        part("columns", c("column"), F.lit("distinct"), c("distinct"))
        .unionByName(part("masks", c("column"), c("mask"), c("n")))
        .unionByName(part("correlations", c("column_i"), c("column_j"), c("value")))
        .unionByName(part("table", F.lit("rows"), F.lit("row_count"), c("row_count")))
    )
