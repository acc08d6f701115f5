"""Cleaning, de-duplication and privacy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import conjunction, numeric_relation
from ..operators import clean, dedup, privacy
from . import Suite, table
from .rounding import rounded

suite = Suite()

_ORDERS = """(SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice END AS price,
    CASE WHEN o_orderpriority = '2-HIGH' THEN NULL ELSE o_custkey END AS custkey,
    CASE WHEN o_totalprice < 50000 THEN NULL ELSE o_orderpriority END AS priority, o_orderstatus FROM orders)"""


def dirty_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.expr("CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice END").alias("price"),
        F.expr("CASE WHEN o_orderpriority = '2-HIGH' THEN NULL ELSE o_custkey END").alias("custkey"),
        F.expr("CASE WHEN o_totalprice < 50000 THEN NULL ELSE o_orderpriority END").alias("priority"),
        "o_orderstatus",
    )


_MODE = """(SELECT {c} FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"""
_FILLS = {
    "mean": ("price", f"(SELECT avg(price) FROM {_ORDERS})"),
    "median": ("price", f"(SELECT median(price) FROM {_ORDERS})"),
    "25%": ("price", f"(SELECT quantile_cont(price, 0.25) FROM {_ORDERS})"),
    "75%": ("price", f"(SELECT quantile_cont(price, 0.75) FROM {_ORDERS})"),
    "min": ("price", f"(SELECT min(price) FROM {_ORDERS})"),
    "max": ("price", f"(SELECT max(price) FROM {_ORDERS})"),
    "mode": ("custkey", _MODE.format(c="custkey", t=_ORDERS)),
    "value": ("price", "-1.5"),
}


def _impute(how):
    column, fill = _FILLS[how]
    digits = f"round(coalesce({column}, {fill}), 6)" if column == "price" else f"coalesce({column}, {fill})"
    name = "impute_" + how.replace("25%", "q25").replace("75%", "q75")

    @suite.add(name, f"SELECT o_orderkey, {digits} AS {column} FROM {_ORDERS}")
    def run(spark, sf_dir):
        orders = dirty_orders(spark, sf_dir).select("o_orderkey", column)
        return rounded(clean.impute(orders, column, how, -1.5))


for _how in _FILLS:
    _impute(_how)


@suite.add(
    "impute_text_mode",
    f"SELECT o_orderkey, coalesce(priority, {_MODE.format(c='priority', t=_ORDERS)}) AS priority FROM {_ORDERS}",
)
def impute_text_mode(spark, sf_dir):
    return clean.impute(dirty_orders(spark, sf_dir).select("o_orderkey", "priority"), "priority", "mode")


@suite.add(
    "impute_conditional",
    f"""SELECT o_orderkey, o_orderstatus, round(CASE WHEN price IS NULL AND o_orderstatus = 'F' AND custkey > 200
      THEN (SELECT avg(price) FROM {_ORDERS} WHERE o_orderstatus = 'F' AND custkey > 200) ELSE price END, 6) AS price FROM {_ORDERS}""",
)
def impute_conditional(spark, sf_dir):
    where = conjunction(['o_orderstatus == "F"', "custkey > 200"])
    filled = clean.impute(dirty_orders(spark, sf_dir), "price", "mean", where=where)
    return rounded(filled.select("o_orderkey", "o_orderstatus", "price"))


_EDITS = f"(SELECT o_orderkey, 'XX' AS priority, CASE WHEN o_orderstatus = 'O' THEN 9.5 END AS price FROM {_ORDERS} WHERE custkey < 300)"


def _edits(orders):
    return orders.filter("custkey < 300").select(
        "o_orderkey", F.lit("XX").alias("priority"), F.expr("CASE WHEN o_orderstatus = 'O' THEN 9.5D END").alias("price")
    )


_EDITED = f"""(SELECT o.o_orderkey, coalesce(e.price, o.price) AS price, custkey,
    coalesce(e.priority, o.priority) AS priority, o_orderstatus
    FROM {_ORDERS} o LEFT JOIN {_EDITS} e ON o.o_orderkey = e.o_orderkey)"""


@suite.add("impute_cells", f"SELECT o_orderkey, price, custkey, priority, o_orderstatus FROM {_EDITED}")
def impute_cells(spark, sf_dir):
    orders = dirty_orders(spark, sf_dir)
    return clean.replace_cells(orders, _edits(orders), "o_orderkey")


_CHANGED = f"""(SELECT o_orderkey, 'priority' AS "column", o.priority AS previous_value, e.priority AS changed_value
    FROM {_ORDERS} o JOIN {_EDITED} e USING (o_orderkey) WHERE o.priority IS DISTINCT FROM e.priority)"""


@suite.add("audit_changed_cells", f"SELECT * FROM {_CHANGED}")
def audit_changed_cells(spark, sf_dir):
    orders = dirty_orders(spark, sf_dir)
    edited = clean.replace_cells(orders, _edits(orders), "o_orderkey")
    return clean.changed_cells(orders, edited, "o_orderkey", ["priority"])


@suite.add(
    "audit_log_entries",
    f"""SELECT 'orders' AS sourcepath, 'S1' AS source_id, CAST(NULL AS VARCHAR) AS source_file, CAST(NULL AS VARCHAR) AS upload_id,
    'IMPUTE' AS action, "column", previous_value, changed_value, count(*) AS changed_count
    FROM {_CHANGED} WHERE changed_value = 'XX' GROUP BY ALL""",
)
def audit_log_entries(spark, sf_dir):
    changes = audit_changed_cells(spark, sf_dir)
    log = clean.audit_entries(changes, "IMPUTE", sourcepath="orders", source_id="S1")
    return clean.log_entries(log, "changed_value", "XX").drop("process_time")


@suite.add(
    "audit_changed_rows",
    f"SELECT o_orderkey, custkey, o_orderstatus FROM {_ORDERS} WHERE o_orderkey IN (SELECT o_orderkey FROM {_CHANGED})",
)
def audit_changed_rows(spark, sf_dir):
    changes = audit_changed_cells(spark, sf_dir)
    rows = clean.rows_by_id(dirty_orders(spark, sf_dir), changes, "o_orderkey")
    return rows.select("o_orderkey", "custkey", "o_orderstatus")


@suite.add(
    "register_cleaned",
    """SELECT user_id AS source_id, max(ts) AS process_time, arg_max(event_id, ts) AS file
    FROM events GROUP BY user_id""",
)
def register_cleaned(spark, sf_dir):
    entries = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("source_id"), F.col("ts").alias("process_time"), F.col("event_id").alias("file"), "event_type"
    )
    old = entries.filter("event_type IN ('click', 'view')").drop("event_type")
    new = entries.filter("event_type NOT IN ('click', 'view')").drop("event_type")
    return clean.register_cleaned(old, new)


@suite.add("select_columns", "SELECT o_orderkey, o_orderstatus FROM orders")
def select_columns(spark, sf_dir):
    return clean.select_columns(table(spark, sf_dir, "orders"), ["o_orderkey", "o_orderstatus"])


@suite.add("null_preview", f"SELECT o_orderkey, custkey, priority FROM {_ORDERS} WHERE priority IS NULL")
def null_preview(spark, sf_dir):
    return clean.null_rows(dirty_orders(spark, sf_dir), "priority").select("o_orderkey", "custkey", "priority")


@suite.add("rows_with_values", "SELECT * FROM events WHERE event_type IN ('click', 'view', 'error')")
def rows_with_values(spark, sf_dir):
    return clean.rows_with_values(table(spark, sf_dir, "events"), "event_type", ["click", "view", "error"])


@suite.add(
    "search_rows",
    r"""SELECT doc_id, source FROM documents WHERE regexp_matches(CAST(doc_id AS VARCHAR), '(?i)data[a-z]*\s+the')
    OR regexp_matches(text, '(?i)(data[a-z]*|the)\s+of') OR regexp_matches(lang, '(?i)(data[a-z]*|the)\s+of')
    OR regexp_matches(source, '(?i)(data[a-z]*|the)\s+of') OR regexp_matches(CAST(n_chars AS VARCHAR), '(?i)(data[a-z]*|the)\s+of')""",
)
def search_rows(spark, sf_dir):
    return clean.search_rows(table(spark, sf_dir, "documents"), r"(data[a-z]*|the)\s+of").select("doc_id", "source")


@suite.add("drop_by_value", "SELECT * FROM events WHERE event_type NOT IN ('click')")
def drop_by_value(spark, sf_dir):
    return clean.drop_where(table(spark, sf_dir, "events"), F.col("event_type").isin("click"))


@suite.add("drop_by_range", f"SELECT o_orderkey, price FROM {_ORDERS} WHERE price IS NULL OR NOT price BETWEEN 10000 AND 150000")
def drop_by_range(spark, sf_dir):
    hit = numeric_relation(F.col("price"), [{"operator": "between", "value": (10000, 150000)}])
    return clean.drop_where(dirty_orders(spark, sf_dir), hit).select("o_orderkey", "price")


@suite.add(
    "drop_rows_by_id",
    f"SELECT o_orderkey, custkey FROM {_ORDERS} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {_ORDERS} WHERE price > 200000)",
)
def drop_rows_by_id(spark, sf_dir):
    orders = dirty_orders(spark, sf_dir)
    return clean.drop_rows(orders, orders.filter("price > 200000"), "o_orderkey").select("o_orderkey", "custkey")


@suite.add("drop_columns", "SELECT event_id, ts, user_id, value FROM events")
def drop_columns(spark, sf_dir):
    return clean.drop_columns(table(spark, sf_dir, "events"), ["props", "event_type"])


_GAPS = "(SELECT price, custkey, priority, NULLIF(o_orderstatus, 'O') AS status, CAST(NULL AS VARCHAR) AS nothing FROM {s})".format(s=_ORDERS)


def _gaps(spark, sf_dir):
    return dirty_orders(spark, sf_dir).select(
        "price", "custkey", "priority", F.expr("nullif(o_orderstatus, 'O')").alias("status"),
        F.lit(None).cast("string").alias("nothing"),
    )


_FILLED_CELLS = "(CAST(price IS NOT NULL AS INT) + CAST(custkey IS NOT NULL AS INT) + CAST(priority IS NOT NULL AS INT) + CAST(status IS NOT NULL AS INT))"


@suite.add("drop_null_rows", f"SELECT * FROM {_GAPS} WHERE {_FILLED_CELLS} >= 3")
def drop_null_rows(spark, sf_dir):
    return clean.drop_null_rows(_gaps(spark, sf_dir), 0.7)


@suite.add("drop_all_null_rows", f"SELECT price, priority, status FROM {_GAPS} WHERE price IS NOT NULL OR priority IS NOT NULL OR status IS NOT NULL")
def drop_all_null_rows(spark, sf_dir):
    return clean.drop_null_rows(_gaps(spark, sf_dir).select("price", "priority", "status"))


@suite.add("drop_null_columns", f"SELECT price, custkey, priority FROM {_GAPS}")
def drop_null_columns(spark, sf_dir):
    return clean.drop_null_columns(_gaps(spark, sf_dir), 0.3)


@suite.add(
    "shape_report",
    f"""SELECT (SELECT count(*) FROM {_GAPS}) AS rows_before, count(*) AS rows_after, CAST(5 AS BIGINT) AS columns_before,
    CAST(3 AS BIGINT) AS columns_after, ['status', 'nothing'] AS removed_columns FROM {_GAPS} WHERE {_FILLED_CELLS} >= 3""",
)
def shape_report(spark, sf_dir):
    before = _gaps(spark, sf_dir)
    after = clean.drop_columns(clean.drop_null_rows(before, 0.7), ["status", "nothing"])
    return clean.shape_report(before, after)


@suite.add(
    "removed_rows",
    f"SELECT o_orderkey, priority FROM {_ORDERS} WHERE priority IS NULL AND price IS NULL",
)
def removed_rows(spark, sf_dir):
    orders = dirty_orders(spark, sf_dir)
    kept = clean.drop_where(orders, F.col("priority").isNull() & F.col("price").isNull())
    return clean.removed_rows(orders, kept, "o_orderkey").select("o_orderkey", "priority")


@suite.add(
    "conditional_projection",
    f"SELECT o_orderkey, CASE WHEN price > 100000 THEN 'big' ELSE o_orderstatus END AS label FROM {_ORDERS}",
)
def conditional_projection(spark, sf_dir):
    label = clean.choose(F.col("price") > 100000, F.lit("big"), F.col("o_orderstatus"))
    return dirty_orders(spark, sf_dir).select("o_orderkey", label.alias("label"))


@suite.add(
    "find_replace",
    """SELECT c_custkey, c_name, CASE WHEN c_nationkey = 7 THEN 70 ELSE c_nationkey END AS c_nationkey, c_acctbal,
    CASE WHEN c_mktsegment = '7' THEN '70' ELSE c_mktsegment END AS c_mktsegment FROM customer""",
)
def find_replace(spark, sf_dir):
    return rounded(
        clean.find_replace(table(spark, sf_dir, "customer"), "7", "70", ["c_nationkey", "c_mktsegment"]), 2
    )


@suite.add(
    "find_replace_text",
    """SELECT event_id, CASE WHEN event_type = 'click' THEN 'tap' ELSE event_type END AS event_type FROM events""",
)
def find_replace_text(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return clean.find_replace(events, "click", "tap", ["event_type"])


_ACCESS = "SELECT event_id FROM events WHERE user_id = 7 OR event_type = 'purchase' OR json_extract_string(props, '$.k') IN ('3', '5')"


@suite.add("access_filter", _ACCESS)
def access_filter(spark, sf_dir):
    sources = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("user_id") == 7, "ann").otherwise("bob").alias("owner"),
        F.when(F.col("event_type") == "purchase", "ann").otherwise("eve").alias("creator"),
        F.array(F.get_json_object("props", "$.k")).alias("departments"),
    )
    return clean.visible_to(sources, "ann", ["3", "5"]).select("event_id")


_DEDUP = "SELECT {c} FROM (SELECT *, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id{d}) AS r, count(*) OVER (PARTITION BY text, lang) AS n FROM documents) WHERE {w}"


@suite.add("dedup_first", _DEDUP.format(c="doc_id, text, lang, source, n_chars", d="", w="r = 1"))
def dedup_first(spark, sf_dir):
    return dedup.deduplicate(table(spark, sf_dir, "documents"), ["text", "lang"], "doc_id")


@suite.add("dedup_last", _DEDUP.format(c="doc_id, text, lang, source, n_chars", d=" DESC", w="r = 1"))
def dedup_last(spark, sf_dir):
    return dedup.deduplicate(table(spark, sf_dir, "documents"), ["text", "lang"], "doc_id", "last")


@suite.add("dedup_none", _DEDUP.format(c="doc_id, text, lang, source, n_chars", d="", w="n = 1"))
def dedup_none(spark, sf_dir):
    return dedup.deduplicate(table(spark, sf_dir, "documents"), ["text", "lang"], "doc_id", "none")


@suite.add("dup_members", _DEDUP.format(c="doc_id, text, lang, source, n_chars", d="", w="n > 1"))
def dup_members(spark, sf_dir):
    return dedup.duplicate_members(table(spark, sf_dir, "documents"), ["text", "lang"])


@suite.add(
    "dup_members_lines",
    """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
    QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1""",
)
def dup_members_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return dedup.duplicate_members(lines, ["l_orderkey", "l_linenumber"])


@suite.add(
    "concat_rows",
    """SELECT c_name AS name, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer
    UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier""",
)
def concat_rows(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").selectExpr("c_name AS name", "c_acctbal AS acctbal", "c_mktsegment AS segment")
    suppliers = table(spark, sf_dir, "supplier").selectExpr("s_name AS name", "s_acctbal AS acctbal")
    return dedup.concat([customers, suppliers])


@suite.add(
    "symmetric_difference",
    """SELECT o_custkey, o_orderstatus FROM (SELECT o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 100000
      UNION ALL SELECT o_custkey, o_orderstatus FROM orders WHERE o_totalprice < 300000) GROUP BY ALL HAVING count(*) = 1""",
)
def symmetric_difference(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    a = orders.filter("o_totalprice > 100000").select("o_custkey", "o_orderstatus")
    b = orders.filter("o_totalprice < 300000").select("o_custkey", "o_orderstatus")
    return dedup.symmetric_difference(a, b)


_GENDER = "regexp_replace({c}, '" + "|".join(privacy.GENDER_WORDS) + "', '***', 'gi')"


def _plain(c, is_text):
    return _GENDER.format(c=c) if is_text else f"CAST({c} AS VARCHAR)"


def _hits_sql(t, columns):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{k}' AS class, count(*) FILTER (WHERE regexp_matches({_plain(c, is_text)}, '{p}')) AS hits FROM {t}"""
        for c, is_text in columns.items() for k, p in privacy.PATTERNS.items()
    )


def _masked_sql(c, is_text):
    out = _plain(c, is_text)
    for p in privacy.PATTERNS.values():
        out = f"regexp_replace({out}, '{p}', '***', 'g')"
    return out


def _mask_sql(t, key, columns):
    cells = ", ".join(
        f"""CASE WHEN (SELECT bool_or({' OR '.join(f"regexp_matches({_plain(c, is_text)}, '{privacy.PATTERNS[k]}')" for k in privacy.TRIGGERS)}) FROM {t})
        THEN {_masked_sql(c, is_text)} ELSE {_plain(c, is_text)} END AS {c}"""
        for c, is_text in columns.items()
    )
    return f"SELECT {key}, {cells} FROM {t}"


# SQL knows ASCII word characters only, so both sides use them here; the default is all scripts.
_DOC = {"text": True, "source": True, "n_chars": False}
_TALK = {"turn": False, "role": True, "text": True}


@suite.add("detect_pii", _hits_sql("documents", _DOC))
def detect_pii(spark, sf_dir):
    return privacy.detect_personal_data(table(spark, sf_dir, "documents"), list(_DOC), unicode=False)


@suite.add("detect_pii_conversations", _hits_sql("conversations", _TALK))
def detect_pii_conversations(spark, sf_dir):
    return privacy.detect_personal_data(table(spark, sf_dir, "conversations"), list(_TALK), unicode=False)


@suite.add("mask_pii", _mask_sql("documents", "doc_id", _DOC))
def mask_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", *_DOC)
    return privacy.mask_personal_data(docs, list(_DOC), unicode=False)


@suite.add("mask_pii_conversations", _mask_sql("conversations", "conv_id", _TALK))
def mask_pii_conversations(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations").select("conv_id", *_TALK)
    return privacy.mask_personal_data(talk, list(_TALK), unicode=False)


@suite.add("mask_pii_unicode")
def mask_pii_unicode(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", *_DOC)
    return privacy.mask_personal_data(docs, list(_DOC))


_PEOPLE = """(SELECT c_custkey, CASE WHEN c_nationkey = 7 THEN NULL ELSE c_mktsegment END AS c_mktsegment,
    c_name, CASE WHEN c_nationkey = 3 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer)"""


def _people(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.expr("CASE WHEN c_nationkey = 7 THEN NULL ELSE c_mktsegment END").alias("c_mktsegment"),
        "c_name",
        F.expr("CASE WHEN c_nationkey = 3 THEN NULL ELSE c_acctbal END").alias("c_acctbal"),
    )


_FILLED = f"""(SELECT c_custkey, coalesce(c_mktsegment, {_MODE.format(c='c_mktsegment', t=_PEOPLE)}) AS c_mktsegment,
    c_name, coalesce(c_acctbal, 0) AS c_acctbal FROM {_PEOPLE})"""


@suite.add(
    "anonymise",
    f"""SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS c_mktsegment,
    dense_rank() OVER (ORDER BY c_name) - 1 AS c_name,
    round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS c_acctbal FROM {_FILLED}""",
)
def anonymise(spark, sf_dir):
    coded, _ = privacy.anonymise(_people(spark, sf_dir), ["c_mktsegment", "c_name", "c_acctbal"])
    return rounded(coded)


@suite.add(
    "anonymise_mapping",
    f"""SELECT 'c_mktsegment' AS "column", c_mktsegment AS "value", row_number() OVER (ORDER BY c_mktsegment) - 1 AS code
    FROM (SELECT DISTINCT c_mktsegment FROM {_FILLED})
    UNION ALL SELECT 'c_name', c_name, row_number() OVER (ORDER BY c_name) - 1 FROM (SELECT DISTINCT c_name FROM {_FILLED})""",
)
def anonymise_mapping(spark, sf_dir):
    _, mapping = privacy.anonymise(_people(spark, sf_dir), ["c_mktsegment", "c_name", "c_acctbal"])
    return mapping
