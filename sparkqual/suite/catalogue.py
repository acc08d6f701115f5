"""Catalogue, lineage, upload and report queries.

The tables have no catalogue, so suppliers stand for its entries, customers and orders for
columns and scores, and events for uploads and lineage events.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, reports
from . import Suite, table
from .rounding import rounded

suite = Suite()

_ENTRIES = """(SELECT s_suppkey AS id, CASE WHEN s_nationkey < 12 THEN 'Field_' ELSE 'FIELD_' END || s_suppkey AS "Column",
    'Term ' || s_nationkey AS "BusinessTerm", CASE WHEN s_acctbal < 0 THEN 'Risk' ELSE 'Sales' END AS "DataDomain" FROM supplier)"""
_ASKED = """(SELECT DISTINCT CASE WHEN c_nationkey < 5 THEN 'field_' ELSE 'Field_' END || (c_custkey // 2) AS "column" FROM customer)"""


def _entries(spark, sf_dir):
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS id",
        "CASE WHEN s_nationkey < 12 THEN 'Field_' ELSE 'FIELD_' END || s_suppkey AS Column",
        "'Term ' || s_nationkey AS BusinessTerm",
        "CASE WHEN s_acctbal < 0 THEN 'Risk' ELSE 'Sales' END AS DataDomain",
    )


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr(
        "CASE WHEN c_nationkey < 5 THEN 'field_' ELSE 'Field_' END || (c_custkey div 2) AS column"
    )


@suite.add(
    "catalogue_match",
    f"""SELECT a."column", e."Column" AS entry, CASE WHEN a."column" = e."Column" THEN 100 ELSE 80 END::BIGINT AS confidence,
    e.id, "BusinessTerm", "DataDomain" FROM {_ASKED} a JOIN {_ENTRIES} e ON lower(a."column") = lower(e."Column")""",
)
def catalogue_match(spark, sf_dir):
    found = catalog.match_columns(_asked(spark, sf_dir), _entries(spark, sf_dir))
    return found.select("column", "entry", "confidence", "id", "BusinessTerm", "DataDomain")


_EVENTS = """(SELECT event_id, user_id, ts, CASE event_type WHEN 'click' THEN 'File Received from user'
      WHEN 'view' THEN 'File storage read' WHEN 'purchase' THEN 'Cleaning Completed- IMPUTE FOR Field_3'
      WHEN 'error' THEN 'Cleaning Completed- IMPUTE FOR Other' ELSE 'report built' END AS action,
    ['Field_' || (user_id // 10), 'Field_3'] AS available_columns FROM events)"""


def _lineage(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "user_id",
        "ts",
        """CASE event_type WHEN 'click' THEN 'File Received from user' WHEN 'view' THEN 'File storage read'
           WHEN 'purchase' THEN 'Cleaning Completed- IMPUTE FOR Field_3' WHEN 'error' THEN 'Cleaning Completed- IMPUTE FOR Other'
           ELSE 'report built' END AS action""",
        "array('Field_' || (user_id div 10), 'Field_3') AS available_columns",
    )


@suite.add(
    "lineage_of_column",
    f"""SELECT event_id, action, step, kind FROM (SELECT *,
      CASE WHEN contains(action, 'File Received') THEN 'File Storage' WHEN contains(action, 'File storage') THEN 'Extract'
           WHEN contains(action, 'Cleaning Completed-') AND contains(action, 'Field_3') THEN 'Cleaning Process'
           WHEN contains(action, 'report ') THEN 'Report' END AS step,
      CASE WHEN contains(action, 'File Received') THEN 'File' WHEN contains(action, 'File storage') THEN 'Dataset'
           WHEN contains(action, 'Cleaning Completed-') AND contains(action, 'Field_3') THEN 'Dataset'
           WHEN contains(action, 'report ') THEN 'Report' END AS kind
      FROM {_EVENTS} WHERE list_contains(available_columns, 'Field_3')) WHERE step IS NOT NULL""",
)
def lineage_of_column(spark, sf_dir):
    found = catalog.lineage_of_column(_lineage(spark, sf_dir), "Field_3")
    return found.select("event_id", "action", "step", "kind")


_SCORES = "(SELECT 'Field_' || (o_custkey // 20) AS \"column\", o_totalprice AS overall FROM orders)"


@suite.add(
    "catalogue_quality",
    f"""SELECT id, "Column", round(quality, 4) AS quality, coalesce(n, 0) AS lineage_events FROM {_ENTRIES} e
    LEFT JOIN (SELECT "column" AS c, avg(overall) AS quality FROM {_SCORES} GROUP BY 1) q ON q.c = e."Column"
    LEFT JOIN (SELECT u AS c, count(*) AS n FROM (SELECT unnest(available_columns) AS u FROM {_EVENTS}) GROUP BY 1) l ON l.c = e."Column" """,
)
def catalogue_quality(spark, sf_dir):
    scores = table(spark, sf_dir, "orders").selectExpr("'Field_' || (o_custkey div 20) AS column", "o_totalprice AS overall")
    found = catalog.catalogue_with_quality(_entries(spark, sf_dir), scores, _lineage(spark, sf_dir))
    return rounded(found.select("id", "Column", "quality", "lineage_events"), 4)


@suite.add("catalogue_domains", f"""SELECT id, "Column" FROM {_ENTRIES} WHERE "DataDomain" IN ('Risk', 'HR')""")
def catalogue_domains(spark, sf_dir):
    return catalog.catalogue_for_domains(_entries(spark, sf_dir), ["Risk", "HR"]).select("id", "Column")


_TERMS = """(SELECT 'Term ' || c_nationkey AS "BusinessTerm", CASE WHEN c_acctbal < 5000 THEN 'Sales' ELSE 'Risk' END AS "DataDomain" FROM customer WHERE c_mktsegment = 'BUILDING')"""


@suite.add(
    "catalogue_terms",
    f"""SELECT id, "Column" FROM {_ENTRIES} WHERE ("BusinessTerm", "DataDomain") IN (SELECT ("BusinessTerm", "DataDomain") FROM {_TERMS})""",
)
def catalogue_terms(spark, sf_dir):
    terms = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").selectExpr(
        "'Term ' || c_nationkey AS BusinessTerm", "CASE WHEN c_acctbal < 5000 THEN 'Sales' ELSE 'Risk' END AS DataDomain"
    )
    return catalog.catalogue_for_terms(_entries(spark, sf_dir), terms).select("id", "Column")


@suite.add(
    "catalogue_upsert",
    f"""SELECT id, "Column", "BusinessTerm", "DataDomain" FROM {_ENTRIES} WHERE id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)
    UNION ALL SELECT c_custkey, c_name, 'Edited', 'CRM' FROM customer WHERE c_acctbal > 5000""",
)
def catalogue_upsert(spark, sf_dir):
    entries = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").selectExpr(
        "c_custkey AS id", "c_name AS Column", "'Edited' AS BusinessTerm", "'CRM' AS DataDomain"
    )
    return catalog.upsert(_entries(spark, sf_dir), entries)


@suite.add(
    "vendor_sources",
    """SELECT s_nationkey AS vendor_type, s_suppkey AS source_id, s_name AS path, r_regionkey AS rule_id
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def vendor_sources(spark, sf_dir):
    sources = table(spark, sf_dir, "supplier").selectExpr("s_nationkey AS vendor_type", "s_suppkey AS source_id", "s_name AS path")
    rules = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS vendor_type", "n_regionkey AS rule_id")
    return rounded(catalog.sources_by_vendor(sources, rules))


@suite.add(
    "latest_upload",
    """SELECT user_id AS source_id, CAST(ts AS DATE) AS day, max(event_id) AS upload_id, arg_max(event_type, event_id) AS file
    FROM events GROUP BY 1, 2""",
)
def latest_upload(spark, sf_dir):
    uploads = table(spark, sf_dir, "events").selectExpr(
        "user_id AS source_id", "event_id AS upload_id", "ts AS upload_ts", "event_type AS file"
    )
    return catalog.latest_uploads(uploads).select("source_id", "day", "upload_id", "file")


@suite.add("upload_days", "SELECT DISTINCT CAST(ts AS DATE) AS day FROM events")
def upload_days(spark, sf_dir):
    return catalog.upload_days(table(spark, sf_dir, "events"), "ts")


_HISTORY = "(SELECT user_id AS source_id, 'K' AS multi_source_key, ts AS upload_ts, event_id AS upload_id FROM events WHERE event_type IN ('click', 'view'))"
_ARRIVALS = """(SELECT user_id AS source_id, CASE WHEN value > 400 THEN 'L' ELSE 'K' END AS multi_source_key, ts AS upload_ts, event_id AS upload_id,
    CASE WHEN value < 100 THEN 'correction' WHEN value < 150 THEN 'cleansedsource' END AS reason FROM events WHERE event_type NOT IN ('click', 'view'))"""
_SLOT = "source_id, multi_source_key, CAST(upload_ts AS DATE)"
_ACCEPTED = f"""(SELECT * EXCLUDE (kind, place, latest, held, replaced),
      CASE kind WHEN 'plain' THEN NOT held AND NOT replaced AND place = 1 WHEN 'correction' THEN latest = 1 ELSE true END AS accepted,
      held AND kind = 'correction' AND latest = 1 AS replaces
    FROM (SELECT *, bool_or(kind = 'correction') OVER (PARTITION BY {_SLOT}) AS replaced,
      row_number() OVER (PARTITION BY {_SLOT}, kind ORDER BY upload_ts, upload_id) AS place,
      row_number() OVER (PARTITION BY {_SLOT}, kind ORDER BY upload_ts DESC, upload_id DESC) AS latest,
      ({_SLOT}) IN (SELECT ({_SLOT}) FROM {_HISTORY}) AS held
      FROM (SELECT *, coalesce(reason, 'plain') AS kind FROM {_ARRIVALS})))"""


def _uploads(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    history = events.filter("event_type IN ('click', 'view')").selectExpr(
        "user_id AS source_id", "'K' AS multi_source_key", "ts AS upload_ts", "event_id AS upload_id"
    )
    arrivals = events.filter("event_type NOT IN ('click', 'view')").selectExpr(
        "user_id AS source_id", "CASE WHEN value > 400 THEN 'L' ELSE 'K' END AS multi_source_key", "ts AS upload_ts",
        "event_id AS upload_id", "CASE WHEN value < 100 THEN 'correction' WHEN value < 150 THEN 'cleansedsource' END AS reason",
    )
    return history, catalog.accept_uploads(history, arrivals)


@suite.add("freshness", f"SELECT upload_id, accepted, replaces FROM {_ACCEPTED}")
def freshness(spark, sf_dir):
    return _uploads(spark, sf_dir)[1].select("upload_id", "accepted", "replaces")


@suite.add(
    "freshness_history",
    f"""SELECT source_id, multi_source_key, upload_id FROM {_HISTORY} h WHERE NOT EXISTS (SELECT 1 FROM {_ACCEPTED} a WHERE replaces
      AND a.source_id = h.source_id AND a.multi_source_key = h.multi_source_key AND CAST(a.upload_ts AS DATE) = CAST(h.upload_ts AS DATE))
    UNION ALL SELECT source_id, multi_source_key, upload_id FROM {_ACCEPTED} WHERE accepted""",
)
def freshness_history(spark, sf_dir):
    history, accepted = _uploads(spark, sf_dir)
    return catalog.apply_uploads(history, accepted).select("source_id", "multi_source_key", "upload_id")


@suite.add(
    "key_values_match",
    """SELECT 'event_type' AS "column", count(*) > 0 AND min(event_type) = 'click' AND max(event_type) = 'click' AS fits FROM events
    UNION ALL SELECT 'region', count(*) > 0 AND min(user_id * 0) = 0 AND max(user_id * 0) = 0 FROM events""",
)
def key_values_match(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("region", F.col("user_id") * 0)
    found = {"event_type": "click", "region": 0}
    rows = [
        spark.range(1).select(F.lit(c).alias("column"), catalog.key_values_match(events, c, v).alias("fits"))
        for c, v in found.items()
    ]
    return rows[0].unionByName(rows[1])


_PARTS = "(SELECT p_size, p_retailprice, CASE WHEN p_size > 30 THEN 'n/a' ELSE CAST(p_size AS VARCHAR) END AS p_note, p_brand FROM part)"


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr(
        "p_size", "p_retailprice", "CASE WHEN p_size > 30 THEN 'n/a' ELSE CAST(p_size AS STRING) END AS p_note", "p_brand"
    )


def _stats_sql(c):
    v = f"coalesce(try_cast({c} AS DOUBLE), 0)"
    return f"""SELECT '{c}' AS "column", round(avg({v}), 6) AS average, round(avg({v}), 6) AS mean, round(median({v}), 6) AS median,
    min({v}) AS minimum, max({v}) AS maximum FROM {_PARTS}"""


_STATS = " UNION ALL ".join(_stats_sql(c) for c in ("p_size", "p_retailprice", "p_note"))


@suite.add("report_values", _STATS)
def report_values(spark, sf_dir):
    return rounded(reports.value_statistics(_parts(spark, sf_dir), ["p_size", "p_retailprice", "p_note"]))


_REPORT = f"""SELECT 'Price' AS term, "column", 'ValueStatistics' AS statistic, item, "value"
    FROM (UNPIVOT ({_stats_sql('p_retailprice')}) ON average, mean, median, minimum, maximum INTO NAME item VALUE "value")
    UNION ALL SELECT 'Brand', 'p_brand', 'LengthStatistics', item, "value" FROM (UNPIVOT (
      SELECT CAST(min(length(p_brand)) AS DOUBLE) AS min_length, CAST(max(length(p_brand)) AS DOUBLE) AS max_length,
      round(avg(length(p_brand)), 6) AS mean_length, CAST(median(length(p_brand)) AS DOUBLE) AS median_length FROM part)
      ON min_length, max_length, mean_length, median_length INTO NAME item VALUE "value")
    UNION ALL SELECT 'Brand', 'p_brand', 'Frequency', p_brand, n FROM (
      SELECT p_brand, CAST(count(*) AS DOUBLE) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS r FROM part GROUP BY 1) WHERE r <= 15
    UNION ALL SELECT 'Size', 'p_size', 'Outliers', item, "value" FROM (UNPIVOT (
      SELECT CAST(o AS DOUBLE) AS outliers, round(100.0 * o / n, 6) AS outlier_pct, round(100.0 * (n - o) / n, 6) AS normal_pct FROM (
        SELECT count(*) AS n, count(*) FILTER (WHERE p_size > hi OR p_size < lo) AS o FROM part,
          (SELECT avg(p_size) + 3 * stddev_samp(p_size) AS hi, avg(p_size) - 3 * stddev_samp(p_size) AS lo FROM part)))
      ON outliers, outlier_pct, normal_pct INTO NAME item VALUE "value")"""


@suite.add("report_by_term", _REPORT)
def report_by_term(spark, sf_dir):
    terms = {"Price": "p_retailprice", "Brand": "p_brand", "Size": "p_size"}
    rules = {"Price": ["ValueStatistics"], "Brand": ["LengthStatistics", "Frequency"], "Size": ["Outliers"]}
    return rounded(reports.report(_parts(spark, sf_dir), terms, rules))


@suite.add(
    "report_proposals",
    """SELECT 'l_quantity' AS "column", 'Volume' AS "BusinessTerm", unnest(['ValueStatistics', 'LengthStatistics', 'Outliers']) AS statistic
    FROM (SELECT count(*) FROM lineitem)
    UNION ALL SELECT 'l_returnflag', 'Returns', unnest(['LengthStatistics', 'Frequency']) FROM (SELECT count(*) FROM lineitem)""",
)
def report_proposals(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_quantity", "l_returnflag", "l_tax")
    known = spark.createDataFrame(
        [("L_QUANTITY", "Volume", "Sales"), ("l_returnflag", "Returns", "Sales"), ("l_tax", "Tax", "Finance")],
        "Column string, BusinessTerm string, DataDomain string",
    )
    terms = spark.createDataFrame([("Volume", "Sales"), ("Returns", "Sales")], "BusinessTerm string, DataDomain string")
    return reports.proposals_for_terms(lines, known, terms)


@suite.add(
    "lineage_append",
    f"""SELECT action, count(*) AS events, max(len(available_columns)) AS columns FROM (
      SELECT action, available_columns FROM {_EVENTS}
      UNION ALL SELECT 'report built', ['o_orderkey', 'o_custkey', 'o_orderstatus'] FROM (SELECT count(*) FROM orders)) GROUP BY 1""",
)
def lineage_append(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    event = catalog.lineage_event(orders, "reports", "report built", source_id="S1")
    log = _lineage(spark, sf_dir).select("action", "available_columns").unionByName(event.select("action", "available_columns"))
    return log.groupBy("action").agg(
        F.count(F.lit(1)).alias("events"), F.max(F.size("available_columns")).cast("bigint").alias("columns")
    )
