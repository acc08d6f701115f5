"""Source, sink and streaming queries: tables are written, read back and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import mdm, quality
from ..plans.durable import checkpoint_root
from ..sources import readers, validate, writers
from ..streaming import arrivals, windowed
from . import Suite, table
from .rounding import rounded

suite = Suite()


def _fresh(spark) -> str:
    return f"{checkpoint_root(spark)}/sparkqual-io/{uuid.uuid4().hex}"


_PARTS = "SELECT p_partkey, p_name, p_size, p_retailprice FROM part"


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")


@suite.add("io_csv", _PARTS)
def io_csv(spark, sf_dir):
    path = _fresh(spark) + ".csv"
    writers.write_csv(_parts(spark, sf_dir), path)
    if readers.find_delimiter(spark, path) != ",":
        raise ValueError("comma expected")
    return rounded(readers.read_path(spark, path), 2)


@suite.add("io_parquet", _PARTS)
def io_parquet(spark, sf_dir):
    path = _fresh(spark) + ".parquet"
    writers.write_parquet(_parts(spark, sf_dir), path)
    return rounded(readers.read_path(spark, path), 2)


@suite.add("io_json_lines", _PARTS)
def io_json_lines(spark, sf_dir):
    path = _fresh(spark)
    parts = _parts(spark, sf_dir)
    parts.write.json(path)
    return rounded(readers.read_json(spark, path, schema=parts.schema, lines=True), 2)


@suite.add("io_xml", _PARTS)
def io_xml(spark, sf_dir):
    path = _fresh(spark) + ".xml"
    parts = _parts(spark, sf_dir)
    parts.write.option("rowTag", "part").xml(path)
    return rounded(readers.read_path(spark, path, row_tag="part", schema=parts.schema), 2)


@suite.add("io_reference", "SELECT s_suppkey, NULLIF(s_name, 'Supplier#000000003') AS s_name FROM supplier")
def io_reference(spark, sf_dir):
    path = _fresh(spark) + ".csv"
    named = "CASE WHEN s_name = 'Supplier#000000003' THEN 'None' ELSE s_name END AS s_name"
    writers.write_csv(table(spark, sf_dir, "supplier").selectExpr("s_suppkey", named), path)
    return rounded(readers.read_reference(spark, [{"name": "suppliers", "path": path}], "suppliers"))


@suite.add(
    "io_rows_to_json",
    """SELECT c_custkey, '{"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || ',"c_mktsegment":'
    || CASE WHEN c_nationkey = 7 THEN 'null' ELSE '"' || c_mktsegment || '"' END || '}' AS record FROM customer""",
)
def io_rows_to_json(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "c_name", "c_nationkey", "CASE WHEN c_nationkey = 7 THEN NULL ELSE c_mktsegment END AS c_mktsegment"
    )
    return writers.rows_to_json(customers, "c_custkey")


@suite.add(
    "io_row_ids",
    """SELECT count(*) AS rows, CAST(0 AS BIGINT) AS first, count(*) - 1 AS last, count(*) AS ids FROM lineitem""",
)
def io_row_ids(spark, sf_dir):
    numbered = readers.with_row_id(table(spark, sf_dir, "lineitem"))
    return numbered.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("row_id").alias("first"),
        F.max("row_id").alias("last"),
        F.count_distinct("row_id").alias("ids"),
    )


@suite.add(
    "io_time_coercion",
    """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END AS "Date" FROM orders""",
)
def io_time_coercion(spark, sf_dir):
    texts = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        """CASE o_orderstatus WHEN 'O' THEN date_format(o_orderdate, 'dd/MM/yyyy') WHEN 'F' THEN date_format(o_orderdate, 'dd-MM-yyyy')
           ELSE 'unknown' END AS Date""",
    )
    return readers.coerce_times(texts).withColumn("Date", F.col("Date").cast("timestamp_ntz"))


@suite.add("io_empty_columns", """SELECT 'nothing' AS "column" FROM (SELECT count(*) FROM orders)""")
def io_empty_columns(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("nothing", F.lit(None).cast("string"))
    return validate.empty_columns(orders)


@suite.add(
    "io_preview_top",
    """SELECT "column", "value", n, rank, round_even(100.0 * n / (SELECT count(*) FROM customer), 4) AS share FROM (
      SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, "value") AS rank FROM (
        SELECT 'c_nationkey' AS "column", CAST(c_nationkey AS VARCHAR) AS "value", count(*) AS n FROM customer GROUP BY ALL
        UNION ALL SELECT 'c_mktsegment', c_mktsegment, count(*) FROM customer GROUP BY ALL)) WHERE rank <= 3""",
)
def io_preview_top(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment")
    return rounded(readers.preview(customers)["top"])


_RULES = [{"column": "o_totalprice", "rules": [
    {"rule": "Value", "value": "100000", "operator": "greaterthan", "dimension": "Accuracy"}]}]


@suite.add(
    "io_violations",
    """SELECT o_orderkey, 'o_totalprice:Value:0' AS rule_id, 'o_totalprice' AS "column", o_orderstatus AS key_value,
    'o_orderstatus' AS key_column, 'L1' AS launch_id FROM orders WHERE o_totalprice <= 100000""",
)
def io_violations(spark, sf_dir):
    path = _fresh(spark)
    found = quality.violations(table(spark, sf_dir, "orders"), _RULES, ["o_orderkey", "o_orderstatus"])
    keyed = found.drop("observed").withColumnRenamed("o_orderstatus", "key_value")
    writers.append_violations(keyed.withColumn("key_column", F.lit("o_orderstatus")), path, "L1")
    return spark.read.parquet(path)


@suite.add(
    "io_result_append",
    """SELECT unnest(['L1', 'L2']) AS launch_id, 'o_totalprice' AS "column", 100.0 * count(o_totalprice) / count(*) AS completeness FROM orders""",
)
def io_result_append(spark, sf_dir):
    path = _fresh(spark)
    scores = quality.completeness(table(spark, sf_dir, "orders"), ["o_totalprice"]).drop("nulls")
    writers.append_results(scores, path, "L1")
    writers.append_results(scores, path, "L2")
    return spark.read.parquet(path)


@suite.add("io_profile_cache", """SELECT 'o_custkey' AS "column", CAST(100 AS DOUBLE) AS completeness, CAST(0 AS BIGINT) AS nulls FROM (SELECT count(*) FROM orders)""")
def io_profile_cache(spark, sf_dir):
    source, root = f"{sf_dir.rstrip('/')}/orders.parquet", _fresh(spark)

    def compute():
        return quality.completeness(readers.read_parquet(spark, source), ["o_custkey"])

    writers.cached_result(spark, root, "completeness", source, compute)
    return writers.cached_result(spark, root, "completeness", source, compute)


_EVENT_RULES = [
    {"column": "event_type", "rules": [{"rule": "DataType", "value": "Text", "operator": "Shouldbe"},
                                       {"rule": "MaxLength", "value": "6", "operator": "equalto"}]},
    {"column": "value", "rules": [{"rule": "Value", "value": "200", "operator": "lessthan"}]},
]


@suite.add(
    "stream_scores",
    """SELECT count(*) AS checked, count(*) FILTER (WHERE value >= 200) AS failed, 'value:Value:0' AS rule_id, CAST(0 AS BIGINT) AS batch
    FROM events""",
)
def stream_scores(spark, sf_dir):
    target, schema = _fresh(spark), table(spark, sf_dir, "events").schema
    query = arrivals.score_arrivals(
        spark, sf_dir, schema, lambda batch: quality.rule_scores(batch, _EVENT_RULES[1:]),
        target, _fresh(spark), pathGlobFilter="events.parquet",
    )
    query.awaitTermination()
    return arrivals.stored_scores(spark, target).select("rule_id", "checked", "failed", "batch")


_WINDOWS = """SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS "end",
    count(*) AS rows, round(100.0 * (count(*) + count(CASE WHEN value < 300 THEN value END)) / (2 * count(*)), 6) AS completeness,
    round(100.0 * (count(*) FILTER (WHERE regexp_full_match(event_type, '[\\p{L}\\p{N}]+')) + count(*) FILTER (WHERE length(event_type) <= 6)
      + count(*) FILTER (WHERE value < 200)) / (3 * count(*)), 6) AS validity FROM events GROUP BY 1, 2"""


def _measured(events):
    dirty = events.withColumn("value", F.when(F.col("value") < 300, F.col("value")))
    return windowed.windowed_quality(dirty, "ts", _EVENT_RULES, columns=["event_type", "value"])


@suite.add("windowed_quality", _WINDOWS)
def windowed_quality(spark, sf_dir):
    return rounded(_measured(table(spark, sf_dir, "events")))


@suite.add("stream_windowed_quality", _WINDOWS)
def stream_windowed_quality(spark, sf_dir):
    """All windows of the stream, those still open at its end too."""
    schema, target = table(spark, sf_dir, "events").schema, _fresh(spark)
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    query = windowed.store_windows(_measured(stream), target, _fresh(spark)).trigger(availableNow=True).start()
    query.awaitTermination()
    return rounded(windowed.stored_windows(spark, target))


@suite.add("io_standardise_file", "SELECT s_suppkey, upper(s_name) AS s_name FROM supplier")
def io_standardise_file(spark, sf_dir):
    source, target = _fresh(spark) + ".csv", _fresh(spark) + ".csv"
    writers.write_csv(table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("  "), F.col("s_name")).alias("s_name")), source)
    rules = [{"column": "s_name", "rules": [{"rule": "Format", "operator": "trim"}, {"rule": "Format", "operator": "toUpperCase"}]}]
    mdm.standardise_file(spark, source, target, rules)
    return rounded(readers.read_path(spark, target))


@suite.add(
    "io_upload_checks",
    """SELECT count(*) AS rows, ['column 2 has no name', 'column nothing is empty'] AS problems FROM supplier""",
)
def io_upload_checks(spark, sf_dir):
    upload = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.col("s_name").alias("_c1"), F.lit(None).cast("string").alias("nothing")
    )
    problems = validate.upload_problems(upload)
    return upload.agg(F.count(F.lit(1)).alias("rows"), F.array(*[F.lit(p) for p in problems]).alias("problems"))
