"""Model-based queries: results that depend on the optimiser have no SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learn
from . import Suite, table
from .rounding import rounded

suite = Suite()


_IMPUTE_SQL = """
with base as (
  select l_orderkey, l_linenumber, nullif(l_linestatus, 'O') as s,
    case when l_linenumber = 3 then null else l_quantity end as q,
    case when l_returnflag = 'R' then null else l_extendedprice end as p
  from lineitem
), v0 as (
  select *, coalesce(q, avg(q) over ()) as q0, coalesce(p, avg(p) over ()) as p0 from base
), f1 as (
  select regr_slope(q0, p0) filter (where q is not null) as bq, regr_intercept(q0, p0) filter (where q is not null) as aq,
    regr_slope(p0, q0) filter (where p is not null) as bp, regr_intercept(p0, q0) filter (where p is not null) as ap from v0
), q1 as (select v0.*, f1.*, coalesce(q, aq + bq * p0) as q1 from v0, f1),
v1 as (select l_orderkey, l_linenumber, s, q, p, q1, coalesce(p, ap + bp * q1) as p1 from q1),
f2 as (
  select regr_slope(q1, p1) filter (where q is not null) as bq, regr_intercept(q1, p1) filter (where q is not null) as aq,
    regr_slope(p1, q1) filter (where p is not null) as bp, regr_intercept(p1, q1) filter (where p is not null) as ap from v1
), q2 as (select v1.*, f2.*, coalesce(q, aq + bq * p1) as q2 from v1, f2)
select l_orderkey, l_linenumber, round(q2, 4) as l_quantity, round(coalesce(p, ap + bp * q2), 4) as l_extendedprice,
  coalesce(s, (select mode(s) from base)) as l_linestatus
from q2
"""


@suite.add("iterative_impute", _IMPUTE_SQL)
def iterative_impute(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.expr("CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END").alias("l_quantity"),
        F.expr("CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_extendedprice END").alias("l_extendedprice"),
        F.expr("nullif(l_linestatus, 'O')").alias("l_linestatus"),
    )
    return rounded(learn.iterative_impute(lines, ["l_quantity", "l_extendedprice", "l_linestatus"], rounds=2), 4)


def _documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").select("lang", "source", "n_chars", "quality", "toxic")


@suite.add("model_accuracy")
def model_accuracy(spark, sf_dir):
    return learn.compare_models(_documents(spark, sf_dir), "quality")


@suite.add("feature_importance")
def feature_importance(spark, sf_dir):
    return learn.feature_importance(_documents(spark, sf_dir), "quality", trees=500)


_INPUT = """(SELECT lang, source, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id))"""
_INPUT_FREQUENCY = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS "value", count(*) AS n FROM {_INPUT} GROUP BY {c}"""
    for c in ("lang", "source", "n_chars", "quality", "toxic")
)


@suite.add(
    "predict_top",
    f"""SELECT "column", "value", n, rank, round_even(100.0 * n / (SELECT count(*) FROM {_INPUT}), 4) AS share FROM (
      SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, "value") AS rank
      FROM ({_INPUT_FREQUENCY}) WHERE "value" IS NOT NULL) WHERE rank <= 3""",
)
def predict_top(spark, sf_dir):
    return rounded(learn.predict_top(_documents(spark, sf_dir)))


@suite.add("predict")
def predict(spark, sf_dir):
    return learn.predict(_documents(spark, sf_dir), "quality")
