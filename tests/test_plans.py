"""Shared plan shapes against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkqual.plans import bands, durable, longform, ranks, skew


def test_running_totals_match_cumulative_sum(spark):
    rng = random.Random(3)
    rows = [(k, v, rng.randint(1, 5)) for k in ("a", "b", None) for v in rng.sample(range(1000), 200)]
    counts = spark.createDataFrame(rows, "k string, v int, n bigint")
    got = {(r["k"], r["v"]): (r["before_n"], r["total_n"])
           for r in ranks.running_totals(counts, ["k"], "v", ["n"]).collect()}
    for k in ("a", "b", None):
        before, mine = 0, sorted((v, n) for kk, v, n in rows if kk == k)
        for v, n in mine:
            assert got[k, v] == (before, sum(n for _, n in mine))
            before += n


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_quantiles_interpolate_like_numpy(spark, size):
    rng = np.random.default_rng(size)
    values = np.round(rng.normal(size=size), 1)
    # A third of all rows share one value.
    values[: size // 3] = 0.5
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    probs = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]
    row = ranks.exact_quantiles(df, ["x"], probs).first()
    assert [row[f"p{i}"] for i in range(len(probs))] == pytest.approx(list(np.quantile(values, probs)))
    assert row["distinct"] == len(set(values))


@pytest.mark.parametrize("limit", [2, 300, 1_000_000])
def test_bands_give_exact_quantiles(spark, monkeypatch, limit):
    """Narrow bands, several rounds, hot values, huge ones; a sketch that is wrong costs nothing but time."""
    monkeypatch.setattr(bands, "BAND_ROWS", limit)
    monkeypatch.setattr(bands, "SMALL", 100)
    monkeypatch.setattr(bands, "SAMPLE", 10 * limit)
    rng = np.random.default_rng(limit)
    a = rng.normal(size=3000)
    a[:1000] = 0.25
    b = rng.integers(0, 7, 3000).astype(float)
    b[5] = 1e300
    rows = [(float(x), float(y), int(i), None, float("nan") if i % 3 else 1.5) for i, (x, y) in enumerate(zip(a, b, strict=True))]
    df = spark.createDataFrame([*rows, (None, None, None, None, None)], "`a.b` double, b double, c int, d double, e float")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    want = {"a.b": a, "b": b, "c": np.arange(3000), "e": np.full(1000, 1.5)}

    def check():
        found = {r["column"]: r for r in bands.band_quantiles(df, df.columns, probs).collect()}
        assert set(found) == set(want)
        for name, values in want.items():
            assert found[name]["n"] == len(values)
            assert [found[name][f"p{j}"] for j in range(5)] == pytest.approx(list(np.quantile(values, probs)))

    check()
    monkeypatch.setattr(bands._Band, "ranks", lambda self: (0.9, 0.95))
    check()
    assert bands.band_quantiles(df.limit(0), ["b"], [0.5]).collect() == []


def test_bands_store_nothing(spark, monkeypatch):
    """No table is stored, and only values in bands are sorted."""
    monkeypatch.setattr(bands, "BAND_ROWS", 1000)
    monkeypatch.setattr(durable, "durable", None)
    df = spark.range(0, 200_000, 1, 4).select(F.xxhash64("id").cast("double").alias("x"))
    found = bands.band_quantiles(df, ["x"], [0.5])
    assert found.first()["p0"] == df.agg(F.expr("percentile(x, 0.5)")).first()[0]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Filter" in plan and "Window" in plan


def test_dense_codes_are_sorted_positions(spark):
    df = spark.createDataFrame([(w,) for w in "pear apple fig apple kiwi".split()] + [(None,)], "w string")
    got = {r["value"]: r["code"] for r in ranks.dense_codes(df, ["w"]).collect()}
    assert got == {"apple": 0, "fig": 1, "kiwi": 2, "pear": 3}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_unique_equals_plain_join_under_hot_keys(spark, how):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
        "id",
    ).unionByName(spark.range(5).select(F.lit(None).cast("string").alias("k"), "id")).repartition(7)
    keyed = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("k IS NULL OR k NOT LIKE 'k4%'")
    got = skew.join_unique(rows, keyed, ["k"], how, "n", hot_rows=100)
    other = keyed.withColumnRenamed("k", "kk")
    want = rows.join(other, F.col("k").eqNullSafe(F.col("kk")), how).drop("kk")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_hot_list_is_bounded(spark):
    """No more keys than fit the least share, and tied keys are all on the list or none is."""
    even = spark.range(int(2 / skew.HOT_SHARE)).select("id", F.lit(10).alias("n"))
    assert skew.hot_hashes(even, ["id"], "n", hot_rows=1).count() == 0
    tied = spark.range(500).select("id", F.lit(10).alias("n"))
    assert skew.hot_hashes(tied, ["id"], "n", hot_rows=1).count() == 500


def test_tied_hot_keys_lose_no_rows(spark):
    rows = spark.range(3000).selectExpr("id % 30 AS k", "id").repartition(6)
    keyed = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert skew.join_unique(rows, keyed, ["k"], "inner", "n", hot_rows=7).count() == 3000


def test_large_whole_numbers_stay_distinct(spark):
    df = spark.createDataFrame([(2**60,), (2**60 + 1,)], "id bigint")
    assert ranks.exact_quantiles(df, ["id"], [0.5]).first()["distinct"] == 2


def test_column_names_with_dots_and_blanks(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y")], "`a b` int, `c.d` string")
    got = {(r["column"], r["value"]): r["n"] for r in longform.value_counts(df, df.columns).collect()}
    assert got == {("a b", "1"): 2, ("c.d", "x"): 1, ("c.d", "y"): 1}


def test_durable_uses_the_configured_folder(spark):
    path = durable.durable(spark.range(3)).inputFiles()[0]
    assert spark.conf.get("spark.checkpoint.dir") in path


def test_stored_tables_can_be_removed(spark):
    from pathlib import Path

    from sparkqual.plans import durable as stored

    table = stored.durable(spark.range(3))
    assert table.count() == 3
    folder = Path(stored._folder(spark).removeprefix("file:"))
    assert len(list(folder.iterdir())) > 0
    stored.remove_stored(spark)
    assert not folder.exists()
