"""Operators on small literal frames; results SQL cannot show."""

from __future__ import annotations

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkqual.operators import (
    association, catalog, classify, clean, dedup, frequency, learn, mdm, privacy, profile, quality, reports, suggest,
)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def tau_b(x, y):
    diff = tx = ty = 0
    pairs = list(itertools.combinations(range(len(x)), 2))
    for i, j in pairs:
        a, b = (x[i] > x[j]) - (x[i] < x[j]), (y[i] > y[j]) - (y[i] < y[j])
        diff, tx, ty = diff + a * b, tx + (a == 0), ty + (b == 0)
    return diff / math.sqrt((len(pairs) - tx) * (len(pairs) - ty))


@pytest.mark.parametrize("seed, spread", [(1, 5), (2, 1000), (3, 40)])
def test_kendall_matches_all_pairs(spark, seed, spread):
    rng = random.Random(seed)
    # A third of the rows share one pair of values.
    data = [(7, 7) if i % 3 == 0 else (rng.randint(0, spread), rng.randint(0, spread)) for i in range(90)]
    df = spark.createDataFrame(data, "x int, y int")
    got = {(r[0], r[1]): r[2] for r in association.correlation(df, ["x", "y"], "kendall").collect()}
    assert got["x", "y"] == pytest.approx(tau_b(*zip(*data)))
    assert got["x", "x"] == pytest.approx(1.0)


def test_correlation_of_constant_and_gappy_columns(spark):
    data = [(float(i), 3.0, None if i % 4 == 0 else float(i * i)) for i in range(20)]
    df = spark.createDataFrame(data, "a double, c double, g double")
    for method in ("pearson", "spearman", "kendall"):
        got = {(r[0], r[1]): r[2] for r in association.correlation(df, method=method).collect()}
        assert len(got) == 9
        assert got["c", "c"] == got["a", "c"] == got["c", "g"] == 0.0
        assert got["a", "a"] == pytest.approx(1.0)
    assert got["a", "g"] == pytest.approx(1.0)


def test_correlation_without_numbers_is_an_error(spark):
    with pytest.raises(ValueError):
        association.correlation(spark.createDataFrame([("a",)], "s string"))


def test_theils_u_range_and_direction(spark):
    data = [("a", "x"), ("b", "x"), ("c", "y"), ("d", "y")] * 5
    df = spark.createDataFrame(data, "fine string, coarse string")
    u = {(r[0], r[1]): r[2] for r in association.theils_u(df).collect()}
    assert u["fine", "coarse"] == pytest.approx(1.0)  # fine tells coarse
    assert u["coarse", "fine"] == pytest.approx(0.5)
    assert all(0 <= v <= 1 + 1e-9 for v in u.values())


def test_cramers_v_is_symmetric_and_corrects_two_by_two(spark):
    data = [("a", "x")] * 8 + [("a", "y")] * 2 + [("b", "x")] * 3 + [("b", "y")] * 7
    df = spark.createDataFrame(data, "p string, q string")
    v = {(r[0], r[1]): r[2] for r in association.cramers_v(df, bias_correction=False).collect()}
    assert v["p", "q"] == v["q", "p"]
    # |o - e| = 2.5 in every cell, moved by 0.5
    chi2 = sum(2.0**2 / e for e in (5.5, 4.5, 5.5, 4.5))
    assert v["p", "q"] == pytest.approx(math.sqrt(chi2 / 20))


def test_missing_strategies(spark):
    df = spark.createDataFrame([("a", "x"), (None, "y"), ("b", "x")], "p string, q string")
    assert association.handle_missing(df, ["p", "q"], "drop_samples")[0].count() == 2
    assert association.handle_missing(df, ["p", "q"], "drop_features")[1] == ["q"]
    filled, _ = association.handle_missing(df, ["p", "q"], "replace", "?")
    assert rows(filled.select("p")) == [("?",), ("a",), ("b",)]
    with pytest.raises(ValueError):
        association.handle_missing(df, ["p"], "guess")


def test_top_correlated_leaves_out_flat_lists(spark):
    matrix = spark.createDataFrame(
        [("a", "b", 0.9), ("a", "c", -0.5), ("b", "a", 0.9), ("b", "c", 0.9), ("c", "a", -0.5), ("c", "b", 0.9)],
        "column_i string, column_j string, value double",
    )
    got = rows(association.top_correlated(matrix))
    assert got == [("a", "negative", 1, "c", -0.5), ("a", "positive", 1, "b", 0.9),
                   ("c", "negative", 1, "a", -0.5), ("c", "positive", 1, "b", 0.9)]


PASSENGERS = [
    (892.0, "Kelly, Mr. James", "male", 34.5, "330911", None, "Q"),
    (893.0, "Wilkes, Mrs. James", "female", 47.0, "363272", None, "S"),
    (894.0, "Myles, Mr. Thomas", "male", None, "A/5 240276", "B45", "Q"),
    (895.0, "Wirz, Mr. Albert", "male", 27.0, "330911", "", "S"),
]
PASSENGER = "PassengerId double, Name string, Sex string, Age double, Ticket string, Cabin string, Embarked string"


def test_profile_document_has_every_part(spark):
    df = spark.createDataFrame([(*p, dt.date(1912, 4, 10)) for p in PASSENGERS], PASSENGER + ", Date date")
    parts = profile.profile_document(df)
    assert set(parts) == {"table", "columns", "frequency", "top_shares", "text", "masks", "patterns", "times",
                          "outliers", "correlations"}
    table = parts["table"].first()
    assert (table["row_count"], table["duplicate_rows"], table["missing_cells"]) == (4, 0, 4)
    columns = {r["column"]: r for r in parts["columns"].collect()}
    assert columns["Age"]["missing"] == 1 and columns["Age"]["median"] == 34.5 and columns["Age"]["distinct"] == 3
    assert columns["Cabin"]["missing"] == 3
    assert parts["times"].first()["first"] == "10/04/1912"
    patterns = {(r["column"], r["pattern"]): r["n"] for r in parts["patterns"].collect()}
    assert patterns["Name", "W-W"] == 4


def test_profiles_of_empty_and_all_null_tables(spark):
    empty = spark.createDataFrame([], "a int, s string")
    assert profile.table_counts(empty).first()["row_count"] == 0
    got = {r["column"]: r for r in profile.scalar_profile(empty).collect()}
    assert got["a"]["n"] == 0 and got["a"]["distinct"] == 0 and got["a"]["median"] is None
    nulls = spark.createDataFrame([(None, None)], "a int, s string")
    got = {r["column"]: r for r in profile.scalar_profile(nulls).collect()}
    assert got["s"]["missing"] == 1 and got["s"]["distinct"] == 0
    assert profile.outliers(nulls).count() == 0


def test_frequency_counts_nulls_and_orders_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("a",), ("b",), ("c",)], "s string")
    assert rows(frequency.value_frequency(df)) == [("s", "a", 2), ("s", "b", 2), ("s", "c", 1), ("s", None, 1)]
    assert [tuple(r) for r in frequency.by_frequency(frequency.value_frequency(df)).collect()][:2] == [
        ("s", "a", 2), ("s", "b", 2)]
    assert [r["value"] for r in frequency.top_values(df, k=2).orderBy("rank").collect()] == ["a", "b"]
    assert {r["value"]: r["share"] for r in frequency.top_shares(df).collect()}["c"] == 16.6667


def test_columns_without_letters_have_no_word_patterns(spark):
    df = spark.createDataFrame([("12 3", "x y"), ("4", "z")], "digits string, words string")
    assert {r["column"] for r in frequency.word_distribution(df).collect()} == {"words"}
    assert {r["column"] for r in frequency.length_distribution(df).collect()} == {"words"}


def test_rules_pass_plus_fail_is_all(spark):
    df = spark.createDataFrame(PASSENGERS, PASSENGER)
    found = suggest.default_rules(df)
    scores = quality.rule_scores(df, suggest.as_ruleset(found)).collect()
    assert scores and all(0 <= r["failed"] <= r["checked"] <= 4 for r in scores)
    listed = quality.violations(df, suggest.as_ruleset(found), ["PassengerId"]).groupBy("rule_id").count().collect()
    assert {r["rule_id"]: r["count"] for r in listed} == {r["rule_id"]: r["failed"] for r in scores if r["failed"]}


def test_scorecard_keeps_the_null_key(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), (None, 2), ("b", None)], "k string, v int")
    card = {r["key_value"]: r for r in quality.group_scorecard(df, ["k"], [{"column": "v", "rules": []}]).collect()}
    assert card["a"]["Uniqueness"] == 50.0 and card["b"]["Completeness"] == 50.0 and card[None]["rows"] == 1
    assert card["a"]["Integrity"] is None and card["a"]["Validity"] == 100.0


def test_recipients_by_category_and_owner(spark):
    alerts = spark.createDataFrame([("A", True, ["x"]), ("B", False, ["y"])], "category string, passed boolean, missed array<string>")
    users = spark.createDataFrame([("ann", ["A", "B"]), ("bob", ["B"])], "user string, categories array<string>")
    got = quality.alert_recipients(alerts, users, "own")
    assert sorted((r["user"], r["category"]) for r in got.collect()) == [
        ("ann", "A"), ("ann", "B"), ("bob", "B"), ("own", "A"), ("own", "B")]


def test_impute_leaves_no_gap_unless_all_are_null(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, None), (3, 4.0, None)], "id int, x double, e double")
    for how in ("mean", "median", "25%", "75%", "min", "max", "mode"):
        assert clean.impute(df, "x", how).filter("x IS NULL").count() == 0
        assert clean.impute(df, "e", how).filter("e IS NULL").count() == 3
    with pytest.raises(ValueError):
        clean.impute(df, "x", "guess")


def test_deduplicate_is_idempotent_and_whole(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(60)], "id int, k string")
    once = dedup.deduplicate(df, ["k"], "id")
    assert rows(dedup.deduplicate(once, ["k"], "id")) == rows(once)
    members, single = dedup.duplicate_members(df, ["k"]), dedup.deduplicate(df, ["k"], "id", "none")
    assert members.count() + single.count() == 60
    assert dedup.deduplicate(df, ["k"], "id", "last").filter("k = 'hot'").first()["id"] == 59


def test_symmetric_difference(spark):
    a = spark.createDataFrame([(1,), (2,), (2,), (None,)], "x int")
    b = spark.createDataFrame([(1,), (3,)], "x int")
    assert rows(dedup.symmetric_difference(a, b)) == [(3,), (None,)]


def test_find_replace_matches_whole_cells(spark):
    df = spark.createDataFrame([("a", 1), ("ab", 12), (None, None)], "s string, n int")
    assert rows(clean.find_replace(df, "a", "z")) == [("ab", "12"), ("z", "1"), (None, None)]
    assert rows(clean.find_replace(df, "1", "5")) == [("a", 5), ("ab", 12), (None, None)]


def test_drop_null_columns_and_report(spark):
    df = spark.createDataFrame([(1, None, None), (2, "x", None), (3, None, None)], "a int, s string, e string")
    assert clean.drop_null_columns(df).columns == ["a", "s"]
    kept = clean.drop_null_columns(df, 0.5)
    assert kept.columns == ["a"]
    report = clean.shape_report(df, kept).first()
    assert (report["rows_before"], report["rows_after"], report["removed_columns"]) == (3, 3, ["s", "e"])


def test_personal_data_is_masked_in_every_script(spark):
    df = spark.createDataFrame(
        [(1, "write to ann.b@mail.com or +1 555-123-4567", "Female"), (2, "нет", None)], "id int, note string, sex string")
    out = {r["id"]: r for r in privacy.mask_personal_data(df.withColumn("id", F.col("id").cast("string")), ["note", "sex"]).collect()}
    assert "@" not in out["1"]["note"] and "555" not in out["1"]["note"]
    assert "emale" not in out["1"]["sex"] and out["2"]["sex"] is None
    hits = {(r["column"], r["class"]): r["hits"] for r in privacy.detect_personal_data(df, ["note"]).collect()}
    assert hits["note", "email"] == 1 and hits["note", "phone"] == 1


def test_columns_without_personal_data_stay(spark):
    df = spark.createDataFrame([("#",), ("--",)], "s string")
    assert rows(privacy.mask_personal_data(df)) == [("#",), ("--",)]


def test_anonymise_constant_and_null_columns(spark):
    df = spark.createDataFrame([("b", 5.0), ("a", 5.0), (None, 5.0), ("a", 5.0)], "s string, x double")
    out, mapping = privacy.anonymise(df)
    assert rows(out) == [(0, 0.0), (0, 0.0), (0, 0.0), (1, 0.0)]
    assert rows(mapping) == [("s", "a", 0), ("s", "b", 1)]


def test_anonymise_looks_up_or_joins(spark, monkeypatch):
    rng = random.Random(8)
    data = [(rng.choice(["x", "yy", None, "é"]), i % 3 == 0, rng.choice([None, 1.0, 2.5]), i, None, rng.choice("abc")) for i in range(60)]
    df = spark.createDataFrame(data, "`a.b` string, flag boolean, x double, id int, none string, _word0 string")
    found = []
    for limit in (1_000_000, 0):
        monkeypatch.setattr(privacy, "BROADCAST_ROWS", limit)
        out, mapping = privacy.anonymise(df, ["a.b", "flag", "x", "none", "_word0"])
        assert out.columns == df.columns
        found.append((sorted(map(tuple, out.collect()), key=lambda r: r[3]), rows(mapping)))
    assert found[0] == found[1]
    got, mapping = found[0]
    code = {(c, v): k for c, v, k in mapping}
    assert sorted(code) == sorted({("a.b", v) for v in ("x", "yy", "é")} | {("flag", v) for v in ("true", "false")} | {("_word0", v) for v in "abc"})
    counts = [r[0] for r in data if r[0]]
    mode = min(set(counts), key=lambda v: (-counts.count(v), v))
    numbers = [r[2] or 0.0 for r in data]
    mean = sum(numbers) / 60
    spread = math.sqrt(sum((v - mean) ** 2 for v in numbers) / 60)
    for r, d, v in zip(got, data, numbers, strict=True):
        assert r[0] == code["a.b", d[0] or mode] and r[1] == code["flag", str(d[1]).lower()] and r[5] == code["_word0", d[5]]
        assert r[2] == pytest.approx((v - mean) / spread) and r[3] == d[3] and r[4] is None


S1 = [("k1", "A", 1.0), ("k2", None, 2.0), (None, "N", None)]
S2 = [("k1", "B", None), ("k3", "C", 3.0), (None, None, 9.0)]
VENDOR = "ISIN string, NAME string, `LAST PRICE` double"


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_golden_copy_rules(spark):
    s1, s2 = spark.createDataFrame(S1, VENDOR), spark.createDataFrame(S2, VENDOR)
    null_keys = [(None, "N", None), (None, None, 9.0)]
    plain = [("k1", "A", 1.0), ("k2", None, 2.0), ("k3", "C", 3.0), *null_keys]
    assert as_rows(mdm.golden_copy(s1, s2, "ISIN")) == sorted(plain, key=str)
    diff = [{"column": "NAME", "rules": [{"rule": "ANY", "value": "NONEMPTY"}, {"rule": "DIFF", "value": "S2"}]},
            {"column": "LAST PRICE", "rules": [{"rule": "ANY", "value": "S1"}]}]
    ruled = [("k1", "B", 1.0), ("k2", None, 2.0), ("k3", "C", None), (None, "N", None), (None, None, None)]
    assert as_rows(mdm.golden_copy(s1, s2, "ISIN", diff)) == sorted(ruled, key=str)
    with pytest.raises(ValueError):
        mdm.golden_copy(s1, s2, "ISIN", [{"column": "NAME", "rules": [{"rule": "MOST"}]}])


def test_golden_copy_of_many(spark):
    s1, s2 = spark.createDataFrame(S1, VENDOR), spark.createDataFrame(S2, VENDOR)
    extra = spark.createDataFrame([("k2", "Z"), ("k4", "Y"), (None, "W")], "ISIN string, CEO string")
    want = [("k1", "A", 1.0, None), ("k2", None, 2.0, "Z"), ("k3", "C", 3.0, None), ("k4", None, None, "Y"),
            (None, "N", None, None), (None, None, 9.0, None), (None, None, None, "W")]
    assert as_rows(mdm.golden_copy_of([s1, s2, extra], "ISIN")) == sorted(want, key=str)


def test_golden_copy_keeps_whole_records(spark):
    """Records without key stay, and a repeated key keeps a record some source holds."""
    held = [(None, "A", 9.0), (None, "B", 2.0), ("X", "P", 5.0), ("X", "Q", 1.0)]
    s1, s2 = spark.createDataFrame(held, VENDOR), spark.createDataFrame([("X", "Z", 7.0)], VENDOR)
    for found in (as_rows(mdm.golden_copy(s1, s2, "ISIN")), as_rows(mdm.golden_copy_of([s1, s2], "ISIN"))):
        assert len(found) == 3 and set(found) <= set(held)
        assert {r for r in found if r[0] is None} == set(held[:2])
    changed = as_rows(mdm.layer_diff(s1.filter("NAME <> 'Q'"), s2, "ISIN"))
    assert len(changed) == 6 and ("X", "NAME", "P", "Z") in changed


def test_standard_layer_names(spark):
    df = spark.createDataFrame([("1", "x")], "BB_ID string, BB_NM string")
    mapping = spark.createDataFrame([("BB_ID", "PRIMARY ID"), ("BB_NM", "NAME"), (None, "ISIN")], "vendor string, std string")
    names = mdm.read_mapping(mapping, "vendor", "std")
    assert mdm.to_standard_layer(df, names).columns == ["PRIMARY ID", "NAME"]
    assert set(names.values()) <= set(mdm.STANDARD_COLUMNS)
    with pytest.raises(ValueError):
        mdm.to_standard_layer(df, {"BB_ID": "NAME", "BB_NM": "NAME"})


def test_candidate_keys_smallest_first(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "b", "x"), (2, "a", "y")], "g int, h string, u string")
    assert mdm.candidate_keys(df) == [["u"], ["g", "h"], ["g", "u"], ["h", "u"], ["g", "h", "u"]]
    assert mdm.candidate_keys(df, minimal=True) == [["u"], ["g", "h"]]
    assert mdm.candidate_keys(df, limit=1) == [["u"]]


def _keys_by_hand(rows, names, limit, minimal):
    out, found = [], []
    if len(set(rows)) < len(rows):
        return out
    for size in range(1, len(names) + 1):
        for combo in itertools.combinations(range(len(names)), size):
            if len({tuple(r[i] for i in combo) for r in rows}) == len(rows):
                if not minimal or not any(k <= set(combo) for k in found):
                    out.append([names[i] for i in combo])
                found.append(set(combo))
    return out[:limit]


@pytest.mark.parametrize("sample", [200_000, 5])
def test_candidate_keys_match_brute_force(spark, monkeypatch, sample):
    monkeypatch.setattr(mdm, "KEY_SAMPLE", sample)
    for seed in range(4):
        rng = random.Random(seed)
        names = [f"c {i}" for i in range(5)]
        rows = [tuple(rng.choice([None, *range(rng.choice([2, 4]))]) for _ in names) for _ in range(14)]
        rows = list(dict.fromkeys(rows)) if seed else rows + rows[:1]
        df = spark.createDataFrame(rows, ", ".join(f"`{n}` int" for n in names))
        for minimal in (True, False):
            assert mdm.candidate_keys(df, limit=7, minimal=minimal) == _keys_by_hand(rows, names, 7, minimal)


def test_candidate_keys_take_few_jobs(spark):
    """Twelve columns whose only key is the pair of the last two: a bounded number of jobs, not one per combination."""
    names = [f"c{i}" for i in range(12)]
    df = spark.range(4000).select(
        *[(F.col("id") % (i + 2)).alias(f"c{i}") for i in range(10)],
        (F.col("id") % 80).alias("c10"),
        F.floor(F.col("id") / 80).alias("c11"),
    )
    context = spark.sparkContext
    context.setJobGroup("keys", "candidate keys")
    found = mdm.candidate_keys(df, limit=1)
    jobs = context.statusTracker().getJobIdsForGroup("keys")
    context.setJobGroup("other", "")
    assert found == [["c10", "c11"]]
    assert len(jobs) <= 12
    assert mdm.candidate_keys(spark.createDataFrame([], df.schema), limit=2) == [["c0"], ["c1"]]
    assert mdm.candidate_keys(df.union(df), limit=2) == []
    assert set(names) == set(df.columns)


def test_classes(spark):
    data = [(i, "yes" if i % 2 else "no", f"name {i}", "long text " * 4 + str(i % 60), 2000 + i % 20, i * 0.5, 1, None, i % 7)
            for i in range(100)]
    df = spark.createDataFrame(data, "id int, flag string, name string, body string, y int, x double, one int, nil string, small int")
    got = {r["column"]: r["class"] for r in classify.classify_columns(df).collect()}
    assert got == {"id": "id", "flag": "string_bool", "name": "id", "body": "nlp", "y": "date", "x": "continuous",
                   "one": "delete", "nil": "delete", "small": "int"}
    cats = {r["column"]: r["class"] for r in classify.integer_categories(df, classify.classify_columns(df)).collect()}
    assert cats["small"] == "cat" and cats["id"] == "id"


def test_lineage_event_and_upsert(spark):
    event = catalog.lineage_event(spark.createDataFrame([(1,)], "a int"), "cleaning", "Cleaning Completed- X a", source_id="S")
    found = catalog.lineage_of_column(event, "a").first()
    assert (found["step"], found["kind"], found["available_columns"]) == ("Cleaning Process", "Dataset", ["a"])
    assert catalog.lineage_of_column(event, "b").count() == 0
    old = spark.createDataFrame([(1, "x"), (2, "y")], "id int, t string")
    assert rows(catalog.upsert(old, spark.createDataFrame([(2, "z"), (3, "w")], "id int, t string"))) == [(1, "x"), (2, "z"), (3, "w")]


def test_key_values_match(spark):
    df = spark.createDataFrame([("K",), ("K",)], "k string")
    one_row = spark.range(1)
    assert one_row.select(catalog.key_values_match(df, "k", "K")).first()[0] is True
    assert one_row.select(catalog.key_values_match(df, "k", "L")).first()[0] is False
    assert one_row.select(catalog.key_values_match(df.unionByName(spark.createDataFrame([(None,)], "k string")), "k", "K")).first()[0] is False


def test_iterative_impute_recovers_a_line(spark):
    data = [(i, float(i), None if i % 5 == 0 else 3.0 * i + 1, None if i % 7 == 0 else 2 * i, "a" if i % 3 else None) for i in range(1, 60)]
    df = spark.createDataFrame(data, "id int, x double, y double, k int, s string")
    out = learn.iterative_impute(df, ["x", "y", "k", "s"], rounds=4)
    assert out.schema["k"].dataType == df.schema["k"].dataType
    for r in out.collect():
        assert r["y"] == pytest.approx(3.0 * r["id"] + 1, abs=0.5)
        assert r["k"] == pytest.approx(2 * r["id"], abs=1)
        assert r["s"] == "a"


def test_iterative_impute_matches_least_squares(spark, monkeypatch):
    """Rounds by hand, with a constant column, one that follows from another, one without values; nothing is stored."""
    monkeypatch.setattr(learn, "durable", None)
    rng = np.random.default_rng(2)
    n = 120
    full = np.column_stack([rng.normal(50, 9, n), rng.normal(-3, 2, n), rng.normal(1e6, 40, n), np.full(n, 7.0)])
    full[:, 2] += 3 * full[:, 0] - 8 * full[:, 1]
    full = np.column_stack([full, 2 * full[:, 0] + 1])
    gaps = rng.random(full.shape) < [0.3, 0.0, 0.2, 0.1, 0.0]
    names = ["a", "b.b", "c", "d", "_value0"]
    rows = [tuple(None if g else float(v) for v, g in zip(r, m, strict=True)) + (None, i) for i, (r, m) in enumerate(zip(full, gaps, strict=True))]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in names) + ", e double, id int")
    want = np.where(gaps, np.nan, full)
    want = np.where(gaps, np.nanmean(want, axis=0), want)
    for _ in range(3):
        fits = {}
        for i in range(5):
            known = ~gaps[:, i]
            others = [k for k in range(5) if k != i]
            middle, width = want[:, others].mean(axis=0), want[:, others].std(axis=0) + 1e-300
            design = np.column_stack([np.ones(n), np.where(width > 1e-9, (want[:, others] - middle) / width, 0)])
            fits[i] = middle, width, np.linalg.lstsq(design[known], want[known, i], rcond=1e-9)[0]
        for i in sorted(range(5), key=lambda i: gaps[:, i].sum()):
            others = [k for k in range(5) if k != i]
            middle, width, fit = fits[i]
            guess = np.column_stack([np.ones(n), np.where(width > 1e-9, (want[:, others] - middle) / width, 0)]) @ fit
            want[:, i] = np.where(gaps[:, i], guess, want[:, i])
    found = learn.iterative_impute(df, [*names, "e"], rounds=3)
    assert found.columns == df.columns
    got = sorted(found.collect(), key=lambda r: r["id"])
    assert {r["e"] for r in got} == {None}
    for k, c in enumerate(names):
        assert np.allclose([r[c] for r in got], want[:, k], rtol=1e-6), c


def test_ranks_are_taken_once_a_column(spark, monkeypatch):
    """Spearman of columns with and without nulls against ranks by hand; large columns are joined, small ones looked up."""
    rng = random.Random(4)
    data = []
    for i in range(200):
        a, b, c = rng.randint(0, 5), rng.random(), rng.choice([-0.0, 0.0, 1.0])
        gap = i % 7 == 0
        data.append((a, b, c, None if gap else a * b, None if gap else float(rng.randint(0, 9)), float("nan") if i % 5 == 0 else b - a))
    df = spark.createDataFrame(data, "a int, `b.b` double, c double, d double, e double, f double")

    def ranks(values):
        return [sum(x < v for x in values) + (sum(x == v for x in values) + 1) / 2 for v in values]

    def expected(i, j):
        both = [(r[i], r[j]) for r in data if None not in (r[i], r[j]) and r[i] == r[i] and r[j] == r[j]]
        x, y = (ranks([float(v) for v in side]) for side in zip(*both, strict=True))
        return float(np.corrcoef(x, y)[0, 1])

    for limit in (500_000, 3):
        monkeypatch.setattr(association, "BROADCAST_RANKS", limit)
        got = {(r[0], r[1]): r[2] for r in association.correlation(df, method="spearman").collect()}
        assert len(got) == 36
        for (i, p), (j, q) in itertools.product(enumerate(df.columns), repeat=2):
            assert got[p, q] == pytest.approx(expected(i, j))


def test_kendall_of_one_column(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (2, 5)], "x int, y int")
    got = [tuple(r) for r in association.correlation(df, ["x"], "kendall").collect()]
    assert got == [("x", "x", 1.0)]
    assert {(r[0], r[1]): r[2] for r in association.correlation(df, method="kendall").collect()} == {
        ("x", "x"): 1.0, ("y", "y"): 0.0, ("x", "y"): 0.0, ("y", "x"): 0.0
    }


def test_prediction_keeps_rows_and_learns(spark):
    data = [(i % 50, "u" if i % 2 else "v", "hi" if i % 50 > 25 else "lo") for i in range(400)]
    df = spark.createDataFrame(data, "n int, w string, target string")
    out = learn.predict(df, "target", "DecisionTree_Classifier")
    assert out.columns == ["n", "w", "target", "Prediction"]
    right = out.filter("target = Prediction").count()
    assert 0 < out.count() < 200 and right == out.count()
    with pytest.raises(ValueError):
        learn.prepare(spark.range(500).withColumn("t", F.col("id")), "t")


def test_fits_share_out_the_rows(spark, monkeypatch):
    """No task of a fit holds more than its share of the rows, however few files they are stored in."""
    held = []

    class Seen(Exception):
        pass

    def watched(self, rows):
        held.append(rows.select("_features", "_label").rdd.mapPartitions(lambda r: [sum(1 for _ in r)]).collect())
        raise Seen

    monkeypatch.setattr(learn.RandomForestClassifier, "fit", watched)
    monkeypatch.setattr(learn, "TASK_BYTES", 40 * (200 + 2 * 8 + 4 * 50), raising=False)
    data = [(i % 50, "u" if i % 2 else "v", "hi" if i % 50 > 25 else "lo") for i in range(400)]
    df = spark.createDataFrame(data, "n int, w string, target string").coalesce(1)
    for run in (
        lambda: learn.feature_importance(df, "target", trees=50),
        lambda: learn.predict(df, "target"),
        lambda: learn.compare_models(df, "target", names=["RandomForest_Classifier"]),
    ):
        with pytest.raises(Seen):
            run()
    assert sum(held[0]) == sum(held[1]) == sum(held[2]) > 250
    assert max(held[0]) <= 45 and max(held[1] + held[2]) <= 65


def test_report_for_one_term(spark):
    df = spark.createDataFrame([(1.0,), (None,), (5.0,)], "p double")
    got = {r["item"]: r["value"] for r in reports.report(df, {"Price": "p"}, {"Price": ["ValueStatistics"]}).collect()}
    assert got == {"average": 2.0, "mean": 2.0, "median": 1.0, "minimum": 0.0, "maximum": 5.0}


def test_membership_is_the_same_with_and_without_broadcast(spark, monkeypatch):
    from sparkqual.operators import quality as q

    df = spark.createDataFrame([("hot",)] * 50 + [("a",), ("b",), (None,)], "v string").repartition(5)
    ref = spark.createDataFrame([("hot",), ("b",), ("b",), (None,)], "r string")
    small = rows(q.with_membership(df, "v", ref, "r", "known"))
    monkeypatch.setattr(q, "fits_broadcast", lambda *_: False)
    assert rows(q.with_membership(df, "v", ref, "r", "known")) == small
    assert (None, False) in small and ("a", False) in small and ("hot", True) in small
    assert q.reference_scores(df, "v", ref, "r").first()["members"] == 51


def test_uniqueness_counts_scored_columns_only(spark):
    rows = [("g", 5, k) for k in range(4)]
    df = spark.createDataFrame(rows, "key string, amount int, value int")
    value = [{"column": "amount", "rules": [{"rule": "Value", "operator": "greaterthan", "value": "0"}]}]
    text_formula = [{"column": "amount", "rules": [{"rule": "Formula", "value": "amount > value"}]}]
    branch = [{"logic": "If", "formula": [{"operand1": "value", "operator1": ">", "value": "2"}],
               "operand": "amount", "operator": ">", "value": "9"}]
    nested = [{"column": "amount", "rules": [{"rule": "Formula", "value": branch}]}]
    found = [quality.group_scorecard(df, ["key"], r, columns=["amount"]).first() for r in (value, text_formula, nested)]
    assert [f["Uniqueness"] for f in found] == [25.0] * 3
    assert [f["Accuracy"] for f in found] == [100.0, 100.0, 75.0] and {f["rows"] for f in found} == {4}


def test_one_upload_for_a_slot_and_day(spark):
    def when(hour):
        return dt.datetime(2024, 5, 1, hour)

    schema = "source_id int, multi_source_key string, upload_ts timestamp, upload_id int, reason string"
    history = spark.createDataFrame([(1, "K", when(0), 0), (9, None, when(0), 9)], "source_id int, multi_source_key string, upload_ts timestamp, upload_id int")
    arrivals = spark.createDataFrame(
        [(2, "K", when(5), 20, None), (2, "K", when(4), 21, ""), (2, "K", when(4), 22, None), (2, "K", when(4), 21, ""),
         (1, "K", when(3), 10, None), (1, "K", when(5), 11, "fix"), (1, "K", when(4), 12, "fix"),
         (3, "K", when(1), 30, None), (3, "K", when(2), 31, "fix"), (9, None, when(2), 90, None),
         (1, "K", when(6), 13, "cleansedsource"), (4, None, when(1), 40, None)],
        schema,
    )
    accepted = catalog.accept_uploads(history, arrivals)
    got = {r["upload_id"]: (r["accepted"], r["replaces"]) for r in accepted.collect()}
    assert {k for k, (a, _) in got.items() if a} == {21, 11, 31, 13, 40}
    assert {k for k, (_, r) in got.items() if r} == {11} and accepted.count() == 11
    after = catalog.apply_uploads(history, accepted)
    assert sorted(r["upload_id"] for r in after.collect()) == [9, 11, 13, 21, 31, 40]
