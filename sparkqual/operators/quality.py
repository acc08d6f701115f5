"""Rule scores, scorecards, violating rows and alerts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import formula as formulas, kinds, rules as rl
from ..functions.values import half_even, is_missing, percent
from ..plans.longform import describe_columns, quoted, value_counts
from ..plans.skew import fits_broadcast, join_unique

DIMENSIONS = ("Completeness", "Uniqueness", "Validity", "Integrity", "Accuracy")


def completeness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, completeness, nulls): percent of non-null values (Q1)."""
    names = list(columns or df.columns)
    return describe_columns(
        df,
        {
            c: {
                "completeness": percent(F.count(quoted(c)), F.count(F.lit(1))),
                "nulls": F.count_if(quoted(c).isNull()),
            }
            for c in names
        },
    )


def uniqueness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, uniqueness, repeats): 100 less the percent of repeated values (Q3)."""
    names = list(columns or kinds.flat_columns(df))
    return (
        value_counts(df, names)
        .groupBy("column")
        .agg(
            percent(F.count(F.lit(1)), F.sum("n")).alias("uniqueness"),
            F.sum(F.col("n") - 1).alias("repeats"),
        )
    )


def rule_scores(
    df: DataFrame, ruleset: Sequence[Mapping], null_as: object = None
) -> DataFrame:
    """(rule_id, column, rule, dimension, checked, failed, pass_pct) from one scan (Q5-Q12)."""
    stats = {}
    for check in rl.compile_rules(df, ruleset, null_as):
        checked, failed = F.count_if(check.applies), F.count_if(check.violated)
        stats[check.rule_id] = {
            "column": F.lit(check.column),
            "rule": F.lit(check.rule),
            "dimension": F.lit(check.dimension),
            "checked": checked,
            "failed": failed,
            "pass_pct": percent(checked - failed, checked),
        }
    return describe_columns(df, stats, label="rule_id")


def violations(
    df: DataFrame,
    ruleset: Sequence[Mapping],
    keep: Sequence[str],
    null_as: object = None,
    null_columns: Sequence[str] = (),
) -> DataFrame:
    """(`keep`, rule_id, column, observed): one row per broken rule (Q2, Q5-Q12).

    `null_columns` adds a row for every null cell of these columns. Rows that break nothing
    are filtered before the broken rules are listed; no shuffle.
    """
    hits = [
        F.when(
            check.violated,
            F.struct(
                F.lit(check.rule_id).alias("rule_id"),
                F.lit(check.column).alias("column"),
                check.observed.alias("observed"),
            ),
        )
        for check in rl.compile_rules(df, ruleset, null_as)
    ]
    hits += [
        F.when(
            quoted(c).isNull(),
            F.struct(
                F.lit(f"{c}:NotNull").alias("rule_id"),
                F.lit(c).alias("column"),
                F.lit(None).cast("string").alias("observed"),
            ),
        )
        for c in null_columns
    ]
    broken = F.filter(F.array(*hits), lambda h: h.isNotNull())
    return df.select(*[quoted(k) for k in keep], F.inline(broken))


def null_rows(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per null cell (Q2)."""
    return violations(df, [], keep, null_columns=columns)


def _known_values(reference: DataFrame, column: str) -> DataFrame:
    return reference.select(quoted(column).cast("string").alias("_ref")).distinct()


def with_membership(
    df: DataFrame, column: str, reference: DataFrame, ref_column: str, name: str
) -> DataFrame:
    """Add boolean `name`: the value occurs in the reference column. Null is no member.

    A reference that was counted and found small is broadcast, and the rows stay where they
    are. Otherwise values are looked up once each, and a value that fills a third of the
    rows meets its answer in many tasks.
    """
    rows = df.withColumn("_value", quoted(column).cast("string"))
    known = _known_values(reference, ref_column)
    if fits_broadcast(known, "_ref"):
        joined = rows.join(F.broadcast(known), F.col("_value") == F.col("_ref"), "left")
        return joined.withColumn(name, F.col("_ref").isNotNull()).drop("_value", "_ref")
    looked_up = (
        rows.groupBy("_value")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .join(known, F.col("_value") == F.col("_ref"), "left")
        .select("_value", F.col("_ref").isNotNull().alias(name), "_rows")
    )
    return join_unique(rows, looked_up, ["_value"], "left", "_rows").drop("_value", "_rows")


def reference_scores(df: DataFrame, column: str, reference: DataFrame, ref_column: str) -> DataFrame:
    """(column, checked, members, integrity): percent of values known to the reference.

    Each value is looked up once and weighted by its rows, so no value is too frequent.
    """
    counted = df.groupBy(quoted(column).cast("string").alias("_value")).agg(
        F.count(F.lit(1)).alias("_rows")
    )
    known = _known_values(reference, ref_column)
    members = F.sum(F.when(F.col("_ref").isNotNull(), F.col("_rows")).otherwise(0))
    return counted.join(known, F.col("_value") == F.col("_ref"), "left").agg(
        F.lit(column).alias("column"),
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("checked"),
        F.coalesce(members, F.lit(0)).alias("members"),
        percent(members, F.sum("_rows")).alias("integrity"),
    )


def reference_violations(
    df: DataFrame, column: str, reference: DataFrame, ref_column: str
) -> DataFrame:
    """Rows whose value the reference does not know."""
    return with_membership(df, column, reference, ref_column, "_known").filter("NOT _known").drop("_known")


def launch_violations(
    df: DataFrame,
    key: str,
    ruleset: Sequence[Mapping],
    keep: Sequence[str],
    null_columns: Sequence[str] = (),
    unique_columns: Sequence[str] = (),
    references: Mapping[str, tuple[DataFrame, str]] | None = None,
    null_as: object = None,
) -> DataFrame:
    """All violations of a launch in one table (Q2, Q4, Q5-Q12, Q14).

    (`keep`, key_column, key_value, kind, rule_id, column, observed): `kind` is null, duplicate,
    rule or reference. Null cells of `null_columns`; rows equal to another one on `unique_columns`
    (a single violation each); broken rules of `ruleset`; values of a column that its reference
    (column: table, its column) doesn't know.
    """
    from . import dedup

    named = df.select(
        "*", F.lit(key).alias("key_column"), quoted(key).cast("string").alias("key_value")
    )
    wide = [*keep, "key_column", "key_value"]
    kinds_of = [("null", violations(named, [], wide, null_columns=null_columns))] if null_columns else []
    kinds_of.append(("rule", violations(named, ruleset, wide, null_as)))

    def one_each(rows: DataFrame, rule_id: str, column: str, observed: Column) -> DataFrame:
        return rows.select(
            *[quoted(c) for c in wide], F.lit(rule_id).alias("rule_id"), F.lit(column).alias("column"),
            observed.alias("observed"),
        )

    if unique_columns:
        together = ",".join(unique_columns)
        repeated = dedup.duplicate_members(named, unique_columns)
        kinds_of.append(
            ("duplicate", one_each(repeated, f"{together}:Unique", together, F.lit(None).cast("string")))
        )
    for column, (reference, ref_column) in (references or {}).items():
        unknown = reference_violations(named, column, reference, ref_column)
        kinds_of.append(("reference", one_each(unknown, f"{column}:Reference", column, quoted(column).cast("string"))))
    out: DataFrame | None = None
    for kind, found in kinds_of:
        part = found.withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out.select(*[quoted(c) for c in wide], "kind", "rule_id", "column", "observed")


def group_scorecard(
    df: DataFrame,
    keys: Sequence[str],
    ruleset: Sequence[Mapping],
    references: Mapping[str, DataFrame] | None = None,
    columns: Sequence[str] | None = None,
    null_as: object = None,
) -> DataFrame:
    """Five dimensions per value of every key column.

    (key_column, key_value, rows, Completeness, Uniqueness, Validity, Integrity, Accuracy,
    overall, is_outlier). Equal rows are grouped once; measures are sums over the distinct rows,
    weighted by their count. Repeats are counted on the scored columns and keys alone, whatever
    other columns a formula reads. Key columns are scored together, a null key value is a group of
    its own.

    `references` maps the id in a reference rule's `ref-id-column` value to its table.
    """
    scored = list(columns or dict.fromkeys([*keys, *[e["column"] for e in ruleset]]))
    told_apart = list(dict.fromkeys([*scored, *keys]))
    needed = list(dict.fromkeys([*told_apart, *[e["column"] for e in ruleset], *_formula_columns(df, ruleset)]))
    counted = df.select(*[quoted(c) for c in needed]).groupBy(*[quoted(c) for c in needed]).agg(
        F.count(F.lit(1)).alias("_n")
    )
    checks = rl.compile_rules(df, ruleset, null_as)
    members = []
    for i, (_, column, ref_id, ref_column) in enumerate(rl.reference_rules(ruleset)):
        counted = with_membership(counted, column, (references or {})[ref_id], ref_column, f"_member{i}")
        members.append(f"_member{i}")

    n = F.col("_n")

    def weigh(test: Column) -> Column:
        return F.when(test, n).otherwise(0)

    nulls = sum((is_missing(df, c, empty_text=False).cast("int") for c in scored), F.lit(0))
    key_values = F.array(
        *[F.struct(F.lit(k).alias("key_column"), quoted(k).cast("string").alias("key_value")) for k in keys]
    )
    long = counted.select(
        F.inline(key_values),
        n,
        F.lit(int(needed == told_apart)).alias("_kinds"),
        (nulls * n).alias("_nulls"),
        *[weigh(c.applies).alias(f"_checked{i}") for i, c in enumerate(checks)],
        *[weigh(c.violated).alias(f"_failed{i}") for i, c in enumerate(checks)],
        *[weigh(F.col(m)).alias(m) for m in members],
    )
    if needed != told_apart:
        kinds_only = counted.select(*[quoted(c) for c in told_apart]).distinct().select(F.inline(key_values))
        long = long.unionByName(kinds_only.withColumn("_kinds", F.lit(1)), allowMissingColumns=True)
    sums = long.groupBy("key_column", "key_value").agg(
        F.sum("_n").alias("rows"),
        (F.sum("_n") - F.sum("_kinds")).alias("_repeats"),
        F.sum("_nulls").alias("_nulls"),
        *[F.sum(f"_{w}{i}").alias(f"_{w}{i}") for w in ("checked", "failed") for i in range(len(checks))],
        *[F.sum(m).alias(m) for m in members],
    )

    def passed(i: int) -> Column:
        return percent(F.col(f"_checked{i}") - F.col(f"_failed{i}"), F.col(f"_checked{i}"))

    def mean_of(scores: Sequence[Column]) -> Column:
        present = F.filter(F.array(*scores), lambda s: s.isNotNull())
        total = F.aggregate(present, F.lit(0.0), lambda a, s: a + s)
        return F.try_divide(total, F.size(present))

    by_kind: dict[str, list[Column]] = {"Validity": [], "Formula": [], "Value": []}
    for i, check in enumerate(checks):
        kind = check.rule if check.rule in ("Formula", "Value") else "Validity"
        by_kind[kind].append(passed(i))
    validity = F.coalesce(mean_of(by_kind["Validity"]), F.lit(100.0)) if by_kind["Validity"] else F.lit(100.0)
    accuracy = [mean_of(by_kind[k]) for k in ("Formula", "Value") if by_kind[k]]
    unmeasured = F.lit(None).cast("double")
    shares = {
        "Completeness": 100 - half_even(percent(F.col("_nulls"), F.col("rows") * len(scored)), 2),
        "Uniqueness": half_even(100 - percent(F.col("_repeats"), F.col("rows")), 2),
        "Validity": half_even(validity, 2),
        "Integrity": half_even(mean_of([percent(F.col(m), F.col("rows")) for m in members]), 2)
        if members
        else unmeasured,
        "Accuracy": half_even(mean_of(accuracy), 2) if accuracy else unmeasured,
    }
    declared = {e["column"]: e.get("data_type") for e in ruleset}
    outlier = F.lit(False)
    for k in keys:
        if declared.get(k):
            misfit = rl.key_is_outlier(F.col("key_value"), declared[k])
            outlier = F.when(F.col("key_column") == k, misfit).otherwise(outlier)
    return sums.select(
        "key_column", "key_value", "rows", *[s.alias(d) for d, s in shares.items()]
    ).select(
        "*",
        half_even(mean_of([F.col(d) for d in DIMENSIONS]), 2).alias("overall"),
        outlier.alias("is_outlier"),
    )


def _formula_columns(df: DataFrame, ruleset: Sequence[Mapping]) -> list[str]:
    """Columns that formulas read besides the rule columns."""
    found = [
        formulas.columns_read(r["value"], df.columns) for e in ruleset for r in e["rules"] if r["rule"] == "Formula"
    ]
    return list(dict.fromkeys(c for names in found for c in names))


def long_scores(scorecard: DataFrame) -> DataFrame:
    """(key_column, key_value, dimension, score), measured dimensions only."""
    return scorecard.unpivot(
        ["key_column", "key_value"], list(DIMENSIONS), "dimension", "score"
    ).filter(F.col("score").isNotNull())


def launch_scores(scorecard: DataFrame) -> DataFrame:
    """(key_column, dimension, score): mean over key values; the row with a null key_column
    is the mean over key columns (A36, Q17)."""
    per_column = (
        long_scores(scorecard)
        .groupBy("key_column", "dimension")
        .agg(half_even(F.avg("score"), 2).alias("score"))
    )
    overall = per_column.groupBy("dimension").agg(half_even(F.avg("score"), 2).alias("score"))
    return per_column.unionByName(
        overall.select(F.lit(None).cast("string").alias("key_column"), "dimension", "score")
    )


def key_outliers(df: DataFrame, key: str, data_type: str) -> DataFrame:
    """(key_value, rows, is_outlier) of every key value (Q15)."""
    return (
        df.groupBy(quoted(key).cast("string").alias("key_value"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("is_outlier", rl.key_is_outlier(F.col("key_value"), data_type))
    )


def column_scorecard(
    df: DataFrame, columns: Sequence[str] | None = None, ruleset: Sequence[Mapping] | None = None
) -> DataFrame:
    """(column, Completeness, Validity, Consistency, Timeliness, Accuracy, overall) (Q18).

    Without a rule set the suggested one is used. Dimensions nobody measured are null, and
    `overall` is the mean of the column's measured ones.
    """
    from . import suggest

    names = list(columns or kinds.flat_columns(df))
    used = ruleset if ruleset is not None else suggest.as_ruleset(suggest.default_rules(df, names))
    scores = rule_scores(df, used)

    def mean_where(dimension: str) -> Column:
        return F.avg(F.when(F.col("dimension") == dimension, F.col("pass_pct")))

    rated = scores.groupBy("column").agg(
        mean_where("Validity").alias("_validity"), mean_where("Accuracy").alias("_accuracy")
    )
    unmeasured = F.lit(None).cast("double")
    return (
        completeness(df, names)
        .join(rated, "column", "left")
        .select(
            "column",
            half_even(F.col("completeness"), 2).alias("Completeness"),
            half_even(F.coalesce("_validity", F.lit(100.0)), 2).alias("Validity"),
            unmeasured.alias("Consistency"),
            unmeasured.alias("Timeliness"),
            half_even(F.col("_accuracy"), 2).alias("Accuracy"),
        )
        .withColumn(
            "overall",
            half_even(
                F.try_divide(
                    F.col("Completeness") + F.col("Validity") + F.coalesce("Accuracy", F.lit(0.0)),
                    F.when(F.col("Accuracy").isNull(), 2).otherwise(3),
                ),
                2,
            ),
        )
    )


def tolerance_alerts(scores: DataFrame, tolerances: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(`by`, category, passed, missed): every measured dimension reaches its minimum.

    `scores` has dimension and score; `tolerances` has category, dimension and minimum.
    """
    fits = F.col("score") >= F.col("minimum")
    return (
        scores.join(tolerances, "dimension")
        .groupBy(*[quoted(b) for b in by], "category")
        .agg(
            F.every(fits).alias("passed"),
            F.array_sort(F.collect_set(F.when(~fits, F.col("dimension")))).alias("missed"),
        )
    )


def alert_recipients(
    alerts: DataFrame, users: DataFrame, owner: str | None = None
) -> DataFrame:
    """Alerts with the users of their category (`users`: user, categories).

    With `owner`, that user receives every alert too.
    """
    audience = users.select("user", F.explode("categories").alias("category")).distinct()
    out = alerts.join(audience, "category")
    if owner is not None:
        out = out.unionByName(alerts.withColumn("user", F.lit(owner))).dropDuplicates(
            [c for c in out.columns if c != "missed"]
        )
    return out


def ruleset_status(start: Column, end: Column, today: Column) -> Column:
    """Active inside the window, Inactive before it, Expired after it; whole days (Q24)."""
    first, last, day = F.to_date(start), F.to_date(end), F.to_date(today)
    return (
        F.when((first <= day) & (day <= last), "Active")
        .when(first >= day, "Inactive")
        .otherwise("Expired")
    )
