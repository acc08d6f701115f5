"""Select, search, impute, replace and drop, with an audit trail."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import kinds
from ..functions.text import contains_pattern
from ..functions.values import any_of
from ..plans.bands import band_quantiles
from ..plans.longform import describe_columns, quoted

# Fills that are quantiles.
_QUANTILES = {"median": 0.5, "25%": 0.25, "75%": 0.75}
_MOMENTS = {"mean": F.avg, "min": F.min, "max": F.max}


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """F1"""
    return df.select(*[quoted(c) for c in columns])


def null_rows(df: DataFrame, column: str) -> DataFrame:
    """Rows without a value in `column` (F2)."""
    return df.filter(quoted(column).isNull())


def rows_with_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """F6"""
    return df.filter(quoted(column).isin(list(values)))


def rows_by_id(df: DataFrame, ids: DataFrame | Sequence, row_id: str = "row_id") -> DataFrame:
    """Rows with the given ids: a short list, or a table with a `row_id` column."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(row_id).distinct(), row_id, "left_semi")
    return df.filter(quoted(row_id).isin(list(ids)))


def search_rows(df: DataFrame, pattern: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows in which any column matches the pattern, case ignored."""
    names = list(columns or kinds.flat_columns(df))
    return df.filter(F.coalesce(any_of([_match(quoted(c), pattern) for c in names]), F.lit(False)))


def _match(c: Column, pattern: str) -> Column:
    return F.coalesce(contains_pattern(c, pattern), F.lit(False))


def log_entries(log: DataFrame, column: str, value: object) -> DataFrame:
    """Audit entries with `column` = value (F8)."""
    return log.filter(quoted(column) == F.lit(value))


def visible_to(
    sources: DataFrame,
    user: str,
    departments: Sequence[str],
    owner: str = "owner",
    creator: str = "creator",
    shared: str = "departments",
) -> DataFrame:
    """Entries a user may see: own, created, or shared with one of the departments."""
    wanted = F.array(*[F.lit(d) for d in departments]).cast("array<string>")
    allowed = (quoted(owner) == user) | (quoted(creator) == user) | F.arrays_overlap(quoted(shared), wanted)
    return sources.filter(F.coalesce(allowed, F.lit(False)))


def drop_rows(df: DataFrame, ids: DataFrame | Sequence, row_id: str = "row_id") -> DataFrame:
    """Rows without the given ids."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(row_id).distinct(), row_id, "left_anti")
    return df.filter(~quoted(row_id).isin(list(ids)))


def drop_where(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition does not hold; unknown keeps the row."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """F11"""
    return df.drop(*columns)


def drop_null_rows(df: DataFrame, threshold: float | None = None) -> DataFrame:
    """Rows that are all null go; with a threshold t, so do rows with fewer than
    int(t * columns) values (F12)."""
    out = df.na.drop("all")
    return out if threshold is None else out.na.drop(thresh=int(threshold * len(df.columns)))


def null_shares(df: DataFrame) -> DataFrame:
    """(column, null_share)"""
    return describe_columns(
        df,
        {
            c: {"null_share": F.try_divide(F.count_if(quoted(c).isNull()), F.count(F.lit(1)))}
            for c in df.columns
        },
    )


def drop_null_columns(df: DataFrame, threshold: float | None = None) -> DataFrame:
    """Columns that are all null go; with a threshold, so do columns with a larger null
    share (F13). The shares of the columns decide the schema, so they are measured first."""
    limit = 1.0 if threshold is None else threshold
    shares = {r["column"]: r["null_share"] or 0.0 for r in null_shares(df).collect()}
    kept = [c for c in df.columns if shares[c] < 1.0 and shares[c] <= limit]
    return df.select(*[quoted(c) for c in kept])


def shape_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows and columns before and after, and the columns that went."""
    removed = [c for c in before.columns if c not in after.columns]
    old = before.agg(F.count(F.lit(1)).alias("rows_before"))
    return old.select(
        "rows_before",
        after.agg(F.count(F.lit(1))).scalar().alias("rows_after"),
        F.lit(len(before.columns)).cast("bigint").alias("columns_before"),
        F.lit(len(after.columns)).cast("bigint").alias("columns_after"),
        F.array(*[F.lit(c) for c in removed]).cast("array<string>").alias("removed_columns"),
    )


def removed_rows(before: DataFrame, after: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Rows of `before` that `after` lacks (U4)."""
    return before.join(after.select(row_id), row_id, "left_anti")


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """F15"""
    return df.limit(n)


def choose(condition: Column, yes: Column, no: Column) -> Column:
    """Conditional projection (F16): unknown takes `no`."""
    return F.when(condition, yes).otherwise(no)


def mode_value(df: DataFrame, column: str) -> Column:
    """Scalar sub-query: the most frequent value, the lowest one on ties (L2).

    Counts are aggregated by value and only the best row of each task is compared.
    """
    counts = (
        df.filter(quoted(column).isNotNull())
        .groupBy(quoted(column).alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.orderBy(F.col("n").desc(), F.col("v").asc()).limit(1).select("v").scalar()


def fill_value(df: DataFrame, column: str, how: str) -> Column:
    """Scalar sub-query for mean, median, 25%, 75%, min, max or mode (L1, L2)."""
    if how in _MOMENTS:
        return df.agg(_MOMENTS[how](quoted(column))).scalar()
    if how in _QUANTILES:
        return band_quantiles(df, [column], [_QUANTILES[how]]).select("p0").scalar()
    if how == "mode":
        return mode_value(df, column)
    raise ValueError(f"unknown fill {how}")


def impute(
    df: DataFrame,
    column: str,
    how: str = "mean",
    value: object = None,
    where: Column | None = None,
) -> DataFrame:
    """Fill nulls of one column (L1-L3); `how="value"` takes the given value.

    With `where`, the fill is measured on and written to the matching rows only; all rows
    are returned. `where` may be a condition, e.g. `functions.rules.conjunction`.
    """
    matching = df if where is None else df.filter(where)
    fill = F.lit(value) if how == "value" else fill_value(matching, column, how)
    gap = quoted(column).isNull()
    if where is not None:
        gap = gap & F.coalesce(where, F.lit(False))
    kind = df.schema[column].dataType
    # A fraction may fill a whole-number column, so means and quantiles widen it.
    target = "double" if how in ("mean", *_QUANTILES) and isinstance(kind, T.NumericType) else kind
    filled = F.when(gap, fill.cast(target)).otherwise(quoted(column).cast(target))
    return df.withColumn(column, filled)


def replace_cells(df: DataFrame, edits: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Write the non-null cells of `edits` over the rows with the same id (L4).

    Of several edits of a cell the largest value counts, so no row is written twice.
    """
    changed = [c for c in edits.columns if c != row_id]
    renamed = edits.groupBy(quoted(row_id)).agg(*[F.max(quoted(c)).alias(f"_new_{c}") for c in changed])
    joined = df.join(renamed, row_id, "left")
    return joined.select(
        *[
            (F.coalesce(F.col(f"`_new_{c}`"), quoted(c)) if c in changed else quoted(c)).alias(c)
            for c in df.columns
        ]
    )


def find_replace(
    df: DataFrame, old: str, new: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """Replace cells whose whole text equals `old`.

    Text columns keep their type; other columns take part only when the new text can be
    read back as their type, otherwise they become text.
    """
    names = set(columns or kinds.flat_columns(df))
    out = []
    for f in df.schema:
        c = quoted(f.name)
        if f.name in names:
            swapped = F.when(c.cast("string") == old, F.lit(new)).otherwise(c.cast("string"))
            c = swapped if isinstance(f.dataType, T.StringType) else _as_type(swapped, c, old, new, f.dataType)
        out.append(c.alias(f.name))
    return df.select(*out)


def _as_type(swapped: Column, c: Column, old: str, new: str, kind: T.DataType) -> Column:
    if isinstance(kind, T.NumericType):
        try:
            float(new)
        except ValueError:
            return swapped
        return F.when(c.cast("string") == old, F.lit(new).try_cast(kind)).otherwise(c)
    return swapped


def changed_cells(
    before: DataFrame, after: DataFrame, row_id: str = "row_id", columns: Sequence[str] | None = None
) -> DataFrame:
    """(row_id, column, previous_value, changed_value): cells that differ."""
    names = list(columns or [c for c in before.columns if c != row_id and c in after.columns])
    new = after.select(quoted(row_id), *[quoted(c).alias(f"_new_{c}") for c in names])
    cells = [
        F.when(
            ~quoted(c).cast("string").eqNullSafe(F.col(f"`_new_{c}`").cast("string")),
            F.struct(
                F.lit(c).alias("column"),
                quoted(c).cast("string").alias("previous_value"),
                F.col(f"`_new_{c}`").cast("string").alias("changed_value"),
            ),
        )
        for c in names
    ]
    differing = F.filter(F.array(*cells), lambda x: x.isNotNull())
    return before.join(new, row_id).select(quoted(row_id), F.inline(differing))


def audit_entries(changes: DataFrame, action: str, **source: str) -> DataFrame:
    """One audit entry per column, previous and new value, with the number of rows.

    The changed rows themselves stay in `changes` (see `rows_by_id`): a list of them in one
    entry would grow with the table.
    """
    labels = ("sourcepath", "source_id", "source_file", "upload_id")
    return (
        changes.groupBy("column", "previous_value", "changed_value")
        .agg(F.count(F.lit(1)).alias("changed_count"))
        .select(
            *[F.lit(source.get(k)).cast("string").alias(k) for k in labels],
            F.current_timestamp().alias("process_time"),
            F.lit(action).alias("action"),
            "column",
            "previous_value",
            "changed_value",
            "changed_count",
        )
    )


def register_cleaned(registry: DataFrame, entries: DataFrame, key: str = "source_id") -> DataFrame:
    """The registry of cleaned files with one, the newest, entry per source."""
    both = registry.unionByName(entries)
    rest = [c for c in both.columns if c != key]
    newest = F.max_by(F.struct(*[quoted(c) for c in rest]), "process_time")
    return both.groupBy(quoted(key)).agg(newest.alias("_entry")).select(key, "_entry.*")
