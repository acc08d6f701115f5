"""Catalogue, lineage, uploads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.longform import quoted
from ..plans.skew import join_unique

# What an action text says about a lineage event.
LINEAGE_TYPES = (
    ("File Received", "File Storage", "File"),
    ("File storage", "Extract", "Dataset"),
    ("Cleaning Completed-", "Cleaning Process", "Dataset"),
    ("report ", "Report", "Report"),
)


def match_columns(columns: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(column, confidence, catalogue entry): catalogue terms of columns, case ignored.

    100 when the names are equal, 80 when only their case differs; columns without an entry
    are left out. `columns` has `column`; the catalogue has one entry per `Column`.
    """
    terms = catalogue.withColumn("_lower", F.lower("Column"))
    asked = columns.select(F.col("column")).distinct().withColumn("_lower", F.lower("column"))
    confidence = F.when(F.col("a.column") == F.col("t.Column"), 100).otherwise(80)
    rest = [F.col("t." + c) for c in catalogue.columns if c != "Column"]
    return asked.alias("a").join(terms.alias("t"), "_lower").select(
        F.col("a.column").alias("column"),
        F.col("t.Column").alias("entry"),
        confidence.cast("bigint").alias("confidence"),
        *rest,
    )


def catalogue_with_quality(
    catalogue: DataFrame, scores: DataFrame, lineage: DataFrame
) -> DataFrame:
    """Catalogue entries with the mean quality of their column and the number of lineage
    events that touch it (J8). `scores` has (column, overall)."""
    quality = scores.groupBy(F.col("column").alias("_q")).agg(F.avg("overall").alias("quality"))
    touched = (
        lineage.select(F.explode("available_columns").alias("_l"))
        .groupBy("_l")
        .agg(F.count(F.lit(1)).alias("lineage_events"))
    )
    return (
        catalogue.join(quality, F.col("Column") == F.col("_q"), "left")
        .join(touched, F.col("Column") == F.col("_l"), "left")
        .withColumn("lineage_events", F.coalesce("lineage_events", F.lit(0)))
        .drop("_q", "_l")
    )


def catalogue_for_domains(catalogue: DataFrame, domains: Sequence[str]) -> DataFrame:
    """J9"""
    return catalogue.filter(F.col("DataDomain").isin(list(domains)))


def catalogue_for_terms(catalogue: DataFrame, terms: DataFrame) -> DataFrame:
    """Entries whose (BusinessTerm, DataDomain) is asked for."""
    pair = ["BusinessTerm", "DataDomain"]
    return catalogue.join(terms.select(*pair).distinct(), pair, "left_semi")


def upsert(catalogue: DataFrame, entries: DataFrame, key: str = "id") -> DataFrame:
    """A new snapshot in which entries replace those with the same id (K4)."""
    kept = catalogue.join(entries.select(key), key, "left_anti").select(*catalogue.columns)
    return kept.unionByName(entries)


def sources_by_vendor(sources: DataFrame, rules: DataFrame) -> DataFrame:
    """(vendor_type, source_id, path, rule_id): sources with the rules of their vendor type.

    One row per source and rule; the caller groups them where a list is wanted.
    """
    return sources.join(rules, "vendor_type").select("vendor_type", "source_id", "path", "rule_id")


def lineage_event(df: DataFrame, module: str, action: str, **source: str) -> DataFrame:
    """One event for a table, ready to append to the lineage table (K1)."""
    labels = ("sourcepath", "source_id", "source_file", "upload_id")
    return df.sparkSession.range(1).select(
        *[F.lit(source.get(k)).cast("string").alias(k) for k in labels],
        F.current_timestamp().alias("process_time"),
        F.lit(module).alias("module"),
        F.lit(action).alias("action"),
        F.array(*[F.lit(c) for c in df.columns]).alias("available_columns"),
    )


def lineage_type(action: Column, column: str) -> tuple[Column, Column]:
    """(step, kind) of an event for one column, by its action text."""
    step, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, name, holds in reversed(LINEAGE_TYPES):
        hit = F.contains(action, F.lit(text))
        if text.startswith("Cleaning"):
            hit = hit & F.contains(action, F.lit(column))
        step, kind = F.when(hit, name).otherwise(step), F.when(hit, holds).otherwise(kind)
    return step, kind


def lineage_of_column(lineage: DataFrame, column: str) -> DataFrame:
    """Events whose columns contain `column` and whose action tells a step (K2)."""
    step, kind = lineage_type(F.col("action"), column)
    return (
        lineage.filter(F.array_contains("available_columns", column))
        .withColumns({"step": step, "kind": kind})
        .filter(F.col("step").isNotNull())
    )


def latest_uploads(
    uploads: DataFrame, source: str = "source_id", upload: str = "upload_id", ts: str = "upload_ts"
) -> DataFrame:
    """The upload with the largest number per source and calendar day.

    The largest number is kept by partial aggregation; no day of a source is sorted.
    """
    rest = [c for c in uploads.columns if c != source]
    newest = F.max_by(F.struct(*[quoted(c) for c in rest]), quoted(upload).cast("bigint"))
    return (
        uploads.groupBy(quoted(source), F.to_date(quoted(ts)).alias("day"))
        .agg(newest.alias("_u"))
        .select(quoted(source), "day", "_u.*")
    )


def upload_days(uploads: DataFrame, ts: str = "upload_ts") -> DataFrame:
    """Distinct calendar days in order (T5)."""
    return uploads.select(F.to_date(quoted(ts)).alias("day")).distinct().orderBy("day")


def key_values_match(df: DataFrame, column: str, expected: str) -> Column:
    """Scalar sub-query: the multi-source key column holds exactly the expected key (Q23)."""
    c = quoted(column).cast("string")
    return df.agg(
        (F.count(c) > 0) & (F.min(c) == expected) & (F.max(c) == expected) & (F.count(c) == F.count(F.lit(1)))
    ).scalar()


def accept_uploads(history: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Arrivals with `accepted` and `replaces` (Q23).

    Both have source_id, multi_source_key, upload_ts; arrivals also have a reason. A source and key
    hold one upload per day, their slot. Without a reason, the first arrival of a free slot is
    accepted; with one other than "cleansedsource" the last arrival takes the slot, replacing what
    history has and ahead of all plain ones. A cleansed source is always accepted. Arrivals at the
    same time are ordered by their other columns; equal rows are one arrival.
    """
    slot = ["source_id", "multi_source_key", "day"]
    order = ["upload_ts", *[c for c in arrivals.columns if c not in ("source_id", "multi_source_key", "upload_ts")]]
    own = F.struct(*[F.col(c) for c in order])
    waiting = arrivals.distinct().withColumn("day", F.to_date("upload_ts"))
    plain = F.col("reason").isNull() | (F.col("reason") == "")
    replacing = ~plain & (F.col("reason") != "cleansedsource")

    def best(some: Column, columns: Sequence[Column], name: str) -> DataFrame:
        """The first arrival of each slot; a task passes on one per slot."""
        place = F.row_number().over(Window.partitionBy(*slot).orderBy(*columns))
        chosen = waiting.filter(some).withColumn("_place", place).filter("_place = 1")
        return chosen.select(*slot, own.alias(name))

    first = best(plain, [F.col(c).asc() for c in order], "_first")
    last = best(replacing, [F.col(c).desc() for c in order], "_last")
    taken = history.select("source_id", "multi_source_key", F.to_date("upload_ts").alias("day")).distinct()
    known = waiting.groupBy(*slot).agg(F.count(F.lit(1)).alias("_rows"))
    for found in (taken.withColumn("_taken", F.lit(True)), first, last):
        other = found.withColumnsRenamed({c: f"_{c}" for c in slot})
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in slot]
        known = known.join(other, same[0] & same[1] & same[2], "left").drop(*[f"_{c}" for c in slot])
    held = F.coalesce("_taken", F.lit(False))
    wins = F.when(plain, ~held & F.col("_last").isNull() & own.eqNullSafe(F.col("_first")))
    wins = wins.when(replacing, own.eqNullSafe(F.col("_last"))).otherwise(True)
    return (
        join_unique(waiting, known, slot, "left", "_rows")
        .withColumns({"accepted": wins, "replaces": held & replacing & wins})
        .select(*arrivals.columns, "accepted", "replaces")
    )


def apply_uploads(history: DataFrame, accepted: DataFrame) -> DataFrame:
    """The history after accepted arrivals: replaced day entries go, new ones are added (Q23)."""
    slot = ["source_id", "multi_source_key", "_day"]
    replaced = (
        accepted.filter("replaces")
        .select("source_id", "multi_source_key", F.to_date("upload_ts").alias("_day"))
        .distinct()
    )
    dated = history.withColumn("_day", F.to_date("upload_ts"))
    same = [dated[c].eqNullSafe(replaced[c]) for c in slot]
    kept = dated.join(replaced, same[0] & same[1] & same[2], "left_anti").drop("_day")
    new = accepted.filter("accepted").select(*history.columns)
    return kept.unionByName(new)
