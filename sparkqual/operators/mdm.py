"""Master data: standard layer, standardisation, golden copies, keys."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.formula import to_sql
from ..functions.text import strip
from ..plans.durable import durable
from ..plans.longform import quoted
from ..sources import readers, writers

# The standard layer's column names.
STANDARD_COLUMNS = (
    "PRIMARY ID",
    "ISIN",
    "EXCHANGE",
    "NAME",
    "INDUSTRY SECTOR",
    "INDUSTRY GROUP",
    "CURRENT MARKET CAP",
    "LAST PRICE",
    "NAME OF THE CEO",
    "START DATE OF CEO",
    "CEO COMPENSATION",
    "COMPANY TELEPHONE NUMER",
    "COMPANY WEB ADDRESS",
)



def add_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """F17"""
    return df.withColumnsRenamed({c: prefix + c for c in df.columns})


def strip_prefix(df: DataFrame, width: int = 3) -> DataFrame:
    """Names without their vendor prefix."""
    return df.withColumnsRenamed({c: c[width:] for c in df.columns})


def to_standard_layer(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Columns under their standard names; columns without a mapping keep theirs."""
    renamed = [mapping.get(c, c) for c in df.columns]
    if len(set(renamed)) < len(renamed):
        raise ValueError("two columns map to one standard name")
    return df.withColumnsRenamed(dict(mapping))


def read_mapping(mapping: DataFrame, vendor: str, standard: str) -> dict[str, str]:
    """Vendor name -> standard name from a mapping table (one row per column)."""
    rows = mapping.select(quoted(vendor), quoted(standard)).na.drop().collect()
    return {r[0]: r[1] for r in rows}


def computed_column(df: DataFrame, name: str, expression: str) -> DataFrame:
    """Add a column from expression text; names with blanks go in back quotes."""
    return df.withColumn(name, F.expr(to_sql(expression)))


def _standardised(c: Column, operator: str, value: object) -> Column:
    text = c.cast("string")
    if operator == "trim":
        return strip(text)
    if operator == "toUpperCase":
        return F.upper(text)
    if operator == "toLowerCase":
        return F.lower(text)
    if operator == "toString":
        return text
    if operator == "substring":
        start, length = (int(v) for v in str(value).split(","))
        return F.substring(text, start, length)
    if operator == "concat":
        return F.concat(text, F.lit(str(value)))
    if operator == "replace":
        old, new = str(value).split("=>", 1)
        return F.replace(text, F.lit(old), F.lit(new))
    raise ValueError(f"unknown operation {operator}")


def standardise(
    df: DataFrame, ruleset: Sequence[Mapping], columns: Sequence[str] | None = None
) -> DataFrame:
    """Apply `Format` and `Transformation` rules in order (L14, L15, F19); nulls stay null.

    `value` holds the parameter: `start,length` for substring, the suffix for concat,
    `old=>new` for replace. A transformation is `name = expression`.
    """
    out = df if columns is None else df.select(*[quoted(c) for c in columns])
    for entry in ruleset:
        for rule in entry["rules"]:
            if rule["rule"] == "Format":
                c = _standardised(quoted(entry["column"]), rule["operator"], rule.get("value"))
                out = out.withColumn(entry["column"], c)
            elif rule["rule"] == "Transformation":
                for step in rule["value"]:
                    name, text = step["formulaText"].split("=", 1)
                    out = computed_column(out, name.strip(), text)
            else:
                raise ValueError(f"unknown rule {rule['rule']}")
    return out


def _survivor(x: Column, y: Column, rules: Sequence[Mapping]) -> Column:
    """ANY: first non-null, or one side; DIFF: a side where both exist and differ."""
    out = F.coalesce(x, y)
    for rule in rules:
        kind, value = rule["rule"], rule.get("value") or "NONEMPTY"
        if kind == "ANY":
            out = {"NONEMPTY": F.coalesce(x, y), "S1": x, "S2": y}[value]
        elif kind == "DIFF":
            out = F.when((x != y), {"S1": x, "S2": y}[value]).otherwise(out)
        else:
            raise ValueError(f"unknown merge rule {kind}")
    return out


def _records(source: DataFrame, key: str) -> DataFrame:
    """One whole record per non-null key: the one whose columns have the smallest hash.

    A key that very many records repeat is cut down in the tasks that read them.
    """
    own = F.xxhash64(*[quoted(c) for c in source.columns])
    first = Window.partitionBy(quoted(key)).orderBy("_hash")
    return (
        source.filter(quoted(key).isNotNull())
        .withColumn("_hash", own)
        .withColumn("_place", F.row_number().over(first))
        .filter("_place = 1")
        .drop("_hash", "_place")
    )


def _side_by_side(left: DataFrame, right: DataFrame, key: str, suffixes: Sequence[str]) -> DataFrame:
    """One row per key of either table, and one for each record with a null key, with both tables' other columns.

    A null key matches nothing, so all its records stay. Master records are unique per key;
    should a source repeat one, one of its records stays whole (see `_records`).
    """
    x, y = (
        source.select(quoted(key).alias("_key"), *[quoted(c).alias(c + s) for c in source.columns if c != key])
        for source, s in zip((left, right), suffixes, strict=True)
    )
    both = _records(x, "_key").withColumnRenamed("_key", "_kx").join(
        _records(y, "_key").withColumnRenamed("_key", "_ky"), F.col("_kx") == F.col("_ky"), "full"
    )
    matched = both.withColumn("_key", F.coalesce("_kx", "_ky")).drop("_kx", "_ky")
    alone = x.filter("_key is null").unionByName(y.filter("_key is null"), allowMissingColumns=True)
    return matched.unionByName(alone).withColumnRenamed("_key", key)


def golden_copy(
    s1: DataFrame,
    s2: DataFrame,
    key: str,
    rules: Sequence[Mapping] = (),
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """One record per match key of either source, each column chosen by its rules.

    A null key matches nothing: each such record stays a record of its own. A key that a source
    repeats keeps one of its records whole. Columns without a rule take the first non-null value.
    """
    by_column = {r["column"]: r["rules"] for r in rules}
    shared = [c for c in s1.columns if c != key and c in s2.columns]
    both = _side_by_side(s1, s2, key, ("_x", "_y"))
    merged = both.select(
        quoted(key),
        *[_survivor(quoted(f"{c}_x"), quoted(f"{c}_y"), by_column.get(c, ())).alias(c) for c in shared],
        *[quoted(f"{c}_x").alias(c) for c in s1.columns if c != key and c not in shared],
        *[quoted(f"{c}_y").alias(c) for c in s2.columns if c != key and c not in shared],
    )
    return merged if columns is None else merged.select(*[quoted(c) for c in columns])


def golden_copy_of(sources: Sequence[DataFrame], key: str) -> DataFrame:
    """One record per match key over any number of sources in order of trust.

    Each column takes the non-null value of the first source that has one. Null keys match nothing, so
    each such record stays a record of its own; a key that a source repeats keeps one of its records
    whole, the one with the smallest hash. All sources are grouped by the key together, once: each
    keeps one record of a key in the tasks that read it, and the columns are merged afterwards.
    """
    names = list(dict.fromkeys(c for s in sources for c in s.columns if c != key))
    kinds = [T.StructType([T.StructField(f"c{names.index(f.name)}", f.dataType) for f in s.schema if f.name != key]) for s in sources]
    tagged = []
    for n, source in enumerate(sources):
        own = F.struct(*[quoted(f.name).alias(f"c{names.index(f.name)}") for f in source.schema if f.name != key])
        rows = [own if k == n else F.lit(None).cast(kind) for k, kind in enumerate(kinds)]
        tagged.append(
            source.filter(quoted(key).isNotNull()).select(
                quoted(key).alias("_key"),
                F.lit(n).alias("_source"),
                F.xxhash64(*[quoted(c) for c in source.columns]).alias("_hash"),
                *[r.alias(f"_row{k}") for k, r in enumerate(rows)],
            )
        )
    first = [
        F.min_by(f"_row{n}", F.when(F.col("_source") == n, F.col("_hash"))).alias(f"_row{n}") for n in range(len(sources))
    ]
    grouped = functools.reduce(DataFrame.unionByName, tagged).groupBy("_key").agg(*first)
    merged = grouped.select(
        F.col("_key").alias(key),
        *[
            F.coalesce(*[F.col(f"_row{n}.c{i}") for n, s in enumerate(sources) if c in s.columns]).alias(c)
            for i, c in enumerate(names)
        ],
    )
    alone = [s.filter(quoted(key).isNull()) for s in sources]
    out = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [merged, *alone])
    return out.select(quoted(key), *[quoted(c) for c in names])


def layer_view(
    basic: DataFrame, standard: DataFrame, golden: DataFrame
) -> dict[str, DataFrame]:
    """The three layers side by side, by name."""
    return {"basic": basic, "standard": standard, "golden": golden}


def layer_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, column, before, after): cells that differ between two layers, records that only
    one of them has included (L18). Each layer has one record per key."""
    shared = [c for c in before.columns if c != key and c in after.columns]
    both = _side_by_side(before.select(quoted(key), *[quoted(c) for c in shared]),
                         after.select(quoted(key), *[quoted(c) for c in shared]), key, ("_x", "_y"))
    cells = [
        F.when(
            ~quoted(f"{c}_x").eqNullSafe(quoted(f"{c}_y")),
            F.struct(
                F.lit(c).alias("column"),
                quoted(f"{c}_x").cast("string").alias("before"),
                quoted(f"{c}_y").cast("string").alias("after"),
            ),
        )
        for c in shared
    ]
    differing = F.filter(F.array(*cells), lambda x: x.isNotNull())
    return both.select(quoted(key), F.inline(differing))


# Rows of a sample that shows most combinations to be no key, and combinations a job looks at.
KEY_SAMPLE, KEY_BATCH = 200_000, 256


def candidate_keys(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    limit: int = 10,
    minimal: bool = False,
    max_size: int | None = None,
) -> list[list[str]]:
    """The first `limit` column combinations, smallest first, whose rows are all distinct.

    Combinations of one size are judged together, KEY_BATCH at a time: rows are grouped by each of
    them in one job. Two equal rows of a sample show that a combination is no key, and so is none of
    what else they agree on; those that the sample leaves open are grouped over all rows, in one job
    again. A combination that contains a key is a key (`minimal=True` leaves it out). If whole
    rows repeat there is no key at all. Values are compared by 128 bits of hashes, nulls are equal.
    """
    names = list(columns or df.columns)
    keys: list[list[str]] = []
    hashed = df.select(*[_hashes(df, names, seed).alias(f"h{seed}") for seed in (0, 1)])
    whole = _grouped(hashed, [range(len(names))]).agg(F.sum("n").alias("rows"), F.max("n").alias("most")).first()
    if (whole["most"] or 0) > 1:
        return keys
    rows = whole["rows"] or 0
    sample = durable(hashed if rows <= KEY_SAMPLE else hashed.sample(KEY_SAMPLE / rows, seed=0))
    found: list[set[int]] = []
    agreeing: list[set[int]] = []
    for size in range(1, (max_size or len(names)) + 1):
        combos = itertools.combinations(range(len(names)), size)
        while batch := list(itertools.islice(combos, KEY_BATCH)):
            implied = [any(k <= set(c) for k in found) for c in batch]
            open_ = [c for c, is_key in zip(batch, implied, strict=True) if not is_key]
            open_ = [c for c in open_ if not any(set(c) <= a for a in agreeing)]
            seen = _agreements(sample, open_, len(names)) if open_ else {}
            agreeing = _largest([*agreeing, *seen.values()])
            left = [c for i, c in enumerate(open_) if i not in seen]
            if left and rows > KEY_SAMPLE:
                repeated = _grouped(hashed, left).filter("n > 1").select("combo").distinct().collect()
                gone = {r["combo"] for r in repeated}
                agreeing = _largest([*agreeing, *(set(left[i]) for i in gone)])
                left = [c for i, c in enumerate(left) if i not in gone]
            found += [set(c) for c in left]
            for combo, is_key in zip(batch, implied, strict=True):
                if combo in left or (is_key and not minimal):
                    keys.append([names[i] for i in combo])
                if len(keys) == limit:
                    return keys
    return keys


def _hashes(df: DataFrame, names: Sequence[str], seed: int) -> Column:
    """A hash of each column's value, as an array."""
    return F.array(
        *[F.xxhash64(F.lit(seed), F.lit(i), quoted(c).isNull(), quoted(c)) for i, c in enumerate(names)]
    )


def _grouped(hashed: DataFrame, combos: Sequence[Sequence[int]], *aggs: Column) -> DataFrame:
    """(combo, k0, k1, n, ...): rows grouped by each of the combinations, in one shuffle."""
    listed = ",".join(f"array({','.join(map(str, c))})" for c in combos)
    many = hashed.select("*", F.posexplode(F.expr(f"array({listed})")).alias("combo", "_in"))

    def key(seed: int) -> Column:
        start = F.lit(0).cast("long")
        return F.aggregate("_in", start, lambda x, i: x.bitwiseXOR(F.element_at(f"h{seed}", i + 1)))

    keyed = many.select("combo", key(0).alias("k0"), key(1).alias("k1"), "h0", "h1")
    return keyed.groupBy("combo", "k0", "k1").agg(F.count(F.lit(1)).alias("n"), *aggs)


def _agreements(sample: DataFrame, combos: Sequence[Sequence[int]], width: int) -> dict[int, set[int]]:
    """For each combination that some rows agree on (by position) the most columns that such rows agree on."""
    ends = [
        f(F.element_at(f"h{seed}", i + 1)).alias(f"{f.__name__}{seed}_{i}")
        for seed in (0, 1) for i in range(width) for f in (F.min, F.max)
    ]
    same = [(F.col(f"min0_{i}") == F.col(f"max0_{i}")) & (F.col(f"min1_{i}") == F.col(f"max1_{i}")) for i in range(width)]
    alike = F.array_compact(F.array(*[F.when(s, F.lit(i)) for i, s in enumerate(same)]))
    groups = _grouped(sample, combos, *ends).filter("n > 1").select("combo", alike.alias("alike"))
    most = groups.groupBy("combo").agg(F.max(F.struct(F.size("alike").alias("size"), "alike")).alias("most"))
    return {r["combo"]: set(r["most"]["alike"]) for r in most.collect()}


def _largest(sets: Sequence[set[int]]) -> list[set[int]]:
    """Those that are part of no other."""
    out: list[set[int]] = []
    for s in sorted(sets, key=len, reverse=True):
        if not any(s <= o for o in out):
            out.append(s)
    return out


def candidate_key_table(df: DataFrame, **options) -> DataFrame:
    """`candidate_keys` as a table (position, columns)."""
    keys = candidate_keys(df, **options)
    return df.sparkSession.createDataFrame(
        list(enumerate(keys, 1)), "position int, columns array<string>"
    )


def standardise_file(
    spark: SparkSession, source: str, target: str, ruleset: Sequence[Mapping], overwrite: bool = False
) -> None:
    """Read a file, apply a rule set, write the result."""
    writers.write_csv(standardise(readers.read_path(spark, source), ruleset), target, overwrite)
