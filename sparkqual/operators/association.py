"""Association between columns.

Every measure is a long table (column_i, column_j, value). Pairs of values are counted once
in a cell table; entropies, chi-square and rank statistics are sums over it.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import kinds
from ..functions.values import finite_or_zero, ratio
from ..plans.durable import durable
from ..plans.longform import batches, describe_columns, quoted, union_all
from ..plans.ranks import numeric_counts, running_totals
from ..plans.skew import join_unique

PAIR = ["column_i", "column_j"]
MISSING = ("replace", "drop", "drop_samples", "drop_features", "skip")
# Column pairs counted per scan.
PAIR_BATCH = 60


def handle_missing(
    df: DataFrame, columns: Sequence[str], missing: str, fill: str | float = 0.0
) -> tuple[DataFrame, list[str]]:
    """Apply a missing-value strategy (A28): the frame and the columns that are left.

    replace: fill nulls; drop_samples: rows without nulls; drop_features: columns without
    nulls; drop: leave nulls to be dropped pair by pair; skip: null is a value of its own.
    """
    if missing not in MISSING:
        raise ValueError(f"missing must be one of {MISSING}")
    names = list(columns)
    if missing == "replace":
        number = float(fill) if isinstance(fill, (int, float)) else 0.0
        numeric = [c for c in names if c in kinds.numeric_columns(df)]
        words = [c for c in names if c not in numeric]
        filled = df.select(
            *[F.coalesce(quoted(c), F.lit(number)).alias(c) for c in numeric],
            *[F.coalesce(quoted(c).cast("string"), F.lit(str(fill))).alias(c) for c in words],
        )
        return filled, names
    if missing == "drop_samples":
        return df.select(*[quoted(c) for c in names]).na.drop("any"), names
    if missing == "drop_features":
        nulls = df.agg(*[F.count_if(quoted(c).isNull()).alias(c) for c in names]).first()
        return df, [c for c in names if nulls[c] == 0]
    return df, names


def pair_cells(
    df: DataFrame, pairs: Sequence[tuple[str, str]], cast: str, drop_nulls: bool = True
) -> DataFrame:
    """(column_i, column_j, x, y, n): how often each value pair occurs, for all column pairs."""
    frames = []
    for start in range(0, len(pairs), PAIR_BATCH):
        group = pairs[start : start + PAIR_BATCH]
        cells = [
            F.struct(
                F.lit(at).alias("_at"), quoted(i).cast(cast).alias("x"), quoted(j).cast(cast).alias("y")
            )
            for at, (i, j) in enumerate(group, 1)
        ]
        long = df.select(F.inline(F.array(*cells)))
        if drop_nulls:
            long = long.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
        # Pairs are grouped by their position and named afterwards.
        counts = long.groupBy("_at", "x", "y").agg(F.count(F.lit(1)).alias("n"))
        names = [
            F.element_at(F.array(*[F.lit(p[side]) for p in group]), F.col("_at")).alias(PAIR[side])
            for side in (0, 1)
        ]
        frames.append(counts.select(*names, "x", "y", "n"))
    return union_all(frames)


def _margins(cells: DataFrame) -> DataFrame:
    """(pair, side, value, n, cells): totals per value of either side of each pair."""
    sides = F.array(
        F.struct(F.lit("x").alias("side"), F.col("x").alias("value")),
        F.struct(F.lit("y").alias("side"), F.col("y").alias("value")),
    )
    return (
        cells.select(*PAIR, "n", F.inline(sides))
        .groupBy(*PAIR, "side", "value")
        .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("cells"))
    )


def _mirror(pairs: DataFrame) -> DataFrame:
    """Both directions of a symmetric measure; the diagonal stays single."""
    both = F.array(
        F.struct(F.col("column_i"), F.col("column_j")),
        F.struct(F.col("column_j").alias("column_i"), F.col("column_i").alias("column_j")),
    )
    once = F.slice(both, 1, 1)
    return pairs.select(
        F.inline(F.when(F.col("column_i") == F.col("column_j"), once).otherwise(both)),
        "value",
    )


def correlation(
    df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson"
) -> DataFrame:
    """Square matrix in long form, pairwise complete like a data-frame library.

    A constant column has value 0 with every column, itself included.
    """
    names = list(columns or kinds.numeric_columns(df))
    if not names:
        raise ValueError("no numeric column to correlate")
    pairs = list(itertools.combinations_with_replacement(names, 2))
    # NaN is a missing value in every method.
    floats = [c for c in names if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType))]
    df = df.select(
        *[F.nanvl(quoted(c), F.lit(None).cast("double")).alias(c) if c in floats else quoted(c) for c in names]
    )
    if method == "pearson":
        upper = _pearson(df, pairs)
    elif method == "spearman":
        upper = _spearman(df, pairs)
    elif method == "kendall":
        upper = _with_diagonal(df, names, _kendall(df, [(i, j) for i, j in pairs if i != j])) if len(names) > 1 else _pearson(df, pairs)
    else:
        raise ValueError(f"unknown method {method}")
    return _mirror(upper.withColumn("value", finite_or_zero(F.col("value"))))


def _with_diagonal(df: DataFrame, names: Sequence[str], pairs: DataFrame) -> DataFrame:
    """A column is like itself, unless it has one value or none."""
    return pairs.unionByName(_pearson(df, [(c, c) for c in names]))


def _facts(df: DataFrame, number: dict[str, Column]) -> dict[str, dict]:
    """Mean, nulls, and whether there is only one value, of each column."""
    found = describe_columns(
        df,
        {c: {"mean": F.avg(x), "gaps": F.count_if(x.isNull()), "flat": F.min(x) >= F.max(x)} for c, x in number.items()},
    )
    return {r["column"]: r.asDict() for r in found.collect()}


def _pearson(df: DataFrame, pairs: Sequence[tuple[str, str]], known: dict[str, dict] | None = None) -> DataFrame:
    """Plain sums of values centred on their column mean.

    A first scan finds the means and which columns are complete, unless they are given. Complete
    columns share their sums over all pairs, leaving one product sum per pair.
    """
    names = list(dict.fromkeys(c for pair in pairs for c in pair))
    number = {c: F.nanvl(quoted(c).cast("double"), F.lit(None).cast("double")) for c in names}
    known = _facts(df, number) if known is None else known
    centred = df.select(
        *[(number[c] - F.lit(known[c]["mean"])).alias(f"_x{i}") for i, c in enumerate(names)]
    )
    x = {c: F.col(f"_x{i}") for i, c in enumerate(names)}

    def beside(c: str, other: str) -> Column:
        return F.when(x[other].isNotNull(), x[c]) if known[other]["gaps"] else x[c]

    def value(i: str, j: str) -> Column:
        flat_i, flat_j = (known[c]["flat"] is not False for c in (i, j))
        if i == j or flat_i or flat_j:
            return F.lit(0.0 if flat_i or flat_j else 1.0)
        a, b, n = beside(i, j), beside(j, i), F.count(x[i] * x[j])
        covariance = F.sum(x[i] * x[j]) - ratio(F.sum(a) * F.sum(b), n)
        spread_i = F.sum(a * a) - ratio(F.sum(a) * F.sum(a), n)
        spread_j = F.sum(b * b) - ratio(F.sum(b) * F.sum(b), n)
        return ratio(covariance, F.sqrt(spread_i) * F.sqrt(spread_j))

    frames = []
    for group in batches(df, pairs, 2):
        cells = [
            F.struct(F.lit(i).alias("column_i"), F.lit(j).alias("column_j"), value(i, j).alias("value"))
            for i, j in group
        ]
        frames.append(
            centred.agg(F.count(F.lit(1)).alias("_n"), F.array(*cells).alias("_m")).select(F.inline("_m"))
        )
    return union_all(frames)


def _ranked_cells(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Value-pair cells with ranks and dense codes of both sides, and the ranked margins."""
    cells = durable(pair_cells(df, pairs, "double"))
    margins = _margins(cells).withColumn("one", F.lit(1).cast("bigint"))
    ranked = durable(running_totals(margins, [*PAIR, "side"], "value", ["n", "one"]))
    out = cells
    for side in ("x", "y"):
        keyed = ranked.filter(F.col("side") == side).select(
            *PAIR,
            F.col("value").alias(side),
            (F.col("before_n") + (F.col("n") + 1) / 2).alias(f"rank_{side}"),
            F.col("before_one").alias(f"code_{side}"),
            F.col("cells").alias("_cells"),
        )
        out = join_unique(out, keyed, [*PAIR, side], "inner", "_cells").drop("_cells")
    return out, ranked


def _spearman(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Pearson correlation of mid-ranks.

    A column's ranks are the same in all pairs whose nulls are in the same rows: it is ranked once, and
    one aggregate takes all these pairs. Other pairs are ranked on the rows that both have.
    """
    names = list(dict.fromkeys(c for pair in pairs for c in pair))
    number = {c: F.nanvl(quoted(c).cast("double"), F.lit(None).cast("double")) for c in names}
    apart = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(number[i].isNull() != number[j].isNull()).alias(f"apart_{k}") for k, (i, j) in enumerate(pairs)]
    ).first()
    alike = [p for k, p in enumerate(pairs) if not apart[f"apart_{k}"]]
    others = [p for k, p in enumerate(pairs) if apart[f"apart_{k}"]]
    frames = []
    if alike:
        ranks, known = rank_columns(df, list(dict.fromkeys(c for p in alike for c in p)), apart["rows"])
        frames.append(_pearson(ranks, alike, known))
    if others:
        frames.append(_pairwise_spearman(df, others))
    return union_all(frames)


# Distinct values of a column whose ranks (24 bytes each) are broadcast; more are joined by value.
BROADCAST_RANKS = 500_000


def rank_columns(df: DataFrame, columns: Sequence[str], count: int) -> tuple[DataFrame, dict[str, dict]]:
    """The columns as mid-ranks among their numbers, nulls and NaN as null, and their means, nulls, and
    whether there is only one value. Rows keep no order; there are `count`.

    All columns are ranked together by running totals over ranges of their distinct values. The ranks of
    columns with few of them are looked up in one pass; the others are joined, hot values split.
    """
    at = {c: f"_x{i}" for i, c in enumerate(columns)}
    rows = df.select(
        *[(F.nanvl(quoted(c).cast("double"), F.lit(None).cast("double")) + F.lit(0.0)).alias(x) for c, x in at.items()]
    )
    counts = numeric_counts(rows, list(at.values()))
    ranked = durable(
        running_totals(counts, ["column"], "value", ["n"]).select(
            "column", "value", "n", (F.col("before_n") + (F.col("n") + 1) / 2).alias("rank"), "total_n"
        )
    )
    sums = ranked.groupBy("column").agg(F.count(F.lit(1)).alias("values"), F.max("total_n").alias("n")).collect()
    sizes = {r["column"]: (r["values"], r["n"]) for r in sums}
    known = {}
    for c, x in at.items():
        values, n = sizes.get(x, (0, 0))
        known[c] = {"mean": (n + 1) / 2 if n else None, "gaps": count - n, "flat": values < 2}
    for c, x in at.items():
        own = ranked.filter(F.col("column") == x).select(F.col("value").alias(x), F.col("rank").alias(f"{x}_rank"), "n")
        if sizes.get(x, (0, 0))[0] <= BROADCAST_RANKS:
            rows = rows.join(F.broadcast(own.drop("n")), x, "left")
        else:
            rows = join_unique(rows, own, [x], "left", "n").drop("n")
    return rows.select(*[F.col(f"{x}_rank").alias(c) for c, x in at.items()]), known


def _pairwise_spearman(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Pearson correlation of mid-ranks, from the cells."""
    cells, ranked = _ranked_cells(df, pairs)
    middle = ranked.groupBy(*PAIR).agg(F.max((F.col("total_n") + 1) / 2).alias("_mid"))
    dx, dy = F.col("rank_x") - F.col("_mid"), F.col("rank_y") - F.col("_mid")
    sums = (
        cells.join(middle, PAIR)
        .groupBy(*PAIR)
        .agg(
            F.sum(F.col("n") * dx * dy).alias("xy"),
            F.sum(F.col("n") * dx * dx).alias("xx"),
            F.sum(F.col("n") * dy * dy).alias("yy"),
        )
    )
    return sums.select(*PAIR, ratio(F.col("xy"), F.sqrt(F.col("xx")) * F.sqrt(F.col("yy"))).alias("value"))


def _pairs_of(n: Column) -> Column:
    return n.cast("double") * (n - 1) / 2


def _kendall(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Tau-b without comparing rows with rows.

    Two cells are concordant when both codes of one are smaller. Their x codes agree above
    some bit and differ in it, so for every bit the cells are grouped by the bits above it,
    and a running total over y counts the zero-bit cells below each one-bit cell. Work is
    (cells x bits), and no group is held by one task.
    """
    cells, ranked = _ranked_cells(df, pairs)
    top = ranked.agg(F.max("total_one")).first()[0] or 1
    bits = max(1, int(top - 1).bit_length())
    is_one = F.expr("shiftright(code_x, bit) % 2 = 1")
    by_bit = (
        cells.select(*PAIR, "code_x", "code_y", "n", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("bit"))
        .groupBy(*PAIR, "bit", F.expr("shiftright(code_x, bit + 1)").alias("above"), "code_y")
        .agg(
            F.sum(F.when(~is_one, F.col("n")).otherwise(0)).alias("zero"),
            F.sum(F.when(is_one, F.col("n")).otherwise(0)).alias("one"),
        )
    )
    below = running_totals(by_bit, [*PAIR, "bit", "above"], "code_y", ["zero"])
    concordant = below.groupBy(*PAIR).agg(
        F.sum(F.col("one").cast("double") * F.col("before_zero")).alias("c")
    )
    ties = (
        ranked.groupBy(*PAIR)
        .agg(
            F.sum(F.when(F.col("side") == "x", _pairs_of(F.col("n")))).alias("tx"),
            F.sum(F.when(F.col("side") == "y", _pairs_of(F.col("n")))).alias("ty"),
            F.max("total_n").alias("_size"),
        )
        .withColumn("all", _pairs_of(F.col("_size")))
    )
    same = cells.groupBy(*PAIR).agg(F.sum(_pairs_of(F.col("n"))).alias("txy"))
    # all = c + d + tx + ty - txy
    diff = 2 * F.col("c") - F.col("all") + F.col("tx") + F.col("ty") - F.col("txy")
    scale = F.sqrt(F.col("all") - F.col("tx")) * F.sqrt(F.col("all") - F.col("ty"))
    return ties.join(same, PAIR).join(concordant, PAIR).select(*PAIR, ratio(diff, scale).alias("value"))


def _n_log_n(n: str = "n") -> Column:
    return F.sum(F.col(n) * F.log(F.col(n)))


def entropies(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    missing: str = "replace",
    fill: str | float = 0.0,
) -> DataFrame:
    """(given, target, entropy, conditional, u) for every ordered pair.

    conditional = S(target | given) = S(target, given) - S(given);
    u = (S(target) - S(target | given)) / S(target), and 1 when the target never varies.
    """
    frame, names = handle_missing(df, list(columns or kinds.nominal_columns(df)), missing, fill)
    pairs = list(itertools.combinations(names, 2))
    cells = pair_cells(frame, pairs, "string", drop_nulls=missing != "skip")
    joint = cells.groupBy(*PAIR).agg(F.sum("n").alias("size"), _n_log_n().alias("joint"))
    sides = (
        _margins(cells)
        .groupBy(*PAIR)
        .agg(
            F.sum(F.when(F.col("side") == "x", F.col("n") * F.log("n"))).alias("sx"),
            F.sum(F.when(F.col("side") == "y", F.col("n") * F.log("n"))).alias("sy"),
        )
    )
    size = F.col("size")
    both = F.array(
        F.struct(F.col("column_j").alias("given"), F.col("column_i").alias("target"),
                 F.col("sy").alias("g"), F.col("sx").alias("t")),
        F.struct(F.col("column_i").alias("given"), F.col("column_j").alias("target"),
                 F.col("sx").alias("g"), F.col("sy").alias("t")),
    )
    long = joint.join(sides, PAIR).select("size", "joint", F.inline(both))
    entropy = F.log(size) - F.col("t") / size
    # Sums of equal terms may leave a rounding rest below zero.
    conditional = F.greatest((F.col("g") - F.col("joint")) / size, F.lit(0.0))
    return long.select(
        "given",
        "target",
        entropy.alias("entropy"),
        conditional.alias("conditional"),
        F.when(entropy <= 1e-12, F.lit(1.0))
        .otherwise((entropy - conditional) / entropy)
        .alias("u"),
    )


def theils_u(df: DataFrame, columns: Sequence[str] | None = None, **strategy) -> DataFrame:
    """(column_i, column_j, value): U(column_j | column_i); 0 when either is constant."""
    found = entropies(df, columns, **strategy)
    steady = found.groupBy(F.col("target").alias("c")).agg((F.max("entropy") <= 1e-12).alias("flat"))
    given = steady.select(F.col("c").alias("given"), F.col("flat").alias("flat_given"))
    target = steady.select(F.col("c").alias("target"), F.col("flat").alias("flat_target"))
    flat = F.col("flat_given") | F.col("flat_target")
    square = found.join(given, "given").join(target, "target").select(
        F.col("given").alias("column_i"),
        F.col("target").alias("column_j"),
        F.when(flat, F.lit(0.0)).otherwise(finite_or_zero(F.col("u"))).alias("value"),
    )
    diagonal = steady.select(
        F.col("c").alias("column_i"),
        F.col("c").alias("column_j"),
        F.when(F.col("flat"), F.lit(0.0)).otherwise(F.lit(1.0)).alias("value"),
    )
    return square.unionByName(diagonal)


def cramers_v(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    bias_correction: bool = True,
    missing: str = "replace",
    fill: str | float = 0.0,
) -> DataFrame:
    """(column_i, column_j, value) for unordered pairs, both directions listed.

    chi-square over all cells, empty ones included, is n * (sum o^2 / (r c) - 1); a 2 x 2
    table gets the continuity correction.
    """
    frame, names = handle_missing(df, list(columns or kinds.nominal_columns(df)), missing, fill)
    pairs = list(itertools.combinations(names, 2))
    cells = durable(pair_cells(frame, pairs, "string", drop_nulls=missing != "skip"))
    of_y = cells.groupBy(*PAIR, "y").agg(F.sum("n").alias("c"), F.count(F.lit(1)).alias("_cells"))
    with_c = join_unique(cells, of_y, [*PAIR, "y"], "inner", "_cells")
    of_x = with_c.groupBy(*PAIR, "x").agg(
        F.sum("n").alias("r"), F.sum(F.col("n") * F.col("n") / F.col("c")).alias("s")
    )
    rows = of_x.groupBy(*PAIR).agg(
        F.sum("r").alias("n"),
        F.sum(F.col("s") / F.col("r")).alias("filled"),
        F.count(F.lit(1)).alias("R"),
        F.sum(F.col("r").cast("double") * F.col("r")).alias("rr"),
    )
    cols = of_y.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("K"), F.sum(F.col("c").cast("double") * F.col("c")).alias("cc")
    )
    n, big_r, big_k = F.col("n"), F.col("R"), F.col("K")
    squared = n.cast("double") * n
    phi2 = F.greatest(F.col("filled") - 1, F.lit(0.0))
    # All four deviations of a 2 x 2 table are equal; r1 r2 = (n^2 - sum r^2) / 2.
    margins = (squared - F.col("rr")) / 2 * (squared - F.col("cc")) / 2
    deviation = F.sqrt(phi2 * margins) / n
    moved = ratio(F.greatest(deviation - 0.5, F.lit(0.0)), deviation)
    phi2 = F.when((big_r == 2) & (big_k == 2), phi2 * F.coalesce(moved * moved, F.lit(0.0))).otherwise(phi2)
    if bias_correction:
        phi2 = F.greatest(phi2 - ratio((big_k - 1) * (big_r - 1), n - 1), F.lit(0.0))
        big_r, big_k = (
            big_r - ratio((big_r - 1) * (big_r - 1), n - 1),
            big_k - ratio((big_k - 1) * (big_k - 1), n - 1),
        )
    smaller = F.least(big_k - 1, big_r - 1)
    value = F.when(smaller > 1e-12, F.sqrt(phi2 / smaller))
    return _mirror(
        rows.join(cols, PAIR).select(*PAIR, finite_or_zero(value).alias("value"))
    )


def correlation_ratio(
    df: DataFrame,
    categories: Sequence[str] | None = None,
    numbers: Sequence[str] | None = None,
    missing: str = "replace",
    fill: str | float = 0.0,
) -> DataFrame:
    """(category, number, value): eta for every category x number pair.

    Numbers are centred on their column mean first, so the sums of squares do not cancel.
    """
    cats = list(categories or kinds.nominal_columns(df))
    nums = list(numbers or kinds.numeric_columns(df))
    frame, kept = handle_missing(df, [*cats, *nums], missing, fill)
    cats, nums = [c for c in cats if c in kept], [c for c in nums if c in kept]
    means = frame.agg(
        F.struct(*[F.avg(quoted(c)).alias(f"m{i}") for i, c in enumerate(nums)]).alias("m")
    ).scalar()
    centred = frame.withColumn("_m", means).select(
        *[quoted(c).cast("string").alias(c) for c in cats],
        *[(quoted(c).cast("double") - F.col("_m").getField(f"m{i}")).alias(f"_v{i}") for i, c in enumerate(nums)],
    )
    long = centred.unpivot(
        [f"_v{i}" for i in range(len(nums))], [quoted(c) for c in cats], "category", "value"
    )
    if missing != "skip":
        long = long.filter(F.col("value").isNotNull())
    groups = long.groupBy("category", "value").agg(
        *[F.count(f"_v{i}").alias(f"n{i}") for i in range(len(nums))],
        *[F.avg(f"_v{i}").alias(f"a{i}") for i in range(len(nums))],
        *[F.var_pop(f"_v{i}").alias(f"s{i}") for i in range(len(nums))],
    )
    per_number = F.array(
        *[
            F.struct(
                F.lit(c).alias("number"),
                F.col(f"n{i}").alias("n"),
                F.col(f"a{i}").alias("a"),
                F.col(f"s{i}").alias("s"),
            )
            for i, c in enumerate(nums)
        ]
    )
    n, a = F.col("n"), F.col("a")
    sums = (
        groups.select("category", F.inline(per_number))
        .groupBy("category", "number")
        .agg(
            F.sum(n).alias("n"),
            F.sum(n * a).alias("t"),
            F.sum(n * a * a).alias("q"),
            F.sum(n * F.col("s")).alias("w"),
        )
    )
    between = F.col("q") - ratio(F.col("t") * F.col("t"), F.col("n"))
    total = between + F.col("w")
    eta = F.when(between > 0, F.sqrt(ratio(between, total))).otherwise(F.lit(0.0))
    return sums.select("category", "number", finite_or_zero(eta).alias("value"))


def associations(
    df: DataFrame,
    categories: Sequence[str] | None = None,
    numbers: Sequence[str] | None = None,
    nominal: str = "theil",
    bias_correction: bool = False,
    missing: str = "replace",
    fill: str | float = 0.0,
) -> DataFrame:
    """Mixed matrix in long form (A27): pearson, eta, and Theil's U or Cramer's V by kind.

    For Theil's U, (column_i, column_j) holds U(column_j | column_i).
    """
    cats = list(kinds.nominal_columns(df) if categories is None else categories)
    nums = list(kinds.numeric_columns(df) if numbers is None else numbers)
    strategy = {"missing": missing, "fill": fill}
    frames = []
    if nums:
        frame, kept = handle_missing(df, nums, missing, fill)
        frames.append(correlation(frame, [c for c in nums if c in kept]))
    if cats and nums:
        eta = correlation_ratio(df, cats, nums, **strategy)
        frames.append(
            _mirror(eta.select(F.col("category").alias("column_i"), F.col("number").alias("column_j"), "value"))
        )
    if len(cats) > 1 and nominal == "theil":
        frames.append(theils_u(df, cats, **strategy))
    elif cats:
        frame, _ = handle_missing(df, cats, missing, fill)
        text = {c: quoted(c).cast("string") for c in cats}
        steady = describe_columns(
            frame, {c: {"flat": ~(F.min(text[c]) < F.max(text[c]))} for c in cats}
        )
        frames.append(
            steady.select(
                F.col("column").alias("column_i"),
                F.col("column").alias("column_j"),
                F.when(F.col("flat"), 0.0).otherwise(1.0).alias("value"),
            )
        )
        if len(cats) > 1:
            frames.append(cramers_v(df, cats, bias_correction, **strategy))
    if not frames:
        raise ValueError("no column to associate")
    return union_all(frames)


def top_correlated(matrix: DataFrame, k: int = 10) -> DataFrame:
    """(column, sign, rank, other, value) of the k strongest of either sign.

    `matrix` is a long association table, one row per column pair. A column whose listed
    values are all positive and equal has nothing to rank and is left out.
    """
    pairs = matrix.filter(F.col("column_i") != F.col("column_j"))
    sign = F.when(F.col("value") >= 0, "positive").otherwise("negative")
    order = Window.partitionBy("column_i", "sign").orderBy(F.abs("value").desc(), "column_j")
    listed = (
        pairs.withColumn("sign", sign)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .withColumn("value", F.round("value", 2))
    )
    flat = (
        listed.groupBy(F.col("column_i").alias("_c"))
        .agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
        .filter((F.col("lo") >= 0) & (F.col("lo") == F.col("hi")))
    )
    return listed.join(flat, F.col("column_i") == F.col("_c"), "left_anti").select(
        F.col("column_i").alias("column"), "sign", "rank", F.col("column_j").alias("other"), "value"
    )
