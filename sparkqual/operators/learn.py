"""Model-based imputation and prediction jobs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import kinds
from ..plans.durable import durable
from ..plans.longform import agg_width, quoted
from ..plans.ranks import dense_codes
from ..plans.skew import join_unique
from . import frequency
from .clean import mode_value

# Fixed value: the split of every prediction job.
SPLIT, SEED = [0.8, 0.2], 21
# Bytes of training rows that a task of a fit holds, and of a row besides its values and trees (expected).
TASK_BYTES, ROW_BYTES = 64 << 20, 200
# A target with more classes than this is no classification target, unless the caller allows more.
MAX_CLASSES = 100


def iterative_impute(
    df: DataFrame, columns: Sequence[str], rounds: int = 5, ridge: float = 0.0
) -> DataFrame:
    """Fill numeric nulls from regressions on the other columns, text nulls with the mode.

    Gaps start with the column's mean. A round takes the sums of products of all columns, over the
    rows where each target is known, in one scan that reads the columns asked for only. Every
    target's regression is solved from its sums, and the gaps are filled in order of ascending gaps, each
    with what is filled already. A fitted model is a handful of numbers, applied as a plain expression:
    nothing is stored between rounds. Whole-number columns stay whole; a column without any value
    stays as it is. `ridge` is added to the columns' correlations with themselves.
    """
    numeric = [c for c in columns if c in kinds.numeric_columns(df)]
    words = [c for c in columns if c in kinds.text_columns(df)]
    out = df
    for c in words:
        out = out.withColumn(c, F.coalesce(quoted(c), mode_value(df, c)))
    if not numeric:
        return out
    profile = df.agg(
        *[F.count_if(quoted(c).isNull()).alias(f"gaps_{i}") for i, c in enumerate(numeric)],
        *[F.avg(quoted(c)).alias(f"mean_{i}") for i, c in enumerate(numeric)],
    ).first()
    means = [profile[f"mean_{i}"] for i in range(len(numeric))]
    usable = [i for i, m in enumerate(means) if m is not None]
    order = sorted((i for i in usable if profile[f"gaps_{i}"]), key=lambda i: profile[f"gaps_{i}"])
    names = {i: _free(df, f"_value{i}") for i in usable}
    # Values are kept as distances from the mean, so that sums of products stay exact.
    start = {names[i]: F.coalesce(quoted(numeric[i]).cast("double") - F.lit(means[i]), F.lit(0.0)) for i in usable}

    def filled(frame: DataFrame, models: Sequence[dict[int, tuple[float, dict[int, float]]]]) -> DataFrame:
        frame = frame.withColumns(start)
        for fitted in models:
            for i in order:
                constant, weights = fitted[i]
                guess: Column = F.lit(constant)
                for k, weight in weights.items():
                    guess = guess + F.lit(weight) * F.col(names[k])
                gap = quoted(numeric[i]).isNull()
                frame = frame.withColumn(names[i], F.when(gap, guess).otherwise(F.col(names[i])))
        return frame

    narrow = df.select(*[quoted(numeric[i]) for i in usable])
    models: list[dict[int, tuple[float, dict[int, float]]]] = []
    for _ in range(rounds if len(usable) > 1 and order else 0):
        known = [F.when(quoted(numeric[i]).isNotNull(), F.lit(i)) for i in order]
        rows = filled(narrow, models).withColumn("_target", F.explode(F.array_compact(F.array(*known))))
        models.append(_regressions(rows, names, ridge))
    done = filled(out, models)
    return done.select(
        *[
            F.coalesce(quoted(f.name), (F.col(names[numeric.index(f.name)]) + F.lit(means[numeric.index(f.name)])).cast(f.dataType)).alias(f.name)
            if f.name in numeric and numeric.index(f.name) in names
            else quoted(f.name)
            for f in df.schema
        ]
    )


def _free(df: DataFrame, name: str) -> str:
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def _regressions(rows: DataFrame, names: dict[int, str], ridge: float) -> dict[int, tuple[float, dict[int, float]]]:
    """target -> (constant, weight of each other column), solved from sums of products by target.

    Columns that follow from others share their weight, so a singular system is no error.
    """
    at = list(names)
    value = {i: F.col(n) for i, n in names.items()}
    sums = {"n": F.count(F.lit(1))}
    sums |= {f"s_{i}": F.sum(value[i]) for i in at}
    sums |= {f"p_{i}_{k}": F.sum(value[i] * value[k]) for j, i in enumerate(at) for k in at[j:]}
    found: dict[int, dict[str, float]] = {}
    width, listed = agg_width(rows), list(sums.items())
    for first in range(0, len(listed), width):
        part = rows.groupBy("_target").agg(*[agg.alias(name) for name, agg in listed[first : first + width]])
        for row in part.collect():
            found.setdefault(row["_target"], {}).update(row.asDict())
    out = {}
    for target, row in found.items():
        n = row["n"]
        mean = np.array([row[f"s_{i}"] / n for i in at])
        product = np.array([[row[f"p_{min(i, k)}_{max(i, k)}"] / n for k in at] for i in at])
        spread = product - np.outer(mean, mean)
        scale = np.sqrt(np.clip(np.diag(spread), 0, None))
        scale[scale <= 1e-12 * np.sqrt(np.abs(np.diag(product)) + 1e-300)] = np.inf
        alike = spread / np.outer(scale, scale)
        mine, others = at.index(target), [j for j, i in enumerate(at) if i != target]
        system = alike[np.ix_(others, others)] + ridge * np.eye(len(others))
        weights = np.linalg.lstsq(system, alike[others, mine], rcond=1e-10)[0]
        weights = weights * (scale[mine] if np.isfinite(scale[mine]) else 0.0) / scale[others]
        constant = float(mean[mine] - weights @ mean[others])
        out[target] = (constant, {at[j]: float(w) for j, w in zip(others, weights, strict=True)})
    return out


def _fill_features(df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, list[str], list[str]]:
    words = [c for c in features if c in kinds.nominal_columns(df)]
    numbers = [c for c in features if c in kinds.numeric_columns(df)]
    out = df
    for c in words:
        out = out.withColumn(c, F.coalesce(quoted(c).cast("string"), mode_value(df, c).cast("string")))
    for c in numbers:
        out = out.withColumn(c, F.coalesce(quoted(c).cast("double"), F.lit(0.0)))
    return out, words, numbers


def _encode(df: DataFrame, words: Sequence[str], codes: DataFrame) -> DataFrame:
    """Text columns as their codes; a value the codes do not know becomes -1."""
    for i, c in enumerate(words):
        counts = df.groupBy(quoted(c).alias("_text")).agg(F.count(F.lit(1)).alias("_rows"))
        known = codes.filter(F.col("column") == c).select(F.col("value").alias("_value"), "code")
        keyed = counts.join(known, F.col("_text") == F.col("_value"), "left").select(
            F.col("_text").alias(c),
            F.coalesce(F.col("code").cast("double"), F.lit(-1.0)).alias(f"_code{i}"),
            "_rows",
        )
        df = join_unique(df, keyed, [c], "left", "_rows").drop("_rows")
    return df


def prepare(
    df: DataFrame, target: str, features: Sequence[str] | None = None, max_classes: int = MAX_CLASSES
) -> tuple[DataFrame, DataFrame]:
    """(train, test) with `_features` and `_label` (M1).

    Text nulls take the mode, numeric ones 0; text is label-encoded on the training rows by
    a distributed ranking; features are standardised on the training rows. The split is made
    on a stored table, so both parts stay the same in every later job. A target with more than
    `max_classes` different values (counted exactly) is refused.
    """
    names = list(features or [c for c in kinds.flat_columns(df) if c != target])
    names = [c for c in names if c in kinds.nominal_columns(df) or c in kinds.numeric_columns(df)]
    classes = df.select(quoted(target)).filter(quoted(target).isNotNull()).distinct().count()
    if classes > max_classes:
        raise ValueError(f"{target} has {classes} classes; {max_classes} are allowed")
    labelled = df.filter(quoted(target).isNotNull()).withColumn("_target", quoted(target).cast("string"))
    filled, words, numbers = _fill_features(labelled, names)
    stored = durable(filled)
    # Class names are few (checked above) and taken from all rows, so no class is unseen.
    index = StringIndexer(
        inputCol="_target", outputCol="_label", stringOrderType="alphabetAsc"
    ).fit(stored.select("_target"))
    train, test = stored.randomSplit(SPLIT, SEED)
    if words:
        codes = durable(dense_codes(train, words))
        train, test = durable(_encode(train, words, codes)), durable(_encode(test, words, codes))
    inputs = [f"_code{i}" for i in range(len(words))] + numbers
    steps = Pipeline(
        stages=[
            index,
            VectorAssembler(inputCols=inputs, outputCol="_raw"),
            StandardScaler(inputCol="_raw", outputCol="_features", withMean=True, withStd=True),
        ]
    ).fit(train)
    return steps.transform(train), steps.transform(test)


def spread(train: DataFrame, trees: int = 20) -> DataFrame:
    """`_features` and `_label` of all rows, in parts of which a task of a fit can hold one in TASK_BYTES.

    Stored rows are a few bytes each, but a forest holds how often each tree's sample has a row (4 bytes a
    tree). Rows whose parts are small enough stay where they are.
    """
    narrow = train.select("_features", "_label")
    values = narrow.schema["_features"].metadata["ml_attr"]["num_attrs"]
    most = max(1, TASK_BYTES // (ROW_BYTES + 8 * values + 4 * trees))
    sizes = narrow.groupBy(F.spark_partition_id()).count()
    largest, rows = sizes.agg(F.max("count"), F.sum("count")).first()
    return narrow if (largest or 0) <= most else narrow.repartition(-(-rows // most))


def classifiers(classes: int, trees: int = 20) -> dict[str, object]:
    """Classifiers by name; the two-class ones are wrapped one-against-the-rest."""
    shared = {"featuresCol": "_features", "labelCol": "_label"}
    svc = LinearSVC(maxIter=20, **shared)
    boosted = GBTClassifier(maxIter=10, seed=SEED, **shared)
    two = classes <= 2
    return {
        "LogisticRegression": LogisticRegression(regParam=0.01, **shared),
        "DecisionTree_Classifier": DecisionTreeClassifier(seed=SEED, **shared),
        "RandomForest_Classifier": RandomForestClassifier(numTrees=trees, seed=SEED, **shared),
        "GradientBoosting_Classifier": boosted if two else OneVsRest(classifier=boosted, **shared),
        "SupportVector_Classifier": svc if two else OneVsRest(classifier=svc, **shared),
        "GaussianNaiveBayes": NaiveBayes(modelType="gaussian", **shared),
    }


def _class_labels(prepared: DataFrame) -> list[str]:
    """Class names in code order, from the column's metadata."""
    return list(prepared.schema["_label"].metadata["ml_attr"]["vals"])


def compare_models(
    df: DataFrame,
    target: str,
    features: Sequence[str] | None = None,
    names: Sequence[str] | None = None,
    max_classes: int = MAX_CLASSES,
) -> DataFrame:
    """(model, accuracy): percent right on the held-out rows, best first (M2)."""
    train, test = prepare(df, target, features, max_classes)
    classes = len(_class_labels(train))
    train, test = spread(train), test.select("_features", "_label")
    # Models read the training rows many times.
    train, test = train.persist(), test.persist()
    judge = MulticlassClassificationEvaluator(labelCol="_label", metricName="accuracy")
    found = []
    try:
        for name, model in classifiers(classes).items():
            if names is None or name in names:
                accuracy = judge.evaluate(model.fit(train).transform(test))
                found.append((name, round(100.0 * accuracy, 2)))
    finally:
        train.unpersist()
        test.unpersist()
    return df.sparkSession.createDataFrame(
        sorted(found, key=lambda f: (-f[1], f[0])), "model string, accuracy double"
    )


def feature_importance(
    df: DataFrame,
    target: str,
    features: Sequence[str] | None = None,
    trees: int = 500,
    max_classes: int = MAX_CLASSES,
) -> DataFrame:
    """(feature, importance) of a random forest, least important first (M3)."""
    train, _ = prepare(df, target, features, max_classes)
    names = list(features or [c for c in kinds.flat_columns(df) if c != target])
    words = [c for c in names if c in kinds.nominal_columns(df)]
    numbers = [c for c in names if c in kinds.numeric_columns(df)]
    forest = RandomForestClassifier(featuresCol="_features", labelCol="_label", numTrees=trees, seed=SEED)
    weights = forest.fit(spread(train, trees)).featureImportances.toArray()
    rows = [(c, float(w)) for c, w in zip([*words, *numbers], weights)]
    return df.sparkSession.createDataFrame(
        sorted(rows, key=lambda r: (r[1], r[0])), "feature string, importance double"
    )


def predict_top(df: DataFrame, k: int = 3) -> DataFrame:
    """(column, value, n, rank, share): the most frequent values of a prediction's input (M4)."""
    return frequency.top_shares(df, k=k)


def predict(
    df: DataFrame,
    target: str,
    model: str = "RandomForest_Classifier",
    features: Sequence[str] | None = None,
    max_classes: int = MAX_CLASSES,
) -> DataFrame:
    """The held-out rows with their `Prediction` (M4)."""
    train, test = prepare(df, target, features, max_classes)
    labels = _class_labels(train)
    fitted = classifiers(len(labels))[model].fit(spread(train))
    scored = fitted.transform(test)
    named = IndexToString(inputCol="prediction", outputCol="Prediction_text", labels=labels).transform(scored)
    return named.select(*[quoted(c) for c in df.columns], F.col("Prediction_text").alias("Prediction"))
