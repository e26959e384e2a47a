"""Comparing a minimal and the full preparation scheme on one split.

Models are the standard linear ones of Spark ML, with the penalty expressed in its terms. Their
coefficients live on the driver, so the number of features is checked before fitting.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow import model as M
from furrow.functions.text import normalize_category, quoted, strict_double
from furrow.operators import metrics
from furrow.operators.fit import (
    FittedState,
    category_counts,
    numeric_facts,
    vocabulary,
)

# ---- fixed values: the models' knobs -------------------------------------------------------
LOGISTIC_C = 1.0
LOGISTIC_ITERATIONS = 1_000
RIDGE_ALPHA = 1.0
BASELINE, COMPLETE = "baseline", "complete"
# -------------------------------------------------------------------------------------------
NORMAL, ITERATIVE = "normal", "l-bfgs"


def same_split_check(raw: DataFrame, processed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of `columns` (key and target) that the two frames do not hold equally often.

    One grouped count over both sides; a value shared by many rows is combined before the shuffle.
    """
    def side(df: DataFrame, sign: int) -> DataFrame:
        return df.select(*[quoted(c) for c in columns], F.lit(sign).alias("_sign"))

    both = side(raw, 1).unionAll(side(processed, -1))
    surplus = both.groupBy(*[quoted(c) for c in columns]).agg(F.sum("_sign").alias("surplus"))
    return surplus.where("surplus <> 0")


# ---- features -------------------------------------------------------------------------------

def baseline_features(train: DataFrame, test: DataFrame, roles: Mapping[str, str],
                      features: Sequence[str], target: str,
                      known: FittedState | None = None) -> tuple[DataFrame, DataFrame]:
    """(`features`, target) of the minimal scheme for both parts.

    Numbers get the training median (0 where there is none) and no scaling. Categories get the
    training mode and one indicator per training category; a new category has none set. What
    `known`, a state fitted on the same rows, already tells is not computed again.
    """
    numeric = [c for c in features if roles[c] in M.NUMERIC_ROLES]
    categorical = [c for c in features if c not in numeric]
    fills: dict[str, object] = {
        **_medians(train, numeric, known), **_modes(train, categorical, known)}
    types = {f.name: f.dataType for f in train.schema}
    cells: list[Column] = []
    for i, c in enumerate(features):
        value = (strict_double(quoted(c), types[c]) if c in numeric
                 else normalize_category(quoted(c)))
        cells.append(F.coalesce(value, F.lit(fills[c])).alias(f"_f{i}"))
    filled = [df.select(*cells, quoted(target).alias("_target")) for df in (train, test)]
    texts = [i for i, c in enumerate(features) if c in categorical]
    stages = []
    if texts:
        # The index kept for unseen values is the one the encoder drops: all indicators zero.
        stages = [
            StringIndexer(inputCols=[f"_f{i}" for i in texts], outputCols=[f"_x{i}" for i in texts],
                          handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=[f"_x{i}" for i in texts], outputCols=[f"_h{i}" for i in texts],
                          dropLast=True),
        ]
    parts = [f"_h{i}" if i in texts else f"_f{i}" for i in range(len(features))]
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    fitted = Pipeline(stages=stages).fit(filled[0])
    ready = [fitted.transform(df).select("features", "_target") for df in filled]
    return ready[0], ready[1]


def _medians(train: DataFrame, columns: Sequence[str],
             known: FittedState | None) -> dict[str, float]:
    fills = {}
    for c in known.columns if known else []:
        if c.column in columns and c.dropped == M.ALL_MISSING:
            fills[c.column] = 0.0
        elif c.column in columns and c.imputation == "median":
            fills[c.column] = c.fill_num
    facts = numeric_facts(train, [c for c in columns if c not in fills])
    fills.update({c: f["median"] if f["present"] else 0.0 for c, f in facts.items()})
    return fills


def _modes(train: DataFrame, columns: Sequence[str],
           known: FittedState | None) -> dict[str, str]:
    """Most frequent training value per column."""
    fills = {
        c.column: c.fill_str for c in (known.columns if known else [])
        if c.column in columns and c.imputation == "most_frequent" and not c.truncated
    }
    left = [c for c in columns if c not in fills]
    if left:
        counts = category_counts(train, left)
        found = {r["column"]: r["value"] for r in vocabulary(counts, 1).collect()}
        fills.update({c: found.get(c, M.MISSING_LABEL) for c in left})
    return fills


def complete_features(processed: DataFrame, outputs: Sequence[str], target: str) -> DataFrame:
    """(`features`, target) of the full scheme: the run's output columns as one vector."""
    renamed = processed.select(
        *[quoted(c).cast("double").alias(f"_f{i}") for i, c in enumerate(outputs)],
        quoted(target).alias("_target"))
    assembler = VectorAssembler(inputCols=[f"_f{i}" for i in range(len(outputs))],
                                outputCol="features")
    return assembler.transform(renamed).select("features", "_target")


# ---- models ----------------------------------------------------------------------------------

def fit_logistic(train: DataFrame, test: DataFrame, rows: int) -> DataFrame:
    """(label, prediction) over the test part of an L2 logistic regression with C = 1.

    The penalty of 1/(C*rows) on averaged loss equals C = 1 on summed loss; features are not
    rescaled for it, and the intercept is free.
    """
    labels = StringIndexer(inputCol="_class", outputCol="_label", stringOrderType="alphabetAsc",
                           handleInvalid="error")
    as_text = [df.withColumn("_class", F.col("_target").cast("string")) for df in (train, test)]
    indexed = labels.fit(as_text[0])
    model = LogisticRegression(
        featuresCol="features", labelCol="_label", maxIter=LOGISTIC_ITERATIONS,
        regParam=1.0 / (LOGISTIC_C * rows), elasticNetParam=0.0, standardization=False,
        fitIntercept=True,
    ).fit(indexed.transform(as_text[0]))
    names = F.array(*[F.lit(v) for v in indexed.labels])
    predicted = F.element_at(names, (F.col("prediction") + 1).cast("int"))
    return model.transform(as_text[1]).select(F.col("_class").alias("label"),
                                              predicted.alias("prediction"))


def fit_ridge(train: DataFrame, test: DataFrame, rows: int, solver: str = NORMAL) -> DataFrame:
    """(label, prediction) over the test part of a ridge regression with penalty 1.

    The caller names the solver: the exact one, which takes up to 4,096 features and says so
    beyond them, or the iterative one, which meets it within a tolerance at any width. Spark scales the penalty by the deviation of the label: the population one in its
    normal-equation solver, the sample one in the iterative solver.
    """
    numeric = [df.withColumn("_label", strict_double(F.col("_target"),
                                                     df.schema["_target"].dataType))
               for df in (train, test)]
    deviation = F.stddev_pop("_label") if solver == NORMAL else F.stddev_samp("_label")
    sigma = numeric[0].agg(deviation).head()[0] or 0.0
    model = LinearRegression(
        featuresCol="features", labelCol="_label", elasticNetParam=0.0, standardization=False,
        regParam=RIDGE_ALPHA * sigma / rows, solver=solver,
        fitIntercept=True,
    ).fit(numeric[0])
    return model.transform(numeric[1]).select(F.col("_label").alias("label"), "prediction")


def ridge_line(train: DataFrame, test: DataFrame, feature: str, target: str) -> DataFrame:
    """Ridge on one feature in closed form: one aggregate over train, joined to test as one row."""
    fitted = train.agg(
        F.avg(feature).alias("_x"), F.avg(target).alias("_y"),
        F.covar_pop(feature, target).alias("_xy"), F.var_pop(feature).alias("_xx"),
        F.count(F.lit(1)).alias("_n"),
    ).head()
    slope = fitted["_xy"] * fitted["_n"] / (fitted["_xx"] * fitted["_n"] + RIDGE_ALPHA)
    predicted = F.lit(fitted["_y"]) + (F.col(feature) - fitted["_x"]) * slope
    return test.select(F.col(target).alias("label"), predicted.alias("prediction"))


def score_scheme(train: DataFrame, test: DataFrame, task: str, rows: int,
                 solver: str = NORMAL) -> DataFrame:
    """(metric, value) of one scheme's features under the model of the task."""
    if task == M.CLASSIFICATION:
        return metrics.classification_metrics(fit_logistic(train, test, rows))
    if task == M.REGRESSION:
        return metrics.regression_metrics(fit_ridge(train, test, rows, solver))
    raise M.PreparationError("quick evaluation covers classification and regression")


def scheme_comparison(scores: DataFrame) -> DataFrame:
    """(metric, baseline, complete, delta) out of (scheme, metric, value)."""
    def of(scheme: str) -> Column:
        return F.max(F.when(F.col("scheme") == scheme, F.col("value")))

    return scores.groupBy("metric").agg(
        of(BASELINE).alias("baseline"), of(COMPLETE).alias("complete")
    ).withColumn("delta", F.col("complete") - F.col("baseline"))
