"""Fitting, scoring and judging classifiers with Spark ML."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonetide.functions.numeric import round_even
from zonetide.learning.sampling import balanced_weights, oversample, smote, smote_tomek, undersample
from zonetide.learning.splits import stratified_folds, uniform
from zonetide.operators.metrics import evaluate
from zonetide.session import written

VECTOR = "features"
VALIDATION = "is_validation"
#: Says that a label has two classes, also where all rows at hand are of one: trees would fit a model of one class else.
TWO_CLASSES = {"ml_attr": {"type": "binary", "name": "label"}}


def assembled(df: DataFrame, columns: list[str], out: str = VECTOR) -> DataFrame:
    """Feature columns as one vector; flags become 0/1 and missing values 0, as in scoring."""
    typed = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    return VectorAssembler(inputCols=columns, outputCol=out).transform(typed)


def one_hot(columns: list[str]) -> Pipeline:
    """Indexers and an encoder; categories not seen in training become zero vectors."""
    index = StringIndexer(inputCols=columns, outputCols=[f"{c}_index" for c in columns], handleInvalid="keep", stringOrderType="alphabetAsc")
    encode = OneHotEncoder(inputCols=[f"{c}_index" for c in columns], outputCols=[f"{c}_onehot" for c in columns], dropLast=True)
    return Pipeline(stages=[index, encode])


def scaler(out: str = "scaled") -> StandardScaler:
    """Centre and scale by the sample deviation; see :func:`population_factor`."""
    return StandardScaler(inputCol=VECTOR, outputCol=out, withMean=True, withStd=True)


def population_factor(n: int) -> float:
    """Multiply scaled values by this to divide by the population deviation instead."""
    return (n / (n - 1)) ** 0.5


def gradient_boosting(label: str = "label", weight: str = "weight", trees: int = 300, depth: int = 5, validation: str | None = None,
                      tolerance: float = 0.001, **kw) -> GBTClassifier:
    """Boosted trees on balanced weights, 80 % of the rows per tree.

    ``validation`` names a column that is true for rows on which the loss is watched: no tree is added once it falls by less than
    ``tolerance`` of itself, so the number of trees depends on the data.
    """
    watched = {"validationIndicatorCol": validation, "validationTol": tolerance} if validation else {}
    return GBTClassifier(labelCol=label, featuresCol=VECTOR, weightCol=weight, maxIter=trees, maxDepth=depth, stepSize=0.05,
                         subsamplingRate=0.8, seed=42, **watched, **kw)


def decision_tree(label: str = "label", weight: str = "weight", depth: int = 6) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(labelCol=label, featuresCol=VECTOR, weightCol=weight, maxDepth=depth, seed=42)


def random_forest(label: str = "label", weight: str = "weight", trees: int = 50, depth: int = 8) -> RandomForestClassifier:
    return RandomForestClassifier(labelCol=label, featuresCol=VECTOR, weightCol=weight, numTrees=trees, maxDepth=depth, seed=42)


def linear(label: str = "label", weight: str = "weight") -> LogisticRegression:
    return LogisticRegression(labelCol=label, featuresCol=VECTOR, weightCol=weight)


def scores(model, df: DataFrame, out: str = "p") -> DataFrame:
    """Probability of the positive class as a plain column; 0 from a model that has seen negatives only."""
    positive = F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0))
    return model.transform(df).withColumn(out, positive).drop("rawPrediction", "probability", "prediction")


def train(df: DataFrame, columns: list[str], label: str, is_train: str = "is_train", estimator=None):
    """Fit on the training rows with balanced weights. Returns (model, scored holdout).

    An estimator that watches a validation column also sees the holdout, to know when to stop; so does boosting by default.
    """
    rows = assembled(df.withColumns({"label": F.col(label).cast("double"), VALIDATION: ~F.col(is_train)}), columns)
    model = estimator or gradient_boosting(validation=VALIDATION)
    watches = model.hasParam("validationIndicatorCol") and model.isDefined(model.getParam("validationIndicatorCol"))
    fitted = model.fit(balanced_weights(rows if watches else rows.filter(F.col(is_train)), "label"))
    return fitted, scores(fitted, rows.filter(~F.col(is_train))).drop(VALIDATION)


def importance(model, columns: list[str], spark) -> DataFrame:
    """Feature importances, largest first. One entry per feature."""
    values = model.featureImportances.toArray().tolist()
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(float(v)).alias("importance")) for c, v in zip(columns, values)])
    return spark.range(1).select(F.inline(entries)).orderBy(F.col("importance").desc(), "feature")


def selected_features(model, columns: list[str], spark, quantile: float = 0.25) -> DataFrame:
    """Features at or above the given quantile of importance."""
    table = importance(model, columns, spark)
    return table.filter(F.col("importance") >= table.agg(F.percentile("importance", quantile)).scalar())


def isotonic(scored: DataFrame, label: str = "y", score: str = "p") -> tuple:
    """Monotone calibration of four-decimal scores. Returns (model, calibrated rows).

    Rows are first averaged per score, so the fit sees at most 10,001 weighted points.
    """
    points = scored.groupBy(round_even(score).alias("feature")).agg(F.avg(F.col(label).cast("double")).alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
    model = IsotonicRegression(featuresCol="feature", labelCol="label", weightCol="weight").fit(points)
    out = model.transform(scored.withColumn("feature", round_even(score))).withColumnRenamed("prediction", "calibrated").drop("feature")
    return model, out


def _judged(rows: DataFrame) -> bool:
    """Whether the rows are of both classes; an AUC is not defined else."""
    return rows.agg(F.count_distinct("label")).first()[0] > 1


def _auc(value: float, judged: bool) -> Column:
    return F.lit(float(value) if judged else None).cast("double")


def cross_validated(df: DataFrame, columns: list[str], label: str, keys: list[str], estimator=None, grid=None, k: int = 5) -> DataFrame:
    """Mean AUC per parameter setting over stratified folds; null if all rows are of one class."""
    folded = stratified_folds(df.withColumn("label", F.col(label).cast("double")), "label", keys, k)
    # Stored, because every fold and setting reads the rows again.
    rows = written(balanced_weights(assembled(folded, columns), "label").withMetadata("label", TWO_CLASSES), "folds")
    judged = _judged(rows)
    est = estimator or decision_tree()
    maps = grid or ParamGridBuilder().build()
    cv = CrossValidator(estimator=est, estimatorParamMaps=maps, evaluator=BinaryClassificationEvaluator(labelCol="label"), foldCol="fold", numFolds=k)
    fitted = cv.fit(rows)
    entries = [F.struct(F.lit("; ".join(sorted(f"{p.name}={v}" for p, v in m.items())) or "default").alias("setting"), _auc(a, judged).alias("mean_auc"),
                        _auc(s, judged).alias("std_auc")) for m, a, s in zip(maps, fitted.avgMetrics, fitted.stdMetrics)]
    return df.sparkSession.range(1).select(F.inline(F.array(*entries)))


def families(trees: int = 20) -> list[tuple[str, str, object]]:
    """Candidates of a model search: (family, setting, estimator), trees and linear models."""
    out = [("tree", f"maxDepth={d}", decision_tree(depth=d)) for d in (3, 6)]
    out += [("forest", f"maxDepth={d}", random_forest(trees=trees, depth=d)) for d in (5, 8)]
    out += [("gbt", f"maxDepth={d}", gradient_boosting(trees=trees, depth=d)) for d in (3, 5)]
    for r in (0.0, 0.01, 0.1):
        model = linear()
        out.append(("linear", f"regParam={r}", model.copy({model.regParam: r})))
    return out


def search_rounds(candidates: int, k: int, budget: float, keep: int = 3) -> list[tuple[int, float]]:
    """(candidates, share of the rows) of each round of successive halving.

    Every round keeps one in ``keep`` candidates and gives those ``keep`` times the rows, so all rounds cost about the same. ``budget``
    is what all fits together may cost, in fits on all rows; the last round has all rows if the budget allows it.
    """
    sizes = [candidates]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // keep))
    weights = [float(keep) ** (i - len(sizes) + 1) for i in range(len(sizes))]  # 1 for the last round
    cost = sum(n * w for n, w in zip(sizes, weights)) * k
    return [(n, w * min(1.0, budget / cost)) for n, w in zip(sizes, weights)]


def model_search(df: DataFrame, columns: list[str], label: str, keys: list[str], k: int = 5, budget: float = 60.0, candidates=None, keep: int = 3, together: int = 4) -> DataFrame:
    """Leaderboard of model families and settings by mean AUC over ``k`` folds, found by successive halving within a budget.

    All candidates are compared on a share of the rows, the better ones again on more, the last on most. Rows are drawn and folded by
    hashes of their keys, and a round's rows contain those of the round before. ``together`` candidates are fitted at a time. Columns: family, setting, rounds (survived), share (of the
    rows in its last round), mean_auc and std_auc (there; null if those rows are of one class); best first.
    """
    spark = df.sparkSession
    folded = stratified_folds(df.withColumn("label", F.col(label).cast("double")), "label", keys, k)
    weighted = balanced_weights(assembled(folded, columns), "label").withMetadata("label", TWO_CLASSES)
    rows = written(weighted.select(VECTOR, "label", "weight", "fold", uniform(*keys, seed=11).alias("_u")), "folds")
    left, board = list(candidates or families()), {}
    rounds = search_rounds(len(left), k, budget, keep)
    judge = BinaryClassificationEvaluator(labelCol="label")
    for turn, (_, share) in enumerate(rounds, start=1):
        used = rows.filter(F.col("_u") < F.lit(share))
        judged = _judged(used)

        def tried(candidate, used=used, turn=turn, share=share, judged=judged):
            cv = CrossValidator(estimator=candidate[2], estimatorParamMaps=[{}], evaluator=judge, foldCol="fold", numFolds=k)
            fitted = cv.fit(used)
            return candidate[:2], (turn, share, fitted.avgMetrics[0] if judged else 0.0, fitted.stdMetrics[0], judged)

        with ThreadPoolExecutor(together) as pool:
            board.update(pool.map(inheritable_thread_target(spark)(tried), left))
        best = sorted(left, key=lambda c: (-board[c[:2]][2], c[:2]))
        left = best[:rounds[turn][0]] if turn < len(rounds) else []
    entries = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(s).alias("setting"), F.lit(t).alias("rounds"), F.lit(float(h)).alias("share"),
                                 _auc(a, j).alias("mean_auc"), _auc(d, j).alias("std_auc")) for (f, s), (t, h, a, d, j) in board.items()])
    return spark.range(1).select(F.inline(entries)).orderBy(F.col("rounds").desc(), F.col("mean_auc").desc(), "family", "setting")


def learning_curve(df: DataFrame, columns: list[str], label: str, keys: list[str], is_train: str = "is_train",
                   fractions=(0.1, 0.2, 0.35, 0.5, 0.7, 0.85, 1.0), estimator=None) -> DataFrame:
    """Train and holdout AUC over growing shares of the training rows."""
    rows = assembled(df.withColumn("label", F.col(label).cast("double")), columns).withColumn("_u", uniform(*keys, seed=7))
    parts = []
    for f in fractions:
        used = balanced_weights(rows.filter(F.col(is_train) & (F.col("_u") < F.lit(float(f)))), "label")
        model = (estimator or decision_tree()).fit(used)
        a, b = (evaluate(scores(model, part), "label").select("roc_auc", "n_test") for part in (used, rows.filter(~F.col(is_train))))
        parts.append(a.select(F.lit(float(f)).alias("fraction"), F.col("n_test").alias("train_rows"), F.col("roc_auc").alias("train_auc"))
                     .withColumn("test_auc", b.select("roc_auc").scalar()).withColumn("gap", round_even(F.col("train_auc") - F.col("test_auc"))))
    return reduce(DataFrame.unionByName, parts)


def compare_strategies(df: DataFrame, columns: list[str], label: str, key: str, is_train: str = "is_train", estimator=None) -> DataFrame:
    """The same model on plain, weighted, over-, under-sampled and synthetic training rows (with and without Tomek links), best F1 first."""
    rows = df.withColumn("label", F.col(label).cast("double"))
    fit_rows, held = rows.filter(F.col(is_train)), assembled(rows.filter(~F.col(is_train)), columns)
    plain = fit_rows.withColumn("weight", F.lit(1.0))
    sets = {
        "no_balancing": plain,
        "class_weights": balanced_weights(fit_rows, "label"),
        "oversample": oversample(fit_rows, "label", [key]).withColumn("weight", F.lit(1.0)),
        "undersample": undersample(fit_rows, "label", [key]).withColumn("weight", F.lit(1.0)),
        "smote": smote(fit_rows, "label", key, columns).withColumn("weight", F.lit(1.0)),
        "smote_tomek": smote_tomek(fit_rows, "label", key, columns).withColumn("weight", F.lit(1.0)),
    }
    parts = []
    for name, train_rows in sets.items():
        model = (estimator or decision_tree()).fit(assembled(written(train_rows, name), columns))
        parts.append(evaluate(scores(model, held), "label").withColumn("strategy", F.lit(name)))
    out = reduce(DataFrame.unionByName, parts)
    return out.select("strategy", "f1", "precision", "recall", "roc_auc", "average_precision", "best_threshold").orderBy(F.col("f1").desc(), "strategy")


def stability(candidate_scores: DataFrame, active_scores: DataFrame, score: str = "p") -> DataFrame:
    """What the promotion gate needs to know about two models' scores on a holdout table."""
    c = candidate_scores.agg(F.stddev_pop(score).alias("candidate_std"), F.min(score).alias("lowest"), F.max(score).alias("highest"),
                             F.count(score).alias("n_scored"), F.count(F.lit(1)).alias("n_rows"))
    return c.withColumn("active_std", active_scores.agg(F.stddev_pop(score)).scalar())


def save(model, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
