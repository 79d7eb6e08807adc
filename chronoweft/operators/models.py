"""Fold-local classifiers on ``pyspark.ml``."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweft import settings
from chronoweft.operators.calendar_splits import CalendarPlan, Fold, role_in

FIT_ROWS = 200_000

EstimatorFactory = Callable[[Sequence[str], int], Estimator]


def logistic_factory(features: Sequence[str], rows: int) -> Pipeline:
    """Scaled logistic regression with unit penalty strength.

    ``1/n`` puts the penalty on the scale of a summed loss; the second factor turns the sample
    deviation used by the scaler into the population deviation.
    """
    penalty = (1.0 / rows) * (rows - 1) / rows
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True),
        LogisticRegression(featuresCol="_x", labelCol="_y", probabilityCol="_p", maxIter=1000,
                           tol=1e-8, regParam=penalty, elasticNetParam=0.0,
                           standardization=False),
    ])


def boosted_factory(trees: int = 300, depth: int = 3, step: float = 0.03,
                    subsample: float = 0.8) -> EstimatorFactory:
    """Gradient-boosted trees with the frozen depth, step size, row sampling and seed."""
    def build(features: Sequence[str], rows: int) -> Pipeline:
        return Pipeline(stages=[
            VectorAssembler(inputCols=list(features), outputCol="_x"),
            GBTClassifier(featuresCol="_x", labelCol="_y", maxIter=trees, maxDepth=depth,
                          stepSize=step, subsamplingRate=subsample, seed=settings.RANDOM_SEED,
                          minInstancesPerNode=5),
        ])

    return build


def score(model: PipelineModel, rows: DataFrame,
          threshold: float = settings.SIGNAL_THRESHOLD) -> DataFrame:
    """Probability of class 1 and the signal for every row."""
    last = model.stages[-1]
    column = last.getProbabilityCol()
    out = model.transform(rows).withColumn(
        "probability_score", vector_to_array(column)[1]
    )
    return out.select(
        *rows.columns, "probability_score",
        (F.col("probability_score") >= threshold).cast("tinyint").alias("signal"),
    )


def fit(rows: DataFrame, features: Sequence[str], factory: EstimatorFactory,
        label: str = "label") -> PipelineModel | float:
    """Fit on all given rows; a single class yields that class as a constant probability.

    Row sampling of boosted trees draws by partition and place, so rows are first put where their values
    say: the partition is a hash of the row, the order within it the row itself. Equal rows are
    interchangeable. The number of partitions follows from the number of rows, not from the cluster.
    """
    classes = {
        int(r[0]): r[1] for r in rows.groupBy(F.col(label)).count().limit(3).collect()
    }
    if not classes or set(classes) - {0, 1}:
        raise ValueError("training labels must be 0 and 1")
    if len(classes) == 1:
        return float(next(iter(classes)))
    n = sum(classes.values())
    return factory(features, n).fit(ordered_rows(rows, features, label, n))


def ordered_rows(rows: DataFrame, features: Sequence[str], label: str, n: int) -> DataFrame:
    """Features and ``_y`` in partitions and an order that only the rows themselves decide."""
    train = rows.select(*features, F.col(label).cast("double").alias("_y"))
    names = train.columns
    placed = train.withColumn("_place", F.xxhash64(*names))
    return placed.repartition(-(-n // FIT_ROWS), "_place").sortWithinPartitions(
        "_place", *names).drop("_place")


def walk_forward(folds: DataFrame, features: Sequence[str], factory: EstimatorFactory, *,
                 keep: Sequence[str], n_splits: int = settings.N_WALK_FORWARD_SPLITS,
                 threshold: float = settings.SIGNAL_THRESHOLD, label: str = "label") -> DataFrame:
    """Out-of-fold predictions: a fresh model per fold, fitted on its training rows only.

    Every fit is a distributed job. ``folds`` should be a written
    table or cached, since each fold reads it.
    """
    def one(fold: int) -> DataFrame:
        here = folds.filter(F.col("fold") == fold)
        return _out_of_fold(here.filter(F.col("role") == "train"),
                            here.filter(F.col("role") == "validation"),
                            features, factory, keep, threshold, label)

    return _together(one, range(1, n_splits + 1))


def pooled_walk_forward(labeled: DataFrame, plan: CalendarPlan, features: Sequence[str],
                        factory: EstimatorFactory, *, keep: Sequence[str],
                        threshold: float = settings.SIGNAL_THRESHOLD,
                        label: str = "label") -> DataFrame:
    """Out-of-fold predictions of one model per fold over all series, along a common calendar.

    Folds are conditions on a row's times, so ``labeled`` (a written table or cached) is filtered in
    place and never copied per fold. A fold that the calendar has no room for raises.
    """
    for fold in plan.folds:
        if not fold.possible:
            raise ValueError(f"fold {fold.number} does not fit into {plan.instants} instants")

    def one(fold: Fold) -> DataFrame:
        rows = labeled.withColumn("fold", F.lit(fold.number))
        role = role_in(plan, fold)
        return _out_of_fold(rows.filter(role == "train"), rows.filter(role == "validation"),
                            features, factory, keep, threshold, label)

    return _together(one, plan.folds)


def _together(one: Callable, folds: Sequence) -> DataFrame:
    """Fit the few folds at the same time: small jobs of one fit leave most executors idle."""
    with ThreadPoolExecutor(len(folds)) as pool:
        parts = list(pool.map(inheritable_thread_target(SparkSession.active())(one), folds))
    return reduce(DataFrame.unionByName, parts)


def _out_of_fold(train: DataFrame, validation: DataFrame, features: Sequence[str],
                 factory: EstimatorFactory, keep: Sequence[str], threshold: float,
                 label: str) -> DataFrame:
    model = fit(train, features, factory, label)
    if isinstance(model, float):
        scored = validation.withColumn("probability_score", F.lit(model)).withColumn(
            "signal", (F.col("probability_score") >= threshold).cast("tinyint"))
    else:
        scored = score(model, validation, threshold)
    return scored.select(
        *keep, "fold", F.col(label).alias("actual_label"), "probability_score", "signal")


def feature_importance(model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """Gain, split count (weight) and covered rows per feature, in schema order; 0 when unused.

    A fitted model is a few hundred small trees of bounded depth; only those are walked.
    """
    trees = model.stages[-1]
    spark = SparkSession.active()
    gains = trees.featureImportances.toArray()
    weight = [0.0] * len(features)
    cover = [0.0] * len(features)

    def visit(node) -> None:
        if node.numDescendants() == 0:
            return
        i = node.split().featureIndex()
        weight[i] += 1.0
        cover[i] += float(node.impurityStats().count())
        visit(node.leftChild())
        visit(node.rightChild())

    for tree in trees._call_java("trees"):
        visit(tree.rootNode())
    rows = [
        (i, f, float(gains[i]), weight[i], cover[i] / weight[i] if weight[i] else 0.0)
        for i, f in enumerate(features)
    ]
    return spark.createDataFrame(
        rows, "position int, feature string, gain double, weight double, cover double"
    )


def top_features(importance: DataFrame, n: int = 10) -> DataFrame:
    """Most important features by gain, then weight."""
    return importance.orderBy(F.desc("gain"), F.desc("weight"), "position").limit(n)


def feature_schema_hash(features: Sequence[str]) -> Column:
    """Digest that binds the order of the feature columns."""
    return F.sha2(F.to_json(F.array(*[F.lit(c) for c in features])), 256)


def ablation_cells(labeled: DataFrame, plan: CalendarPlan, technical: Sequence[str],
                   news: Sequence[str], factories: dict[str, EstimatorFactory], *,
                   keep: Sequence[str]) -> DataFrame:
    """Out-of-fold predictions of every model with and without news columns.

    All cells read the same written table along the same calendar, so rows, folds and labels are
    identical by construction; :func:`cell_differences` proves it on the result.
    """
    cells = []
    for name, factory in factories.items():
        for inputs, columns in (("technical", technical), ("technical_news", [*technical, *news])):
            cells.append(pooled_walk_forward(labeled, plan, columns, factory, keep=keep).select(
                         F.lit(name).alias("model"), F.lit(inputs).alias("inputs"), "*"))
    return reduce(DataFrame.unionByName, cells)


def cell_differences(cells: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Rows that not every cell holds with the same fold and label; empty when matched."""
    n = cells.select("model", "inputs").distinct().agg(F.count(F.lit(1)).alias("_cells"))
    seen = cells.groupBy(*keep, "fold", "actual_label").agg(F.count(F.lit(1)).alias("copies"))
    return seen.crossJoin(F.broadcast(n)).filter("copies <> _cells").drop("_cells")
