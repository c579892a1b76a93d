"""Which features separate the clusters (R4, I1 - I4): relabel the clusters as
classes and read a random forest's feature importances."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString, StringIndexer, StringIndexerModel, VectorAssembler, VectorIndexer
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.operators.features import feature_names
from concord.operators.layout import fixed_layout
from concord.operators.resample import train_test_split
from concord.session import materialize

# The reference's forest settings.
FOREST = dict(impurity="gini", maxDepth=5, numTrees=20, featureSubsetStrategy="auto", seed=5043)


def relabel(predictions: DataFrame, prediction_col: str = "prediction", label_col: str = "label",
            feature_cols: list[str] | None = None) -> DataFrame:
    """Cluster ids become the class label.

    An input column already called ``label`` would make the name ambiguous:
    it is kept as ``input_label``, unless it is one of the features, which
    would leak the answer into the forest -- then we refuse.
    """
    if label_col in predictions.columns:
        if feature_cols and label_col in feature_cols:
            raise ValueError(f"column {label_col!r} is a feature; pick another label column name")
        predictions = predictions.withColumnRenamed(label_col, f"input_{label_col}")
    return predictions.withColumn(label_col, F.col(prediction_col).cast("double")).drop(prediction_col)


def forest(labeled: DataFrame, features_col: str = "features", label_col: str = "label",
           partitions: int | None = None, id_col: str = "point_id", **params):
    """The forest, fitted to a copy of the rows in a fixed layout."""
    p = dict(FOREST)
    p.update(params)
    labeled = fixed_layout(labeled.select(*[c for c in (id_col, features_col, label_col) if c in labeled.columns]),
                           partitions, id_col, features_col)
    return RandomForestClassifier(featuresCol=features_col, labelCol=label_col, **p).fit(labeled)


def rf_importance(labeled: DataFrame, features_col: str = "features", label_col: str = "label",
                  **params) -> DataFrame:
    """(feature_idx, feature, importance), names from the vector metadata."""
    model = forest(labeled, features_col, label_col, **params)
    imp = model.featureImportances.toArray()
    names = feature_names(labeled, features_col)
    rows = [(i, names[i] if i < len(names) else f"f{i}", float(v)) for i, v in enumerate(imp)]
    return labeled.sparkSession.createDataFrame(rows, "feature_idx int, feature string, importance double")


def rf_holdout_score(labeled: DataFrame, id_col: str, features_col: str = "features",
                     label_col: str = "label", train_fraction: float = 0.8, split_seed: int = 5043,
                     **params) -> DataFrame:
    """I4: forest on a stable 80 / 20 split; accuracy and weighted F1 on the held-out part."""
    keep = [id_col, features_col, label_col]
    split = materialize(train_test_split(labeled.select(*keep), id_col, split_seed, train_fraction), "forest-split")
    train = split.where("is_train").drop("is_train")
    test = split.where("NOT is_train").drop("is_train")
    model = forest(train, features_col, label_col, id_col=id_col, **params)
    # predictions are written once for both metrics
    pred = materialize(model.transform(test).select(label_col, "prediction"), "forest-predictions")
    rows = []
    for metric in ("accuracy", "f1"):
        ev = MulticlassClassificationEvaluator(labelCol=label_col, predictionCol="prediction",
                                               metricName=metric)
        rows.append((metric, float(ev.evaluate(pred))))
    return labeled.sparkSession.createDataFrame(rows, "metric string, value double")


def fold_of(id_col: str, folds: int, seed: int = 5043) -> Column:
    """Cross-validation fold of a row, a function of its id: md5('fold:seed:id') mod folds (first 7 hex digits)."""
    digest = F.md5(F.concat_ws(":", F.lit("fold"), F.lit(str(seed)), F.col(id_col).cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 7), 16, 10).cast("int"), F.lit(folds))


def rf_cross_validate(labeled: DataFrame, id_col: str, features_col: str = "features", label_col: str = "label",
                      depths=(3, 5), trees=(10, 20), folds: int = 3, seed: int = 5043,
                      partitions: int | None = None) -> DataFrame:
    """I4: k-fold cross-validation over a small grid; (max_depth, num_trees, accuracy).

    Folds follow from the ids (``fold_of``) and the rows are written once in a
    fixed layout, so neither moves with partitioning."""
    rows = labeled.select(id_col, features_col, label_col, fold_of(id_col, folds, seed).alias("__fold"))
    labeled = fixed_layout(rows, partitions, id_col, features_col)
    rf = RandomForestClassifier(featuresCol=features_col, labelCol=label_col, impurity="gini",
                                featureSubsetStrategy="auto", seed=seed)
    grid = ParamGridBuilder().addGrid(rf.maxDepth, list(depths)).addGrid(rf.numTrees, list(trees)).build()
    ev = MulticlassClassificationEvaluator(labelCol=label_col, metricName="accuracy")
    cv = CrossValidator(estimator=rf, estimatorParamMaps=grid, evaluator=ev, numFolds=folds,
                        foldCol="__fold", seed=seed, parallelism=min(4, len(grid))).fit(labeled)
    rows = [(int(pm[rf.maxDepth]), int(pm[rf.numTrees]), float(m))
            for pm, m in zip(grid, cv.avgMetrics)]
    return labeled.sparkSession.createDataFrame(rows, "max_depth int, num_trees int, accuracy double")


def class_pipeline(categorical: list[str], numeric: list[str], label: str, max_categories: int = 32, **params) -> Pipeline:
    """I4: one ML pipeline from raw columns to the predicted class name.

    String columns and the label are indexed, all features assembled, slots with
    few values made categorical, the forest fitted, and its prediction turned back
    into the label's name (``predicted``).  A value not seen in training gets an
    index of its own.  The fitted pipeline is saved and loaded as one
    (``sources.models``)."""
    index = [StringIndexer(inputCol=c, outputCol=f"{c}__idx", handleInvalid="keep") for c in categorical]
    target = StringIndexer(inputCol=label, outputCol="__label", handleInvalid="skip")
    gather = VectorAssembler(inputCols=[*[f"{c}__idx" for c in categorical], *numeric], outputCol="__raw")
    slots = VectorIndexer(inputCol="__raw", outputCol="__features", maxCategories=max_categories, handleInvalid="keep")
    trees = RandomForestClassifier(featuresCol="__features", labelCol="__label", predictionCol="__prediction", **{**FOREST, **params})
    return Pipeline(stages=[*index, target, gather, slots, trees])


def fit_class_pipeline(rows: DataFrame, categorical: list[str], numeric: list[str], label: str, id_col: str,
                       partitions: int | None = None, **params) -> PipelineModel:
    """The fitted pipeline with the stage that names the classes; ``rows`` are laid out by their id first."""
    laid = fixed_layout(rows.select(id_col, *categorical, *numeric, label), partitions, id_col)
    fitted = class_pipeline(categorical, numeric, label, **params).fit(laid)
    names = next(s.labels for s in fitted.stages if isinstance(s, StringIndexerModel) and s.getOutputCol() == "__label")
    return PipelineModel([*[s for s in fitted.stages if not (isinstance(s, StringIndexerModel) and s.getOutputCol() == "__label")],
                          IndexToString(inputCol="__prediction", outputCol="predicted", labels=names)])


def predict_classes(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` (a label column is not needed) with ``predicted``; the pipeline's own columns are dropped."""
    return model.transform(rows).select(*rows.columns, "predicted")
