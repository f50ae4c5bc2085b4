"""Deviation regressor and snap classifier: features, training, scoring, importance, cross-validation, persistence."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.functions.scalars import column_or, from_log, log_deviation
from driftline.tables import cut

from . import boosting
from .correct import classifier_correction, hybrid_correction

# Features in their fixed order: fixed values.
NUMERIC = ("glh_accuracy_m", "glh_speed_mps", "nearest_car_distance_m", "nearest_ped_distance_m", "dist_to_nearest_network_m", "nearest_building_m", "n_buildings_50m", "building_area_50m_m2", "n_buildings_100m", "building_area_100m_m2", "corrected_snap_distance_m", "bearing_to_nearest_car_sin", "bearing_to_nearest_car_cos", "bearing_to_nearest_ped_sin", "bearing_to_nearest_ped_cos")
BOOLEAN = ("inside_building",)
CATEGORICAL = ("glh_source", "glh_layer", "corrected_glh_network_kind", "nearest_car_road_class", "nearest_car_form_of_way")
# Training defaults: fixed values; depth, step, shares of rows and columns, least weight and L2 are those of ``Settings``.
TREES, CLASSIFIER_TREES = 600, 400
#: More groups than this are validated by hashed groups of groups.
FOLDS = 32


@dataclass
class Bundle:
    """A fitted model with what is needed to score: feature columns and levels, and the rate of positives of a classifier."""

    model: boosting.Forest
    feature_columns: list[str]
    categorical_levels: dict[str, list[str]] = field(default_factory=dict)
    pos_rate: float | None = None


def levels_of(df: DataFrame) -> dict[str, list[str]]:
    """Distinct levels of each category, sorted, from one aggregate (levels are few)."""
    have = [c for c in CATEGORICAL if c in df.columns]
    if not have:
        return {}
    row = df.agg(*[F.sort_array(F.collect_set(F.col(c).cast("string"))).alias(c) for c in have]).first()
    return {c: list(row[c]) for c in have}


def feature_table(df: DataFrame, categorical_levels: dict[str, list[str]] | None = None) -> tuple[DataFrame, list[str], dict[str, list[str]]]:
    """The frame with its feature columns under ``f`` (a struct), their names, and the levels. Infinite numbers are missing."""
    levels = levels_of(df) if categorical_levels is None else categorical_levels
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)
    columns: dict[str, Column] = {c: finite(column_or(df, c).cast("double")) for c in NUMERIC}
    columns |= {c: F.coalesce(column_or(df, c, F.lit(False)).cast("boolean"), F.lit(False)).cast("double") for c in BOOLEAN}
    for c, own in levels.items():
        text = column_or(df, c, F.lit(None).cast("string")).cast("string")
        columns |= {f"{c}__{level}": F.coalesce(text == level, F.lit(False)).cast("double") for level in own}
    return df.withColumn("f", F.struct(*[v.alias(k) for k, v in columns.items()])), list(columns), levels


def prepare_features(df: DataFrame, categorical_levels: dict[str, list[str]] | None = None, matched_only: bool = True, need_target: bool = True) -> tuple[DataFrame, list[str], dict[str, list[str]]]:
    """Features and target ``y`` = log1p(deviation_m). need_target False: rows without truth stay, to be scored."""
    if matched_only and "matched" in df.columns:
        df = df.where(F.coalesce("matched", F.lit(False)))
    if need_target and "deviation_m" not in df.columns:
        raise KeyError("deviation_m")
    df = df.withColumn("y", log_deviation(column_or(df, "deviation_m")))
    return feature_table(df.where("y is not null") if need_target else df, categorical_levels)


def prepare_classifier_features(df: DataFrame, categorical_levels: dict[str, list[str]] | None = None, snap_required: bool = True, matched_only: bool = True) -> tuple[DataFrame, list[str], dict[str, list[str]]]:
    """Features and label ``y``: 1 where the snap is nearer to the truth. snap_required False keeps every row."""
    if matched_only and "matched" in df.columns:
        df = df.where(F.coalesce("matched", F.lit(False)))
    helped = column_or(df, "corrected_deviation_m") < column_or(df, "deviation_m")
    df = df.withColumn("y", helped.cast("double"))
    return feature_table(df.where("y is not null") if snap_required else df, categorical_levels)


def _columns(prepared: DataFrame, features: list[str]) -> dict[str, Column]:
    """The features of a prepared frame; columns that it lacks are 0."""
    have = set(prepared.schema["f"].dataType.fieldNames())
    return {c: F.col("f").getField(c) if c in have else F.lit(0.0) for c in features}


def train(prepared: DataFrame, features: list[str], levels: dict[str, list[str]], trees: int | None = None, **params) -> Bundle:
    """Boosted regression trees on log1p(deviation_m)."""
    settings = boosting.Settings(trees=trees or TREES, **params)
    return Bundle(boosting.train(prepared, _columns(prepared, features), F.col("y"), settings)[0], features, levels)


def train_classifier(prepared: DataFrame, features: list[str], levels: dict[str, list[str]], trees: int | None = None, **params) -> Bundle:
    """Boosted classification trees; positives weigh as much as negatives where there are both."""
    n, pos = prepared.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    weight = (n - pos) / pos if 0 < pos < n else 1.0
    settings = boosting.Settings(trees=trees or CLASSIFIER_TREES, logistic=True, **params)
    forest = boosting.train(prepared, _columns(prepared, features), F.col("y"), settings, F.when(F.col("y") > 0, F.lit(weight)).otherwise(F.lit(1.0)))[0]
    return Bundle(forest, features, levels, pos / max(n, 1))


def _scored(bundle: Bundle, prepared: DataFrame) -> DataFrame:
    return boosting.predict(prepared, [bundle.model], _columns(prepared, bundle.feature_columns), "prediction")


def predict_deviation(bundle: Bundle, df: DataFrame, out: str = "predicted_deviation_m") -> DataFrame:
    """Metres, never below 0, for every row; levels come from the bundle."""
    prepared, _, _ = prepare_features(df, bundle.categorical_levels, matched_only=False, need_target=False)
    return _scored(bundle, prepared).withColumn(out, from_log(F.col("prediction"))).select(*[c for c in df.columns if c != out], out)


def predict_ensemble(bundles: list[Bundle], df: DataFrame, out: str = "predicted_deviation_m") -> DataFrame:
    """The mean over bundles, each with its own levels."""
    names = [f"_fold_{i}" for i in range(len(bundles))]
    for bundle, name in zip(bundles, names):
        df = predict_deviation(bundle, df, name)
    return df.withColumn(out, reduce(lambda a, b: a + b, map(F.col, names)) / len(names)).drop(*names)


def predict_snap_probability(bundle: Bundle, df: DataFrame, out: str = "snap_helps_prob") -> DataFrame:
    """Probability that the snap helps, for every row."""
    prepared, _, _ = prepare_classifier_features(df, bundle.categorical_levels, snap_required=False, matched_only=False)
    return _scored(bundle, prepared).withColumn(out, 1 / (1 + F.exp(-F.col("prediction")))).select(*[c for c in df.columns if c != out], out)


def apply_model(bundle: Bundle, df: DataFrame, alpha_floor: float = 0.0, alpha_ceil: float = 1.0) -> DataFrame:
    return hybrid_correction(predict_deviation(bundle, df), alpha_floor=alpha_floor, alpha_ceil=alpha_ceil)


def apply_classifier_corrector(bundle: Bundle, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    return classifier_correction(predict_snap_probability(bundle, df), threshold=threshold)


def feature_importance(bundle: Bundle, spark: SparkSession, top_n: int | None = 20) -> DataFrame:
    """feature, gain (the mean over its splits; 0 if unused) and rank from 1, highest first, by name on ties."""
    rows = spark.createDataFrame(list(bundle.model.gains().items()), "feature string, gain double")
    ranked = rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("gain"), "feature")).cast("long"))
    return ranked.where(F.col("rank") <= top_n) if top_n else ranked


def _folds(prepared: DataFrame, by: str, folds: int) -> tuple[DataFrame, int]:
    """The frame with ``fold``: one for each group, in order of name, or, of more than ``folds`` groups, hashed groups of groups. Null is a group."""
    name = F.col(by).cast("string")
    groups = [r[0] for r in prepared.select(name.alias("g")).distinct().orderBy(F.col("g").asc_nulls_first()).limit(folds + 1).collect()]
    if len(groups) > folds:
        return prepared.withColumn("fold", F.pmod(F.xxhash64(name), F.lit(folds)).cast("int")), folds
    fold = F.coalesce(*[F.when(name.eqNullSafe(F.lit(g)), F.lit(i)) for i, g in enumerate(groups)], F.lit(None)) if groups else F.lit(None)
    return prepared.withColumn("fold", fold.cast("int")), len(groups)


def leave_one_out(df: DataFrame, by: str = "volunteer", trees: int | None = None, folds: int = FOLDS, out: str = "predicted_deviation_m", **params) -> tuple[DataFrame, list[Bundle]]:
    """Matched rows with ``fold`` and the prediction of the model trained without their group, and the models.

    All folds are trained in the same jobs over one stored table. Levels are those of all rows: one that a fold does not have is never
    split on there. A single group is trained on nothing and predicted as no deviation.
    """
    prepared, features, levels = prepare_features(df)
    prepared, n = _folds(prepared, by, folds)
    prepared = cut(prepared, "validation")
    columns = _columns(prepared, features)
    forests = boosting.train(prepared, columns, F.col("y"), boosting.Settings(trees=trees or TREES, **params), fold=F.col("fold"), held_out=list(range(n))) if n else []
    scored = boosting.predict(prepared, forests, columns, "prediction", F.col("fold"))
    return scored.withColumn(out, from_log(F.col("prediction"))).drop("prediction", "f"), [Bundle(f, features, levels) for f in forests]


def calibration(scored: DataFrame, predicted: str = "predicted_deviation_m") -> DataFrame:
    """For each fold, and for all (fold null): rows, rows trained on, and Pearson's r of log1p of prediction and deviation."""
    r = F.corr(F.log1p(predicted), F.log1p("deviation_m")).alias("r_log")
    each = scored.groupBy("fold").agg(F.count(F.lit(1)).alias("n_test"), r)
    each = each.withColumn("n_train", F.sum("n_test").over(Window.partitionBy()) - F.col("n_test"))  # a row for each fold
    whole = scored.agg(F.count(F.lit(1)).alias("n_test"), r)
    return each.select("fold", "n_test", "n_train", "r_log").unionByName(whole.select(F.lit(None).cast("int").alias("fold"), "n_test", F.lit(0).cast("long").alias("n_train"), "r_log"))


def save_bundle(bundle: Bundle, prefix: str) -> None:
    """``<prefix>_model`` and ``<prefix>_meta``, each a one-line JSON text, on any file system Spark can write."""
    spark = SparkSession.getActiveSession()
    meta = {"feature_columns": bundle.feature_columns, "categorical_levels": bundle.categorical_levels}
    if bundle.pos_rate is not None:
        meta["pos_rate"] = bundle.pos_rate
    for name, value in (("model", bundle.model.to_dict()), ("meta", meta)):
        spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(f"{prefix}_{name}")


def load_bundle(prefix: str) -> Bundle:
    spark = SparkSession.getActiveSession()
    model, meta = (json.loads(spark.read.text(f"{prefix}_{name}").first()[0]) for name in ("model", "meta"))
    return Bundle(boosting.Forest.from_dict(model), meta["feature_columns"], meta["categorical_levels"], meta.get("pos_rate"))
