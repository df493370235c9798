"""Batch scoring: a fitted Spark ML pipeline or a linear form with given
coefficients, row-failure handling, and per-batch result records."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.columns import cast_or_drop, letters_only
from cadenza.operators.ordinal import ordinal
from cadenza.session import checkpoint


def linear_score(coefficients: dict[str, float], intercept: float,
                 category: tuple[str, dict[str, float]] | None = None) -> Column:
    """``intercept + sum(c_i * x_i) + c[category]`` as one column
    expression (unknown category contributes 0)."""
    expr = F.lit(float(intercept))
    for name, c in coefficients.items():
        expr = expr + F.lit(float(c)) * F.col(name).cast("double")
    if category:
        col, weights = category
        cat = F.lit(0.0)
        for value, w in weights.items():
            cat = F.when(F.col(col) == value, F.lit(float(w))).otherwise(cat)
        expr = expr + cat
    return expr


def train(df: DataFrame, features: list[str], label: str, categorical: list[str] = (),
          regressor=None) -> PipelineModel:
    """Fit index -> one-hot (no dropped level, unknown kept) -> assemble ->
    regressor. Fitting is distributed by Spark ML."""
    stages = []
    cat_out = []
    for c in categorical:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}__idx", handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCol=f"{c}__idx", outputCol=f"{c}__vec", dropLast=False,
                                    handleInvalid="keep"))
        cat_out.append(f"{c}__vec")
    stages.append(VectorAssembler(inputCols=[f for f in features if f not in categorical] + cat_out,
                                  outputCol="features", handleInvalid="keep"))
    stages.append(regressor or LinearRegression(featuresCol="features", labelCol=label,
                                                predictionCol="prediction", solver="auto",
                                                tol=1e-14, maxIter=500))
    return Pipeline(stages=stages).fit(df)


def train_fixed_effects(df: DataFrame, features: list[str], label: str, category: str) -> tuple[Column, DataFrame]:
    """Least squares on ``features`` and one indicator per category, by one
    aggregate: the moments of every category. On deviations from the
    category means the indicators drop out, and the normal equations are as
    many as the features. Returns the score column and the category means
    to join to the rows on ``category`` (:func:`score_fixed_effects`)."""
    x = [*features, label]
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    # sums of deviations from fixed values near the data lose no digits
    near = df.agg(*(F.avg(c).alias(c) for c in x)).first()
    off = [F.col(c).cast("double") - F.lit(near[c] or 0.0) for c in x]
    rows = df.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in x))
    per = rows.groupBy(category).agg(F.count(F.lit(1)).alias("n"), *(F.sum(o).alias(f"s{i}") for i, o in enumerate(off)),
                                     *(F.sum(off[i] * off[j]).alias(f"p{i}_{j}") for i, j in pairs))
    per = checkpoint(per, gather=True)
    within = per.agg(*(F.sum(F.col(f"p{i}_{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n")).alias(f"w{i}_{j}")
                       for i, j in pairs)).first()
    k = len(features)
    a = np.zeros((k + 1, k + 1))
    for i, j in pairs:
        a[i, j] = a[j, i] = within[f"w{i}_{j}"] or 0.0
    weights = np.linalg.lstsq(a[:k, :k], a[:k, k], rcond=None)[0]
    means = per.select(category, *((F.col(f"s{i}") / F.col("n") + F.lit(near[c] or 0.0)).alias(f"_mean_{c}")
                                   for i, c in enumerate(x)))
    out = F.col(f"_mean_{label}")
    for c, w in zip(features, weights):
        out = out + F.lit(float(w)) * (F.col(c) - F.col(f"_mean_{c}"))
    return out, means


def score_fixed_effects(df: DataFrame, model: tuple[Column, DataFrame], category: str,
                        out: str = "predicted") -> DataFrame:
    """Rows with their score; null for a category the fit has not seen."""
    column, means = model
    kept = df.columns
    means = means.withColumnRenamed(category, "_category")
    return (df.join(means, F.col(category).eqNullSafe(F.col("_category")), "left")
            .select(*kept, column.alias(out)))


def score(df: DataFrame, model: PipelineModel, out: str = "predicted") -> DataFrame:
    """Apply a fitted pipeline; keeps the input columns plus ``out``."""
    cols = df.columns
    return model.transform(df).select(*cols, F.col("prediction").alias(out))


def score_rows(raw: DataFrame, model, types: dict[str, str],
               name_col: str | None = None, out: str = "predicted") -> tuple[DataFrame, DataFrame]:
    """Score what can be scored, with a fitted pipeline or a score column: rows that fail the strict cast, or whose
    name breaks the letters-only store rule, are returned separately
    instead of failing the job. Returns (scored, skipped)."""
    kept, dropped = cast_or_drop(raw, types)
    if name_col:
        ok = letters_only(name_col, unicode=False)
        skipped_names = kept.filter(~ok)
        kept = kept.filter(ok)
        dropped = dropped.unionByName(skipped_names, allowMissingColumns=True)
    scored = kept.withColumn(out, model) if isinstance(model, Column) else score(kept, model, out)
    return scored, dropped


def regression_line(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """One-feature least squares per group (slope, intercept, rows)."""
    return df.groupBy(*(by or [])).agg(
        F.regr_slope(F.col(y), F.col(x)).alias("slope"),
        F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
        F.regr_count(F.col(y), F.col(x)).alias("n_rows"))


def batch_summary(scored: DataFrame, file_col: str, score_col: str) -> DataFrame:
    """One row per file: its rows and mean score."""
    return scored.groupBy(file_col).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(score_col).alias("mean_score"))


def batch_rows(scored: DataFrame, file_col: str, order: list[str], key_col: str, features: list[str],
               score_col: str) -> DataFrame:
    """Flat result rows: file, ``position`` (from 1), key, features, score."""
    n = ordinal(scored.select(*dict.fromkeys([file_col, *order, key_col, *features, score_col])),
                [file_col], order, name="position")
    return n.select(*dict.fromkeys([file_col, "position", key_col, *features, score_col]))


def batch_result(scored: DataFrame, file_col: str, order: list[str], key_col: str,
                 score_col: str, batch_size: int = 100) -> DataFrame:
    """Per batch of ``batch_size`` consecutive rows of a file: count, mean
    score and the nested (keys, scores) payload in row order. A batch is
    bounded by ``batch_size``, so nesting never gathers an unbounded
    group."""
    # only what the payload needs is sorted and numbered
    need = dict.fromkeys([file_col, *order, key_col, score_col])
    n = ordinal(scored.select(*need), [file_col], order, name="_rn")
    n = n.withColumn("batch_no", F.floor((F.col("_rn") - 1) / batch_size))
    agg = (n.groupBy(file_col, "batch_no")
           .agg(F.count(F.lit(1)).alias("n_rows"), F.avg(score_col).alias("mean_score"),
                F.array_sort(F.collect_list(F.struct("_rn", F.col(key_col).alias("k"),
                                                     F.col(score_col).alias("s")))).alias("_items")))
    return agg.select(file_col, "batch_no", "n_rows", "mean_score",
                      F.struct(F.transform("_items", lambda e: e["k"]).alias("songs"),
                               F.transform("_items", lambda e: e["s"]).alias("predictions")).alias("payload"))
