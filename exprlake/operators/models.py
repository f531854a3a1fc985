"""Model fitting: cross-validated linear models, all fitted together, and MLlib pipelines.

Cross-validation needs the same logistic regression fitted on many overlapping
row sets (outer cohort x inner cohort x penalty, or term x fold x penalty).
:func:`exprlake.operators.fitting.fit_many` trains all of them over the same passes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exprlake.operators.fitting import Fitted, Moments, Spec, arrays, fit_many, moments_by_fold
from exprlake.operators.metrics import auroc_auprc
from exprlake.operators.tiles import column_moments, principal_axes, stacked
from exprlake.session import materialize


def score_many(rows: DataFrame, fitted: Sequence[Fitted], keys: Sequence[str]) -> DataFrame:
    """Probabilities of the rows in each model's scoring folds: (keys, fold, model, label, probability)."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", fold string, model string, label double, probability double"
    keys = list(keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            (x, y), fold = arrays(f), f["fold"].to_numpy()
            for g in fitted:
                use = np.isin(fold, g.spec.score)
                if use.any():
                    out = f.loc[use, [*keys, "fold"]].copy()
                    out["model"], out["label"] = g.spec.name, y[use, g.spec.label]
                    out["probability"] = g.probability(x[use])
                    yield out

    return rows.select(*keys, "features", "labels", "fold").mapInPandas(run, schema)


def _name(*parts) -> str:
    return "|".join(str(p) for p in parts)


def select_penalty(predictions: DataFrame) -> DataFrame:
    """Best C per task from inner validation: highest mean AUROC, ties to the smaller C.

    ``model`` reads task|inner|C. Inner folds without an AUROC have no say.
    """
    part = F.split("model", r"\|")
    rows = predictions.select(part[0].alias("task"), part[1].alias("inner"), part[2].cast("double").alias("c"), "label", "probability")
    auc = auroc_auprc(rows, ["task", "inner", "c"], "label", "probability")
    mean = auc.groupBy("task", "c").agg(F.avg("auroc").alias("inner_auroc")).filter("inner_auroc IS NOT NULL")
    best = mean.groupBy("task").agg(F.max_by(F.struct("c", "inner_auroc"), F.struct(F.round("inner_auroc", 12), -F.col("c"))).alias("b"))
    return best.select("task", "b.c", "b.inner_auroc")


def usable(moments: Moments, label: int, exclude: Sequence[str], inner: str) -> bool:
    """Whether an inner round says anything: both classes among what it learns from, and among what it is tried on."""
    return moments.both_classes(label, moments.training(exclude)) and moments.both_classes(label, np.array([moments.folds.index(inner)]))


def chosen(scored: DataFrame, best: DataFrame, tasks: Sequence[str], fallback: float) -> DataFrame:
    """Scores of each task's best C; a task without a usable inner round has been fitted with the fallback alone."""
    part = F.split("model", r"\|")
    final = scored.withColumn("task", part[0]).withColumn("c", part[2].cast("double")).drop("model")
    rest = final.sparkSession.createDataFrame([(t, fallback, None) for t in tasks], "task string, c double, inner_auroc double")
    return final.join(best.union(rest), ["task", "c"])


def leave_one_cohort_out(
    rows: DataFrame, key: str, penalties: Sequence[float] = (0.01, 0.1, 1.0, 10.0), top_variance: int | None = None, fallback: float = 1.0,
) -> DataFrame:
    """Nested leave-one-cohort-out predictions: the penalty of each outer round is chosen on the inner cohorts.

    ``rows`` holds ``key``, ``features``, ``labels`` (one entry) and ``fold`` (the cohort). Inner rounds that learn from or
    are tried on one class only are left out of the choice; where none is left, C is ``fallback``. An outer round whose
    training rows have one class, or none, can't be fitted and has no predictions.
    """
    rows = materialize(rows, "rows")
    moments = moments_by_fold(rows)
    cohorts = moments.folds
    outer = [o for o in cohorts if moments.both_classes(0, moments.training((o,)))]
    inner = [Spec(_name(o, i, c), 0, (o, i), (i,), c) for o in outer for i in cohorts if i != o and usable(moments, 0, (o, i), i) for c in penalties]
    tried = {s.exclude[0] for s in inner}
    final = [Spec(_name(o, "-", c), 0, (o,), (o,), c) for o in outer for c in (penalties if o in tried else (fallback,))]
    fitted = fit_many(rows, [*inner, *final], top_variance, moments=moments)
    best = select_penalty(score_many(rows, fitted[: len(inner)], [key]))
    out = chosen(score_many(rows, fitted[len(inner) :], [key]), best, [o for o in outer if o not in tried], fallback)
    return out.withColumnRenamed("task", "held_out").withColumnRenamed("c", "selected_c")


def term_probes(
    vectors: DataFrame, membership: DataFrame, terms: Sequence[str] | None = None, folds: int = 3,
    penalties: Sequence[float] = (0.1, 1.0, 10.0, 100.0, 1000.0), holdout_tenths: int = 3, fallback: float = 1.0,
) -> DataFrame:
    """One linear probe per term: C by cross-validated AUROC, then metrics on held-out keys.

    Keys are split by hash; the same split serves every term. Without ``terms`` all terms of ``membership`` are probed; those
    without both classes among the training keys have no row.
    """
    from exprlake.operators.splits import hash_bucket

    if terms is None:
        terms = sorted(r["term"] for r in membership.select("term").distinct().collect() if r["term"] is not None)
    sets = membership.select("key", "term").distinct().groupBy("key").agg(F.collect_set("term").alias("t"))
    flags = F.transform(F.split(F.lit("\u0001".join(terms)), "\u0001"), lambda t: F.array_contains(F.coalesce("t", F.array().cast("array<string>")), t).cast("double"))
    b = hash_bucket("key", 10)
    inner = F.pmod(F.xxhash64("key"), F.lit(folds)).cast("string")
    fold = F.when(b < holdout_tenths, "holdout").otherwise(F.concat(F.lit("cv"), inner))
    rows = vectors.join(sets, "key", "left").select("key", F.col("vec").cast("array<double>").alias("features"), flags.alias("labels"), fold.alias("fold"))
    rows = materialize(rows, "rows")
    moments = moments_by_fold(rows)
    cv = [f for f in moments.folds if f != "holdout"]
    known = [j for j in range(len(terms)) if moments.both_classes(j, moments.training(("holdout",)))]
    specs = [
        Spec(_name(terms[j], f, c), j, (f, "holdout"), (f,), c) for j in known for f in cv if usable(moments, j, (f, "holdout"), f) for c in penalties
    ]
    tried = {s.label for s in specs}
    final = [Spec(_name(terms[j], "-", c), j, ("holdout",), ("holdout",), c) for j in known for c in (penalties if j in tried else (fallback,))]
    fitted = fit_many(rows, [*specs, *final], moments=moments)
    best = select_penalty(score_many(rows, fitted[: len(specs)], ["key"]))
    held = chosen(score_many(rows, fitted[len(specs) :], ["key"]), best, [terms[j] for j in known if j not in tried], fallback)
    out = auroc_auprc(held, ["task", "c", "inner_auroc"], "label", "probability")
    return out.withColumnsRenamed({"task": "term", "c": "best_c", "inner_auroc": "cv_auroc"})


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Class weight n / (classes * class size) on every row; rows without a label belong to no class and are left out.

    The aggregated sizes are joined by the label. Spark broadcasts them where they are small, so the rows of a hot label
    aren't shuffled.
    """
    known = df.filter(F.col(label).isNotNull())
    sizes = materialize(known.groupBy(label).agg(F.count(F.lit(1)).alias("_c")), "class-sizes")
    whole = sizes.select(F.struct(F.sum("_c").cast("double").alias("n"), F.count(F.lit(1)).cast("double").alias("k")).alias("s")).scalar()
    weights = sizes.withColumn("_s", whole).select(label, (F.col("_s.n") / (F.col("_s.k") * F.col("_c"))).alias(out))
    return known.join(weights, label)


def out_of_fold(df: DataFrame, pipeline: Pipeline, label: str, folds: int, keep: Sequence[str], parallel: int = 4) -> DataFrame:
    """Fit a pipeline once per fold and score the fold left out; weights are balanced on training rows.

    ``parallel`` folds are fitted at a time, since one fit alone leaves most of a cluster idle. Returns predictions with
    ``probabilities``.
    """
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target
    from pyspark.ml.functions import vector_to_array

    def one(f: int) -> DataFrame:
        return pipeline.fit(balanced_weights(df.filter(F.col("fold") != f), label)).transform(df.filter(F.col("fold") == f))

    with ThreadPool(min(parallel, folds)) as pool:
        fitted = pool.map(inheritable_thread_target(df.sparkSession)(one), range(folds))
    preds = None
    for out in fitted:
        out = out.select(*keep, label, "fold", vector_to_array("probability").alias("probabilities"), F.col("prediction").cast("double").alias("prediction"))
        preds = out if preds is None else preds.unionByName(out)
    return preds


def scaled_pca_logistic(features: str, label: str, components: int = 20, c: float = 1.0, rows: int = 1) -> Pipeline:
    """Standardise, reduce by PCA, multinomial logistic regression."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler

    return Pipeline(stages=[
        StandardScaler(inputCol=features, outputCol="_scaled", withMean=True),
        PrincipalComponents(k=components, inputCol="_scaled", outputCol="_pc"),
        LogisticRegression(featuresCol="_pc", labelCol=label, weightCol="weight", family="multinomial",
                           regParam=1.0 / (c * max(rows, 1)), standardization=False, maxIter=100)])


def edge_classifier(features: str, label: str) -> Pipeline:
    """Linear edge classifier with class weights."""
    from pyspark.ml.classification import LogisticRegression

    return Pipeline(stages=[LogisticRegression(featuresCol=features, labelCol=label, weightCol="weight", regParam=1e-4, maxIter=100)])


def average_repeats(predictions: DataFrame, keys: Sequence[str], probability: str = "probability") -> DataFrame:
    """Mean out-of-fold probability over repeats."""
    return predictions.groupBy(*keys).agg(F.avg(probability).alias(probability), F.count(F.lit(1)).alias("repeats"))


class _TopVarianceParams(HasInputCol, HasOutputCol):
    k = Param(Params._dummy(), "k", "number of components to keep", typeConverter=TypeConverters.toInt)


class TopVarianceSelector(Estimator, _TopVarianceParams):
    """Keeps the k components of largest population variance over the rows it is fitted on."""

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None, k: int = 1000):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "TopVarianceModel":
        col = self.getOrDefault(self.inputCol)
        n, _, (square,) = column_moments(dataset.filter(F.col(col).isNotNull()), [col])
        score = np.where(np.isfinite(square), square / max(n, 1), -np.inf)
        best = np.sort(np.lexsort((np.arange(len(score)), -score))[: self.getOrDefault(self.k)])
        return TopVarianceModel([int(i) for i in best], col, self.getOrDefault(self.outputCol))


class TopVarianceModel(Model, _TopVarianceParams):
    def __init__(self, indices: list[int], inputCol: str, outputCol: str):
        super().__init__()
        self.indices = indices
        self._set(inputCol=inputCol, outputCol=outputCol)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        col = self.getOrDefault(self.inputCol)
        at = F.split(F.lit(",".join(map(str, self.indices))), ",")
        return dataset.withColumn(self.getOrDefault(self.outputCol), F.transform(at, lambda i: F.get(F.col(col), i.cast("int"))))


class PrincipalComponents(Estimator, _TopVarianceParams):
    """Coordinates along the k directions of largest variance of a vector column.

    The columns' products are added up in the tasks and NumPy takes their eigenvectors. MLlib's PCA takes them by the JVM's
    LAPACK, which has failed to converge where several folds were fitted at a time.
    """

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None, k: int = 20):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "PrincipalComponentsModel":
        from pyspark.ml.functions import vector_to_array

        col = self.getOrDefault(self.inputCol)
        _, axes, _, _ = principal_axes(dataset.select(vector_to_array(col).alias("x")), self.getOrDefault(self.k))
        return PrincipalComponentsModel(axes, col, self.getOrDefault(self.outputCol))


class PrincipalComponentsModel(Model, _TopVarianceParams):
    def __init__(self, axes: np.ndarray, inputCol: str, outputCol: str):
        super().__init__()
        self.axes = axes
        self._set(inputCol=inputCol, outputCol=outputCol)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector, vector_to_array

        held = dataset.sparkSession.sparkContext.broadcast(self.axes)

        @F.pandas_udf("array<double>")
        def project(x: pd.Series) -> pd.Series:
            return pd.Series(list(stacked(x) @ held.value)) if len(x) else pd.Series([], dtype=object)

        return dataset.withColumn(self.getOrDefault(self.outputCol), array_to_vector(project(vector_to_array(self.getOrDefault(self.inputCol)))))
