"""The cohort model: scaling, PCA to a share of variance, L1 logistic regression, leave-one-dataset-out."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import PCA, ElementwiseProduct, StandardScaler, VarianceThresholdSelector, VarianceThresholdSelectorModel, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import evaluate, search
from tessera.sources.stage import stage_table

#: The grids of the search (twelve shares of variance, as a half-open range of thousandths gives them).
VARIANCES = [round(0.987 + 0.001 * i, 3) for i in range(12)]
STRENGTHS = [0.04, 0.05, 0.06, 0.07, 0.08, 0.09, 0.1, 0.2]


def row_scale(rows: DataFrame, col: str = "features") -> DataFrame:
    """Each sample less its mean over its population deviation; centred only if that is 0."""
    # Per-row numbers enter the lambdas as arrays: a lambda evaluates what it captures for every element.
    x, n = F.col(col), F.size(col)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, e: a + e)
    off = F.zip_with(x, F.array_repeat(F.try_divide(total(x), n), n), lambda v, m: v - m)
    sd = F.sqrt(F.try_divide(total(F.transform(off, lambda v: v * v)), n))
    return rows.withColumn(col, F.zip_with(off, F.array_repeat(F.when(sd > 0, sd).otherwise(1.0), n), lambda v, s: v / s))


def varying(rows: DataFrame):
    """Fitted selector, raw to kept, of the features that vary."""
    return VarianceThresholdSelector(featuresCol="raw", outputCol="kept", varianceThreshold=0.0).fit(rows)


def kept_features(rows: DataFrame, col: str = "features") -> DataFrame:
    """Positions whose values vary, as :func:`train` keeps them."""
    found = varying(rows.withColumn("raw", array_to_vector(col))).selectedFeatures
    return rows.sparkSession.createDataFrame([(int(i),) for i in found], "pos int")


def scaler(inputs: str, outputs: str, n: int, width: int) -> list:
    """Steps that centre columns and divide them by their population deviation (StandardScaler has the sample's)."""
    scale = StandardScaler(inputCol=inputs, outputCol=f"{outputs}_sample", withMean=True, withStd=True)
    return [scale, ElementwiseProduct(inputCol=f"{outputs}_sample", outputCol=outputs, scalingVec=Vectors.dense([(n / max(1, n - 1)) ** 0.5] * width))]


def column_scale(rows: DataFrame, key: str, col: str = "features") -> DataFrame:
    """(key, pos, value): features less their mean over their population deviation, as :func:`train` scales them."""
    rows = rows.withColumn("raw", array_to_vector(col))
    first = rows.select(F.count(F.lit(1)).alias("n"), F.max(F.size(col)).alias("w")).head()
    out = Pipeline(stages=scaler("raw", "scaled", int(first["n"]), int(first["w"] or 0))).fit(rows).transform(rows)
    return out.select(key, F.posexplode(vector_to_array("scaled")).alias("pos", "value"))


@dataclass
class CohortModel:
    """Fitted steps, in order, with their parameters."""

    select: object
    steps: PipelineModel
    classifier: object
    variance: float
    strength: float
    components: int

    def prepare(self, rows: DataFrame) -> DataFrame:
        v = self.select.transform(rows.withColumn("raw", array_to_vector("features")))
        v = row_scale(v.withColumn("features", vector_to_array("kept")))
        return self.steps.transform(v.withColumn("scaled_rows", array_to_vector("features")))

    def predict(self, rows: DataFrame) -> DataFrame:
        """*rows* with score, the probability of class 1."""
        keep = [c for c in rows.columns if c != "features"]
        return self.classifier.transform(self.prepare(rows)).select(*keep, vector_to_array("probability")[1].alias("score"))

    def coefficients(self) -> list[float]:
        return [float(x) for x in self.classifier.coefficients]

    def save(self, path: str) -> None:
        """Write the fitted steps and the parameters below *path*."""
        for name in ("select", "steps", "classifier"):
            getattr(self, name).write().overwrite().save(f"{path}/{name}")
        SparkSession.active().createDataFrame([(float(self.variance), float(self.strength), int(self.components))], "variance double, strength double, components int").coalesce(1).write.mode("overwrite").json(f"{path}/parameters")

    @classmethod
    def load(cls, path: str) -> CohortModel:
        p = SparkSession.active().read.schema("variance double, strength double, components int").json(f"{path}/parameters").head()
        steps = VarianceThresholdSelectorModel.load(f"{path}/select"), PipelineModel.load(f"{path}/steps"), LogisticRegressionModel.load(f"{path}/classifier")
        return cls(*steps, p["variance"], p["strength"], p["components"])

    def summary(self) -> dict[str, float]:
        c = self.coefficients()
        return {"nonzero": sum(x != 0 for x in c), "min": min(c), "max": max(c), "intercept": float(self.classifier.intercept)}


def compare(models: dict[str, CohortModel], rows: DataFrame) -> DataFrame:
    """(model, nonzero, min, max, intercept, mean_score) of several models: active coefficients, the ends of all, and the mean
    probability that each gives *rows*."""
    spark, out = rows.sparkSession, None
    for name, m in models.items():
        s = m.summary()
        part = m.predict(rows).agg(F.avg("score").alias("mean_score"))
        part = part.select(F.lit(name).alias("model"), *[F.lit(s[c]).alias(c) for c in ("nonzero", "min", "max", "intercept")], "mean_score")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "model string, nonzero int, min double, max double, intercept double, mean_score double")


def train_grid(rows: DataFrame, points: list[tuple[float, float]], group: str | None = "dataset", iterations: int = 200, parallelism: int = 8) -> list[CohortModel]:
    """A model for each of *points* (variance, C), as :func:`train` has it. What comes before the components
    is fitted once, and points that keep equally many components share their fit. *parallelism* fits run at
    once: each is many small Spark jobs, which alone would leave most of a cluster idle."""
    rows = rows.withColumn("raw", array_to_vector("features"))
    select = varying(rows)
    v = row_scale(select.transform(rows).withColumn("features", vector_to_array("kept"))).withColumn("scaled_rows", array_to_vector("features"))
    v = evaluate.balanced_weights(v, group) if group else v.withColumn("weight", F.lit(1.0))
    v = v.cache()
    try:
        n, width = v.count(), len(select.selectedFeatures)
        columns = Pipeline(stages=scaler("scaled_rows", "scaled", n, width)).fit(v)
        pca = PCA(k=min(width, max(1, n - 1)), inputCol="scaled", outputCol="all_components").fit(columns.transform(v))
        shares = [float(x) for x in pca.explainedVariance]

        def needed(variance: float) -> int:
            total, k = 0.0, 0
            for k, share in enumerate(shares, 1):
                total += share
                if total >= variance:
                    break
            return k

        inputs, fits = {}, {}
        try:
            for k in sorted({needed(p) for p, _ in points}):
                slicer = VectorSlicer(inputCol="all_components", outputCol="components", indices=list(range(k)))
                steps = Pipeline(stages=[columns, pca, slicer, *scaler("components", "x", n, k)]).fit(v)
                inputs[k] = steps, steps.transform(v).select("x", "y", "weight").cache()

            def fit(at: tuple[int, float]):
                k, c = at
                lr = LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight", elasticNetParam=1.0, regParam=1.0 / (c * n), standardization=False, maxIter=iterations, tol=1e-6)
                return lr.fit(inputs[k][1])

            todo = sorted({(needed(p), c) for p, c in points})
            with ThreadPool(min(parallelism, len(todo))) as pool:
                for at, lr in zip(todo, pool.map(inheritable_thread_target(rows.sparkSession)(fit), todo, chunksize=1), strict=True):
                    fits[at] = inputs[at[0]][0], lr
        finally:
            for _, x in inputs.values():
                x.unpersist()
        return [CohortModel(select, *fits[needed(p), c], p, c, needed(p)) for p, c in points]
    finally:
        v.unpersist()


def train(rows: DataFrame, variance: float, strength: float, group: str | None = "dataset", iterations: int = 200) -> CohortModel:
    """Fit to (features, y[, dataset]): varying features, rows scaled, columns scaled, the fewest principal
    components that explain *variance*, those scaled, then L1 logistic regression of inverse strength C.
    Datasets weigh alike. The penalty per row is 1 / (C * sum of weights); the weights sum to the rows."""
    return train_grid(rows, [(variance, strength)], group, iterations)[0]


def folds(rows: DataFrame, group: str = "dataset") -> list[str]:
    """The datasets in order; there are as many models as datasets, so they come to the driver."""
    return [r[0] for r in rows.select(group).distinct().orderBy(group).collect()]


def components_needed(rows: DataFrame, variances: list[float]) -> DataFrame:
    """(variance, components): the fewest principal components of the scaled features that explain each share."""
    data = search.Scans(rows.withColumn("__all", F.lit(0)), ["__all"])
    try:
        whole = search.Fold(0, frozenset())
        space = search.spaces(data, [whole])[whole]
        return rows.sparkSession.createDataFrame([(p, space.needed(p)) for p in variances], "variance double, components int")
    finally:
        data.close()


def _inner_folds(rows: DataFrame, group: str, seed: int) -> tuple[DataFrame, list[str], list[tuple[search.Fold, object]]]:
    """Rows, columns of groups, and (fold, held group): one dataset left out in turn; with a single dataset 50 folds, a
    fifth of the rows ten times over, dealt so that classes are in every fold alike."""
    names = folds(rows, group)
    if len(names) >= 2:
        return rows, [group], [(search.Fold(0, frozenset([d])), d) for d in names]
    rows, columns = search.stratified(rows, 5, [seed + r for r in range(10)]), [f"fold{r}" for r in range(10)]
    return rows, columns, [(search.Fold(r, frozenset([k])), k) for r in range(10) for k in range(5)]


def _grid_scores(data: search.Scans, inner: list[tuple[int, search.Fold, object]], variances: list[float], strengths: list[float]) -> DataFrame:
    """(outer, C, variance, fold, score): the balanced accuracy at each fold's best threshold, for (outer, fold, held group)."""
    spark, space = data.spark, search.spaces(data, [f for _, f, _ in inner])
    fits = search.fit_all(data, space, [(f, space[f].needed(p), c) for _, f, _ in inner for p in variances for c in strengths])
    asked, place = [], {}
    for _, f, held in inner:
        for k in sorted({space[f].needed(p) for p in variances}):
            for c in strengths:
                if (f, held, k, c) not in place:
                    place[f, held, k, c] = len(asked)
                    asked.append((len(asked), fits[f, k, c], held))
    scored = stage_table(search.held_out_scores(data, space, asked), "scores")
    best = evaluate.max_j(scored, ["name"]).select("name", "threshold")
    rates = evaluate.confusion(scored.join(F.broadcast(best), "name"), F.col("threshold"), ["name"])  # a row a fit
    got = {r["name"]: float(r["balanced_accuracy"]) for r in rates.select("name", "balanced_accuracy").collect()}
    out = [
        (outer, float(c), float(p), i, got[place[f, held, space[f].needed(p), c]])
        for i, (outer, f, held) in enumerate(inner) for p in variances for c in strengths if place[f, held, space[f].needed(p), c] in got
    ]
    return spark.createDataFrame(out, "outer int, C double, variance double, fold int, score double")


def tune(rows: DataFrame, variances: list[float] = VARIANCES, strengths: list[float] = STRENGTHS, group: str = "dataset", seed: int = 1) -> DataFrame:
    """(C, variance, mean_score, se): for every pair of parameters the balanced accuracy at each fold's best
    threshold. Folds leave one dataset out; with a single dataset there are 50, five by five and stratified by class."""
    rows, columns, inner = _inner_folds(rows, group, seed)
    data = search.Scans(rows, columns, balanced=columns == [group])
    try:
        grid = _grid_scores(data, [(0, f, held) for f, held in inner], variances, strengths)
    finally:
        data.close()
    return evaluate.fold_scores(grid, ["C", "variance"])


def train_final(rows: DataFrame, variances: list[float] = VARIANCES, strengths: list[float] = STRENGTHS, group: str = "dataset") -> CohortModel:
    """Tune on all rows, take the simplest model within one standard error, fit it."""
    best = evaluate.one_se(tune(rows, variances, strengths, group), "C", "variance").head()
    return train(rows, best["variance"], best["C"], group)


def write_results(scores: DataFrame, path: str, group: str = "dataset") -> None:
    """One CSV of the AUC and the number of samples of each held-out dataset: a row a dataset."""
    evaluate.auc(scores, [group]).orderBy(group).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def leave_one_out(rows: DataFrame, variances: list[float] = VARIANCES, strengths: list[float] = STRENGTHS, group: str = "dataset", never_held: tuple[str, ...] = ()) -> DataFrame:
    """(sample_id, dataset, y, score, C, variance): every dataset scored by a model tuned and trained on the
    others. Those in *never_held* are trained on but not held out.

    All folds of all datasets are fitted together, see :mod:`tessera.operators.search`; a fold of two datasets serves
    whichever of them is held out. Where but one dataset is left to train on, that one is tuned by itself."""
    names = folds(rows, group)
    outer = [d for d in names if d not in never_held]
    data = search.Scans(rows, [group])
    try:
        if len(names) > 2:
            inner = [(k, search.Fold(0, frozenset([d, i])), i) for k, d in enumerate(outer) for i in names if i != d]
            grid = evaluate.fold_scores(_grid_scores(data, inner, variances, strengths), ["outer", "C", "variance"])
        else:
            alone = [tune(rows.filter(F.col(group) != d), variances, strengths, group).withColumn("outer", F.lit(k)) for k, d in enumerate(outer)]
            grid = reduce(DataFrame.unionByName, alone)
        grid = stage_table(grid.select("outer", "C", "variance", "mean_score", "se"), "grid")
        best = {k: evaluate.one_se(grid.filter(F.col("outer") == k), "C", "variance").head() for k in range(len(outer))}
        space = search.spaces(data, [search.Fold(0, frozenset([d])) for d in outer])
        wanted = [(f := search.Fold(0, frozenset([d])), space[f].needed(best[k]["variance"]), best[k]["C"]) for k, d in enumerate(outer)]
        fits = search.fit_all(data, space, wanted)
        scores = search.held_out_scores(data, space, [(k, fits[w], d) for k, (w, d) in enumerate(zip(wanted, outer, strict=True))])
        chosen = rows.sparkSession.createDataFrame([(k, d, float(best[k]["C"]), float(best[k]["variance"])) for k, d in enumerate(outer)], f"name int, {group} string, C double, variance double")
        return stage_table(scores.join(F.broadcast(chosen), "name").select("sample_id", group, "y", "score", "C", "variance"), "held-out")
    finally:
        data.close()
