"""Time-to-arrival models with MLlib: one-stage and two-stage boosted trees, a router over horizons, a cascade
of thresholds, blends.

Targets are log1p(hours). Splits are by vessel (`features.fold`), so no vessel is on both sides. Fitting iterates
over the training rows in Spark; nothing is collected but the trees.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import domain, geo
from tidewater.plans import features

INPUTS = ("sog", "dist_km", "closing_kmh", "efficiency", "hour_sin", "hour_cos")
SEED = 42


def training_rows(samples: DataFrame) -> DataFrame:
    """Samples with inputs, target `y`, weight (mean one) and the vessel's side; nulls and infinities become 0."""
    s = features.approach(samples).where("dist_km > 0 and dist_km < 20000 and tta_h > 0 and tta_h < 200 and sog < 50")
    s = s.withColumns({"hour_sin": F.sin(2 * F.pi() * F.hour("ts") / 24), "hour_cos": F.cos(2 * F.pi() * F.hour("ts") / 24), "y": F.log1p("tta_h"), "bin": domain.horizon_bin("tta_h")})
    s = s.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in INPUTS})
    s = s.withColumn("train", features.fold("mmsi", 100) < 80).withColumn("fold", features.fold("mmsi", 5))
    w = 1 / (1 + F.col("tta_h"))
    mean = s.agg(F.avg(w).alias("__m"))
    return s.crossJoin(F.broadcast(mean)).withColumn("weight", w / F.col("__m")).drop("__m")  # one row


def _assemble(inputs, out: str = "x") -> list:
    raw = VectorAssembler(inputCols=list(inputs), outputCol=f"{out}_raw", handleInvalid="keep")
    return [raw, StandardScaler(inputCol=f"{out}_raw", outputCol=out, withMean=True)]


def fit_boosted(rows: DataFrame, target: str = "y", inputs=INPUTS, trees: int = 40, depth: int = 5, out: str = "guess") -> PipelineModel:
    tree = GBTRegressor(featuresCol="x", labelCol=target, weightCol="weight", predictionCol=out, maxIter=trees, maxDepth=depth, seed=SEED)
    return Pipeline(stages=[*_assemble(inputs), tree]).fit(rows)


def hours(column: str) -> Column:
    """From log1p back, clipped to [0.05, 200] hours."""
    return F.greatest(F.lit(0.05), F.least(F.lit(200.0), F.expm1(column)))


class TwoStage:
    """A first model, and a second on its residuals near arrival; a sigmoid of the first's estimate blends them."""

    def __init__(self, threshold_h: float = 3.0, steepness: float = 2.0, trees: int = 40):
        self.threshold, self.steepness, self.trees = threshold_h, steepness, trees

    def fit(self, rows: DataFrame) -> TwoStage:
        self.first = fit_boosted(rows, trees=self.trees, out="g1")
        near = self.first.transform(rows).withColumn("r", F.col("y") - F.col("g1")).drop("x", "x_raw")
        self.second = fit_boosted(near, "r", (*INPUTS, "g1"), trees=self.trees, out="g2")
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        p = self.second.transform(self.first.transform(rows).drop("x", "x_raw")).drop("x", "x_raw")
        gate = 1 / (1 + F.exp(self.steepness * (F.expm1("g1") - self.threshold)))
        return p.withColumn("z", F.col("g1") + gate * F.col("g2")).withColumn("hours", hours("z"))


class Router:
    """A classifier of the horizon and a model per horizon; the estimate is their mean weighted by its probabilities."""

    def __init__(self, trees: int = 20):
        self.trees = trees

    def fit(self, rows: DataFrame) -> Router:
        bins = sorted(r.bin for r in rows.select("bin").distinct().collect())  # at most five
        self.bins = bins
        labelled = Bucketizer(splits=[-0.1, *domain.HORIZON_BINS], inputCol="tta_h", outputCol="label", handleInvalid="keep").transform(rows)
        forest = RandomForestClassifier(featuresCol="x", labelCol="label", probabilityCol="p", numTrees=self.trees, seed=SEED)
        self.router = Pipeline(stages=[*_assemble(INPUTS), forest]).fit(labelled)
        self.models = {b: fit_boosted(rows.where(F.col("bin") == b), trees=self.trees, out=f"g_{b}") for b in bins}
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        p = self.router.transform(rows).withColumn("p", vector_to_array("p")).drop("x", "x_raw", "rawPrediction", "prediction")
        for m in self.models.values():
            p = m.transform(p).drop("x", "x_raw")
        weights = {b: F.coalesce(F.try_element_at("p", F.lit(b + 1)), F.lit(0.0)) for b in self.bins}
        total = sum(weights.values(), F.lit(0.0))
        z = sum((w * F.col(f"g_{b}") for b, w in weights.items()), F.lit(0.0)) / F.greatest(total, F.lit(1e-9))
        return p.withColumn("z", z).withColumn("hours", hours("z"))


class Cascade:
    """Chained classifiers, under 6, 24 or 72 hours, the first that says yes decides; a model for each horizon. Under
    6 hours the naive estimate tells the last hour from the rest. A horizon of fewer than `least` rows has no model
    and its rows get the least estimate."""

    def __init__(self, thresholds: tuple[float, ...] = (6.0, 24.0, 72.0), trees: int = 40, least: int = 100):
        self.thresholds, self.trees, self.least = thresholds, trees, least

    def fit(self, rows: DataFrame) -> Cascade:
        self.deciders = {}
        total = rows.count()
        for t in self.thresholds:
            under = rows.where(F.col("tta_h") < t).count()
            scale = min((total - under) / max(under, 1), 10.0)
            labelled = rows.withColumn("label", (F.col("tta_h") < t).cast("double")).withColumn("__w", F.when(F.col("tta_h") < t, scale).otherwise(1.0))
            tree = GBTClassifier(featuresCol="x", labelCol="label", weightCol="__w", predictionCol=f"under_{t:g}", maxIter=self.trees, maxDepth=5, seed=SEED)
            self.deciders[t] = Pipeline(stages=[*_assemble(INPUTS), tree]).fit(labelled)
        many = {r["bin"]: r["count"] for r in rows.where("bin is not null").groupBy("bin").count().collect()}  # at most five
        self.models = {b: fit_boosted(rows.where(F.col("bin") == b), trees=self.trees, out=f"g_{b}") for b, n in sorted(many.items()) if n >= self.least}
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        p = rows
        for t, m in self.deciders.items():
            p = m.transform(p).drop("x", "x_raw", "probability", "rawPrediction")
        for m in self.models.values():
            p = m.transform(p).drop("x", "x_raw")
        first, *others = self.thresholds
        close = features.half_up(F.col("dist_km") / F.greatest("sog", F.lit(1.0)), 2) < 1
        route = F.when(F.col(f"under_{first:g}") == 1, F.when(close, 0).otherwise(1))
        for k, t in enumerate(others, 2):
            route = route.when(F.col(f"under_{t:g}") == 1, k)
        p = p.withColumn("route", route.otherwise(len(self.thresholds) + 1))
        z = F.lit(0.0)
        for b in self.models:
            z = F.when(F.col("route") == b, F.col(f"g_{b}")).otherwise(z)
        return p.withColumn("z", z).withColumn("hours", hours("z"))


def distance_gate(near: str | Column, far: str | Column, dist_km: str | Column = "dist_km", threshold_km: float = 200.0, smoothness: float = 3.0) -> Column:
    """Hours of two models blended by a sigmoid of the distance: the first near the port, the second far from it."""
    near, far, dist_km = map(geo.c, (near, far, dist_km))
    gate = 1 / (1 + F.exp((dist_km - threshold_km) / (threshold_km / smoothness)))
    return F.greatest(F.lit(0.05), F.least(F.lit(200.0), gate * near + (1 - gate) * far))


def residual_hours(naive: str | Column, residual: str | Column) -> Column:
    """The naive estimate corrected by a residual in log1p; a residual that is no number is 0, an infinite one 3."""
    naive, residual = geo.c(naive), geo.c(residual)
    base = F.log1p(F.greatest(F.lit(0.05), F.least(F.lit(200.0), F.coalesce(naive, F.lit(0.0)))))
    inf = F.lit(float("inf"))
    r = F.when(residual.isNull() | F.isnan(residual), 0.0).when(residual == inf, 3.0).when(residual == -inf, -3.0).otherwise(residual)
    return F.expm1(F.greatest(F.lit(0.0), F.least(F.log1p(F.lit(200.0)), base + r)))


def out_of_fold(rows: DataFrame, folds: int = 5, trees: int = 20) -> DataFrame:
    """Every row's estimate by a model that hasn't seen its vessel."""
    parts = [fit_boosted(rows.where(F.col("fold") != k), trees=trees).transform(rows.where(F.col("fold") == k)).drop("x", "x_raw") for k in range(folds)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("hours", hours("guess"))


def tune(rows: DataFrame, depths: tuple[int, ...] = (3, 5), trees: tuple[int, ...] = (10, 30)) -> PipelineModel:
    """The best of a grid by the error on a fifth of the rows."""
    tree = GBTRegressor(featuresCol="x", labelCol="y", weightCol="weight", predictionCol="guess", seed=SEED)
    grid = ParamGridBuilder().addGrid(tree.maxDepth, list(depths)).addGrid(tree.maxIter, list(trees)).build()
    judge = RegressionEvaluator(labelCol="y", predictionCol="guess", metricName="mae")
    return TrainValidationSplit(estimator=Pipeline(stages=[*_assemble(INPUTS), tree]), estimatorParamMaps=grid, evaluator=judge, seed=SEED).fit(rows).bestModel


def weighted_rmse(rows: DataFrame, truth: str = "tta_h", guess: str = "hours") -> float:
    """Root mean squared error with weights falling with the horizon."""
    w = 1 / (1 + F.col(truth))
    return rows.agg(F.sqrt(F.sum(w * F.pow(F.col(truth) - F.col(guess), 2)) / F.sum(w))).first()[0]


def r2(rows: DataFrame, truth: str = "tta_h", guess: str = "hours") -> float | None:
    """Part of the variance that is explained; null where there is none."""
    return rows.where(F.col(truth).isNotNull() & F.col(guess).isNotNull()).agg(1 - F.try_divide(F.avg(F.pow(F.col(truth) - F.col(guess), 2)), F.var_pop(truth))).first()[0]
