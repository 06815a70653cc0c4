"""Classifiers and regressors on the panels, with their test metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import metrics as m
from tidemark.functions.scalar import expm1_clipped
from tidemark.functions.stats import spearman
from tidemark.models import boosting
from tidemark.models.prepare import as_doubles, balanced_weights, kept_categories, linear_stages, tree_stages, with_values

C = F.col
MAX_BINS = 64  # split candidates of a numeric feature; categories raise it where there are more of them

MIN_TEST_POSITIVES = 10  # below it a segment's metrics are noise


@dataclass(frozen=True)
class TreeParams:
    iterations: int = 40
    step: float = 0.1
    depth: int = 5
    min_rows: int = 20
    seed: int = 42


@dataclass(frozen=True)
class Features:
    num: tuple[str, ...]
    cat: tuple[str, ...] = ()

    def plus(self, num: Sequence[str] = (), cat: Sequence[str] = ()) -> Features:
        return Features((*self.num, *num), (*self.cat, *cat))

    def prepared(self, df: DataFrame) -> DataFrame:
        out = as_doubles(df, self.num)
        return out.withColumns({c: F.coalesce(C(c).cast("string"), F.lit("none")) for c in self.cat}) if self.cat else out


def linear_preparation(train: DataFrame, feats: Features) -> PipelineModel:
    """The fitted stages before a linear model. They depend on the features alone, so fits on the same rows may share them."""
    rows = feats.prepared(train)
    return Pipeline(stages=linear_stages(with_values(rows, feats.num), kept_categories(rows, feats.cat))).fit(rows)


def tree_preparation(train: DataFrame, feats: Features) -> PipelineModel:
    """The fitted stages before a boosted model; fits on the same rows may share them."""
    rows = feats.prepared(train)
    return Pipeline(stages=tree_stages(with_values(rows, feats.num), kept_categories(rows, feats.cat))).fit(rows)


def _fitted(prep: PipelineModel, estimator: Estimator, rows: DataFrame) -> PipelineModel:
    return PipelineModel(stages=[*prep.stages, estimator.fit(prep.transform(rows))])


def _boosted(prep: PipelineModel, estimator: GBTClassifier | GBTRegressor, rows: DataFrame, feats: Features) -> PipelineModel:
    return PipelineModel(stages=[*prep.stages, boosting.fit(estimator, prep, rows, [*feats.num, *feats.cat])])


def fit_logreg(train: DataFrame, feats: Features, label: str, weight: str | None = None,
               balanced: bool = False, reg: float = 1e-4, prep: PipelineModel | None = None) -> PipelineModel:
    prep = prep or linear_preparation(train, feats)
    rows = feats.prepared(train)
    if balanced:
        rows = balanced_weights(rows, label)
        rows = rows.withColumn("class_weight", C("class_weight") * (C(weight) if weight else F.lit(1.0)))
        weight = "class_weight"
    lr = LogisticRegression(labelCol=label, maxIter=100, regParam=reg, **({"weightCol": weight} if weight else {}))
    return _fitted(prep, lr, rows)


def fit_gbt(train: DataFrame, feats: Features, label: str, weight: str | None = None,
            params: TreeParams = TreeParams(), prep: PipelineModel | None = None) -> PipelineModel:
    prep = prep or tree_preparation(train, feats)
    gbt = GBTClassifier(
        labelCol=label, maxIter=params.iterations, stepSize=params.step, maxDepth=params.depth,
        minInstancesPerNode=params.min_rows, maxBins=_bins(prep), seed=params.seed,
        **({"weightCol": weight} if weight else {}))
    return _boosted(prep, gbt, feats.prepared(train), feats)


def _bins(prep: PipelineModel) -> int:
    """Trees need a bin for every category, for all others together and for unseen ones."""
    return max([MAX_BINS, *(len(s.labelsArray[0]) + 2 for s in prep.stages if isinstance(s, StringIndexerModel))])


def fit_gbt_reg(train: DataFrame, feats: Features, target: str, params: TreeParams = TreeParams(),
                prep: PipelineModel | None = None) -> PipelineModel:
    """Regression on log1p of the target."""
    prep = prep or tree_preparation(train, feats)
    rows = feats.prepared(train).withColumn("_log_target", F.log1p(F.greatest(C(target), F.lit(0.0))))
    gbt = GBTRegressor(
        labelCol="_log_target", maxIter=params.iterations, stepSize=params.step, maxDepth=params.depth,
        minInstancesPerNode=params.min_rows, maxBins=_bins(prep), seed=params.seed)
    return _boosted(prep, gbt, rows, feats)


def predict(model: PipelineModel, df: DataFrame, feats: Features, out: str, kind: str = "class") -> DataFrame:
    """Input columns plus one score column: P(1), or the value on the original scale."""
    scored = model.transform(feats.prepared(df).withColumn("_row", F.struct(*df.columns)))
    value = vector_to_array("probability")[1] if kind == "class" else expm1_clipped("prediction")
    return scored.select("_row.*", value.alias(out))


@dataclass(frozen=True)
class TwoPart:
    """P(pay) x E(revenue | pay)."""

    pays: PipelineModel
    amount: PipelineModel
    feats: Features

    def predict(self, df: DataFrame, out: str = "pred_ltv_twopart") -> DataFrame:
        p = predict(self.pays, df, self.feats, "_p_pay")
        both = predict(self.amount, p, self.feats, "_e_rev", "value")
        return both.withColumn(out, C("_p_pay") * C("_e_rev")).drop("_p_pay", "_e_rev")


def fit_two_part(train: DataFrame, feats: Features, target: str, params: TreeParams = TreeParams(),
                 prep: PipelineModel | None = None) -> TwoPart:
    """``prep`` is that of all rows; the amounts have one of their own."""
    marked = train.withColumn("_pays", (C(target) > 0).cast("int"))
    return TwoPart(
        fit_gbt(marked, feats, "_pays", params=params, prep=prep),
        fit_gbt_reg(train.filter(C(target) > 0), feats, target, params), feats)


def persistence(df: DataFrame, prior: str = "rev_365", out: str = "pred_persistence") -> DataFrame:
    """Baseline: next year equals last year."""
    return df.withColumn(out, C(prior))


# --- reports ----------------------------------------------------------------------
def classification_report(scored: DataFrame, label: str, score: str, tiebreak: str, name: str,
                          weight: str | None = None, pcts: Sequence[float] = (1, 5, 10)) -> DataFrame:
    """One row: AUC, average precision, lift, top-decile precision and recall, calibration."""
    parts = [
        m.curve_metrics(scored, label, score, weight),
        m.top_metrics(scored, label, score, tiebreak, pcts, weight),
        m.ece(scored, label, score, 10, weight), m.brier(scored, label, score, weight),
    ]
    return _one_row(name, parts)


def regression_report(scored: DataFrame, target: str, pred: str, tiebreak: str, name: str,
                      pcts: Sequence[float] = (5, 10, 20)) -> DataFrame:
    parts = [
        m.mae_rmse(scored, target, pred), spearman(scored, pred, target), m.captures(scored, target, pred, tiebreak, pcts),
    ]
    return _one_row(name, parts)


def _one_row(name: str, parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0].select(F.lit(name).alias("model"), "*")
    for part in parts[1:]:
        out = out.join(F.broadcast(part))  # every side is exactly one row
    return out


def segment_vs_global(
    train: DataFrame, test: DataFrame, feats: Features, targets: Mapping[str, str], global_scored: DataFrame,
    global_label: str, key: str, weight: str, pct: float = 20,
) -> DataFrame:
    """A model per segment flag against the global model on the same test rows.

    ``targets`` maps flags to labels; ``global_scored`` has (key, global_score).
    A segment whose training rows hold one class only has no model of its own; with fewer than
    ``MIN_TEST_POSITIVES`` positives among its test rows the comparison is marked as noise.
    """
    rows = []
    for flag_col, label in targets.items():
        tr, te = train.filter(C(flag_col) == 1), test.filter(C(flag_col) == 1)
        seen = tr.agg(F.count_distinct(label).alias("k")).first()["k"]
        own = None
        if seen >= 2:
            scored = predict(fit_logreg(tr, feats, label, weight, balanced=True), te, feats, "own_score")
            own = _own_report(scored, label, "own_score", key, weight, pct, "segment")
        both = te.join(global_scored, key)
        other = (
            _own_report(both, label, "global_score", key, weight, pct, "global")
            if label == global_label else None
        )
        base = te.agg(F.coalesce(F.sum(label), F.lit(0)).alias("test_positives")).select(
            F.lit(flag_col).alias("segment"), F.lit(label).alias("target"), "test_positives")
        for part, name in ((own, "segment"), (other, "global")):
            empty = [F.lit(None).cast("double").alias(f"{name}_{k}") for k in ("auc", "lift")]
            base = base.join(F.broadcast(part)) if part is not None else base.select("*", *empty)
        rows.append(base)
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    both_known = C("segment_auc").isNotNull() & C("global_auc").isNotNull()
    winner = F.when(both_known & (C("segment_auc") > C("global_auc")), "segment").when(both_known, "global")
    return out.withColumns({"winner": winner, "is_noise": (C("test_positives") < MIN_TEST_POSITIVES).cast("int")})


def _own_report(scored: DataFrame, label: str, score: str, key: str, weight: str, pct: float, name: str) -> DataFrame:
    auc = m.curve_metrics(scored, label, score, weight).select(C("roc_auc").alias(f"{name}_auc"))
    top = m.top_metrics(scored, label, score, key, (pct,), weight).select(C(f"lift_{pct:g}").alias(f"{name}_lift"))
    return auc.join(F.broadcast(top))


# --- storage ----------------------------------------------------------------------
def save_model(model: PipelineModel, feats: Features, path: str) -> None:
    """Fitted stages and the feature list side by side."""
    model.write().overwrite().save(f"{path}/model")
    named = SparkSession.active().createDataFrame(
        [(list(feats.num), list(feats.cat))], "num array<string>, cat array<string>")
    named.write.mode("overwrite").parquet(f"{path}/features")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, Features]:
    row = spark.read.parquet(f"{path}/features").first()
    return PipelineModel.load(f"{path}/model"), Features(tuple(row["num"]), tuple(row["cat"]))


def save_predictions(scored: DataFrame, cols: Sequence[str], path: str) -> None:
    scored.select(*cols).write.mode("overwrite").parquet(path)
