"""Detectors: fit, score, store, search, ablate, hold out families.

Logistic regression is Spark ML's. Boosted trees and forests are grown by ``operators.trees``.
"""

from __future__ import annotations

import json
import random
import uuid
from dataclasses import asdict, dataclass
from functools import lru_cache, reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plantwatch import constants as K
from plantwatch.operators import errors as E, metrics as M
from plantwatch.operators.preparation import Preprocessor, with_class_weight
from plantwatch.operators.splits import stratified_kfold
from plantwatch.operators.trees import Spec, StoredTrees, TreeModel, cross_scores, fit_forest_trees, fit_models, load_trees
from plantwatch.session import materialise

KINDS = {"logistic": LogisticRegressionModel, "forest": RandomForestClassificationModel}

# --- Fixed values: search space of the boosted model --------------------------
SEARCH_SPACE = {
    "n_estimators": [200, 300, 400, 500, 650],
    "max_depth": [2, 3, 4, 5, 6, 8],
    "learning_rate": [0.02, 0.04, 0.06, 0.08, 0.10, 0.15],
    "min_child_weight": [1, 2, 4, 6, 10],
    "subsample": [0.70, 0.80, 0.90, 1.00],
    "colsample_bytree": [0.70, 0.80, 0.90, 1.00],
    "gamma": [0.0, 0.1, 0.25, 0.5],
    "reg_lambda": [1.0, 2.0, 5.0, 10.0],
    "reg_alpha": [0.0, 0.01, 0.1, 0.5],
}


@dataclass
class LinearModel:
    """Published coefficients: log-odds = intercept + sum of weight * value; contributions are counted from ``means``."""

    weights: dict[str, float]
    intercept: float
    means: dict[str, float]

    def odds(self) -> Column:
        return reduce(lambda a, kv: a + F.lit(float(kv[1])) * F.col(f"`{kv[0]}`").cast("double"), self.weights.items(), F.lit(float(self.intercept)))


def linear_detector(weights: dict[str, float], intercept: float, means: dict[str, float], unused: list[str] = ()) -> Detector:
    """A detector from given coefficients; ``unused`` columns belong to its schema but have no weight."""
    model = LinearModel(dict(weights), intercept, {c: means.get(c, 0.0) for c in weights})
    return Detector("linear", Preprocessor(list(weights), list(unused), scale=False), model)


@dataclass
class Detector:
    """A fitted model with its column preparation; scores are P(positive class)."""

    kind: str
    prep: Preprocessor
    model: object = None
    constant: float = 0.0

    @property
    def expected_features(self) -> list[str]:
        return self.prep.inputs

    def score(self, df: DataFrame, name: str = "probability") -> DataFrame:
        if self.kind == "dummy":
            return df.withColumn(name, F.lit(self.constant))
        if self.kind == "linear":
            return df.withColumn(name, 1 / (1 + F.exp(-self.model.odds())))
        keep = df.columns
        if isinstance(self.model, (TreeModel, StoredTrees)):
            return self.model.add_scores(self.prep.transform(df, "_features"), "_features", name).select(*keep, name)
        out = self.model.transform(self.prep.transform(df, "_features"))
        # A model without probabilities is ranked by its decision value.
        source = "_probability" if "_probability" in out.columns else "_raw"
        return out.withColumn(name, vector_to_array(source)[1]).select(*keep, name)

    def save(self, spark: SparkSession, path: str) -> None:
        trees, linear = isinstance(self.model, (TreeModel, StoredTrees)), isinstance(self.model, LinearModel)
        meta = {"linear": asdict(self.model) if linear else None, "kind": self.kind, "constant": self.constant, "prep": self.prep.to_dict(), "trees": trees, "written": uuid.uuid4().hex}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(
            f"{path}/schema")
        if trees:
            self.model.save(spark, f"{path}/model")
        elif self.model is not None and not linear:
            self.model.write().overwrite().save(f"{path}/model")


def load_detector(path: str) -> Detector:
    """Load a stored detector once per Python process; an overwritten one is loaded again."""
    spark = SparkSession.getActiveSession()
    try:
        schema = spark.read.text(f"{path}/schema").first()["value"]
    except Exception as e:
        raise FileNotFoundError(f"model artifact not found: {path}") from e
    return _load(path, schema)


@lru_cache(maxsize=8)
def _load(path: str, schema: str) -> Detector:
    meta = json.loads(schema)
    if meta["trees"]:
        model = load_trees(SparkSession.getActiveSession(), meta["kind"], f"{path}/model")
    elif meta.get("linear"):
        model = LinearModel(**meta["linear"])
    else:
        model = KINDS[meta["kind"]].load(f"{path}/model") if meta["kind"] in KINDS else None
    return Detector(meta["kind"], Preprocessor.from_dict(meta["prep"]), model, meta["constant"])


COLS = {"featuresCol": "_features", "rawPredictionCol": "_raw", "probabilityCol": "_probability",
        "predictionCol": "_prediction"}


#: Most rows that one task of a fit holds: a stored split of equal vectors is small, the rows read from it are not.
FIT_ROWS = 500_000


def _fit(estimator, df: DataFrame, prep: Preprocessor, label: str, weight: str):
    return _fit_all([estimator], df, prep, label, weight)[0]


def _fit_all(estimators: list, df: DataFrame, prep: Preprocessor, label: str, weight: str) -> list:
    """Fit on the prepared vectors, which every pass over the data reads again.

    They are written once to the shared folder, so a lost executor re-reads them and
    nothing upstream runs twice, and kept in memory while the fits last.
    """
    vectors = prep.transform(df, "_features").select("_features", label, weight)
    data = materialise(vectors, "training")
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-data.count() // FIT_ROWS))
    if data.rdd.getNumPartitions() < tasks:
        data = data.repartition(tasks)
    data = data.persist()
    try:
        return [e.fit(data) for e in estimators]
    finally:
        data.unpersist()


def fit_dummy(df: DataFrame, label: str, numeric: list[str], categorical: list[str] = ()) -> Detector:
    """Always the most frequent class of the training rows."""
    top = df.groupBy(label).count().orderBy(F.desc("count"), label).first()[label]
    return Detector("dummy", Preprocessor(list(numeric), list(categorical)), constant=float(top))


def fit_logistic(df: DataFrame, label: str, numeric: list[str], categorical: list[str] = (),
                 max_iter: int = 2000) -> Detector:
    """Balanced logistic regression; the penalty equals C = 1 on the weighted sum."""
    prep = Preprocessor(list(numeric), list(categorical)).fit(df)
    lr = LogisticRegression(labelCol=label, weightCol="_w", maxIter=max_iter, regParam=1.0 / df.count(),
                            elasticNetParam=0.0, standardization=False, **COLS)
    return Detector("logistic", prep, _fit(lr, with_class_weight(df, label, "_w"), prep, label, "_w"))


def fit_forest(df: DataFrame, label: str, numeric: list[str], categorical: list[str] = (), trees: int = 200,
               depth: int | None = None, min_leaf: int = 2, seed: int = K.SEED, scale: bool = False) -> Detector:
    """Random forest, classes balanced in every bootstrap; trees of any depth unless ``depth`` limits it."""
    return fit_forests(df, label, numeric, [seed], categorical, trees, depth, min_leaf, scale)[0]


def fit_forests(df: DataFrame, label: str, numeric: list[str], seeds: list[int], categorical: list[str] = (), trees: int = 200,
                depth: int | None = None, min_leaf: int = 2, scale: bool = False) -> list[Detector]:
    """A forest per seed on the same rows, which are prepared and read once for all of them."""
    prep = Preprocessor(list(numeric), list(categorical), scale=scale).fit(df)
    specs = [Spec(kind="forest", n_estimators=trees, max_depth=depth, min_leaf=min_leaf, seed=s) for s in seeds]
    known = prep.transform(df.filter(F.col(label).isNotNull()), "_features")
    return [Detector("forest", prep, m) for m in fit_forest_trees(known, "_features", len(prep.names), label, specs)]


def positive_weight(df: DataFrame, label: str) -> float:
    row = df.agg(F.sum((F.col(label) == 0).cast("bigint")), F.sum((F.col(label) == 1).cast("bigint"))).first()
    if not row[1]:
        raise ValueError("the training rows have no positive class")
    return row[0] / row[1]


def fit_boosted(df: DataFrame, label: str, numeric: list[str], categorical: list[str] = (), n_estimators: int = 300,
                max_depth: int = 8, learning_rate: float = 0.08, min_child_weight: int = 4, subsample: float = 1.0,
                colsample_bytree: float = 0.9, gamma: float = 0.5, reg_lambda: float = 1.0, reg_alpha: float = 0.5,
                seed: int = K.SEED, scale: bool = False, pos_weight: float | None = None) -> Detector:
    """Gradient-boosted trees with L1 and L2 penalties; positive rows weigh negatives / positives."""
    known = df.filter(F.col(label).isNotNull())
    prep = Preprocessor(list(numeric), list(categorical), scale=scale).fit(known)
    w = positive_weight(known, label) if pos_weight is None else pos_weight
    spec = Spec("boosted", n_estimators, max_depth, learning_rate, min_child_weight, subsample, colsample_bytree, gamma, reg_lambda,
                reg_alpha, pos_weight=w, seed=seed)
    model = fit_models(prep.transform(known, "_features"), "_features", len(prep.names), label, [spec])[0]
    return Detector("boosted", prep, model)


def baselines(train: DataFrame, validation: DataFrame, label: str, numeric: list[str], categorical: list[str] = (),
              row_id: str = "row_id", **forest) -> DataFrame:
    """Dummy, logistic and forest fitted on train, all evaluated on validation in one job."""
    fits = {"Dummy_MostFrequent": fit_dummy(train, label, numeric, categorical),
            "LogisticRegression_Balanced": fit_logistic(train, label, numeric, categorical),
            "RandomForest_Balanced": fit_forest(train, label, numeric, categorical, **forest)}
    scored = validation.select(row_id, label, *numeric, *categorical)
    for name, d in fits.items():
        scored = d.score(scored, f"s_{name}")
    return M.compare_models(scored, label, {n: f"s_{n}" for n in fits})


def sample_candidates(space: dict[str, list], n: int, seed: int) -> list[dict]:
    """n different combinations, drawn without listing the whole space."""
    size = reduce(lambda a, b: a * b, (len(v) for v in space.values()), 1)
    picks = random.Random(seed).sample(range(size), min(n, size))
    out = []
    for p in picks:
        combo = {}
        for name, values in space.items():
            p, i = divmod(p, len(values))
            combo[name] = values[i]
        out.append(combo)
    return out


def random_search(df: DataFrame, label: str, key: str, numeric: list[str], categorical: list[str] = (),
                  space: dict[str, list] = SEARCH_SPACE, n_iter: int = 30, folds: int = 4, seed: int = K.SEED,
                  refit: bool = True) -> tuple[DataFrame, dict, Detector | None]:
    """Randomised search scored by average precision over stratified folds.

    Returns the history (one row per candidate, best first), the best parameters and
    the detector refitted on all rows. All candidates and folds share one table of bins,
    and the scores of all of them are ranked in one job.
    """
    known = df.filter(F.col(label).isNotNull()).select(key, label, *numeric, *categorical)
    data = materialise(stratified_kfold(known, label, key, folds, seed), "folds")
    candidates = sample_candidates(space, n_iter, seed)
    pos_weight = positive_weight(data, label)
    prep = Preprocessor(list(numeric), list(categorical), scale=False).fit(data)
    specs = [Spec(**c, pos_weight=pos_weight, seed=seed, fold=f) for c in candidates for f in range(folds)]
    scores = cross_scores(prep.transform(data, "_features"), "_features", len(prep.names), label, "fold", specs)
    ranked = M.ranking(scores, "y", "score", ["model", "outside"], "n")
    ap = F.col("average_precision")
    table = ranked.groupBy("model").agg(F.max(F.when(F.col("outside"), ap)).alias("test_score"), F.max(F.when(~F.col("outside"), ap)).alias("train_score"))
    runs = table.select(F.floor(F.col("model") / folds).cast("int").alias("candidate"), F.pmod("model", F.lit(folds)).cast("int").alias("fold"), "test_score", "train_score")
    spark = df.sparkSession
    params = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(candidates)], "candidate int, params string")
    history = materialise(E.cv_history(runs, "candidate", None).join(params, "candidate"), "search").orderBy("rank_test_score", "candidate")
    best = candidates[history.first()["candidate"]]
    model = fit_boosted(df, label, numeric, categorical, seed=seed, pos_weight=pos_weight, **best) if refit else None
    return history, best, model


def final_test(df: DataFrame, label: str, key: str, fit, modes: dict[str, float],
               split: str = "split") -> tuple[Detector, DataFrame, DataFrame]:
    """Fit on train + validation, evaluate the test rows once, publish their predictions.

    ``fit`` takes a DataFrame and returns a Detector. Returns the detector, the
    result table (one row per operating mode) and the prediction table.
    """
    det = fit(df.filter(F.col(split).isin("train", "validation")))
    scored = det.score(df.filter(F.col(split) == "test"))
    from plantwatch.functions.expressions import decision
    preds = materialise(scored.select(
        F.col(key).alias("row_id"), F.col(label).alias("actual"), "probability",
        *[decision("probability", t).alias(f"predicted_{m}") for m, t in modes.items()]), "predictions")
    return det, M.operating_modes(preds, "actual", "probability", modes), preds


# --- Fixed values: columns that each named feature set leaves out -------------
FEATURE_SETS = {
    "FULL": [],
    "NO_CATEGORICAL": ["proto", "service"],
    "NO_PORTS": ["id_orig_p", "id_resp_p"],
}


def ablation(train: DataFrame, validation: DataFrame, label: str, numeric: list[str], categorical: list[str],
             feature_sets: dict[str, list[str]], fit=fit_forest, **options) -> DataFrame:
    """Same estimator on named column subsets; metrics and their distance from FULL."""
    seen: dict[tuple, str] = {}
    for name, dropped in feature_sets.items():
        kept = tuple(c for c in [*numeric, *categorical] if c not in dropped)
        if kept in seen:
            raise ValueError(f"feature sets {seen[kept]} and {name} keep the same columns")
        seen[kept] = name
    scored, sizes = validation.select(label, *numeric, *categorical), {}
    for name, dropped in feature_sets.items():
        num = [c for c in numeric if c not in dropped]
        cat = [c for c in categorical if c not in dropped]
        sizes[name] = len(num) + len(cat)
        scored = fit(train, label, num, cat, **options).score(scored, f"s_{name}")
    table = materialise(M.compare_models(scored, label, {n: f"s_{n}" for n in feature_sets}), "ablation")
    delta = E.delta_vs(table, "model", "FULL", ["f1", "recall", "roc_auc", "average_precision"])
    n = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])[F.col("model")]
    return table.join(delta, "model").withColumn("n_features", n).withColumnRenamed("model", "feature_set")


def run_study(df: DataFrame, features: list[str], families: dict[str, list[str]], seeds: list[int], label: str,
              cls: str, gid: str, row_id: str, split: str = "split", trees: int = 200,
              **forest) -> DataFrame:
    """Leave one family out: can a detector flag a family it never saw?

    For every family and seed a fresh forest is fitted on train + validation without
    the family, and evaluated on all rows of the family plus the normal test rows.
    One reference model per seed, fitted on everything, gives the seen results.
    Families without rows are skipped.

    The study's columns are written once. The forests of all seeds share a family's prepared
    rows, and all scores go to one table that is evaluated in one job.
    """
    data = materialise(df.select(row_id, gid, cls, label, split, *features), "study")
    dev = data.filter(F.col(split).isin("train", "validation"))
    test_normal = data.filter((F.col(split) == "test") & (F.col(label) == 0))
    listed = sorted({c for classes in families.values() for c in classes})
    is_dev = F.coalesce(F.col(split).isin("train", "validation"), F.lit(False)).cast("bigint")
    found = {r[cls]: r for r in data.filter(F.col(cls).isin(listed)).groupBy(cls).agg(
        F.count(F.lit(1)).alias("n"), F.sum(is_dev).alias("dev")).collect()}
    n_dev, scored, runs = dev.count(), [], []

    def add(models: list[Detector], family: str, positives: DataFrame, kind: str) -> None:
        """Scores of the family's rows and of the normal ones under every seed's model."""
        first = len(runs)
        both = positives.select("*", F.lit(1).alias("_y")).unionByName(test_normal.select("*", F.lit(0).alias("_y")))
        for i, m in enumerate(models):
            both = m.score(both, f"_s{i}")
        cells = F.array(*[F.struct(F.lit(str(first + i)).alias("family"), F.col(f"_s{i}").alias("score")) for i in range(len(models))])
        scored.append(both.select(row_id, gid, "_y", F.inline(cells)))
        runs.extend((str(first + i), family, s, kind) for i, s in enumerate(seeds))

    kept = {f: c for f, c in families.items() if any(x in found for x in c)}
    if not kept:
        raise ValueError("no listed family has rows")
    refs = fit_forests(dev, label, features, seeds, trees=trees, **forest)
    for fam, classes in kept.items():
        rows = data.filter(F.col(cls).isin(classes))
        models = fit_forests(E.without_family(dev, families, fam, cls), label, features, seeds, trees=trees, **forest)
        add(models, fam, rows, "unseen")
        add(refs, fam, rows.filter(F.col(split) == "test"), "seen")
    scores = materialise(reduce(lambda a, b: a.unionByName(b), scored), "family-scores")
    pos, neg = (scores.filter(F.col("_y") == y).select("family", row_id, gid, "score") for y in (1, 0))
    spark = df.sparkSession
    names = spark.createDataFrame(runs, "family string, _name string, seed int, _kind string")
    result = materialise(E.unseen_family_eval(pos, neg, "score", gid, row_id).join(F.broadcast(names), "family"), "family-results")
    part = lambda kind: (result.filter(F.col("_kind") == kind).drop("family", "_kind")
                         .withColumnRenamed("_name", "family"))
    sizes = spark.createDataFrame(
        [(f, "+".join(map(str, c)), n_dev - sum(found[x]["dev"] for x in set(c) if x in found)) for f, c in kept.items()],
        "family string, classes string, train_rows bigint")
    return materialise(E.merge_runs(part("unseen"), part("seen"), ["family", "seed"]).join(F.broadcast(sizes), "family"), "family-runs")
