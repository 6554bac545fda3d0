"""Pair classifiers on Spark ML: three boosted or bagged tree models, logistic regression, and their blend."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink import schema
from weftlink.operators import trees
from weftlink.operators.pairs import FEATURES
from weftlink.sources import tables


def default_params() -> dict[str, dict]:
    """For each model what it is trained with; change a copy."""
    boosted = {"maxIter": 250, "stepSize": 0.05, "maxDepth": 6, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "seed": schema.SEED}
    return {
        "gbt": dict(boosted),
        "gbt_wide": {**boosted, "maxBins": 64, "seed": schema.SEED + 1},
        "forest": {"numTrees": 250, "maxDepth": 6, "subsamplingRate": 0.8, "seed": schema.SEED},
        "logistic": {"C": 1.0, "maxIter": 1000},
    }


def _assembler(out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(FEATURES), outputCol=out, handleInvalid="keep")


def _fit(stages: list, rows: DataFrame) -> PipelineModel:
    return Pipeline(stages=stages).fit(rows.na.fill(0.0, list(FEATURES)))


def train_gbt(rows: DataFrame, params: dict) -> PipelineModel:
    return _fit([_assembler(), GBTClassifier(**params)], rows)


def train_forest(rows: DataFrame, params: dict) -> PipelineModel:
    return _fit([_assembler(), RandomForestClassifier(**params)], rows)


def train_logistic(rows: DataFrame, params: dict) -> PipelineModel:
    """On standardised features; C is the inverse of the penalty summed over rows."""
    params = dict(params)
    n = max(1, rows.count())
    params["regParam"] = 1.0 / (params.pop("C", 1.0) * n)
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)
    return _fit([_assembler("raw"), scaler, LogisticRegression(standardization=False, elasticNetParam=0.0, **params)], rows)


#: Rows a partition in training: each tree level is a job, and a job costs more than so many rows.
ROWS = 20_000

TRAINERS = {"gbt": train_gbt, "gbt_wide": train_gbt, "forest": train_forest, "logistic": train_logistic}


def train_all(rows: DataFrame, params: dict[str, dict] | None = None) -> dict[str, PipelineModel]:
    """Every model of params on rows with the features and label, side by side, on as many partitions as the rows fill.

    Tree ensembles are grown by operators.trees. With parameters or labels that it does not know, Spark ML's own trainers take their place, where
    boosting cuts its lineage every ten rounds by checkpoints in the shared folder; else each round costs more than the one before.
    """
    params = params or default_params()
    tables.use_checkpoints(rows.sparkSession)
    packed = rows.select(F.col("label").cast("double").alias("label"), *FEATURES).na.fill(0.0, list(FEATURES)).coalesce(max(1, -(-rows.count() // ROWS))).persist()
    try:
        plain = packed.where("label is null or label not in (0, 1)").isEmpty() and not packed.isEmpty()
        kinds = {name: RandomForestClassifier if TRAINERS[name] is train_forest else GBTClassifier for name in params if TRAINERS[name] is not train_logistic}
        grown = {name: kind(**params[name]) for name, kind in kinds.items() if plain and set(params[name]) <= trees.KNOWN}
        with ThreadPoolExecutor(1 + len(params)) as pool:
            ensembles = pool.submit(trees.train, packed, grown) if grown else None
            fitted = {name: pool.submit(TRAINERS[name], packed, p) for name, p in params.items() if name not in grown}
            return {name: PipelineModel(stages=[_assembler(), ensembles.result()[name]]) if name in grown else fitted[name].result() for name in params}
    finally:
        packed.unpersist()


def predict(models: dict[str, PipelineModel], rows: DataFrame) -> DataFrame:
    """rows with p_<name>, the probability of label 1, for each model; one pass, no shuffle."""
    out = rows.na.fill(0.0, list(FEATURES))
    for name, model in models.items():
        kept = out.columns
        out = model.transform(out).select(*kept, vector_to_array("probability")[1].alias(f"p_{name}"))
    return out


def predict_one(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return predict({"": model}, rows).withColumnRenamed("p_", "p")
