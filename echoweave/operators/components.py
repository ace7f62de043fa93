"""Fitted components on disk: a directory for each, with Spark's own formats for models and tables.

A component is a dataclass of :mod:`.pipelines`, a fitted pipeline, a DataFrame, a plain value, or a list or tuple of
these. Models are written by Spark ML, tables as Parquet, plain values as JSON in the manifest, which is written last: a
save that was cut short cannot be loaded.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, fields, is_dataclass
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import KEYS
from . import models, pipelines
from .pairs import fold

VERSION = 1
KINDS = {c.__name__: c for c in (pipelines.Branches, pipelines.Range, pipelines.Angles, pipelines.Position)}


def _write_json(spark: SparkSession, path: str, value: Any) -> None:
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_json(spark: SparkSession, path: str) -> Any:
    """The value written there; None if there is none."""
    try:
        found = spark.read.text(path, wholetext=True).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return json.loads(found[0]) if found else None


def _save(spark: SparkSession, value: Any, path: str) -> dict:
    """Writes what is not plain below ``path`` and describes the value."""
    if isinstance(value, PipelineModel):
        value.write().overwrite().save(path)
        return {"kind": "model"}
    if isinstance(value, DataFrame):
        value.write.mode("overwrite").parquet(path)
        return {"kind": "table"}
    if is_dataclass(value) and type(value).__name__ in KINDS:
        return {"kind": "component", "of": type(value).__name__, "parts": {f.name: _save(spark, getattr(value, f.name), f"{path}/{f.name}") for f in fields(value)}}
    if isinstance(value, (list, tuple)):
        return {"kind": type(value).__name__, "parts": [_save(spark, v, f"{path}/{i}") for i, v in enumerate(value)]}
    return {"kind": "value", "value": json.loads(json.dumps(value))}


def _load(spark: SparkSession, what: dict, path: str) -> Any:
    kind = what["kind"]
    if kind == "model":
        return PipelineModel.load(path)
    if kind == "table":
        return spark.read.parquet(path)
    if kind == "component":
        return KINDS[what["of"]](**{name: _load(spark, part, f"{path}/{name}") for name, part in what["parts"].items()})
    if kind in ("list", "tuple"):
        parts = [_load(spark, part, f"{path}/{i}") for i, part in enumerate(what["parts"])]
        return parts if kind == "list" else tuple(parts)
    return what["value"]


def save(component: Any, path: str, spark: SparkSession) -> None:
    """Writes a fitted component to a new or old directory. Tables may not read from that directory."""
    _write_json(spark, f"{path}/manifest", {"version": VERSION, "spark": spark.version, "component": _save(spark, component, f"{path}/parts")})


def load(path: str, spark: SparkSession, kind: type | None = None) -> Any:
    """The component saved at ``path``; it must be of ``kind`` if one is given."""
    manifest = _read_json(spark, f"{path}/manifest")
    if manifest is None:
        raise FileNotFoundError(f"no saved component at {path}")
    if manifest["version"] != VERSION:
        raise ValueError(f"saved in version {manifest['version']} of the format, this is {VERSION}")
    found = _load(spark, manifest["component"], f"{path}/parts")
    if kind is not None and not isinstance(found, kind):
        raise TypeError(f"{path} holds a {type(found).__name__}, not a {kind.__name__}")
    return found


@dataclass
class CrossFit:
    """Models that have not seen their fold, and (keys, fold, label, ``raw``, ``cal``) of every row.

    ``raw``: log probabilities of the row's own model; ``cal``: probabilities with the bias fitted on the other folds.
    ``bias`` is fitted on all rows.
    """

    models: list[PipelineModel]
    rows: DataFrame
    biases: list[list[float]]
    bias: list[float]


def cross_fit(df: DataFrame, features: Sequence[str], label: str, classes: int, path: str, folds: int = 5, trees: int = 20, seed: int = 42, keys: Sequence[str] = KEYS) -> CrossFit:
    """Cross-fitted forests and biases kept at ``path``: a run that finds a fold there, of the same rows and settings, does not fit it again.

    The rows lie there by fold. They, and not the models, are what later steps read: biases, calibration, scores.
    """
    spark = df.sparkSession
    placed = df.withColumn("fold", fold(folds))
    state = placed.agg(F.count("*"), F.sum(F.xxhash64(*keys, label, *features).cast("decimal(38,0)"))).first()
    settings = {"version": VERSION, "features": list(features), "label": label, "classes": classes, "folds": folds, "trees": trees, "seed": seed, "rows": state[0], "hash": str(state[1])}
    flagged, fitted = models.with_flags(placed, features), []
    for k in range(folds):
        at = f"{path}/models/{k}"
        if _read_json(spark, f"{at}/done") == settings:
            fitted.append(PipelineModel.load(f"{at}/model"))
            continue
        forest = RandomForestClassifier(featuresCol="x", labelCol=label, numTrees=trees, maxDepth=5, seed=seed)
        model = Pipeline(stages=[*models.prepare(features), forest]).fit(flagged.where(F.col("fold") != k))
        model.write().overwrite().save(f"{at}/model")
        own = model.transform(flagged.where(F.col("fold") == k)).select(*keys, label, models.log_probabilities(classes).alias("raw"))
        own.write.mode("overwrite").parquet(f"{path}/raw/fold={k}")
        _write_json(spark, f"{at}/done", settings)
        fitted.append(model)
    rows = reduce(DataFrame.unionByName, [spark.read.parquet(f"{path}/raw/fold={k}").withColumn("fold", F.lit(k)) for k in range(folds)])
    found = _read_json(spark, f"{path}/biases")
    if not found or found["settings"] != settings:
        *biases, bias = models.fit_biases(rows, "raw", label, classes, folds)
        found = {"settings": settings, "biases": biases, "bias": bias}
        _write_json(spark, f"{path}/biases", found)
    return CrossFit(fitted, models.calibrated(rows, "raw", found["biases"], "cal"), found["biases"], found["bias"])
