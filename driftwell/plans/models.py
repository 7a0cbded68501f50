"""Fitted detectors as JSON: saved in one place, read in another, without code in the file."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import SparkSession

from ..operators import ahsc, detectors, reconstruction, signals, thresholds
from .errors import ConfigError

#: Classes that a file may hold, by name.
KNOWN = {c.__name__: c for m in (detectors, thresholds, signals, ahsc, reconstruction) for c in vars(m).values() if isinstance(c, type) and c.__module__ == m.__name__}


def encoded(value):
    """Numbers, texts, lists, arrays and objects of KNOWN classes as JSON values."""
    if isinstance(value, np.ndarray):
        return {"array": value.tolist(), "type": str(value.dtype), "shape": list(value.shape)}
    if isinstance(value, np.generic):
        return value.item()
    if isinstance(value, (list, tuple)):
        return [encoded(x) for x in value]
    if isinstance(value, dict):
        return {"keys": list(value), "values": [encoded(x) for x in value.values()]}
    if type(value).__name__ in KNOWN:
        return {"class": type(value).__name__, "state": {k: encoded(v) for k, v in vars(value).items()}}
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    raise ConfigError(f"a {type(value).__name__} cannot be saved")


def decoded(value):
    if isinstance(value, list):
        return [decoded(x) for x in value]
    if not isinstance(value, dict):
        return value
    if "array" in value:
        return np.array(value["array"], value["type"]).reshape(value["shape"])
    if "keys" in value:
        return dict(zip(value["keys"], map(decoded, value["values"]), strict=True))
    if value["class"] not in KNOWN:
        raise ConfigError(f"unknown class '{value['class']}'")
    out = object.__new__(KNOWN[value["class"]])
    vars(out).update({k: decoded(v) for k, v in value["state"].items()})
    return out


def save(spark: SparkSession, detector: detectors.Detector, path: str) -> None:
    spark.createDataFrame([(json.dumps(encoded(detector)),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> detectors.Detector:
    return decoded(json.loads(spark.read.text(path).first()["value"]))
