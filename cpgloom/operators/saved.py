"""Saving and loading of the library's own models, by Spark ML's protocol.

A class names its constructor arguments in ``parts``; each must be an attribute of the same name.  The folder of a
saved model has Spark's ``metadata`` with the plain values, and beside it one folder for every part that is a
model (saved by its own writer) or a table (Parquet).  Such models can be stages of a ``PipelineModel``.
"""

from __future__ import annotations

import importlib
from dataclasses import asdict
from typing import Any

import numpy as np
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame

from cpgloom.operators.linear import LinearFit

# Where the classes and functions of a saved model may come from.
TRUSTED = ("cpgloom.", "pyspark.ml.")


def _named(path: str) -> Any:
    module, name = path.split(":")
    if not module.startswith(TRUSTED):
        raise ValueError(f"{path} is not a class or function that a saved model may name")
    return getattr(importlib.import_module(module), name)


def _name(thing: Any) -> str:
    return f"{thing.__module__}:{thing.__name__}"


def _plain(value: Any) -> Any:
    """Numbers, texts and lists as JSON knows them."""
    if isinstance(value, np.generic):
        return value.item()
    if isinstance(value, (list, tuple)):
        return [_plain(x) for x in value]
    if isinstance(value, dict):
        return {str(k): _plain(x) for k, x in value.items()}
    return value


class Saved(MLWritable, MLReadable):
    """A model or estimator that is rebuilt from its constructor arguments."""

    parts: tuple[str, ...] = ()

    def write(self) -> SavedWriter:
        return SavedWriter(self)

    @classmethod
    def read(cls) -> SavedReader:
        return SavedReader(cls)


class SavedWriter(MLWriter):
    def __init__(self, instance: Saved):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:  # noqa: N802
        told = {name: self._store(f"{path}/{name}", getattr(self.instance, name)) for name in self.instance.parts}
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={"parts": told})

    def _store(self, path: str, value: Any) -> dict:
        if isinstance(value, DataFrame):
            value.write.parquet(path)
            return {"kind": "table"}
        if isinstance(value, LinearFit):
            return {"kind": "fit", "value": _plain(asdict(value) | {"coef": value.coef.tolist()})}
        if isinstance(value, np.ndarray):
            return {"kind": "array", "type": str(value.dtype), "shape": list(value.shape), "value": value.ravel().tolist()}
        if isinstance(value, MLWritable):
            value.write().save(path)
            return {"kind": "model", "class": _name(type(value))}
        if isinstance(value, dict) and any(isinstance(x, (MLWritable, DataFrame, np.ndarray)) for x in value.values()):
            # Keys need not be texts.
            return {"kind": "several", "value": [[_plain(k), self._store(f"{path}/{i}", x)] for i, (k, x) in enumerate(value.items())]}
        if callable(value):
            return {"kind": "function", "value": _name(value)}
        return {"kind": "value", "value": _plain(value)}


class SavedReader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> Any:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession, f"{self.cls.__module__}.{self.cls.__name__}")
        out = self.cls(**{name: self._fetch(f"{path}/{name}", told) for name, told in metadata["parts"].items()})
        out._resetUid(metadata["uid"])
        return out

    def _fetch(self, path: str, told: dict) -> Any:
        kind = told["kind"]
        if kind == "table":
            return self.sparkSession.read.parquet(path)
        if kind == "fit":
            return LinearFit(**(told["value"] | {"coef": np.array(told["value"]["coef"])}))
        if kind == "array":
            return np.array(told["value"], told["type"]).reshape(told["shape"])
        if kind == "model":
            return _named(told["class"]).load(path)
        if kind == "several":
            return {k: self._fetch(f"{path}/{i}", x) for i, (k, x) in enumerate(told["value"])}
        return _named(told["value"]) if kind == "function" else told["value"]
