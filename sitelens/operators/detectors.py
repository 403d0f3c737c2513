"""Where models plug in: a detector is called in Arrow batches, one model a worker; a table stands in for it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.operators.filters import filter_detector

FOUND = "image_id long, det_ord int, class_id int, class_name string, x1 double, y1 double, x2 double, y2 double, confidence double, model string, phrase string, error string"
COLUMNS = [c.split()[0] for c in FOUND.split(", ")]


class Detector(Protocol):
    """A model that finds boxes. ``prompts`` are the words of open vocabularies, none for models of fixed classes."""

    def detect(self, images: pd.DataFrame, confidence: float, prompts: list[str]) -> list[list[dict]]:
        """For each row of image_id, height, width, n_channels, data: boxes with class_id, class_name, x1 ... y2, confidence, perhaps phrase."""


class Encoder(Protocol):
    def embed(self, images: pd.DataFrame) -> list[list[float]]:
        """A vector for each row."""


class Reader(Protocol):
    def read(self, images: pd.DataFrame) -> list[list[tuple[str, float]]]:
        """(text, score) of what is written in each row's image."""


_loaded: dict[str, object] = {}


def _model(name: str, load: Callable[[], object]):
    """The worker's one copy of a model."""
    if name not in _loaded:
        _loaded[name] = load()
    return _loaded[name]


def _results(batch: pd.DataFrame, call: Callable[[pd.DataFrame], list], size: int) -> Iterator[tuple[int, object, str | None]]:
    """(row, result, error) of every row: the model gets ``size`` rows a call, and each row by itself only where a call fails."""
    for lo in range(0, len(batch), size):
        part = batch.iloc[lo : lo + size]
        try:
            out = call(part)
            if len(out) != len(part):
                raise ValueError(f"{len(out)} results for {len(part)} images")
            yield from ((lo + i, x, None) for i, x in enumerate(out))
        except Exception:
            for i in range(lo, lo + len(part)):
                try:  # a failing image is a row that says so, not a lost task
                    yield i, call(batch.iloc[i : i + 1])[0], None
                except Exception as e:
                    yield i, None, f"{type(e).__name__}: {e}"


PIXELS = ["height", "width", "n_channels", "data"]


def run_detector(images: DataFrame, name: str, load: Callable[[], Detector], confidence: float, prompts: list[str] | None = None, batch: int = 64) -> DataFrame:
    """Detections of one model. ``load`` runs once a worker; confidence and prompts are handed to the model, which gets ``batch`` images a call."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(name, load)
        for images in batches:
            rows = []
            ids = images["image_id"].tolist()
            for i, found, error in _results(images, lambda part: model.detect(part, confidence, prompts or []), batch):
                if error:
                    rows.append({"image_id": ids[i], "error": error, "model": name})
                else:
                    kept = [d for d in found if d["confidence"] >= confidence]
                    rows += [{**d, "image_id": ids[i], "det_ord": k + 1, "model": name, "phrase": d.get("phrase"), "error": None} for k, d in enumerate(kept)]
            yield pd.DataFrame(rows, columns=COLUMNS).astype({"det_ord": "Int32", "class_id": "Int32", "class_name": object, "model": object, "phrase": object, "error": object})

    return images.select("image_id", *PIXELS).mapInPandas(run, FOUND)


def run_encoder(images: DataFrame, name: str, load: Callable[[], Encoder], keys: list[str], batch: int = 64) -> DataFrame:
    """``keys``, ``embedding`` (null where it failed) and ``error`` of each image."""
    kinds = ", ".join(f"{k} {images.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(name, load)
        for part in batches:
            out = list(_results(part, model.embed, batch))
            yield part[keys].reset_index(drop=True).assign(embedding=[x for _, x, _ in out], error=[e for *_, e in out])

    return images.select(*keys, *PIXELS).mapInPandas(run, f"{kinds}, embedding array<double>, error string")


def run_reader(images: DataFrame, name: str, load: Callable[[], Reader], keys: list[str], batch: int = 64) -> DataFrame:
    """``keys``, ``text``, ``score``, ``error``: a row for each text read; a row without a text where there is none or it failed."""
    kinds = ", ".join(f"{k} {images.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(name, load)
        for part in batches:
            rows = [(i, text, score, error) for i, found, error in _results(part, model.read, batch) for text, score in (found or [(None, None)])]
            frame = pd.DataFrame(rows, columns=["row", "text", "score", "error"]).astype({"text": object, "error": object, "score": float})
            yield pd.concat([part[keys].reset_index(drop=True).iloc[frame["row"]].reset_index(drop=True), frame.drop(columns="row")], axis=1)

    return images.select(*keys, *PIXELS).mapInPandas(run, f"{kinds}, text string, score double, error string")


def table_detector(images: DataFrame, detections: DataFrame, confidence: float, classes: list[str] | None = None) -> DataFrame:
    """The stand-in: detections of the images from a table, under a detector's confidence and classes."""
    return filter_detector(detections, confidence, classes).join(images.select("image_id"), "image_id", "left_semi")


def ensemble(*detections: DataFrame) -> DataFrame:
    """All detections of several models or tiles as a bag, numbered anew: a model's order within the models' order."""
    out = None
    for k, d in enumerate(detections):
        d = d.withColumn("_model", F.lit(k))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out.withColumn("det_ord", F.expr("row_number() over (partition by image_id order by _model, det_ord)")).drop("_model")
