"""Boxes from the raw output of an anchor-free detector."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "x double, y double, w double, h double, class int, score double"


def decode(raw: np.ndarray, classes: int, threshold: float, overlap: float) -> list[tuple[float, float, float, float, int, float]]:
    """Boxes (left, top, width, height, class, score) of a channels x anchors matrix, best first.

    The first four channels are centre and size, the others class logits. An anchor counts with its
    best class if the sigmoid of that logit reaches threshold and the box has an area; of boxes of a
    class that overlap more than overlap the better one stays.
    """
    grid = raw.reshape(4 + classes, -1)
    labels = grid[4:].argmax(axis=0)
    scores = 1.0 / (1.0 + np.exp(-grid[4:].max(axis=0)))
    w, h = grid[2], grid[3]
    ok = np.flatnonzero((scores >= threshold) & (w > 0) & (h > 0))
    ok = ok[np.argsort(-scores[ok], kind="stable")]
    x, y = grid[0] - w / 2, grid[1] - h / 2
    kept: list[int] = []
    for i in ok:
        same = [k for k in kept if labels[k] == labels[i]]
        if same:
            across = np.maximum(0, np.minimum(x[i] + w[i], x[same] + w[same]) - np.maximum(x[i], x[same]))
            down = np.maximum(0, np.minimum(y[i] + h[i], y[same] + h[same]) - np.maximum(y[i], y[same]))
            shared = across * down
            if (shared / (w[i] * h[i] + w[same] * h[same] - shared) > overlap).any():
                continue
        kept.append(int(i))
    return [(float(x[i]), float(y[i]), float(w[i]), float(h[i]), int(labels[i]), float(scores[i])) for i in kept]


def detections(frames: DataFrame, output: str, classes: int, threshold: float = 0.25, overlap: float = 0.45) -> DataFrame:
    """Rows of frames with a box each: the array column output holds a frame's matrix, row by row. Arrays of another shape give none."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    @F.pandas_udf(f"array<struct<{', '.join(f'{a}:{b}' for a, b in (f.split() for f in SCHEMA.split(', ')))}>>")
    def boxes(series: pd.Series) -> pd.Series:
        def one(values) -> list[dict]:
            if values is None or len(values) == 0 or len(values) % (4 + classes):
                return []
            return [dict(zip(names, b, strict=True)) for b in decode(np.asarray(values, dtype=float), classes, threshold, overlap)]

        return series.map(one, na_action=None)

    kept = [c for c in frames.columns if c != output]
    return frames.select(*kept, F.explode(boxes(output)).alias("b")).select(*kept, "b.*")
