"""Plug-in points: user models as vectorised callables with a declared schema. No model is shipped."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Schemas that each kind of plug-in must produce.
GEOMETRY = "clip string, frame int, u int, v int, depth double"
SEGMENTATION = "clip string, object_id string, frame int, u int, v int"
DETECTION = "clip string, detection_id string, frame_index int, class_label string, score double, x1 double, y1 double, x2 double, y2 double"


def apply_plugin(frames: DataFrame, plugin: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Run a user's function over Arrow batches of frames; its output must have exactly the columns of ``schema``."""
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema).names

    def checked(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in plugin(parts):
            if list(out.columns) != names:
                raise ValueError(f"plug-in gave columns {list(out.columns)}, wanted {names}")
            yield out

    return frames.mapInPandas(checked, schema)
