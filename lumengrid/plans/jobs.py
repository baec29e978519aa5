"""Batch jobs over tables of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lumengrid.operators import retrieve
from lumengrid.sources.frames import write_frames


def run_batch(frames: DataFrame, params: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """Retrieve every frame with its own parameters; the objects are also stored, if a path is given."""
    objects, _ = retrieve.shrink_wrap(frames, params)
    if path:
        write_frames(objects, path)
    return objects
