"""Scoring a stream of rows with one tree of the set."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.model import RashomonModel


def score_stream(model: RashomonModel, stream: DataFrame, tree_id: int, output: str = "prediction") -> DataFrame:
    """Add a tree's prediction to a streaming DataFrame.

    A tree is a projection: no state, no watermark, any output mode that the
    source allows.
    """
    if not stream.isStreaming:
        raise ValueError("expected a streaming DataFrame; use model.predict for a batch one")
    return model.predict(stream, tree_id, output)
