"""Hooks for user code: models over batches, and the process-validate-window composition."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame

from ..operators import validate, windows


def apply_model(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """load is called once per task and returns the model; it maps Arrow batches to frames of `schema`."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in frames:
            yield model(pdf)

    return df.mapInPandas(run, schema)


def validated_windows(df: DataFrame, rules: list[validate.Rule], size: int, keys: Sequence[str], ts: str, tie: str, aggs: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """(windows of the valid rows, quarantined rows)."""
    good, bad = validate.split(df, rules)
    return windows.tumbling_count(good, size, keys, ts, tie, aggs, include_partial=True), bad
