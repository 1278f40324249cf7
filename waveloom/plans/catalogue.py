"""Every registered query and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waveloom.plans import base, detectors, export, extras, intervals, media, recurring, series, signals, spectral, speech, stores, vectors

MODULES = (recurring, series, intervals, detectors, vectors, signals, spectral, media, stores, speech, export, extras)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)
