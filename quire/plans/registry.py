"""User-supplied extractors by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

_EXTRACTORS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_extractor(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    """`fn` turns a table of pages into a table of catalogue rows or chapters."""
    _EXTRACTORS[name] = fn


def extract(name: str, pages: DataFrame) -> DataFrame:
    if name not in _EXTRACTORS:
        raise KeyError(f"unknown extractor {name!r}, known: {', '.join(_EXTRACTORS)}")
    return pages.transform(_EXTRACTORS[name])
