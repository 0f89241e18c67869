"""Every query of the library, by name, with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.plans import cleaning, evaluation, fitted, labels, learning, molecules, parsing, protocol, substructures, trees, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in (cleaning, labels, parsing, evaluation, vectors, molecules, protocol, learning, trees, fitted, substructures):
    QUERIES |= _module.REGISTRY.queries
    ORACLES |= _module.REGISTRY.oracles
