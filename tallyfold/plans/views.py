"""Tables and queries as views, so that the operators are reachable from SQL."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import SparkSession

from tallyfold.plans import registry
from tallyfold.sources.tables import table


def register_tables(spark: SparkSession, sf_dir: str) -> list[str]:
    """Every parquet table of a directory as a view of its name."""
    names = sorted(p.name.removesuffix(".parquet") for p in Path(sf_dir).glob("*.parquet"))
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return names


def register_queries(spark: SparkSession, sf_dir: str, names: Iterable[str] | None = None) -> list[str]:
    """Queries as views (all core ones by default); a view is planned again with whatever is asked of it."""
    picked = sorted(registry.QUERIES) if names is None else list(names)
    for name in picked:
        registry.QUERIES[name](spark, sf_dir).createOrReplaceTempView(name)
    return picked
