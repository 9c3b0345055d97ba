"""Registered queries: every operator applied to the given tables, with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SECTIONS = ("scans", "filters", "joins", "profiles", "series", "samples", "scalars", "cleaners", "learning", "texts",
            "shapes", "groups", "flows")


class Tables:
    """Parquet tables of one scale directory, read on first use as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a function of Tables under `name`, with the SQL that must give the same rows."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def load_all() -> None:
    from pathlib import Path
    for section in SECTIONS:
        if not (Path(__file__).parent / f"{section}.py").exists():
            continue
        import_module(f"datascry.catalog.{section}")
