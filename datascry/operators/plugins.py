"""User transforms called by name from a cleaning plan: 'plugin:<id>:k=v,...'."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Plugin:
    id: str
    fn: Callable
    params: dict = field(default_factory=dict)
    schema: Callable | str | None = None
    description: str = ""


_PLUGINS: dict[str, Plugin] = {}


def register_plugin(id: str, fn: Callable, params: dict | None = None, description: str = "") -> None:
    """`fn(df, **params) -> df` over Spark DataFrames; `params` holds the defaults and names what is accepted."""
    _PLUGINS[id] = Plugin(id, fn, dict(params or {}), None, description)


def register_pandas_plugin(id: str, fn: Callable, schema: Callable | str, params: dict | None = None, description: str = "") -> None:
    """`fn(pdf, **params) -> pdf`, local to a batch of rows. `schema` is the output schema, or makes it from the input's."""
    _PLUGINS[id] = Plugin(id, fn, dict(params or {}), schema, description)


def parse_value(text: str):
    """int, float, bool or text."""
    try:
        return float(text) if "." in text else int(text)
    except ValueError:
        return {"true": True, "false": False}.get(text.lower(), text)


def parse_spec(spec: str) -> tuple[str, dict]:
    parts = spec.split(":", 2)
    if len(parts) < 2 or parts[0] != "plugin" or not parts[1]:
        raise ValueError(f"not a plugin call: {spec}")
    pairs = [p.split("=", 1) for p in (parts[2].split(",") if len(parts) > 2 else []) if "=" in p]
    return parts[1], {k: parse_value(v) for k, v in pairs}


def check_spec(spec: str) -> None:
    id, given = parse_spec(spec)
    if id not in _PLUGINS:
        raise ValueError(f"unknown plugin {id}")
    odd = set(given) - set(_PLUGINS[id].params)
    if odd:
        raise ValueError(f"plugin {id} has no parameter {sorted(odd)}")


def apply_plugin(df: DataFrame, spec: str) -> DataFrame:
    check_spec(spec)
    id, given = parse_spec(spec)
    plugin = _PLUGINS[id]
    params = {**plugin.params, **given}
    if plugin.schema is None:
        return df.transform(plugin.fn, **params)
    schema = plugin.schema(df.schema) if callable(plugin.schema) else plugin.schema
    fn = plugin.fn

    def batches(frames):
        for frame in frames:
            yield fn(frame, **params)

    return df.mapInPandas(batches, schema)


def plugin_catalog(spark: SparkSession) -> DataFrame:
    """One row per plugin parameter; a plugin without parameters has one row with nulls."""
    rows = []
    for p in _PLUGINS.values():
        kind = "spark" if p.schema is None else "pandas"
        for name, default in (p.params or {None: None}).items():
            rows.append((p.id, kind, p.description, name, type(default).__name__ if name else None,
                         json.dumps(default) if name else None))
    return spark.createDataFrame(rows, "id string, kind string, description string, parameter string, type string, value string")
