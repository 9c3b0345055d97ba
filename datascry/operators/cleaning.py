"""Cleaning plans: fitted once on training rows, applied to any table or stream."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datascry.functions import scalars as s
from datascry.operators import filters
from datascry.operators.imputers import KnnImputer, MiceImputer
from datascry.operators.isolation import IsolationForest
from datascry.operators.plugins import apply_plugin, check_spec
from datascry.operators.quantiles import quantiles

FILTERS = ("exclude_categories", "remove_less_than", "remove_greater_than", "remove_equals", "remove_contains")
IMPUTERS = ("impute_mean", "impute_median", "impute_mode", "impute_knn", "impute_mice")
OUTLIERS = ("clip_outliers", "drop_outliers", "isolation_forest")
TRANSFORMS = ("transform_log", "transform_power", "transform_interaction", "transform_date")
WITH_ARGUMENT = ("rename", "transform_interaction", "plugin", *FILTERS)
PLAIN = ("remove_duplicates", "drop", *IMPUTERS, *OUTLIERS, "transform_log", "transform_power", "transform_date")
QUARTERS = [0.25, 0.5, 0.75]


@dataclass(frozen=True)
class Action:
    column: str
    kind: str
    argument: str = ""


def parse_actions(actions: list[dict]) -> list[Action]:
    """Typed actions; anything malformed is refused here and not while data flows."""
    out = []
    for a in actions:
        text = a["actionType"]
        kind, _, argument = text.partition(":")
        if kind == "plugin":
            check_spec(text)
            argument = text
        elif kind in WITH_ARGUMENT:
            if not argument.strip():
                raise ValueError(f"{kind} needs a value")
            if kind in ("remove_less_than", "remove_greater_than", "remove_equals"):
                float(argument)
        elif kind not in PLAIN:
            raise ValueError(f"unknown cleaning action {text}")
        if kind == "remove_duplicates" and a.get("column") != "all":
            raise ValueError("remove_duplicates applies to column 'all'")
        out.append(Action(a.get("column", ""), kind, argument))
    return out


def follow_renames(actions: list[Action]) -> tuple[dict[str, str], list[Action]]:
    """Renames run first; the other actions follow the new names."""
    names: dict[str, str] = {}
    for a in actions:
        if a.kind == "rename":
            names[a.column] = a.argument.strip()
    rest = []
    for a in actions:
        if a.kind == "rename":
            continue
        argument = names.get(a.argument, a.argument) if a.kind == "transform_interaction" else a.argument
        rest.append(Action(names.get(a.column, a.column), a.kind, argument))
    return names, rest


class CleanerModel:
    """Fitted plan. `values` maps (column, kind) to what was learnt."""

    def __init__(self, renames: dict[str, str], actions: list[Action], values: dict):
        self.renames, self.actions, self.values = renames, actions, values

    def _of(self, *kinds: str) -> list[Action]:
        return [a for a in self.actions if a.kind in kinds]

    @property
    def removes_rows(self) -> bool:
        return bool(self._of("remove_duplicates", "drop_outliers", "isolation_forest", *FILTERS))

    def transform(self, df: DataFrame, training: bool = False) -> DataFrame:
        """Apply the plan in its fixed order. Without `training` every row is kept."""
        out = df.withColumnsRenamed(self.renames)
        if training:
            if self._of("remove_duplicates"):
                out = out.distinct()
            for a in self._of(*FILTERS):
                if a.column in out.columns:
                    out = _row_filter(out, a)
        out = out.drop(*[a.column for a in self._of("drop")])
        out = self._impute(out)
        out = self._outliers(out, training)
        out = self._transforms(out)
        for a in self._of("plugin"):
            out = apply_plugin(out, a.argument)
        return out

    def _impute(self, df: DataFrame) -> DataFrame:
        filled = {}
        for a in self._of("impute_mean", "impute_median", "impute_mode"):
            value = self.values.get((a.column, a.kind))
            if value is not None and a.column in df.columns:
                dtype = df.schema[a.column].dataType
                target = "double" if a.kind != "impute_mode" and isinstance(dtype, s.NUMERIC) else dtype
                before = filled.get(a.column, F.col(a.column))
                filled[a.column] = F.coalesce(before.cast(target), F.lit(value).cast(target))
        out = df.withColumns(filled) if filled else df
        for a in self._of("impute_knn", "impute_mice"):
            model = self.values.get((a.column, a.kind))
            if model is not None and a.column in out.columns:
                missing = {c: F.lit(None).cast("double") for c in model.cols if c not in out.columns}
                out = model.transform(out.withColumns(missing) if missing else out)
        return out

    def _outliers(self, df: DataFrame, training: bool) -> DataFrame:
        for a in self._of(*OUTLIERS):
            value = self.values.get((a.column, a.kind))
            if value is None or a.column not in df.columns:
                continue
            if a.kind == "clip_outliers":
                df = df.withColumn(a.column, s.clip(F.col(a.column).cast("double"), *value))
            elif training and a.kind == "drop_outliers":
                df = df.filter(F.col(a.column).between(*value))
            elif training and a.kind == "isolation_forest":
                df = value.keep(df, a.column)
        return df

    def _transforms(self, df: DataFrame) -> DataFrame:
        new = {}
        for a in self._of(*TRANSFORMS):
            c = a.column
            if c not in df.columns:
                continue
            if a.kind == "transform_log":
                new[f"{c}_log"] = s.transform_log(c)
            elif a.kind == "transform_power":
                new[f"{c}_power"] = s.transform_power(c)
            elif a.kind == "transform_interaction" and a.argument in df.columns:
                new[f"{c}_x_{a.argument}"] = s.transform_interaction(c, a.argument)
            elif a.kind == "transform_date":
                new.update({f"{c}_{n}": e for n, e in s.transform_date(c, df.schema[c].dataType).items()})
        return df.withColumns(new) if new else df

    def to_json(self) -> str:
        """The fitted plan as text. Donors of a nearest-row imputer are included while they fit one task, else the path of their stored table."""
        values = []
        for (column, kind), v in self.values.items():
            if isinstance(v, KnnImputer):
                donors = None if v.donors is None else [[None if x != x else x for x in r] for r in v.donors.tolist()]
                v = {"cols": v.cols, "k": v.k, "means": v.means, "donors": donors, "path": v.path}
            elif isinstance(v, MiceImputer):
                v = {"cols": v.cols, "means": v.means, "scales": v.scales, "steps": v.steps}
            elif isinstance(v, IsolationForest):
                v = {"cuts": v.cuts, "scores": v.scores, "limit": v.limit, "median": v.median}
            values.append([column, kind, v])
        return json.dumps({"renames": self.renames, "actions": [[a.column, a.kind, a.argument] for a in self.actions], "values": values},
                          default=str)

    @staticmethod
    def from_json(text: str) -> CleanerModel:
        import numpy as np

        data = json.loads(text)
        values = {}
        for column, kind, v in data["values"]:
            if kind == "impute_knn" and v is not None and v["donors"] is None:
                v = KnnImputer.load(SparkSession.active(), v["cols"], v["k"], v["means"], v["path"])
            elif kind == "impute_knn" and v is not None:
                donors = np.array([[float("nan") if x is None else x for x in r] for r in v["donors"]], dtype=float)
                v = KnnImputer(v["cols"], v["k"], v["means"], donors, None)
            elif kind == "impute_mice" and v is not None:
                v = MiceImputer(v["cols"], v["means"], v["scales"], [(j, c) for j, c in v["steps"]])
            elif kind == "isolation_forest" and v is not None:
                v = IsolationForest(**v)
            values[(column, kind)] = v
        return CleanerModel(data["renames"], [Action(*a) for a in data["actions"]], values)


def _row_filter(df: DataFrame, a: Action) -> DataFrame:
    if a.kind == "exclude_categories":
        values = [v.strip() for v in a.argument.split("|") if v.strip()]
        return filters.exclude_categories(df, a.column, values) if values else df
    if a.kind == "remove_contains":
        return filters.remove_contains(df, a.column, a.argument)
    return getattr(filters, a.kind)(df, a.column, float(a.argument))


def fit_cleaner(df: DataFrame, actions: list[dict], exact: bool = True) -> CleanerModel:
    """Learn the plan's statistics on the raw rows: one aggregate for means, one for quantiles, one for modes."""
    renames, plan = follow_renames(parse_actions(actions))
    rows = df.withColumnsRenamed(renames)
    numeric = set(s.numeric_columns(rows))
    known = [a for a in plan if a.column in rows.columns]
    values: dict = {}

    means = sorted({a.column for a in known if a.kind == "impute_mean" and a.column in numeric})
    if means:
        row = rows.agg(*[F.avg(c).alias(c) for c in means]).first()
        values.update({(c, "impute_mean"): row[c] for c in means})

    ranked = [a for a in known if a.kind in ("impute_median", *OUTLIERS) and a.column in numeric]
    if ranked:
        cols = sorted({a.column for a in ranked})
        q = {r["column"]: r["q"] for r in quantiles(rows, cols, QUARTERS, exact=exact).collect()}
        for a in ranked:
            if not q[a.column] or q[a.column][0] is None:
                continue
            q1, median, q3 = q[a.column]
            if a.kind == "impute_median":
                values[(a.column, a.kind)] = median
            elif a.kind == "isolation_forest":
                values[(a.column, a.kind)] = IsolationForest.fit(rows, a.column, median)
            else:
                values[(a.column, a.kind)] = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))

    modes = sorted({a.column for a in known if a.kind == "impute_mode"})
    if modes:
        found = {c: mode_value(rows, c) for c in modes}
        for c in modes:
            text = isinstance(rows.schema[c].dataType, T.StringType)
            values[(c, "impute_mode")] = found[c] if found[c] is not None else ("missing" if text else None)

    every = s.numeric_columns(rows)
    for a in known:
        if a.kind == "impute_knn" and a.column in numeric:
            values[(a.column, a.kind)] = KnnImputer.fit(rows, every)
        elif a.kind == "impute_mice" and a.column in numeric:
            values[(a.column, a.kind)] = MiceImputer.fit(rows, every)
    return CleanerModel(renames, plan, values)


def mode_value(df: DataFrame, c: str):
    """Most frequent value, the smallest among equals, found on pre-aggregated counts."""
    counts = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), c).first()
    return top[c] if top else None


def clean(df: DataFrame, actions: list[dict], exact: bool = True) -> tuple[CleanerModel, DataFrame]:
    model = fit_cleaner(df, actions, exact)
    return model, model.transform(df, training=True)
