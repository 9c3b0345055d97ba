"""Run registry and numbered table states, kept as parquet below a folder."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RUN_SCHEMA = ("run string, dataset string, target string, ts timestamp, task string, model string, score double, "
              "rows bigint, columns int, actions string")
LOG_SCHEMA = "seq bigint, op string, state_id int, description string, rows bigint, columns int, path string"


def record_run(spark: SparkSession, path: str, run: dict | list[dict]) -> DataFrame:
    """Append one run or several to the registry; returns the registry."""
    runs = [run] if isinstance(run, dict) else run
    names = [f.split()[0] for f in RUN_SCHEMA.split(", ")]
    spark.createDataFrame([tuple(r.get(n) for n in names) for r in runs], RUN_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return read_runs(spark, path)


def append_runs(runs: DataFrame, path: str) -> DataFrame:
    """Append a table of runs to the registry; returns the registry."""
    names = [f.split()[0] for f in RUN_SCHEMA.split(", ")]
    kinds = [f.split()[1] for f in RUN_SCHEMA.split(", ")]
    cols = [(F.col(n) if n in runs.columns else F.lit(None)).cast(k).alias(n) for n, k in zip(names, kinds)]
    runs.select(cols).write.mode("append").parquet(path)
    return read_runs(runs.sparkSession, path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).parquet(path)


def other_runs(runs: DataFrame, dataset: str, run: str) -> DataFrame:
    """Runs of the same dataset except the given one."""
    return runs.filter((F.col("dataset") == dataset) & (F.col("run") != run))


# Words that place a task in a family.
TASK_FAMILIES = {
    "classification": "class",
    "regression": "regress",
    "timeseries": "time|forecast",
    "object_detection": "object|vision|image",
}


def search_runs(runs: DataFrame, text: str = "", family: str = "All") -> DataFrame:
    """Runs whose dataset name contains the text, in any case, and whose task belongs to the family."""
    out = runs.filter(F.lower("dataset").contains(text.lower())) if text else runs
    if family == "All":
        return out
    task = F.lower(F.coalesce("task", F.lit("")))
    return out.filter(task.rlike(TASK_FAMILIES[family]) if family in TASK_FAMILIES else task == family)


class StateStore:
    """Numbered states of a table. Every change is one appended log row; a rollback hides later states."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _log(self) -> DataFrame:
        try:
            return self.spark.read.schema(LOG_SCHEMA).parquet(f"{self.root}/log")
        except AnalysisException:
            return self.spark.createDataFrame([], LOG_SCHEMA)

    def _append(self, op: str, state_id: int, description: str, rows: int, columns: int, path: str) -> None:
        seq = (self._log().agg(F.max("seq")).first()[0] or 0) + 1
        entry = self.spark.createDataFrame([(seq, op, state_id, description, rows, columns, path)], LOG_SCHEMA)
        entry.coalesce(1).write.mode("append").parquet(f"{self.root}/log")

    def states(self) -> DataFrame:
        """Live states: (state_id, description, rows, columns, path)."""
        log = self._log()
        later = Window.partitionBy(F.lit(1)).orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
        back = F.min(F.when(F.col("op") == "rollback", F.col("state_id"))).over(later)
        seen = log.withColumn("__back", back).filter("op = 'snapshot' and (__back is null or state_id <= __back)")
        return seen.select("state_id", "description", "rows", "columns", "path")

    def snapshot(self, df: DataFrame, description: str) -> int:
        state_id = (self.states().agg(F.max("state_id")).first()[0] or 0) + 1
        path = f"{self.root}/states/{state_id}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self._append("snapshot", state_id, description, self.spark.read.parquet(path).count(), len(df.columns), path)
        return state_id

    def read(self, state_id: int) -> DataFrame:
        found = self.states().filter(F.col("state_id") == state_id).first()
        if found is None:
            raise ValueError(f"no live state {state_id}")
        return self.spark.read.parquet(found["path"])

    def rollback(self, state_id: int) -> DataFrame:
        """Return to a state; later ones are no longer listed."""
        df = self.read(state_id)
        self._append("rollback", state_id, "", 0, 0, "")
        return df
