"""Streams: fitted cleaning and scoring, windowed profiles, and incremental profiles of arriving files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from datascry.functions.scalars import NUMERIC, micros
from datascry.operators.cleaning import CleanerModel
from datascry.operators.imputers import KnnImputer
from datascry.operators.keys import attach
from datascry.operators.models import FittedPipeline
from datascry.operators.profile import long_rows


#: Size of the stored sketches: KLL ranks are off by about 0.7 % of the rows at most, HLL counts by about 0.8 %.
KLL_K, HLL_LOG2 = 400, 14


def check_streamable(model: CleanerModel, training: bool, ts: str | None = None) -> None:
    """Plans that run on a stream by themselves: dedup needs an event time, a stored donor table needs `write_cleaned`."""
    if training and _dedups(model) and not ts:
        raise ValueError("remove_duplicates on a stream needs the name of its event time")
    if any(isinstance(v, KnnImputer) and v.donors is None for v in model.values.values()):
        raise ValueError("an imputer with a donor table needs joins: write this stream with write_cleaned")


def _dedups(model: CleanerModel) -> bool:
    return any(a.kind == "remove_duplicates" for a in model.actions)


def event_instant(rows: DataFrame, ts: str) -> Column:
    """The event time as the instant that watermarks need; a time without zone counts as UTC, so days start at its own midnight."""
    dtype = rows.schema[ts].dataType
    return F.timestamp_micros(micros(ts, dtype)) if isinstance(dtype, T.TimestampNTZType) else F.col(ts).cast("timestamp")


def dedup_stream(stream: DataFrame, ts: str, watermark: str = "1 hour") -> DataFrame:
    """Distinct rows of a stream. Equal rows have equal event times, so rows before the watermark leave the state without loss.

    Rows that come later than the watermark are dropped, copies or not; rows without an event time are kept once, in state for good.
    """
    instant = "__instant"
    while instant in stream.columns:
        instant = f"_{instant}"
    timed = stream.withColumn(instant, event_instant(stream, ts)).withWatermark(instant, watermark)
    return timed.dropDuplicates([*stream.columns, instant]).drop(instant)


def _rows_to_clean(stream: DataFrame, model: CleanerModel, training: bool, ts: str | None, watermark: str) -> tuple[DataFrame, CleanerModel]:
    """The stream without duplicates where the plan asks for that, and the rest of the plan."""
    if not (training and _dedups(model)):
        return stream, model
    rest = CleanerModel(model.renames, [a for a in model.actions if a.kind != "remove_duplicates"], model.values)
    return dedup_stream(stream, ts, watermark), rest


def stream_clean(stream: DataFrame, model: CleanerModel, training: bool = False, ts: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """The fitted plan on a stream. With `training` its row filters apply as well; `ts` names the event time (before renames) for dedup."""
    check_streamable(model, training, ts)
    rows, rest = _rows_to_clean(stream, model, training, ts, watermark)
    return rest.transform(rows, training=training)


def write_cleaned(stream: DataFrame, model: CleanerModel, path: str, checkpoint: str, training: bool = False, ts: str | None = None,
                  watermark: str = "1 hour", available_now: bool = True, every: str = "1 minute") -> StreamingQuery:
    """Any fitted plan on a stream, one folder `batch=N` of Parquet files per micro-batch, replaced on a retry.

    Duplicates are dropped in the stream's state; then each micro-batch meets a stored donor table by the joins of a batch.
    """
    if training and _dedups(model) and not ts:
        raise ValueError("remove_duplicates on a stream needs the name of its event time")
    rows, rest = _rows_to_clean(stream, model, training, ts, watermark)

    def keep(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        rest.transform(held, training=training).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        held.unpersist()

    writer = rows.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def stream_score(stream: DataFrame, fitted: FittedPipeline) -> DataFrame:
    """Predictions for every arriving row."""
    if fitted.cleaner:
        check_streamable(fitted.cleaner, False)
    return fitted.transform(stream)


def write_stream(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", available_now: bool = True,
                 every: str = "1 minute") -> StreamingQuery:
    """Append a stream to files, exactly once per row."""
    writer = stream.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def window_profile(rows: DataFrame, ts: str, value: str, by: str, window: str = "1 day") -> DataFrame:
    """Count and mean per window and group. Works on tables and, after withWatermark, on streams."""
    return rows.groupBy(F.window(ts, window).alias("w"), by).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "mean")


def stream_window_profile(stream: DataFrame, ts: str, value: str, by: str, window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """The windowed profile with a watermark: rows later than that are dropped, closed windows are final."""
    timed = stream.withColumn(ts, event_instant(stream, ts))
    return window_profile(timed.withWatermark(ts, watermark), ts, value, by, window)


def mergeable_profile(df: DataFrame) -> DataFrame:
    """Per column: rows, non-null values, a sketch of the distinct values and, for numbers, extremes, mean, summed squared deviation and a rank sketch.

    Sketches are bounded at any number of rows and merge. Maps have no distinct sketch; NaN is no part of the ranks.
    """
    facts = []
    for f in df.schema.fields:
        number = isinstance(f.dataType, NUMERIC)
        x = F.col(f.name).cast("double") if number else F.lit(None).cast("double")
        kinds, ranks = F.lit(None).cast("binary"), F.lit(None).cast("binary")
        if "map<" not in f.dataType.simpleString():
            kinds = F.hll_sketch_agg(F.when(F.col(f.name).isNotNull(), F.xxhash64(f.name)), HLL_LOG2)
        if number:
            ranks = F.kll_sketch_agg_double(F.when(~F.isnan(x), x), KLL_K)
        facts.append(F.struct(F.lit(f.name).alias("column"), F.count("*").alias("rows"), F.count(F.col(f.name)).alias("non_null"), F.min(x).alias("min"),
                              F.max(x).alias("max"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"), kinds.alias("kinds"), ranks.alias("ranks")))
    return long_rows(df, [], facts)


def merge_profiles(parts: DataFrame) -> DataFrame:
    """One profile from the profiles of disjoint row sets: (column, rows, missing, min, max, mean, std, quartiles, distinct).

    The last two come from merged sketches: quartiles within about 0.7 % of the rows in rank, distinct counts within about
    0.8 % (one standard error). Everything else is exact. Null where a column has no such values.
    """
    numbers = F.when(F.col("mean").isNotNull(), F.col("non_null")).otherwise(F.lit(0))
    centers = parts.groupBy("column").agg((F.sum(numbers * F.col("mean")) / F.nullif(F.sum(numbers), F.lit(0))).alias("center"))
    both = attach(parts, centers, ["column"])
    gap = F.col("mean") - F.col("center")
    total = F.sum(numbers)
    whole = both.groupBy("column").agg(
        F.sum("rows").alias("rows"), F.sum(F.col("rows") - F.col("non_null")).alias("missing"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.max("center").alias("mean"), F.when(total > 1, F.sqrt((F.sum("m2") + F.sum(numbers * gap * gap)) / (total - 1))).alias("std"),
        F.kll_merge_agg_double("ranks").alias("ranks"), F.count("ranks").alias("ranked"), F.hll_union_agg("kinds").alias("kinds"), F.count("kinds").alias("counted"))
    some = F.when(F.col("ranked") > 0, F.kll_sketch_get_n_double("ranks") > 0).otherwise(F.lit(False))
    quartiles = F.when(some, F.array(*[F.kll_sketch_get_quantile_double("ranks", F.lit(q)) for q in (0.25, 0.5, 0.75)]))
    return whole.select("column", "rows", "missing", "min", "max", "mean", "std", quartiles.alias("quartiles"),
                        F.when(F.col("counted") > 0, F.hll_sketch_estimate("kinds")).alias("distinct"))


def scheduled_profile(spark: SparkSession, path_in: str, path_out: str, schema: T.StructType, fmt: str = "parquet",
                      max_files: int | None = None, pattern: str | None = None) -> DataFrame:
    """Profile the files that arrived since the last call and merge with what was seen before.

    Each micro-batch writes its partial profile under its own batch id, replacing it on a retry, so a lost executor
    or a restarted job never counts a file twice.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)

    def keep(batch: DataFrame, batch_id: int) -> None:
        mergeable_profile(batch).write.mode("overwrite").parquet(f"{path_out}/parts/batch={batch_id}")

    query = (reader.load(path_in).writeStream.foreachBatch(keep).option("checkpointLocation", f"{path_out}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return merge_profiles(spark.read.parquet(f"{path_out}/parts"))
