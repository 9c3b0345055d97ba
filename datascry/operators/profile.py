"""Column profiles: one aggregate over all columns, plus one pre-aggregated value table for exact distinct counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datascry.functions.scalars import FLOATING, INTEGRAL, NUMERIC, TEMPORAL, to_datetime
from datascry.operators.keys import attach
from datascry.operators.ordered import largest_group
from datascry.operators.quantiles import TABLE_ROWS, fences, quantiles

# Name parts of the type rule.
DATE_NAMES = ["date", "time", "timestamp", "datetime", "year", "month", "day"]
CATEGORY_NAMES = ["class", "label", "target", "category", "group", "outcome", "gender", "sex", "style", "type", "status",
                  "state", "mode", "stage", "grade", "phase", "tier", "priority", "choice", "option", "flag", "indicator",
                  "ind", "is_"]
CONTINUOUS_NAMES = ["age", "price", "amount", "score", "value", "val", "count", "num", "temp", "rate", "pct", "percent",
                    "date", "year", "month", "day", "time"]
ID_NAMES = ["id", "index", "no", "number", "num", "row", "rowid"]
SERIES_NAMES = ["date", "time", "timestamp", "datetime", "year", "month", "period", "week"]
TARGET_NAMES = ["target", "label", "class", "price", "outcome", "y", "survived"]

WIDE = 100
QUARTERS = [0.25, 0.5, 0.75]


def family(dtype: T.DataType) -> str:
    if isinstance(dtype, INTEGRAL):
        return "integer"
    if isinstance(dtype, NUMERIC):
        return "number"
    if isinstance(dtype, T.StringType):
        return "string"
    if isinstance(dtype, TEMPORAL):
        return "time"
    return "boolean" if isinstance(dtype, T.BooleanType) else "other"


def name_has(name: Column, parts: list[str]) -> Column:
    return F.lower(name).rlike("|".join(parts))


def long_rows(df: DataFrame, by: list[str], per_column: list[Column]) -> DataFrame:
    """One aggregate row per group, turned into one row per column; wide tables go in chunks of columns."""
    chunks = []
    for i in range(0, len(per_column), WIDE):
        part = per_column[i:i + WIDE]
        named = [c.alias(f"s{k}") for k, c in enumerate(part)]
        wide = df.groupBy(*by).agg(*named) if by else df.agg(*named)
        chunks.append(wide.select(*by, F.inline(F.array(*[f"s{k}" for k in range(len(part))]))))
    return reduce(DataFrame.unionByName, chunks)


def value_table(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """Counts per distinct non-null value: (by..., column, value, n), values as text after grouping."""
    by = list(by or [])
    kinds: dict[str, list[str]] = {}
    for c in cols:
        dtype = df.schema[c].dataType
        if isinstance(dtype, INTEGRAL):
            kind = "bigint"
        elif isinstance(dtype, FLOATING):
            kind = "double"
        else:
            kind = "string"
        kinds.setdefault(kind, []).append(c)
    tables = []
    for kind, names in kinds.items():
        flat = [F.col(c).cast(kind) if not isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType))
                else F.to_json(F.col(c)) for c in names]
        long = df.select(*by, *[e.alias(c) for e, c in zip(flat, names)]).unpivot(by, names, "column", "value")
        counts = long.filter("value is not null").groupBy(*by, "column", "value").agg(F.count("*").alias("n"))
        tables.append(counts.withColumn("value", F.col("value").cast("string")))
    return reduce(DataFrame.unionByName, tables)


def _short(df: DataFrame, c: str):
    """A stand-in for a value that differs where the value differs: long texts by their digest, so they are not shuffled."""
    if not isinstance(df.schema[c].dataType, T.StringType):
        return F.col(c)
    return F.when(F.length(c) <= 32, F.col(c)).otherwise(F.concat(F.lit("#"), F.md5(c)))


def distinct_counts(df: DataFrame, cols: list[str], by: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Distinct non-null values: (by..., column, nunique)."""
    by = list(by or [])
    if exact:
        slim = df.select(*by, *[_short(df, c).alias(c) for c in cols])
        return value_table(slim, cols, by).groupBy(*by, "column").agg(F.count("*").alias("nunique"))
    return long_rows(df, by, [F.struct(F.lit(c).alias("column"), F.approx_count_distinct(c).alias("nunique")) for c in cols])


def profile_counts(df: DataFrame, by: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Rows, missing and distinct values per column."""
    by = list(by or [])
    cols = [c for c in df.columns if c not in by]
    facts = [F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"),
                      (F.count("*") - F.count(F.col(c))).alias("missing")) for c in cols]
    counts = long_rows(df, by, facts)
    return _attach(counts, distinct_counts(df, cols, by, exact), by).fillna({"nunique": 0})


def _attach(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    return attach(left, right, by + ["column"])


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: rows, distinct rows and rows equal to an earlier one."""
    counts = df.groupBy(*df.columns).agg(F.count("*").alias("__n"))
    return counts.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_rows"),
                      F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"))


def _moments(c: str) -> list[Column]:
    x = F.col(c).cast("double")
    return [F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("std")]


def numeric_stats(df: DataFrame, cols: list[str], by: list[str] | None = None, exact: bool = True,
                  limit: int | None = None) -> DataFrame:
    """Count, min, max, mean, sample deviation and quartiles per column; missing statistics are 0.0."""
    by = list(by or [])
    named = lambda c: F.lit(c).alias("column")
    if exact and (by or largest_group(df.select(*cols), []) > (TABLE_ROWS if limit is None else limit)):
        base = long_rows(df, by, [F.struct(named(c), *_moments(c)) for c in cols])
        both = _attach(base, quantiles(df, cols, QUARTERS, by, True, limit).drop("n"), by)
    else:
        probs = F.array(*[F.lit(p) for p in QUARTERS])
        q = lambda c: F.percentile(c, probs) if exact else F.percentile_approx(c, QUARTERS, 10_000)
        both = long_rows(df, by, [F.struct(named(c), *_moments(c), q(F.col(c).cast("double")).alias("q")) for c in cols])
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return both.select(
        *by, "column", "n", *[zero(F.col(c)).alias(c) for c in ("min", "max", "mean", "std")],
        *[zero(F.col("q")[i]).alias(f"p{round(p * 100)}") for i, p in enumerate(QUARTERS)])


def text_length_stats(df: DataFrame, cols: list[str], by: list[str] | None = None, exact: bool = True) -> DataFrame:
    """The numeric statistics of the character length of text columns."""
    by = list(by or [])
    return numeric_stats(df.select(*by, *[F.length(c).alias(c) for c in cols]), cols, by, exact)


def integer_like(df: DataFrame, cols: list[str]) -> DataFrame:
    """Whether every non-null value of a column is integral."""
    def whole(c):
        x = F.col(c).cast("double")
        return F.coalesce(F.bool_and(x == F.floor(x)), F.lit(False))

    return long_rows(df, [], [F.struct(F.lit(c).alias("column"), whole(c).alias("integer_like")) for c in cols])


def top_categories(df: DataFrame, cols: list[str], k: int = 5, by: list[str] | None = None) -> DataFrame:
    """The k most frequent values per column, equal counts in value order: (by..., column, rank, value, n)."""
    by = list(by or [])
    w = Window.partitionBy(*by, "column").orderBy(F.desc("n"), "value")
    ranked = value_table(df, cols, by).withColumn("rank", F.row_number().over(w))
    return ranked.filter(F.col("rank") <= k).select(*by, "column", "rank", "value", "n")


def value_counts(df: DataFrame, c: str) -> DataFrame:
    return df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))


def majority_share(df: DataFrame, t: str, limit: float = 0.7) -> DataFrame:
    """The most frequent class, its share, and whether the classes are imbalanced."""
    counts = value_counts(df, t)
    total = counts.agg(F.sum("n")).scalar()
    top = counts.orderBy(F.desc("n"), t).limit(1)
    share = F.col("n") / total
    return top.select(F.col(t).cast("string").alias("majority_class"), share.alias("share"), (share > limit).alias("imbalanced"))


def column_facts(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Everything the type rule needs, from one pass: (by..., column, position, family, rows, non_null, ...)."""
    by = list(by or [])
    facts = []
    for i, c in enumerate(x for x in df.columns if x not in by):
        kind = family(df.schema[c].dataType)
        x, none = F.col(c), F.lit(None)
        number = x.cast("double")
        dated = any(k in c.lower() for k in DATE_NAMES)
        is_num = kind in ("integer", "number")
        whole = F.lit(True) if kind == "integer" else (F.bool_and(number == F.floor(number)) if kind == "number" else F.lit(False))
        # Text facts decide only for texts and nested values; numbers and times are short and free of commas.
        worded = kind == "string" or (kind == "other" and not isinstance(df.schema[c].dataType, T.BinaryType))
        text = x if kind == "string" else F.to_json(x) if worded else None
        facts.append(F.struct(
            F.lit(c).alias("column"), F.lit(i).alias("position"), F.lit(kind).alias("family"),
            F.count("*").alias("rows"), F.count(x).alias("non_null"),
            F.coalesce(whole, F.lit(False)).alias("integer_like"),
            (F.avg(F.length(text)) if worded else none.cast("double")).alias("mean_length"),
            (F.coalesce(F.bool_or(text.rlike(r"\s")), F.lit(False)) if kind == "string" else F.lit(False)).alias("has_blank"),
            (F.avg(F.when(x.isNotNull(), to_datetime(c).isNotNull().cast("int"))) if kind == "string" and dated
             else none.cast("double")).alias("date_share"),
            (F.avg(text.contains(",").cast("int")) if worded else none.cast("double")).alias("comma_share"),
            (F.avg(F.length(text) - F.length(F.replace(text, F.lit(","), F.lit(""))) + 1) if worded else none.cast("double")).alias("mean_parts"),
            (F.min(number) if is_num else none.cast("double")).alias("min"),
            (F.max(number) if is_num else none.cast("double")).alias("max"),
            (F.avg(number) if is_num else none.cast("double")).alias("mean"),
            (F.stddev_samp(number) if is_num else none.cast("double")).alias("std"),
            F.min(x.cast("string") if kind == "time" else none.cast("string")).alias("first_time"),
            F.max(x.cast("string") if kind == "time" else none.cast("string")).alias("last_time"),
        ))
    return long_rows(df, by, facts)


def is_identifier() -> Column:
    """Nearly unique and either named like a key or a short text without blanks."""
    name = F.lower("column")
    unique = (F.col("non_null") > 0) & (F.col("nunique") / F.greatest(F.col("non_null"), F.lit(1)) >= 0.98)
    named = name.isin(ID_NAMES) | name.endswith("id") | name.startswith("id_") | name.endswith("key") | name.startswith("key_")
    short = (F.col("family") == "string") & ~F.col("has_blank") & (F.col("mean_length") < 40) & (name != "password")
    return unique & (named | F.coalesce(short, F.lit(False)))


def is_datetime() -> Column:
    """Temporal columns, date-named texts that parse, and date-named numbers (any number reads as an epoch)."""
    dated_number = F.col("family").isin("integer", "number") & name_has(F.col("column"), DATE_NAMES) & (F.col("non_null") > 0)
    return (F.col("family") == "time") | F.coalesce(F.col("date_share") >= 0.8, F.lit(False)) | dated_number


def is_categorical_number() -> Column:
    name = F.col("column")
    n = F.col("nunique")
    return (n <= 2) | ((n <= 15) & name_has(name, CATEGORY_NAMES)) | (
        (n <= 5) & F.col("integer_like") & ~name_has(name, CONTINUOUS_NAMES))


def is_numeric() -> Column:
    return F.col("family").isin("integer", "number") & ~is_categorical_number()


def is_multilabel() -> Column:
    return F.coalesce((F.col("comma_share") >= 0.1) & (F.col("mean_parts") > 1.1), F.lit(False))


def logical_type(overrides: dict[str, str] | None = None) -> Column:
    """identifier, datetime, numeric, text or categorical, in that priority; overrides win."""
    texty = F.coalesce((F.col("mean_length") > 50) | ((F.col("family") == "string") & (F.col("nunique") > 100)), F.lit(False))
    rule = (F.when(is_identifier(), "identifier").when(is_datetime(), "datetime").when(is_numeric(), "numeric")
            .when(texty, "text").otherwise("categorical"))
    for c, kind in (overrides or {}).items():
        rule = F.when(F.col("column") == c, F.lit(kind)).otherwise(rule)
    return rule


def typed_facts(df: DataFrame, overrides: dict[str, str] | None = None, exact: bool = True,
                by: list[str] | None = None) -> DataFrame:
    """Facts, distinct count, logical type and multi-label flag per column."""
    by = list(by or [])
    cols = [c for c in df.columns if c not in by]
    facts = _attach(column_facts(df, by), distinct_counts(df, cols, by, exact), by).fillna({"nunique": 0})
    typed = facts.withColumn("type", logical_type(overrides))
    return typed.withColumn("is_multi_label", F.col("type").isin("categorical", "text") & is_multilabel())


def infer_column_type(df: DataFrame, overrides: dict[str, str] | None = None, exact: bool = True) -> DataFrame:
    return typed_facts(df, overrides, exact).select("column", "type", "is_multi_label")


def profile(df: DataFrame, overrides: dict[str, str] | None = None, exact: bool = True, by: list[str] | None = None) -> DataFrame:
    """One row per column: counts, logical type, and statistics of numbers or of text lengths."""
    by = list(by or [])
    facts = typed_facts(df, overrides, exact, by)
    cols = [f.name for f in df.schema.fields if f.name not in by]
    numbers = [c for c in cols if family(df.schema[c].dataType) in ("integer", "number")]
    texts = [c for c in cols if family(df.schema[c].dataType) == "string"]
    measured = df.select(*by, *numbers, *[F.length(c).alias(c) for c in texts])
    stats = numeric_stats(measured, numbers + texts, by, exact) if numbers or texts else None
    names = ["min", "max", "mean", "std", "p25", "p50", "p75"]
    base = facts.select(*by, "column", "position", "family", "rows", (F.col("rows") - F.col("non_null")).alias("missing"),
                        "nunique", "type", "is_multi_label", "integer_like", "first_time", "last_time")
    if stats is None:
        return base.select("*", *[F.lit(None).cast("double").alias(n) for n in names])
    both = _attach(base, stats.drop("n"), by)
    shown = F.col("type").isin("numeric") | ((F.col("type") == "text") & (F.col("family") == "string"))
    return both.withColumns({n: F.when(shown, F.col(n)) for n in names})


def detect_identifier(df: DataFrame) -> DataFrame:
    return typed_facts(df).filter(is_identifier()).select("column", "non_null", "nunique")


def detect_datetime(df: DataFrame) -> DataFrame:
    return typed_facts(df).filter(is_datetime()).select("column", "family")


def detect_multilabel(df: DataFrame) -> DataFrame:
    facts = column_facts(df)
    return facts.select("column", F.col("comma_share"), F.col("mean_parts"), is_multilabel().alias("is_multi_label"))


def datetime_bounds(df: DataFrame) -> DataFrame:
    """First and last day of every temporal column, and of text columns whose date-like values parse."""
    facts = []
    for f in df.schema.fields:
        dated = any(k in f.name.lower() for k in DATE_NAMES)
        if isinstance(f.dataType, TEMPORAL):
            day = F.col(f.name).cast("date")
        elif isinstance(f.dataType, T.StringType) and dated:
            day = to_datetime(f.name).cast("date")
        else:
            continue
        facts.append(F.struct(F.lit(f.name).alias("column"), F.date_format(F.min(day), "yyyy-MM-dd").alias("min_day"),
                              F.date_format(F.max(day), "yyyy-MM-dd").alias("max_day")))
    return long_rows(df, [], facts).filter("min_day is not null")


def column_categories(df: DataFrame, cols: list[str], k: int = 30) -> DataFrame:
    """Up to k distinct non-blank values per column, in order: (column, value)."""
    values = value_table(df, cols).filter(F.trim("value") != "").select("column", "value")
    w = Window.partitionBy("column").orderBy("value")
    return values.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("column", "value")


def histogram(df: DataFrame, c: str, bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """Equal-width bins on the column's [min, max], the last one closed, empty bins kept.

    (by..., bin, low, high, mid, n); with `by` the edges stay common to all groups.
    """
    by = list(by or [])
    x = F.col(c).cast("double")
    edges = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    if edges["lo"] is None:
        return df.sparkSession.createDataFrame([], T.StructType([df.schema[b] for b in by] + [
            T.StructField("bin", T.IntegerType())] + [T.StructField(n, T.DoubleType()) for n in ("low", "high", "mid")] + [
            T.StructField("n", T.LongType())]))
    lo, hi = edges["lo"], edges["hi"]
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    bin_of = F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    found = df.filter(x.isNotNull()).groupBy(*by, bin_of.alias("bin")).agg(F.count("*").alias("n"))
    if by:
        # The groups come from the counts themselves; each gets all bins, a fixed number.
        slots = found.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    else:
        slots = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    low = F.lit(lo) + F.col("bin") * F.lit(width)
    full = attach(slots, found, by + ["bin"]).withColumn("n", F.coalesce("n", F.lit(0)))
    return full.select(*by, "bin", low.alias("low"), (low + width).alias("high"), (low + width / 2).alias("mid"), "n")


def boxplot_stats(df: DataFrame, cols: list[str], by: list[str] | None = None, top: int | None = 5, exact: bool = True,
                  limit: int | None = None) -> DataFrame:
    """Quartiles, whiskers (extreme values inside the fences) and outlier share per column, worst columns first.

    (by..., column, n, whisker_low, q1, median, q3, whisker_high, outliers, outlier_share); columns with fewer
    than five values are left out.
    """
    by = list(by or [])
    f = fences(df, cols, by, exact, limit)
    flat = f.select(*by, "column", *[F.when(F.col("q3") > F.col("q1"), F.col(n)).alias(n) for n in ("low", "high")])
    inside = _spread(df, cols, by, flat)
    both = _attach(f, inside, by).filter("n >= 5")
    share = F.when(F.col("q3") > F.col("q1"), F.col("outliers") / F.col("n")).otherwise(F.lit(0.0))
    out = both.select(*by, "column", "n", F.coalesce("whisker_low", "q1").alias("whisker_low"), "q1", "median", "q3",
                      F.coalesce("whisker_high", "q3").alias("whisker_high"), "outliers", share.alias("outlier_share"))
    if top is None:
        return out
    w = Window.partitionBy(*by).orderBy(F.desc("outlier_share"), "column")
    return out.withColumn("__rk", F.row_number().over(w)).filter(F.col("__rk") <= top).drop("__rk")


def _spread(df: DataFrame, cols: list[str], by: list[str], bounds: DataFrame) -> DataFrame:
    """Extreme values inside each column's bounds and the number of values outside."""
    if not by:
        # One row per column: the bounds become literals and the pass stays narrow up to the aggregate.
        limits = {r["column"]: (r["low"], r["high"]) for r in bounds.collect()}
        facts = []
        for c in cols:
            lo, hi = limits[c]
            x = F.col(c).cast("double")
            ok = x.isNotNull() if lo is None else x.between(lo, hi)
            facts.append(_spread_facts(F.lit(c), x, ok))
        return long_rows(df, [], facts)
    doubles = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols])
    long = doubles.unpivot(by, cols, "column", "value").filter("value is not null")
    keys = by + ["column"]
    joined = attach(long, bounds, keys, "inner")
    ok = F.col("low").isNull() | F.col("value").between(F.col("low"), F.col("high"))
    return joined.groupBy(*keys).agg(*_spread_columns(F.col("value"), ok))


def _spread_columns(x: Column, ok: Column) -> list[Column]:
    return [F.min(F.when(ok, x)).alias("whisker_low"), F.max(F.when(ok, x)).alias("whisker_high"),
            F.count(F.when(~ok, x)).alias("outliers")]


def _spread_facts(name: Column, x: Column, ok: Column) -> Column:
    return F.struct(name.alias("column"), *_spread_columns(x, ok))


def box_outliers(df: DataFrame, c: str, box: DataFrame, k: int = 100) -> DataFrame:
    """The k smallest values of a column beyond its whiskers."""
    b = box.filter(F.col("column") == c).first()
    x = F.col(c).cast("double")
    return df.filter((x < b["whisker_low"]) | (x > b["whisker_high"])).select(x.alias("value")).orderBy("value").limit(k)


def outlier_share(df: DataFrame, cols: list[str], exact: bool = True) -> DataFrame:
    """Share of all rows outside the fences, with the alert (over 1 %) and recommendation (over 5 %) flags."""
    box = boxplot_stats(df, cols, top=None, exact=exact)
    rows = df.count()
    share = F.col("outliers") / F.lit(rows)
    return box.select("column", "outliers", share.alias("share"), (share > 0.01).alias("alert"), (share > 0.05).alias("recommend"))


def adjusted_skewness(c: str) -> Column:
    """Bias-adjusted skewness as an aggregate."""
    x = F.col(c).cast("double")
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def skew_alert(df: DataFrame, cols: list[str], limit: float = 1.5) -> DataFrame:
    table = long_rows(df, [], [F.struct(F.lit(c).alias("column"), adjusted_skewness(c).alias("skewness")) for c in cols])
    return table.withColumn("alert", F.coalesce(F.abs("skewness") > limit, F.lit(False)))


def missing_alert(profile_table: DataFrame, limit: float = 0.3) -> DataFrame:
    share = F.col("missing") / F.col("rows")
    return profile_table.select("column", "missing", share.alias("share")).filter(F.col("share") > limit)


def missing_top(profile_table: DataFrame, k: int = 10) -> DataFrame:
    return profile_table.filter("missing > 0").orderBy(F.desc("missing"), "column").limit(k).select("column", "missing")


def calendar_avg(df: DataFrame, ts: str, y: str, part: str) -> DataFrame:
    """Mean by month of the year or day of the month."""
    unit = {"month": F.month, "day": F.dayofmonth}[part]
    return df.filter(F.col(ts).isNotNull() & F.col(y).isNotNull()).groupBy(unit(ts).alias(part)).agg(F.avg(y).alias("mean"))


def typical_row(profile_table: DataFrame, tops: DataFrame) -> DataFrame:
    """One default value per column: median of numbers (rounded when whole), most frequent value otherwise."""
    first = tops.filter("rank = 1").select("column", F.col("value").alias("top"))
    both = profile_table.join(first, "column", "left")
    median = F.when(F.col("integer_like"), F.round("p50", 0)).otherwise(F.col("p50"))
    return both.filter("type <> 'identifier'").select(
        "column", F.when(F.col("type") == "numeric", median).alias("number"),
        F.when(F.col("type") != "numeric", F.col("top")).alias("category"))


def dataset_type(df: DataFrame) -> DataFrame:
    """One row saying timeseries, nlp or tabular, from column names and one pass over the text columns."""
    if any(k in c.lower() for c in df.columns for k in SERIES_NAMES):
        return df.select(F.lit("timeseries").alias("dataset_type")).limit(1)
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df.select(F.lit("tabular").alias("dataset_type")).limit(1)
    prose = F.lit(False)
    for c in texts:
        blanks = F.size(F.regexp_extract_all(F.col(c), F.lit(r"(\s+)"), F.lit(1)))
        hit = (F.avg(F.length(c)) > 60) & (F.avg(F.when(F.col(c).isNotNull(), blanks)) + 1 > 4)
        prose = prose | F.coalesce(hit, F.lit(False))
    return df.agg(F.when(prose, "nlp").otherwise("tabular").alias("dataset_type"))


def infer_dataset_type(df: DataFrame) -> str:
    row = dataset_type(df).first()
    return row[0] if row else "tabular"
