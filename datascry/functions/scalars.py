"""Column -> Column functions. All stay inside Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def to_numeric(c) -> Column:
    """Number, or null where the value does not parse."""
    return column(c).try_cast("double")


def to_datetime(c, fmt: str | None = None) -> Column:
    """Timestamp, or null where the value does not parse."""
    if fmt:
        return F.try_to_timestamp(column(c), F.lit(fmt))
    return F.try_to_timestamp(column(c))


def finite(c) -> Column:
    """NaN and both infinities become null."""
    c = column(c)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def transform_log(c) -> Column:
    c = column(c).cast("double")
    return F.when(c.isNotNull(), F.log1p(F.greatest(F.lit(0.0), c)))


def transform_power(c) -> Column:
    c = column(c).cast("double")
    return c * c


def transform_interaction(a, b) -> Column:
    return column(a).cast("double") * column(b).cast("double")


# What an unparsable date becomes.
DATE_DEFAULTS = {"year": 2000, "month": 1, "day": 1, "dayofweek": 0, "hour": 0}


def transform_date(c, dtype: T.DataType) -> dict[str, Column]:
    """Calendar parts of a date, timestamp or text column; Monday is 0."""
    stamp = column(c) if isinstance(dtype, TEMPORAL) else to_datetime(c)
    parts = {
        "year": F.year(stamp),
        "month": F.month(stamp),
        "day": F.dayofmonth(stamp),
        "dayofweek": F.weekday(stamp),
        "hour": F.lit(0) if isinstance(dtype, T.DateType) else F.hour(stamp),
    }
    return {k: F.coalesce(v, F.lit(DATE_DEFAULTS[k])) for k, v in parts.items()}


def clip(c, low: float, high: float) -> Column:
    """Clamp to [low, high]; null stays null."""
    c = column(c)
    return F.when(c < low, F.lit(low)).when(c > high, F.lit(high)).otherwise(c)


def micros(c, dtype: T.DataType) -> Column:
    """Order-keeping microseconds of a temporal column, free of the session time zone for zoneless types."""
    c = column(c)
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c)
    day = F.unix_date(c.cast("date")).cast("long") * 86_400_000_000
    if isinstance(dtype, T.DateType):
        return day
    second = (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
    return day + F.hour(c).cast("long") * 3_600_000_000 + F.minute(c).cast("long") * 60_000_000 + second


def epoch_seconds(c, dtype: T.DataType) -> Column:
    """Whole seconds since 1970; zoneless times count as UTC."""
    return F.floor(micros(c, dtype) / 1_000_000).cast("long")


def hash_bucket(key, buckets: int = 1_000_000, salt: str = "") -> Column:
    """Stable bucket of a key: the first 32 bits of md5, modulo. Same on every engine and every run."""
    cols = [key] if isinstance(key, (str, Column)) else list(key)
    text = F.concat_ws("|", *[column(c).cast("string") for c in cols])
    if salt:
        text = F.concat(text, F.lit(salt))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % buckets


def json_props(c, fields: list[str]) -> dict[str, Column]:
    """One level of a JSON object as text columns."""
    return {f: F.get_json_object(column(c), f"$.{f}") for f in fields}


def parse_multilabel(c) -> Column:
    """'[a, "b"]' or 'a,b' as an array of bare tags, blanks dropped."""
    body = F.trim(F.coalesce(column(c), F.lit("")))
    inner = F.when(
        body.startswith("[") & body.endswith("]") & (F.length(body) >= 2), F.substring(body, F.lit(2), F.length(body) - 2)
    ).otherwise(body)

    def bare(tag):
        return F.trim(F.btrim(F.btrim(F.trim(tag), F.lit("'")), F.lit('"')))

    return F.filter(F.transform(F.split(inner, ","), bare), lambda tag: tag != "")


def box_area(w, h) -> Column:
    return column(w) * column(h)


def box_aspect(w, h, floor: float | None = None) -> Column:
    """w / h; a zero height gives 0, or is replaced by `floor` when one is given."""
    w, h = column(w), column(h)
    if floor is None:
        return F.when(h > 0, w / h).otherwise(F.lit(0.0))
    return w / F.when(h == 0, F.lit(floor)).otherwise(h)


def box_corners(cx, cy, w, h, width: int, height: int) -> dict[str, Column]:
    """Corner pixels of a normalised box, cut at the image border."""
    cx, cy, w, h = (column(c) for c in (cx, cy, w, h))
    return {
        "x1": F.greatest(F.lit(0), ((cx - w / 2) * width).cast("int")),
        "y1": F.greatest(F.lit(0), ((cy - h / 2) * height).cast("int")),
        "x2": F.least(F.lit(width), ((cx + w / 2) * width).cast("int")),
        "y2": F.least(F.lit(height), ((cy + h / 2) * height).cast("int")),
    }


def square_shape(arr) -> Column:
    """struct(h, w, c) when the array length is a square, or three times a square; otherwise null."""
    n = F.size(column(arr))
    grey = F.floor(F.sqrt(n)).cast("int")
    rgb = F.floor(F.sqrt(n / 3)).cast("int")
    return (
        F.when(grey * grey == n, F.struct(grey.alias("h"), grey.alias("w"), F.lit(1).alias("c")))
        .when((n % 3 == 0) & (rgb * rgb * 3 == n), F.struct(rgb.alias("h"), rgb.alias("w"), F.lit(3).alias("c")))
    )
