"""Ordered operators over one or many series, without giving any task a whole hot series.

A key whose rows are few enough (checked with a pre-aggregated count) takes an ordinary window per key.
Beyond that limit rows are numbered exactly through range partitions of the whole order, and window functions
run over blocks of consecutive row numbers; rows near a block's edge are repeated into the neighbour block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from datascry.operators.keys import attach
from datascry.session import stored

HOT_ROWS = 2_000_000

RN = "__rn"
BLOCK = "__block"
RANGE = "__range"
HOME = "__home"


def largest_group(df: DataFrame, key: list[str]) -> int:
    """Rows of the biggest key; the whole row count when there is no key."""
    if not key:
        return df.count()
    return df.groupBy(*key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def in_ranges(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """`df` with its range partition number in RANGE: rows of a group are split by their whole order, so no hot group stays in one task.

    The number of ranges is that of shuffle partitions, and the table is stored, so that sizes and rows are counted on the same ranges.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(n, *group, *order).withColumn(RANGE, F.spark_partition_id()), "in-ranges")


def starts_of(ranges: DataFrame, group: list[str], sums: dict[str, Column]) -> DataFrame:
    """Per group and range: each sum over the ranges before it, and <name>_all over the whole group.

    Without a group that is one row per range.
    """
    sizes = ranges.groupBy(*group, RANGE).agg(*[v.alias(n) for n, v in sums.items()])
    every = Window.partitionBy(*group)
    before = every.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(*group, RANGE, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums], *[F.sum(n).over(every).alias(f"{n}_all") for n in sums])


def running_totals(df: DataFrame, group: list[str], order: list[str], values: dict[str, Column | str]) -> DataFrame:
    """`df` with <name> = sum of the value over the group's rows up to this one, and <name>_all over the group.

    Rows go to ranges of the order; totals of whole ranges are added up once, and running sums stay inside a range.
    """
    values = {n: F.col(v) if isinstance(v, str) else v for n, v in values.items()}
    ranges = in_ranges(df, group, order)
    starts = starts_of(ranges, group, {n: F.sum(v) for n, v in values.items()}).withColumnsRenamed({n: f"__{n}" for n in values})
    upto = Window.partitionBy(*group, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranges.withColumns({f"__to_{n}": F.sum(v).over(upto) for n, v in values.items()})
    joined = attach(local, starts, group + [RANGE], "inner")
    return joined.select(*[c for c in df.columns if c not in values], *[(F.col(f"__{n}") + F.col(f"__to_{n}")).alias(n) for n in values], *[f"{n}_all" for n in values])


class Sequence:
    """Rows of each key in a total order given by `order` (the last column breaks ties)."""

    def __init__(self, df: DataFrame, key: list[str], order: list[str], limit: int | None = None):
        self.df = df
        self.key = list(key)
        self.order = list(order)
        self.limit = HOT_ROWS if limit is None else limit
        self.rows = largest_group(df, self.key)
        self.hot = self.rows > self.limit

    def _window(self) -> WindowSpec:
        return Window.partitionBy(*self.key).orderBy(*self.order)

    def _backwards(self) -> WindowSpec:
        """From the end of the series: a frame that only grows costs one step per row, one that shrinks does not."""
        return Window.partitionBy(*self.key).orderBy(*[F.desc(c) for c in self.order]).rowsBetween(Window.unboundedPreceding, 0)

    def numbered(self, name: str = RN) -> DataFrame:
        """Exact 1-based position of every row in its series."""
        if not self.hot:
            return self.df.withColumn(name, F.row_number().over(self._window()).cast("long"))
        parts = in_ranges(self.df, self.key, self.order)
        starts = starts_of(parts, self.key, {"__start": F.count("*")})
        local = parts.withColumn("__local", F.row_number().over(Window.partitionBy(*self.key, RANGE).orderBy(*self.order)))
        joined = attach(local, starts, self.key + [RANGE])
        return joined.select(*self.df.columns, (F.col("__start") + F.col("__local")).alias(name))

    def _blocks(self, before: int, after: int) -> DataFrame:
        """Numbered rows with their block; rows near an edge appear in the neighbour blocks too."""
        size = max(self.limit // 2, before + after + 1)
        at = F.col(RN) - 1
        home = F.floor(at / size)
        low = F.greatest(F.lit(0), F.floor((at - after) / size))
        high = F.floor((at + before) / size)
        return (self.numbered().withColumn(HOME, home)
                .withColumn(BLOCK, F.explode(F.sequence(low.cast("long"), high.cast("long")))))

    def apply(self, columns: dict[str, Callable[[WindowSpec, Column], Column]], before: int = 0, after: int = 0) -> DataFrame:
        """Add window columns. Each function gets (window, position); it may look `before` rows back and `after` ahead."""
        if not self.hot:
            w = self._window()
            position = F.row_number().over(w).cast("long")
            return self.df.withColumns({n: fn(w, position) for n, fn in columns.items()})
        rows = self._blocks(before, after)
        w = Window.partitionBy(*self.key, BLOCK).orderBy(RN)
        out = rows.withColumns({n: fn(w, F.col(RN)) for n, fn in columns.items()})
        return out.filter(F.col(BLOCK) == F.col(HOME)).select(*self.df.columns, *[n for n in columns if n not in self.df.columns])

    def neighbours(self, c: str, prefix: str) -> DataFrame:
        """Position of each row, and value and position of the nearest non-null `c` at or before and at or after it.

        Adds <prefix>_at, <prefix>_prev, <prefix>_prev_at, <prefix>_next and <prefix>_next_at.
        """
        at = f"{prefix}_at"
        names = {k: f"{prefix}_{k}" for k in ("prev", "prev_at", "next", "next_at")}
        rows = self.numbered(at)
        known = F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.col(at).alias("p")))
        if not self.hot:
            back = self._window().rowsBetween(Window.unboundedPreceding, 0)
            out = rows.withColumns({"__p": F.last(known, True).over(back), "__n": F.last(known, True).over(self._backwards())})
        else:
            size = max(self.limit // 2, 1)
            rows = rows.withColumn(BLOCK, F.floor((F.col(at) - 1) / size))
            group = self.key + [BLOCK]
            edges = rows.groupBy(*group).agg(F.max_by(known, F.when(known.isNotNull(), F.col(at))).alias("__last"),
                                             F.min_by(known, F.when(known.isNotNull(), F.col(at))).alias("__first"))
            earlier, later = (Window.partitionBy(*self.key).orderBy(o).rowsBetween(Window.unboundedPreceding, -1)
                              for o in (F.asc(BLOCK), F.desc(BLOCK)))
            carried = edges.select(*group, F.last("__last", True).over(earlier).alias("__in"), F.last("__first", True).over(later).alias("__out"))
            back, ahead = (Window.partitionBy(*group).orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc(at), F.desc(at)))
            local = rows.withColumns({"__lp": F.last(known, True).over(back), "__ln": F.last(known, True).over(ahead)})
            out = attach(local, carried, group).select(
                                *self.df.columns, at,
                                F.coalesce("__lp", "__in").alias("__p"), F.coalesce("__ln", "__out").alias("__n"))
        return out.select(
            *self.df.columns, at,
            F.col("__p.v").alias(names["prev"]), F.col("__p.p").alias(names["prev_at"]),
            F.col("__n.v").alias(names["next"]), F.col("__n.p").alias(names["next_at"]),
        )


def numbered_by_hash(df: DataFrame, key, group: list[str], name: str = "rank", limit: int | None = None) -> DataFrame:
    """Exact position of each row in its group by the md5 of `key`.

    Hashes spread evenly, so for a hot group their leading digits give ranges of equal size without a scan.
    """
    limit = HOT_ROWS if limit is None else limit
    cols = [key] if isinstance(key, str) else list(key)
    digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cols]))
    if largest_group(df, group) <= limit:
        w = Window.partitionBy(*group).orderBy("__hash", *cols)
        return df.withColumn("__hash", digest).withColumn(name, F.row_number().over(w).cast("long")).drop("__hash")
    rows = df.withColumn(RANGE, F.substring(digest, 1, 3))
    parts = group + [RANGE]
    sizes = rows.groupBy(*parts).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*group).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*parts, F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__start"))
    # The long digest is taken again behind the shuffle, not sent through it.
    local = rows.repartition(*parts).withColumn("__hash", digest)
    local = local.withColumn("__local", F.row_number().over(Window.partitionBy(*parts).orderBy("__hash", *cols)))
    return attach(local, starts, parts).select(*df.columns, (F.col("__start") + F.col("__local")).alias(name))
