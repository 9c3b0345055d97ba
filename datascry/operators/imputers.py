"""Row-local imputers fitted on training rows: nearest donors and chained regressions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datascry.operators.keys import attach, spread
from datascry.session import stored

# Donor rows one task may hold, and rows of a block of donors or of incomplete rows beyond that.
DONOR_ROWS = 50_000
QUERY_ROWS = 20_000
# Donor blocks that one call gets, on average.
CALL_BLOCKS = 16
# Boxes of donor blocks that travel with the tasks at most; blocks grow with the table so that there are no more.
MAX_BOXES = 50_000
# Missing patterns for which donors are laid out by the columns known there, at most; a pattern gets a layout of its own from one row
# in LAYOUT_SHARE donors on. Others use the layout by all columns.
MAX_LAYOUTS = 8
LAYOUT_SHARE = 1000
# Distances between rows and boxes, and between rows and donors, that a task holds at once.
BOUNDS = 1_000_000
DISTANCES = 1 << 18
# Rows whose quantiles place the cuts of a layout. They say which rows lie together, never which ones count.
CUT_ROWS = 200_000
BLOCK = "__block"
LAYOUT = "__layout"


def any_null(cols: list[str]):
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])


def as_double(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


def patterns_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of a matrix of yes and no, and the number of each row's kind."""
    if mask.shape[1] > 60:
        kinds, kind = np.unique(mask, axis=0, return_inverse=True)
        return kinds, kind.ravel()
    _, first, kind = np.unique(mask @ (1 << np.arange(mask.shape[1])), return_index=True, return_inverse=True)
    return mask[first], kind


def nearest_values(queries: np.ndarray, donors: np.ndarray, k: int, radius: np.ndarray | None = None):
    """(rows, columns, distances, values): per query row and missing column the k nearest donors, nearest first, ties by value.

    Distances use the coordinates both rows have, scaled up to all coordinates. With a `radius` per row, no donors beyond it. Rows of one
    missing pattern meet the donors of one pattern at once.
    """
    width = queries.shape[1]
    have, known = ~np.isnan(queries), ~np.isnan(donors)
    radius = np.full(len(queries), np.inf) if radius is None else radius
    kinds, kind = patterns_of(known)
    own = [slice(None)] if len(kinds) == 1 else [np.flatnonzero(kind == i) for i in range(len(kinds))]
    by_value = {}
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0))]
    patterns, pattern = patterns_of(have)
    for number, has in enumerate(patterns):
        asked = np.flatnonzero(pattern == number)
        step = max(1, DISTANCES // max(len(donors), 1))
        for start in range(0, len(asked) if len(donors) and not has.all() else 0, step):
            rows = asked[start:start + step]
            dist = np.full((len(rows), len(donors)), np.inf)
            for group, knows in zip(own, kinds):
                shared = np.flatnonzero(has & knows)
                if len(shared):
                    d2 = 0.0
                    for j in shared:
                        gap = queries[rows, j][:, None] - donors[group, j][None, :]
                        gap *= gap
                        d2 = gap + d2
                    d2 *= width
                    d2 /= len(shared)
                    dist[:, group] = d2
            for j in np.flatnonzero(~has):
                if j not in by_value:
                    some = np.flatnonzero(known[:, j])
                    by_value[j] = some[np.argsort(donors[some, j], kind="stable")]
                order = by_value[j]
                if not len(order):
                    continue
                d, bound = dist[:, order], radius[rows]
                near = (d <= bound[:, None]) & (d < np.inf)
                if len(order) > k and np.count_nonzero(near) > 8 * k * len(rows):
                    near &= d <= np.partition(d, k - 1, axis=1)[:, k - 1, None]
                at, place = np.nonzero(near)
                far = d[at, place]
                turn = np.lexsort((place, far, at))
                at, place, far = at[turn], place[turn], far[turn]
                first = np.searchsorted(at, at, "left")
                best = np.arange(len(at)) - first < k
                found.append((rows[at[best]], np.full(np.count_nonzero(best), j), far[best], donors[order[place[best]], j]))
    return tuple(np.concatenate(part) for part in zip(*found))


def pattern_of(cols: list[str]):
    """One digit per column: 0 where it is missing."""
    return F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in cols])


def blocked(df: DataFrame, cols: list[str], rows: int, layout: str = "") -> DataFrame:
    """`df` with a column BLOCK: blocks of about `rows` rows that lie near each other, stored.

    The order is that of the missing pattern, then of interleaved bits of each column's place among its quantiles (a Z curve), then of
    the values; with a `layout`, a missing pattern, only of the columns known there. Range partitions of that order are cut into blocks,
    so no pattern and no value fills a task. Blocks also end where the pattern changes, unless there are so many patterns that blocks
    would get too many. `df` is read three times, so it should be a stored table.
    """
    lead = [c for c, known in zip(cols, layout or "1" * len(cols)) if known == "1"]
    order = lead + [c for c in cols if c not in lead]
    used = lead[:60]
    bits = max(1, min(6, 60 // len(used)))
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    n = df.count()
    some = df.sample(CUT_ROWS / n, seed=42) if n > 2 * CUT_ROWS else df
    found = some.agg(*[F.percentile_approx(c, shares, 1000).alias(f"c{i}") for i, c in enumerate(used)]).first()
    cuts = [np.array(found[f"c{i}"] or [0.0], dtype=float) for i in range(len(used))]

    def place(frames):
        for frame in frames:
            code = np.zeros(len(frame), np.int64)
            for i, c in enumerate(used):
                x = frame[c].to_numpy(dtype=float)
                at = np.where(np.isnan(x), 0, np.searchsorted(cuts[i], x, "right"))
                for k in range(bits):
                    code |= (at >> k & 1) << (k * len(used) + i)
            yield frame.assign(__z=code)

    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    patterns = 1 << len(lead) if len(lead) < 15 else df.select(pattern_of(lead)).distinct().count()
    turn = ["__pattern", "__z", *order]
    coded = df.mapInPandas(place, T.StructType([*df.schema.fields, T.StructField("__z", T.LongType())])).withColumn("__pattern", pattern_of(lead))
    placed = coded.repartitionByRange(ranges, *turn).sortWithinPartitions(*turn).withColumn("__at", F.monotonically_increasing_id())
    # The number of a sorted row holds its partition above 33 bits of its place there.
    part = [F.shiftright("__at", 33), F.floor(F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) / rows)]
    if ranges + patterns <= MAX_BOXES:
        part.append(F.col("__pattern"))
    return stored(placed.withColumn(BLOCK, F.xxhash64(*part, F.lit(layout))).drop("__pattern", "__z", "__at"), "blocks")


def boxes_of(blocks: DataFrame, cols: list[str]) -> DataFrame:
    """One row per block: layout, rows, and per column (in order) least, largest and number of known values."""
    return blocks.groupBy(BLOCK, LAYOUT).agg(F.count("*").alias("rows"), F.array(*[F.min(c) for c in cols]).alias("low"), F.array(*[F.max(c) for c in cols]).alias("high"),
                                             F.array(*[F.count(c) for c in cols]).alias("known"))


class Boxes:
    """Bounds around blocks of donors, as matrices; a bound of a column is used only where every row of the block knows it."""

    def __init__(self, frame: pd.DataFrame):
        self.ids, self.rows, self.layout = frame[BLOCK].to_numpy(np.int64), frame["rows"].to_numpy(np.int64), frame[LAYOUT].to_numpy(object)
        stacked = lambda c: np.array([[np.nan if x is None else x for x in r] for r in frame[c]], dtype=float)
        low, high, self.known = stacked("low"), stacked("high"), stacked("known")
        whole = self.known == self.rows[:, None]
        self.low, self.high = np.where(whole, low, -np.inf), np.where(whole, high, np.inf)
        self.most = (self.known > 0).sum(1)

    def of(self, layout: str) -> Boxes:
        """The blocks of one layout."""
        some, own = object.__new__(Boxes), self.layout == layout
        some.ids, some.rows, some.layout, some.known = self.ids[own], self.rows[own], self.layout[own], self.known[own]
        some.low, some.high, some.most = self.low[own], self.high[own], self.most[own]
        return some

    def around(self, q: np.ndarray, radius: np.ndarray | None, k: int) -> list:
        """(boxes, rows) that together leave out no block that a row of q can meet: boxes near the box around the rows, by `radius` or by the nearest one.

        Rows of one missing pattern go together. Where a nearby block knows too few values of a column, all boxes stay.
        """
        out = []
        patterns, pattern = patterns_of(~np.isnan(q))
        for number, has in enumerate(patterns):
            rows = np.flatnonzero(pattern == number)
            useful = (self.known[:, has] > 0).any(1) & (self.known[:, ~has] > 0).any(1)
            low, high = q[np.ix_(rows, has)].min(0), q[np.ix_(rows, has)].max(0)
            with np.errstate(invalid="ignore"):
                apart = np.nan_to_num(np.maximum(np.maximum(self.low[:, has] - high, low - self.high[:, has]), 0.0), posinf=np.inf)
                widest = np.nan_to_num(np.maximum(np.maximum(self.low[:, has] - low, high - self.high[:, has]), 0.0), posinf=np.inf)
            scale = q.shape[1] / np.maximum(np.minimum(self.most, has.sum()), 1)
            least, most = (apart * apart).sum(1) * scale, (widest * widest).sum(1) * scale
            if radius is not None:
                # Blocks met first are left out of the rest, so those nearest to any row stay here too.
                reach = max(radius[rows].max(), most[useful].min(initial=np.inf))
            else:
                reach = most[useful].min(initial=np.inf)
            near = useful & (least * (1 - 1e-6) <= reach)
            if ((self.known[near] < k) & ~has).any():
                near = useful
            some = object.__new__(Boxes)
            for name in ("ids", "rows", "layout", "known", "low", "high", "most"):
                setattr(some, name, getattr(self, name)[near])
            out.append((some, rows))
        return out

    def least_distances(self, q: np.ndarray) -> np.ndarray:
        """Per row and block, at most the distance of the row from any donor of the block; infinite where they share nothing useful."""
        have, held = ~np.isnan(q), self.known > 0
        bound = np.zeros((len(q), len(self.ids)))
        for j in range(q.shape[1]):
            x = np.where(have[:, j], q[:, j], 0.0)[:, None]
            with np.errstate(invalid="ignore"):
                gap = np.nan_to_num(np.maximum(np.maximum(self.low[:, j] - x, x - self.high[:, j]), 0.0), posinf=np.inf)
            bound += np.where(have[:, j, None], gap * gap, 0.0)
        bound *= q.shape[1] / np.maximum(np.minimum(self.most, have.sum(1)[:, None]), 1)
        useful = (have.astype(float) @ held.T.astype(float) > 0) & ((~have).astype(float) @ held.T.astype(float) > 0)
        return np.where(useful, bound * (1 - 1e-9), np.inf)

    def first(self, q: np.ndarray, far: np.ndarray, k: int) -> np.ndarray:
        """Per row and block, whether the row meets the block first: the nearest ones that know k values of each missing column.

        Of equally near blocks the one that knows most of the row's columns comes first, then the one whose farthest corner is nearest:
        its donors bound the rest best.
        """
        lacks = np.isnan(q)
        rows = np.arange(len(q))
        whole = self.known == self.rows[:, None]
        shared = np.where(far == far.min(1, keepdims=True), (~lacks).astype(float) @ whole.T.astype(float), -1.0)
        corner = np.zeros(far.shape)
        for j in range(q.shape[1]):
            reach = np.maximum(q[:, j, None] - self.low[:, j], self.high[:, j] - q[:, j, None])
            corner += np.where(whole[:, j] & ~lacks[:, j, None], reach * reach, 0.0)
        nearest = np.where(shared == shared.max(1, keepdims=True), corner, np.inf).argmin(1)
        met = np.zeros(far.shape, dtype=bool)
        met[rows, nearest] = np.isfinite(far[rows, nearest])
        for i in np.flatnonzero(((self.known[nearest] < k) & lacks).any(1)):
            order = np.argsort(far[i], kind="stable")
            order = order[np.isfinite(far[i, order])]
            for j in np.flatnonzero(lacks[i]):
                before = np.cumsum(self.known[order, j]) - self.known[order, j]
                enough = order[before < k]
                met[i, enough[self.known[enough, j] > 0]] = True
        return met


class KnnImputer:
    """Mean of the k nearest donors. Donors are the distinct training rows with how often each occurs, at most k.

    Up to DONOR_ROWS donors (counted first) travel with the tasks. Beyond that donors are a stored table of blocks that lie near each
    other, with a box around each. Donors are laid out once more for each common missing pattern, by the columns known there, so that
    the donors near an incomplete row lie in few blocks. An incomplete row first meets the donor block nearest to it; the k-th distances
    found bound the rest, and it then meets those blocks whose box is within that bound, no others. Rows travel in blocks, and only the
    k best per row and donor block leave a task. The stored table is part of the fitted plan.
    """

    def __init__(self, cols: list[str], k: int, means: list[float], donors: np.ndarray | None, table: DataFrame | None, path: str | None = None):
        self.cols, self.k, self.means, self.donors, self.table, self.path = cols, k, means, donors, table, path

    @staticmethod
    def fit(df: DataFrame, cols: list[str], k: int = 5, limit: int = DONOR_ROWS) -> KnnImputer:
        rows = as_double(df.select(*cols), cols)
        means = list(rows.agg(*[F.avg(c) for c in cols]).first())
        # Equal rows beyond k never change which k values are nearest.
        counted = rows.groupBy(*cols).agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("__copies"))
        table = stored(counted.select(*cols, F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy")).drop("__copy"), "donors")
        n = table.count()
        if n <= limit:
            donors = table.toPandas().to_numpy(dtype=float)
            return KnnImputer(cols, k, means, donors, None)
        blocks = blocked(table, cols, max(DONOR_ROWS // 16, 1, -(-n // MAX_BOXES)))
        return KnnImputer(cols, k, means, None, blocks, blocks.inputFiles()[0].rsplit("/", 1)[0])

    @staticmethod
    def load(spark, cols: list[str], k: int, means: list[float], path: str) -> KnnImputer:
        """An imputer whose donor table was stored by `fit`."""
        return KnnImputer(cols, k, means, None, spark.read.parquet(path), path)

    def transform(self, df: DataFrame) -> DataFrame:
        cols = self.cols
        doubles = as_double(df, cols)
        whole = doubles.filter(~any_null(cols))
        holes = doubles.filter(any_null(cols))
        if self.donors is not None:
            return whole.unionByName(holes.mapInPandas(self._filler(), holes.schema))
        return whole.unionByName(self._fill_from_table(holes))

    def _filler(self):
        cols, k, means, donors = self.cols, self.k, self.means, self.donors

        def fill(frames):
            for frame in frames:
                q = frame[cols].to_numpy(dtype=float)
                out = np.where(np.isnan(q), np.array([np.nan if m is None else m for m in means]), q)
                rows, columns, _, values = nearest_values(q, donors, k)
                turn = np.lexsort((columns, rows))
                cells, starts = np.unique((rows * len(cols) + columns)[turn], return_index=True)
                for cell, near in zip(cells.tolist(), np.split(values[turn], starts[1:])):
                    out[divmod(cell, len(cols))] = near.mean()
                yield frame.assign(**{c: out[:, j] for j, c in enumerate(cols)})

        return fill

    def _laid_out(self, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The donors in every layout that serves the incomplete rows, and these rows with their layout."""
        cols = self.cols
        donors = self.table.drop(BLOCK)
        n = self.table.count()
        asked = asked.withColumn("__own", pattern_of(cols))
        common = asked.groupBy("__own").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "__own").limit(MAX_LAYOUTS + 1).collect()
        own = [r["__own"] for r in common if r["n"] * LAYOUT_SHARE >= n][:MAX_LAYOUTS]
        size = max(DONOR_ROWS // 16, 1, -(-n // MAX_BOXES))
        tables = [blocked(donors, cols, size, p).withColumn(LAYOUT, F.lit(p)) for p in own]
        if any(r["__own"] not in own for r in common):
            tables.append(self.table.withColumn(LAYOUT, F.lit("")))
        layout = F.when(F.col("__own").isin(own), F.col("__own")).otherwise("") if own else F.lit("")
        return reduce(DataFrame.unionByName, tables), asked.withColumn(LAYOUT, layout).drop("__own")

    def _pairs(self, sides: DataFrame, donors: Boxes, within: bool) -> DataFrame:
        """(cols..., radius, __q, __d): the donor blocks each incomplete row meets first or, `within`, the others no farther than its column `radius`."""
        cols, k = self.cols, self.k

        def run(frames):
            layouts = {}
            for frame in frames:
                for (name, _), rows in frame.groupby([LAYOUT, BLOCK]):
                    if name not in layouts:
                        layouts[name] = donors.of(name)
                    q, radius = rows[cols].to_numpy(dtype=float), rows["radius"].to_numpy(dtype=float)
                    near = layouts[name].around(q, radius if within else None, k)
                    for boxes, some in near:
                        step = max(1, BOUNDS // max(len(boxes.ids), 1))
                        for start in range(0, len(some) if len(boxes.ids) else 0, step):
                            part = some[start:start + step]
                            far = boxes.least_distances(q[part])
                            met = boxes.first(q[part], far, k)
                            if within:
                                met = ~met & np.isfinite(far) & (far <= radius[part, None])
                            i, d = np.nonzero(met)
                            yield rows.iloc[part[i]][[*cols, "radius", BLOCK]].rename(columns={BLOCK: "__q"}).assign(__d=boxes.ids[d])

        return sides.mapInPandas(run, ", ".join([f"`{c}` double" for c in cols] + ["radius double", "__q long", "__d long"]))

    def _met(self, left: DataFrame, table: DataFrame) -> DataFrame:
        """(cols..., column, distance, value): the k nearest donors within its radius of each incomplete row in each block that it meets."""
        cols, k = self.cols, self.k
        # Rows that ask for a donor block meet it together, QUERY_ROWS or so at a time, so the block is sent once for many.
        asking = left.groupBy("__d", "__q").agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.partitionBy("__d").orderBy("__q")) - F.col("n")
        pieces = stored(asking.select("__d", "__q", F.floor(before / QUERY_ROWS).alias("__piece")), "pieces")
        meets = pieces.select("__d", "__piece").distinct()
        # A call gets a few blocks: calls cost more than small blocks do.
        bucket = F.pmod(F.xxhash64("__d", "__piece"), F.lit(meets.count() // CALL_BLOCKS + 1)).alias("__bucket")
        # Names of its own keep both sides of the cogroup apart.
        right = table.withColumnRenamed(BLOCK, "__d").join(meets, "__d").select(*[F.col(c).alias(c) for c in [*cols, "__d", "__piece"]], bucket)
        left = left.join(pieces, ["__d", "__q"]).select(*cols, "radius", "__d", "__piece", bucket)
        schema = T.StructType([T.StructField(c, T.DoubleType()) for c in cols] + [T.StructField("column", T.IntegerType()), T.StructField("distance", T.DoubleType()),
                                                                                 T.StructField("value", T.DoubleType())])

        def best(queries, donors):
            q, radius, known = queries[cols].to_numpy(dtype=float), queries["radius"].to_numpy(dtype=float), donors[cols].to_numpy(dtype=float)
            blocks, out = donors.groupby(["__d", "__piece"]).indices, []
            for key, asked in queries.groupby(["__d", "__piece"]).indices.items():
                rows, columns, distances, values = nearest_values(q[asked], known[blocks[key]], k, radius[asked])
                out.append(np.column_stack([q[asked[rows]], columns, distances, values]))
            return pd.DataFrame(np.vstack(out) if out else np.empty((0, len(cols) + 3)), columns=[*cols, "column", "distance", "value"]).astype({"column": "int32"})

        return spread(left, ["__bucket"]).groupBy("__bucket").cogroup(spread(right, ["__bucket"]).groupBy("__bucket")).applyInPandas(best, schema)

    def _fill_from_table(self, holes: DataFrame) -> DataFrame:
        cols, k = self.cols, self.k
        some = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in cols])
        asked = blocked(stored(holes.select(*cols).filter(some).distinct(), "asked"), cols, max(1, QUERY_ROWS // 16))
        if asked.isEmpty():
            return holes.withColumns({c: F.coalesce(F.col(c), F.lit(self.means[j])) for j, c in enumerate(cols)})
        table, asked = self._laid_out(asked)
        donors = Boxes(boxes_of(table, cols).toPandas())  # MAX_BOXES, MAX_LAYOUTS and the shuffle partitions bound their number
        first = stored(self._met(stored(self._pairs(asked.withColumn("radius", F.lit(float("inf"))), donors, False), "pairs"), table), "nearest-first")
        # The k-th distance of every missing cell bounds its row; a cell with fewer donors so far leaves the row unbounded.
        w = Window.partitionBy(*cols, "column").orderBy("distance", "value")
        near = first.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") == k)
        reach = near.groupBy(*cols).agg(F.count("*").alias("__settled"), F.max("distance").alias("__far"))
        lacking = sum(((F.col(c).isNull() | F.isnan(c)).cast("int") for c in cols), F.lit(0))
        radius = F.when(F.col("__settled") >= lacking, F.col("__far")).otherwise(F.lit(float("inf")))
        bounded = attach(asked, reach, cols).withColumn("radius", radius).drop("__settled", "__far")
        rest = self._met(stored(self._pairs(bounded, donors, True), "pairs"), table)
        picked = first.unionByName(rest).withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k)
        filled = picked.groupBy(*cols).pivot("column", list(range(len(cols)))).agg(F.avg("value"))
        named = filled.withColumnsRenamed({str(j): f"__near_{j}" for j in range(len(cols))})
        joined = attach(holes, named, cols)
        value = {c: F.coalesce(F.col(c), F.col(f"__near_{j}"), F.lit(self.means[j])) for j, c in enumerate(cols)}
        return joined.select([value[c].alias(c) if c in value else F.col(c) for c in holes.columns])


def run_steps(x: np.ndarray, means: np.ndarray, scales: np.ndarray, steps: list[tuple[int, list[float]]]) -> np.ndarray:
    """Standardised rows with missing cells set to 0 (the mean) and then replaced by each regression in turn."""
    z = (x - means) / scales
    missing = np.isnan(z)
    z = np.where(missing, 0.0, z)
    for j, coef in steps:
        c = np.asarray(coef)
        guess = c[0] + z @ c[1:]
        z[:, j] = np.where(missing[:, j], guess, z[:, j])
    return z


class MiceImputer:
    """Chained linear regressions, up to `rounds` passes over the columns with missing values.

    Normal equations are summed inside the tasks and only a (columns + 1)^2 matrix reaches the driver. Complete
    rows contribute one fixed matrix; each step revisits only the incomplete rows. Applying the fitted steps is
    local to a row.
    """

    def __init__(self, cols: list[str], means: list[float], scales: list[float], steps: list):
        self.cols, self.means, self.scales, self.steps = cols, means, scales, steps

    @staticmethod
    def fit(df: DataFrame, cols: list[str], rounds: int = 10, tolerance: float = 1e-3) -> MiceImputer:
        rows = as_double(df.select(*cols), cols)
        k = len(cols)
        first = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)],
                         *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"n{i}") for i, c in enumerate(cols)]).first()
        means = [first[f"m{i}"] or 0.0 for i in range(k)]
        scales = [first[f"s{i}"] or 1.0 for i in range(k)]
        order = sorted((j for j in range(k) if first[f"n{j}"]), key=lambda j: (first[f"n{j}"], j))
        model = MiceImputer(cols, means, scales, [])
        if not order:
            return model
        whole = model._products(rows.filter(~any_null(cols)), [])
        holes = rows.filter(any_null(cols)).persist()
        try:
            last: dict[int, np.ndarray] = {}
            for _ in range(rounds):
                moved = 0.0
                for j in order:
                    gram = whole + model._products(holes.filter(F.col(cols[j]).isNotNull()), model.steps)
                    use = [0] + [i + 1 for i in range(k) if i != j]
                    a = gram[np.ix_(use, use)] + 1e-9 * np.eye(k)
                    solved = np.linalg.lstsq(a, gram[use, j + 1], rcond=None)[0]
                    coef = np.zeros(k + 1)
                    coef[use] = solved
                    moved = max(moved, float(np.abs(coef - last.get(j, np.zeros(k + 1))).max()))
                    last[j] = coef
                    model.steps.append((j, coef.tolist()))
                if moved < tolerance:
                    break
        finally:
            holes.unpersist()
        return model

    def _products(self, rows: DataFrame, steps: list) -> np.ndarray:
        """Sum of [1, z]' [1, z] over the rows, with missing cells as the steps so far leave them."""
        cols = self.cols
        means, scales, k = np.array(self.means), np.array(self.scales), len(cols)

        def sums(frames):
            total = np.zeros((k + 1, k + 1))
            for frame in frames:
                z = run_steps(frame[cols].to_numpy(dtype=float), means, scales, steps)
                one = np.column_stack([np.ones(len(z)), z])
                total += one.T @ one
            yield pd.DataFrame({"i": np.repeat(np.arange(k + 1), k + 1), "j": np.tile(np.arange(k + 1), k + 1), "v": total.ravel()})

        parts = rows.mapInPandas(sums, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
        out = np.zeros((k + 1, k + 1))
        for r in parts.collect():
            out[r["i"], r["j"]] = r["v"]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        cols, steps = self.cols, self.steps
        means, scales = np.array(self.means), np.array(self.scales)
        doubles = as_double(df, cols)

        def fill(frames):
            for frame in frames:
                x = frame[cols].to_numpy(dtype=float)
                z = run_steps(x, means, scales, steps) * scales + means
                out = np.where(np.isnan(x), z, x)
                yield frame.assign(**{c: out[:, j] for j, c in enumerate(cols)})

        holes = doubles.filter(any_null(cols))
        return doubles.filter(~any_null(cols)).unionByName(holes.mapInPandas(fill, holes.schema))
