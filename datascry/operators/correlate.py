"""Association between columns: all numeric pairs in one aggregate, category pairs on pre-aggregated counts."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datascry.functions.scalars import NUMERIC
from datascry.operators.profile import distinct_counts, long_rows

MIN_ROWS = 5
FEW_PAIRS = 3
# Different cells and dictionary entries that a task holds before it sends them on.
TASK_CELLS = 1_000_000


def _number(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def strongest(pairs: DataFrame, limit: int | None = None) -> DataFrame:
    out = pairs.filter("value is not null").orderBy(F.desc(F.abs("value")), "x", "y")
    return out if limit is None else out.limit(limit)


def corr_pearson(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every pair over pairwise complete rows: (x, y, value), strongest first.

    A few pairs are plain aggregates; more are summed as matrix products inside the tasks, which costs one pass
    however many pairs there are.
    """
    few = len(cols) * (len(cols) - 1) // 2 <= FEW_PAIRS
    table = _pair_aggregates(df, cols) if few else _pair_products(df, cols)
    return strongest(table.filter(F.col("n") >= 2).select("x", "y", _number(F.col("r")).alias("value")))


def _pair_aggregates(df: DataFrame, cols: list[str]) -> DataFrame:
    pairs = []
    for a, b in combinations(cols, 2):
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        pairs.append(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.count(F.when(x.isNotNull(), y)).alias("n"),
                              F.corr(x, y).alias("r")))
    return long_rows(df, [], pairs)


def _pair_products(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x, y, n, r) from sums over pairwise complete rows, taken around the column means for accuracy."""
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    centers = np.array([v or 0.0 for v in doubles.agg(*[F.avg(c) for c in cols]).first()])
    k = len(cols)
    at = [(i, j) for i in range(k) for j in range(i + 1, k)]
    rows, columns = np.array([i for i, _ in at]), np.array([j for _, j in at])

    def sums(frames):
        total = np.zeros((6, len(at)))
        for frame in frames:
            z = frame[cols].to_numpy(dtype=float) - centers
            known = (~np.isnan(z)).astype(float)
            z = np.nan_to_num(z)
            squares, n = z * z, known.T @ known
            sx, sxx, sxy = z.T @ known, squares.T @ known, z.T @ z
            total += np.stack([n[rows, columns], sx[rows, columns], sx[columns, rows], sxx[rows, columns], sxx[columns, rows], sxy[rows, columns]])
        yield pd.DataFrame({"pair": np.arange(len(at)), **{f"s{i}": total[i] for i in range(6)}})

    parts = doubles.mapInPandas(sums, "pair long, " + ", ".join(f"s{i} double" for i in range(6)))
    merged = parts.groupBy("pair").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(6)])
    n, sx, sy, sxx, syy, sxy = (F.col(f"s{i}") for i in range(6))
    r = (sxy - sx * sy / n) / F.sqrt((sxx - sx * sx / n) * (syy - sy * sy / n))
    names = F.lit(list(cols))
    place = F.lit([int(i) + 1 for i in rows]), F.lit([int(j) + 1 for j in columns])
    slot = (F.col("pair") + 1).cast("int")
    return merged.select(F.element_at(names, F.element_at(place[0], slot)).alias("x"), F.element_at(names, F.element_at(place[1], slot)).alias("y"),
                         n.cast("long").alias("n"), F.when((sxx - sx * sx / n > 0) & (syy - sy * sy / n > 0), r).alias("r"))


def _cells(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Crosstab counts of several column pairs at once: (x, y, a, b, o).

    Inside a task every column has a dictionary of the values met so far, and a pair is counted on codes, batch by batch. A row crosses to
    Python once with its values, not once per pair; only different cells leave the task, and dictionaries start anew when they are full.
    """
    cols = list(dict.fromkeys(c for pair in pairs for c in pair))
    at = [(cols.index(a), cols.index(b)) for a, b in pairs]

    def count(frames):
        codes: list[dict] = [{} for _ in cols]
        held: list[list] = [[] for _ in at]

        def merged(parts):
            cells, places = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            return cells, np.bincount(places, np.concatenate([n for _, n in parts]), len(cells))

        def told():
            names = [np.array(list(known), dtype=object) for known in codes]
            for k, (i, j) in enumerate(at):
                if held[k]:
                    cells, n = merged(held[k])
                    yield pd.DataFrame({"pair": k, "a": names[i][cells >> 32], "b": names[j][cells & 0xFFFFFFFF], "o": n})
                    held[k] = []
            for known in codes:
                known.clear()

        for frame in frames:
            numbers = []
            for c, known in enumerate(codes):
                local, values = pd.factorize(frame.iloc[:, c])
                numbers.append(np.append(np.array([known.setdefault(v, len(known)) for v in values], np.int64), -1)[local])
            for k, (i, j) in enumerate(at):
                both = (numbers[i] >= 0) & (numbers[j] >= 0)
                held[k].append(np.unique((numbers[i][both] << 32) | numbers[j][both], return_counts=True))
                if len(held[k]) >= 32:
                    held[k] = [merged(held[k])]
            if sum(map(len, codes)) + sum(len(c) for parts in held for c, _ in parts) > TASK_CELLS:
                yield from told()
        yield from told()

    counted = df.select(*[F.col(c).cast("string").alias(f"v{i}") for i, c in enumerate(cols)]).mapInPandas(count, "pair int, a string, b string, o double")
    name = lambda side: F.element_at(F.lit([p[side] for p in pairs]), F.col("pair") + 1)
    return counted.groupBy("pair", "a", "b").agg(F.sum("o").alias("o")).select(name(0).alias("x"), name(1).alias("y"), "a", "b", "o")


def cramers_v_table(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Cramer's V per pair: (x, y, n, value), 0 where a side has one level.

    chi2 = n * (sum(o^2 / (row * column)) - 1) needs no empty cells. A 2x2 table gets the continuity
    correction; there every cell deviates from its expectation by the same amount.
    """
    cells = _cells(df, pairs)
    rows = cells.groupBy("x", "y", "a").agg(F.sum("o").alias("r"))
    columns = cells.groupBy("x", "y", "b").agg(F.sum("o").alias("c"))
    left = rows.groupBy("x", "y").agg(F.count("*").alias("rows"), F.sum(1 / F.col("r")).alias("inv_r"), F.sum("r").alias("n"))
    right = columns.groupBy("x", "y").agg(F.count("*").alias("cols"), F.sum(1 / F.col("c")).alias("inv_c"))
    sized = cells.join(rows, ["x", "y", "a"]).join(columns, ["x", "y", "b"])
    shape = left.join(right, ["x", "y"])
    terms = sized.join(shape, ["x", "y"]).groupBy("x", "y", "rows", "cols", "n", "inv_r", "inv_c").agg(
        F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))).alias("s"),
        F.max(F.abs(F.col("o") - F.col("r") * F.col("c") / F.col("n"))).alias("d"))
    short = F.least(F.col("rows"), F.col("cols")) - 1
    plain = F.col("n") * (F.col("s") - 1)
    off = F.col("d") - F.least(F.lit(0.5), F.col("d"))
    corrected = off * off * F.col("n") * F.col("inv_r") * F.col("inv_c")
    chi2 = F.when((F.col("rows") == 2) & (F.col("cols") == 2), corrected).otherwise(F.greatest(plain, F.lit(0.0)))
    value = F.when(short < 1, F.lit(0.0)).otherwise(F.sqrt(chi2 / F.col("n") / short))
    return terms.select("x", "y", F.col("n").cast("long").alias("n"), value.alias("value"))


def corr_cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    return cramers_v_table(df, [(a, b)])


def category_number_table(df: DataFrame, cats: list[str], nums: list[str]) -> DataFrame:
    """Correlation ratio (more than two levels) or point-biserial r (two levels) of category/number pairs.

    (x, y, levels, n, value) with x the category. The smallest category counts as 1 in the binary case.
    """
    doubles = df.select(*[F.col(c).cast("double").alias(f"n{i}") for i, c in enumerate(nums)],
                        *[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(cats)])
    ids = [f"n{i}" for i in range(len(nums))]
    long = doubles.unpivot(ids, [f"c{i}" for i in range(len(cats))], "x", "level").filter("level is not null")
    aggs = []
    for i in ids:
        aggs += [F.struct(F.lit(i).alias("y"), F.count(i).alias("k"), F.avg(i).alias("m"),
                          (F.var_pop(i) * F.count(i)).alias("ss")).alias(f"g_{i}")]
    groups = (long.groupBy("x", "level").agg(*aggs)
              .select("x", "level", F.inline(F.array(*[f"g_{i}" for i in ids]))).filter("k > 0"))
    means = groups.groupBy("x", "y").agg((F.sum(F.col("k") * F.col("m")) / F.sum("k")).alias("mean"))
    both = groups.join(means, ["x", "y"])
    gap = F.col("m") - F.col("mean")
    total = both.groupBy("x", "y").agg(
        F.count("*").alias("levels"), F.sum("k").alias("n"), F.sum(F.col("k") * gap * gap).alias("between"),
        F.sum("ss").alias("within"), F.min_by("m", "level").alias("m1"), F.max_by("m", "level").alias("m0"))
    sst = F.col("between") + F.col("within")
    eta = F.when(sst > 0, F.sqrt(F.col("between") / sst)).otherwise(F.lit(0.0))
    signed = F.when(sst > 0, eta * F.signum(F.col("m1") - F.col("m0")))
    value = F.when(F.col("levels") > 2, eta).when(F.col("levels") == 2, signed)
    names = lambda c, prefix, known: reduce(
        lambda e, p: F.when(F.col(c) == f"{prefix}{p[0]}", F.lit(p[1])).otherwise(e), enumerate(known), F.lit(None).cast("string"))
    return total.select(names("x", "c", cats).alias("x"), names("y", "n", nums).alias("y"), "levels", "n", value.alias("value"))


def corr_ratio(df: DataFrame, cat: str, num: str) -> DataFrame:
    return category_number_table(df, [cat], [num])


def corr_point_biserial(df: DataFrame, binary: str, num: str) -> DataFrame:
    return category_number_table(df, [binary], [num])


def corr_mixed(df: DataFrame, cols: list[str], t: str | None = None, limit: int = 100, exact: bool = True,
               most: int | None = None) -> DataFrame:
    """Strongest associations of any column types: (x, y, value). All columns, or the first `most` with the target first."""
    if most is not None and len(cols) > most:
        cols = ([t] if t in cols else []) + [c for c in cols if c != t]
        cols = cols[:most]
    levels = {r["column"]: r["nunique"] for r in distinct_counts(df, cols, exact=exact).collect()}
    nums = [c for c in cols if isinstance(df.schema[c].dataType, NUMERIC) and levels.get(c, 0) > 2]
    cats = [c for c in cols if c not in nums and not isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType))]
    at = {c: i for i, c in enumerate(cols)}
    parts = []
    if len(nums) > 1:
        parts.append(corr_pearson(df, nums).select("x", "y", "value"))
    if len(cats) > 1:
        parts.append(cramers_v_table(df, list(combinations(cats, 2))).filter(F.col("n") >= MIN_ROWS).select("x", "y", "value"))
    if cats and nums:
        table = category_number_table(df, cats, nums).filter(F.col("n") >= MIN_ROWS)
        place = F.create_map(*[F.lit(x) for k, v in at.items() for x in (k, v)])
        swap = F.element_at(place, F.col("x")) > F.element_at(place, F.col("y"))
        parts.append(table.select(F.when(swap, F.col("y")).otherwise(F.col("x")).alias("x"),
                                  F.when(swap, F.col("x")).otherwise(F.col("y")).alias("y"), "value"))
    if not parts:
        return df.sparkSession.createDataFrame([], "x string, y string, value double")
    return strongest(reduce(DataFrame.unionByName, parts), limit)
