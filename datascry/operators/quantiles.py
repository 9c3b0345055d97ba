"""Linear-interpolated quantiles of many columns at once, exact at any size or approximate on request."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datascry.operators.ordered import largest_group, running_totals

# Rows of a group up to which percentile buffers are used, and rows within open digits up to which their values are counted one by one.
BUFFER_ROWS = 250_000
# Rows of a whole table up to which buffers are faster than two more passes.
TABLE_ROWS = 100_000
# Bits of the first digit (sign, exponent and four bits of the fraction: few values occur) and of the later ones.
FIRST_BITS, NEXT_BITS = 16, 12
TOP = 1 << 63


def quantiles(df: DataFrame, cols: list[str], probs: list[float], by: list[str] | None = None, exact: bool = True,
              limit: int | None = None) -> DataFrame:
    """One row per group and column: (by..., column, n, q) with `q` an array aligned to `probs`.

    Exact results come from percentile buffers while every group is known to be small, from radix selection over
    a whole table, and from running counts of distinct values for large groups.
    """
    by = list(by or [])
    limit = (BUFFER_ROWS if by else TABLE_ROWS) if limit is None else limit
    if not exact:
        return _one_pass(df, cols, by, lambda c: F.percentile_approx(c, probs, 10_000))
    if largest_group(df.select(*by, *cols), by) <= limit:
        return _one_pass(df, cols, by, lambda c: F.percentile(c, F.array(*[F.lit(p) for p in probs])))
    return _ranked(df, cols, probs, by) if by else _selected(df, cols, probs)


def _number(c: str):
    """The column as double; NaN counts as missing."""
    x = F.col(f"`{c}`").cast("double")
    return F.when(~F.isnan(x), x)


def order_code(x):
    """Whole numbers of 64 bits in the order of the doubles; -0.0 counts as 0.0."""
    import numpy as np
    bits = (np.asarray(x, np.float64) + 0.0).view(np.uint64)
    return np.where(bits >= TOP, ~bits, bits | np.uint64(TOP))


def from_code(code: int) -> float:
    import struct
    return struct.unpack("<d", struct.pack("<Q", code - TOP if code >= TOP else ~code & (2 * TOP - 1)))[0]


def _digit_counts(df: DataFrame, x: dict, jobs: list[tuple], done: int, bits: int) -> DataFrame:
    """(job, digit, n, low, high): how often each next digit occurs among the values whose first `done` bits are the job's, and the
    least and largest code with it (as signed numbers). jobs: (column, prefix)."""
    cols = list(dict.fromkeys(c for c, _ in jobs))
    wanted = [[(j, prefix) for j, (c, prefix) in enumerate(jobs) if c == name] for name in cols]

    def count(batches):
        import numpy as np
        import pandas as pd
        held: dict[int, list] = {}

        def merged(parts):
            digits, n, low, high = (np.concatenate(p) for p in zip(*parts))
            turn = np.argsort(digits, kind="stable")
            digits = digits[turn]
            starts = np.flatnonzero(np.concatenate([[True], digits[1:] != digits[:-1]]))
            return digits[starts], np.add.reduceat(n[turn], starts), np.minimum.reduceat(low[turn], starts), np.maximum.reduceat(high[turn], starts)

        for batch in batches:
            for k, asked in enumerate(wanted):
                values = batch.iloc[:, k].to_numpy(np.float64)
                code = order_code(np.sort(values[~np.isnan(values)]))
                for j, prefix in asked:
                    low, high = prefix << 64 - done, (prefix + 1 << 64 - done) - 1
                    inside = code[np.searchsorted(code, np.uint64(low), "left"):np.searchsorted(code, np.uint64(high), "right")]
                    if len(inside):
                        digit = ((inside >> np.uint64(64 - done - bits)) & np.uint64((1 << bits) - 1)).astype(np.int64)
                        starts = np.flatnonzero(np.concatenate([[True], digit[1:] != digit[:-1]]))
                        signed, stops = (inside ^ np.uint64(TOP)).view(np.int64), np.concatenate([starts[1:], [len(digit)]])
                        parts = held.setdefault(j, [])
                        parts.append((digit[starts], stops - starts, signed[starts], signed[stops - 1]))
                        if len(parts) >= 64:
                            held[j] = [merged(parts)]
        for j, parts in held.items():
            digits, n, low, high = merged(parts)
            yield pd.DataFrame({"job": j, "digit": digits, "n": n, "low": low, "high": high})

    counted = df.select(*[x[c].alias(f"x{k}") for k, c in enumerate(cols)]).mapInPandas(count, "job int, digit long, n long, low long, high long")
    return counted.groupBy("job", "digit").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def _selected(df: DataFrame, cols: list[str], probs: list[float]) -> DataFrame:
    """Radix selection: digit by digit of an order-preserving code, the digit that holds each wanted rank.

    A round counts the next digit of all columns and ranks in one aggregate; counts are formed inside the tasks, and the driver
    gets one row per rank. The first digit has 16 bits, the others 12, so five rounds settle any data. A digit that holds a single
    value settles its ranks at once; when no more than BUFFER_ROWS values are left inside the open digits, the rest of the code is one
    digit and the round is the last. No column is gathered or sorted as a whole.
    """
    x = {c: _number(c) for c in cols}
    first = df.agg(*[F.count(x[c]).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    total = {c: first[f"n{i}"] for i, c in enumerate(cols)}
    ranks = {(c, k): (math.floor(p * (total[c] - 1)), math.ceil(p * (total[c] - 1))) for c in cols if total[c] for k, p in enumerate(probs)}
    spark = df.sparkSession
    # (column, first bits of the code) -> (rows below, rows inside, ranks inside)
    open_ = {(c, 0): (0, total[c], {r for (name, _), pair in ranks.items() if name == c for r in pair}) for c in cols if total[c]}
    done, values = 0, {}
    while open_:  # a whole code is a single value
        jobs = list(open_)
        bits = FIRST_BITS if not done else min(NEXT_BITS, 64 - done)
        if done and sum(held for _, held, _ in open_.values()) <= BUFFER_ROWS:
            bits = 64 - done
        asked = spark.createDataFrame([(j, r - open_[job][0]) for j, job in enumerate(jobs) for r in sorted(open_[job][2])], "job int, at long")
        upto = Window.partitionBy("job").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        counts = _digit_counts(df, x, jobs, done, bits).withColumn("upto", F.sum("n").over(upto))
        found = counts.join(F.broadcast(asked), "job").filter("upto - n <= at and at < upto").collect()
        further: dict = {}
        for row in found:
            (c, prefix), (below, _, _) = jobs[row["job"]], open_[jobs[row["job"]]]
            if row["low"] == row["high"]:
                values[(c, below + row["at"])] = from_code(row["low"] + TOP)
                continue
            key = (c, (prefix << bits) | row["digit"])
            further.setdefault(key, (below + row["upto"] - row["n"], row["n"], set()))[2].add(below + row["at"])
        open_, done = further, done + bits
    rows = []
    for c in cols:
        q = None
        if total[c]:
            q = []
            for k, p in enumerate(probs):
                pos, (lo, hi) = p * (total[c] - 1), (values[(c, r)] for r in ranks[(c, k)])
                q.append(lo if lo == hi else lo + (pos - math.floor(pos)) * (hi - lo))
        rows.append((c, total[c], q))
    return spark.createDataFrame(rows, "column string, n bigint, q array<double>")


def _one_pass(df, cols, by, quantile) -> DataFrame:
    stats = [F.struct(F.lit(c).alias("column"), F.count(_number(c)).alias("n"),
                      quantile(_number(c)).alias("q")).alias(f"s{i}") for i, c in enumerate(cols)]
    wide = df.groupBy(*by).agg(*stats) if by else df.agg(*stats)
    return wide.select(*by, F.inline(F.array(*[f"s{i}" for i in range(len(cols))])))


def _ranked(df, cols, probs, by) -> DataFrame:
    """Counts per distinct value, added up through ranges of values; the rows at each target rank follow from them."""
    doubles = df.select(*by, *[_number(c).alias(c) for c in cols])
    values = (doubles.unpivot(by, cols, "column", "value").filter("value is not null")
              .groupBy(*by, "column", "value").agg(F.count("*").alias("n")))
    group = by + ["column"]
    ranked = running_totals(values, group, ["value"], {"upto": "n"}).withColumnRenamed("upto_all", "total")
    at = [F.lit(p) * (F.col("total") - 1) for p in probs]
    holds = lambda k: (F.col("upto") - F.col("n") <= k) & (k < F.col("upto"))
    aggs = [F.max("total").alias("n")]
    for i, pos in enumerate(at):
        aggs.append(F.max(F.when(holds(F.floor(pos)), F.col("value"))).alias(f"lo{i}"))
        aggs.append(F.max(F.when(holds(F.ceil(pos)), F.col("value"))).alias(f"hi{i}"))
    picked = ranked.groupBy(*group).agg(*aggs)

    def blend(i, p):
        pos = F.lit(p) * (F.col("n") - 1)
        return F.col(f"lo{i}") + (pos - F.floor(pos)) * (F.col(f"hi{i}") - F.col(f"lo{i}"))

    return picked.select(*group, "n", F.array(*[blend(i, p) for i, p in enumerate(probs)]).alias("q"))


def fences(df: DataFrame, cols: list[str], by: list[str] | None = None, exact: bool = True, limit: int | None = None) -> DataFrame:
    """Quartiles and the 1.5 * IQR fences per column: (by..., column, n, q1, median, q3, low, high)."""
    q = quantiles(df, cols, [0.25, 0.5, 0.75], by, exact, limit)
    q1, q3 = F.col("q")[0], F.col("q")[2]
    return q.select(
        *(by or []), "column", "n", q1.alias("q1"), F.col("q")[1].alias("median"), q3.alias("q3"),
        (q1 - 1.5 * (q3 - q1)).alias("low"), (q3 + 1.5 * (q3 - q1)).alias("high"))
