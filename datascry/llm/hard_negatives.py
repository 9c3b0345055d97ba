"""Hard negatives by exact integer scores: residue matrices multiplied in float32, signed scores by Chinese remainders, windows of scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datascry.llm.base import partitions, written

#: Bytes of integers on one side of a tile; rows and anchors of a tile that are multiplied at once.
TILE_BYTES = 32 << 20
ROWS_AT_ONCE, ANCHORS_AT_ONCE = 8192, 256
#: Dimensions whose products are summed in float32 before they are reduced again, and the whole numbers that float32 holds.
DIMS_AT_ONCE, WHOLE = 256, 1 << 24
NOTHING = -(1 << 63)


def small_primes(dims: int, bound: int) -> list[int]:
    """The largest primes whose residue products stay whole in float32 over `dims` dimensions, as many as scores within +-bound need."""
    half = math.isqrt((WHOLE - 1) // max(1, min(dims, DIMS_AT_ONCE)))
    found, product, p = [], 1, 2 * half + 1
    while product <= 2 * bound + 1:
        if p < 3:
            raise ValueError("scores are too large for primes of this size")
        if all(p % q for q in range(2, math.isqrt(p) + 1)):
            found.append(p)
            product *= p
        p -= 1
    return found


def residues(x, primes: list[int]) -> list:
    """One float32 matrix per prime with the residues of smallest size."""
    import numpy as np
    out = []
    for p in primes:
        r = np.mod(x, p)
        out.append(np.where(r > p // 2, r - p, r).astype(np.float32))
    return out


def scores(left: list, right: list, primes: list[int]):
    """Exact inner products, as int64, of the rows behind two lists of residue matrices.

    Every product matrix is exact: its partial sums stay below 2 ** 24. The digits of the mixed radix c0 + c1 p0 + c2 p0 p1 + ...
    are of smallest size too, so the sum is the signed score; where the product of the primes passes 2 ** 64 it is right by wrapping.
    """
    import numpy as np
    digits: list = []
    for k, p in enumerate(primes):
        r = np.zeros((len(left[k]), len(right[k])), np.int64)
        for d in range(0, left[k].shape[1], DIMS_AT_ONCE):
            r += (left[k][:, d:d + DIMS_AT_ONCE] @ right[k][:, d:d + DIMS_AT_ONCE].T).astype(np.int64)
        weight = 1
        for digit, q in zip(digits, primes):
            r -= digit * (weight % p)
            weight *= q
        r = np.mod(np.mod(r, p) * pow(weight % p, -1, p), p)
        digits.append(np.where(r > p // 2, r - p, r))
    total, weight = np.zeros_like(digits[0]), 1
    for digit, q in zip(digits, primes):
        with np.errstate(over="ignore"):
            total += digit * np.int64(((weight + (1 << 63)) % (1 << 64)) - (1 << 63))
        weight *= q
    return total


def best_places(told, fits, k: int):
    """(anchor, row) places of the k highest of the fitting scores in each line of a matrix; among equal ones the first."""
    import numpy as np
    held = np.where(fits, told, NOTHING)
    n = held.shape[1]
    limit = np.partition(held, n - k, axis=1)[:, n - k] if n > k else np.full(len(held), NOTHING)
    above = held > limit[:, None]
    ties = fits & (held == limit[:, None])
    ties &= np.cumsum(ties, axis=1) <= (k - above.sum(1))[:, None]
    return np.nonzero(above | ties)


def tiled(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, dims: int):
    """Both sides in tiles, each row tile beside each anchor tile: cogrouped by (_a, _r).

    A side of a tile holds TILE_BYTES of integers at most, on average. Rows are repeated once per anchor tile and anchors once per row
    tile; with one anchor in a hundred rows and 64 dimensions, up to 6.5 million rows there is one anchor tile and no row is repeated.
    """
    per_tile = max(1, TILE_BYTES // (8 * max(1, dims)))
    spark = rows.sparkSession
    a, r = max(1, -(-n_anchors // per_tile)), max(1, -(-n_rows // per_tile), min(partitions(spark), n_rows // 2048))
    parts = max(a * r, 1)
    left = rows.withColumn("_r", F.pmod(F.xxhash64("rid"), F.lit(r)).cast("int")).withColumn("_a", F.explode(F.lit(list(range(a)))))
    right = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])  # names of its own: a cogrouped frame of shared ones loses columns
    right = right.withColumn("_a", F.pmod(F.xxhash64("rid", F.lit(1)), F.lit(a)).cast("int")).withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(r - 1))))
    return left.repartition(parts, "_a", "_r").groupBy("_a", "_r").cogroup(right.repartition(parts, "_a", "_r").groupBy("_a", "_r"))


def matrix(column):
    import numpy as np
    return np.stack(column.to_numpy()).astype(np.int64, copy=False)


def tile_candidates(primes: list[int], same: bool, k: int, low: int, high: int):
    """The function of a tile: (rows, anchors) to the best k rows of each anchor (same label), or of each of its windows (other labels)."""

    def run(rows, anchors):
        import numpy as np
        import pandas as pd
        empty = pd.DataFrame({"arid": np.zeros(0, np.int64), "top": np.zeros(0, np.int64), "rid": np.zeros(0, np.int64), "ord": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
        if not len(rows) or not len(anchors):
            return empty
        rows = rows.sort_values(["ord", "rid"], ignore_index=True)
        codes = pd.factorize(pd.concat([rows["label"], anchors["label"]], ignore_index=True))[0]
        label, own = codes[:len(rows)], codes[len(rows):]
        rid, order = rows["rid"].to_numpy(), rows["ord"].to_numpy()
        theirs, mine = residues(matrix(rows["x"]), primes), residues(matrix(anchors["x"]), primes)
        arid = anchors["rid"].to_numpy()
        tops = None if same else anchors["tops"].tolist()
        out = [empty]
        for a in range(0, len(arid), ANCHORS_AT_ONCE):
            ids = arid[a:a + ANCHORS_AT_ONCE]
            if not same:
                wide = max(len(t) for t in tops[a:a + ANCHORS_AT_ONCE])
                edges = np.array([sorted(t, reverse=True) + [NOTHING] * (wide - len(t)) for t in tops[a:a + ANCHORS_AT_ONCE]], np.int64)
            found = []
            for b in range(0, len(rid), ROWS_AT_ONCE):
                told = scores([m[a:a + ANCHORS_AT_ONCE] for m in mine], [m[b:b + ROWS_AT_ONCE] for m in theirs], primes)
                alike = own[a:a + ANCHORS_AT_ONCE][:, None] == label[b:b + ROWS_AT_ONCE][None]
                if same:
                    i, j = best_places(told, alike & (ids[:, None] != rid[b:b + ROWS_AT_ONCE][None]), k)
                    found.append((i, np.zeros(len(i), np.int64), b + j, told[i, j]))
                    continue
                for w in range(edges.shape[1]):
                    top = edges[:, w]
                    least = np.array([-((-low * int(t)) // high) if t != NOTHING else 0 for t in top], np.int64)
                    i, j = best_places(told, ~alike & (top != NOTHING)[:, None] & (told <= top[:, None]) & (told >= least[:, None]), k)
                    found.append((i, top[i], b + j, told[i, j]))
            i, top, j, told = (np.concatenate(x) for x in zip(*found))
            turn = np.lexsort((j, -told, top, i))
            i, top, j, told = i[turn], top[turn], j[turn], told[turn]
            first = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (top[1:] != top[:-1])])) if len(i) else np.zeros(0, np.int64)
            place = np.arange(len(i)) - np.repeat(first, np.diff(np.concatenate([first, [len(i)]])))
            keep = place < k
            out.append(pd.DataFrame({"arid": ids[i[keep]], "top": top[keep], "rid": rid[j[keep]], "ord": order[j[keep]], "score": told[keep]}))
        return pd.concat(out, ignore_index=True)

    return run


def hard_negatives(table: DataFrame, anchors: Column, id_col: str = "vec_id", vec_col: str = "embedding", label: Column | str = "label",
                   scale: float = 256.0, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its first `positives`
    rows of the same label, the first `negatives` rows of other labels with low * positive <= high * negative <= high * positive.

    Each component x becomes floor(scale * x); a score is the exact integer inner product. Higher scores come first, equal ones by
    smaller id, null ids last, repeated rows in any order. `anchors` is a condition on the table's rows, a stated query set that meets all
    rows in tiles (see `tiled`), twice: for the positives, then for the windows under them. Only the best few of a tile leave it.

    Rows with a null label, a null or empty vector, a null or non-finite component, or another length than the commonest take no part.
    A repeated row is another row: it can be the anchor's positive, and each repetition of an anchor is answered. A positive with a
    score below 0 has an empty window. Anchors without positives or negatives give no rows, as does an empty table. Other columns are
    ignored, whatever their names. The id 2 ** 63 - 1 reads as null. Scores must fit a long, or ArithmeticError is raised.
    """
    kind = table.schema[id_col].dataType.simpleString()
    value = F.col(vec_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("_id"), (F.col(label) if isinstance(label, str) else label).alias("label"), value.alias("vec"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    rows = rows.where("label is not null and vec is not null and size(vec) > 0")
    rows = rows.where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    length = rows.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), "size").first()
    dims = length["size"] if length else 1
    whole = F.transform("vec", lambda x: F.floor(x * F.lit(scale)).cast("long"))
    largest = F.aggregate("vec", F.lit(0.0), lambda s, x: s + F.floor(x * F.lit(scale)).cast("double") * F.floor(x * F.lit(scale)).cast("double"))
    rows = rows.where(F.size("vec") == dims).select(F.coalesce("_id", F.lit((1 << 63) - 1)).alias("ord"), "label", "asks", whole.alias("x"), largest.alias("norm"))
    rows = written(rows.withColumn("rid", F.monotonically_increasing_id()), "scored")
    n_rows, n_anchors, norm = rows.agg(F.count("*"), F.count_if("asks"), F.max("norm")).first()
    bound = int((norm or 0.0) * (1 + 1e-9)) + 1  # |score| is at most the largest squared length, by Cauchy and Schwarz
    if bound >= 1 << 62:
        raise ArithmeticError("scores do not fit a long")
    primes = small_primes(dims, bound)
    asking = rows.where("asks").select("rid", "label", "x")
    plain = rows.select("rid", "label", "x", "ord")
    told = "arid long, top long, rid long, ord long, score long"
    first = Window.partitionBy("arid").orderBy(F.desc("score"), "ord", "rid")
    own = tiled(plain, asking, n_rows, n_anchors, dims).applyInPandas(tile_candidates(primes, True, positives, low, high), told)
    own = written(own.withColumn("n", F.row_number().over(first)).where(F.col("n") <= positives).select("arid", "ord", "rid", "score"), "positives")
    windows = own.where("score >= 0").groupBy("arid").agg(F.collect_set("score").alias("tops")).withColumnRenamed("arid", "rid")
    other = tiled(plain, asking.join(windows, "rid"), n_rows, n_anchors, dims).applyInPandas(tile_candidates(primes, False, negatives, low, high), told)
    within = Window.partitionBy("arid", "top").orderBy(F.desc("score"), "ord", "rid")
    other = other.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= negatives)
    other = other.select("arid", F.col("top").alias("score"), "rank", F.col("ord").alias("negative"), F.col("score").alias("negative_score"))
    anchor = rows.where("asks").select(F.col("rid").alias("arid"), F.col("ord").alias("anchor"))
    back = lambda c: F.nullif(F.col(c), F.lit((1 << 63) - 1)).cast(kind)
    return own.join(other, ["arid", "score"]).join(anchor, "arid").select(
        back("anchor").alias("anchor_id"), back("ord").alias("positive_id"), F.col("rank").cast("int").alias("rank"), back("negative").alias("negative_id"),
        F.col("score").alias("positive_score"), "negative_score")
