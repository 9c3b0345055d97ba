"""Whitening of vectors by Chebyshev-filtered subspace iteration: passes of centred X'XQ damp the unwanted spectrum, Rayleigh-Ritz decides."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datascry.llm.base import named, written

#: Bytes of one packed block of vectors; steps of the recurrence in one filter; steps of the bound on the smallest eigenvalue.
BLOCK_BYTES, DEGREE, BOUND_STEPS = 4 << 20, 12, 8
#: Residual of a certified component, relative to the largest eigenvalue; the most that may stay where rounding ends the progress.
CERTIFIED, ACCEPTED = 2e-14, 1e-11
#: Components below this share of the largest eigenvalue are directions without spread.
NO_SPREAD = 1e-12
#: The most by which a filter may raise the strongest column over the weakest wanted one.
SPREAD = 1e8


class CentredProducts:
    """The distinct integer vectors of a table, packed in blocks in the shared folder, and sums over their centred rows."""

    def __init__(self, fit: DataFrame, dims: int):
        self.dims = dims
        self.n, sums = self._sums(fit)
        self.sums = sums
        # Subtracting the rounded mean first, as integers, keeps every digit of the entries; the rest of the mean is below one.
        self.origin = [(2 * s + self.n) // (2 * self.n) for s in sums] if self.n else [0] * dims
        self.rest = [(s - self.n * o) / self.n for s, o in zip(sums, self.origin)] if self.n else [0.0] * dims
        self.blocks = written(fit.mapInPandas(self._packer(), "kind string, data binary"), "vector-blocks") if self.n else None

    def _sums(self, fit: DataFrame) -> tuple[int, list[int]]:
        dims = self.dims

        def partial(batches):
            import numpy as np
            import pandas as pd
            n, total = 0, np.zeros(dims, object)
            for batch in batches:
                n += len(batch)
                total = total + np.stack(batch["x"].to_numpy()).astype(object).sum(0) if len(batch) else total
            yield pd.DataFrame({"place": np.arange(dims + 1), "part": [str(n), *map(str, total)]})

        parts = fit.select("x").mapInPandas(partial, "place int, part string").groupBy("place").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s")).collect()
        found = {r["place"]: int(r["s"]) for r in parts}
        return found.get(0, 0), [found.get(i + 1, 0) for i in range(dims)]

    def _packer(self):
        import numpy as np
        origin, per_block = np.array(self.origin, np.int64), max(1, BLOCK_BYTES // (8 * self.dims))

        def pack(batches):
            import pandas as pd
            for batch in batches:
                for start in range(0, len(batch), per_block):
                    x = np.stack(batch["x"].iloc[start:start + per_block].to_numpy()).astype(np.int64) - origin
                    kind = next(k for k in ("<i2", "<i4", "<i8") if k == "<i8" or np.abs(x).max() < np.iinfo(k).max)
                    yield pd.DataFrame({"kind": [kind], "data": [x.astype(kind).tobytes()]})

        return pack

    def summed(self, of_block, size: int):
        """Sum over all blocks of of_block(centred rows), an array of `size` doubles: one pass, added up by place."""
        import numpy as np
        dims, rest = self.dims, np.array(self.rest)

        def partial(batches):
            import pandas as pd
            total, seen = np.zeros(size), False
            for batch in batches:
                for kind, data in zip(batch["kind"], batch["data"]):
                    total += of_block(np.frombuffer(data, kind).reshape(-1, dims).astype(np.float64) - rest)
                    seen = True
            if seen:
                yield pd.DataFrame({"place": np.arange(size), "part": total})

        out = np.zeros(size)
        for r in self.blocks.mapInPandas(partial, "place int, part double").groupBy("place").agg(F.sum("part").alias("s")).collect():
            out[r["place"]] = r["s"]
        return out

    def times(self, q):
        """V Q, with V the covariance (divisor n)."""
        shape = q.shape
        return self.summed(lambda rows: (rows.T @ (rows @ q)).ravel(), q.size).reshape(shape) / self.n

    def trace(self) -> float:
        return float(self.summed(lambda rows: (rows * rows).sum().reshape(1), 1)[0]) / self.n


def low_end(v: CentredProducts, rng) -> float:
    """A number at or below the smallest eigenvalue: a few Lanczos steps, the least Ritz value less the last remainder's length."""
    import numpy as np
    q = rng.standard_normal((v.dims, 1))
    q /= np.linalg.norm(q)
    basis, diagonal, beside = [q], [], []
    for _ in range(min(BOUND_STEPS, v.dims)):
        w = v.times(basis[-1])
        diagonal.append(float((basis[-1].T @ w)[0, 0]))
        held = np.hstack(basis)
        w -= held @ (held.T @ w)
        w -= held @ (held.T @ w)
        beside.append(float(np.linalg.norm(w)))
        if beside[-1] <= 1e-12 * max(abs(d) for d in diagonal):
            break
        basis.append(w / beside[-1])
    t = np.diag(diagonal) + np.diag(beside[:-1], 1) + np.diag(beside[:-1], -1)
    return max(0.0, float(np.linalg.eigvalsh(t)[0]) - beside[-1])


def filtered(v: CentredProducts, q, vq, held, top: float, wanted: float, low: float, cut: float):
    """Columns of q after the Chebyshev polynomial that stays within one on [low, cut] and grows above; `held` columns are kept out.

    The degree ends where the strongest of the columns would outgrow the weakest wanted one by more than SPREAD.
    """
    import numpy as np
    centre, half = (cut + low) / 2, (cut - low) / 2
    growth = lambda x: math.acosh(max(1.0, (x - centre) / half))
    degree = max(2, min(DEGREE, int(math.log(SPREAD) / max(growth(top) - growth(wanted), 1e-9))))
    clear = lambda y: y - held @ (held.T @ y) if held.shape[1] else y
    sigma = first = half / (top - centre)
    before, now = q, clear((vq - centre * q) * (sigma / half))
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, clear((v.times(now) - centre * now) * (2 * after / half) - before * (sigma * after))
        sigma = after
    return now


def leading_components(v: CentredProducts, count: int, seed: int = 5, cycles: int = 60):
    """(values, vectors, worst residual relative to the first value): the `count` leading eigenpairs of the covariance, certified.

    A block of three times the wanted columns is filtered, made orthonormal and rotated (Rayleigh-Ritz) until the residual of every wanted
    pair is at most CERTIFIED of the largest value. Converged leading columns are held and kept out of the recurrence. Where rounding ends the
    progress above ACCEPTED, or after a fixed number of cycles, the block is doubled; a block as wide as the vectors is exact at once, so
    this ends on any spectrum, equal eigenvalues included.
    """
    import numpy as np
    rng = np.random.default_rng(seed)
    dims, width = v.dims, min(v.dims, 3 * count)
    q = np.linalg.qr(rng.standard_normal((dims, width)))[0]
    vq = v.times(q)
    low = low_end(v, rng) if width < dims else 0.0
    best, turn, stuck = math.inf, 0, 0
    while True:
        small = q.T @ vq
        values, turned = np.linalg.eigh((small + small.T) / 2)
        values, turned = values[::-1], turned[:, ::-1]
        q, vq = q @ turned, vq @ turned
        top = max(float(values[0]), 0.0)
        if not top:
            return values[:0], q[:, :0], 0.0
        wanted = [j for j in range(min(count, width)) if values[j] > NO_SPREAD * top]
        left = np.linalg.norm(vq - q * values, axis=0) / top
        worst = float(left[wanted].max())
        stuck = stuck + 1 if worst > best / 2 else 0
        best, turn = min(best, worst), turn + 1
        if worst <= CERTIFIED or width == dims or (stuck >= 2 and worst <= ACCEPTED):
            return values[wanted], q[:, wanted], worst
        if turn % cycles == 0 or stuck >= 6:
            more = min(dims, 2 * width)
            fresh = rng.standard_normal((dims, more - width))
            fresh -= q @ (q.T @ fresh)
            fresh = np.linalg.qr(fresh - q @ (q.T @ fresh))[0]
            q, vq, width, best, stuck = np.hstack([q, fresh]), np.hstack([vq, v.times(fresh)]), more, math.inf, 0
            continue
        done = 0
        while done < len(wanted) and left[done] <= CERTIFIED:
            done += 1
        held, cut = q[:, :done], float(values[-1])
        floor = min(low, 0.999 * cut) if cut > 0 else -1e-6 * top
        cut = max(cut, 1e-6 * top) if cut <= 0 else cut
        y = filtered(v, q[:, done:], vq[:, done:], held, max(float(values[done]), 1.001 * cut), max(float(values[wanted[-1]]), 1.001 * cut), floor, cut)
        y = y / np.maximum(np.linalg.norm(y, axis=0), 1e-300)
        for _ in range(2):
            y = np.linalg.qr(y - held @ (held.T @ y))[0]
        q, vq = np.hstack([held, y]), np.hstack([vq[:, :done], v.times(y)])


def identity_error(v: CentredProducts, vectors, values) -> float:
    """Largest absolute entry of the whitened fit list's covariance less the identity, by one more pass."""
    import numpy as np
    k = len(values)
    turn = vectors / np.sqrt(values)

    def moments(rows):
        w = rows @ turn
        return np.concatenate([(w.T @ w).ravel(), w.sum(0)])

    found = v.summed(moments, k * k + k) / v.n
    mean = found[k * k:]
    return float(np.abs(found[:k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def whiten(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", count: int = 16, scale: float = 64.0, offset: int = 1_000_000, seed: int = 5) -> DataFrame:
    """Per sound row and component: id, component (1 has the largest eigenvalue), n, deviation, whitened, explained, identity_error, residual.

    Each entry c becomes x = floor(scale * c) + offset. The fit list holds each different x once; n counts it. Components are unit
    eigenvectors of its covariance (divisor n), the entry of largest size positive. deviation is the exact sum of (n * x - S) ** 2 over the
    dimensions, S the sums of the fit list, and null where it does not fit a long. identity_error and residual say how well it went.

    Rows whose vector is null, empty, of another length than the commonest, or holds null or non-finite entries are left out. Repeated rows
    count once in the fit and come back each. Components without spread (below NO_SPREAD of the largest eigenvalue) are left out, so
    one different vector, or an empty table, gives no rows. Of equal eigenvalues any orthonormal vectors may come, the same for all
    rows. Null ids and other columns, whatever their names, are no obstacle. Every pass sums inside the tasks and adds by place; the
    driver sees matrices of dims x 3 * count. An entry outside the range of a long raises an error.
    """
    kind = table.schema[id_col].dataType.simpleString()
    rows = table.select(F.col(id_col).cast("string").alias("_id"), F.col(vec_col).cast("array<double>").alias("vec")).where("vec is not null and size(vec) > 0")
    rows = rows.where(F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    length = rows.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), "size").first()
    dims = length["size"] if length else 1
    whole = F.transform("vec", lambda c: F.floor(c * F.lit(scale)).cast("long") + F.lit(offset).cast("long"))
    rows = rows.where(F.size("vec") == dims).select("_id", whole.alias("x"))
    fit = written(rows.select("x").distinct(), "fit-list")
    v = CentredProducts(fit, dims)
    columns = "component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"
    nothing = table.sparkSession.createDataFrame([], f"{id_col} {kind}, {columns}")
    if not v.n:
        return nothing
    values, vectors, worst = leading_components(v, count, seed)
    if not len(values):
        return nothing
    import numpy as np
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    error, share = identity_error(v, vectors, values), [float(e) for e in values / v.trace()]
    n, origin, rest, turn = v.n, np.array(v.origin, np.int64), np.array(v.rest), vectors / np.sqrt(values)
    off = [s - v.n * o for s, o in zip(v.sums, v.origin)]

    def project(batches):
        import pandas as pd
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["x"].to_numpy()).astype(np.int64) - origin
            rough = ((n * x.astype(np.float64)) ** 2).sum(1)
            if rough.max() < 1e18:
                gaps = n * x - np.array(off, np.int64)
                far = (gaps * gaps).sum(1).tolist()
            else:
                far = [sum((n * int(a) - o) ** 2 for a, o in zip(row, off)) for row in x]
                far = [f if f < 1 << 63 else None for f in far]
            yield pd.DataFrame({"_id": batch["_id"], "deviation": pd.array(far, dtype="Int64"), "w": list((x.astype(np.float64) - rest) @ turn)})

    out = rows.mapInPandas(project, "_id string, deviation long, w array<double>")
    out = out.select("_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    out = out.select("_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                     F.lit(share)[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"), F.lit(worst).alias("residual"))
    return named(out, "_id" if id_col == "_id" else id_col, kind)
