"""Near-duplicate vectors by NN-descent: a neighbour graph refined through neighbours of neighbours, its links counted whole."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datascry.llm.base import components, partitions, written

#: Members compared at once around one node; rows of a block in the comparison of saturated components; blocks whose
#: balls meet at once, on average; rows of an audit.
AROUND, BLOCK, TILE, AUDIT = 48, 512, 4096, 256
PLANES = 24


def unit_rows(column):
    """Matrix of the vectors of a pandas column, as doubles of length 1."""
    import numpy as np
    rows = np.array(column.tolist(), dtype=np.float64)
    most = np.abs(rows).max(axis=1, keepdims=True)
    rows = np.where((most > 1e150) | (most < 1e-150), rows / most, rows)  # their squares would leave the range of a double
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def sorted_neighbours(vecs: DataFrame, dims: int, k: int, seed: int) -> DataFrame:
    """(id, nbr, sim): the best k neighbours of each vector among those beside it in the order of its random sign code."""
    import numpy as np
    planes = np.random.default_rng(seed).standard_normal((dims, PLANES))

    def code(batches):
        import pandas as pd
        for batch in batches:
            signs = unit_rows(batch["vec"]) @ planes > 0
            yield pd.DataFrame({"rid": batch["rid"], "vec": batch["vec"], "code": signs @ (1 << np.arange(PLANES - 1, -1, -1))})

    coded = vecs.select("rid", "vec").mapInPandas(code, "rid long, vec array<double>, code long").withColumn("tie", F.xxhash64("rid", F.lit(seed)))
    dealt = coded.repartitionByRange(partitions(vecs.sparkSession), "code", "tie").sortWithinPartitions("code", "tie").select("rid", "vec")

    def beside(batches):
        import pandas as pd
        ids, rows = np.zeros(0, np.int64), np.zeros((0, dims))
        for batch in batches:
            ids, rows = np.concatenate([ids, batch["rid"].to_numpy()]), np.concatenate([rows, unit_rows(batch["vec"])])
            out, start = [], 0
            while start == 0 or start + 32 < len(ids):
                part, mine = rows[start:start + 64], ids[start:start + 64]
                near = part @ part.T
                np.fill_diagonal(near, -2)
                best = np.argsort(-near, axis=1)[:, :k]
                taken = np.take_along_axis(near, best, 1)
                out.append(pd.DataFrame({"id": np.repeat(mine, best.shape[1]), "nbr": mine[best].ravel(), "sim": taken.ravel()}))
                start += 32
            yield pd.concat(out).query("sim > -2")
            ids, rows = ids[-64:], rows[-64:]

    return dealt.mapInPandas(beside, "id long, nbr long, sim double")


def best_of(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest neighbours of each id out of edges(id, nbr, sim, fresh); an edge seen before is not fresh."""
    once = edges.groupBy("id", "nbr").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    order = Window.partitionBy("id").orderBy(F.desc("sim"), "nbr")
    return once.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def refine(graph: DataFrame, vecs: DataFrame, k: int, turn: int) -> DataFrame:
    """One round: the neighbours of each node, either way, are compared where one of them is fresh; the best k stay.

    A node with many neighbours deals them to groups anew in each round, so no group is larger than AROUND on average.
    """
    worst = graph.groupBy("id").agg(F.count("*").alias("n"), F.min("sim").alias("low")).select(F.col("id").alias("u"), F.when(F.col("n") >= k, F.col("low")).otherwise(F.lit(-2.0)).alias("low"))
    around = graph.select(F.col("id").alias("v"), F.col("nbr").alias("u"), "fresh").unionByName(graph.select(F.col("nbr").alias("v"), F.col("id").alias("u"), "fresh"))
    around = around.groupBy("v", "u").agg(F.max("fresh").alias("fresh"))
    sizes = around.groupBy("v").agg(F.ceil(F.count("*") / AROUND).cast("int").alias("parts"))
    dealt = around.join(sizes, "v").select("v", F.pmod(F.xxhash64("u", F.lit(turn)), F.col("parts")).cast("int").alias("part"), "u", "fresh")
    known = vecs.select(F.col("rid").alias("u"), "vec").join(worst, "u", "left").withColumn("low", F.coalesce("low", F.lit(-2.0)))
    rows = dealt.join(known, "u").repartition("v", "part").sortWithinPartitions("v", "part")

    def compare(batches):
        import numpy as np
        import pandas as pd
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = held.iloc[-1]
            whole = ~((held["v"] == last["v"]) & (held["part"] == last["part"])).to_numpy()
            ready, held = held[whole], held[~whole]
            if len(ready):
                yield groups(ready)
        if held is not None and len(held):
            yield groups(held)

    def groups(frame):
        import numpy as np
        import pandas as pd
        rows, ids = unit_rows(frame["vec"]), frame["u"].to_numpy()
        low, fresh = frame["low"].to_numpy(), frame["fresh"].to_numpy(dtype=bool)
        v, part = frame["v"].to_numpy(), frame["part"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (part[1:] != part[:-1])]))
        first, second, sims = [], [], []
        for a, b in zip(starts, np.concatenate([starts[1:], [len(v)]])):
            near = rows[a:b] @ rows[a:b].T
            better = (near > low[a:b][:, None]) & (fresh[a:b][:, None] | fresh[a:b][None])
            np.fill_diagonal(better, False)
            i, j = np.nonzero(better)
            first.append(ids[a:b][i])
            second.append(ids[a:b][j])
            sims.append(near[i, j])
        return pd.DataFrame({"id": np.concatenate(first), "nbr": np.concatenate(second), "sim": np.concatenate(sims)}).drop_duplicates(["id", "nbr"])

    found = rows.mapInPandas(compare, "id long, nbr long, sim double").withColumn("fresh", F.lit(True))
    return best_of(graph.withColumn("fresh", F.lit(False)).unionByName(found), k)


def neighbour_graph(vecs: DataFrame, dims: int, k: int, orders: int, rounds: int, seed: int) -> DataFrame:
    """(id, nbr, sim, fresh): the k nearest neighbours found for each vector; ends when a round changes under 1 in 500 entries."""
    start = None
    for n in range(orders):
        part = sorted_neighbours(vecs, dims, k, seed + n)
        start = part if start is None else start.unionByName(part)
    graph = written(best_of(start.withColumn("fresh", F.lit(True)), k), "neighbours")
    for turn in range(rounds):
        graph = written(refine(graph, vecs, k, seed + turn), "neighbours")
        changed, size = graph.agg(F.sum(F.col("fresh").cast("int")), F.count("*")).first()
        if not size or changed * 500 <= size:
            break
    return graph


def in_blocks(members: DataFrame, vecs: DataFrame) -> DataFrame:
    """members(comp, scope, rid, copies) with vec and box: blocks of at most BLOCK rows of one scope along a projection, named by their first rid.

    Rows are split by their whole order (scope, place, rid), so a large scope is spread over tasks.
    """
    rows = members.join(vecs.select("rid", "vec"), "rid").withColumn("along", F.aggregate("vec", F.lit(0.0), lambda s, x: s + x))
    rows = rows.repartitionByRange(partitions(vecs.sparkSession), "scope", "along", "rid").sortWithinPartitions("scope", "along", "rid")

    def deal(batches):
        scope, box, held = None, None, 0
        for batch in batches:
            names = []
            for s, r in zip(batch["scope"], batch["rid"]):
                if s != scope or held == BLOCK:
                    scope, box, held = s, r, 0
                held += 1
                names.append(box)
            yield batch[["comp", "rid", "copies", "vec"]].assign(box=names)

    return written(rows.select("scope", "comp", "rid", "copies", "vec").mapInPandas(deal, "comp long, rid long, copies long, vec array<double>, box long"), "saturated")


def near_blocks(rows: DataFrame, at_least: float) -> DataFrame:
    """(box, other), box <= other: the pairs of blocks that can hold a link, by the balls around them.

    A ball is the mean direction of a block and the largest angle to it. Two blocks are left out only where the angle between
    their means is above both radii and the angle of a link together, so no link is lost. One row per block is compared, in
    tiles of about TILE balls; pairs that pass leave a tile, never all of them.
    """
    reach = math.acos(max(-1.0, min(1.0, at_least)))

    def ball(frame):
        import numpy as np
        import pandas as pd
        units = unit_rows(frame["vec"])
        mean = units.mean(0)
        size = np.linalg.norm(mean)
        mean = mean / size if size > 1e-9 else units[0]
        return pd.DataFrame({"box": [frame["box"].iloc[0]], "mean": [mean], "radius": [float(np.arccos(np.clip(units @ mean, -1, 1)).max())]})

    balls = written(rows.select("box", "vec").groupBy("box").applyInPandas(ball, "box long, mean array<double>, radius double"), "balls")
    tiles = max(1, -(-balls.count() // TILE))
    balls = balls.withColumn("tile", F.pmod(F.xxhash64("box"), F.lit(tiles)).cast("int"))
    left = balls.select(F.col("tile").alias("one"), F.explode(F.sequence("tile", F.lit(tiles - 1))).alias("two"), F.lit(0).alias("side"), "box", "mean", "radius")
    right = balls.where("tile > 0").select(F.explode(F.sequence(F.lit(0), F.col("tile") - 1)).alias("one"), F.col("tile").alias("two"), F.lit(1).alias("side"), "box", "mean", "radius")

    def meet(frame):
        import numpy as np
        import pandas as pd
        one, two = frame[frame["side"] == 0], frame[frame["side"] == 1]
        own = frame["one"].iloc[0] == frame["two"].iloc[0]
        two = one if own else two
        first, second = [], []
        if len(one) and len(two):
            means, radii, names = np.array(two["mean"].tolist()), two["radius"].to_numpy(), two["box"].to_numpy()
            for n in range(0, len(one), 256):
                part = one.iloc[n:n + 256]
                angle = np.arccos(np.clip(np.array(part["mean"].tolist()) @ means.T, -1, 1))
                i, j = np.nonzero(angle <= part["radius"].to_numpy()[:, None] + radii[None] + reach + 1e-6)
                a, b = part["box"].to_numpy()[i], names[j]
                keep = a <= b if own else np.ones(len(a), bool)
                first.append(np.minimum(a, b)[keep])
                second.append(np.maximum(a, b)[keep])
        none = [np.zeros(0, np.int64)]
        return pd.DataFrame({"box": np.concatenate(none + first), "other": np.concatenate(none + second)})

    return left.unionByName(right).groupBy("one", "two").applyInPandas(meet, "box long, other long")


def links_among(members: DataFrame, vecs: DataFrame, at_least: float) -> tuple[DataFrame, DataFrame]:
    """((rid, n, kinds), (a, b)): copies and vectors linked with each member, itself left out, and the different components that link.

    members: (comp, scope, rid, copies). The enlarged list of a saturated vector is every member of any saturated component:
    blocks of a scope meet all blocks whose balls are near enough for a link. Counts and pairs of components leave a block
    pair, never pairs of vectors.
    """
    rows = in_blocks(members, vecs)
    units = written(near_blocks(rows, at_least), "block-pairs")
    sides = units.select("*", F.col("box").alias("mine"), F.lit(0).alias("side")).unionByName(units.where("box < other").select("*", F.col("other").alias("mine"), F.lit(1).alias("side")))
    work = rows.withColumnRenamed("box", "mine").join(sides, "mine").select("box", "other", "side", "comp", "rid", "copies", "vec")

    def count(frame):
        import numpy as np
        import pandas as pd
        left, right = frame[frame["side"] == 0], frame[frame["side"] == 1]
        own = not len(right)
        right = left if own else right
        near = unit_rows(left["vec"]) @ unit_rows(right["vec"]).T >= at_least
        if own:
            np.fill_diagonal(near, False)
        out = pd.DataFrame({"rid": left["rid"], "n": near @ right["copies"].to_numpy(), "kinds": near.sum(1)})
        if not own:
            out = pd.concat([out, pd.DataFrame({"rid": right["rid"], "n": near.T @ left["copies"].to_numpy(), "kinds": near.sum(0)})])
        one, two = left["comp"].to_numpy(), right["comp"].to_numpy()
        i, j = np.nonzero(near & (one[:, None] != two[None]))
        met = pd.DataFrame({"a": one[i], "b": two[j]}).drop_duplicates()
        out, met = out[out["kinds"] > 0], met.assign(n=0, kinds=0)
        return pd.concat([out.assign(a=None, b=None), met.assign(rid=None)]).astype({c: "Int64" for c in ("rid", "n", "kinds", "a", "b")})[["rid", "n", "kinds", "a", "b"]]

    found = written(work.groupBy("box", "other").applyInPandas(count, "rid long, n long, kinds long, a long, b long"), "block-links")
    counted = found.where("rid is not null").groupBy("rid").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds"))
    return counted, found.where("rid is null").select("a", "b").distinct()


def merged(comps: DataFrame, met: DataFrame) -> DataFrame:
    """comps(id, comp) with the components named in met(a, b) made one."""
    joined = components(met, "merged").select(F.col("id").alias("comp"), F.col("comp").alias("whole"))
    return comps.join(joined, "comp", "left").select("id", F.coalesce("whole", "comp").alias("comp"))


def audit(vecs: DataFrame, kinds: DataFrame, at_least: float) -> float:
    """Recall of the links of AUDIT vectors taken by hash, half of them among those that have links; kinds(rid, kinds). 1.0 where there is none.

    The lower of two figures: the share of all their true links that were found, and the mean share per vector, in which
    a vector with two links weighs as much as one of a large group.
    """
    order = [F.xxhash64("rid"), F.col("rid")]
    linked = kinds.where("kinds > 0").select("rid").orderBy(*order).limit(AUDIT // 2)
    chosen = linked.unionByName(vecs.select("rid").orderBy(*order).limit(AUDIT // 2)).distinct()
    asked = vecs.select("rid", "vec").join(F.broadcast(chosen), "rid").toPandas()
    if not len(asked):
        return 1.0
    import numpy as np
    matrix, ids = unit_rows(asked["vec"]), asked["rid"].to_numpy()

    def run(batches):
        import pandas as pd
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            total += (matrix @ unit_rows(batch["vec"]).T >= at_least).sum(1)
        yield pd.DataFrame({"rid": ids, "n": total})

    true = vecs.select("vec").mapInPandas(run, "rid long, n long").groupBy("rid").agg((F.sum("n") - 1).alias("n")).where("n > 0")
    hit = F.least("n", F.coalesce("kinds", F.lit(0)))
    every, found, mean = true.join(kinds, "rid", "left").agg(F.sum("n"), F.sum(hit), F.avg(hit / F.col("n"))).first()
    return 1.0 if not every else float(min(found / every, mean))


def near_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", at_least: float = 0.9, k: int = 10, orders: int = 4, rounds: int = 8,
                 recall: float = 0.95, tries: int = 3, seed: int = 7) -> DataFrame:
    """Per row: id, n_links, component_id, kept, audit_recall: vectors linked at a cosine of `at_least` or more, in doubles.

    Equal vectors are one class and link with each other. The graph starts from neighbours in several sign orders and is
    refined by NN-descent. A list is saturated when all of its k entries link. A link that two short lists both miss joins two
    saturated vectors, so every vector of a component with saturated lists is compared with all others of such components,
    in blocks, bar those that the balls around them keep apart: links inside and across these components are counted whole,
    and components that link become one. Links of the others are the entries of their lists, either way. An audit compares
    some vectors, half of them with links, with all; below `recall` the search starts again with longer lists and more
    orders, `tries` times; then all vectors are compared by blocks and balls. No list or group is cut.

    Vectors that are null, empty, zero, or hold null or non-finite parts link with nothing, likewise vectors of another length
    than the commonest. component_id is the smallest id reachable (a null id never names one unless alone); repeated rows link
    as any other rows; other columns are ignored; an empty table gives no rows.
    """
    kind = table.schema[id_col].dataType.simpleString()
    rows = table.select(F.col(id_col).alias("_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    sound = rows.where("vec is not null and size(vec) > 0").where(finite)
    length = sound.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), "size").first()
    dims = length["size"] if length else 1
    sound = sound.where(F.size("vec") == dims)
    vecs = sound.groupBy("vec").agg(F.min("_id").alias("low"), F.count("*").alias("copies")).withColumn("rid", F.monotonically_increasing_id())
    vecs = written(vecs, "vectors")
    copies = vecs.select("rid", "copies")
    for attempt in range(tries):
        graph = neighbour_graph(vecs, dims, k << attempt, orders << attempt, rounds, seed + 100 * attempt)
        true = graph.where(F.col("sim") >= at_least)
        links = true.select(F.greatest("id", "nbr").alias("a"), F.least("id", "nbr").alias("b")).distinct()
        comps = written(components(links), "vector-components")
        full = true.groupBy("id").count().where(F.col("count") >= (k << attempt)).select("id")
        dense = full.join(comps, "id").select("comp").distinct()
        members = comps.withColumnRenamed("id", "rid").join(dense, "comp").join(copies, "rid")
        whole, met = links_among(members.select("comp", F.col("comp").alias("scope"), "rid", "copies"), vecs, at_least)
        ends = links.select(F.col("a").alias("rid"), F.col("b").alias("o")).unionByName(links.select(F.col("b").alias("rid"), F.col("a").alias("o")))
        ends = ends.join(members.select("rid"), "rid", "leftanti").join(copies.select(F.col("rid").alias("o"), "copies"), "o")
        counted = written(whole.unionByName(ends.groupBy("rid").agg(F.sum("copies").alias("n"), F.count("*").alias("kinds"))), "vector-links")
        comps = merged(comps, met)
        reached = audit(vecs, counted.select("rid", "kinds"), at_least)
        if reached >= recall:
            break
    else:
        counted, met = links_among(copies.select(F.col("rid").alias("comp"), F.lit(0).alias("scope"), "rid", "copies"), vecs, at_least)
        comps, reached = components(met, "exact-components"), 1.0
    told = vecs.join(counted.drop("kinds"), "rid", "left").join(comps.withColumnRenamed("id", "rid"), "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
    lows = told.groupBy("comp").agg(F.min("low").alias("component_id"))
    told = told.join(lows, "comp").select("vec", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    found = sound.join(told, "vec").select("_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(F.col("vec").isNotNull() & (F.size("vec") == dims) & finite, F.lit(False)))
    out = found.unionByName(alone.select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id")))
    return out.select(F.col("_id").cast(kind).alias(id_col), "n_links", "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"), F.lit(float(reached)).alias("audit_recall"))
