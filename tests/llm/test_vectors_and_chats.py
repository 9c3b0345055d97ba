"""Hard negatives, whitening and reply trees against plain versions, with nulls, ties, repeated rows, clashing names and empty tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

VECS = "vec_id long, embedding array<float>, label int, x string, rid long, score int, _r int, kind string"


def odd_vectors(seed, n=300, dims=12):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dims)).astype(np.float32)
    base[40:90] = base[40]            # a large group of copies: ties of equal scores
    base[100:110] = base[100:110].round(1)
    rows = [(int(k), [float(c) for c in v], int(k % 4), "clash", 1, 2, 3, "k") for k, v in enumerate(base)]
    rows += [rows[0], rows[41], rows[120]]  # repeated rows, an anchor's among them
    rows += [(None, rows[7][1], 1, "clash", 1, 2, 3, "k"), (1000, None, 1, None, 1, 2, 3, "k"), (1010, [], 1, None, 1, 2, 3, "k"), (1020, rows[5][1], None, None, 1, 2, 3, "k"),
             (1030, [None] * dims, 2, None, 1, 2, 3, "k"), (1040, [float("nan")] * dims, 2, None, 1, 2, 3, "k"), (1050, [float("inf")] + [0.0] * (dims - 1), 2, None, 1, 2, 3, "k"),
             (1060, [1.0, 2.0], 2, None, 1, 2, 3, "k"), (1070, [0.0] * dims, 2, None, 1, 2, 3, "k")]
    return rows, dims


def plain_negatives(rows, dims, anchors, k=5):
    good = [(math.inf if i is None else i, lab, [math.floor(256 * c) for c in v]) for i, v, lab, *_ in rows
            if lab is not None and v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a, anchor in enumerate(good):
        if anchor[0] == math.inf or not anchors(anchor[0]):
            continue
        told = [(-sum(p * q for p, q in zip(anchor[2], r[2])), r[0], r[1]) for b, r in enumerate(good) if a != b]
        for s, pid, _ in sorted((t for t in told if t[2] == anchor[1]), key=lambda t: t[:2])[:k]:
            fits = sorted((t for t in told if t[2] != anchor[1] and 80 * -s <= 100 * -t[0] <= 100 * -s), key=lambda t: t[:2])[:k]
            out += [(anchor[0], pid, n + 1, t[1], -s, -t[0]) for n, t in enumerate(fits)]
    return sorted(out)


def told(df):
    return sorted(tuple(math.inf if v is None else v for v in r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_exact_products_of_residues():
    from datascry.llm.hard_negatives import residues, scores, small_primes
    rng = np.random.default_rng(0)
    for dims, most in ((64, 150), (3, 1 << 20), (700, 1 << 10), (64, 1 << 27), (1, 1 << 30)):
        x, y = rng.integers(-most, most, (30, dims)), rng.integers(-most, most, (40, dims))
        x[0], y[0] = most, -most
        primes = small_primes(dims, dims * most * most)
        assert (scores(residues(x, primes), residues(y, primes), primes) == x.astype(object) @ y.astype(object).T).all()


@pytest.mark.parametrize("tile_bytes", [32 << 20, 4000])
def test_hard_negatives(spark, monkeypatch, tile_bytes):
    from datascry.llm import hard_negatives as module
    monkeypatch.setattr(module, "TILE_BYTES", tile_bytes)  # 4 000 bytes: 41 vectors a tile, several tiles of anchors and of rows
    rows, dims = odd_vectors(1)
    df = spark.createDataFrame(rows, VECS).repartition(3)
    got = told(module.hard_negatives(df, F.col("vec_id") % 6 == 0))
    assert got and got == plain_negatives(rows, dims, lambda i: i % 6 == 0)


def test_hard_negatives_of_nothing(spark):
    from datascry.llm.hard_negatives import hard_negatives
    rows, _ = odd_vectors(1)
    df = spark.createDataFrame(rows, VECS)
    assert hard_negatives(df.where("false"), F.col("vec_id") % 6 == 0).count() == 0
    assert hard_negatives(df, F.lit(None).cast("boolean")).count() == 0
    assert hard_negatives(df.where("label = 1"), F.col("vec_id") % 5 == 0).count() == 0  # no other label
    with pytest.raises(ArithmeticError):
        hard_negatives(spark.createDataFrame([(0, [1e12, 1.0], 1), (1, [1.0, 1e12], 2)], "vec_id long, embedding array<double>, label int"), F.lit(True))


# 12 --------------------------------------------------------------------------------------------------------------------------

def plain_whitening(rows, dims, count=16):
    good = [(i, [math.floor(64 * c) + 1000000 for c in v]) for i, v, *_ in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}), dtype=object)
    n, sums = len(fit), fit.sum(0)
    centred = ((n * fit - sums) / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:count], vectors[:, ::-1][:, :count]
    x = np.array([x for _, x in good], dtype=object)
    gaps = n * x - sums
    return [i for i, _ in good], n, (gaps * gaps).sum(1), (gaps / n).astype(float) @ vectors / np.sqrt(values), values / np.trace(centred.T @ centred / n)


@pytest.mark.parametrize("dims,wide", [(12, 300), (40, 400), (80, 900)])  # narrower than the block, filtered from a block of 48
def test_whitening(spark, dims, wide):
    from datascry.llm.whitening import whiten
    rows, _ = odd_vectors(dims, wide, dims)
    got = whiten(spark.createDataFrame(rows, VECS).repartition(3)).collect()
    ids, n, far, white, shares = plain_whitening(rows, dims)
    key = lambda i: -1 if i is None else i
    k = white.shape[1]
    assert len(got) == len(ids) * k and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-10
    mine = sorted(((key(r.vec_id), r.component, r.deviation, abs(r.whitened), r.explained) for r in got), key=lambda r: r[:2])
    theirs = sorted(((key(i), c + 1, int(far[a]), abs(white[a, c]), shares[c]) for a, i in enumerate(ids) for c in range(k)), key=lambda r: r[:2])
    for a, b in zip(mine, theirs):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], abs=1e-8) and a[4] == pytest.approx(b[4], rel=1e-10)
    signs = {}  # one sign per component, the same for all rows
    at = {(key(i), c + 1): white[a, c] for a, i in enumerate(ids) for c in range(k)}
    for r in got:
        if abs(r.whitened) > 1e-6:
            signs.setdefault(r.component, set()).add(np.sign(r.whitened * at[(key(r.vec_id), r.component)]))
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_of_equal_eigenvalues_and_of_little(spark):
    from datascry.llm.whitening import whiten
    schema = "vec_id long, embedding array<double>"
    axes = [(2 * i + s, [float((s * 2 - 1) * (j == i)) for j in range(60)]) for i in range(60) for s in (0, 1)]  # all 60 eigenvalues equal
    got = whiten(spark.createDataFrame(axes, schema)).collect()
    assert len(got) == 120 * 16 and max(r.identity_error for r in got) < 1e-10 and all(r.explained == pytest.approx(1 / 60) for r in got)
    line = whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(10)], schema)).collect()  # rank one
    assert {r.component for r in line} == {1} and len(line) == 10 and all(r.explained == pytest.approx(1.0) for r in line)
    assert whiten(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], schema)).count() == 0
    assert whiten(spark.createDataFrame([], schema)).count() == 0
    far = whiten(spark.createDataFrame([(i, [float(i) * 1e12, float(i % 3)]) for i in range(50)], schema), count=1).collect()
    assert all(r.deviation is None for r in far if r.vec_id in (0, 49))  # no long holds it


# 13 --------------------------------------------------------------------------------------------------------------------------

def messages(spark, rows):
    schema = "conv_id long, node long, parent long, role string, text string, score double, rid long, up int, leaf string, branch int"
    return spark.createDataFrame([(*r, 1, 2, "clash", 3) for r in rows], schema)


def chats(df, **options):
    from datascry.llm.reply_trees import format_trees, loss_text, parse_turns
    out = format_trees(df, **options)
    rows = out.select("conv_id", "branch", parse_turns(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss")).alias("learned"), "formatted", "loss").collect()
    for r in rows:
        at = 0
        for k, turn in enumerate(r.formatted.split("\n</turn>\n")[:-1]):  # the mask, as offsets into the whole text, holds escaped assistant texts
            for m in (m for m in r.loss if m.turn == k):
                assert r.turns[k].role == "assistant" and turn[m.start:m.end] == r.formatted[at + m.start:at + m.end]
            at += len(turn) + len("\n</turn>\n")
        assert r.learned == "".join(t.text for t in r.turns if t.role == "assistant")
    return {(r.conv_id, r.branch): [(t.role, t.text) for t in r.turns] for r in rows}


def test_branches_of_reply_trees(spark):
    odd = ["", "\\", "\\\\### Assistant: </turn> ok", "\n</turn>\n### user:\nhm", "####", "<</turn>", "日\U0001f389\n\n", "x" * 50000, "ends in \\"]
    rows = [(1, 1, None, "user", odd[2], 0.0), (1, 2, 1, "assistant", odd[3], 1.0), (1, 3, 1, "assistant", odd[4], 2.0), (1, 4, 2, "user", odd[5], 5.0), (1, 5, 3, "us:er\n#", odd[6], 1.0),
            (1, 6, 3, "assistant", odd[7], 1.0), (1, 7, 99, "user", odd[8], None), (2, 1, 2, "user", "a cycle", 0.0), (2, 2, 1, "assistant", "a cycle", 0.0), (2, 3, 2, "user", "below it", 0.0),
            (None, 1, None, None, None, 1.0), (None, 2, 1, "assistant", None, 1.0), (1, 5, 3, "us:er\n#", odd[6], 1.0), (3, None, None, "user", "no number", 0.0), (4, 1, 1, "user", "answers itself", 0.0)]
    df = messages(spark, rows).repartition(3)
    first, at = ("user", odd[2]), lambda n: ("assistant", odd[n])
    want = {(1, 1): [first, at(3), ("user", odd[5])], (1, 2): [first, at(4), ("us:er\n#", odd[6])], (1, 3): [first, at(4), at(7)], (1, 4): [("user", odd[8])],
            (None, 1): [("", ""), ("assistant", "")], (3, 1): [("user", "no number")]}
    got = chats(df, score_col="score")
    assert {k: v for k, v in got.items() if k not in ((1, 2), (1, 3))} == {k: v for k, v in want.items() if k not in ((1, 2), (1, 3))}
    assert sorted(got[k] for k in ((1, 2), (1, 3))) == sorted(want[k] for k in ((1, 2), (1, 3)))  # equal scores
    assert set(chats(df, score_col="score", branches=1)) == {(1, 1), (None, 1), (3, 1)}
    assert chats(df.where("false")) == {}


def test_long_and_wide_trees(spark):
    rng = random.Random(2)
    rows = [(1, 1, None, "user", "root", 0.0)] + [(1, n, n - 1 if n < 200 else rng.randrange(1, n), rng.choice(["user", "assistant"]), f"m{n}", rng.random()) for n in range(2, 500)]
    rows += [(2, n, 1 if n > 1 else None, "assistant", f"w{n}", float(n)) for n in range(1, 400)]  # one root with many answers
    parent, text, role, score = ({(r[0], r[1]): r[k] for r in rows} for k in (2, 4, 3, 5))
    want = []
    for tree in (1, 2):
        inner = {parent[k] for k in parent if k[0] == tree}
        for leaf in (k[1] for k in parent if k[0] == tree and k[1] not in inner):
            path, at = [], leaf
            while at is not None:
                path.append(at)
                at = parent[(tree, at)]
            want.append((tree, -sum(score[(tree, n)] for n in reversed(path)), [(role[(tree, n)], text[(tree, n)]) for n in reversed(path)]))
    got = chats(messages(spark, rows).repartition(4), score_col="score")
    for tree in (1, 2):
        mine = sorted((w for w in want if w[0] == tree), key=lambda w: w[1])
        assert [got[(tree, b + 1)] for b in range(len(mine))] == [w[2] for w in mine]
    assert len(got) == len(want)


def test_conversations_as_trees(spark):
    from datascry.llm.reply_trees import linear_trees
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (1, None, "system", "s"), (None, 5, None, None), (2, 7, "assistant", "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, at int")
    assert chats(linear_trees(df)) == {(1, 1): [("system", "s"), ("user", "a"), ("assistant", "b"), ("assistant", "b")], (None, 1): [("", "")], (2, 1): [("assistant", "")]}


def two_batches(seed=3, dims=64):
    """600 vectors apart, 20 groups of 60 near copies, and 10 groups of two batches of 15, the batches 0.94 apart."""
    rng = np.random.default_rng(seed)

    def unit(v):
        return v / np.linalg.norm(v)

    def around(centre, n):
        return [unit(centre + 0.004 * rng.standard_normal(dims)) for _ in range(n)]

    rows = [unit(rng.standard_normal(dims)) for _ in range(600)]
    for _ in range(20):
        rows += around(unit(rng.standard_normal(dims)), 60)
    for _ in range(10):
        one = unit(rng.standard_normal(dims))
        side = rng.standard_normal(dims)
        side = unit(side - (side @ one) * one)
        rows += around(one, 15) + around(0.94 * one + math.sqrt(1 - 0.94 ** 2) * side, 15)
    rows = np.array(rows)
    return rows[rng.permutation(len(rows))]


def plain_links(rows, at_least):
    near = rows @ rows.T >= at_least
    np.fill_diagonal(near, False)
    low = np.arange(len(rows))
    while True:
        new = np.minimum(low, np.where(near, low[None], len(rows)).min(1))
        if (new == low).all():
            return near.sum(1), low
        low = new


@pytest.mark.parametrize("block, tile", [(512, 4096), (8, 3)])
def test_dense_batches_just_above_the_limit(spark, monkeypatch, block, tile):
    from datascry.llm import nn_descent
    monkeypatch.setattr(nn_descent, "BLOCK", block)
    monkeypatch.setattr(nn_descent, "TILE", tile)
    rows = two_batches()
    links, low = plain_links(rows, 0.9)
    df = spark.createDataFrame([(n, [float(c) for c in v], 1) for n, v in enumerate(rows)], "vec_id long, embedding array<double>, box int")
    got = nn_descent.near_vectors(df).orderBy("vec_id").toPandas()
    assert (got["n_links"] == links).all() and (got["component_id"] == low).all()
    assert len(set(low[links > 0])) == 30 and got["audit_recall"].iloc[0] == 1.0


def test_vectors_compared_whole_where_the_audit_fails(spark, monkeypatch):
    from datascry.llm import nn_descent
    monkeypatch.setattr(nn_descent, "BLOCK", 64)
    rows = two_batches(5)[:400]
    links, low = plain_links(rows, 0.9)
    df = spark.createDataFrame([(n, [float(c) for c in v]) for n, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = nn_descent.near_vectors(df, recall=2.0, tries=1).orderBy("vec_id").toPandas()  # no audit reaches this: the exact way
    assert (got["n_links"] == links).all() and (got["component_id"] == low).all()


def test_huge_and_tiny_vectors_link(spark):
    from datascry.llm.nn_descent import near_vectors
    rows = [(1, [1e300, 1e300]), (2, [1e-300, 1.1e-300]), (3, [1.0, -1.0]), (4, [0.0, 0.0]), (5, None)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4), 5: (0, 5)}
