"""Clustering queries."""

from datascry.catalog import query
from datascry.operators import cluster as cu

from pyspark.sql import functions as F

COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("kmeans_auto_k")
def _(t):
    return cu.kmeans_auto_k(t.lineitem, COLS)[1].withColumn("silhouette", F.round("silhouette", 6))


@query("pca_2d")
def _(t):
    rows, _table = cu.kmeans_auto_k(t.customer, ["c_acctbal", "c_nationkey"])
    return cu.pca_2d(rows, ["c_custkey", "cluster"]).select("c_custkey", "cluster", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"))


@query("pca_variance")
def _(t):
    table = cu.pca_variance(t.lineitem, COLS)
    return table.select("component", F.round("share", 6).alias("share"), F.round("cumulative", 6).alias("cumulative"))


# The squared eigenvalues of a correlation matrix add up to its squared entries.
@query("pca_variance_squares", "select round(" + " + ".join(f"power(corr({a}, {b}), 2)" if a != b else "1" for a in COLS for b in COLS) + ", 6) as squares from lineitem")
def _(t):
    table = cu.pca_variance(t.lineitem, COLS)
    return table.agg(F.round(F.sum(F.col("share") * F.col("share")) * len(COLS) ** 2, 6).alias("squares"))


LABELLED = "(select l_extendedprice, (l_suppkey % 3)::int as cluster from lineitem)"


def labelled(t):
    return t.lineitem.select("l_extendedprice", (F.col("l_suppkey") % 3).cast("int").alias("cluster"))


@query("cluster_sizes", f"select cluster, count(*) as n from {LABELLED} group by 1")
def _(t):
    return cu.cluster_sizes(labelled(t))


@query("cluster_density", f"""with e as (select min(l_extendedprice) as lo, (max(l_extendedprice) - min(l_extendedprice)) / 30 as w from lineitem),
       n as (select cluster, least(floor((l_extendedprice - lo) / w), 29)::int as bin, count(*) as n from {LABELLED}, e group by 1, 2), z as (select cluster, count(*) as z from {LABELLED} group by 1)
       select z.cluster, round(lo + b.bin * w + w / 2, 4) as x_num, round(coalesce(n.n, 0) / z.z, 6) as y from z cross join (select unnest(range(30))::int as bin) b cross join e left join n on n.cluster = z.cluster and n.bin = b.bin""")
def _(t):
    out = cu.cluster_density(labelled(t), "l_extendedprice")
    return out.select("cluster", F.round("x_num", 4).alias("x_num"), F.round("y", 6).alias("y"))
