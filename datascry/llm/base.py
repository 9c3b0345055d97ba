"""Helpers shared by the operators of this folder: words, tables in the shared folder, links to components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datascry.session import scratch_path

#: Fixed by the task: what separates words in running text, and what words of benchmark comparison are made of.
SPACED_WORD = "[^\\x20\\x09-\\x0D]+"
PLAIN_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: str) -> str:
    """Lower-cases A-Z and leaves every other letter alone: lower() of bytes knows ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read back: later steps do not repeat it, and lost executors lose nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def named(out: DataFrame, id_col: str, kind: str) -> DataFrame:
    """Column _id, carried through Python as text so that null and large ids stay exact, back as `id_col` of type `kind`."""
    return out.select(F.col("_id").cast(kind).alias(id_col), *[c for c in out.columns if c != "_id"])


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """At most `rows` rows in a batch that goes to Python, for this session from now on: ten thousand long texts at once are too much for a worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, text_col: str) -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(a long, b long) links to (id, comp): for every id with a link, the smallest id it reaches.

    Rounds of large-star and small-star steps; every round is written to the shared folder. A node's neighbours are never
    gathered: both steps are a minimum per node and a join, so one node with many links costs one row each. The number of
    rounds follows the logarithm of the longest path. Links are stars, and the work is done, when every node has one link
    and no node linked to has a link of its own; that is read off one grouping.
    """
    edges = written(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b")
                    .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        large = written(large.where("a <> b").distinct(), name)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.greatest("b", "m").alias("x"), F.least("b", "m").alias("m"), "a")
        star = (small.select(F.col("x").alias("a"), F.col("m").alias("b"))
                .unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        edges = written(star, name)
        ends = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty():
            break
    found = edges.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    roots = edges.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("comp"))
    return found.unionByName(roots).groupBy("id").agg(F.min("comp").alias("comp"))
