"""Corpus operators. A document's tokens stay in its row; only term counts and bounded vectors are shuffled."""

from __future__ import annotations

import math

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datascry.functions.scalars import string_columns
from datascry.functions.words import sentiment_band, sentiment_polarity, split_words, tokenize
from datascry.operators.profile import boxplot_stats, histogram, long_rows
from datascry.session import stored

# Buckets that runs of tokens are counted by first, fullest ones that are looked into, and most that are told apart by a list.
GRAM_BUCKETS, FULL_BUCKETS, MOST_BUCKETS = 1 << 17, 500, 10_000


def text_column_frame(df: DataFrame, t: str | None = None) -> DataFrame:
    """Mean length per text column, the longest first: (column, mean_length)."""
    cols = [c for c in string_columns(df) if c != t]
    lengths = long_rows(df, [], [F.struct(F.lit(c).alias("column"), F.coalesce(F.avg(F.length(c)), F.lit(0.0)).alias("mean_length")) for c in cols])
    return lengths.orderBy(F.desc("mean_length"), "column")


def pick_text_column(df: DataFrame, t: str | None = None) -> str:
    return text_column_frame(df, t).first()["column"]


class Tfidf:
    """Vocabulary of the most frequent terms and their weights ln((1 + n) / (1 + df)) + 1; rows have length 1.

    Fitting needs two bounded results: the vocabulary, and one vector of document counts. Applying is narrow.
    """

    def __init__(self, vocabulary: list[str], weights: list[float], stop: list[str] | None):
        self.vocabulary, self.weights, self.stop = vocabulary, weights, stop

    @staticmethod
    def fit(df: DataFrame, text: str, max_features: int = 200, stop: list[str] | None = None) -> Tfidf:
        tokens = df.select(tokenize(text, stop).alias("__tokens"))
        counts = tokens.select(F.explode("__tokens").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
        vocabulary = [r["term"] for r in counts.orderBy(F.desc("n"), "term").limit(max_features).collect()]
        if not vocabulary:
            raise ValueError("the corpus has no terms")
        model = Tfidf(vocabulary, [], stop)
        seen = model._counts(tokens).agg(Summarizer.metrics("numNonZeros", "count").summary(F.col("__counts")).alias("s")).first()["s"]
        n = seen["count"]
        model.weights = [math.log((1 + n) / (1 + d)) + 1 for d in seen["numNonZeros"].toArray()]
        return model

    def _counts(self, tokens: DataFrame) -> DataFrame:
        return CountVectorizerModel.from_vocabulary(self.vocabulary, "__tokens", "__counts").transform(tokens)

    def vectors(self, df: DataFrame, text: str, out: str = "features") -> DataFrame:
        """df with the weighted, normalised term vector."""
        counted = self._counts(df.withColumn("__tokens", tokenize(text, self.stop)))
        scaled = ElementwiseProduct(scalingVec=Vectors.dense(self.weights), inputCol="__counts", outputCol="__scaled").transform(counted)
        return Normalizer(p=2.0, inputCol="__scaled", outputCol=out).transform(scaled).drop("__tokens", "__counts", "__scaled")

    def weights_table(self, df: DataFrame, keep: list[str], text: str) -> DataFrame:
        """(keep..., term, weight) of the terms present."""
        vectors = self.vectors(df.select(*dict.fromkeys([*keep, text])), text, "__v")
        long = vectors.select(*keep, F.posexplode(vector_to_array("__v")).alias("at", "weight")).filter("weight > 0")
        return long.select(*keep, F.element_at(F.lit(self.vocabulary), F.col("at") + 1).alias("term"), "weight")

    def sums(self, df: DataFrame, text: str, by: list[str] | None = None) -> DataFrame:
        """Summed weight per term (and group) from one bounded vector per group: (by..., term, weight)."""
        by = list(by or [])
        vectors = self.vectors(df.select(*dict.fromkeys([*by, text])), text, "__v")
        total = Summarizer.sum(F.col("__v")).alias("__s")
        wide = vectors.groupBy(*by).agg(total) if by else vectors.agg(total)
        long = wide.select(*by, F.posexplode(vector_to_array("__s")).alias("at", "weight"))
        return long.select(*by, F.element_at(F.lit(self.vocabulary), F.col("at") + 1).alias("term"), "weight")


def tfidf(df: DataFrame, id: str, text: str, max_features: int = 200, stop: list[str] | None = None) -> DataFrame:
    return Tfidf.fit(df, text, max_features, stop).weights_table(df, [id], text)


def top_words(df: DataFrame, text: str, k: int = 20, max_features: int = 200, stop: list[str] | None = None) -> DataFrame:
    """Terms of the greatest summed weight."""
    return Tfidf.fit(df, text, max_features, stop).sums(df, text).orderBy(F.desc("weight"), "term").limit(k)


def class_top_words(df: DataFrame, text: str, label: str, k: int = 5, max_features: int = 200, stop: list[str] | None = None) -> DataFrame:
    """The k terms of the greatest summed weight per class: (label, rank, term, weight)."""
    rows = _by_class(df, label)
    sums = Tfidf.fit(rows, text, max_features, stop).sums(rows, text, [label]).filter("weight > 0")
    # A class has at most max_features terms here.
    w = Window.partitionBy(label).orderBy(F.desc(F.round("weight", 9)), "term")
    return sums.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(label, "rank", "term", "weight")


def ngrams(df: DataFrame, text: str, n: int = 2, k: int = 10, stop: list[str] | None = None) -> DataFrame:
    """Most frequent runs of n tokens after stop words are removed: (ngram, n).

    Runs are counted by GRAM_BUCKETS hashes first, few enough to stay inside the tasks; a run is no more frequent than its
    bucket. The runs of the fullest buckets are counted as text. Where another bucket holds as many as the k-th of them, all
    buckets that hold so many are counted the same way, so the result is exact and rare runs are not shuffled.
    """
    tokens = df.select(tokenize(text, stop).alias("__t")).filter(F.size("__t") >= n)
    places = F.sequence(F.lit(0), F.size("__t") - n)
    run = lambda i: [F.get("__t", i + j) for j in range(n)]
    bucket = lambda i: F.pmod(F.xxhash64(*run(i)), F.lit(GRAM_BUCKETS)).cast("int")
    sizes = stored(tokens.select(F.explode(F.transform(places, bucket)).alias("b")).groupBy("b").agg(F.count("*").alias("n")), "gram-buckets")

    def counted(buckets: list[int] | None) -> list:
        among = places if buckets is None else F.filter(places, lambda i: bucket(i).isin(buckets))
        found = tokens.select(F.explode(F.transform(among, lambda i: F.concat_ws(" ", *run(i)))).alias("ngram"))
        return found.groupBy("ngram").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ngram").limit(k).collect()

    full = sizes.orderBy(F.desc("n"), "b").limit(FULL_BUCKETS + 1).collect()
    found = counted([r["b"] for r in full[:FULL_BUCKETS]])
    if len(full) > FULL_BUCKETS:
        least = found[-1]["n"] if len(found) == k else 1
        if full[-1]["n"] >= least:
            wider = [r["b"] for r in sizes.filter(F.col("n") >= least).select("b").limit(MOST_BUCKETS + 1).collect()]
            found = counted(wider if len(wider) <= MOST_BUCKETS else None)
    return df.sparkSession.createDataFrame([(r["ngram"], r["n"]) for r in found], "ngram string, n long")


def word_count_hist(df: DataFrame, text: str, bins: int = 10) -> DataFrame:
    """Word counts in at most 10 bins, labelled 'low-high': (bin, x_val, n)."""
    counts = df.select(F.size(split_words(text)).alias("words"))
    kinds = counts.agg(F.approx_count_distinct("words")).first()[0]
    if kinds <= 2 * bins:
        kinds = counts.select("words").distinct().count()
    h = histogram(counts, "words", min(bins, max(2, kinds)))
    edge = lambda c: F.col(c).cast("long").cast("string")
    return h.select("bin", F.concat(edge("low"), F.lit("-"), edge("high")).alias("x_val"), "n")


def sentiment_bands(df: DataFrame, text: str, **words) -> DataFrame:
    """Documents per tone: Positive, Neutral and Negative, zero counts kept."""
    tones = df.select(sentiment_band(sentiment_polarity(text, **words)).alias("tone"))
    counts = tones.agg(*[F.count(F.when(F.col("tone") == t, 1)).alias(t) for t in ("Positive", "Neutral", "Negative")])
    return counts.unpivot([], ["Positive", "Neutral", "Negative"], "tone", "n")


def _by_class(df: DataFrame, label: str) -> DataFrame:
    """One row per class of a row; a tag array counts for each tag."""
    if df.schema[label].dataType.typeName() == "array":
        return df.withColumn(label, F.explode(label))
    return df.filter(F.col(label).isNotNull())


def polarity_by_class(df: DataFrame, text: str, label: str, **words) -> DataFrame:
    rows = df.select(label, sentiment_polarity(text, **words).alias("polarity"))
    return _by_class(rows, label).groupBy(label).agg(F.avg("polarity").alias("polarity"))


def words_by_class(df: DataFrame, text: str, label: str) -> DataFrame:
    rows = df.select(label, F.size(split_words(text)).alias("words"))
    return _by_class(rows, label).groupBy(label).agg(F.avg("words").alias("words"))


def word_box_by_class(df: DataFrame, text: str, label: str, exact: bool = True) -> DataFrame:
    rows = _by_class(df.select(label, F.size(split_words(text)).alias("words")), label)
    return boxplot_stats(rows, ["words"], by=[label], top=None, exact=exact)


def svd_projection(df: DataFrame, keep: list[str], text: str, k: int = 2, max_features: int = 200, stop: list[str] | None = None) -> DataFrame:
    """Every document on the k strongest singular directions of its term vectors: (keep..., x1..xk).

    Only the terms-by-terms product matrix is aggregated. Each direction's largest entry is made positive.
    """
    model = Tfidf.fit(df, text, max_features, stop)
    vectors = model.vectors(df.select(*dict.fromkeys([*keep, text])), text, "__v")
    rows = MLUtils.convertVectorColumnsFromML(vectors.select("__v"), "__v")
    directions = RowMatrix(rows).computeSVD(min(k, len(model.vocabulary))).V.toArray()
    dense = vector_to_array("__v")
    out = {}
    for i in range(directions.shape[1]):
        d = directions[:, i]
        d = d if d[abs(d).argmax()] > 0 else -d
        out[f"x{i + 1}"] = F.aggregate(F.zip_with(dense, F.lit(d.tolist()), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return vectors.select(*keep, *[c.alias(n) for n, c in out.items()])


def informative_terms(model, vocabulary: list[str], spark, k: int = 15) -> DataFrame:
    """The k terms of the largest |coefficient| in a linear classifier's first row: (term, weight)."""
    if hasattr(model, "models"):
        weights = model.models[0].coefficients.toArray()
    elif hasattr(model, "coefficientMatrix"):
        weights = model.coefficientMatrix.toArray()[0]
    else:
        weights = model.coefficients.toArray()
    rows = sorted(((t, float(w)) for t, w in zip(vocabulary, weights)), key=lambda r: (-abs(r[1]), r[0]))[:k]
    return spark.createDataFrame(rows, "term string, weight double")
