"""From raw documents to token ids: quality, recurring lines, near duplicates, benchmark passages, encoding."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datascry.llm.base import written


#: The columns of documents that a stage knows by name.
KNOWN = ("doc_id", "text", "lang", "source", "n_chars")


def with_other_columns(stage: Callable) -> Callable:
    """The stage with all other columns carried under names of their own, so that none clashes with a column that the stage makes."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        aside = {c: f"carried_{k}" for k, c in enumerate(docs.columns) if c not in KNOWN}
        kept = stage(spark, docs.select(*[F.col(f"`{c}`").alias(aside.get(c, c)) for c in docs.columns]), sf_dir)
        return kept.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])

    return run_stage


@with_other_columns
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose letters the model of their language finds neither too odd nor too repetitive and whose words are not toxic; the others go.

    Empty and null texts stay, texts are judged whole, repeated rows alike, an empty table stays empty."""
    from datascry.llm.ngram_quality import quality
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "text", "lang"))
    judged = quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=carry, keep_text=True)
    return judged.where("kept").select(*docs.columns)


@with_other_columns
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines whose template recurs, but for its first place; a document goes when nothing but blanks is left of it.

    Null, empty and blank texts stay as they are; repeated rows lose the same lines; the first place by (id, line) wins every tie."""
    from datascry.llm.line_templates import drop_recurring_lines
    cleaned = drop_recurring_lines(docs)
    cleaned = cleaned.where("_dropped = 0 or trim(translate(text, '\\t\\n\\r\\f', '    ')) <> ''")
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cleaned.select(*docs.columns)


@with_other_columns
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id; texts without words stay, and null texts.

    Of rows with equal id and text one stays when they stand for their group. Long texts are compared whole."""
    from datascry.llm.signature_trees import jaccard_components
    found = written(jaccard_components(docs).where("n_shingles > 0"), "near-duplicates")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_i"), F.col("_th").alias("_t")).distinct()
    same = (F.col("doc_id") == F.col("_i")) & (F.xxhash64("text") == F.col("_t"))
    kept = docs.join(gone, same, "leftanti")
    repeated = found.where("doc_id = component_id").groupBy("doc_id", "_th").count().where("count > 1")
    if repeated.isEmpty():
        return kept
    again = repeated.select(F.col("doc_id").alias("_i"), F.col("_th").alias("_t"))
    return kept.join(again, same, "leftanti").unionByName(kept.join(again, same, "leftsemi").dropDuplicates(["doc_id", "text"]))


@with_other_columns
def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty stands in a benchmark window; the others go whole, with their repeated rows.

    Null and empty texts have no words and stay; an empty benchmark keeps everything."""
    from datascry.llm.decontaminate import contamination
    keyed = docs.select(F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64("text").cast("string")).alias("key"), "text")
    found = contamination(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key").where("contaminated").select("key").distinct()
    found = written(found, "contaminated")
    return docs.join(found, F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64("text").cast("string")) == F.col("key"), "leftanti")


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of the ids and of what they decode to."""
    import public_tokenizers

    from datascry.llm.catalog import tokenizer_file
    from datascry.llm.ranked_bpe import encoding_digests
    return encoding_digests(docs, tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("near_duplicates", near_duplicate_stage), ("decontaminate", benchmark_stage), ("encode", encode_stage)]

#: No stage's model or tree can be said in SQL; the tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
