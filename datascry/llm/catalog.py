"""Queries of this folder's operators over their whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datascry.llm.base import written
from datascry.session import scratch_path

#: Fixed by the task.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def tokenizer_file(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datascry.llm.token_files import read_token_files, write_token_files
    out = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), out, tokenizer_file("byte_bpe_50k.json"), end_id=2)
    return read_token_files(spark, out, digest=True).withColumnRenamed("id", "doc_id")


def op2_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datascry.llm.class_lm import score_class_lm
    return score_class_lm(table(spark, sf_dir, "documents"))


def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datascry.llm.line_templates import drop_recurring_lines
    out = drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), F.sha2(F.col("text"), 256).alias("text_sha256"))


def op4_ngram_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datascry.llm.ngram_quality import quality
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datascry.llm.decontaminate import contamination
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op6_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datascry.llm.private_spans import private_spans
    return private_spans(table(spark, sf_dir, "documents"))


def op7_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datascry.llm.nn_descent import near_vectors
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datascry.llm.url_rules import judge_urls
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


OP8_SQL = """
with parts as (
  select page_id,
    case when instr(url, '://') > 0 then translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
    case when instr(url, '://') > 0 then regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path
  from pages),
rules(verdict, r_host, r_path) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits as (
  select page_id, host, path, r_host || r_path as rule, verdict,
    row_number() over (partition by page_id, host, path order by length(r_host || r_path) desc) as n
  from parts join rules on (host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path))
select p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') as verdict
from parts p left join (select * from fits where n = 1) f on p.page_id = f.page_id
"""


def op9_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datascry.llm.signature_trees import jaccard_components
    return jaccard_components(table(spark, sf_dir, "documents")).drop("_th")


def op10_ranked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from datascry.llm.ranked_bpe import encoding_digests
    return encoding_digests(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datascry.llm.hard_negatives import hard_negatives
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


OP11_SQL = """
with good as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as x
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, r.vec_id, a.label = r.label as same,
    cast(list_sum(list_transform(generate_series(1, len(a.x)), lambda i: a.x[i] * r.x[i])) as bigint) as score
  from good a join good r on a.vec_id % 100 = 0 and a.vec_id <> r.vec_id),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, p.positive_id, cast(row_number() over w as integer) as rank, n.vec_id as negative_id, p.positive_score, n.score as negative_score
from positives p join scored n on n.anchor_id = p.anchor_id and not n.same
  and 80 * p.positive_score <= 100 * n.score and n.score <= p.positive_score
window w as (partition by p.anchor_id, p.positive_id order by n.score desc, n.vec_id)
qualify row_number() over w <= 5
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datascry.llm.whitening import whiten
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datascry.llm.reply_trees import format_trees, linear_trees, loss_text, parse_turns
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit("\\### Assistant: </turn> ok").alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    out = written(format_trees(linear_trees(turns)), "chats")
    read = out.select("conv_id", parse_turns(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss")).alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
                       F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")


OP13_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, i, case when i = 0 then 'user' else 'assistant' end, '\### Assistant: </turn> ok' from range(2) t(i)),
sized as (
  select *, 15 + length(role) + len(regexp_extract_all(role, '[\\#<:\n]')) + length(text) + len(regexp_extract_all(text, '[\\#<]')) as size from turns)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(size) as bigint) as formatted_chars
from sized group by conv_id
"""


def listed() -> dict:
    """Every query of this module by its name."""
    return {name: fn for name, fn in globals().items() if name.startswith("op") and callable(fn)}


QUERIES = listed()
ORACLE = {"op8_url_rules": OP8_SQL, "op11_hard_negatives": OP11_SQL, "op13_reply_trees": OP13_SQL}
