"""Text queries on documents and their labels."""

from datascry.catalog import query
from datascry.catalog.scalars import BARE, DOWN, UP, polarity_sql
from datascry.functions import words as w
from datascry.operators import text as tx

from pyspark.sql import functions as F

STOP = ["the", "and", "of", "le", "la", "les", "de", "et", "il", "der", "die", "und", "el", "los"]
QUOTED = ", ".join(f"'{x}'" for x in STOP)
TERMS = 50
TOKENS = rf"""(select doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda x: x not in ({QUOTED}))) as term from documents)"""
WEIGHTS = f"""(with tok as (select * from {TOKENS}), vocab as (select term, count(*) as n, count(distinct doc_id) as df from tok group by 1 order by n desc, term limit {TERMS}),
  tf as (select doc_id, term, count(*) as tf from tok join vocab using (term) group by 1, 2),
  raw as (select doc_id, term, tf * (ln((1 + (select count(*) from documents))::double / (1 + df)) + 1) as x from tf join vocab using (term))
  select doc_id, term, x / sqrt(sum(x * x) over (partition by doc_id)) as weight from raw)"""


def labelled(t):
    return t.documents.join(t.labels, "doc_id")


@query("pick_text_column", """select 'text' as "column", round(avg(length(text)), 4) as mean_length from documents union all select 'lang', round(avg(length(lang)), 4) from documents
       union all select 'source', round(avg(length(source)), 4) from documents""")
def _(t):
    return tx.text_column_frame(t.documents).withColumn("mean_length", F.round("mean_length", 4))


@query("tfidf", f"select doc_id, term, round(weight, 6) as weight from {WEIGHTS}")
def _(t):
    return tx.tfidf(t.documents, "doc_id", "text", TERMS, STOP).withColumn("weight", F.round("weight", 6))


@query("top_words", f"select term, round(sum(weight), 4) as weight from {WEIGHTS} group by 1 order by 2 desc limit 20")
def _(t):
    return tx.top_words(t.documents, "text", 20, TERMS, STOP).withColumn("weight", F.round("weight", 4))


LABELLED_WEIGHTS = WEIGHTS.replace("from documents)", "from documents join labels using (doc_id))")


@query("class_top_words", f"""select quality, rank, term, round(s, 4) as weight from (select quality, term, sum(weight) as s, row_number() over (partition by quality order by round(sum(weight), 9) desc, term)::int as rank
       from {LABELLED_WEIGHTS} join labels using (doc_id) group by 1, 2) where rank <= 5""")
def _(t):
    return tx.class_top_words(labelled(t), "text", "quality", 5, TERMS, STOP).withColumn("weight", F.round("weight", 4))


def gram_sql(n):
    return rf"""select array_to_string(list_slice(l, i, i + {n - 1}), ' ') as ngram, count(*) as n from (select l, unnest(range(1, len(l) - {n - 2})) as i
      from (select list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda x: x not in ({QUOTED})) as l from documents) where len(l) >= {n}) group by 1 order by 2 desc, 1 limit 10"""


@query("ngrams", f"(select 2 as size, * from ({gram_sql(2)})) union all (select 3, * from ({gram_sql(3)}))")
def _(t):
    two = tx.ngrams(t.documents, "text", 2, 10, STOP).select(F.lit(2).alias("size"), "ngram", "n")
    return two.unionByName(tx.ngrams(t.documents, "text", 3, 10, STOP).select(F.lit(3).alias("size"), "ngram", "n"))


WORDS = r"(select doc_id, len(regexp_extract_all(text, '\S+')) as words from documents)"


@query("word_count_hist", f"""with e as (select min(words)::double as lo, (max(words) - min(words)) / 10.0::double as w from {WORDS}), b as (select least(floor((words - lo) / w), 9)::int as bin, count(*) as n from {WORDS}, e group by 1)
       select s.bin, trunc(lo + s.bin * w)::bigint || '-' || trunc(lo + s.bin * w + w)::bigint as x_val, coalesce(b.n, 0) as n from (select unnest(range(10))::int as bin) s cross join e left join b on b.bin = s.bin""")
def _(t):
    return tx.word_count_hist(t.documents, "text")


POLARITY = f"(select doc_id, {polarity_sql()} as p from (select doc_id, {BARE} as b from documents))"
LISTS = {"positive": UP, "negative": DOWN}


@query("sentiment_bands", f"""select t.tone, count(p.p) as n from (values ('Positive'), ('Neutral'), ('Negative')) t(tone) left join {POLARITY} p on t.tone = case when p > 0.1 then 'Positive' when p < -0.1 then 'Negative' else 'Neutral' end group by 1""")
def _(t):
    return tx.sentiment_bands(t.documents, "text", **LISTS)


@query("polarity_by_class", f"""select quality, round(avg(p), 6) as polarity from {POLARITY} join labels using (doc_id) group by 1""")
def _(t):
    return tx.polarity_by_class(labelled(t), "text", "quality", **LISTS).withColumn("polarity", F.round("polarity", 6))


@query("words_by_class", f"""select quality, round(avg(words), 6) as words from {WORDS} join labels using (doc_id) group by 1""")
def _(t):
    return tx.words_by_class(labelled(t), "text", "quality").withColumn("words", F.round("words", 6))


@query("words_by_role", r"""select role, round(avg(len(regexp_extract_all(text, '\S+'))), 6) as words from conversations group by 1""")
def _(t):
    return tx.words_by_class(t.conversations, "text", "role").withColumn("words", F.round("words", 6))


@query("words_by_tag", r"""select tag, round(avg(words), 6) as words from (select len(regexp_extract_all(text, '\S+')) as words, unnest([lang, source]) as tag from documents) group by 1""")
def _(t):
    rows = t.documents.select("text", F.array("lang", "source").alias("tag"))
    return tx.words_by_class(rows, "text", "tag").withColumn("words", F.round("words", 6))


@query("word_box_by_class", f"""with r as (select lang, words::double as x from {WORDS} join documents using (doc_id)), q as (select lang, quantile_cont(x, 0.25) as q1, quantile_cont(x, 0.5) as median, quantile_cont(x, 0.75) as q3 from r group by 1)
       select lang, count(*) as n, round(any_value(q1), 4) as q1, round(any_value(median), 4) as median, round(any_value(q3), 4) as q3,
       min(case when x between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) then x end) as whisker_low, max(case when x between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) then x end) as whisker_high,
       count(case when not (x between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) then 1 end) as outliers from r join q using (lang) group by 1 having count(*) >= 5""")
def _(t):
    box = tx.word_box_by_class(t.documents, "text", "lang")
    return box.select("lang", "n", F.round("q1", 4).alias("q1"), F.round("median", 4).alias("median"), F.round("q3", 4).alias("q3"), "whisker_low", "whisker_high", "outliers")


@query("svd_projection")
def _(t):
    out = tx.svd_projection(t.documents, ["doc_id"], "text", 2, TERMS, STOP)
    return out.select("doc_id", F.round("x1", 6).alias("x1"), F.round("x2", 6).alias("x2"))


def text_rows(t, label="quality"):
    """Labelled documents with non-negative term vectors, and the fitted vocabulary."""
    rows = labelled(t)
    model = tx.Tfidf.fit(rows, "text", TERMS, STOP)
    return model, model.vectors(rows, "text").select("doc_id", "features", F.col(label).cast("double").alias("label"))


@query("informative_terms")
def _(t):
    from datascry.operators.models import train_logistic

    model, rows = text_rows(t)
    return tx.informative_terms(train_logistic(rows, 2), model.vocabulary, t.spark)


@query("train_text_models")
def _(t):
    from datascry.operators import models as m
    from datascry.operators.sampling import split_train_test

    rows = split_train_test(text_rows(t)[1], "doc_id")
    fitted = m.train_text_models(rows.filter("split = 'train'"), 2)
    return m.leaderboard(fitted, rows.filter("split = 'test'"), "classification")


@query("train_multilabel")
def _(t):
    from datascry.operators import models as m
    from datascry.operators.sampling import split_train_test

    both = labelled(t)
    tags = F.filter(F.array(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic"), F.col("lang")), lambda x: x.isNotNull())
    vectors = tx.Tfidf.fit(both, "text", TERMS, STOP).vectors(both, "text").select("doc_id", "features", tags.alias("tags"))
    rows = split_train_test(vectors, "doc_id")
    known = [r["t"] for r in rows.select(F.explode("tags").alias("t")).distinct().orderBy("t").collect()]
    models = m.train_multilabel(rows.filter("split = 'train'"), "tags", known)
    return m.subset_accuracy(m.predict_multilabel(models, rows.filter("split = 'test'")), "tags", known)
