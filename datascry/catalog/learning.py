"""Training, comparison, explanation and scoring. Curves and metrics use a fixed score, so SQL can follow."""

from datascry.catalog import query
from datascry.operators import cleaning as cl
from datascry.operators import evaluate as ev
from datascry.operators import models as m
from datascry.operators import profile as p
from datascry.operators.sampling import split_train_test
from datascry.session import scratch_path, stored

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F


def union(parts):
    return "\nunion all ".join(parts)


@query("resolve_task", union([f"""select '{c}' as target, case when {rule} then 'classification' else 'regression' end as task, n as classes from
       (select count(distinct {c}) as n, min({c}) as lo, max({c}) as hi from {tab})""" for tab, c, rule in (
    ("lineitem", "l_linenumber", "n <= 10 and hi - lo + 1 = n and lo in (0, 1)"), ("lineitem", "l_extendedprice", "n <= 10"),
    ("orders", "o_orderstatus", "true"), ("labels", "quality", "n <= 10 and hi - lo + 1 = n and lo in (0, 1)"), ("part", "p_size", "n <= 10 and hi - lo + 1 = n and lo in (0, 1)"))]))
def _(t):
    out = None
    for df, c, categorical in ((t.lineitem, "l_linenumber", False), (t.lineitem, "l_extendedprice", False), (t.orders, "o_orderstatus", True),
                               (t.labels, "quality", False), (t.part, "p_size", False)):
        one = m.task_frame(df, c, categorical).select(F.lit(c).alias("target"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query("resolve_target", """select * from (values ('part', 'p_partkey'), ('embeddings', 'label'), ('lineitem', 'l_quantity')) v(name, target)
       union all select 'documents', case when avg(length(text)) > 60 and avg(len(regexp_extract_all(text, '\\s+'))) + 1 > 4 then 'lang' else 'text' end from documents""")
def _(t):
    part = m.target_frame(t.part.select("p_partkey", "p_size", "p_type")).select(F.lit("part").alias("name"), "target")
    emb = m.target_frame(t.embeddings).select(F.lit("embeddings").alias("name"), "target")
    line = m.target_frame(t.lineitem.select("l_tax", "l_discount", "l_quantity")).select(F.lit("lineitem").alias("name"), "target")
    doc = m.target_frame(t.documents.select("n_chars", "lang", "text")).select(F.lit("documents").alias("name"), "target")
    return part.unionByName(emb).unionByName(line).unionByName(doc)


def documents(t):
    """Labelled documents with numbers, categories and prose."""
    return t.documents.join(t.labels, "doc_id").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("double").alias("n_chars"), "toxic", "quality")


def orders(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority", "c_acctbal", "c_mktsegment", F.col("c_nationkey").cast("double").alias("nation"))


@query("featurize")
def _(t):
    rows = documents(t)
    plan = m.plan_features(rows, p.profile(rows), "quality", [{"column": "source", "actionType": "target_encode"}])
    ready = m.with_label(m.prepare(rows, plan), plan)
    out = m.featurize(plan).fit(ready).transform(ready)
    from pyspark.ml.functions import vector_to_array

    values = vector_to_array("features")
    return out.select("doc_id", "label", F.size(values).alias("width"), F.exists(values, lambda x: x.isNull() | F.isnan(x)).alias("holes"))


LINE_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def line_rows(t):
    """Order lines with a price that follows quantity, split by hash."""
    price = F.col("l_quantity") * 100 - F.col("l_discount") * 5000 + F.col("l_extendedprice") / 100
    rows = t.lineitem.select("l_orderkey", *[F.col(c).cast("double").alias(c) for c in LINE_FEATURES], price.alias("label"),
                             (F.col("l_quantity") + F.col("l_extendedprice") / 5000 > 35).cast("double").alias("big"))
    return split_train_test(VectorAssembler(inputCols=LINE_FEATURES, outputCol="features").transform(rows), "l_orderkey")


def parts(rows):
    return rows.filter("split = 'train'"), rows.filter("split = 'test'")


def class_parts(t):
    return parts(line_rows(t).drop("label").withColumnRenamed("big", "label"))


@query("train_logistic")
def _(t):
    fit, test = class_parts(t)
    return m.leaderboard({"logistic": m.train_logistic(fit, 2)}, test, "classification")


@query("train_linear", """select round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept from lineitem""")
def _(t):
    rows = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(t.lineitem.select("l_quantity", F.col("l_extendedprice").alias("label")))
    model = m.train_linear(rows)
    return rows.limit(1).select(F.round(F.lit(float(model.coefficients[0])), 4).alias("slope"), F.round(F.lit(float(model.intercept)), 3).alias("intercept"))


@query("train_ridge_lasso")
def _(t):
    fit, test = parts(line_rows(t))
    return m.leaderboard(m.train_ridge_lasso(fit), test, "regression")


@query("train_random_forest")
def _(t):
    fit, test = parts(line_rows(t))
    return m.leaderboard({"random_forest": m.train_random_forest(fit, "regression")}, test, "regression")


@query("train_boosted")
def _(t):
    fit, test = parts(line_rows(t))
    return m.leaderboard({"boosted": m.train_boosted(fit, "regression")}, test, "regression")


@query("train_mlp")
def _(t):
    fit, test = class_parts(t)
    return m.leaderboard({"mlp": m.train_mlp(fit, 2)}, test, "classification")


@query("tune")
def _(t):
    rows = VectorAssembler(inputCols=["s_nationkey", "s_suppkey"], outputCol="features").transform(t.supplier.withColumn("label", F.col("s_acctbal")))
    fit, _test = parts(split_train_test(rows, "s_suppkey"))
    _model, score, best = m.tune(fit.select("features", "label"), "regression")
    return t.spark.createDataFrame([(float(score), int(best["numTrees"]), int(best["maxDepth"]))], "score double, trees int, depth int")


@query("cross_validate")
def _(t):
    rows = documents(t)
    plan = m.plan_features(rows, p.profile(rows), "quality")
    ready = m.with_label(m.prepare(rows, plan), plan)
    from pyspark.ml import Pipeline

    pipeline = Pipeline(stages=[*m.featurize(plan).getStages(), m.classifier("logistic", 2)])
    return m.cross_validate(pipeline, ready, "doc_id", "classification")


@query("leaderboard")
def _(t):
    fit, test = parts(stored(line_rows(t), "lines"))
    models = {f: m.train(f, fit, "regression") for f in ("linear", "ridge", "lasso", "random_forest", "boosted")}
    return m.leaderboard(models, test, "regression")


SPLIT = "(select *, ('0x' || substr(md5(o_orderkey::varchar), 1, 8))::bigint % 1000000 < 800000 as tr from orders)"


@query("dummy_baseline", f"""select o_orderkey, (select o_orderpriority from {SPLIT} where tr group by 1 order by count(*) desc, 1 limit 1) as class_guess,
       round((select avg(o_totalprice) from {SPLIT} where tr), 4) as mean_guess from {SPLIT} where not tr""")
def _(t):
    fit, test = parts(split_train_test(t.orders, "o_orderkey"))
    a = ev.dummy_baseline(fit, test.select("o_orderkey"), "o_orderpriority").withColumnRenamed("prediction", "class_guess")
    return ev.dummy_baseline(fit, a, "o_totalprice", False).select("o_orderkey", "class_guess", F.round("prediction", 4).alias("mean_guess"))


SCORED = """(select l_orderkey, l_linenumber, l_extendedprice as y, l_quantity * 2000 + l_tax * 10000 as p, ('0x' || substr(md5(l_orderkey || '|' || l_linenumber), 1, 8))::bigint % 1000000 as h from lineitem)"""


def scored(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 2000 + F.col("l_tax") * 10000).alias("p"))


REGRESSION = """count(*) as rows, round(1 - sum(power(y - p, 2)) / (var_pop(y) * count(*)), 6) as r2, round(avg(power(y - p, 2)), 2) as mse, round(sqrt(avg(power(y - p, 2))), 4) as rmse, round(avg(abs(y - p)), 4) as mae"""


def tidy(df):
    return df.select(*[F.round(c, d).alias(c) if d else F.col(c) for c, d in (("rows", 0), ("r2", 6), ("mse", 2), ("rmse", 4), ("mae", 4))])


@query("metrics_regression", f"select {REGRESSION} from {SCORED}")
def _(t):
    return tidy(ev.metrics_regression(scored(t), "y", "p"))


GUESSED = "(select o_orderkey, o_orderstatus as y, case when o_totalprice > 300000 then 'O' when o_totalprice > 150000 then 'F' when o_totalprice > 20000 then 'P' else 'X' end as p, case when o_custkey % 10 < 7 then 'train' else 'val' end as split from orders)"


def guessed(t):
    price = F.col("o_totalprice")
    guess = F.when(price > 300000, "O").when(price > 150000, "F").when(price > 20000, "P").otherwise("X")
    return t.orders.select("o_orderkey", F.col("o_orderstatus").alias("y"), guess.alias("p"), F.when(F.col("o_custkey") % 10 < 7, "train").otherwise("val").alias("split"))


def class_sql(rows):
    return f"""(with c as (select k, count(*) filter (y = k) as s, count(*) filter (p = k) as g, count(*) filter (y = k and p = k) as h from {rows}, (select distinct y as k from {rows} union select distinct p from {rows}) group by 1)
      select k, s, g, h, case when g > 0 then h / g else 0 end as pr, case when s > 0 then h / s else 0 end as re, case when h > 0 then 2 * h / (g + s) else 0 end as f1 from c)"""


def classification_sql(rows):
    return f"""select sum(s)::bigint as rows, round(sum(h) / sum(s), 6) as accuracy, round(sum(s * pr) / sum(s), 6) as precision, round(sum(s * re) / sum(s), 6) as recall, round(sum(s * f1) / sum(s), 6) as f1 from {class_sql(rows)}"""


CLASS = ["accuracy", "precision", "recall", "f1"]


@query("metrics_classification", classification_sql(GUESSED))
def _(t):
    return ev.metrics_classification(guessed(t), "y", "p").select("rows", *[F.round(c, 6).alias(c) for c in CLASS])


@query("class_metrics", f"""select k as "class", s::bigint as support, g::bigint as predicted, h::bigint as hits, round(pr, 6)::double as precision, round(re, 6)::double as recall, round(f1, 6)::double as f1 from {class_sql(GUESSED)}""")
def _(t):
    return ev.class_metrics(guessed(t), "y", "p").select("class", "support", "predicted", "hits", *[F.round(c, 6).alias(c) for c in CLASS[1:]])


@query("evaluate_split", classification_sql(f"(select * from {GUESSED} where split = 'val')"))
def _(t):
    return ev.evaluate_split(guessed(t), "y", "p")[0].select("rows", *[F.round(c, 6).alias(c) for c in CLASS])


@query("confusion_matrix", f"select y as actual, p as predicted, count(*) as n from {GUESSED} group by 1, 2")
def _(t):
    return ev.confusion_matrix(guessed(t), "y", "p")


CURVE = """(with s as (select (o_totalprice - 100000) / 1000 as b, case when o_orderstatus = 'F' or o_totalprice > 350000 then 1 else 0 end as y from orders),
  g as (select b, sum(y) as pos, count(*) - sum(y) as neg from s group by 1)
  select b as threshold, row_number() over (order by b desc) as k, count(*) over () as points, sum(pos) over (order by b desc) as tp, sum(neg) over (order by b desc) as fp, sum(pos) over () as ap, sum(neg) over () as an from g)"""
THIN = "where k = 1 or points <= 100 or floor((k - 1) * 99 / (points - 1)) <> floor((k - 2) * 99 / (points - 1))"


def curve_rows(t):
    top = t.orders.agg(F.max("o_totalprice")).scalar()
    label = ((F.col("o_orderstatus") == "F") | (F.col("o_totalprice") > 350000)).cast("int")
    return t.orders.select(F.round(F.col("o_totalprice") / top, 3).alias("score"), ((F.col("o_totalprice") - 100000) / 1000).alias("margin"), label.alias("label"))


@query("roc_curve", f"""with c as (select *, tp / ap as tpr, fp / an as fpr from {CURVE}), a as (select *, (fpr - coalesce(lag(fpr) over (order by k), 0)) * (tpr + coalesce(lag(tpr) over (order by k), 0)) / 2 as area from c),
       z as (select *, sum(area) over () as auc from a) select threshold, round(fpr, 6) as fpr, round(tpr, 6) as tpr, round(auc, 6) as auc from z {THIN}""")
def _(t):
    out = ev.roc_curve(curve_rows(t), "label", "margin")
    return out.select("threshold", *[F.round(c, 6).alias(c) for c in ("fpr", "tpr", "auc")])


@query("pr_curve", f"""with c as (select *, tp / (tp + fp) as pr, tp / ap as re, ap / (ap + an) as baseline from {CURVE}), a as (select *, (re - coalesce(lag(re) over (order by k), 0)) * pr as step from c),
       z as (select *, sum(step) over () as average from a) select threshold, round(pr, 6) as precision, round(re, 6) as recall, round(average, 6) as average_precision, round(baseline, 6) as baseline from z {THIN}""")
def _(t):
    out = ev.pr_curve(curve_rows(t), "label", "margin")
    return out.select("threshold", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "average_precision", "baseline")])


@query("calibration_curve", """with s as (select round(o_totalprice / (select max(o_totalprice) from orders), 3) as s, case when o_orderstatus = 'F' or o_totalprice > 350000 then 1 else 0 end as y from orders)
       select least(floor(s * 10), 9)::int as bin, round(avg(s), 6) as mean_score, round(avg(y), 6) as positive_rate, count(*) as n from s group by 1""")
def _(t):
    out = ev.calibration_curve(curve_rows(t), "label", "score")
    return out.select("bin", F.round("mean_score", 6).alias("mean_score"), F.round("positive_rate", 6).alias("positive_rate"), "n")


@query("pred_vs_actual", f"""select 'class ' || k as kind, s::double as actual, g::double as predicted from {class_sql(GUESSED)} union all select 'point', y, p from {SCORED} where h < round(1000000 * least(1.0, 200.0 / (select count(*) from lineitem)))""")
def _(t):
    classes = ev.pred_vs_actual_classes(guessed(t), "y", "p").select(
        F.concat(F.lit("class "), "class").alias("kind"), F.col("actual").cast("double").alias("actual"), F.col("predicted").cast("double").alias("predicted"))
    points = ev.scatter_sample(scored(t), ["l_orderkey", "l_linenumber"], "y", "p").select(F.lit("point").alias("kind"), "actual", "predicted")
    return classes.unionByName(points)


@query("residuals", f"""select l_orderkey, l_linenumber, round(p, 4) as predicted, round(y - p, 4) as residual from {SCORED} where h < round(1000000 * least(1.0, 300.0 / (select count(*) from lineitem)))""")
def _(t):
    out = ev.residuals(scored(t), ["l_orderkey", "l_linenumber"], "y", "p")
    return out.select("l_orderkey", "l_linenumber", F.round("predicted", 4).alias("predicted"), F.round("residual", 4).alias("residual"))


@query("feature_importance")
def _(t):
    fit, _test = parts(line_rows(t))
    return m.feature_importance(m.train_random_forest(fit, "regression"), LINE_FEATURES, t.spark)


def line_pipeline(t):
    from pyspark.ml import Pipeline

    fit, test = parts(line_rows(t).drop("features"))
    pipeline = Pipeline(stages=[VectorAssembler(inputCols=LINE_FEATURES, outputCol="features"), m.regressor("ridge", 1)])
    return pipeline.fit(fit), test


@query("permutation_importance")
def _(t):
    model, test = line_pipeline(t)
    return m.permutation_importance(model, test, LINE_FEATURES, "regression")


@query("pdp_ice")
def _(t):
    model, test = line_pipeline(t)
    return m.pdp_ice(model, test, "l_quantity", ["l_orderkey", "l_linenumber", "label"])


@query("linear_attribution", union([f"""select '{c}' as feature, {b}::double as coefficient, round(avg(abs({b} * ({c} - (select avg({c}) from lineitem)))), 6) as importance from lineitem"""
                                    for c, b in (("l_quantity", 100.0), ("l_discount", -5000.0), ("l_tax", 0.5))]))
def _(t):
    out = ev.linear_attribution(t.lineitem, ["l_quantity", "l_discount", "l_tax"], [100.0, -5000.0, 0.5])
    return out.withColumn("importance", F.round("importance", 6))


@query("rfe_select")
def _(t):
    from pyspark.ml.functions import array_to_vector

    rows = t.embeddings.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), (F.col("embedding")[3] * 2 + F.col("embedding")[7] * 0.5).cast("double").alias("label"))
    names = [f"e{i}" for i in range(64)]
    kept = m.rfe_select(rows, "regression", names)
    return t.spark.createDataFrame([(n,) for n in kept], "feature string")


def fitted_orders(t):
    """Cleaned, featurised and trained on the training orders; scored rows are the test orders.

    The joined rows are stored once: every step of the fit would join again, and send the customers through the driver each time.
    """
    rows = split_train_test(orders(t).withColumn("c_acctbal", F.when(F.col("o_orderkey") % 11 != 0, F.col("c_acctbal"))), "o_orderkey")
    rows = stored(rows, "orders")
    fit, test = parts(rows)
    fit, test = fit.drop("split"), test.drop("split")
    cleaner = cl.fit_cleaner(fit, [{"column": "c_acctbal", "actionType": "impute_median"}, {"column": "o_totalprice", "actionType": "drop_outliers"},
                                   {"column": "o_totalprice", "actionType": "transform_log"}])
    cleaned = cleaner.transform(fit, training=True)
    plan = m.plan_features(cleaned, p.profile(cleaned), "o_orderpriority")
    ready = m.with_label(m.prepare(cleaned, plan), plan)
    from pyspark.ml import Pipeline

    stages = Pipeline(stages=[*m.featurize(plan).getStages(), m.classifier("logistic", len(plan.classes))]).fit(ready)
    return m.FittedPipeline(cleaner, stages, plan, "logistic"), test.drop("o_orderpriority")


@query("save_load_pipeline")
def _(t):
    fitted, test = fitted_orders(t)
    path = scratch_path(t.spark, "pipeline")
    fitted.save(t.spark, path)
    again = m.FittedPipeline.load(t.spark, path).transform(test)
    both = fitted.transform(test).select("o_orderkey", F.col("o_orderpriority").alias("first")).join(again.select("o_orderkey", F.col("o_orderpriority").alias("second")), "o_orderkey")
    return both.groupBy((F.col("first") == F.col("second")).alias("same")).agg(F.count("*").alias("n"))


@query("score_batch", f"select o_orderkey, true as known from {SPLIT} where not tr")
def _(t):
    fitted, test = fitted_orders(t)
    path = scratch_path(t.spark, "scored")
    m.score_batch(fitted, test, path)
    back = t.spark.read.option("header", True).schema("o_orderkey bigint, o_totalprice double, o_orderstatus string, c_acctbal double, c_mktsegment string, nation double, "
                                                      "o_totalprice_log double, o_orderpriority string").csv(path)
    return back.select("o_orderkey", F.coalesce(F.col("o_orderpriority").rlike("^[1-5]-"), F.lit(False)).alias("known"))


@query("score_records")
def _(t):
    fitted, test = fitted_orders(t)
    records = [r.asDict() for r in test.orderBy("o_orderkey").limit(5).collect()]
    out = m.score_records(t.spark, fitted, records)
    return out.select("o_orderkey", "o_orderpriority", F.size("probabilities").alias("classes"))
