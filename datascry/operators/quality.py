"""Quality rules over the profile table: recommendations, checklists, leakage, snapshots, chart points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datascry.functions.scalars import epoch_seconds, numeric_columns
from datascry.operators.keys import attach
from datascry.operators.ordered import Sequence
from datascry.operators.profile import long_rows, outlier_share, top_categories, typed_facts

# Advice per kind of finding.
ADVICE = {
    "drop_nulls": "Drop this column as it contains mostly nulls.",
    "impute": "Impute missing values using median (numeric) or mode (categorical).",
    "many": "Group rare categories or drop if not highly predictive.",
    "constant": "Drop this column as it has zero variance.",
    "near_constant": "Consider dropping this column.",
    "outliers": "Apply outlier capping/clipping or log transformation.",
}

# Candidate actions per issue, in order of preference.
ACTIONS = {
    ("missing", "High", True): ["drop", "impute_median", "impute_mean", "impute_knn", "impute_mice"],
    ("missing", "High", False): ["drop", "impute_mode"],
    ("missing", "Low", True): ["impute_median", "impute_mean", "impute_knn", "impute_mice", "drop"],
    ("missing", "Low", False): ["impute_mode", "drop"],
    ("outlier", None, None): ["clip_outliers", "drop_outliers", "isolation_forest"],
}


def _finding(when, issue, advice: str, impact: str):
    return F.when(when, F.struct(issue.alias("issue"), F.lit(ADVICE[advice]).alias("recommendation"), F.lit(impact).alias("impact")))


def cleaning_recommendations(df: DataFrame, t: str | None = None, overrides: dict[str, str] | None = None, exact: bool = True) -> DataFrame:
    """(column, issue, recommendation, impact) from the column facts and one outlier pass."""
    facts = typed_facts(df, overrides, exact)
    numeric = numeric_columns(df)
    if numeric:
        facts = attach(facts, outlier_share(df, numeric, exact).select("column", F.col("share").alias("outlier_share")), ["column"])
    else:
        facts = facts.withColumn("outlier_share", F.lit(None).cast("double"))
    binary = top_categories(df, numeric, 1).select("column", F.col("n").alias("top_n")) if numeric else None
    facts = attach(facts, binary, ["column"]) if binary is not None else facts.withColumn("top_n", F.lit(None).cast("long"))
    missing = (F.col("rows") - F.col("non_null")) / F.col("rows")
    share = F.col("top_n") / F.col("non_null")
    feature = F.col("column") != F.lit(t or "")
    pct = lambda c: F.format_string("%.1f", c * 100)
    number = F.col("type") == "numeric"
    found = F.array(
        _finding(missing >= 0.5, F.concat(pct(missing), F.lit("% missing values")), "drop_nulls", "High"),
        _finding((missing > 0) & (missing < 0.5), F.concat(pct(missing), F.lit("% missing values")), "impute", "Low"),
        _finding(feature & F.col("type").isin("categorical", "text") & (F.col("nunique") > 100),
                 F.concat(F.lit("High cardinality categorical column ("), F.col("nunique"), F.lit(" unique categories)")), "many", "Medium"),
        _finding(feature & (F.col("nunique") == 1), F.lit("Constant value column (only 1 unique value)"), "constant", "Medium"),
        _finding(feature & (F.col("nunique") == 2) & number & (share > 0.99),
                 F.concat(F.lit("Near-constant column ("), pct(share), F.lit("% identical values)")), "near_constant", "Low"),
        _finding(feature & number & (F.col("outlier_share") > 0.05),
                 F.concat(F.lit("Outliers detected ("), pct(F.col("outlier_share")), F.lit("% of values outside whiskers)")), "outliers", "Medium"),
    )
    return facts.select("column", F.inline(F.filter(found, lambda x: x.isNotNull())))


def recommendation_actions(recommendations: DataFrame, types: DataFrame) -> DataFrame:
    """Candidate cleaning actions of each recommendation: (column, issue, rank, action)."""
    rows = attach(recommendations, types.select("column", "type"), ["column"])
    issue, number = F.lower("issue"), F.col("type") == "numeric"
    options = F.lit(["drop"])
    rule = F.when(issue.contains("outlier"), F.lit(ACTIONS[("outlier", None, None)]))
    missing = issue.contains("missing") | issue.contains("null")
    for impact in ("High", "Low"):
        level = (F.col("impact") == "High") if impact == "High" else (F.col("impact") != "High")
        for is_number in (True, False):
            rule = F.when(missing & level & (number == is_number), F.lit(ACTIONS[("missing", impact, is_number)])).otherwise(rule)
    chosen = rows.select("column", "issue", F.posexplode(F.coalesce(rule, options)).alias("rank", "action"))
    return chosen.withColumn("rank", F.col("rank") + 1)


def leakage_warnings(df: DataFrame, t: str, limit: float = 0.98) -> DataFrame:
    """Columns named after the target or almost perfectly correlated with it: (column, reason, value)."""
    numeric = numeric_columns(df)
    facts = []
    for c in df.columns:
        if c == t:
            continue
        named = t.lower() in c.lower() and not c.lower().startswith(("is_", "has_"))
        r = F.corr(F.col(c).cast("double"), F.col(t).cast("double")) if c in numeric and t in numeric else F.lit(None).cast("double")
        facts.append(F.struct(F.lit(c).alias("column"), F.lit(named).alias("named"), r.alias("r")))
    table = long_rows(df, [], facts)
    by_name = F.when(F.col("named"), F.struct(F.lit("name").alias("reason"), F.lit(None).cast("double").alias("value")))
    by_corr = F.when(F.abs("r") >= limit, F.struct(F.lit("correlation").alias("reason"), F.col("r").alias("value")))
    return table.select("column", F.inline(F.filter(F.array(by_name, by_corr), lambda x: x.isNotNull())))


def dataset_snapshot(df: DataFrame, exact: bool = True) -> DataFrame:
    """One line per column: type, share of non-null values, extremes, mean or most frequent value, distinct values."""
    facts = typed_facts(df, exact=exact)
    tops = top_categories(df, df.columns, 1).select("column", F.col("value").alias("top"))
    rows = attach(facts, tops, ["column"])
    number = F.col("family").isin("integer", "number")
    shown = lambda c: F.when(number, F.col(c))
    return rows.select(
        "column", "family", F.round(100 * F.col("non_null") / F.col("rows"), 1).alias("non_null_pct"),
        shown("min").alias("min"), shown("max").alias("max"), shown("mean").alias("mean"),
        F.when(F.col("family") == "time", F.substring("first_time", 1, 10)).alias("first_day"),
        F.when(F.col("family") == "time", F.substring("last_time", 1, 10)).alias("last_day"),
        F.when(~number & (F.col("family") != "time"), F.substring("top", 1, 40)).alias("top"), "nunique")


def quality_checklist(df: DataFrame, t: str | None = None, exclude: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Findings per feature column: (column, severity, title, share, actions)."""
    skipped = [t, *(exclude or [])]
    facts = typed_facts(df, exact=exact)
    blanks = long_rows(df, [], [F.struct(F.lit(f.name).alias("column"), F.count(F.when(
        F.col(f.name).isNull() | (F.trim(F.col(f.name)) == "" if f.dataType.simpleString() == "string" else F.lit(False)), 1)).alias("blank"))
        for f in df.schema.fields])
    rows = attach(facts, blanks, ["column"]).filter(~F.col("column").isin([c for c in skipped if c]))
    pct = F.floor(100 * F.col("blank") / F.col("rows")).cast("int")
    name = F.lower("column")
    item = lambda when, severity, title, share, actions: F.when(when, F.struct(
        severity.alias("severity"), F.lit(title).alias("title"), share.alias("share"), actions.alias("actions")))
    fill = F.when(F.col("type") == "numeric", F.lit("impute_median,exclude")).otherwise(F.lit("impute_mode,exclude"))
    none = F.lit(None).cast("int")
    id_name = name.isin("id", "row", "index") | name.endswith("_id")
    found = F.array(
        item(F.col("blank") > 0, F.when(pct > 40, "critical").otherwise("warning"), "Missing values detected", pct, fill),
        item((F.col("nunique") == 1) & (F.col("non_null") > 1), F.lit("critical"), "Constant column", none, F.lit("exclude")),
        item((F.col("type") == "identifier") | id_name, F.lit("info"), "Potential identifier column", none, F.lit("exclude")))
    return rows.select("column", F.inline(F.filter(found, lambda x: x.isNotNull())))


def point_summary(points: DataFrame, by_series: bool = False) -> DataFrame:
    """Range, mean and median of y (and range of x) per chart, or per chart and series."""
    keys = ["chart", "series"] if by_series else ["chart"]
    from datascry.operators.quantiles import quantiles

    base = points.groupBy(*keys).agg(
        F.count("*").alias("points"), F.min("y").alias("min_y"), F.max("y").alias("max_y"), F.avg("y").alias("mean_y"),
        F.min("x_num").alias("min_x"), F.max("x_num").alias("max_x"))
    median = quantiles(points, ["y"], [0.5], keys).select(*keys, F.col("q")[0].alias("median_y"))
    return attach(base, median, keys)


def top_n_others(df: DataFrame, c: str, n: int = 10) -> DataFrame:
    """The n most frequent categories with their share; all others as one line."""
    counts = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("category")).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "category").limit(n)
    total = counts.agg(F.sum("n")).scalar()
    kept = attach(counts, top.select("category", F.lit(True).alias("is_top")), ["category"])
    name = F.when(F.col("is_top"), F.col("category")).otherwise("Others")
    folded = kept.groupBy(name.alias("category")).agg(F.sum("n").alias("n"))
    return folded.select("category", "n", (F.col("n") / total).alias("share"))


def share_of_total(points: DataFrame, name: str = "x_val", y: str = "y") -> DataFrame:
    """Positive points by name with their share of the total."""
    positive = points.filter(F.col(y) > 0)
    total = positive.agg(F.sum(y)).scalar()
    return positive.withColumn("share", F.col(y) / total).orderBy(name)


def runs_by_dataset(runs: DataFrame, dataset: str = "dataset", ts: str = "ts", run: str = "run") -> DataFrame:
    """Runs with the group order: datasets by their newest run, runs inside newest first."""
    newest = runs.groupBy(dataset).agg(F.max(ts).alias("latest"), F.count("*").alias("runs"))
    recent = runs.withColumn("__age", -epoch_seconds(ts, runs.schema[ts].dataType))
    placed = Sequence(recent, [dataset], ["__age", run]).numbered("place").drop("__age")
    return attach(placed, newest, [dataset]).orderBy(F.desc("latest"), dataset, "place")
