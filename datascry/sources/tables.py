"""File sources and sinks for tables."""

from __future__ import annotations

import re

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datascry.functions.scalars import FLOATING, finite, hash_bucket

CORRUPT = "_corrupt_record"


def detect_format(spark: SparkSession, path: str) -> str:
    """Format by extension; without a known one, by whether the path reads as parquet, else by its first line."""
    low = path.rstrip("/").lower()
    for ending, fmt in ((".parquet", "parquet"), (".csv", "csv"), (".tsv", "tsv"), (".jsonl", "jsonl"), (".ndjson", "jsonl"),
                        (".json", "json")):
        if low.endswith(ending):
            return fmt
    try:
        spark.read.parquet(path).schema  # noqa: B018
        return "parquet"
    except Exception:  # the footer check fails in many ways, all of them mean "not parquet"
        pass
    head = spark.read.text(path).filter(F.trim("value") != "").head(1)
    line = head[0]["value"].lstrip() if head else ""
    if line.startswith("{") and line.rstrip().endswith("}"):
        return "jsonl"
    if line.startswith(("[", "{")):
        return "json"
    return "tsv" if "\t" in line else "csv"


def read_table(spark: SparkSession, path: str, fmt: str | None = None, schema=None) -> DataFrame:
    """Any supported table as a DataFrame with trimmed column names and without infinities."""
    fmt = fmt or detect_format(spark, path)
    if fmt == "parquet":
        df = spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    elif fmt in ("csv", "tsv"):
        df = read_delimited(spark, path, "\t" if fmt == "tsv" else ",", schema)
    elif fmt == "jsonl":
        df = spark.read.schema(schema).json(path) if schema else spark.read.json(path)
    elif fmt == "json":
        df = read_json_document(spark, path)
    else:
        raise ValueError(f"unknown table format {fmt}")
    return normalize_columns(df)


def _encoding(spark: SparkSession, path: str) -> str:
    """utf-8 unless some line does not decode."""
    broken = spark.read.text(path).filter(~F.is_valid_utf8("value"))
    return "UTF-8" if broken.isEmpty() else "ISO-8859-1"


def header_is_data(cells: list[str | None]) -> bool:
    """A header cell with more than 60 characters, more than 3 blanks or a line break is a data value."""
    return any(c is not None and (len(c) > 60 or c.count(" ") > 3 or "\n" in c) for c in cells)


def read_delimited(spark: SparkSession, path: str, sep: str = ",", schema=None, encoding: str | None = None) -> DataFrame:
    """Delimited text with a header (found missing where its cells look like data).

    Lines with more fields than the header are skipped, short lines are filled with nulls.
    """
    encoding = encoding or _encoding(spark, path)
    base = spark.read.option("sep", sep).option("encoding", encoding).option("escape", '"')
    first = base.option("header", False).csv(path).head(1)
    cells = [(c or "").lstrip("﻿") for c in first[0]] if first else []
    header = not header_is_data(cells)
    base = spark.read.option("sep", sep).option("encoding", encoding).option("escape", '"').option("header", header)
    if schema is None:
        schema = base.option("inferSchema", True).csv(path).schema
    elif isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    with_bad = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType())])
    rows = base.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).schema(with_bad).csv(path)
    bare = F.regexp_replace(F.col(CORRUPT), r'"([^"]|"")*"', "")
    fields = F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1
    # The reader refuses plans that need only the record column, as a plain count would; the last term names another one.
    other = F.col(f"`{schema.fields[0].name}`").cast("string") == CORRUPT
    rows = rows.filter(F.col(CORRUPT).isNull() | (fields <= len(schema.fields)) | F.coalesce(other, F.lit(False))).drop(CORRUPT)
    names = [c.lstrip("﻿").strip() for c in rows.columns] if header else [f"col_{i}" for i in range(len(rows.columns))]
    return rows.toDF(*names)


def read_json_document(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of objects; or objects whose first list of objects is the table; or one row per object.

    Every document is judged by its own keys; columns that only some documents have are null elsewhere. An empty list gives no row.
    """
    doc = spark.read.option("multiLine", True).json(path)
    lists = [f.name for f in doc.schema.fields
             if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    if not lists:
        return doc
    # Spark sorts inferred fields; each document's own key order decides which of its lists is the table.
    body = F.ltrim("value")
    first = F.get(F.filter(F.json_object_keys("value"), lambda k: k.isin(lists)), 0)
    case = F.when(F.substring(body, 1, 1) == "[", F.lit("[")).otherwise(F.coalesce(F.concat(F.lit("."), first), F.lit("{")))
    texts = spark.read.option("wholetext", True).text(path).filter(F.trim("value") != "").withColumn("case", case)
    parts = []
    for kind in sorted(r["case"] for r in texts.select("case").distinct().collect()):
        rows = texts.filter(F.col("case") == kind)
        if kind == "[":
            rows = rows.select(F.explode(F.from_json("value", T.ArrayType(doc.schema))).alias("row"))
        else:
            rows = rows.select(F.from_json("value", doc.schema).alias("row"))
            rows = rows if kind == "{" else rows.select(F.explode(F.col(f"row.`{kind[1:]}`")).alias("row"))
        parts.append(rows.select("row.*"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else doc


def normalize_columns(df: DataFrame) -> DataFrame:
    """Trimmed names; NaN and infinities of float columns become null. Other columns stay bare for pushdown."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        cols.append((finite(c) if isinstance(f.dataType, FLOATING) else c).alias(f.name.strip()))
    return df.select(cols)


def json_safe(df: DataFrame, name: str = "json", keep: list[str] | None = None) -> DataFrame:
    """Rows as JSON text: NaN and infinities as null, bytes decoded. Columns in `keep` stay beside the text."""
    keep = list(keep or [])
    cols = []
    for f in df.schema.fields:
        if f.name in keep:
            continue
        c = F.col(f.name)
        if isinstance(f.dataType, FLOATING):
            c = finite(c)
        elif isinstance(f.dataType, T.BinaryType):
            c = F.decode(c, "utf-8")
        cols.append(c.alias(f.name))
    return df.select(*keep, F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias(name))


def preview(df: DataFrame, order_by: list[str], n: int = 15) -> DataFrame:
    """The first n rows as text, null as ''."""
    head = df.orderBy(*order_by).limit(n)
    return head.select([F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])


def estimate_table(df: DataFrame, key, actions: list[dict] | None = None, share: float = 0.1) -> DataFrame:
    """One row: total rows, and the rows left after cleaning, scaled up from a hash sample of `share`."""
    if not actions:
        return df.agg(F.count("*").alias("total_rows"), F.count("*").alias("estimated_rows"))
    from datascry.operators.cleaning import fit_cleaner

    sample = df.filter(hash_bucket(key) < int(share * 1_000_000))
    cleaned = fit_cleaner(sample, actions).transform(sample, training=True)
    total, seen, kept = df.count(), sample.count(), cleaned.count()
    guess = int(total * kept / seen + 0.5) if seen else total
    return df.sparkSession.createDataFrame([(total, guess)], "total_rows bigint, estimated_rows bigint")


def estimate_rows(df: DataFrame, key=None, actions: list[dict] | None = None) -> int:
    return estimate_table(df, key, actions).first()["estimated_rows"]


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A directory of CSV files with headers, one per task."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def content_id(df: DataFrame) -> str:
    """Order-free fingerprint of a table: schema, row count and two sums over row hashes."""
    cols = [F.to_json(c) if isinstance(f.dataType, T.MapType) else F.col(f.name)
            for f, c in zip(df.schema.fields, df.columns)]
    row = F.xxhash64(*cols).cast("decimal(38,0)")
    other = F.hash(*cols).cast("decimal(38,0)")
    sums = df.agg(F.count("*").alias("n"), F.sum(row).alias("a"), F.sum(other).alias("b")).first()
    schema_id = df.sparkSession.range(1).select(F.md5(F.lit(df.schema.simpleString()))).first()[0]
    return f"{schema_id[:8]}-{sums['n']}-{int(sums['a'] or 0) % 2**64:016x}{int(sums['b'] or 0) % 2**32:08x}"


def land_parquet(df: DataFrame, root: str) -> str:
    """Write a table below `root` under its content id, once; returns the path."""
    path = f"{root.rstrip('/')}/{content_id(df)}.parquet"
    try:
        df.sparkSession.read.parquet(path)
    except AnalysisException:
        write_parquet(df, path)
    return path


SAFE_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def run_sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The user's SELECT over named DataFrames."""
    for name, df in tables.items():
        if not SAFE_NAME.match(name):
            raise ValueError(f"bad table name {name}")
        df.createOrReplaceTempView(name)
    return spark.sql(sql)


def jdbc_options(db_type: str, query: str, params: dict, partition: dict | None = None) -> dict[str, str]:
    """Options of the JDBC source for a query on sqlite, postgresql or mysql."""
    if db_type == "sqlite":
        options = {"url": f"jdbc:sqlite:{params['path']}", "driver": "org.sqlite.JDBC"}
    elif db_type in ("postgresql", "mysql"):
        port = params.get("port") or {"postgresql": 5432, "mysql": 3306}[db_type]
        options = {
            "url": f"jdbc:{db_type}://{params['host']}:{port}/{params['database']}",
            "driver": {"postgresql": "org.postgresql.Driver", "mysql": "com.mysql.cj.jdbc.Driver"}[db_type],
            "user": params.get("user", ""),
            "password": params.get("password", ""),
        }
    else:
        raise ValueError(f"unknown database type {db_type}")
    if partition:
        missing = {"partitionColumn", "lowerBound", "upperBound", "numPartitions"} - set(partition)
        if missing:
            raise ValueError(f"partitioned reads also need {sorted(missing)}")
        # The source cannot split a plain query, only a relation.
        options["dbtable"] = f"({query.rstrip().rstrip(';')}) q"
        options.update({k: str(v) for k, v in partition.items()})
    else:
        options["query"] = query.rstrip().rstrip(";")
    return options


def bigquery_options(query: str, params: dict) -> dict[str, str]:
    """Options of the BigQuery connector, which the user's session provides."""
    options = {"query": query, "viewsEnabled": "true", "parentProject": params["project"]}
    if params.get("dataset"):
        options["materializationDataset"] = params["dataset"]
    if params.get("credentials_path"):
        options["credentialsFile"] = params["credentials_path"]
    return options


def read_query(spark: SparkSession, db_type: str, query: str, params: dict, partition: dict | None = None) -> DataFrame:
    """A remote query as a DataFrame; `partition` splits it over executors by a numeric column."""
    if db_type == "bigquery":
        return normalize_columns(spark.read.format("bigquery").options(**bigquery_options(query, params)).load())
    return normalize_columns(spark.read.format("jdbc").options(**jdbc_options(db_type, query, params, partition)).load())
