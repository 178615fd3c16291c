"""Typed and text CSV scans, table registries and deterministic sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: columns that hold dates; everything that ends in one of the id names stays text, so leading zeros survive
DATES = {"invoice_date", "ship_date", "delivery_date", "received_date", "superseded_on", "effective_from", "effective_to", "week_start", "authorized_at", "certified_at"}
#: fixed values: types of numeric columns that are not text
NUMBERS = {"miles": "int", "weight_lbs": "int", "billed_weight_lbs": "int", "certified_weight_lbs": "int", "transit_days": "int", "version": "int", "min_charge": "decimal(18,2)", "rate_per_mile": "decimal(18,4)", "amount": "decimal(18,2)", "authorized_amount": "decimal(18,2)", "total": "decimal(18,2)", "price_per_gallon": "decimal(10,3)", "fsc_pct": "decimal(12,6)", "diesel_from": "decimal(10,3)", "diesel_to": "decimal(10,3)", "lat": "double", "lon": "double", "true_dollar_impact": "decimal(18,2)"}


def text_csv(spark: SparkSession, paths: str | list[str], columns: list[str]) -> DataFrame:
    """All columns as text, blanks as empty strings, in the given order of the header."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    d = spark.read.option("header", True).option("enforceSchema", False).option("nullValue", "\u0000").option("emptyValue", "").schema(schema).csv(paths)
    return d.select([F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns])


def header(spark: SparkSession, path: str) -> list[str]:
    """The column names of a CSV file, from its first line (read on the driver)."""
    return spark.read.option("header", True).csv(path).columns


def typed_csv(spark: SparkSession, path: str) -> DataFrame:
    """A reference table: ids as text, known dates and numbers typed; junk in a typed column gives null."""
    d = text_csv(spark, path, header(spark, path))
    cols = []
    for c in d.columns:
        v = F.nullif(F.col(c), F.lit(""))
        kind = "date" if c in DATES else NUMBERS.get(c) or ("decimal(18,4)" if c.startswith("cwt_") else "boolean" if c.startswith("is_") or c == "deficit_weight_rating" else None)
        cols.append((v.try_cast(kind) if kind else F.col(c)).alias(c))
    return d.select(cols)


def registry(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """Named tables of a folder, also as temporary views."""
    out = {n: typed_csv(spark, f"{folder}/{n}.csv") for n in names}
    for n, d in out.items():
        d.createOrReplaceTempView(n)
    return out


def write_tables(tables: dict[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    """Each table to its own folder. CSV has a header, ISO dates and ``\\n``, and is sorted by all columns so reruns are equal."""
    for name, d in tables.items():
        if kind == "csv":
            d.orderBy(*[F.col(c).asc_nulls_first() for c in d.columns]).write.mode("overwrite").option("header", True).option("lineSep", "\n").option("dateFormat", "yyyy-MM-dd").csv(f"{folder}/{name}")
        else:
            d.write.mode("overwrite").parquet(f"{folder}/{name}")


def rounded(d: DataFrame) -> DataFrame:
    """Ratios to 4 places, money to 2, counts whole: by type."""
    return d.select([F.round(c, 4).alias(c) if t == "double" else F.round(c, 2).alias(c) if t.startswith("decimal") else F.col(c) for c, t in d.dtypes])


def write_json(values: dict, path: str, spark: SparkSession) -> None:
    """A small document with keys in the given order and no wall clock."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray((json.dumps(values, indent=2, default=str) + "\n").encode()))
    finally:
        out.close()
