"""Stage sinks: the tables of a stage appear together or not at all.

A stage is written aside, read back, and described by a manifest (columns, rows and a content hash per table) that is written last; then the folder takes its
place with a rename. A run that fails leaves what was there before. Files are cut and named by their content, so that equal tables give equal bytes.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import write_json

MANIFEST = "manifest.json"
#: bytes of values to a file at most, so that a task sorts its file in memory
FILE_BYTES = 128_000_000


class StageError(ValueError):
    pass


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def content(d: DataFrame) -> dict:
    """Columns, number of rows and a hash of all rows that does not depend on their order."""
    row = F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string") if t != "binary" else F.hex(f"`{c}`"), F.lit("\u0000")) for c, t in d.dtypes], F.lit(0))
    got = d.select(row.alias("h")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("h").cast("decimal(38,0)")).alias("hash")).first()
    return {"columns": [f"{c} {t}" for c, t in d.dtypes], "rows": got.rows, "hash": str(got["hash"] or 0)}


def ordered_files(d: DataFrame, per_file: int) -> DataFrame:
    """Rows dealt by hash to as many partitions as their number and their width ask for, each sorted by all columns. Both follow from the content."""
    plain = [c for c, t in d.dtypes if not t.startswith("map")]
    long = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, t in d.dtypes if t in ("string", "binary")]
    width = reduce(lambda a, b: a + b, long, F.lit(8 * len(d.columns))).cast("long")
    got = d.agg(F.count(F.lit(1)).alias("rows"), F.sum(width).alias("bytes")).first()
    n = max(1, -(-got.rows // per_file), -(-(got.bytes or 0) // FILE_BYTES))
    keys = [F.col(f"`{c}`") for c in plain]
    return d.repartition(n, *keys).sortWithinPartitions(*[k.asc_nulls_first() for k in keys])


def _write(d: DataFrame, folder: str, kind: str, per_file: int) -> None:
    """One file per partition, named by its number."""
    writer = ordered_files(d, per_file).write
    if kind == "csv":
        writer.option("header", True).option("lineSep", "\n").option("dateFormat", "yyyy-MM-dd").option("escape", '"').csv(folder)
    else:
        writer.option("compression", "zstd").parquet(folder)
    spark = d.sparkSession
    target, fs = _fs(spark, folder)
    for f in fs.listStatus(target):
        name = f.getPath().getName()
        if name.startswith("part-"):
            fs.rename(f.getPath(), _fs(spark, f"{folder}/{name.split('-')[0]}-{name.split('-')[1]}.{kind}")[0])
        else:
            fs.delete(f.getPath(), False)


def commit_stage(tables: dict[str, DataFrame], folder: str, kind: str = "parquet", per_file: int = 5_000_000) -> dict[str, dict]:
    """Write the tables of a stage to ``folder`` as a whole; returns the manifest. CSV holds flat columns only; dates are ISO."""
    if not tables:
        raise StageError("a stage needs a table")
    spark = next(iter(tables.values())).sparkSession
    folder = folder.rstrip("/")
    parent, name = folder.rsplit("/", 1)
    aside, old = f"{parent}/.{name}-{uuid.uuid4().hex}", f"{parent}/.{name}-old-{uuid.uuid4().hex}"
    target, fs = _fs(spark, aside)
    try:
        manifest = {}
        for table, d in tables.items():
            _write(d, f"{aside}/{table}", kind, per_file)
            if kind == "parquet":  # what was written, not what was asked for
                manifest[table] = content(spark.read.schema(d.schema).parquet(f"{aside}/{table}"))
            else:
                manifest[table] = content(d.select([F.col(f"`{c}`").cast("string").alias(c) for c in d.columns]))
        write_json({"kind": kind, "tables": manifest}, f"{aside}/{MANIFEST}", spark)
        place = _fs(spark, folder)[0]
        if fs.exists(place):
            fs.rename(place, _fs(spark, old)[0])
        if not fs.rename(target, place):
            raise StageError(f"{folder} could not be put in place")
        fs.delete(_fs(spark, old)[0], True)
    except BaseException:
        fs.delete(target, True)
        if fs.exists(_fs(spark, old)[0]) and not fs.exists(_fs(spark, folder)[0]):
            fs.rename(_fs(spark, old)[0], _fs(spark, folder)[0])
        raise
    return manifest


def read_stage(spark: SparkSession, folder: str, check: bool = False) -> dict[str, DataFrame]:
    """The tables of a committed stage; ``check`` compares rows and hashes with the manifest."""
    where, fs = _fs(spark, f"{folder}/{MANIFEST}")
    if not fs.exists(where):
        raise StageError(f"{folder} holds no committed stage")
    told = json.loads("\n".join(r.value for r in spark.read.option("wholetext", True).text(f"{folder}/{MANIFEST}").collect()))
    out = {}
    for table, m in told["tables"].items():
        if told["kind"] == "parquet":
            d = spark.read.schema(", ".join(f"`{c.split(' ', 1)[0]}` {c.split(' ', 1)[1]}" for c in m["columns"])).parquet(f"{folder}/{table}")
        else:
            d = spark.read.option("header", True).option("escape", '"').schema(", ".join(f"`{c.split(' ', 1)[0]}` string" for c in m["columns"])).csv(f"{folder}/{table}")
        if check and (found := content(d)) | {"columns": 0} != m | {"columns": 0}:
            raise StageError(f"{folder}/{table} holds {found['rows']} rows with hash {found['hash']}, the manifest says {m['rows']} and {m['hash']}")
        out[table] = d
    return out
