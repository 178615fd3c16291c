"""A session with the settings the engine relies on."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
#: settings while rows meet where they lie: joins by some of their keys; buckets and their order are kept by unions and filters too; and methods that the JVM would only interpret are cut into smaller ones
AT_HOME = {ALL_KEYS: "false", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false", "spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.codegen.hugeMethodLimit": "8000"}
#: columns whose values hardly repeat, so that a dictionary is built in vain
DISTINCT = {"home", "invoice_id", "invoice_number", "pro_number", "bol", "bol_raw", "bol_canonical", "shipment_id", "true_shipment", "target_id", "superseded_by", "related_invoice_id", "reason"}


def session(master: str = "local[*]", app: str = "wharfline", **conf: str) -> SparkSession:
    """UTC, ANSI casts, adaptive execution with skew joins; further settings as keywords with ``__`` for dots."""
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local session, which has no other machines, gets a temporary folder of its own; anywhere else it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="wharfline-")
    return _own[context.applicationId]


class _During:
    """A setting that holds while any write of the session that asks for it runs."""

    lock = threading.Lock()
    writes: dict[tuple[str, str], tuple[int, str | None]] = {}

    def __init__(self, spark: SparkSession, key: str, value: str):
        self.spark, self.key, self.value, self.id = spark, key, value, (spark._jsparkSession.sessionUUID(), key)

    def __enter__(self) -> None:
        with self.lock:
            n, before = self.writes.get(self.id) or (0, self.spark.conf.get(self.key, None))
            self.writes[self.id] = n + 1, before
            self.spark.conf.set(self.key, self.value)

    def __exit__(self, *_) -> None:
        with self.lock:
            n, before = self.writes.pop(self.id)
            if n > 1:
                self.writes[self.id] = n - 1, before
            elif before is None:
                self.spark.conf.unset(self.key)
            else:
                self.spark.conf.set(self.key, before)


def _Cleanup(spark: SparkSession) -> _During:
    """Drops the shuffle files of a write when it is done: nothing reads them again."""
    return _During(spark, SHUFFLE_CLEANUP, "true")


@contextmanager
def at_home(spark: SparkSession) -> Iterator[None]:
    """The settings of ``AT_HOME`` hold within."""
    with ExitStack() as stack:
        for key, value in AT_HOME.items():
            stack.enter_context(_During(spark, key, value))
        yield


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _write(df: DataFrame, name: str, by: str | None = None) -> str:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/wharfline/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    with _Cleanup(spark):
        (writer.partitionBy(by) if by else writer).parquet(path)
    target, fs = _path(spark, path)
    fs.deleteOnExit(target)
    return path


def store(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    For tables that fan out to many consumers: they are computed once, survive lost executors, and later plans start from a scan
    (a persisted frame keeps its whole logical plan, which is analysed again with every operation on it). The files go when the application ends.
    """
    schema = df.schema
    return df.sparkSession.read.schema(schema).parquet(_write(df, name))


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """Like ``store``, for what is derived from tables that ``lay`` wrote: their rows meet where they lie."""
    with at_home(df.sparkSession):
        return store(df, name)


def lay(df: DataFrame, by: str, n: int, name: str = "table") -> DataFrame:
    """Like ``store``, as a table in ``n`` buckets of a column, which later joins, groups and windows on this column and others need not shuffle again.

    While the table is written, joins too may use a partitioning by some of their keys; that suits ``by`` columns without large groups only. Buckets are sorted by the column and the invoice, so that
    what is derived from them is not sorted again. The column's metadata have their number.
    """
    spark, key = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/wharfline/{key}"
    order = [by, *[c for c in ("invoice_id",) if c in df.columns]]
    plain = {f"parquet.enable.dictionary#{c}": "false" for c in df.columns if c in DISTINCT}
    with _Cleanup(spark), at_home(spark):
        df.withMetadata(by, {"buckets": n}).write.format("parquet").options(compression="zstd", path=path, **plain).bucketBy(n, by).sortBy(*order).saveAsTable(key)
    target, fs = _path(spark, path)
    fs.deleteOnExit(target)
    return spark.table(key)


def united(frames: list[DataFrame]) -> DataFrame:
    """The union of ``frames`` by name; within ``at_home`` it keeps the buckets of those that lie by home.

    Spark takes the children's partitionings for equal only if the first child's column is spelled as in its own partitioning, where a table's name is missing. So the first child's home is an alias
    (with metadata of its own, as it would be dropped otherwise).
    """
    first, *rest = frames
    if "home" in first.columns:
        first = first.withMetadata("home", {**first.schema["home"].metadata, "union": uuid.uuid4().hex})
    return reduce(DataFrame.unionByName, rest, first)


def come_home(df: DataFrame, like: DataFrame) -> DataFrame:
    """The rows of ``df`` dealt by home as those of ``like`` lie, so that a union of both keeps their buckets; for few rows that were found elsewhere."""
    n = like.schema["home"].metadata.get("buckets") if "home" in like.columns else None
    return df.repartition(n, "home") if n else df


def store_parts(df: DataFrame, by: str, values: list[int], name: str = "table") -> list[DataFrame]:
    """The rows of ``df`` by the whole number in column ``by`` (which must be one of ``values``), computed in one pass and stored as tables of their own, so that each can be discarded."""
    spark, schema = df.sparkSession, df.drop(by).schema
    path = _write(df, name, by)
    for v in values:  # a table without rows has no folder
        target, fs = _path(spark, f"{path}/{by}={v}")
        fs.mkdirs(target)
    return [spark.read.schema(schema).parquet(f"{path}/{by}={v}") for v in values]


def discard(stored: DataFrame) -> None:
    """Delete a stored table's files, once all that is derived from it is stored."""
    spark = stored.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in stored.inputFiles()}:
        target, fs = _path(spark, folder)
        fs.delete(target, True)
