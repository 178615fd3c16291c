"""Exact dedup by content sort, in DataFrame operations only.

Sampled splitters range-partition the rows by the first bytes of the text and its hash, an external sort places equal texts
adjacent, and neighbouring full comparisons (the window's group boundaries compare whole texts) find the runs of equal texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import carried, table

PREFIX_CHARS = 128
HOT_SHARE = 1000


def _runs(rows: DataFrame, keep: str, *salt: str) -> DataFrame:
    """Sort rows (id, text, head, fp and any salt) by content; each run of equal neighbours gets its keeper and length.

    The window's keys hold all keys of the range exchange, so the sort follows it without another shuffle.
    """
    placed = rows.repartitionByRange("head", "fp", *salt)
    more = [c for c in ("text", "carried") if "carried" in rows.columns]
    run = Window.partitionBy("head", "fp", *salt, "text")
    order = run.orderBy(F.col("id").desc_nulls_last() if keep == "max" else F.col("id").asc_nulls_last())
    return placed.select(
        "id", "fp", F.first("id").over(order).alias("keep_id"), (F.row_number().over(order) == 1).alias("kept"),
        F.count(F.lit(1)).over(run).alias("group_size"), F.sha2("text", 256).alias("text_sha256"), *more,
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", normalise=None, hot_min: int = 1024, carry: list[str] | None = None) -> DataFrame:
    """Find groups of equal texts; ``keep`` says whether the smallest or the largest id of a group stays.

    Returns one row per input row: doc_id, keep_id, group_size, kept, text_sha256; with ``carry`` also text (as normalised, nulls empty) and carried, a
    struct of those columns.

    Edge cases: a null text counts as empty, so nulls and empty texts form one group. Null ids sort last and stay only if their
    group has no other id; of repeated ids one row stays. Very long texts are compared whole; only the splitters are short
    (PREFIX_CHARS characters and a hash). An empty table gives an empty result. Other columns of ``docs`` are not read, so
    their names cannot clash.

    Scale: one shuffle of the texts. A text with more than 1/HOT_SHARE of all rows (there are fewer than HOT_SHARE such texts)
    is salted over several ranges, and its few runs are merged by digest afterwards.
    """
    normalise = normalise or (lambda c: c)
    text: Column = F.coalesce(normalise(F.col(f"`{text_col}`")), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), *carried(carry)).select("*", F.substring("text", 1, PREFIX_CHARS).alias("head"), F.xxhash64("text").alias("fp"))
    # one pass finds the number of rows and the texts that may be hot: no more than HOT_SHARE can exceed the bar
    seen = Observation()
    most = rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).observe(seen, F.sum("n").alias("rows")).orderBy(F.desc("n")).limit(HOT_SHARE).collect()
    bar = max(hot_min, (seen.get["rows"] or 0) // HOT_SHARE) if most else hot_min
    hot = {r.fp: -(-r.n // bar) for r in most if r.n > bar}
    out = ["id", "keep_id", "group_size", "kept", "text_sha256", *([] if carry is None else ["text", "carried"])]
    if not hot:
        found = _runs(rows, keep).select(out)
    else:
        is_hot = F.col("fp").isin(list(hot))
        found = _runs(rows.filter(~is_hot), keep).select(out)
        spread = F.element_at(F.create_map(*[F.lit(x) for kv in hot.items() for x in kv]), F.col("fp"))
        pieces = _runs(rows.filter(is_hot).withColumn("salt", F.pmod(F.xxhash64("id"), spread)), keep, "salt")
        best = F.max("keep_id") if keep == "max" else F.min("keep_id")
        merged = pieces.filter("kept").groupBy("text_sha256").agg(best.alias("keep_all"), F.sum("group_size").alias("size_all"))
        found = found.unionByName(
            pieces.join(F.broadcast(merged), "text_sha256").select("id", F.col("keep_all").alias("keep_id"), F.col("size_all").alias("group_size"), (F.col("kept") & F.col("keep_id").eqNullSafe(F.col("keep_all"))).alias("kept"), *out[4:])
        )
    return found.withColumnRenamed("id", "doc_id")


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
