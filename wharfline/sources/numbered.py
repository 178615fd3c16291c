"""CSV records with their numbers, from any number of files of any size, without a file in one row.

Whether a line feed ends a record depends on the quotes before it, back to the file's start. A line maps the state in front of it (outside or inside a quoted
field) to the state after it, and such maps compose. So splits are scanned on their own, for either state in front of them; one map and one pair of record counts per split are
scanned over the file; and every split then knows its state and its first record's number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import store


def after_line(line: Column, inside: bool) -> Column:
    """Whether the state after a line is inside a quoted field, from the state before it.

    A quote opens a field only at its start, is doubled within a quoted field, and is an ordinary character in the middle of an unquoted one. The
    line is folded over its pieces between quotes: 0 outside, 1 inside, 2 just behind a closing quote.
    """
    pieces = F.split(line, '"')
    flags = lambda state, piece, first: F.struct(state.alias("state"), (F.length(piece) == 0).alias("empty"), F.endswith(piece, F.lit(",")).alias("comma"), first.alias("first"))

    def quote(a: Column, piece: Column) -> Column:
        opens = a["comma"] | (a["empty"] & (a["first"] | (a["state"] == 2)))
        return flags(F.when(a["state"] == 1, 2).when(opens, 1).otherwise(0), piece, F.lit(False))

    start = flags(F.lit(int(inside)), F.get(pieces, F.lit(0)), F.lit(True))
    end = F.aggregate(F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1))), start, quote, lambda a: a["state"] == 1)
    return F.when(F.contains(line, F.lit('"')), end).otherwise(F.lit(inside))


def scanned(zero: Column, one: Column, order: Window) -> tuple[Column, Column]:
    """The state in front of each element, for either state in front of the first, of maps given by their values at False and True.

    An element that maps both states alike fixes the state; since the last of these, or the start, swaps are counted.
    """
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.coalesce(F.sum((zero & ~one).cast("long")).over(before), F.lit(0).cast("long"))
    upto = F.sum((zero & ~one).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return swaps, upto


def state_before(rows: DataFrame, order: Window) -> DataFrame:
    """Adds before0 and before1: the state in front of each row (columns zero, one) if the state in front of its window's first row is outside, or inside."""
    swaps, upto = scanned(F.col("zero"), F.col("one"), order)
    rows = rows.withColumns({"_swaps": swaps, "_upto": upto})
    fixed = F.last(F.when(F.col("zero") == F.col("one"), F.struct(F.col("zero").alias("value"), F.col("_upto").alias("swaps"))), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_fixed", fixed)
    since = F.col("_swaps") - F.coalesce(F.col("_fixed.swaps"), F.lit(0))
    odd = since % 2 == 1
    of = lambda start: F.when(odd, ~F.coalesce(F.col("_fixed.value"), F.lit(start))).otherwise(F.coalesce(F.col("_fixed.value"), F.lit(start)))
    return rows.withColumns({"before0": of(False), "before1": of(True)}).drop("_swaps", "_upto", "_fixed")


def numbered_records(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """The records of CSV files (paths and globs): file, folder, source_file (folder and name), csv_row and record; and the files that end inside quotes: file, csv_row.

    The folder of ``carrier_id=X`` is X.

    csv_row is the record's number, the header being 1; blank lines between records are not counted, line feeds within quoted fields stay in their record. A carriage return before
    a line feed and a byte order mark are dropped. A record that is not closed by the end of its file is left out and told in the second table. Empty files have no records.

    Scale: lines are read in splits; a window holds one split's lines (files.maxPartitionBytes), and the scan over a file has a row per split. Only records of several lines are put together.
    """
    read = spark.read.option("lineSep", "\n").text(paths)
    lines = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("line"))
    lines = lines.withColumn("line", F.when((F.col("block") == 0) & F.startswith("line", F.lit("﻿")), F.substring("line", 2, 1 << 30)).otherwise(F.col("line")))
    lines = lines.withColumns({"zero": after_line(F.col("line"), False), "one": after_line(F.col("line"), True)})
    split = Window.partitionBy("file", "block").orderBy("at")
    lines = state_before(lines, split)
    starts = lambda before: F.sum((~F.col(before) & (F.col("line") != "")).cast("long")).over(split.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lines = store(lines.withColumns({"n0": starts("before0"), "n1": starts("before1")}), "lines")
    after = lambda before: F.when(F.col(before), F.col("one")).otherwise(F.col("zero"))
    last = F.max_by(F.struct(after("before0").alias("zero"), after("before1").alias("one"), "n0", "n1"), "at").alias("last")
    blocks = state_before(lines.groupBy("file", "block").agg(last).select("file", "block", "last.*"), Window.partitionBy("file").orderBy("block"))
    blocks = blocks.withColumn("_n", F.when(F.col("before0"), F.col("n1")).otherwise(F.col("n0")))
    base = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    blocks = store(blocks.select("file", "block", F.col("before0").alias("inside"), base.alias("base"), F.col("_n").alias("own"), after("before0").alias("ends_inside")), "splits")
    open_ = blocks.groupBy("file").agg(F.max_by("ends_inside", "block").alias("open"), F.sum("own").alias("csv_row")).filter("open").select("file", "csv_row")
    placed = lines.join(blocks.select("file", "block", "inside", "base"), ["file", "block"])
    state = F.when(F.col("inside"), F.col("before1")).otherwise(F.col("before0"))
    placed = placed.select("file", "block", "at", "line", state.alias("state"), (F.col("base") + F.when(F.col("inside"), F.col("n1")).otherwise(F.col("n0"))).alias("csv_row"), "zero", "one")
    placed = placed.filter(F.col("state") | (F.col("line") != "")).withColumn("goes_on", F.when(F.col("state"), F.col("one")).otherwise(F.col("zero")))
    placed = placed.join(open_.select("file", F.col("csv_row").alias("_open")), "file", "left").filter("_open is null or csv_row < _open").drop("_open")
    whole = placed.filter(~F.col("state") & ~F.col("goes_on")).select("file", "csv_row", F.col("line").alias("record"))
    parts = placed.filter(F.col("state") | F.col("goes_on")).groupBy("file", "csv_row").agg(F.array_sort(F.collect_list(F.struct("block", "at", "line"))).alias("l"))
    records = whole.unionByName(parts.select("file", "csv_row", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("record")))
    names = F.split("file", "/")
    return records.select("file", F.regexp_replace(F.element_at(names, -2), "^[^=]*=", "").alias("folder"), F.array_join(F.slice(names, -2, 2), "/").alias("source_file"), F.col("csv_row").cast("int").alias("csv_row"), "record"), open_


def fields(record: Column, n: int) -> Column:
    """A record's first ``n`` fields as a struct c0, c1, ...; missing ones are empty."""
    return F.from_csv(record, ", ".join(f"c{k} string" for k in range(n)), {"nullValue": "\u0000", "emptyValue": "", "escape": '"', "maxCharsPerColumn": "-1"})
