"""Merkle fixity audit of WARC records.

Records are framed as WARC resource records and laid out in volumes by ranges of their id. A node of a volume's tree is the hash and the length of an ordered range of
FANOUT nodes below it; its offset follows from the lengths before it, so a record that grows or goes changes the nodes above it and no others. An audit compares the roots
of two replicas and descends only into branches that mismatch, level by level, to the corrupt records; what they moved follows from their lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import indexed
from .common import materialise, table

FANOUT = 4
LEVELS = 3
VOLUME = FANOUT**LEVELS  # places per volume
PLACE = ["volume", "shelf"]


def warc_record(page_id: Column, url: Column, body: Column) -> Column:
    """A WARC/1.0 resource record as text (its bytes are the text in UTF-8)."""
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(F.coalesce(body, F.lit(""))).cast("string"), F.lit("\r\n\r\n"), F.coalesce(body, F.lit("")), F.lit("\r\n\r\n"),
    )


def leaves(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Per record: volume, shelf, slot (its place in the volume's tree), page_id, offset, length, hash.

    A volume holds the ids of one range of VOLUME, one record to a slot. Of rows that repeat an id the first by content hash lies there, and the others on shelves of VOLUME
    records of their own, so that no id is unbounded in one place. Rows without an id go to volumes below 0 by content, and repeated ones to shelves.
    """
    record = warc_record(F.col(f"`{id_col}`"), F.col(f"`{url_col}`").cast("string"), F.col(f"`{body_col}`").cast("string"))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), record.alias("record")).select("page_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("hash"))
    by_content = F.conv(F.substring("hash", 1, 12), 16, 10).cast("long")
    rows = indexed(rows.withColumn("key", F.coalesce("page_id", -1 - by_content)), ["key"], ["hash"], "copy")
    first = F.col("copy") == 0
    volume = F.coalesce(F.floor(F.col("page_id") / VOLUME), -1 - F.floor(by_content / VOLUME))
    slot = F.when(first, F.pmod("key", F.lit(VOLUME))).otherwise(F.pmod(F.col("copy") - 1, F.lit(VOLUME)))
    shelf = F.when(first, "").otherwise(F.concat_ws(":", "key", F.floor((F.col("copy") - 1) / VOLUME).cast("string")))
    along = Window.partitionBy(*PLACE).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(volume.alias("volume"), shelf.alias("shelf"), slot.alias("slot"), "page_id", "length", "hash").withColumn("offset", F.coalesce(F.sum("length").over(along), F.lit(0).cast("long")))


def tree(records: DataFrame) -> DataFrame:
    """Nodes of all volumes: volume, shelf, level (0 for slots, LEVELS for roots), node, length, hash."""
    level = records.select(*PLACE, F.col("slot").alias("node"), "length", "hash")
    out = level.select(*PLACE, F.lit(0).alias("level"), "node", "length", "hash")
    for k in range(1, LEVELS + 1):
        child = F.struct("node", F.concat_ws(":", F.col("node").cast("string"), F.col("length").cast("string"), "hash").alias("line"))
        lines = F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda x: x["line"]), ",")
        level = level.groupBy(*PLACE, F.floor(F.col("node") / FANOUT).alias("node")).agg(F.sum("length").alias("length"), F.sha2(lines, 256).alias("hash"))
        out = out.unionByName(level.select(*PLACE, F.lit(k).alias("level"), "node", "length", "hash"))
    return out


def descent(a: DataFrame, b: DataFrame) -> list[DataFrame]:
    """The mismatching nodes (volume, shelf, node) of two stored trees by level, from the roots down to the slots: below a node that matches nothing is compared."""
    found: list[DataFrame] = []
    for k in range(LEVELS, -1, -1):
        x, y = (t.filter(F.col("level") == k).select(*PLACE, "node", F.struct("length", "hash").alias(name)) for t, name in ((a, "x"), (b, "y")))
        if found:
            parents = found[-1].select(*PLACE, F.col("node").alias("parent"))
            x, y = (t.withColumn("parent", F.floor(F.col("node") / FANOUT)).join(parents, [*PLACE, "parent"], "left_semi").drop("parent") for t in (x, y))
        found.append(materialise(x.join(y, [*PLACE, "node"], "full_outer").filter(~F.col("x").eqNullSafe(F.col("y"))).select(*PLACE, "node"), "bad"))
    return found


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Records (of ``leaves``) of the first replica that do not match the second, and the second's that the first lacks.

    Returns volume, shelf, slot, page_id, status: corrupt (other content), missing, extra, or shifted (same content at another offset: in its volume something before it has
    another length). Volumes with equal roots are not descended into; of the others only the mismatching nodes of each level are.

    Edge cases: empty replicas have no roots, so everything of the other is missing or extra; null and repeated ids are handled as
    in leaves(). Scale: joins on (volume, shelf, node); what is compared below the roots is proportional to the damage, and shifts are looked for in damaged volumes only.
    """
    slots = descent(materialise(tree(ours), "tree"), materialise(tree(theirs), "tree"))[-1].withColumnRenamed("node", "slot")
    at = [*PLACE, "slot"]
    x = ours.join(slots, at, "left_semi").select(*at, F.struct("page_id", "hash", "length").alias("x"))
    y = theirs.join(slots, at, "left_semi").select(*at, F.struct("page_id", "hash", "length").alias("y"))
    status = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra").otherwise("corrupt")
    bad = x.join(y, at, "full_outer").select(*at, F.coalesce("x.page_id", "y.page_id").alias("page_id"), status.alias("status"), (F.coalesce("y.length", F.lit(0)) - F.coalesce("x.length", F.lit(0))).alias("delta"))
    bad = materialise(bad, "damage")
    moved = bad.filter("delta != 0").select(*PLACE, F.col("slot").alias("from"), "delta")
    shifted = ours.join(moved, PLACE).filter("slot > from").groupBy(*at, "page_id").agg(F.sum("delta").alias("by")).filter(F.col("by") != 0)
    return bad.drop("delta").unionByName(shifted.join(slots, at, "left_anti").select(*at, "page_id", F.lit("shifted").alias("status")))


def damaged(pages: DataFrame) -> DataFrame:
    """The query's second replica. In every fourth range of VOLUME ids: of every 97th page one byte is overwritten, every 61st lost its last byte, every 83rd is gone."""
    page = F.col("page_id")
    hit = F.coalesce(F.pmod(F.floor(page / VOLUME), F.lit(4)) == 1, F.lit(False))
    html = F.when(hit & (page % 97 == 5), F.concat(F.lit("#"), F.substring("html", 2, 2**31 - 1))).when(hit & (page % 61 == 7), F.expr("substring(html, 1, length(html) - 1)")).otherwise(F.col("html"))
    return pages.filter(~hit | (page % 83 != 11)).withColumn("html", html)


def op5_warc_fixity(spark, sf_dir: str) -> DataFrame:
    """Every page's record with its place and hash, and what the audit against the damaged replica says of it."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    ours = materialise(leaves(pages), "leaves")
    found = audit(ours, materialise(leaves(damaged(pages)), "leaves")).filter("status != 'extra'").select(*PLACE, "slot", "status")
    return ours.join(found, [*PLACE, "slot"], "left").select("page_id", "volume", F.col("offset").alias("record_offset"), F.col("length").alias("record_length"), F.col("hash").alias("record_sha256"), F.coalesce("status", F.lit("ok")).alias("status"))


_RECORD = """'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10)
     || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)"""

ORACLE = f"""
WITH a AS (SELECT page_id, {_RECORD} AS r FROM pages),
bp AS (SELECT page_id, url, CASE WHEN page_id // 64 % 4 = 1 AND page_id % 97 = 5 THEN '#' || substring(html, 2) WHEN page_id // 64 % 4 = 1 AND page_id % 61 = 7 THEN substring(html, 1, length(html) - 1) ELSE html END AS html
       FROM pages WHERE page_id IS NULL OR page_id // 64 % 4 <> 1 OR page_id % 83 <> 11),
b AS (SELECT page_id, {_RECORD} AS r FROM bp),
x AS (SELECT page_id, CAST(floor(page_id / 64) AS BIGINT) AS volume, sha256(r) AS h, CAST(strlen(r) AS BIGINT) AS n,
             CAST(coalesce(sum(strlen(r)) OVER (PARTITION BY floor(page_id / 64) ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS o FROM a),
y AS (SELECT page_id, sha256(r) AS h,
             CAST(coalesce(sum(strlen(r)) OVER (PARTITION BY floor(page_id / 64) ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS o FROM b)
SELECT x.page_id, x.volume, x.o AS record_offset, x.n AS record_length, x.h AS record_sha256,
       CASE WHEN y.h IS NULL THEN 'missing' WHEN x.h <> y.h THEN 'corrupt' WHEN x.o <> y.o THEN 'shifted' ELSE 'ok' END AS status
FROM x LEFT JOIN y ON x.page_id = y.page_id
"""
