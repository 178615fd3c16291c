"""The global rank against a sort on the driver, with wide rows, default partitioning and adaptive execution."""

from pyspark.sql import functions as F


def test_rank_keeps_every_row(spark):
    from wharfline.operators.action import ranked

    for n, partitions in ((1_000_000, 64), (20_000, 200), (0, 8)):
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        try:
            d = spark.range(n).select("id", F.pmod(F.xxhash64("id"), F.lit(5000)).alias("v"), F.repeat(F.lit("payload "), 12).alias("wide"))
            got = ranked(d, "rank", F.desc("v"), "id")
            seen = got.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rank").alias("k"), F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.countDistinct("id").alias("ids")).first()
            assert (seen.n, seen.k, seen.ids) == (n, n, n) and (not n or (seen.lo, seen.hi) == (1, n))
            if n == 20_000:
                rows = sorted(d.select("v", "id").collect(), key=lambda r: (-r.v, r.id))
                assert [(r.id, r["rank"]) for r in got.orderBy("rank").collect()] == [(r.id, i + 1) for i, r in enumerate(rows)]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
