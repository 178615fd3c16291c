"""Stage sinks, knowledge-time views, the nested summary and the whole run's stages."""

import hashlib
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wharfline.config import Config, ConfigError, Network
from wharfline.operators.knowledge import known
from wharfline.operators.report import breakdown, paths
from wharfline.session import discard, store_parts
from wharfline.sources.stages import StageError, commit_stage, read_stage


def digest(folder: Path) -> dict:
    return {str(p.relative_to(folder)): hashlib.md5(p.read_bytes()).hexdigest() for p in sorted(folder.rglob("*")) if p.is_file() and not p.name.endswith(".crc")}


@pytest.fixture(scope="module")
def tables(spark):
    d = spark.range(1000).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit('a,"b"\n'), F.col("id").cast("string"))).alias("text"), (F.col("id") % 9).cast("decimal(18,2)").alias("money"), F.date_add(F.lit(date(2024, 1, 1)), (F.col("id") % 40).cast("int")).alias("day"))
    return {"facts": d.repartition(5), "none": d.limit(0)}


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_a_stage_is_whole_and_reruns_are_equal(spark, tables, tmp_path, kind):
    told = [commit_stage(tables, f"file://{tmp_path}/{name}/audit", kind, per_file=300) for name in "ab"]
    assert told[0] == told[1] and told[0]["facts"]["rows"] == 1000 and told[0]["none"]["rows"] == 0
    assert digest(tmp_path / "a") == digest(tmp_path / "b") and len(list((tmp_path / "a/audit/facts").glob(f"*.{kind}"))) == 4
    got = read_stage(spark, f"file://{tmp_path}/a/audit", check=kind == "parquet")
    if kind == "parquet":
        assert sorted(map(str, got["facts"].collect())) == sorted(map(str, tables["facts"].collect())) and got["none"].isEmpty()
    # a later run takes its place as a whole
    commit_stage({"facts": tables["facts"].limit(3)}, f"file://{tmp_path}/a/audit", kind)
    assert set(read_stage(spark, f"file://{tmp_path}/a/audit")) == {"facts"} and [p.name for p in (tmp_path / "a").iterdir()] == ["audit"]


def test_a_run_that_fails_leaves_the_stage_as_it_was(spark, tables, tmp_path):
    folder = f"file://{tmp_path}/audit"
    commit_stage({"facts": tables["facts"]}, folder)
    before = digest(tmp_path)
    broken = tables["facts"].withColumn("text", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        commit_stage({"facts": tables["facts"].limit(1), "later": broken}, folder)
    assert digest(tmp_path) == before and [p.name for p in tmp_path.iterdir()] == ["audit"]
    with pytest.raises(StageError, match="no committed stage"):
        read_stage(spark, f"file://{tmp_path}/nothing")
    # rows that were changed behind the manifest's back are found
    next((tmp_path / "audit/facts").glob("*.parquet")).unlink()
    with pytest.raises(StageError, match="manifest"):
        read_stage(spark, folder, check=True)


def test_known_rows(spark):
    rows = [("a", date(2024, 1, 1), None, False), ("b", date(2024, 1, 5), date(2024, 1, 9), True), ("c", date(2024, 1, 9), date(2024, 1, 10), True), ("d", None, None, False)]
    d = spark.createDataFrame([(*r, "z" if r[2] else None) for r in rows], "invoice_id string, received_date date, superseded_on date, is_superseded boolean, superseded_by string")
    for day in (date(2024, 1, 1), date(2024, 1, 8), date(2024, 1, 9), date(2024, 1, 10)):
        got = {r.invoice_id: (r.is_superseded, r.superseded_on, r.superseded_by) for r in known(d, "invoices", day).collect()}
        assert got == {i: ((True, on, "z") if on and on <= day else (False, None, None)) for i, at, on, _ in rows if at and at <= day}
        # later rows change nothing
        late = d.filter(F.col("received_date") <= F.lit(day))
        assert sorted(map(str, known(late, "invoices", day).collect())) == sorted(map(str, known(d, "invoices", day).collect()))


def test_paths_and_breakdown(spark):
    block = spark.sql("select struct(1 as a, struct(2.5 as c) as b) as x, map('k', struct(3 as n), 'l', struct(cast(null as int) as n)) as y")
    assert {(r.path, r.value) for r in paths(block).collect()} == {("x.a", 1.0), ("x.b.c", 2.5), ("y.k.n", 3.0), ("y.l.n", None)}
    none = spark.createDataFrame([], "carrier_id string, invoice_type string, n_flags int, total decimal(18,2), recoverable decimal(18,2)")
    assert breakdown(none).filter("level != 'all'").isEmpty()


def test_stored_parts_are_discarded_one_by_one(spark):
    one, two, three = store_parts(spark.range(10).withColumn("part", (F.col("id") % 2).cast("int")), "part", [0, 1, 2])
    assert (one.count(), two.count(), three.count()) == (5, 5, 0)
    discard(two)
    assert one.count() == 5 and not [f for f in two.inputFiles() if Path(f.removeprefix("file://").removeprefix("file:")).exists()]


def test_network_settings():
    assert Config().network.lanes <= Config().network.origins * Config().network.destinations
    with pytest.raises(ConfigError, match="network.lanes"):
        Config(network=Network(lanes=10, origins=3, destinations=3))
    with pytest.raises(ConfigError, match="network.monthly_weights"):
        Config(network=Network(monthly_weights=(0.5, 0.6)), months=2)
    with pytest.raises(ConfigError, match="monthly_weights has 2"):
        Config(network=Network(monthly_weights=(0.5, 0.5)))
    with pytest.raises(ConfigError, match="carriers_per_lane"):
        Config(network=Network(carriers_per_lane=(("LTL", 99),)))


def test_wide_rows_are_cut_into_files_that_a_task_can_sort(spark, monkeypatch):
    from wharfline.sources import stages

    d = spark.range(100).selectExpr("id", "repeat('x', 1000) as text")
    assert stages.ordered_files(d, 5_000_000).rdd.getNumPartitions() == 1
    monkeypatch.setattr(stages, "FILE_BYTES", 20_000)
    assert stages.ordered_files(d, 5_000_000).rdd.getNumPartitions() == 6
    assert stages.ordered_files(d, 5_000_000).count() == 100
