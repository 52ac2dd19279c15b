"""Names, trees and files that come from tables."""

from conftest import DATA
from pyspark.sql import functions as F

from quantloom import queries
from quantloom.functions import registry
from quantloom.sources import market


def test_names_meet_their_prefixes_by_equality(spark):
    names = ["RSI", "RSI_14", "R", "", None, "%K_3", "MACD_Signal_1", "MACD_Sig", "HT_TRENDMODE_SMA"]
    rows = spark.createDataFrame([(n,) for n in names + names], "feature string")
    got = {r.feature: (r.family, r.prefix) for r in registry.classify(rows).collect()}
    want = {}
    for n in names:
        fits = [(registry._PRIORITY[f], -len(p), f, p) for p, f, *_ in registry.RULES if n is not None and n.startswith(p)]
        want[n] = min(fits)[2:] if fits else (None, None)
    assert got == want
    plan = registry.classify(rows)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_every_tree_query_reads_the_events(spark):
    for name in "classify adjacency child_overflow tree_validate compact subtree root_branch_copy critical_repair lcg next_generation mutate_parameters add_node subtree_crossover permuted".split():
        plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().analyzed().toString()
        assert "value#" in plan or "event_id#" in plan or "LogicalRDD" in plan or "user_id#" in plan, name


def test_files_out_of_range_stay_closed(spark, tmp_path):
    bars = queries._bars(spark, DATA)
    market.write_klines(bars, str(tmp_path / "k"))
    columns = "ts timestamp_ntz, open double, high double, low double, close double, volume double"
    found = market.read_klines_between(spark, str(tmp_path / "k"), columns, "2024-01-04 07:00:00", "2024-01-06", ["click", "view"])
    want = bars.where("symbol IN ('click', 'view') AND ts >= TIMESTAMP_NTZ '2024-01-04 07:00:00' AND ts < TIMESTAMP_NTZ '2024-01-06'").select(found.columns)
    assert found.count() == want.count() > 10 and found.exceptAll(want).count() == 0
    scan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "day#" in scan.split("PartitionFilters: [")[1].split("]")[0] and "GreaterThanOrEqual(ts" in scan
    day = F.regexp_extract(F.input_file_name(), "day=([^/]+)", 1)
    days = {r[0] for r in market.read_klines_between(spark, str(tmp_path / "k"), columns, "2024-01-04 07:00:00", "2024-01-06").select(day).distinct().collect()}
    assert days == {"2024-01-04", "2024-01-05"}
    for part in (tmp_path / "k").glob("symbol=*/day=2024-01-1*/*.parquet"):
        part.write_bytes(b"not a table")  # would fail if it were opened
    assert found.count() == want.count()
    assert market.read_klines_between(spark, str(tmp_path / "k"), columns, "2030-01-01").count() == 0
