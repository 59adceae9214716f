"""Plans: pruned scans, partial aggregates, no pairwise or single-task stages."""

import subprocess
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from tidebook.operators.series import Series, measure_cuts
from tidebook.plans.market import Market

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


NARROW = ["bars_hourly", "sma", "fifo_trades", "sweep_ranked", "asof_nearest_snap", "pretrade_screen",
          "vector_equity", "trade_stats", "time_in_market", "walk_forward", "chain_price", "book_at_end"]


@pytest.mark.parametrize("name", NARROW)
def test_no_cartesian_and_no_unpartitioned_window(spark, name):
    plan = plan_of(entry_module.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    for line in plan.splitlines():
        if "Window [" in line:
            assert "], [], [" not in line
    assert "BatchEvalPython" not in plan


def test_bars_read_only_their_columns_and_combine_first(spark):
    plan = plan_of(Market(spark, SF).bars)
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string,value:double,props:string>" in plan
    assert "partial_max" in plan


def test_one_shuffle_for_a_whole_backtest(spark):
    plan = plan_of(entry_module.queries()["vector_equity"](spark, SF))
    # one for the bars, one for the series; every later window reuses it
    assert plan.count("Exchange hashpartitioning") == 2


def test_split_series_partition_by_block(spark):
    m = Market(spark, SF)
    cuts = measure_cuts(m.ticks, ("symbol",), "ts", rows_per_block=50)
    s = Series.of("symbol", ("ts", "seq"), cuts)
    plan = plan_of(s.number(m.ticks, "n"))
    assert "hashpartitioning(symbol" in plan and "_s_blk" in plan


def test_tasks_carry_their_helpers(tmp_path):
    """Executors and streaming workers have no copy of the package."""
    from tidebook.operators.options import solve_vol
    from tidebook.streaming.processors import Orders

    blob = tmp_path / "helpers"
    blob.write_bytes(cloudpickle.dumps((solve_vol, Orders())))
    code = (
        "import pickle, sys; fn, p = pickle.load(open(sys.argv[1], 'rb')); "
        "assert 'tidebook' not in sys.modules; print(type(p).__name__)"
    )
    run = [sys.executable, "-c", code, str(blob)]
    out = subprocess.run(run, cwd=tmp_path, capture_output=True, text=True, check=True)
    assert out.stdout.strip() == "Orders"


def test_tasks_of_sorted_series_stay_small(spark):
    """Tasks are cut by shuffled bytes, however many rows these hold when they compress well."""
    df = Market(spark, SF).spark.range(4_000_000, numPartitions=4).selectExpr("id % 400000 AS k", "id", "repeat('x', 40) AS text")
    sorted_rows = df.repartition("k").sortWithinPartitions("k", "id")
    most = sorted_rows.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 700_000


def test_losses_are_counted_once(spark):
    """What both passes of the guard read is a table, not the trades once more."""
    plan = plan_of(entry_module.queries()["stoploss_guard"](spark, SF))
    assert "lineitem" not in plan and "stage-" in plan
