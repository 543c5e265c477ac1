"""Percentile ranks after releases, against a rank over all rows."""

import random

import pytest
from pyspark.sql.readwriter import DataFrameWriter

from trackengine.operators import order_runs, ranks
from trackengine.sources import scratch

SCHEMA = "id long, x double"


def test_releases_with_deletions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(order_runs, "MOST_RUNS", 3)
    draw, path = random.Random(4), f"file://{tmp_path}/o"
    value = lambda: draw.choice([None, float("nan"), -0.0, 0.0, *(draw.randrange(-40, 40) / 4 for _ in range(6))])
    held = {k: value() for k in range(300)}
    frame = lambda rows: spark.createDataFrame(list(rows), SCHEMA)
    runs = order_runs.OrderRuns.create(frame(held.items()), path, "x", ranges=5)
    for release in range(5):
        went = {k: held.pop(k) for k in draw.sample(sorted(held), 40)}
        came = {1000 * (release + 1) + k: value() for k in range(30)}
        held |= came
        if release == 3:  # one that fails changes nothing
            real = DataFrameWriter.text
            with monkeypatch.context() as patch:
                patch.setattr(DataFrameWriter, "text", lambda *a, **b: (_ for _ in ()).throw(OSError("lost")))
                with pytest.raises(OSError):
                    runs.apply(frame(came.items()), frame(went.items()), "x")
            assert DataFrameWriter.text is real
            runs = order_runs.OrderRuns.open(spark, path)
        runs.apply(frame(came.items()), frame(went.items()), "x")
        rows = frame((k, None if x is None or x != x else x + 0.0) for k, x in held.items())
        for ascending in (True, False):
            want = {r["id"]: r["p"] for r in ranks.percentile_rank(rows, "x", ascending, "p").collect()}
            got = {r["id"]: r["p"] for r in runs.rank_rows(rows, "x", "p", ascending).collect()}
            assert got == want, (release, ascending)
    assert len(runs.state["runs"]) <= 3 and runs.state["release"] == 5
    assert order_runs.OrderRuns.open(spark, path).state == runs.state


def test_a_release_touches_its_ranges_only(spark, tmp_path):
    path = f"file://{tmp_path}/o"
    rows = spark.range(1000).selectExpr("id", "cast(id as double) as x")
    runs = order_runs.OrderRuns.create(rows, path, "x", ranges=10)
    runs.apply(rows.filter("id = 500"), rows.filter("id in (510, 520)"), "x")
    last = runs.state["runs"][-1]
    assert len([n for n in scratch.names_in(spark, f"{path}/runs/{last}") if n.startswith("range=")]) == 1
    assert [(r["id"], r["p"]) for r in runs.rank_rows(rows.filter("id = 995"), "x", "p").collect()] == [(995, 100)]
    plan = runs.ranks(True, [9])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(range") + plan.count("PartitionFilters: [(range#") + plan.count("PartitionFilters: [range#") >= 2
    with pytest.raises(ValueError):
        order_runs.OrderRuns.open(spark, f"file://{tmp_path}/none")
