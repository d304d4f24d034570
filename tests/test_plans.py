"""Physical-plan properties: pushdown, pruning, shuffle shape."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from rarefy.operators import levelwise, sampling
from rarefy.operators.ensemble import BalancedTreeEnsemble, TreeParams
from rarefy.operators.prefix import running_totals
from rarefy.plans import catalog, experiment
from rarefy.session import scratch_path
from rarefy.sources import fixtures
from rarefy.sources.tables import materialise, read_table, scan


def plan_of(df, mode="formatted"):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def test_scan_filter_and_projection_reach_parquet(spark, small_dir):
    q = scan(read_table(spark, small_dir, "events"), ["event_id", "value"], "value < 5")
    p = plan_of(q)
    assert "LessThan(value,5.0)" in p
    assert "ReadSchema: struct<event_id:bigint,value:double>" in p


def test_tree_partition_is_pruned(spark):
    path = scratch_path(spark, "prune-check")
    (spark.range(100).select((F.col("id") % 4).cast("int").alias("tree"), "id")
     .write.mode("overwrite").partitionBy("tree").parquet(path))
    p = plan_of(spark.read.parquet(path).where(F.col("tree") == 2))
    assert re.search(r"PartitionFilters: \[.*\(tree#\d+ = 2\)", p)


def test_running_totals_window_is_partitioned(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    p = plan_of(running_totals(df, ["k", "id"], {"c": F.lit(1)}), "simple")
    # The row-level window is partitioned by the range bucket; only the
    # bucket-offset table (one row per bucket) is ordered globally.  Both read
    # the one written table of ranged rows: no second range exchange.
    assert "rangepartitioning" not in p
    assert re.search(r"Window \[.*\], \[_bucket#\d+\]", p)


def test_vote_scoring_has_no_exchange(spark, small_dir):
    votes = fixtures.tree_vote_arrays(spark, small_dir)
    from rarefy.operators.votes import combine
    p = plan_of(combine(votes.select("idn", "label", "p1s"), "soft").select("p1"), "simple")
    # Only the fixture's own window exchange; the combiner adds none.
    assert p.count("Exchange") == fixtures_exchange_count(spark, small_dir)


def fixtures_exchange_count(spark, small_dir):
    return plan_of(fixtures.tree_vote_arrays(spark, small_dir).select("p1s"), "simple").count("Exchange")


def _fit(spark, small_dir, engine, **params):
    data, _, names = experiment.prepare(fixtures.transactions(spark, small_dir),
                                        list(fixtures.FEATURES))
    tr, te = sampling.train_test(data, 0.7, "0")
    return BalancedTreeEnsemble(TreeParams("gini", 3, 8), "indexedFeatures", names, engine=engine,
                                **params).fit(tr), te


@pytest.mark.parametrize("engine", ["levelwise", "ml"])
def test_scoring_is_row_local(spark, small_dir, engine):
    model, te = _fit(spark, small_dir, engine)
    before, after = plan_of(te, "simple"), plan_of(model.predict(te), "simple")
    for node in ("Exchange", "Generate", "Join", "Subquery"):
        assert after.count(node) == before.count(node)
    assert after.count("Project") <= before.count("Project") + 5  # no step per tree


def test_level_plan_reads_the_state_once(spark):
    rows = [(i % 3, 1.0, float(i % 2), [i % 4, i % 2], 1) for i in range(60)]
    state = materialise(spark.createDataFrame(
        rows, "tree int, w double, y double, bins array<int>, node bigint"))
    p = plan_of(levelwise._histogram(state), "simple")
    assert p.count("FileScan") == 1 and p.count("Generate") == 1 and p.count("Exchange") == 1


@pytest.mark.parametrize("name,points", [
    ("experiment_report", {(1, "gini")}),
    ("experiment_grid", {(k, i) for k in range(1, catalog.RUNS + 1) for i in ("gini", "entropy")})])
def test_experiments_score_every_labelled_row(spark, small_dir, name, points):
    rows = catalog.QUERIES[name](spark, small_dir).collect()
    assert {(r.k, r.impurity) for r in rows} == points and len(rows) == 2 * len(points)
    n = catalog.QUERIES["labelled_filter"](spark, small_dir).count()
    scored = dict.fromkeys(points, 0)
    for r in rows:
        scored[r.k, r.impurity] += r.tp + r.fn + r.tn + r.fp
    assert set(scored.values()) == {n}
