"""Work of bootstraps and growth that must not follow constants of the plan."""

import threading

from pyspark.sql import functions as F

from rarefy.operators import ensemble, levelwise, neighbours, prefix, sampling
from rarefy.operators.ensemble import TreeParams
from rarefy.operators.thresholds import bin_by_tree, feature_thresholds
from rarefy.operators.votes import combine
from rarefy.plans import experiment
from rarefy.sources import fixtures


def _rows(spark, n=4000):
    return spark.range(n).select(
        F.col("id").alias("idn"), F.when(F.col("id") % 10 == 0, 1).otherwise(-1).alias("label"),
        *[(F.floor(F.col("id") / k) % 2).cast("double").alias(f"b{k}") for k in (1, 3, 7)])


def test_bootstrap_draws_no_uniform_per_step_of_the_cdf(spark):
    bal = sampling.balanced_sets(_rows(spark), keep=["idn", "label"])
    plan = bal._jdf.queryExecution().optimizedPlan().toString()
    # One for the total, one for a copy's tree: none within the search of the CDF, none again in a filter.
    assert plan.count("md5(") == 2, plan
    got = bal.where("label = -1").agg(F.sum("w"), F.countDistinct("tree")).first()
    want = 9 * 400
    assert abs(got[0] - want) < 5 * want ** 0.5 and got[1] == 9


def test_bootstrap_weights_name_their_id(spark):
    rows = _rows(spark, 400)
    plan = sampling.balance_plan(rows)
    majority = rows.where("label <> 1")
    want = sorted(map(tuple, sampling.bootstrap_weights(majority, plan).collect()))
    other = sampling.bootstrap_weights(majority.withColumnRenamed("idn", "key"), plan, idn="key")
    assert other.columns == ["tree", "idn", "w"] and sorted(map(tuple, other.collect())) == want


def test_rows_of_equal_bins_grow_as_one(spark, monkeypatch):
    bal = sampling.balanced_sets(_rows(spark), keep=["idn", "label", "b1", "b3", "b7"])
    bal = bal.withColumn("y", F.when(F.col("label") == 1, 1.0).otherwise(0.0))
    seen, own = [], levelwise._histogram
    monkeypatch.setattr(levelwise, "_histogram", lambda state: (seen.append(state.count()), own(state))[1])
    features, params = ["b1", "b3", "b7"], TreeParams("gini", 2, 32)
    merged = levelwise.grow(bal, features, params)
    assert max(seen) <= 9 * 8 * 2
    monkeypatch.setattr(levelwise, "MAX_CELLS", 0)
    plain = levelwise.grow(bal, features, params)
    assert max(seen) > 9 * 8 * 2
    assert sorted(map(tuple, merged.nodes.collect()), key=str) == sorted(map(tuple, plain.nodes.collect()), key=str)


def test_quantiles_are_taken_of_wide_features_only(spark):
    df = spark.range(5000).select((F.col("id") % 2).cast("double").alias("two"), (F.col("id") / 7).alias("wide"),
                                  F.lit(None).cast("double").alias("none"))
    two, wide, none = feature_thresholds(df, ["two", "wide", "none"], 8)
    assert two == [0.5] and none == [] and len(wide) == 7 and wide == sorted(wide)
    assert feature_thresholds(df, [], 8) == []


def test_places_by_tree_look_their_thresholds_up_once(spark):
    rows = spark.createDataFrame([(0, 1.0, 0.5), (1, 1.0, 7.0), (1, 1.0, None), (2, 1.0, float("nan"))],
                                 "tree int, w double, x double")
    cuts = spark.createDataFrame([(0, 0, [0.5, 1.0, 2.0]), (1, 0, [1.0, 6.5, 8.0])], "tree int, f int, thresholds array<double>")
    found = bin_by_tree(rows, ["x"], cuts)
    assert sorted(r["bins"][0] for r in found.where("tree < 2").collect()) == [0, 2, 3]
    step = found._jdf.queryExecution().optimizedPlan().toString().split("lambdafunction(CASE")[1].split("lambda at")[0]
    assert "_cuts" not in step.split(", lambda")[0]


def test_votes_sum_logarithms_once(spark):
    rows = spark.createDataFrame([(1, [0.25, 0.75, 0.5]), (2, [1.0, 0.0]), (3, [])], "idn int, p1s array<double>")
    out = combine(rows, "soft")
    assert out.columns == ["idn", "p1s", "n_trees", "n_votes", "p0", "p1", "predicted_label"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("aggregate(p1s") == 2
    assert [(round(r.p1, 6), r.n_votes, r.predicted_label) for r in out.orderBy("idn").collect()] == [
        (0.5, 1, -1), (0.5, 1, -1), (0.5, 0, -1)]


def test_positions_equal_running_totals_without_a_second_shuffle(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.floor(F.col("id") / 700)).alias("k"),
                                    (F.col("id") * 7919 % 3001).alias("id"))
    own = prefix.positions(rows, ["k", "id"], buckets=16)
    whole = prefix.running_totals(rows, ["k", "id"], buckets=16)
    assert sorted(map(tuple, own.select("id", "pos").collect())) == sorted(map(tuple, whole.select("id", "pos").collect()))
    assert sorted(own.columns) == sorted(whole.columns)
    # Windows and shuffles of the one-row-a-bucket table only.
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan and "Exchange hashpartitioning(_bucket" not in plan.split("BroadcastExchange")[0]


def test_rows_that_stay_anyway_are_not_searched(spark):
    rows = spark.range(900).select(F.col("id"), F.when(F.col("id") % 5 == 0, 1).otherwise(-1).alias("y"),
                                   F.array(*[(F.col("id") * k % 101).cast("double") for k in (1, 7, 13)]).alias("x"),
                                   F.col("id").alias("_row"))
    whole = neighbours.nearest_neighbours(rows, 3, block=64, tables=2)
    part = neighbours.nearest_neighbours(rows, 3, block=64, tables=2, skip=1)
    want = {r["_row"]: r["near"] for r in whole.collect() if r["_row"] % 5}
    assert {r["_row"]: r["near"] for r in part.collect()} == want


def test_fits_at_once_overlap_and_change_no_report(spark, small_dir, monkeypatch):
    running, most, lock, own = [0], [0], threading.Lock(), ensemble.BalancedTreeEnsemble.fit
    both = threading.Barrier(2)

    def fit(self, df):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        try:
            if at_once > 1:
                both.wait(timeout=120)
            return own(self, df)
        finally:
            with lock:
                running[0] -= 1
    monkeypatch.setattr(ensemble.BalancedTreeEnsemble, "fit", fit)
    made = []
    for at_once in (1, 2):
        most[0] = 0
        cfg = experiment.ExperimentConfig(runs=1, impurities=("gini",), depths=(1,), bins=(8,),
                                          balancings=("balanced", "kmeans"),
                                          features=["monto", "is_purchase"], reports=("confusion",), fit_at_once=at_once)
        found = experiment.run_experiment(fixtures.transactions(spark, small_dir), cfg)["confusion"].collect()
        made.append(sorted(map(str, found)))
        assert len(found) == 4 and most[0] == at_once
    assert made[0] == made[1]
