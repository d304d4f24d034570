"""The score table of many scored sets, and ensembles that grow together."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rarefy.operators import detection, metrics
from rarefy.operators.ensemble import BalancedTreeEnsemble, TreeParams, fit_together
from rarefy.operators.score_table import score_table
from rarefy.plans import experiment
from rarefy.sources import fixtures

SCHEMA = "k int, g int, score double, label int, predicted_label int"


def _sets(spark, seed=3):
    """Four scored sets: many ties, hardly any, one class only, one score only; and a NULL label."""
    rng = random.Random(seed)
    rows = [(1, 0, float(rng.randint(-4, 4)), rng.choice([1, -1, -1]), rng.choice([1, -1])) for _ in range(200)]
    rows += [(1, 1, rng.gauss(0, 2), rng.choice([1, -1]), rng.choice([1, -1])) for _ in range(150)]
    rows += [(2, 0, rng.gauss(0, 2), -1, rng.choice([1, -1])) for _ in range(40)]
    rows += [(2, 1, 0.25, rng.choice([1, -1]), -1) for _ in range(30)]
    rows += [(1, 0, None, 1, 1), (1, 0, None, -1, -1), (1, 1, 0.5, None, 1)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def sets(spark):
    df = _sets(spark).cache()
    return df, score_table(df, ["k", "g"], F.col("score"), F.col("label") == 1, F.col("predicted_label"), buckets=4)


def _alone(df, k, g):
    own = df.where(f"k = {k} AND g = {g} AND label IS NOT NULL")
    return own, own.withColumn("lr", F.col("score")).withColumn("flag", (F.col("label") == 1).cast("int"))


def _brute_eer(pairs, mode):
    """Every row (reference) or distinct score (standard) looked at in order."""
    nf, nl = sum(f for _, f in pairs), sum(1 - f for _, f in pairs)
    if not nf or not nl:
        return None, None, 0
    seen = []
    if mode == "standard":
        for s in sorted({s for s, _ in pairs}):
            cf = sum(f for v, f in pairs if v <= s)
            cl = sum(1 - f for v, f in pairs if v <= s)
            seen.append((abs(cf * nl - (nl - cl) * nf), s, (nl - cl) / nl))
    else:
        cf = 0
        for i, (s, f) in enumerate(sorted(pairs, key=lambda p: (p[0], -p[1]))):
            cf += f
            seen.append((abs((i - cf) * nl - (nl - cf) * nf), s, (nl - cf) / nl))
    least = [c for c in seen if c[0] == min(x[0] for x in seen)]
    gap, s, pfa = least[(len(least) + 1) // 2 - 1]
    return round(pfa * 100, 6), s, int(gap / (nf * nl) <= 1e-5)


@pytest.mark.parametrize("mode", ["standard", "reference"])
def test_eer_of_every_set_equals_the_rows(sets, mode):
    df, table = sets
    got = {(r["k"], r["g"]): (r["eer"], r["lr"], r["state"]) for r in table.eer(mode).collect()}
    assert len(got) == 4
    for (k, g), found in got.items():
        pairs = [(r["score"], int(r["label"] == 1)) for r in df.where(
            f"k = {k} AND g = {g} AND label IS NOT NULL AND score IS NOT NULL").collect()]
        want = _brute_eer(pairs, mode)
        assert found[1:] == want[1:] and found[0] == pytest.approx(want[0])


def test_unequal_classes_and_single_rows(spark):
    rng = random.Random(9)
    rows = []
    for g in range(40):
        n, share = rng.randint(1, 12), rng.choice([0.1, 0.5, 0.9])
        rows += [(0, g, float(rng.randint(0, 3)), 1 if rng.random() < share else -1, 1) for _ in range(n)]
    df = spark.createDataFrame(rows, SCHEMA)
    table = score_table(df, ["g"], F.col("score"), F.col("label") == 1)
    for mode in ("standard", "reference"):
        for r in table.eer(mode).collect():
            want = _brute_eer([(s, int(y == 1)) for _, g, s, y, _ in rows if g == r["g"]], mode)
            assert (r["lr"], r["state"]) == want[1:] and r["eer"] == pytest.approx(want[0])


def test_areas_confusion_and_roc_of_every_set(sets):
    df, table = sets
    area, hard = ({(r["k"], r["g"]): r["auc"] for r in f.collect()} for f in (table.area(), table.hard_area()))
    counts = {(r["k"], r["g"]): r for r in table.confusion().collect()}
    roc = table.hard_roc().collect()
    for k, g in counts:
        own, _ = _alone(df, k, g)
        assert area[k, g] == metrics.auc(own, "score", digits=None).first()["auc"]
        assert hard[k, g] == metrics.auc(own, "predicted_label", digits=None).first()["auc"]
        one = metrics.confusion_counts(own).first()
        assert all(counts[k, g][c] == one[c] for c in ("tp", "fn", "tn", "fp"))
        want = sorted(map(tuple, metrics.roc_points(own, "predicted_label", digits=None).collect()), key=str)
        assert sorted([(r["pos"], r["fpr"], r["tpr"]) for r in roc if (r["k"], r["g"]) == (k, g)], key=str) == want


def test_density_and_curves_of_every_set(sets):
    df, table = sets
    dens, curves = table.density(-3, 3).toPandas(), table.curves(20).toPandas()
    bands = table.bandwidth().toPandas()
    for k, g in ((1, 0), (1, 1), (2, 0), (2, 1)):
        _, lr = _alone(df, k, g)
        for flag, name, small in ((1, "Fraude", "fraude"), (0, "Legal", "legal")):
            def mine(frame):
                return frame[(frame.k == k) & (frame.g == g) & (frame.flag == flag)]
            want = detection.density(lr, -3, 3, digits=None).where(f"type = '{name}'").orderBy("x").toPandas()
            got = mine(dens).sort_values("x")
            assert len(got) == len(want)
            if len(want):
                assert np.allclose(got["y"].astype(float), want["y"].astype(float), rtol=1e-9, equal_nan=True)
            band = detection.bandwidth(lr).where(f"flag = {flag}").toPandas()
            assert np.allclose(mine(bands)[["n", "sd", "h"]].astype(float), band[["n", "sd", "h"]].astype(float), rtol=1e-9)
            line = detection.score_curves(lr, 20, digits=None).where(f"type = '{small}'").orderBy("i").toPandas()
            got = mine(curves).sort_values("i")
            assert np.allclose(got[["x", "y"]].astype(float), line[["x", "y"]].astype(float), equal_nan=True)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    table = score_table(empty, ["k", "g"], F.col("score"), F.col("label") == 1, F.col("predicted_label"))
    for frame in (table.eer("reference"), table.area(), table.hard_area(), table.hard_roc(), table.density(-1, 1),
                  table.curves(5), table.confusion()):
        assert frame.count() == 0


def test_one_range_exchange(spark):
    """The table is ranged once; every evaluator reads it without another order over all rows."""
    table = score_table(_sets(spark), ["k", "g"], F.col("score"), F.col("label") == 1, F.col("predicted_label"))
    for frame in (table.eer("standard"), table.eer("reference"), table.area(), table.density(-2, 2), table.curves(10)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan and "Exchange SinglePartition" not in plan


def _trees(model):
    return sorted(map(str, model.nodes.collect()))


def test_ensembles_grown_together_equal_those_alone(spark, small_dir):
    data, _, names = experiment.prepare(fixtures.transactions(spark, small_dir), list(fixtures.BINARY_FEATURES))
    made = [BalancedTreeEnsemble(p, feature_names=names, seed=s) for p, s in (
        (TreeParams("gini", 3, 16), "1"), (TreeParams("entropy", 2, 16), "2"), (TreeParams("gini", 0, 16), "3"))]
    sides = [data.where("idn % 3 <> 0"), data, data.where("idn % 2 = 0")]
    for alone, frame, model in zip(made, sides, fit_together(made, sides)):
        want = alone.fit(frame)
        assert _trees(model) == _trees(want)
        assert (model.num_trees, model.model.params) == (want.num_trees, want.model.params)
        score = model.predict(frame).select("idn", "p1", "predicted_label")
        assert score.exceptAll(want.predict(frame).select("idn", "p1", "predicted_label")).count() == 0


def test_growing_together_needs_one_kind_of_ensemble(spark, small_dir):
    data, _, names = experiment.prepare(fixtures.transactions(spark, small_dir), list(fixtures.BINARY_FEATURES))
    with pytest.raises(ValueError, match="max_bins"):
        fit_together([BalancedTreeEnsemble(TreeParams("gini", 1, b), feature_names=names) for b in (8, 16)], [data, data])
    with pytest.raises(ValueError, match="level-wise"):
        fit_together([BalancedTreeEnsemble(feature_names=names, engine="ml")], [data])


@pytest.mark.parametrize("shared", [False, True])
def test_reports_do_not_depend_on_growing_together(spark, small_dir, shared):
    def rows(together):
        cfg = experiment.ExperimentConfig(runs=2, impurities=("gini", "entropy"), depths=(1, 2), bins=(8,),
                                          features=list(fixtures.BINARY_FEATURES), split_per_grid_point=shared,
                                          reports=("confusion", "nodes"), grow_together=together)
        made = experiment.run_experiment(fixtures.transactions(spark, small_dir), cfg)
        return {name: sorted(map(str, frame.collect())) for name, frame in made.items()}
    assert rows(1) == rows(3)
