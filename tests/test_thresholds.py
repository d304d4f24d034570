"""Thresholds by tree and weight, and category sets of the level-wise grower."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rarefy.operators import levelwise
from rarefy.operators.ensemble import BalancedTreeEnsemble, TreeParams
from rarefy.operators.features import feature_arity
from rarefy.operators.thresholds import bin_by_tree, tree_thresholds
from rarefy.session import discard

SCHEMA = "tree int, w double, y double, a double, b double"


def _cuts(df, features, max_bins, **kw):
    found = tree_thresholds(df, features, max_bins, **kw)
    rows = {(r["tree"], r["f"]): r["thresholds"] for r in found.collect()}
    discard(found)
    return rows


def _exact(x, w, max_bins):
    """Split points of one tree's values by plain Python."""
    values = sorted(set(x))
    weight = {v: sum(wi for xi, wi in zip(x, w) if xi == v) for v in values}
    total, cum, out = sum(weight.values()), 0.0, []
    for v, up in zip(values, values[1:]):
        before, cum = cum, cum + weight[v]
        if len(values) <= max_bins or math.floor(cum * max_bins / total) > math.floor(before * max_bins / total):
            out.append(v + (up - v) / 2)
    return out


def test_exact_where_values_fit_the_grid(spark):
    rng = np.random.default_rng(0)
    rows = [(t, float(rng.integers(1, 6)), 0.0, float(rng.integers(0, 90)) * (t + 1), float(rng.integers(0, 3)))
            for t in range(3) for _ in range(700)]
    got = _cuts(spark.createDataFrame(rows, SCHEMA), ["a", "b"], 16)
    for t in range(3):
        mine = [r for r in rows if r[0] == t]
        for f in (0, 1):
            assert got[t, f] == _exact([r[3 + f] for r in mine], [r[1] for r in mine], 16)
    assert got[0, 0] != got[1, 0]


def test_weights_count(spark):
    """A row drawn a thousand times holds most quantiles next to its own value."""
    rows = [(0, 1.0, 0.0, float(i), 0.0) for i in range(100)] + [(0, 1000.0, 0.0, 50.0, 0.0)]
    got = _cuts(spark.createDataFrame(rows, SCHEMA), ["a", "b"], 8)
    assert got == {(0, 0): [50.5]}  # b has one value: no row


@pytest.mark.parametrize("factor", [4, 32])
def test_rank_error_on_a_coarse_grid(spark, factor):
    rng = np.random.default_rng(1)
    rows = [(t, float(rng.integers(1, 4)), 0.0, float(v), 0.0)
            for t in range(2) for v in rng.lognormal(t, 1.5, 6000)]
    got = _cuts(spark.createDataFrame(rows, SCHEMA).repartition(7), ["a"], 8, grid_factor=factor)
    for t in range(2):
        x, w = (np.array(c) for c in zip(*[(r[3], r[1]) for r in rows if r[0] == t]))
        ranks = [w[x <= cut].sum() / w.sum() for cut in got[t, 0]]
        assert ranks == sorted(ranks) and len(ranks) <= 7
        # A pooled cell holds 1 / (8 * factor) of all rows: at most twice that in one of two trees.
        assert all(min(abs(r - i / 8) for i in range(1, 8)) < 2.5 / (8 * factor) for r in ranks), (t, ranks)


def test_partitioning_does_not_matter(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(0, float(rng.integers(1, 9)) / 8, 0.0, float(rng.integers(0, 500)), 1.0)
                                for _ in range(3000)], SCHEMA)
    assert _cuts(df.coalesce(1), ["a"], 16) == _cuts(df.repartition(11), ["a"], 16)


def test_empty_null_and_constant(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert _cuts(empty, ["a", "b"], 8) == {}
    rows = [(0, 1.0, 0.0, None, 1.0), (0, 1.0, 0.0, math.nan, 1.0), (0, 1.0, 1.0, 2.0, 1.0), (1, 1.0, 1.0, 3.0, 1.0),
            (0, 1.0, 1.0, 4.0, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = tree_thresholds(df, ["a", "b"], 8)
    assert [tuple(r) for r in found.collect()] == [(0, 0, [3.0])]
    bins = sorted((r["tree"], str(r["a"]), r["bins"]) for r in bin_by_tree(df, ["a", "b"], found).collect())
    # NULL and NaN lie above the last threshold; tree 1 has none.
    assert bins == [(0, "2.0", [0, 0]), (0, "4.0", [1, 0]), (0, "None", [1, 0]), (0, "nan", [1, 0]), (1, "3.0", [0, 0])]
    model = levelwise.grow(df, ["a", "b"], TreeParams("gini", 2, 8), per_tree=True)
    leaves = {(r["tree"], r["node"]): (r["n"], r["prediction"]) for r in model.nodes.where("is_leaf").collect()}
    # 2.0 alone goes left; 4.0 and the unknown values share the bin on the right.
    assert leaves == {(0, 2): (1.0, 1.0), (0, 3): (3.0, 1 / 3), (1, 1): (1.0, 1.0)}


def test_trees_split_at_their_own_values(spark):
    rows = [(t, 1.0, float(i >= 30), float(i * 10 ** t), 0.0) for t in range(3) for i in range(60)]
    model = levelwise.grow(spark.createDataFrame(rows, SCHEMA), ["a", "b"], TreeParams("gini", 1, 64), per_tree=True)
    roots = {r["tree"]: r["threshold"] for r in model.nodes.where("node = 1").collect()}
    assert roots == {0: 29.5, 1: 295.0, 2: 2950.0}
    scored = model.tree_probabilities(spark.createDataFrame([(0.0, 0.0), (300.0, 0.0)], "a double, b double"))
    assert [r["p1s"] for r in scored.orderBy("a").collect()] == [[0.0] * 3, [1.0, 1.0, 0.0]]


# -- category sets ---------------------------------------------------------------------

def test_category_sets_match_spark_ml(spark):
    from pyspark.ml.feature import VectorAssembler, VectorIndexer
    from pyspark.ml.regression import DecisionTreeRegressor
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 9, 4000)
    other = rng.integers(0, 20, 4000)
    rate = np.array([.5, .1, .8, .3, .05, .6, .2, .9, .4])[codes] * np.where(other > 11, 1.0, 0.6)
    y = (rng.random(4000) < rate).astype(float)
    df = spark.createDataFrame([(0, 1.0, *map(float, r)) for r in zip(y, codes, other)], SCHEMA)
    vec = VectorAssembler(inputCols=["a", "b"], outputCol="raw").transform(df)
    vec = VectorIndexer(inputCol="raw", outputCol="x", maxCategories=9).fit(vec).transform(vec)
    theirs = DecisionTreeRegressor(featuresCol="x", labelCol="y", maxDepth=3, maxBins=32, predictionCol="p").fit(vec)
    ours = levelwise.grow(df, ["a", "b"], TreeParams("gini", 3, 32), per_tree=True, categorical={0: 9})
    both = theirs.transform(ours.tree_probabilities(vec)).select((F.col("p") - F.col("p1s")[0]).alias("d"))
    assert both.agg(F.max(F.abs("d"))).first()[0] < 1e-12
    assert ours.nodes.where("left_codes is not null and threshold is null").count() > 0


@pytest.mark.parametrize("per_tree", [True, False])
def test_many_categories_and_unknown_codes(spark, per_tree):
    """Odd codes of 200 are the minority; unknown and NULL codes go right."""
    rows = [(0, 1.0, float(i % 2), float(i), 0.0) for i in range(200)] + [(0, 1.0, 1.0, None, 0.0)]
    model = levelwise.grow(spark.createDataFrame(rows, SCHEMA), ["a", "b"], TreeParams("gini", 2, 256),
                           per_tree=per_tree, categorical={0: 200})
    root = model.nodes.where("node = 1").first()
    assert root["left_codes"] == list(range(0, 200, 2)) and root["threshold"] is None
    probe = spark.createDataFrame([(float(i),) for i in range(200)] + [(None,), (5000.0,), (math.nan,)], "a double")
    got = {str(r["a"]): r["p1s"][0] for r in model.tree_probabilities(probe.withColumn("b", F.lit(0.0))).collect()}
    assert got == {str(float(i)): float(i % 2) for i in range(200)} | {"None": 1.0, "5000.0": 1.0, "nan": 1.0}


def test_category_arguments(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0, 1.0, 0.0)], SCHEMA)
    for bad in ({0: 9}, {2: 3}, {0: 0}):
        with pytest.raises(ValueError):
            levelwise.grow(df, ["a", "b"], TreeParams("gini", 2, 8), categorical=bad)
    with pytest.raises(ValueError):
        BalancedTreeEnsemble(thresholds="global")


def test_learner_saves_and_loads_category_sets(spark, tmp_path):
    from pyspark.ml.feature import VectorAssembler
    rng = np.random.default_rng(5)
    rows = [(i, 1 if c in (1, 4) and v > 3 else -1, float(c), float(v))
            for i, (c, v) in enumerate(zip(rng.integers(0, 6, 900), rng.integers(0, 10, 900)))]
    df = VectorAssembler(inputCols=["c", "v"], outputCol="indexedFeatures").transform(
        spark.createDataFrame(rows, "idn long, label int, c double, v double"))
    model = BalancedTreeEnsemble(TreeParams("entropy", 4, 16), feature_names=["c", "v"], categories={0: 6}).fit(df)
    scored = model.predict(df).select("idn", "label", "predicted_label")
    assert scored.where("label <> predicted_label").count() == 0
    model.save(str(tmp_path / "m"))
    again = levelwise.LevelwiseEnsembleModel.load(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, again.predict(df).select("idn", "label", "predicted_label").collect())) \
        == sorted(map(tuple, scored.collect()))
    from rarefy.plans.experiment import dump_lines
    assert dump_lines(model.nodes, ["c", "v"]).where("line like '%(c in {%'").count() > 0


def test_wide_arity(spark):
    df = spark.createDataFrame([(float(i % 40), float(i), None, 1.0) for i in range(500)],
                               "a double, b double, c double, d double")
    got = {r["feature"]: (r["arity"], r["categorical"]) for r in feature_arity(df, ["a", "b", "c", "d"], 40).collect()}
    assert got == {"a": (40, True), "b": (None, False), "c": (0, True), "d": (1, True)}
    assert feature_arity(df.limit(0), ["a"], 5).first()["arity"] == 0
