"""Property and edge-case tests for operators without an exact SQL twin."""

import math
import uuid
import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rarefy.operators import detection, metrics, sampling, votes
from rarefy.operators.ensemble import BalancedEnsembleModel, BalancedTreeEnsemble, TreeParams
from rarefy.operators.importance import named_importances
from rarefy.operators.prefix import running_totals
from rarefy.plans import experiment
from rarefy.schema import labelled
from rarefy.session import scratch_path
from rarefy.sources import fixtures


# -- running totals ----------------------------------------------------------

def test_running_totals_match_pandas_under_skew(spark):
    rng = np.random.default_rng(7)
    n = 3000
    # A third of all rows share one key: the tie group must still be split.
    key = np.where(rng.random(n) < 0.34, 5.0, rng.integers(0, 50, n).astype(float))
    pdf = pd.DataFrame({"k": key, "idn": np.arange(n), "v": rng.integers(0, 3, n)})
    df = spark.createDataFrame(pdf)
    out = running_totals(df, ["k", "idn"], {"cv": "v"}, buckets=16).toPandas()
    exp = pdf.sort_values(["k", "idn"]).reset_index(drop=True)
    exp["pos"] = np.arange(1, n + 1)
    exp["cv"] = exp["v"].cumsum()
    got = out.sort_values(["k", "idn"]).reset_index(drop=True)
    assert (got["pos"].to_numpy() == exp["pos"].to_numpy()).all()
    assert (got["cv"].to_numpy() == exp["cv"].to_numpy()).all()


# -- balance plan, bootstrap ---------------------------------------------------

@pytest.fixture(scope="module")
def train(spark, small_dir):
    lab = labelled(fixtures.transactions(spark, small_dir))
    tr, _ = sampling.train_test(lab, 0.7, "0")
    return tr.cache()


def test_tree_count_is_odd_and_planned(train):
    plan = sampling.balance_plan(train).first()
    assert plan["n_trees"] % 2 == 1
    assert plan["ratio"] == plan["n_major"] // plan["n_minor"]
    assert plan["n_trees"] in (plan["ratio"], plan["ratio"] + 1)


def test_every_tree_sees_all_minority_rows(train):
    bal = sampling.balanced_sets(train, seed="3", keep=["idn", "label"])
    n_minor = train.where("label = 1").count()
    per_tree = {r["tree"]: r["c"] for r in
                bal.where("label = 1").groupBy("tree").agg(F.count("*").alias("c")).collect()}
    plan = sampling.balance_plan(train).first()
    assert sorted(per_tree) == list(range(plan["n_trees"]))
    assert set(per_tree.values()) == {n_minor}


def test_bootstrap_size_is_balanced(train):
    bal = sampling.balanced_sets(train, seed="11", keep=["idn", "label"])
    plan = sampling.balance_plan(train).first()
    sizes = [r["s"] for r in bal.where("label <> 1").groupBy("tree")
             .agg(F.sum("w").alias("s")).collect()]
    mean = plan["n_minor"]
    for s in sizes:
        assert abs(s - mean) <= 4 * math.sqrt(mean) + 1
    assert all(r["w"] >= 1 for r in bal.select("w").collect())


def test_poisson_counts_have_the_right_mean(spark):
    from rarefy.functions.poisson import poisson_cdf_frame, poisson_count
    from rarefy.functions.hashing import hash_uniform
    cdf = poisson_cdf_frame(spark, F.lit(1.7)).first()["cdf"]
    assert abs(cdf[-1] - 1.0) < 1e-15
    df = spark.range(20000).select(poisson_count(hash_uniform("p:", F.col("id")),
                                                 F.lit(cdf)).alias("n"))
    m, v = df.agg(F.avg("n"), F.var_pop("n")).first()
    assert abs(m - 1.7) < 0.05 and abs(v - 1.7) < 0.1


def test_hash_split_is_partitioning_independent(spark, small_dir):
    lab = labelled(fixtures.transactions(spark, small_dir))
    a = sampling.hash_split(lab.repartition(1)).where("split = 'train'").select("idn")
    b = sampling.hash_split(lab.repartition(7)).where("split = 'train'").select("idn")
    assert sorted(r[0] for r in a.collect()) == sorted(r[0] for r in b.collect())


# -- votes ---------------------------------------------------------------------

def _arrays(spark, rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "idn long, p1s array<double>")


def test_soft_strict_equals_stable_without_underflow(spark):
    df = _arrays(spark, [[0.1, 0.9, 0.6], [0.0, 1.0, 0.5], [0.3, 0.3, 0.3]])
    a = votes.combine(df, "soft", strict=True).orderBy("idn").collect()
    b = votes.combine(df, "soft").orderBy("idn").collect()
    for x, y in zip(a, b):
        assert abs(x["p1"] - y["p1"]) < 1e-12 and abs(x["p0"] - y["p0"]) < 1e-12
        assert 0 <= y["p1"] <= 1 and abs(y["p0"] + y["p1"] - 1) < 1e-12


def test_soft_underflow(spark):
    # 25 pure trees each way: both products underflow to 0.
    df = _arrays(spark, [[0.0] * 25 + [1.0] * 25])
    strict = votes.combine(df, "soft", strict=True).first()
    stable = votes.combine(df, "soft").first()
    assert strict["p1"] is None
    assert abs(stable["p1"] - 0.5) < 1e-12
    # tie in votes and probabilities -> majority
    assert stable["predicted_label"] == -1


def test_soft_or_rule_and_hard_vote(spark):
    # Two trees lean weakly to 1, one strongly to 0: product favours 0, votes favour 1.
    df = _arrays(spark, [[0.6, 0.6, 0.01]])
    soft = votes.combine(df, "soft").first()
    assert soft["p1"] < soft["p0"] and soft["predicted_label"] == 1
    hard = votes.combine(df, "hard").first()
    assert hard["p1"] == pytest.approx(2 / 3) and hard["predicted_label"] == 1
    mean = votes.combine(df, "mean").first()
    assert mean["p1"] == pytest.approx(1.21 / 3) and mean["predicted_label"] == -1


def test_unknown_strategy_warns(spark):
    df = _arrays(spark, [[0.2, 0.9]])
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        out = votes.combine(df, "SOFTISH").first()
    assert any("unknown vote strategy" in str(x.message) for x in w)
    assert out["p1"] == votes.combine(df, "soft").first()["p1"]


# -- evaluators ----------------------------------------------------------------

def _scores(spark, rows):
    return spark.createDataFrame(rows, "idn long, label int, p0 double, p1 double")


def _brute_eer(lr, flag, mode):
    order = sorted(range(len(lr)), key=lambda i: (lr[i], -flag[i], i))
    nf = sum(flag)
    nl = len(flag) - nf
    rows = []
    if mode == "reference":
        cf = 0
        for pos, i in enumerate(order):
            cf += flag[i]
            gap = abs((pos - cf) * nl - (nl - cf) * nf)
            rows.append((gap, (nl - cf) / nl, lr[i]))
    else:
        cf = cl = 0
        vals = sorted(set(lr))
        for v in vals:
            cf += sum(1 for i in range(len(lr)) if lr[i] == v and flag[i] == 1)
            cl += sum(1 for i in range(len(lr)) if lr[i] == v and flag[i] == 0)
            rows.append((abs(cf * nl - (nl - cl) * nf), (nl - cl) / nl, v))
    best = min(r[0] for r in rows)
    cands = [r for r in rows if r[0] == best]
    g, pfa, v = cands[(len(cands) + 1) // 2 - 1]
    return round(pfa * 100, 6), v, int(g / (nf * nl) <= 1e-5)


@pytest.mark.parametrize("mode", ["standard", "reference"])
def test_eer_matches_brute_force(spark, mode):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        y = 1 if rng.random() < 0.3 else -1
        p1 = float(np.clip(rng.normal(0.65 if y == 1 else 0.35, 0.2), 0, 1))
        p1 = round(p1, 2)  # many ties
        rows.append((i, y, 1 - p1, p1))
    df = detection.with_lr(_scores(spark, rows))
    got = detection.eer(df, mode, buckets=8).first()
    pdf = df.toPandas()
    exp = _brute_eer(list(pdf["lr"]), list(pdf["flag"]), mode)
    assert (got["eer"], got["lr"], got["state"]) == exp


def test_eer_empty_class(spark):
    df = detection.with_lr(_scores(spark, [(1, -1, 0.7, 0.3), (2, -1, 0.6, 0.4)]))
    rows = detection.eer(df).collect()
    assert len(rows) == 1 and rows[0]["eer"] is None and rows[0]["state"] == 0


def test_kde_matches_numpy(spark):
    rng = np.random.default_rng(5)
    rows = [(i, 1 if i % 4 == 0 else -1, float(p0), float(1 - p0))
            for i, p0 in enumerate(rng.uniform(0.05, 0.95, 200))]
    df = detection.with_lr(_scores(spark, rows))
    got = {(r["type"], r["x"]): r["y"] for r in detection.density(df, -3, 3, digits=None).collect()}
    pdf = df.toPandas()
    for flag, name in ((1, "Fraude"), (0, "Legal")):
        s = pdf.loc[pdf.flag == flag, "lr"].to_numpy()
        h = s.std() * (4 / (3 * len(s))) ** 0.2
        for x in np.arange(-6, 7) * 0.5:
            exp = np.exp(-((x - s) / h) ** 2 / 2).sum() / (len(s) * h * math.sqrt(2 * math.pi))
            assert got[(name, float(x))] == pytest.approx(exp, rel=1e-9)


def test_kde_zero_variance_is_null(spark):
    df = detection.with_lr(_scores(spark, [(1, 1, 0.2, 0.8), (2, 1, 0.2, 0.8), (3, -1, 0.5, 0.5),
                                           (4, -1, 0.6, 0.4)]))
    dens = detection.density(df, -1, 1).where("type = 'Fraude'").collect()
    assert dens and all(r["y"] is None for r in dens)


def test_curves_endpoints_and_monotone(spark):
    rng = np.random.default_rng(9)
    rows = [(i, 1 if i % 3 == 0 else -1, float(p), float(1 - p))
            for i, p in enumerate(rng.uniform(0.01, 0.99, 300))]
    df = detection.with_lr(_scores(spark, rows))
    cur = detection.score_curves(df, 20).toPandas()
    for _, g in cur.groupby("type"):
        g = g.sort_values("i")
        assert g["y"].iloc[0] == 0.0 and g["y"].iloc[-1] == 1.0
        assert (np.diff(g["y"].to_numpy()) >= 0).all()


def test_curves_degenerate_range(spark):
    df = detection.with_lr(_scores(spark, [(1, 1, 0.5, 0.5), (2, -1, 0.5, 0.5)]))
    cur = detection.score_curves(df, 5).where("type = 'legal'").orderBy("i").toPandas()
    assert list(cur["y"]) == [0.0, 0.0, 0.0, 0.0, 1.0]


def test_confusion_zero_denominators_are_null(spark):
    df = spark.createDataFrame([(-1, -1), (-1, -1)], "label int, predicted_label int")
    r = metrics.confusion_metrics(df).first()
    assert r["tpr"] is None and r["ppv"] is None and r["spc"] == 100.0 and r["mcc"] is None


def test_roc_monotone_and_auc_matches_rank_statistic(spark):
    rng = np.random.default_rng(2)
    y = (rng.random(500) < 0.3).astype(int)
    s = np.round(rng.normal(y * 0.8, 1.0), 1)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(np.where(y == 1, 1, -1), s)],
                               "label int, score double")
    roc = metrics.roc_points(df, "score", digits=None).orderBy("pos").toPandas()
    assert (np.diff(roc["fpr"]) >= 0).all() and (np.diff(roc["tpr"]) >= 0).all()
    area = metrics.auc(df, "score", digits=None).first()["auc"]
    pos, neg = s[y == 1], s[y == 0]
    mw = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum())
    assert area == pytest.approx(mw / (len(pos) * len(neg)), rel=1e-12)


def test_hard_auc_is_balanced_accuracy(spark, small_dir):
    sc = fixtures.scored(spark, small_dir)
    conf = metrics.confusion_metrics(sc, digits=None).first()
    area = metrics.auc(sc, "predicted_label", digits=None).first()["auc"]
    assert area == pytest.approx((conf["tpr"] + conf["spc"]) / 200.0, rel=1e-12)


# -- ensemble --------------------------------------------------------------------

@pytest.fixture(scope="module")
def fitted(spark, small_dir):
    data, _, names = experiment.prepare(fixtures.transactions(spark, small_dir),
                                        list(fixtures.FEATURES))
    tr, te = sampling.train_test(data, 0.7, "0")
    model = BalancedTreeEnsemble(TreeParams("gini", 5, 32), "indexedFeatures", names,
                                 seed="1", engine="ml").fit(tr)
    return model, tr, te


def test_ensemble_tree_count_and_probabilities(fitted):
    model, tr, te = fitted
    plan = sampling.balance_plan(tr).first()
    assert model.num_trees == plan["n_trees"]
    pred = model.predict(te).toPandas()
    assert ((pred["p1"] >= 0) & (pred["p1"] <= 1)).all()
    assert np.allclose(pred["p0"] + pred["p1"], 1.0)
    assert (pred["n_trees"] == model.num_trees).all()
    assert set(pred["predicted_label"]) <= {1, -1}


def test_ensemble_save_load_round_trip(spark, fitted):
    model, _, te = fitted
    path = scratch_path(spark, f"model-{uuid.uuid4().hex}")
    model.save(path)
    again = BalancedEnsembleModel.load(path)
    a = model.predict(te).select("idn", "p1").orderBy("idn").collect()
    b = again.predict(te).select("idn", "p1").orderBy("idn").collect()
    assert a == b and again.num_trees == model.num_trees


def test_ensemble_importances_sum_to_one(spark, fitted):
    from rarefy.operators.ensemble import node_table
    model, _, _ = fitted
    nodes = node_table(model, scratch_path(spark, f"nodes-{uuid.uuid4().hex}"))
    imp = named_importances(nodes, model.feature_names, digits=None).toPandas()
    assert len(imp) == len(model.feature_names)
    assert (imp["importance"] >= 0).all()
    assert imp["importance"].sum() == pytest.approx(1.0)


def test_entropy_ensemble_and_kmeans_balancing(spark, fitted):
    _, tr, te = fitted
    m = BalancedTreeEnsemble(TreeParams("entropy", 4, 16), "indexedFeatures", seed="2",
                             balancing="kmeans", parallelism=2).fit(tr)
    pred = m.predict(te, "hard").toPandas()
    assert len(pred) == te.count()
    assert ((pred["p1"] >= 0) & (pred["p1"] <= 1)).all()


def test_unknown_balancing_raises():
    with pytest.raises(ValueError):
        BalancedTreeEnsemble(balancing="meta")


def test_tree_params_validation():
    with pytest.raises(ValueError):
        TreeParams("gini", 31, 32)
    with pytest.raises(ValueError):
        TreeParams("variance", 5, 32)


def test_grid_order():
    g = experiment.grid(["gini", "entropy"], [30, 10], [32, 128])
    assert [(p.impurity, p.max_depth, p.max_bins) for p in g][:3] == [
        ("gini", 30, 32), ("gini", 30, 128), ("gini", 10, 32)]
    assert len(g) == 8


def test_no_minority_raises(spark):
    df = spark.createDataFrame([(1, -1), (2, -1)], "idn long, label int")
    with pytest.raises(ValueError):
        BalancedTreeEnsemble().balanced_table(df)


# -- level-wise grower -------------------------------------------------------------

def test_levelwise_tree_invariants(spark, fitted):
    _, tr, te = fitted
    model = BalancedTreeEnsemble(TreeParams("entropy", 6, 16), "indexedFeatures",
                                 seed="4", engine="levelwise").fit(tr)
    nodes = model.nodes.toPandas()
    plan = sampling.balance_plan(tr).first()
    assert model.num_trees == plan["n_trees"]
    assert sorted(nodes["tree"].unique()) == list(range(plan["n_trees"]))
    # Leaves of a tree partition its weighted rows; children sum to their parent.
    roots = nodes[nodes.node == 1].set_index("tree")
    leaves = nodes[nodes.is_leaf].groupby("tree")[["n", "n1"]].sum()
    assert np.allclose(leaves["n"], roots.loc[leaves.index, "n"])
    assert np.allclose(leaves["n1"], roots.loc[leaves.index, "n1"])
    by_id = nodes.set_index(["tree", "node"])
    for (t, n), r in by_id[~by_id.is_leaf].iterrows():
        kids = by_id.loc[[(t, 2 * n), (t, 2 * n + 1)]]
        assert kids["n"].sum() == pytest.approx(r["n"])
        assert r["gain"] > 0
    assert nodes["depth"].max() <= 6
    pred = model.predict(te).toPandas()
    assert len(pred) == te.count()
    assert (pred["n_trees"] == plan["n_trees"]).all()
    assert ((pred["p1"] >= 0) & (pred["p1"] <= 1)).all()


def test_levelwise_leaf_values_match_direct_routing(spark, fitted):
    _, tr, te = fitted
    model = BalancedTreeEnsemble(TreeParams("gini", 3, 8), "indexedFeatures",
                                 seed="5", engine="levelwise").fit(tr)
    nodes = model.nodes.toPandas().set_index(["tree", "node"])
    from pyspark.ml.functions import vector_to_array
    rows = (model.predict(te).select("idn", "p1s", vector_to_array("indexedFeatures").alias("x"))
            .limit(50).collect())
    for r in rows:
        for t in range(model.num_trees):
            node = 1
            while not nodes.loc[(t, node), "is_leaf"]:
                nd = nodes.loc[(t, node)]
                go_right = r["x"][int(nd["feature_index"])] > nd["threshold"]
                node = 2 * node + int(go_right)
            assert r["p1s"][t] == pytest.approx(nodes.loc[(t, node), "prediction"], abs=0, rel=0)


def test_levelwise_save_load_and_importances(spark, fitted):
    from rarefy.operators.levelwise import LevelwiseEnsembleModel
    _, tr, te = fitted
    model = BalancedTreeEnsemble(TreeParams("gini", 4, 16), "indexedFeatures",
                                 list(fixtures.FEATURES), seed="6", engine="levelwise").fit(tr)
    path = scratch_path(spark, f"lw-{uuid.uuid4().hex}")
    model.save(path)
    again = LevelwiseEnsembleModel.load(spark, path)
    a = model.predict(te).select("idn", "p1").orderBy("idn").collect()
    b = again.predict(te).select("idn", "p1").orderBy("idn").collect()
    assert a == b
    imp = named_importances(model.nodes, model.feature_names, digits=None).toPandas()
    assert (imp["importance"] >= 0).all() and imp["importance"].sum() == pytest.approx(1.0)


def test_experiment_reports_levelwise_train_indexer(spark, small_dir):
    cfg = experiment.ExperimentConfig(runs=1, impurities=("entropy",), depths=(3,), bins=(16,),
                                      features=list(fixtures.FEATURES), engine="levelwise",
                                      fit_indexer_on="train")
    rep = experiment.run_experiment(fixtures.transactions(spark, small_dir), cfg)
    assert set(rep) == {"confusion", "importances", "roc", "density_test", "density_train",
                        "eer", "curves", "nodes", "model"}
    assert rep["nodes"].where("floor(log2(node)) > 3").count() == 0
    assert rep["nodes"].where("NOT is_leaf").count() > 0
    conf = rep["confusion"].toPandas()
    assert sorted(conf["tipo"]) == ["test", "train"]
    assert rep["eer"].count() == 2
    assert rep["density_test"].count() == 2 * 41
    assert rep["curves"].count() == 4 * 150


def test_stratified_kmeans_picks_balance_every_tree(spark, fitted):
    from rarefy.operators import kmeans_balance as kb
    _, tr, _ = fitted
    majority, n_minor = tr.where("label <> 1"), tr.where("label = 1").count()
    assigned = kb.assigned_rows(majority, kb.fit_clusters(majority, 7))
    quotas = {r["cluster"]: r["quota"] for r in kb.cluster_quotas(assigned, n_minor).collect()}
    assert sum(quotas.values()) == n_minor
    picks = kb.stratified_picks(assigned, n_minor, 5, seed="9").join(assigned, "idn").toPandas()
    per = picks.groupby(["tree", "cluster"])["w"].sum()
    assert set(picks["tree"]) == set(range(5))
    for t in range(5):
        assert {c: per.get((t, c), 0) for c in quotas} == quotas
    bal = kb.kmeans_balanced_sets(tr, k=7, n_trees=3, keep=["idn", "label"])
    major = bal.where("label <> 1").groupBy("tree").agg(F.sum("w").alias("w")).collect()
    assert {r["tree"]: r["w"] for r in major} == dict.fromkeys(range(3), n_minor)


def test_experiment_default_config_grid(spark, small_dir):
    # One engine for both impurities under engine="auto".
    cfg = experiment.ExperimentConfig(runs=1, impurities=("gini", "entropy"), depths=(3,),
                                      bins=(16,), features=list(fixtures.FEATURES),
                                      split_per_grid_point=False)
    rep = experiment.run_experiment(fixtures.transactions(spark, small_dir), cfg)
    conf = rep["confusion"].toPandas()
    assert sorted(conf["impurity"]) == ["entropy", "entropy", "gini", "gini"]
    assert set(rep["nodes"].select("impurity").distinct().toPandas()["impurity"]) == {"gini", "entropy"}
    # A line per node, for either engine.
    assert rep["model"].count() == rep["nodes"].count()


def test_split_sides_partition_rows_with_null_ids(spark):
    df = spark.createDataFrame([(i if i % 5 else None, 1) for i in range(200)], "idn long, label int")
    tr, te = sampling.train_test(df, 0.7, "3")
    assert tr.count() + te.count() == 200
    labelled_split = sampling.hash_split(df, 0.7, "3").groupBy("split").count().toPandas()
    assert dict(zip(labelled_split["split"], labelled_split["count"])) == {
        "train": tr.count(), "test": te.count()}


def test_feature_arity_agrees_with_vector_indexer(spark, small_dir):
    from rarefy.operators.features import assemble, category_arity, feature_arity, fit_indexer, labelled_points
    lab = labelled(fixtures.transactions(spark, small_dir))
    feats = list(fixtures.FEATURES)
    ours = {r["feature_index"]: r["arity"] for r in feature_arity(lab, feats).collect()
            if r["categorical"]}
    idx = fit_indexer(assemble(lab, feats).select("features"))
    assert ours == category_arity(idx)
    pts = labelled_points(lab, feats)
    assert pts.columns == ["idn", "label", "features"]
    assert dict(pts.dtypes)["label"] == "double"


def test_nearest_picks_are_nearest_to_the_means(spark, fitted):
    from rarefy.operators import kmeans_balance as kb
    _, tr, _ = fitted
    majority = tr.where("label <> 1")
    assigned = kb.assigned_rows(majority, kb.fit_clusters(majority, 5))
    quotas = {r["cluster"]: r["quota"] for r in kb.cluster_quotas(assigned, 23).collect()}
    picks = kb.nearest_picks(assigned, 23).toPandas()
    for c, grp in assigned.toPandas().groupby("cluster"):
        x = np.stack(grp["x"].to_numpy())
        d2 = ((x - x.mean(axis=0)) ** 2).sum(axis=1).round(9)
        best = grp.assign(d2=d2).sort_values(["d2", "idn"]).head(quotas[c])
        assert sorted(picks.loc[picks.cluster == c, "idn"]) == sorted(best["idn"])


def test_minority_larger_than_majority_oversamples(spark):
    # 300 minority vs 100 majority: ratio 0 -> one tree; bootstrap mean 3 per majority row.
    rows = [(i, 1 if i < 300 else -1) for i in range(400)]
    df = spark.createDataFrame(rows, "idn long, label int")
    plan = sampling.balance_plan(df).first()
    assert plan["ratio"] == 0 and plan["n_trees"] == 1
    bal = sampling.balanced_sets(df, seed="2", keep=["idn", "label"])
    major_weight = bal.where("label <> 1").agg(F.sum("w")).first()[0]
    assert abs(major_weight - 300) <= 4 * math.sqrt(300)
    assert bal.where("label = 1").count() == 300


def test_eer_all_scores_equal(spark):
    rows = [(i, 1 if i % 4 == 0 else -1, 0.5, 0.5) for i in range(40)]
    df = detection.with_lr(_scores(spark, rows))
    for mode in ("standard", "reference"):
        got = detection.eer(df, mode).first()
        pdf = df.toPandas()
        assert (got["eer"], got["lr"], got["state"]) == _brute_eer(list(pdf["lr"]), list(pdf["flag"]), mode)


def test_undefined_lr_is_null_and_ignored(spark):
    rows = [(1, 1, 0.0, 0.0), (2, 1, 0.2, 0.8), (3, -1, 0.9, 0.1), (4, -1, 0.6, 0.4), (5, 1, 1.0, 0.0)]
    df = detection.with_lr(_scores(spark, rows))
    lr = {r["idn"]: r["lr"] for r in df.collect()}
    assert lr[1] is None
    assert lr[5] == pytest.approx(round(math.log(1e-13 / 1.0), 9))
    got = detection.eer(df).first()
    pdf = df.toPandas().dropna(subset=["lr"])
    assert (got["eer"], got["lr"], got["state"]) == _brute_eer(list(pdf["lr"]), list(pdf["flag"]), "standard")


def test_null_feature_handling(spark):
    from pyspark.errors import PySparkException
    from py4j.protocol import Py4JJavaError
    from rarefy.operators.features import assemble
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 3.0)], "idn long, a double, b double")
    assert assemble(df, ["a", "b"], handle_invalid="skip").count() == 1
    with pytest.raises((PySparkException, Py4JJavaError)):
        assemble(df, ["a", "b"]).collect()


def test_kde_fixed_bandwidth(spark):
    rows = [(1, 1, 0.2, 0.8), (2, 1, 0.2, 0.8), (3, -1, 0.5, 0.5), (4, -1, 0.6, 0.4)]
    df = detection.with_lr(_scores(spark, rows))
    dens = {(r["type"], r["x"]): r["y"] for r in
            detection.density(df, -1, 2, digits=None, fixed_bandwidth=0.1).collect()}
    lr = round(math.log(0.8 / 0.2), 9)  # evaluators use the 9-digit LR
    for x in (1.0, 1.5):
        exp = math.exp(-((x - lr) / 0.1) ** 2 / 2) / (0.1 * math.sqrt(2 * math.pi))
        assert dens[("Fraude", x)] == pytest.approx(exp, rel=1e-9, abs=1e-300)


# -- many distinct scores ------------------------------------------------------------

@pytest.fixture(scope="module")
def many_scores(spark):
    """600k distinct scores in a written table, and the exact evaluator values."""
    from rarefy.sources.tables import materialise
    n = 600_000
    rng = np.random.default_rng(11)
    y = rng.random(n) < 0.2
    lr = np.round(rng.permutation(n) / n * 6 - 3 + y * 0.8, 9)
    pdf = pd.DataFrame({"idn": np.arange(n), "lr": lr, "flag": y.astype("int32"),
                        "label": np.where(y, 1, -1).astype("int32")})
    df = materialise(spark.createDataFrame(pdf).repartition(24, "idn"))
    order = np.lexsort((pdf.idn, -pdf.flag, pdf.lr))
    return df, pdf.iloc[order].reset_index(drop=True)


def _exact_eer(rows, mode):
    nf, nl = int(rows.flag.sum()), int((1 - rows.flag).sum())
    if mode == "reference":
        cf = rows.flag.cumsum().to_numpy().astype(object)
        a, b, v = np.arange(len(rows)).astype(object) - cf, nl - cf, rows.lr.to_numpy()
    else:
        g = rows.groupby("lr").flag.agg(["sum", "count"])
        cf = g["sum"].cumsum().to_numpy().astype(object)
        a, b, v = cf, nl - (g["count"] - g["sum"]).cumsum().to_numpy().astype(object), g.index.to_numpy()
    gap = np.abs(a * nl - b * nf)
    best = np.flatnonzero(gap == gap.min())
    k = best[(len(best) + 1) // 2 - 1]
    return round(float(b[k]) / nl * 100, 6), v[k], int(gap[k] / (nf * nl) <= 1e-5)


def test_running_totals_are_exact_and_repeatable_at_many_scores(spark, many_scores):
    df, rows = many_scores
    g = rows.groupby("lr").flag.agg(["sum", "count"]).sort_index(ascending=False)
    tp, fp = g["sum"].to_numpy(), (g["count"] - g["sum"]).to_numpy()
    area = int((fp.astype(object) * (2 * tp.cumsum() - tp).astype(object)).sum()) / (2.0 * tp.sum() * fp.sum())
    name = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    spark.conf.set(name, "1")
    try:
        for _ in range(3):
            assert metrics.auc(df, "lr", digits=None).first()["auc"] == pytest.approx(area, rel=1e-12)
            for mode in ("standard", "reference"):
                got = detection.eer(df, mode).first()
                assert (got["eer"], got["lr"], got["state"]) == _exact_eer(rows, mode)
        roc = metrics.roc_points(df, "lr", digits=None).orderBy("pos").toPandas().iloc[1:-1]
    finally:
        spark.conf.unset(name)
    assert np.allclose(roc["tpr"], tp.cumsum() / tp.sum(), rtol=0, atol=1e-12)
    assert np.allclose(roc["fpr"], fp.cumsum() / fp.sum(), rtol=0, atol=1e-12)


# -- thresholds, scoring, limits -----------------------------------------------------

@pytest.mark.parametrize("rare", [0.0, 1.0])
def test_rare_values_split(spark, rare):
    from rarefy.operators import levelwise
    rows = [(0, 1.0, 1.0 if i < 20 else 0.0, rare if i < 20 else 1.0 - rare) for i in range(4000)]
    df = spark.createDataFrame(rows, "tree int, w double, y double, a double")
    model = levelwise.grow(df, ["a"], TreeParams("gini", 2, 64))
    assert model.thresholds == [[0.5]]
    leaves = {r["n"]: r["prediction"] for r in model.nodes.where("is_leaf").collect()}
    assert leaves == {20.0: 1.0, 3980.0: 0.0}


def test_low_cardinality_splits_match_spark_ml(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor
    from rarefy.operators import levelwise
    rng = np.random.default_rng(4)
    x = rng.integers(0, [2, 5, 9], size=(3000, 3)).astype(float)
    y = (rng.random(3000) < 0.1 + 0.25 * (x[:, 1] > 2) + 0.2 * x[:, 0] + 0.05 * (x[:, 2] < 3)).astype(float)
    df = spark.createDataFrame([(0, 1.0, float(b), *map(float, a)) for a, b in zip(x, y)],
                               "tree int, w double, y double, a double, b double, c double")
    ours = levelwise.grow(df, ["a", "b", "c"], TreeParams("gini", 3, 32))
    vec = VectorAssembler(inputCols=["a", "b", "c"], outputCol="x").transform(df)
    theirs = DecisionTreeRegressor(featuresCol="x", labelCol="y", maxDepth=3, maxBins=32).fit(vec)
    got = {r["idn"]: r["p1s"][0] for r in ours.tree_probabilities(
        df.withColumn("idn", F.monotonically_increasing_id())).select("idn", "p1s").collect()}
    want = {r["idn"]: r["p"] for r in theirs.setPredictionCol("p").transform(
        vec.withColumn("idn", F.monotonically_increasing_id())).select("idn", "p").collect()}
    assert got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i], abs=1e-12) for i in got)


@pytest.mark.parametrize("engine", ["levelwise", "ml"])
def test_scoring_keeps_null_and_repeated_ids(spark, fitted, engine):
    _, tr, te = fitted
    model = BalancedTreeEnsemble(TreeParams("gini", 3, 16), "indexedFeatures", list(fixtures.FEATURES),
                                 seed="3", engine=engine).fit(tr)
    odd = te.limit(20).unionByName(te.limit(20).withColumn("idn", F.lit(None).cast("bigint"))).unionByName(
        te.limit(40).withColumn("idn", F.lit(7).cast("bigint")))
    pred = model.predict(odd)
    assert pred.count() == odd.count()
    assert {r["n_trees"] for r in pred.select("n_trees").collect()} == {model.num_trees}
    by_vector = {str(r["indexedFeatures"]): r["p1s"] for r in model.predict(te).collect()}
    assert all(r["p1s"] == by_vector[str(r["indexedFeatures"])] for r in pred.collect())


@pytest.mark.parametrize("kind", ["gini", "entropy"])
def test_row_walk_equals_spark_ml_transform(spark, fitted, kind):
    from pyspark.ml.functions import vector_to_array
    _, tr, te = fitted
    model = BalancedTreeEnsemble(TreeParams(kind, 4, 16), "indexedFeatures", list(fixtures.FEATURES),
                                 seed="8", engine="ml").fit(tr)
    got = {r["idn"]: r["p1s"] for r in model.predict(te).select("idn", "p1s").collect()}
    for t, tree in enumerate(model.trees):
        out = tree.copy().setFeaturesCol("indexedFeatures").transform(te)
        p1 = F.col("prediction") if kind == "gini" else vector_to_array("probability")[1]
        for r in out.select("idn", p1.alias("p")).collect():
            assert got[r["idn"]][t] == pytest.approx(r["p"], abs=1e-12)


def test_tree_groups_split_by_nodes(spark):
    from rarefy.operators.treewalk import group_trees, with_tree_values
    trees = [[(1, 0, float(t), 0, 2, 3, 0.5), (2, None, None, 0, 0, 0, 0.1 * t), (3, None, None, 0, 0, 0, 1.0)]
             for t in range(5)] + [[(1, None, None, 0, 0, 0, 0.25)]]
    groups = group_trees(trees, max_nodes=6)
    assert [len(g.roots) for g in groups] == [2, 2, 2]
    df = spark.createDataFrame([(2.0,), (None,), (float("nan"),)], "x double")
    got = [r["p1s"] for r in with_tree_values(df, F.array("x"), groups).collect()]
    assert got[0] == [1.0, 1.0, 0.2, 0.1 * 3, 0.4, 0.25]
    assert got[1] == got[2] == [1.0] * 5 + [0.25]


def test_poisson_with_a_large_mean(spark):
    rows = [(i, 1 if i < 9000 else -1) for i in range(9010)]
    df = spark.createDataFrame(rows, "idn long, label int")  # 900 copies of each majority row
    bal = sampling.balanced_sets(df, seed="2", keep=["idn", "label"])
    w = [r["w"] for r in bal.where("label <> 1").collect()]
    assert len(w) == 10 and abs(sum(w) - 9000) <= 5 * math.sqrt(9000) and len(set(w)) > 1


def test_null_ids_take_part_in_split_sample_and_bootstrap(spark):
    df = spark.createDataFrame([(None, 1), (1, 1), (2, -1), (None, -1), (3, -1)], "idn long, label int")
    assert sampling.hash_sample(df, 1.0).count() == 5
    tr, te = sampling.train_test(df, 0.5, "1")
    assert tr.count() + te.count() == 5
    counts = [sampling.balanced_sets(df, seed=str(s), keep=["idn", "label"])
              .where("label <> 1 and idn is null").count() for s in range(6)]
    assert any(counts)


def test_hash_uniform_uses_52_bits(spark):
    from rarefy.functions.hashing import hash_uniform
    u = [r[0] for r in spark.range(2000).select(hash_uniform("x:", F.col("id"))).collect()]
    assert any((v * 2 ** 32) % 1 for v in u) and 0 <= min(u) and max(u) < 1


def test_unseen_category_with_a_train_only_indexer(spark):
    from rarefy.operators.features import assemble, fit_indexer
    df = spark.createDataFrame([(float(i % 2), float(i)) for i in range(10)], "a double, b double")
    new = spark.createDataFrame([(7.0, 1.0)], "a double, b double")
    model = fit_indexer(assemble(df, ["a", "b"]), handle_invalid="keep")
    assert model.transform(assemble(new, ["a", "b"])).select("indexedFeatures").count() == 1


def test_depths_share_one_growth(spark, fitted, monkeypatch):
    data, tr, te = fitted
    from rarefy.operators.ensemble import BalancedTreeEnsemble, TreeParams
    deep = BalancedTreeEnsemble(TreeParams("gini", 4, 16), seed="5").fit(tr)
    for depth in (1, 3, 4):
        alone = BalancedTreeEnsemble(TreeParams("gini", depth, 16), seed="5").fit(tr)
        cut = deep.truncated(depth)
        columns = [c for c in alone.nodes.columns]
        assert cut.nodes.columns == columns
        assert sorted(map(str, cut.nodes.collect())) == sorted(map(str, alone.nodes.collect()))
    assert deep.truncated(9) is deep


def test_grid_of_depths_fits_once_per_run(spark, small_dir, monkeypatch):
    from rarefy.operators.ensemble import BalancedTreeEnsemble
    fits = []
    fit = BalancedTreeEnsemble.fit
    monkeypatch.setattr(BalancedTreeEnsemble, "fit", lambda self, df: fits.append(self.params) or fit(self, df))
    cfg = experiment.ExperimentConfig(runs=2, impurities=("gini",), depths=(1, 2), bins=(8,),
                                      features=list(fixtures.BINARY_FEATURES), split_per_grid_point=False,
                                      reports=("nodes",))
    nodes = experiment.run_experiment(fixtures.transactions(spark, small_dir), cfg)["nodes"].toPandas()
    assert [p.max_depth for p in fits] == [2, 2]
    assert set(nodes[["k", "depth"]].itertuples(index=False, name=None)) == {(1, 1), (1, 2), (2, 1), (2, 2)}
    assert (np.floor(np.log2(nodes["node"])) <= nodes["depth"]).all()
