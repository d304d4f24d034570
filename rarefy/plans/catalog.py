"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator.

Every query reads the driver's tables (``events`` through the
``transactions`` fixture) over whole tables; SQL twins live in
:mod:`rarefy.plans.oracle`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detection, ensemble, importance, metrics, sampling, stumps, votes
from ..operators import kmeans_balance as kmeans_balance_ops
from ..operators import instance_selection, levelwise, neighbours, smote
from . import experiment
from ..functions.hashing import hash_uniform
from ..operators.features import feature_arity
from ..schema import IGNORE, feature_columns, labelled
from ..sources import fixtures
from ..sources.tables import materialise, numeric_view, read_table, scan

# Fixed parameters of the registered queries.
SCAN_FILTER = "monto < 60"
# The reference's filter: every row.
EXPERIMENT_FILTER = "monto < 100000000"
RAW_FILTER = "value < 60"
RAW_COLUMNS = ("event_id", "event_type", "value")
TRAIN = 0.7
SPLIT_SEED = "0"
SAMPLE_RATE = 0.3
SAMPLE_SEED = "0"
BOOT_SEED = "0"
RUNS = 5
GRID_POINTS = 2
AXIS = (-10, 10)
DIGITS = 9
HASH_CLUSTERS = 7
PICK_TREES = 3
NEAR_BLOCK = 64
NEAR_K = 5
SMOTE_PERCENT = 150
# Binary features with one value on 1 of 100 rows: rarer than 1 / max_bins.
RARE_FEATURES = {"rare_one": "cast(idn % 100 = 7 as int)", "rare_zero": "cast(idn % 100 <> 11 as int)"}

# Features of many values, and codes; any value of them is exact in binary.
CUT_FEATURES = {"monto_entero": "floor(monto)", "cuenta_6h": "cuenta_monto_user_6h", "cuenta_24h": "cuenta_monto_user_24h"}
CODE_FEATURES = {"evento": "is_purchase + 2 * is_click + 3 * is_view", "franja": "morn + 2 * tard + 3 * noch",
                 "resto": "cast(idn % 13 as int)"}
CODE_ARITY = {"evento": 4, "franja": 4, "resto": 13}
CUT_BINS = 16

Query = Callable[[SparkSession, str], DataFrame]


def _tx(spark, d):
    return fixtures.transactions(spark, d)


def _lab(spark, d):
    """Labelled rows, written once and re-read (SRC6) for queries of several passes."""
    return materialise(labelled(_tx(spark, d)))


def _scored(spark, d):
    """The soft-voted fixture, materialised once: input of every evaluator."""
    return materialise(fixtures.scored_from(_lab(spark, d)))


def _train(spark, d):
    lab = _lab(spark, d)
    train, _ = sampling.train_test(lab, TRAIN, SPLIT_SEED)
    return train


def _scored_lr(spark, d):
    return detection.with_lr(_scored(spark, d))


# -- sources, filters ------------------------------------------------------

def src_scan_filter(spark, d):
    return scan(_tx(spark, d), filters=SCAN_FILTER)


def src_scan_pushed(spark, d):
    """SRC2 on a raw table: columns and filter reach the Parquet reader.

    ``src_scan_filter`` filters after the fixture's rolling windows, which need
    the rows the filter drops; so its filter stays above them.
    """
    return scan(read_table(spark, d, "events"), list(RAW_COLUMNS), RAW_FILTER)


def src_numeric_drop(spark, d):
    return numeric_view(_tx(spark, d))


def labelled_filter(spark, d):
    return labelled(_tx(spark, d))


def csv_export_rows(spark, d):
    """SNK1 row set: labelled -> sample -> drop non-feature columns."""
    sample = sampling.hash_sample(labelled(_tx(spark, d)), SAMPLE_RATE, SAMPLE_SEED)
    return sample.select(*feature_columns(sample, IGNORE))


def feature_columns_binary(spark, d):
    lab = _lab(spark, d)
    return feature_arity(lab, feature_columns(lab, IGNORE))


# -- sampling, balance -----------------------------------------------------

def class_counts(spark, d):
    lab = labelled(_tx(spark, d))
    return lab.agg(F.count_if(F.col("label") == 1).alias("n_fraud"),
                   F.count_if(F.col("label") == -1).alias("n_legal"))


def balance_plan(spark, d):
    return sampling.balance_plan(_train(spark, d))


def hash_split(spark, d):
    return sampling.hash_split(labelled(_tx(spark, d)), TRAIN, SPLIT_SEED).select("idn", "label", "split")


def hash_sample(spark, d):
    return sampling.hash_sample(labelled(_tx(spark, d)), SAMPLE_RATE, SAMPLE_SEED).select("idn", "label")


def bootstrap_weights(spark, d):
    train = _train(spark, d)
    plan = sampling.balance_plan(train)
    return sampling.bootstrap_weights(train.where(F.col("label") != 1), plan, BOOT_SEED)


def balanced_union(spark, d):
    train = _train(spark, d)
    return sampling.balanced_sets(train, seed=BOOT_SEED, keep=["idn", "label"])


def runs_membership(spark, d):
    """GRD2: a fresh split for every (run, grid point); counts per split/label."""
    lab = _lab(spark, d).select("idn", "label")
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("run"), F.lit(g).alias("grid_id"))
                                for r in range(1, RUNS + 1) for g in range(GRID_POINTS)]))
    rows = lab.select("idn", "label", pairs.alias("rg")).select("idn", "label", "rg.*")
    u = hash_uniform("split:", F.col("run"), ":", F.col("grid_id"), ":", F.col("idn"))
    split = F.when(u < F.lit(TRAIN), F.lit("train")).otherwise(F.lit("test"))
    return (rows.groupBy("run", "grid_id", split.alias("split"), "label")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("idn").alias("id_sum")))


# -- votes -----------------------------------------------------------------

def _votes(spark, d, strategy, strict=False):
    v = votes.combine(fixtures.vote_arrays_from(_lab(spark, d)), strategy, strict=strict)
    return v.select("idn", "label", F.round("p0", DIGITS).alias("p0"),
                    F.round("p1", DIGITS).alias("p1"), "n_votes", "predicted_label")


def soft_vote(spark, d):
    return _votes(spark, d, "soft", strict=True)


def soft_vote_stable(spark, d):
    return _votes(spark, d, "soft")


def hard_vote(spark, d):
    return _votes(spark, d, "hard")


def mean_vote(spark, d):
    return _votes(spark, d, "mean")


# -- evaluators ------------------------------------------------------------

def confusion_metrics(spark, d):
    return metrics.confusion_metrics(_scored(spark, d))


def roc_hard(spark, d):
    return metrics.roc_points(_scored(spark, d), "predicted_label")


def auc_hard(spark, d):
    return metrics.auc(_scored(spark, d), "predicted_label")


def _scored_p1(spark, d):
    return _scored(spark, d).withColumn("score", F.round("p1", DIGITS))


def roc_score(spark, d):
    return metrics.roc_points(_scored_p1(spark, d), "score")


def auc_score(spark, d):
    return metrics.auc(_scored_p1(spark, d), "score")


def llr(spark, d):
    return _scored_lr(spark, d).select("idn", "label", "lr")


def llr_inverse(spark, d):
    """EVA12 with the other orientation: ln(p0/p1), zero sides clipped to 1e-13."""
    return detection.with_lr(_scored(spark, d), inverse=False).select("idn", "label", "lr")


def bandwidth(spark, d):
    bw = detection.bandwidth(_scored_lr(spark, d))
    return bw.select(F.when(F.col("flag") == 1, "Fraude").otherwise("Legal").alias("type"),
                     "n", F.round("sd", DIGITS).alias("sd"), F.round("h", DIGITS).alias("h"))


def density_kde(spark, d):
    return detection.density(_scored_lr(spark, d), *AXIS)


def eer_standard(spark, d):
    return detection.eer(_scored_lr(spark, d), "standard")


def eer_reference(spark, d):
    return detection.eer(_scored_lr(spark, d), "reference")


def score_curves(spark, d):
    return detection.score_curves(_scored_lr(spark, d))


def score_range(spark, d):
    return detection.score_range(_scored_lr(spark, d))


# -- stumps, importances, ensemble -----------------------------------------

def _balanced_binary(spark, d, train=None):
    train = _train(spark, d) if train is None else train
    keep = ["idn", "label", *fixtures.BINARY_FEATURES]
    bal = sampling.balanced_sets(train, seed=BOOT_SEED, keep=keep)
    return bal.withColumn("y", F.when(F.col("label") == 1, 1.0).otherwise(0.0))


def stump_gini(spark, d):
    return stumps.stump_splits(_balanced_binary(spark, d), fixtures.BINARY_FEATURES, "gini")


def stump_entropy(spark, d):
    return stumps.stump_splits(_balanced_binary(spark, d), fixtures.BINARY_FEATURES, "entropy")


def importances_named(spark, d):
    splits = stumps.stump_splits(_balanced_binary(spark, d), fixtures.BINARY_FEATURES, "gini")
    return importance.named_importances(stumps.stump_nodes(splits), fixtures.BINARY_FEATURES)


def _fitted(spark, d, params=None):
    data, _, names = experiment.prepare(_tx(spark, d), list(fixtures.FEATURES))
    train, test = sampling.train_test(data, TRAIN, SPLIT_SEED)
    model = ensemble.BalancedTreeEnsemble(params or ensemble.TreeParams("gini", 10, 64),
                                          "indexedFeatures", names, seed=BOOT_SEED,
                                          engine="ml").fit(train)
    return model, train, test


def ensemble_predictions(spark, d):
    model, _, test = _fitted(spark, d)
    return model.predict(test, "soft").select("idn", "label", "n_trees", "n_votes",
                                              "p0", "p1", "predicted_label")


def ensemble_importances(spark, d):
    model, _, _ = _fitted(spark, d)
    from ..session import scratch_path
    import uuid
    nodes = ensemble.node_table(model, scratch_path(spark, f"model-{uuid.uuid4().hex}"))
    return importance.named_importances(nodes, model.feature_names)


def levelwise_stumps(spark, d):
    """Depth-1 level-wise grower on the binary features: equals the stump SQL."""
    bal = _balanced_binary(spark, d)
    model = levelwise.grow(bal, list(fixtures.BINARY_FEATURES), ensemble.TreeParams("gini", 1, 32))
    return _stump_rows(model, fixtures.BINARY_FEATURES)


def _stump_rows(model, features):
    """Depth-1 trees of the level-wise grower in the layout of the stumps."""
    nodes = model.nodes
    root = nodes.where("depth = 0 AND NOT is_leaf")
    kids = nodes.where("depth = 1").select("tree", "node", "prediction")
    left = kids.where("node = 2").select("tree", F.col("prediction").alias("left_p1"))
    right = kids.where("node = 3").select("tree", F.col("prediction").alias("right_p1"))
    names = F.element_at(F.array(*[F.lit(c) for c in features]), F.col("feature_index") + 1)
    return (root.join(left, "tree").join(right, "tree")
            .select(F.col("tree").cast("int").alias("tree"), "feature_index", names.alias("feature"),
                    F.round("gain", DIGITS).alias("gain"), F.round("left_p1", DIGITS).alias("left_p1"),
                    F.round("right_p1", DIGITS).alias("right_p1")))


def levelwise_rare_stumps(spark, d):
    """Depth-1 trees on binary features rarer than 1 / max_bins, low and high."""
    train = _train(spark, d).select("idn", "label", *[F.expr(e).alias(c) for c, e in RARE_FEATURES.items()])
    bal = sampling.balanced_sets(train, seed=BOOT_SEED, keep=["idn", "label", *RARE_FEATURES])
    bal = bal.withColumn("y", F.when(F.col("label") == 1, 1.0).otherwise(0.0))
    model = levelwise.grow(bal, list(RARE_FEATURES), ensemble.TreeParams("gini", 1, 32))
    return _stump_rows(model, list(RARE_FEATURES))


def _depth2(spark, d, kind="gini", train=None):
    bal = _balanced_binary(spark, d, train)
    return levelwise.grow(bal, list(fixtures.BINARY_FEATURES), ensemble.TreeParams(kind, 2, 32))


def levelwise_depth2_nodes(spark, d):
    """INS1: the node tables of all depth-2 trees on the binary features."""
    return _depth2(spark, d).nodes.select(
        F.col("tree").cast("int").alias("tree"), "node", "depth", "n", "n1",
        F.round("prediction", DIGITS).alias("prediction"), "is_leaf", "feature_index",
        F.round("gain", DIGITS).alias("gain"))


def levelwise_depth2_entropy(spark, d):
    return _depth2(spark, d, "entropy").nodes.select(
        F.col("tree").cast("int").alias("tree"), "node", "is_leaf", "feature_index",
        F.round("gain", DIGITS).alias("gain"))


def levelwise_depth2_predictions(spark, d):
    """ENS3 + ENS7: the held-out rows scored by the depth-2 trees."""
    train, test = sampling.train_test(_lab(spark, d), TRAIN, SPLIT_SEED)
    return _depth2(spark, d, train=train).predict(test, "soft").select(
        "idn", "label", "n_trees", "n_votes", F.round("p0", DIGITS).alias("p0"),
        F.round("p1", DIGITS).alias("p1"), "predicted_label")


def levelwise_depth2_importances(spark, d):
    """IMP1 + IMP2 on trees of several splits."""
    return importance.named_importances(_depth2(spark, d).nodes, list(fixtures.BINARY_FEATURES))


def _binned_rows(spark, d):
    """Balanced sets on amounts, counts and codes."""
    exprs = CUT_FEATURES | CODE_FEATURES
    train = _train(spark, d).select("idn", "label", *[F.expr(e).alias(c) for c, e in exprs.items()])
    bal = sampling.balanced_sets(train, seed=BOOT_SEED, keep=["idn", "label", *exprs])
    return bal.withColumn("y", F.when(F.col("label") == 1, 1.0).otherwise(0.0))


def _binned_nodes(model):
    return model.nodes.select(
        F.col("tree").cast("int").alias("tree"), "node", "depth", "n", "n1",
        F.round("prediction", DIGITS).alias("prediction"), "is_leaf", "feature_index", "split_bin",
        F.round("threshold", DIGITS).alias("threshold"), F.array_join("left_codes", ",").alias("left_codes"),
        F.round("gain", DIGITS).alias("gain"))


def tree_thresholds(spark, d):
    """ENS1: split points of every tree's own weighted rows."""
    cuts = levelwise.tree_thresholds(_binned_rows(spark, d), list(CUT_FEATURES), CUT_BINS)
    return cuts.select("tree", F.col("f").alias("feature_index"), F.posexplode("thresholds").alias("split_bin", "threshold"))


def levelwise_quantile_nodes(spark, d):
    """ENS1: depth-2 trees on features of many values, split points by tree and weight."""
    return _binned_nodes(levelwise.grow(_binned_rows(spark, d), list(CUT_FEATURES),
                                        ensemble.TreeParams("gini", 2, CUT_BINS), per_tree=True))


def levelwise_category_nodes(spark, d):
    """ENS1 + FEA3: depth-2 trees on features of many values and category sets."""
    features = list(CUT_FEATURES | CODE_FEATURES)
    arity = {features.index(c): n for c, n in CODE_ARITY.items()}
    return _binned_nodes(levelwise.grow(_binned_rows(spark, d), features, ensemble.TreeParams("entropy", 2, CUT_BINS),
                                        per_tree=True, categorical=arity))


def feature_arity_wide(spark, d):
    """FEA3 with more than two categories."""
    return feature_arity(labelled(_tx(spark, d)).select("*", *[F.expr(e).alias(c) for c, e in CODE_FEATURES.items()]),
                         ["monto", "madr", "cuenta_monto_user_6h", *CODE_FEATURES], CUT_BINS)


def levelwise_predictions(spark, d):
    """All trees grown together, one aggregate job per depth level."""
    data, _, names = experiment.prepare(_tx(spark, d), list(fixtures.FEATURES))
    train, test = sampling.train_test(data, TRAIN, SPLIT_SEED)
    model = ensemble.BalancedTreeEnsemble(ensemble.TreeParams("gini", 10, 32), "indexedFeatures",
                                          names, seed=BOOT_SEED, engine="levelwise").fit(train)
    return model.predict(test, "soft").select("idn", "label", "n_trees", "n_votes",
                                              "p0", "p1", "predicted_label")


def kmeans_balance(spark, d):
    """BAL2: each k-means cluster's quota of rows nearest to its mean (train split)."""
    data, _, _ = experiment.prepare(_tx(spark, d), list(fixtures.FEATURES))
    train, _ = sampling.train_test(data, TRAIN, SPLIT_SEED)
    majority = train.where(F.col("label") != 1)
    n_minor = train.where(F.col("label") == 1).count()
    assigned = kmeans_balance_ops.assigned_rows(majority, kmeans_balance_ops.fit_clusters(majority))
    return kmeans_balance_ops.nearest_picks(assigned, n_minor)


def _hash_assigned(spark, d):
    """(assigned majority rows, n_minor) with clusters from a hash of the id."""
    train = _train(spark, d)
    cluster = F.floor(hash_uniform("cluster:", F.col("idn")) * HASH_CLUSTERS).cast("int")
    x = F.array(*[F.col(c).cast("double") for c in fixtures.BINARY_FEATURES])
    assigned = materialise(train.where(F.col("label") != 1).select("idn", cluster.alias("cluster"), x.alias("x")))
    return assigned, train.where(F.col("label") == 1).count()


def kmeans_quotas(spark, d):
    return kmeans_balance_ops.cluster_quotas(*_hash_assigned(spark, d))


def kmeans_nearest_pick(spark, d):
    """BAL2's pick step on clusters that SQL can form too."""
    return kmeans_balance_ops.nearest_picks(*_hash_assigned(spark, d))


def kmeans_stratified_pick(spark, d):
    assigned, n_minor = _hash_assigned(spark, d)
    return kmeans_balance_ops.stratified_picks(assigned, n_minor, PICK_TREES, BOOT_SEED)


def kmeans_repeated_pick(spark, d):
    """BAL2's draws where ten rows share an id: every row is drawn for itself."""
    assigned, n_minor = _hash_assigned(spark, d)
    shared = assigned.withColumn("idn", F.floor(F.col("idn") / 10))
    return kmeans_balance_ops.stratified_picks(shared, n_minor, PICK_TREES, BOOT_SEED)


NEAR_FEATURES = ("monto", "is_purchase", "fds", "cuenta_monto_user_6h", "cuenta_monto_user_24h")
NEAR_NOMINAL = (1, 2)


def _hash_dealt(spark, d, minority_only):
    """Labelled rows dealt by a hash into blocks of about ``NEAR_BLOCK``, and their neighbours."""
    rows = _lab(spark, d)
    if minority_only:
        rows = rows.where(F.col("label") == 1)
    x = F.array(*[F.col(c).cast("double") for c in NEAR_FEATURES])
    own = neighbours.points(rows, x)
    deal = hash_uniform("block:", F.col("id")) * neighbours.rows_a_block(own.count(), NEAR_BLOCK)
    near = neighbours.block_neighbours(own.withColumn("block", F.floor(deal).cast("int")), ["block"], NEAR_K)
    return own, near


def smote_synthetic(spark, d):
    """BAL3: new minority rows between neighbours of blocks that SQL can form too."""
    own, near = _hash_dealt(spark, d, True)
    found = materialise(own.select("_row", "id").join(near, "_row", "left"))
    draws = smote.smote_draws(found, own.count() * SMOTE_PERCENT // 100, BOOT_SEED)
    made = smote.interpolate(draws, own, NEAR_NOMINAL)
    return made.select(F.col("id").alias("idn"), "j", F.col("to_id").alias("neighbour"),
                       F.round("gap", DIGITS).alias("gap"),
                       *[F.round(F.col("x")[i], 6).alias(c) for i, c in enumerate(NEAR_FEATURES)])


def enn_round(spark, d):
    """BAL4: one round of edited nearest neighbours of both classes, on blocks that SQL can form too."""
    own, near = _hash_dealt(spark, d, False)
    return instance_selection.edit_verdicts(own, near).select(
        F.col("id").alias("idn"), F.col("y").alias("label"), "n_near", "n_other", "kept")


def smote_balance(spark, d):
    """BAL3 on the train split: labelled vectors and as many new minority rows."""
    data, _, _ = experiment.prepare(_tx(spark, d), list(fixtures.FEATURES))
    train, _ = sampling.train_test(data, TRAIN, SPLIT_SEED)
    made = smote.smote(train.select("idn", "label", "indexedFeatures"), SMOTE_PERCENT)
    return made.select("idn", "label", F.round(vector_to_array("indexedFeatures")[0], 6).alias("monto"))


def enn_selection(spark, d):
    """BAL4 on the train split: majority rows edited until a round changes nothing."""
    data, _, _ = experiment.prepare(_tx(spark, d), list(fixtures.FEATURES))
    train, _ = sampling.train_test(data, TRAIN, SPLIT_SEED)
    return instance_selection.edited(train).select("idn", "label")


def flagship(spark, d):
    """Split -> balanced ensemble -> soft vote on the test side -> O1 metrics."""
    model, _, test = _fitted(spark, d)
    pred = materialise(model.predict(test, "soft").select("idn", "label", "p0", "p1",
                                                          "predicted_label"))
    conf = metrics.confusion_metrics(pred)
    hard = metrics.auc(pred, "predicted_label").first()["auc"]
    # Rank by the log-likelihood ratio: near-pure leaves push p1 itself to 0/1.
    score = metrics.auc(detection.with_lr(pred), "lr").first()["auc"]
    return (conf.withColumn("area_roc", F.lit(hard).cast("double"))
            .withColumn("area_roc_score", F.lit(score).cast("double"))
            .withColumn("n_trees", F.lit(model.num_trees)))


def _depth2_report(spark, d, name):
    """One report of one run of one grid point on the binary features."""
    cfg = experiment.ExperimentConfig(runs=1, impurities=("gini",), depths=(2,), bins=(32,),
                                      features=list(fixtures.BINARY_FEATURES), reports=(name,))
    return experiment.run_experiment(_tx(spark, d), cfg)[name]


def _rounded(df, *names):
    return df.withColumns({c: F.round(c, DIGITS) for c in names})


CONFUSION_MEASURES = ("TPR", "SPC", "PPV", "ACC", "F1", "MGEO", "PEXC", "MCC", "areaRoc", "areaRocScore")


def report_confusion(spark, d):
    """O1 on the depth-2 experiment."""
    return _rounded(_depth2_report(spark, d, "confusion"), *CONFUSION_MEASURES)


def report_importances(spark, d):
    """O2."""
    return _rounded(_depth2_report(spark, d, "importances"), "importance")


def report_roc(spark, d):
    """O3."""
    return _rounded(_depth2_report(spark, d, "roc"), "X", "Y")


def report_density_test(spark, d):
    """O4."""
    return _rounded(_depth2_report(spark, d, "density_test"), "X", "Y")


def report_density_train(spark, d):
    """O5."""
    return _rounded(_depth2_report(spark, d, "density_train"), "X", "Y")


def report_eer(spark, d):
    """O6."""
    return _depth2_report(spark, d, "eer")


def report_curves(spark, d):
    """O7."""
    return _rounded(_depth2_report(spark, d, "curves"), "X", "Y")


def report_nodes(spark, d):
    """O8 as a node table."""
    nodes = _rounded(_depth2_report(spark, d, "nodes"), "gain", "prediction", "node_impurity")
    return nodes.withColumn("tree", F.col("tree").cast("int"))


def report_model(spark, d):
    """O8 as text lines."""
    return _depth2_report(spark, d, "model")


def experiment_strategies(spark, d):
    """BAL5 as a grid dimension: O1 of every balancing strategy."""
    cfg = experiment.ExperimentConfig(runs=1, impurities=("gini",), depths=(3,), bins=(32,),
                                      balancings=kmeans_balance_ops.STRATEGIES,
                                      features=list(fixtures.FEATURES), reports=("confusion",),
                                      fit_at_once=len(kmeans_balance_ops.STRATEGIES))
    return experiment.run_experiment(_tx(spark, d), cfg)["confusion"]


def experiment_report(spark, d):
    cfg = experiment.ExperimentConfig(runs=1, impurities=("gini",), depths=(10,), bins=(32,),
                                      features=list(fixtures.FEATURES), filters=EXPERIMENT_FILTER,
                                      reports=("confusion",))
    return experiment.run_experiment(_tx(spark, d), cfg)["confusion"]


def experiment_grid(spark, d):
    """GRD3: O1 of every run at every grid point, on the binary features."""
    cfg = experiment.ExperimentConfig(runs=RUNS, impurities=("gini", "entropy"), depths=(2,), bins=(32,),
                                      features=list(fixtures.BINARY_FEATURES), filters=EXPERIMENT_FILTER,
                                      reports=("confusion",), grow_together=2 * RUNS)
    return _rounded(experiment.run_experiment(_tx(spark, d), cfg)["confusion"], *CONFUSION_MEASURES)


QUERIES: dict[str, Query] = {
    "src_scan_filter": src_scan_filter,
    "src_numeric_drop": src_numeric_drop,
    "labelled_filter": labelled_filter,
    "csv_export_rows": csv_export_rows,
    "feature_columns_binary": feature_columns_binary,
    "class_counts": class_counts,
    "balance_plan": balance_plan,
    "hash_split": hash_split,
    "hash_sample": hash_sample,
    "bootstrap_weights": bootstrap_weights,
    "balanced_union": balanced_union,
    "runs_membership": runs_membership,
    "soft_vote": soft_vote,
    "soft_vote_stable": soft_vote_stable,
    "hard_vote": hard_vote,
    "mean_vote": mean_vote,
    "confusion_metrics": confusion_metrics,
    "roc_hard": roc_hard,
    "auc_hard": auc_hard,
    "roc_score": roc_score,
    "auc_score": auc_score,
    "llr": llr,
    "llr_inverse": llr_inverse,
    "bandwidth": bandwidth,
    "density_kde": density_kde,
    "eer_standard": eer_standard,
    "eer_reference": eer_reference,
    "score_curves": score_curves,
    "score_range": score_range,
    "stump_gini": stump_gini,
    "stump_entropy": stump_entropy,
    "importances_named": importances_named,
    "ensemble_predictions": ensemble_predictions,
    "ensemble_importances": ensemble_importances,
    "levelwise_stumps": levelwise_stumps,
    "levelwise_predictions": levelwise_predictions,
    "kmeans_balance": kmeans_balance,
    "src_scan_pushed": src_scan_pushed,
    "levelwise_rare_stumps": levelwise_rare_stumps,
    "tree_thresholds": tree_thresholds,
    "levelwise_quantile_nodes": levelwise_quantile_nodes,
    "levelwise_category_nodes": levelwise_category_nodes,
    "feature_arity_wide": feature_arity_wide,
    "levelwise_depth2_nodes": levelwise_depth2_nodes,
    "levelwise_depth2_entropy": levelwise_depth2_entropy,
    "levelwise_depth2_predictions": levelwise_depth2_predictions,
    "levelwise_depth2_importances": levelwise_depth2_importances,
    "kmeans_quotas": kmeans_quotas,
    "kmeans_nearest_pick": kmeans_nearest_pick,
    "kmeans_stratified_pick": kmeans_stratified_pick,
    "kmeans_repeated_pick": kmeans_repeated_pick,
    "smote_synthetic": smote_synthetic,
    "smote_balance": smote_balance,
    "enn_round": enn_round,
    "enn_selection": enn_selection,
    "report_model": report_model,
    "experiment_strategies": experiment_strategies,
    "report_confusion": report_confusion,
    "report_importances": report_importances,
    "report_roc": report_roc,
    "report_density_test": report_density_test,
    "report_density_train": report_density_train,
    "report_eer": report_eer,
    "report_curves": report_curves,
    "report_nodes": report_nodes,
    "experiment_report": experiment_report,
    "experiment_grid": experiment_grid,
}
