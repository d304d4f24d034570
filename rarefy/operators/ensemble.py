"""Balanced tree ensemble: fit, score, inspect, persist (ENS1-ENS8, INS1-INS2, SNK2-SNK3).

Fit plan (ENS1/ENS2):
  1. balance plan (one aggregate) -> number of trees T;
  2. the balanced sets of all T trees as one long table (tree, w, y,
     features): minority rows repeated per tree, majority rows with their
     per-tree bootstrap counts as weights (no per-tree resampling scan);
  3. that table is written once to the shared checkpoint folder,
     partitioned by tree, so every tree's fit reads only its own partition;
  4. one Spark ML tree per partition, fitted from a small driver thread pool
     (concurrent jobs share the cluster).
gini uses DecisionTreeRegressor on the 0/1 label (variance = gini / 2, and
its leaf value is the leaf's P(minority)); entropy uses
DecisionTreeClassifier, whose leaf probabilities survive except where Spark
merges sibling leaves with the same predicted class.

Scoring (ENS3/ENS7) walks all trees inside the row (:mod:`.treewalk`); the
leaf values are gathered into ``p1s`` and combined by a vote (ENS4-ENS6, ENS8):
no shuffle, and a plan that does not grow with the trees.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FRAUD, ID, LABEL, LEGAL, to_binary
from ..session import delete_folder, scratch_path
from ..sources.tables import materialise
from .instance_selection import edited
from .kmeans_balance import check_strategy, kmeans_balanced_sets
from .sampling import balance_plan, balanced_sets, plan_values
from .smote import smote
from .treewalk import TreeGroup, category_mask, group_trees, with_tree_values
from .votes import combine

# Fixed value: Spark ML rejects deeper trees.
MAX_DEPTH_LIMIT = 30
# Default bound on concurrently fitted trees (driver threads).
MAX_CONCURRENT_FITS = 32
IMPURITIES = ("gini", "entropy")


@dataclass(frozen=True)
class TreeParams:
    """One grid point (D11): impurity, maximum depth, maximum bins."""
    impurity: str = "entropy"
    max_depth: int = 10
    max_bins: int = 64

    def __post_init__(self):
        if self.impurity.lower() not in IMPURITIES:
            raise ValueError(f"impurity must be one of {IMPURITIES}")
        if not 0 <= self.max_depth <= MAX_DEPTH_LIMIT:
            raise ValueError(f"max_depth must be in [0, {MAX_DEPTH_LIMIT}]")
        if self.max_bins < 2:
            raise ValueError("max_bins must be >= 2")

    @property
    def tag(self) -> str:
        return f"{self.impurity}{self.max_depth}{self.max_bins}"


def _estimator(params: TreeParams, features: str, seed: int):
    common = dict(featuresCol=features, labelCol="y", weightCol="w",
                  maxDepth=params.max_depth, maxBins=params.max_bins, seed=seed)
    if params.impurity.lower() == "gini":
        return DecisionTreeRegressor(impurity="variance", **common)
    return DecisionTreeClassifier(impurity="entropy", **common)


@dataclass
class BalancedEnsembleModel:
    """A fitted ensemble: ordered tree models plus what scoring needs."""
    trees: list
    params: TreeParams
    features_col: str
    feature_names: list[str]
    minority: int = FRAUD
    majority: int = LEGAL
    kind: str = field(default="regressor")
    saved: str | None = None
    _groups: list[TreeGroup] | None = field(default=None, repr=False, compare=False)

    @property
    def num_trees(self) -> int:
        """INS2."""
        return len(self.trees)

    # -- scoring ---------------------------------------------------------
    def groups(self) -> list[TreeGroup]:
        """The trees as constant arrays, read from the saved node table once per model."""
        if self._groups is None:
            if self.saved is None:
                raise ValueError("the model has no saved trees; call save() first")
            rows = _saved_nodes(self.saved).orderBy("tree", "id").toLocalIterator()
            by_tree = itertools.groupby(rows, key=lambda r: r["tree"])
            self._groups = group_trees([_walk_node(r) for r in nodes] for _, nodes in by_tree)
        return self._groups

    def tree_probabilities(self, df: DataFrame, output: str = "p1s") -> DataFrame:
        """ENS3: add ``p1s``, the P(minority) of every tree, in tree order."""
        return with_tree_values(df, vector_to_array(F.col(self.features_col)), self.groups(), output)

    def predict(self, df: DataFrame, strategy: str = "soft", strict: bool = False) -> DataFrame:
        """ENS7: add ``p1s, n_trees, n_votes, p0, p1, probability, predicted_label``."""
        with_p = self.tree_probabilities(df)
        return with_probability(combine(with_p, strategy, minority=self.minority,
                                         majority=self.majority, strict=strict))

    # -- inspection ------------------------------------------------------
    def to_debug_string(self) -> str:
        """INS1 (text form)."""
        return "\n".join(f"-- tree {i} --\n{m.toDebugString}" for i, m in enumerate(self.trees))

    # -- persistence -----------------------------------------------------
    def save(self, path: str) -> None:
        """SNK2: one Spark ML artefact per tree plus a JSON manifest (written by Spark)."""
        path = path.rstrip("/")
        for i, m in enumerate(self.trees):
            m.write().overwrite().save(f"{path}/tree_{i}")
        spark = SparkSession.getActiveSession()
        manifest = {"num_trees": self.num_trees, "impurity": self.params.impurity,
                    "max_depth": self.params.max_depth, "max_bins": self.params.max_bins,
                    "features_col": self.features_col, "feature_names": self.feature_names,
                    "minority": self.minority, "majority": self.majority, "kind": self.kind}
        (spark.createDataFrame([(json.dumps(manifest),)], "manifest string")
         .coalesce(1).write.mode("overwrite").text(f"{path}/manifest"))
        self.saved = path

    @classmethod
    def load(cls, path: str) -> BalancedEnsembleModel:
        """SNK3: read the manifest, then every tree it lists."""
        path = path.rstrip("/")
        spark = SparkSession.getActiveSession()
        manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
        reader = (DecisionTreeRegressionModel if manifest["kind"] == "regressor"
                  else DecisionTreeClassificationModel)
        trees = [reader.load(f"{path}/tree_{i}") for i in range(manifest["num_trees"])]
        params = TreeParams(manifest["impurity"], manifest["max_depth"], manifest["max_bins"])
        return cls(trees, params, manifest["features_col"], manifest["feature_names"],
                   manifest["minority"], manifest["majority"], manifest["kind"], path)


def with_probability(df: DataFrame) -> DataFrame:
    """D9: ``probability`` = [P(majority), P(minority)] as an ML vector."""
    from pyspark.ml.functions import array_to_vector
    return df.withColumn("probability", array_to_vector(F.array("p0", "p1")))


class BalancedTreeEnsemble:
    """ENS2: an ensemble of single trees, each on a balanced bootstrap sample.

    ``df`` must hold ``idn``, ``label`` and the vector column ``features_col``.
    """

    def __init__(self, params: TreeParams | None = None, features_col: str = "indexedFeatures",
                 feature_names: Sequence[str] | None = None, seed: str = "0",
                 minority: int = FRAUD, majority: int = LEGAL, parallelism: int | None = None,
                 workdir: str | None = None, plan: DataFrame | None = None,
                 balancing: str = "balanced", kmeans_k: int | None = None,
                 engine: str = "auto", max_concurrent_fits: int = MAX_CONCURRENT_FITS,
                 neighbours: int = 5, smote_percent: int = 100,
                 thresholds: str = "tree", categories: Mapping[int, int] | None = None):
        self.params = params or TreeParams()
        self.features_col = features_col
        self.feature_names = list(feature_names or [])
        self.seed = str(seed)
        self.minority = minority
        self.majority = majority
        self.parallelism = None if parallelism is None else max(1, parallelism)
        self.workdir = workdir
        self.plan = plan
        self.balancing = check_strategy(balancing)
        self.kmeans_k = kmeans_k
        # Of SMOTE and instance selection: neighbours, and new minority rows in per cent of the old.
        self.neighbours = neighbours
        self.smote_percent = smote_percent
        if engine not in ("auto", "ml", "levelwise"):
            raise ValueError("engine must be 'auto', 'ml' or 'levelwise'")
        # One learner for every impurity, so that a grid compares impurities, not engines.
        self.engine = "levelwise" if engine == "auto" else engine
        self.max_concurrent_fits = max_concurrent_fits
        # Of the level-wise engine: split points of each tree's own balanced set or of all sets
        # together, and the number of categories by feature index (the ml engine reads both off
        # the vector's metadata and the tree's rows).
        if thresholds not in ("tree", "pooled"):
            raise ValueError("thresholds must be 'tree' or 'pooled'")
        self.thresholds = thresholds
        self.categories = dict(categories or {})

    def balanced_table(self, df: DataFrame) -> tuple[DataFrame, int]:
        """The long (tree, w, y, features) table and the tree count."""
        if self.balancing == "smote":
            df = materialise(smote(df, self.smote_percent, self.neighbours, self.features_col,
                                   LABEL, self.minority, ID, self.seed))
        elif self.balancing == "enn":
            df = materialise(edited(df, self.neighbours, self.features_col, LABEL, ID, self.minority))
        plan = self.plan if self.plan is not None else balance_plan(df, LABEL, self.minority)
        row = plan.first()
        if not row["n_minor"]:
            raise ValueError("no minority row: cannot plan a balanced ensemble")
        n_trees = int(row["n_trees"])
        keep = [ID, LABEL, self.features_col]
        if self.balancing == "kmeans":
            long = kmeans_balanced_sets(df, self.features_col, self.kmeans_k, n_trees, self.seed,
                                        LABEL, self.minority, ID, keep=keep)
        else:
            long = balanced_sets(df, plan, self.seed, LABEL, self.minority, ID, keep=keep)
        long = long.select("tree", ID, F.col("w").cast("double").alias("w"),
                           to_binary(LABEL, self.minority).alias("y"), self.features_col)
        return long, n_trees

    def levelwise_table(self, df: DataFrame) -> tuple[DataFrame, list[str], int]:
        """The balanced table with a column per feature, their names and the tree count."""
        from .levelwise import expand_vector
        size = len(self.feature_names)
        if not size:
            first = df.select(self.features_col).first()
            size = len(first[0]) if first else 0
        long, n_trees = self.balanced_table(df.select(ID, LABEL, self.features_col))
        long, cols = expand_vector(long, self.features_col, size)
        return long.drop(self.features_col, ID), cols, n_trees

    def _fit_levelwise(self, df: DataFrame):
        from .levelwise import LevelwiseEnsembleModel, grow
        long, cols, n_trees = self.levelwise_table(df)
        model = grow(long, cols, self.params, n_trees=n_trees,
                     per_tree=self.thresholds == "tree", categorical=self.categories)
        return LevelwiseEnsembleModel(model, self.features_col, self.feature_names,
                                      self.minority, self.majority)

    def fit(self, df: DataFrame):
        if self.engine == "levelwise":
            return self._fit_levelwise(df)
        spark = df.sparkSession
        long, n_trees = self.balanced_table(df)
        path = self.workdir or scratch_path(spark, f"balanced-{uuid.uuid4().hex}")
        # Written once, partitioned by tree: each fit below prunes to one folder.
        # Range-partitioning on (tree, id) first gives every task a contiguous
        # slice of one or two trees (files ~ tasks + trees, not tasks x trees),
        # and a large tree still spreads over several tasks.
        (long.repartitionByRange("tree", ID).drop(ID)
         .write.mode("overwrite").partitionBy("tree").parquet(path))
        stored = spark.read.parquet(path)
        seed_int = int(hashlib.md5(self.seed.encode()).hexdigest()[:7], 16)
        models = scratch_path(spark, f"trees-{uuid.uuid4().hex}")

        def fit_one(t: int):
            part = stored.where(F.col("tree") == t)
            tree = _estimator(self.params, self.features_col, seed_int + t).fit(part)
            # Scoring and the node table read the written nodes.
            tree.write().overwrite().save(f"{models}/tree_{t}")
            return tree

        # Concurrent fits: explicit, or follow the cluster's parallelism up to a
        # parameter, since each fit is a driver thread submitting its own jobs.
        workers = self.parallelism or max(4, spark.sparkContext.defaultParallelism)
        with ThreadPoolExecutor(max_workers=max(1, min(workers, self.max_concurrent_fits,
                                                       n_trees))) as pool:
            trees = list(pool.map(fit_one, range(n_trees)))
        if not self.workdir:
            delete_folder(spark, path)
        kind = "regressor" if self.params.impurity.lower() == "gini" else "classifier"
        return BalancedEnsembleModel(trees, self.params, self.features_col, self.feature_names,
                                     self.minority, self.majority, kind, models)


def fit_together(estimators: Sequence[BalancedTreeEnsemble], frames: Sequence[DataFrame]) -> list:
    """Fit several ensembles of the level-wise engine in one growing state, one on each frame.

    Bins, features, categories and threshold mode must agree; impurity, depth, seed
    and balancing strategy may differ.
    """
    from .levelwise import LevelwiseEnsembleModel, grow_sets
    first = estimators[0]
    for e in estimators:
        if (e.engine, e.features_col, e.feature_names, e.categories, e.thresholds) != (
                "levelwise", first.features_col, first.feature_names, first.categories, "tree"):
            raise ValueError("ensembles that grow together are level-wise, of the same features, with thresholds by tree")
    tables, names, counts = zip(*[e.levelwise_table(df) for e, df in zip(estimators, frames)])
    grown = grow_sets(tables, names[0], [e.params for e in estimators], counts, categorical=first.categories)
    return [LevelwiseEnsembleModel(model, e.features_col, e.feature_names, e.minority, e.majority)
            for e, model in zip(estimators, grown)]


def _saved_nodes(path: str) -> DataFrame:
    """The nodes of the Spark ML trees saved under ``path``, with their tree number."""
    spark = SparkSession.getActiveSession()
    nodes = spark.read.parquet(f"{path.rstrip('/')}/tree_*/data")
    return nodes.withColumn("tree", F.regexp_extract(
        F.col("_metadata.file_path"), r"tree_(\d+)/data", 1).cast("int"))


def _walk_node(r) -> tuple:
    """A saved node as the row-local walk takes it."""
    stats = r["impurityStats"]
    # A regressor's leaf value is the mean of the 0/1 label; a classifier's is in the class counts.
    value = r["prediction"] if len(stats) != 2 else (stats[1] / sum(stats) if sum(stats) else 0.0)
    if r["leftChild"] < 0:
        return r["id"], None, None, 0, -1, -1, value
    split = r["split"]
    kept = split["leftCategoriesOrThreshold"]
    if split["numCategories"] < 0:
        return r["id"], split["featureIndex"], kept[0], 0, r["leftChild"], r["rightChild"], value
    return (r["id"], split["featureIndex"], None, category_mask(kept), r["leftChild"], r["rightChild"],
            value)


def node_table(model: BalancedEnsembleModel, path: str) -> DataFrame:
    """INS1/D8: every node of every tree as rows, read from the saved model.

    (tree, id, prediction, impurity, gain, left_child, right_child,
    feature_index, threshold_or_categories, num_categories)
    """
    model.save(path)
    nodes = _saved_nodes(path)
    return nodes.select(
        "tree", F.col("id"), F.col("prediction"), F.col("impurity"),
        F.col("gain"), F.col("leftChild").alias("left_child"),
        F.col("rightChild").alias("right_child"),
        F.col("split.featureIndex").alias("feature_index"),
        F.col("split.leftCategoriesOrThreshold").alias("threshold_or_categories"),
        F.col("split.numCategories").alias("num_categories"))
