"""Level-wise grower: all trees of the ensemble grown together, one job per depth.

State: the balanced long table (tree, w, y, bins) with the current node of
every row (heap numbering: root 1, children 2n and 2n+1).  Per level:

1. rows in the smaller child of every split are unpivoted and grouped by
   (tree, node, feature, bin) into weighted counts: one scan and one
   generator, map-side partial aggregation; the sibling's histogram is the
   parent's minus these (the root counts all rows);
2. running sums over bins inside (tree, node, feature) give the left and right
   counts of every threshold (windows of at most ``max_bins`` rows);
3. gain (gini or entropy), best split per (tree, node) by a max aggregate
   over (gain rounded to 12 digits, lowest feature, lowest bin);
4. rows of split nodes move to a child through an equi-join on (tree, node)
   with the level's split table (Spark broadcasts it when its bytes allow);
   the new state is written, and the one before is dropped.

Where the features have few combinations of bins, rows of a tree with equal bins
and class are merged first, so levels read a table that does not grow with the rows.

Node totals are the side sums of the parent's split, so no pass computes them.

Candidate thresholds (:mod:`rarefy.operators.thresholds`) come from the balanced
rows, of all trees together or of each tree by weight.  A categorical feature
has one bin per code; inside a node its codes are ordered by P(minority), and
the splits are the prefixes of that order.  A NULL code goes right.

Ensembles of several scored sets can grow in one state (:func:`grow_sets`): their
trees are numbered set by set, each set with its impurity and depth, so the jobs
follow the deepest set and not the number of sets.

Scoring walks the trees inside the row (:mod:`rarefy.operators.treewalk`).
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard
from ..sources.tables import materialise
from .ensemble import TreeParams
from .impurity import impurity as _impurity
from .thresholds import (
    GRID_FACTOR, bin_by_tree, bin_columns, category_bins, feature_thresholds, side_bin, tree_thresholds)
from .treewalk import TreeGroup, category_mask, group_trees, with_tree_values
from .votes import combine

GAIN_DIGITS = 12
# Tree numbers of one set among sets that grow together.
SET_STRIDE = 1 << 20
# Combinations of bins up to which rows of equal bins are merged before growth.
MAX_CELLS = 1 << 14
SIDE_SUMS = ("left_n", "left_n1", "right_n", "right_n1")


@dataclass
class LevelwiseModel:
    """Node table (one row per node of every tree) plus binning metadata."""
    nodes: DataFrame
    features: list[str]
    thresholds: list[list[float]]
    params: TreeParams
    num_trees: int
    max_level: int
    _groups: list[TreeGroup] | None = field(default=None, repr=False, compare=False)

    def truncated(self, depth: int) -> LevelwiseModel:
        """The trees down to ``depth``; nodes there become leaves."""
        cut = (F.col("depth") == depth) & ~F.col("is_leaf")
        kept = self.nodes.where(F.col("depth") <= depth)
        empty = {c: F.when(~cut, F.col(c)) for c in ("feature_index", "split_bin", "threshold", "left_codes", "gain")}
        nodes = kept.select(*[
            (empty.get(c) if c in empty else F.when(cut, F.lit(-1)).otherwise(F.col(c)) if c == "left_child"
             else F.col(c) | cut if c == "is_leaf" else F.col(c)).alias(c) for c in kept.columns])
        return LevelwiseModel(nodes, self.features, self.thresholds, replace(self.params, max_depth=depth),
                              self.num_trees, min(self.max_level, depth))

    def groups(self) -> list[TreeGroup]:
        """The trees as constant arrays, read from the node table once per model."""
        if self._groups is None:
            rows = (self.nodes.select("tree", "node", "is_leaf", "feature_index", "threshold",
                                      "left_codes", "prediction")
                    .orderBy("tree", "node").toLocalIterator())
            by_tree = itertools.groupby(rows, key=lambda r: r["tree"])
            self._groups = group_trees(
                [(r["node"], None if r["is_leaf"] else r["feature_index"], r["threshold"],
                  category_mask(r["left_codes"] or ()), 2 * r["node"], 2 * r["node"] + 1, r["prediction"]) for r in nodes]
                for _, nodes in by_tree)
        return self._groups

    def tree_probabilities(self, df: DataFrame, output: str = "p1s") -> DataFrame:
        """Add ``p1s`` (leaf P(minority) of every tree, tree order) to every row of ``df``."""
        x = F.array(*[F.col(c).cast("double") for c in self.features])
        return with_tree_values(df, x, self.groups(), output)

    def predict(self, df: DataFrame, strategy: str = "soft", minority: int = 1,
                majority: int = -1, strict: bool = False) -> DataFrame:
        return combine(self.tree_probabilities(df), strategy, minority=minority,
                       majority=majority, strict=strict)


def _merged(state: DataFrame) -> DataFrame:
    """Rows of a tree that fall into the same bins and class as one row of their summed weight.

    They take the same way through the tree, so the grower tells them apart nowhere.
    """
    return state.groupBy("tree", "y", "bins", "node").agg(F.sum("w").alias("w")).select(*state.columns)


def _histogram(state: DataFrame) -> DataFrame:
    """(tree, node, f, b, c, c1): weighted counts, one scan and one generator."""
    cells = state.select("tree", "node", "w", "y", F.posexplode("bins").alias("f", "b"))
    return cells.groupBy("tree", "node", "f", "b").agg(
        F.sum("w").alias("c"), F.sum(F.col("w") * F.col("y")).alias("c1"))


def _impurity_by(kind: str | Column, n: Column, n1: Column) -> Column:
    """The impurity ``kind``, or where that is a column, the one it names in each row."""
    if isinstance(kind, str):
        return _impurity(n, n1, kind)
    return F.when(kind == "gini", _impurity(n, n1, "gini")).otherwise(_impurity(n, n1, "entropy"))


def _best_splits(hist: DataFrame, kind: str | Column, min_info_gain: float,
                 categorical: Sequence[int] = ()) -> DataFrame:
    """Best split per (tree, node), with the sums of its two sides.

    ``split_bin`` is the last bin on the left; for a categorical feature the
    position in the order of its codes by P(minority), whose prefix is
    ``left_codes``.
    """
    order, last = ["b"], F.col("b")
    left_codes = F.lit(None).cast("array<int>")
    if categorical:
        of_codes = F.col("f").isin(*categorical)
        # NULL codes (bin -1) stay at the right end.
        rank = F.when(~of_codes, F.lit(0.0)).when(F.col("b") < 0, F.lit(2.0)).otherwise(F.col("c1") / F.col("c"))
        hist, order = hist.withColumn("o", rank), ["o", "b"]
    by_bin = Window.partitionBy("tree", "node", "f").orderBy(*order)
    whole = Window.partitionBy("tree", "node", "f")
    if categorical:
        last = F.when(of_codes, F.row_number().over(by_bin) - 1).otherwise(F.col("b"))
        left_codes = F.when(of_codes, F.collect_list(F.when(of_codes, F.col("b"))).over(by_bin))
    cum = (hist.withColumn("nl", F.sum("c").over(by_bin)).withColumn("n1l", F.sum("c1").over(by_bin))
           .withColumn("nt", F.sum("c").over(whole)).withColumn("n1t", F.sum("c1").over(whole))
           .withColumn("last", last).withColumn("codes", left_codes))
    nr, n1r = F.col("nt") - F.col("nl"), F.col("n1t") - F.col("n1l")
    gain = (_impurity_by(kind, F.col("nt"), F.col("n1t"))
            - F.col("nl") / F.col("nt") * _impurity_by(kind, F.col("nl"), F.col("n1l"))
            - nr / F.col("nt") * _impurity_by(kind, nr, n1r))
    cand = (cum.where((F.col("nl") > 0) & (nr > 0))
            .select("tree", "node", "f", "last", F.round(gain, GAIN_DIGITS).alias("gain"),
                    "nl", "n1l", "nt", "n1t", "codes"))
    # Max over (gain, -feature, -bin); the side sums ride along.
    best = (cand.groupBy("tree", "node")
            .agg(F.max(F.struct("gain", (-F.col("f")).alias("nf"), (-F.col("last")).alias("nb"),
                                "nl", "n1l", "nt", "n1t", "codes")).alias("s"))
            .select("tree", "node", F.col("s.gain").alias("gain"),
                    (-F.col("s.nf")).alias("feature_index"), (-F.col("s.nb")).alias("split_bin"),
                    F.col("s.nl").alias("left_n"), F.col("s.n1l").alias("left_n1"),
                    (F.col("s.nt") - F.col("s.nl")).alias("right_n"),
                    (F.col("s.n1t") - F.col("s.n1l")).alias("right_n1"), F.col("s.codes").alias("left_codes")))
    return best.where(F.col("gain") > F.lit(min_info_gain))


def _children(level: DataFrame) -> DataFrame:
    """(tree, node, n, n1) of the nodes below a level's splits."""
    return (level.where(~F.col("is_leaf"))
            .select("tree", F.explode(F.array(
                F.struct((F.lit(2) * F.col("node")).alias("node"), F.col("left_n").alias("n"),
                         F.col("left_n1").alias("n1")),
                F.struct((F.lit(2) * F.col("node") + 1).alias("node"), F.col("right_n").alias("n"),
                         F.col("right_n1").alias("n1")))).alias("k"))
            .select("tree", "k.node", "k.n", "k.n1"))


def _next_histogram(small: DataFrame, parent: DataFrame, splits: DataFrame) -> DataFrame:
    """Histograms of all children: the counted ones, and their siblings by subtraction."""
    odd = F.when(F.col("left_n") <= F.col("right_n"), F.lit(1)).otherwise(F.lit(0))
    sides = splits.select("tree", F.col("node").alias("up"), (F.lit(2) * F.col("node") + 1 - odd).alias("mine"),
                          (F.lit(2) * F.col("node") + odd).alias("node"))
    counted = small.select("tree", F.col("node").alias("mine"), "f", "b", F.col("c").alias("sc"),
                           F.col("c1").alias("sc1"))
    other = (parent.withColumnRenamed("node", "up").join(sides, ["tree", "up"])
             .join(counted, ["tree", "mine", "f", "b"], "left")
             .select("tree", "node", "f", "b", (F.col("c") - F.coalesce("sc", F.lit(0.0))).alias("c"),
                     (F.col("c1") - F.coalesce("sc1", F.lit(0.0))).alias("c1"))
             .where(F.col("c") > 0))
    return small.select(*other.columns).unionByName(other)


def _leaves(totals: DataFrame) -> DataFrame:
    return totals.select("tree", "node", "n", "n1", F.lit(None).cast("double").alias("gain"),
                         F.lit(None).cast("int").alias("feature_index"),
                         F.lit(None).cast("int").alias("split_bin"),
                         *[F.lit(None).cast("double").alias(c) for c in SIDE_SUMS],
                         F.lit(None).cast("array<int>").alias("left_codes"))


def grow(balanced: DataFrame, features: Sequence[str], params: TreeParams,
         thresholds: list[list[float]] | None = None, min_info_gain: float = 0.0,
         n_trees: int | None = None, per_tree: bool = False,
         categorical: Mapping[int, int] | None = None,
         sets: Sequence[TreeParams] | None = None) -> LevelwiseModel:
    """Grow every tree of ``balanced`` (tree, w, y, <features>) level by level.

    ``per_tree``: thresholds of each tree's own weighted rows instead of all
    trees' rows together; a NULL or NaN goes right.  ``categorical``: feature
    index -> number of categories; such a feature holds codes from 0, at most
    ``max_bins`` of them.  ``sets``: impurity and depth of every set, where the
    trees number ``set * SET_STRIDE + tree``; ``params`` then holds the largest depth.
    """
    kind, limit = params.impurity.lower(), None
    if sets:
        own_set = F.expr(f"cast(tree div {SET_STRIDE} as int)")
        kind = F.get(F.array(*[F.lit(p.impurity.lower()) for p in sets]), own_set)
        if any(p.max_depth != params.max_depth for p in sets):
            limit = F.get(F.array(*[F.lit(p.max_depth) for p in sets]), own_set)
    features = list(features)
    codes = sorted(categorical or {})
    for i in codes:
        if not 0 <= i < len(features) or not 0 < categorical[i] <= params.max_bins:
            raise ValueError("a categorical feature needs a place among the features and 1 to max_bins categories")
    ordered = [i for i in range(len(features)) if i not in codes]
    names = [features[i] for i in ordered]
    cols = [F.col("w").cast("double").alias("w"), F.col("y").cast("double").alias("y")]
    written, cuts = [], None
    if per_tree or thresholds is None or params.max_depth > 1:
        # Several passes follow: thresholds, and a histogram and a move per level.
        balanced = materialise(balanced.select("tree", *cols, *features))
        written.append(balanced)
    spark = balanced.sparkSession
    pooled = None
    if per_tree:
        # A feature of two values has the same split point in every tree that has both: only
        # the others need a summary by tree.
        grid = feature_thresholds(balanced, names, GRID_FACTOR * params.max_bins)
        wide = [j for j in range(len(names)) if len(grid[j]) > 1]
        pooled = [None] * len(features)
        for j, ts in enumerate(grid):
            if len(ts) == 1:
                pooled[ordered[j]] = ts[0]
        thresholds, binned, thr = [], balanced, None
        by_tree, pooled_cuts = {ordered[j] for j in wide}, dict(zip(ordered, grid))
        if wide:
            cuts = tree_thresholds(balanced, [names[j] for j in wide], params.max_bins, grid=[grid[j] for j in wide])
            written.append(cuts)
            place = F.array(*[F.lit(ordered[j]) for j in wide])
            thr = cuts.select("tree", F.get(place, F.col("f")).alias("feature_index"),
                              F.posexplode("thresholds").alias("split_bin", "threshold"))
            thr_key = ["tree", "feature_index", "split_bin"]
            binned = bin_by_tree(balanced, [names[j] for j in wide], cuts, "_wide")
        own_bins = [F.get("_wide", F.lit(wide.index(j))) if j in wide else side_bin(names[j], ts)
                    for j, ts in enumerate(grid)]
    else:
        if thresholds is None:
            found = iter(feature_thresholds(balanced, names, params.max_bins))
            thresholds = [[] if i in codes else next(found) for i in range(len(features))]
        thr = spark.createDataFrame(
            [(f, b, t) for f, ts in enumerate(thresholds) for b, t in enumerate(ts)],
            "feature_index int, split_bin int, threshold double")
        thr_key = ["feature_index", "split_bin"]
        by_tree, pooled_cuts = set(), thresholds
        binned = bin_columns(balanced, names, [thresholds[i] for i in ordered], "_ordered")
        own_bins = [F.get("_ordered", F.lit(j)) for j in range(len(names))]
    if n_trees is None:
        top = balanced.agg(F.max("tree")).first()[0]
        n_trees = 0 if top is None else int(top) + 1
    bins = F.array(*[category_bins(features[i]) if i in codes else own_bins[ordered.index(i)]
                     for i in range(len(features))])
    state = binned.select("tree", *cols, bins.alias("bins"), F.lit(1).cast("bigint").alias("node"))
    # Bins of a feature: one more than its split points, and one for NULL codes.
    sizes = [categorical[i] + 1 if i in codes else params.max_bins if i in by_tree else len(pooled_cuts[i]) + 1
             for i in range(len(features))]
    if written and math.prod(sizes) <= MAX_CELLS:
        state = materialise(_merged(state))
        written.append(state)
    elif cuts is not None and params.max_depth > 1:
        state = materialise(state)  # places by tree are searched once, not for the root and its split
        written.append(state)
    hist = materialise(_histogram(state))
    root = hist.where("f = 0").groupBy("tree", "node").agg(F.sum("c").alias("n"), F.sum("c1").alias("n1"))
    levels, depth, totals = [], 0, root
    while True:
        if depth == params.max_depth:
            level = _leaves(totals)
        else:
            best = _best_splits(hist, kind, min_info_gain, codes)
            if limit is not None:
                best = best.where(limit > depth)
            level = totals.join(best, ["tree", "node"], "left")
        level = materialise(level.withColumn("depth", F.lit(depth))
                            .withColumn("is_leaf", F.col("feature_index").isNull()))
        levels.append(level)
        splits = level.where(~F.col("is_leaf"))
        if depth == params.max_depth or splits.isEmpty():
            break
        totals, depth = _children(level), depth + 1
        if depth == params.max_depth:
            continue  # these are leaves: their sums are known
        if limit is not None:
            splits = splits.where(limit > depth)  # so are these, of the sets that end here
        side = splits.select("tree", "node", "feature_index", "split_bin", "left_codes",
                             (F.col("left_n") <= F.col("right_n")).alias("left_small"))
        own = F.element_at("bins", F.col("feature_index") + 1)
        right = own > F.col("split_bin")
        if codes:
            right = F.when(F.col("left_codes").isNull(), right).otherwise(~F.array_contains("left_codes", own))
        moved = state.join(side, ["tree", "node"]).select(
            "tree", "w", "y", "bins", (F.lit(2) * F.col("node") + right.cast("bigint")).alias("node"),
            (right != F.col("left_small")).alias("small"))
        before, state = [t for t in written if t is not cuts], materialise(moved)
        written = [state] if cuts is None else [state, cuts]
        small = materialise(_histogram(state.where("small")))
        joined = materialise(_next_histogram(small, hist, splits))
        for old in (*before, small, hist):
            discard(old)
        hist = joined
    nodes = reduce(DataFrame.unionByName, levels)
    imp = _impurity_by(kind, F.col("n"), F.col("n1"))
    if thr is None:
        nodes = nodes.withColumn("threshold", F.lit(None).cast("double"))
    else:
        nodes = nodes.join(thr, thr_key, "left")
    if pooled is not None:
        at = F.array(*[F.lit(t).cast("double") for t in pooled])
        nodes = nodes.withColumn("threshold", F.coalesce("threshold", F.get(at, F.col("feature_index"))))
    nodes = materialise(
        nodes
        .select("tree", "node", "depth", "n", "n1",
                F.try_divide(F.col("n1"), F.col("n")).alias("prediction"),
                imp.alias("impurity"), "is_leaf", "feature_index", "split_bin",
                F.when(F.col("left_codes").isNull(), F.col("threshold")).alias("threshold"),
                "gain",
                F.when(F.col("is_leaf"), F.lit(-1)).otherwise(F.lit(1)).alias("left_child"),
                F.array_sort("left_codes").alias("left_codes")))
    for old in (*written, hist, *levels):
        discard(old)
    return LevelwiseModel(nodes, features, thresholds, params, n_trees, depth)


def grow_sets(tables: Sequence[DataFrame], features: Sequence[str], params: Sequence[TreeParams],
              n_trees: Sequence[int], per_tree: bool = True, categorical: Mapping[int, int] | None = None,
              min_info_gain: float = 0.0) -> list[LevelwiseModel]:
    """Grow the ensembles of several balanced tables (tree, w, y, <features>) in one state.

    One model a table, as :func:`grow` would give it (thresholds by tree: exact for
    features whose distinct values fit the pooled grid of all tables).  All
    ``params`` share ``max_bins``; impurity and depth may differ.  The state holds
    the rows of all tables at once, so the caller bounds their number.
    """
    if len({p.max_bins for p in params}) != 1:
        raise ValueError("sets that grow together need one max_bins")
    if max(n_trees) > SET_STRIDE:
        raise ValueError(f"at most {SET_STRIDE} trees a set")
    rows = [t.select((F.col("tree").cast("bigint") + F.lit(i * SET_STRIDE)).alias("tree"), "w", "y", *features)
            for i, t in enumerate(tables)]
    deepest = max(params, key=lambda p: p.max_depth)
    whole = grow(reduce(DataFrame.unionByName, rows), features, deepest, min_info_gain=min_info_gain,
                 n_trees=sum(n_trees), per_tree=per_tree, categorical=categorical, sets=params)
    models = []
    for i, (p, count) in enumerate(zip(params, n_trees)):
        nodes = (whole.nodes.where(F.col("tree").between(i * SET_STRIDE, (i + 1) * SET_STRIDE - 1))
                 .withColumn("tree", F.col("tree") - F.lit(i * SET_STRIDE)))
        models.append(LevelwiseModel(nodes, whole.features, whole.thresholds, p, count,
                                     min(whole.max_level, p.max_depth)))
    return models


def expand_vector(df: DataFrame, vector_col: str, size: int, prefix: str = "_v") -> tuple[DataFrame, list[str]]:
    """Vector column -> one double column per element (``_v0`` ...)."""
    from pyspark.ml.functions import vector_to_array
    arr = vector_to_array(vector_col)
    names = [f"{prefix}{i}" for i in range(size)]
    return df.select("*", *[arr[i].alias(n) for i, n in enumerate(names)]), names


@dataclass
class LevelwiseEnsembleModel:
    """A level-wise ensemble scored from a vector column, like the ML-backed one."""
    model: LevelwiseModel
    features_col: str
    feature_names: list[str]
    minority: int = 1
    majority: int = -1

    @property
    def num_trees(self) -> int:
        return self.model.num_trees

    def truncated(self, depth: int) -> LevelwiseEnsembleModel:
        """The ensemble that stops at ``depth``: growth by level makes its trees prefixes of these."""
        if depth >= self.model.params.max_depth:
            return self
        return replace(self, model=self.model.truncated(depth))

    @property
    def nodes(self) -> DataFrame:
        return self.model.nodes

    def predict(self, df: DataFrame, strategy: str = "soft", strict: bool = False) -> DataFrame:
        cols = df.columns
        expanded, _ = expand_vector(df, self.features_col, len(self.model.features))
        from .ensemble import with_probability
        out = self.model.predict(expanded, strategy, self.minority, self.majority, strict)
        return with_probability(out.select(*cols, "p1s", "n_trees", "n_votes", "p0", "p1",
                                           "predicted_label"))

    def save(self, path: str) -> None:
        """SNK2: node table as Parquet plus a JSON manifest (binning, parameters)."""
        path = path.rstrip("/")
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        m = self.model
        manifest = {"features": m.features, "thresholds": m.thresholds,
                    "impurity": m.params.impurity, "max_depth": m.params.max_depth,
                    "max_bins": m.params.max_bins, "num_trees": m.num_trees,
                    "max_level": m.max_level, "features_col": self.features_col,
                    "feature_names": self.feature_names, "minority": self.minority,
                    "majority": self.majority}
        spark = self.nodes.sparkSession
        (spark.createDataFrame([(json.dumps(manifest),)], "manifest string")
         .coalesce(1).write.mode("overwrite").text(f"{path}/manifest"))

    @classmethod
    def load(cls, spark, path: str) -> LevelwiseEnsembleModel:
        """SNK3: read back a saved level-wise ensemble."""
        path = path.rstrip("/")
        m = json.loads(spark.read.text(f"{path}/manifest").first()[0])
        nodes = spark.read.parquet(f"{path}/nodes")
        if "left_codes" not in nodes.columns:  # saved without category sets
            nodes = nodes.withColumn("left_codes", F.lit(None).cast("array<int>"))
        model = LevelwiseModel(nodes, m["features"], m["thresholds"],
                               TreeParams(m["impurity"], m["max_depth"], m["max_bins"]),
                               m["num_trees"], m["max_level"])
        return cls(model, m["features_col"], m["feature_names"], m["minority"], m["majority"])

    def to_debug_string(self) -> str:
        """INS1 text form (the node table itself is the primary form)."""
        rows = self.nodes.orderBy("tree", "node").collect()
        lines = []
        for r in rows:
            pad = "  " * (r["depth"] + 1)
            if r["is_leaf"]:
                lines.append(f"tree {r['tree']}{pad}node {r['node']}: predict {r['prediction']:.6f}")
            else:
                name = self.feature_names[r["feature_index"]] if self.feature_names else r["feature_index"]
                rule = f"<= {r['threshold']}" if r["left_codes"] is None else f"in {r['left_codes']}"
                lines.append(f"tree {r['tree']}{pad}node {r['node']}: {name} {rule} (gain {r['gain']})")
        return "\n".join(lines)
