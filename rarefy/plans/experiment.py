"""Experiment control and reports (GRD1-GRD3, O1-O8, SNK4).

``run_experiment`` mirrors the reference's batch job: for every run k and
every grid point, a fresh deterministic hold-out split, a balanced ensemble
fit on the training side, scoring of test and train, and all evaluators.
Predictions are written to the shared checkpoint folder once per
(run, grid point), and one ordered score table of all of them
(:mod:`rarefy.operators.score_table`) serves every evaluator: the jobs of the
evaluation do not follow the number of runs and points.  A lost executor
recomputes from storage, not from the fit.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import rounded_lr
from ..operators import detection, metrics
from ..operators.ensemble import BalancedTreeEnsemble, TreeParams, fit_together, node_table
from ..operators.features import assemble, fit_indexer
from ..operators.importance import named_importances
from ..operators.kmeans_balance import check_strategy
from ..operators.levelwise import LevelwiseEnsembleModel
from ..operators.sampling import hash_split, train_test
from ..operators.score_table import score_table
from ..schema import FRAUD, IGNORE, feature_columns, labelled
from ..session import scratch_path, scratch_scope
from ..sources.tables import materialise, scan


@dataclass(frozen=True)
class ExperimentConfig:
    """D12: run configuration with the reference's defaults."""
    runs: int = 5
    impurities: Sequence[str] = ("entropy",)
    depths: Sequence[int] = (10,)
    bins: Sequence[int] = (64,)
    balancings: Sequence[str] = ("balanced",)
    axis: tuple[int, int] = (-10, 10)
    train: float = 0.7
    filters: str = ""
    strategy: str = "soft"
    seed: str = "0"
    split_per_grid_point: bool = True
    fit_indexer_on: str = "all"
    engine: str = "auto"
    eer_mode: str = "reference"
    parallelism: int | None = None
    curve_points: int = 150
    features: Sequence[str] | None = field(default=None)
    reports: Sequence[str] | None = None
    # Ensembles of one growing state (level-wise engine): fewer jobs for more scratch space.
    grow_together: int = 1
    # Fits (of one ensemble, or of those that grow together) whose jobs run at the same time.
    fit_at_once: int = 1


REPORTS = ("confusion", "importances", "roc", "density_test", "density_train", "eer", "curves", "nodes",
           "model")


def grid(impurities: Sequence[str], depths: Sequence[int], bins: Sequence[int]) -> list[TreeParams]:
    """GRD1: impurity x depth x bins, impurity varying slowest."""
    return [TreeParams(i, d, b) for i, d, b in itertools.product(impurities, depths, bins)]


def assemble_labelled(df: DataFrame, features: Sequence[str] | None = None):
    """FLT1 -> FEA1: (idn, label, features) written once and re-read; names."""
    lab = labelled(df)
    names = list(features or feature_columns(lab, IGNORE))
    return materialise(assemble(lab, names).select("idn", "label", "features")), names


def prepare(df: DataFrame, features: Sequence[str] | None = None, fit_on: DataFrame | None = None):
    """FLT1 -> FEA1 -> FEA3: (idn, label, features, indexedFeatures), indexer, names.

    The labelled vectors and the indexed table are each written once and
    re-read (SRC6): the indexer fit, the balance plan and every fit scan
    them instead of recomputing the input.  The indexer is fitted on all
    labelled rows unless ``fit_on`` is given.
    """
    assembled, names = assemble_labelled(df, features)
    indexer = fit_indexer(fit_on if fit_on is not None else assembled)
    return materialise(indexer.transform(assembled)), indexer, names


def _tag(df: DataFrame, k: int, p: TreeParams, balancing: str) -> DataFrame:
    return (df.withColumn("k", F.lit(k)).withColumn("impurity", F.lit(p.impurity))
            .withColumn("depth", F.lit(p.max_depth)).withColumn("bins", F.lit(p.max_bins))
            .withColumn("balancing", F.lit(balancing)))


SCORED_KEYS = ["k", "g", "tipo"]


def evaluate(scored: DataFrame, points: Sequence[tuple[str, TreeParams]], cfg: ExperimentConfig) -> dict[str, DataFrame]:
    """The requested evaluators of all scored sets: rows of every run ``k``, point ``g`` and side ``tipo``.

    The score is the log-likelihood ratio ln(p1/p0): with near-pure leaves the
    product rule pushes p1 itself to 0 or 1, while the ratio keeps the ranking.
    """
    names = set(wanted(cfg)) & {"confusion", "roc", "density_test", "density_train", "eer", "curves"}
    if not names:
        return {}
    table = score_table(scored, SCORED_KEYS, rounded_lr(F.col("p0"), F.col("p1")), F.col("label") == FRAUD,
                        F.col("predicted_label"))

    def tagged(df: DataFrame) -> DataFrame:
        place = F.col("g")
        values = {"impurity": [p.impurity for _, p in points], "depth": [p.max_depth for _, p in points],
                  "bins": [p.max_bins for _, p in points], "balancing": [b for b, _ in points]}
        return df.withColumns({name: F.get(F.array(*[F.lit(v) for v in own]), place) for name, own in values.items()})

    def confusion() -> DataFrame:
        rates = metrics.with_rates(table.confusion(), digits=None, keys=SCORED_KEYS)
        hard = table.hard_area().withColumnRenamed("auc", "areaRoc")
        return rates.join(hard, SCORED_KEYS).join(table.area().withColumnRenamed("auc", "areaRocScore"), SCORED_KEYS, "left")

    def density(side: str) -> DataFrame:
        name = F.when(F.col("flag") == 1, F.lit(detection.CLASS_NAMES[1])).otherwise(F.lit(detection.CLASS_NAMES[0]))
        return densities.where(F.col("tipo") == side).withColumn("type", name)

    def curves() -> DataFrame:
        name = F.when(F.col("flag") == 1, F.lit("fraude")).otherwise(F.lit("legal"))
        return table.curves(cfg.curve_points).withColumn("type", F.concat(F.col("tipo"), F.lit("-"), name))

    densities = table.density(*cfg.axis)
    build = {"confusion": confusion, "density_test": lambda: density("test"), "density_train": lambda: density("train"),
             "eer": lambda: table.eer(cfg.eer_mode).withColumnRenamed("tipo", "type"), "curves": curves,
             "roc": lambda: table.hard_roc().where("tipo = 'test'")}
    return {name: tagged(make()) for name, make in build.items() if name in names}


def wanted(cfg: ExperimentConfig) -> tuple[str, ...]:
    return REPORTS if cfg.reports is None else tuple(cfg.reports)


def run_experiment(df: DataFrame, cfg: ExperimentConfig | None = None,
                   out: str | None = None) -> dict[str, DataFrame]:
    """GRD3: every (run, grid point) -> reports O1-O8 as DataFrames.

    ``out``: optional folder; each report is also written there as CSV
    with a header (SNK4), and models under ``out/models``.  The returned
    reports are read from a written folder; everything else the run wrote to
    scratch space is deleted at its end.
    """
    cfg = cfg or ExperimentConfig()
    spark = df.sparkSession
    if cfg.fit_indexer_on not in ("all", "train"):
        raise ValueError("fit_indexer_on must be 'all' or 'train'")
    kept = scratch_path(spark, f"reports-{uuid.uuid4().hex}")
    with scratch_scope(spark) as work:
        result = _reports(df, cfg, work, out)
        for name, frame in result.items():
            frame.write.mode("overwrite").parquet(f"{kept}/{name}")
    stored = {name: spark.read.parquet(f"{kept}/{name}") for name in result}
    if out:
        for name, frame in stored.items():
            frame.write.mode("overwrite").option("header", True).csv(f"{out}/{name}")
    return stored


def _reports(df: DataFrame, cfg: ExperimentConfig, work: str, out: str | None) -> dict[str, DataFrame]:
    """The reports as plans over tables in the run's folder ``work``."""
    spark = df.sparkSession
    base = scan(df, filters=cfg.filters)
    if cfg.fit_indexer_on == "all":
        # As the reference: indexer fitted on every labelled row, before the split.
        data, _, names = prepare(base, cfg.features)
        data = data.select("idn", "label", "indexedFeatures")
    else:
        data, names = assemble_labelled(base, cfg.features)
    reports: dict[str, list[DataFrame]] = {k: [] for k in wanted(cfg)}
    # The balancing strategy is the slowest dimension of the grid.
    points = [(b, p) for b in map(check_strategy, cfg.balancings)
              for p in grid(cfg.impurities, cfg.depths, cfg.bins)]
    # Trees of one run, strategy, impurity and bin count that share a sample are prefixes in depth.
    share = not cfg.split_per_grid_point and cfg.engine != "ml"
    tasks = [_Task(k, g, balancing, params, f"{k}:{g}" if cfg.split_per_grid_point else f"{k}")
             for k in range(1, cfg.runs + 1) for g, (balancing, params) in enumerate(points)]
    sides: dict[tuple, tuple[DataFrame, DataFrame]] = {}
    fitted: dict[tuple, tuple[Future, int]] = {}
    pool = ThreadPoolExecutor(max_workers=max(1, cfg.fit_at_once))

    def both_sides(task: _Task) -> tuple[DataFrame, DataFrame]:
        if task.seed not in sides:
            train, test = train_test(data, cfg.train, task.seed)
            if cfg.fit_indexer_on == "train":
                # No label-free leakage: categories are learnt from the training side only.
                indexer = fit_indexer(train, handle_invalid="keep")
                train = materialise(indexer.transform(train))
                test = indexer.transform(test)
            sides[task.seed] = train, test
        return sides[task.seed]

    def learner(task: _Task) -> BalancedTreeEnsemble:
        most = replace(task.params, max_depth=max(cfg.depths)) if share else task.params
        return BalancedTreeEnsemble(most, "indexedFeatures", names, seed=task.seed, parallelism=cfg.parallelism,
                                    engine=cfg.engine, balancing=task.balancing)

    def next_fits(tasks: Sequence[_Task]) -> list[dict[tuple, _Task]]:
        """The next unfitted ensembles, ``fit_at_once`` lots of those that grow together (of one bin count)."""
        lots: list[dict[tuple, _Task]] = []
        left = {t.grown(share): t for t in reversed(tasks) if t.grown(share) not in fitted}
        waiting = [t for t in tasks if left.get(t.grown(share)) is t]
        size = max(1, cfg.grow_together) if cfg.engine != "ml" else 1
        while waiting and len(lots) < max(1, cfg.fit_at_once):
            same = [t for t in waiting if t.params.max_bins == waiting[0].params.max_bins][:size]
            lots.append({t.grown(share): t for t in same})
            waiting = [t for t in waiting if t not in same]
        return lots

    def fit_lot(learners: Sequence[BalancedTreeEnsemble], frames: Sequence[DataFrame]) -> list:
        return fit_together(learners, frames) if len(learners) > 1 else [learners[0].fit(frames[0])]

    def fit(task: _Task, later: Sequence[_Task]):
        """The task's model; the next unfitted ensembles are fitted along with it."""
        if task.grown(share) not in fitted:
            lots = next_fits((task, *later))
            learners = [[learner(t) for t in lot.values()] for lot in lots]
            frames = [[both_sides(t)[0] for t in lot.values()] for lot in lots]
            # Driver threads submit the jobs; a fit's short jobs run in the gaps of another's long ones.
            for lot, own, sides_of in zip(lots, learners, frames):
                models = pool.submit(fit_lot, own, sides_of)
                fitted.update({grown: (models, place) for place, grown in enumerate(lot)})
        models, place = fitted[task.grown(share)]
        model = models.result()[place]
        if not any(other.grown(share) == task.grown(share) for other in later):
            del fitted[task.grown(share)]
        return model.truncated(task.params.max_depth) if share else model

    scored = f"{work}/scored"
    with pool:
        for number, task in enumerate(tasks):
            k, balancing, params = task.k, task.balancing, task.params
            model = fit(task, tasks[number + 1:])
            if cfg.fit_indexer_on == "all":
                rows = hash_split(data, cfg.train, task.seed).withColumnRenamed("split", "tipo")
            else:
                train, test = both_sides(task)
                rows = train.withColumn("tipo", F.lit("train")).unionByName(test.withColumn("tipo", F.lit("test")))
            (model.predict(rows, cfg.strategy).select("idn", "label", "p0", "p1", "predicted_label", "tipo")
             .write.mode("overwrite").parquet(f"{scored}/k={k}/g={task.g}"))
            plain = "" if balancing == "balanced" else f"{balancing}_"
            model_path = f"{out}/models/{plain}{params.tag}_{k}" if out else f"{work}/k{k}_g{task.g}/model"
            levelwise = isinstance(model, LevelwiseEnsembleModel)
            if levelwise:
                if out:
                    model.save(model_path)
                nodes = model.nodes
            else:
                nodes = node_table(model, model_path)
            if "importances" in reports:
                reports["importances"].append(_tag(named_importances(nodes, names, digits=None), k, params,
                                                   balancing))
            if "nodes" in reports:
                reports["nodes"].append(_tag(_node_rows(nodes, levelwise), k, params, balancing))
            if "model" in reports:
                # Spark ML trees live on the driver already; their text dump is local.
                lines = (dump_lines(nodes, names) if levelwise else
                         spark.createDataFrame(list(_text_lines(model.to_debug_string())), DUMP))
                reports["model"].append(_tag(lines, k, params, balancing))
    for name, frame in evaluate(spark.read.parquet(scored), points, cfg).items():
        reports[name].append(frame)
    result = {name: reduce(DataFrame.unionByName, frames) for name, frames in reports.items()}
    return _shape_reports(result)


@dataclass(frozen=True)
class _Task:
    """One run at one grid point."""
    k: int
    g: int
    balancing: str
    params: TreeParams
    seed: str

    def grown(self, share: bool) -> tuple:
        """What tells its ensemble from others: with ``share``, not the depth."""
        own = (self.seed, self.balancing, self.params.impurity, self.params.max_bins)
        return own if share else (*own, self.g)


DUMP = "tree int, place string, line string"


def dump_lines(nodes: DataFrame, names: Sequence[str]) -> DataFrame:
    """O8 as text, a row per node: ``tree, place, line``; lines of a tree read in the order of ``place``.

    A node's number in its tree spells its path from the root (1, then a bit a
    branch), so the binary number is its place and no walk is needed: each line
    takes its condition from the parent's row.
    """
    feature = F.coalesce(F.try_element_at(F.array(*[F.lit(n) for n in names]) if names else
                                          F.array().cast("array<string>"),
                                          (F.col("feature_index") + 1).cast("int")),
                         F.concat(F.lit("feature "), F.col("feature_index")))
    up = nodes.where("NOT is_leaf").select("tree", F.col("node").alias("parent"), feature.alias("name"),
                                           F.col("threshold").alias("at"), F.array_join("left_codes", ",").alias("codes"))
    own = nodes.select("tree", "node", "is_leaf", "prediction",
                       F.when(F.col("node") > 1, F.expr("node div 2")).alias("parent"))
    rows = own.join(up, ["tree", "parent"], "left")
    at = F.format_string("%.6f", "at")
    low = F.when(F.col("codes").isNull(), F.concat(F.lit(" <= "), at)).otherwise(F.concat(F.lit(" in {"), "codes", F.lit("}")))
    high = F.when(F.col("codes").isNull(), F.concat(F.lit(" > "), at)).otherwise(F.concat(F.lit(" not in {"), "codes", F.lit("}")))
    branch = (F.when(F.col("parent").isNull(), F.lit("Tree"))
              .when(F.col("node") % 2 == 0, F.concat(F.lit("If ("), "name", low, F.lit(")")))
              .otherwise(F.concat(F.lit("Else ("), "name", high, F.lit(")"))))
    leaf = F.when(F.col("is_leaf"), F.concat(F.lit(" Predict: "), F.format_string("%.6f", "prediction"))).otherwise(F.lit(""))
    place = F.bin("node")
    return rows.select(F.col("tree").cast("int").alias("tree"), place.alias("place"),
                       F.concat(F.repeat(F.lit("  "), F.length(place) - 1), branch, leaf).alias("line"))


def _text_lines(text: str) -> Iterator[tuple[int, str, str]]:
    """The lines of Spark ML's own dump, by tree."""
    tree = -1
    for number, line in enumerate(text.splitlines()):
        if line.startswith("-- tree "):
            tree = int(line.split()[2])
        else:
            yield tree, f"{number:09d}", line


def _node_rows(nodes: DataFrame, levelwise: bool) -> DataFrame:
    """O8 as a table: (tree, node, feature_index, threshold, gain, prediction, node_impurity,
    is_leaf)."""
    if levelwise:
        return nodes.select("tree", "node", "feature_index", "threshold",
                            F.array_join("left_codes", ",").alias("left_categories"), "gain",
                            "prediction", F.col("impurity").alias("node_impurity"), "is_leaf")
    return nodes.select("tree", F.col("id").cast("bigint").alias("node"), "feature_index",
                        # Continuous splits hold one threshold; leaves hold an empty array.
                        F.when((F.col("left_child") >= 0) & (F.col("num_categories") < 0),
                               F.try_element_at("threshold_or_categories", F.lit(1)))
                        .alias("threshold"),
                        # Categorical splits send these category codes left.
                        F.when((F.col("left_child") >= 0) & (F.col("num_categories") > 0),
                               F.array_join(F.col("threshold_or_categories").cast("array<string>"),
                                            ",")).alias("left_categories"),
                        "gain", "prediction", F.col("impurity").alias("node_impurity"),
                        (F.col("left_child") < 0).alias("is_leaf"))


def _shape_reports(r: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Column layouts of the reports (O1-O8)."""
    tail = ["impurity", "depth", "bins", "balancing"]
    point = [F.col("x").alias("X"), F.col("y").alias("Y"), "k", "type", *tail]
    layout = {
        "confusion": ["tipo", "k", "tp", "fn", "tn", "fp", F.col("tpr").alias("TPR"), F.col("spc").alias("SPC"),
                      F.col("ppv").alias("PPV"), F.col("acc").alias("ACC"), F.col("f1").alias("F1"),
                      F.col("mgeo").alias("MGEO"), F.col("pexc").alias("PEXC"), F.col("mcc").alias("MCC"),
                      "areaRoc", "areaRocScore", *tail],
        "importances": ["variable", "importance", "k", *tail],
        "roc": [F.col("fpr").alias("X"), F.col("tpr").alias("Y"), "k", "pos", *tail],
        "density_test": point, "density_train": point, "curves": point,
        "eer": ["k", "type", F.col("eer").alias("EER"), F.col("lr").alias("LR"), "state", *tail],
        "model": ["k", "tree", "place", "line", *tail],
        "nodes": ["k", "tree", "node", "feature_index", "threshold", "left_categories", "gain",
                  "prediction", "node_impurity", "is_leaf", *tail],
    }
    return {name: frame.select(*layout[name]) for name, frame in r.items()}
