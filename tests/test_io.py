"""Sinks, persistence paths and stream scoring."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from rarefy.operators import sampling
from rarefy.operators.ensemble import BalancedTreeEnsemble, TreeParams
from rarefy.plans import catalog, experiment
from rarefy.schema import labelled
from rarefy.session import discard, ensure_checkpoint_dir, scratch_path
from rarefy.sources import fixtures, sinks
from rarefy.sources.tables import materialise, reuse_or_build, scan
from rarefy.streaming.scoring import score_stream


def test_feature_csv_export_round_trip(spark, small_dir):
    tx = fixtures.transactions(spark, small_dir)
    path = scratch_path(spark, f"csv-{uuid.uuid4().hex}")
    sinks.export_features_csv(tx, path, rate=catalog.SAMPLE_RATE, num_files=2,
                              seed=catalog.SAMPLE_SEED)
    back = spark.read.option("header", True).option("inferSchema", True).csv(path)
    assert back.columns == list(fixtures.FEATURES)
    assert back.count() == catalog.csv_export_rows(spark, small_dir).count()
    assert len(set(r[0] for r in back.select(F.input_file_name()).collect())) <= 2


def test_scan_filter_and_materialise(spark, small_dir):
    tx = fixtures.transactions(spark, small_dir)
    kept = scan(tx, ["idn", "monto"], "monto < 20")
    assert kept.columns == ["idn", "monto"]
    m = materialise(kept, path=scratch_path(spark, f"m-{uuid.uuid4().hex}"))
    assert m.count() == tx.where("monto < 20").count()


def test_reuse_or_build_reads_existing_table(spark, small_dir):
    name = f"t_{uuid.uuid4().hex[:8]}"
    calls = []

    def build():
        calls.append(1)
        return labelled(fixtures.transactions(spark, small_dir)).select("idn", "label")
    a = reuse_or_build(spark, name, build)
    b = reuse_or_build(spark, name, build)
    assert len(calls) == 1 and a.count() == b.count()


@pytest.mark.parametrize("engine", ["levelwise", "ml"])
def test_stream_scoring_equals_batch(spark, small_dir, engine):
    data, indexer, names = experiment.prepare(fixtures.transactions(spark, small_dir),
                                              list(fixtures.FEATURES))
    tr, _ = sampling.train_test(data, 0.7, "0")
    model = BalancedTreeEnsemble(TreeParams("gini", 4, 16), "indexedFeatures", names,
                                 engine=engine).fit(tr)
    lab = labelled(fixtures.transactions(spark, small_dir))
    src = scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    lab.write.parquet(src)
    stream = spark.readStream.schema(lab.schema).parquet(src)
    q_name = f"scored_{uuid.uuid4().hex[:8]}"
    q = (score_stream(model, stream, indexer).writeStream.format("memory").queryName(q_name)
         .outputMode("append").option("checkpointLocation", scratch_path(spark, f"ck-{q_name}"))
         .start())
    q.processAllAvailable()
    q.stop()
    streamed = spark.table(q_name).orderBy("idn").collect()
    vec = indexer.transform(experiment.assemble(lab, names))
    batch = (model.predict(vec).select("idn", "label", "p0", "p1", "predicted_label")
             .orderBy("idn").collect())
    assert streamed == batch


def test_experiment_writes_reports_and_models(spark, small_dir):
    out = scratch_path(spark, f"exp-out-{uuid.uuid4().hex}")
    cfg = experiment.ExperimentConfig(runs=1, impurities=("gini",), depths=(3,), bins=(16,),
                                      features=list(fixtures.FEATURES), engine="ml", eer_mode="standard")
    rep = experiment.run_experiment(fixtures.transactions(spark, small_dir), cfg, out=out)
    for name in rep:
        back = spark.read.option("header", True).option("multiLine", True).csv(f"{out}/{name}")
        assert back.count() == rep[name].count(), name
        assert back.columns == rep[name].columns, name
    from rarefy.operators.ensemble import BalancedEnsembleModel
    model = BalancedEnsembleModel.load(f"{out}/models/gini316_1")
    assert model.num_trees > 0
    nodes = rep["nodes"].toPandas()
    internal = nodes[~nodes.is_leaf]
    # Every split has exactly one of: a threshold (continuous) or a category set.
    assert (internal["threshold"].notna() ^ internal["left_categories"].notna()).all()
    assert nodes.loc[nodes.is_leaf, "threshold"].isna().all()


def test_write_reports_csv_and_parquet(spark, small_dir):
    conf = catalog.confusion_metrics(spark, small_dir)
    curves = catalog.score_curves(spark, small_dir)
    for fmt in ("csv", "parquet"):
        out = scratch_path(spark, f"reports-{fmt}-{uuid.uuid4().hex}")
        sinks.write_reports({"confusion": conf, "curves": curves}, out, fmt=fmt)
        reader = spark.read.option("header", True) if fmt == "csv" else spark.read
        for name, frame in (("confusion", conf), ("curves", curves)):
            back = reader.format(fmt).load(f"{out}/{name}")
            assert back.count() == frame.count() and back.columns == frame.columns


def test_only_requested_outputs_remain_after_an_experiment(spark, small_dir):
    base = scratch_path(spark, "")
    before = set(os.listdir(base))
    cfg = experiment.ExperimentConfig(runs=1, impurities=("gini",), depths=(2,), bins=(16,),
                                      features=list(fixtures.FEATURES))
    rep = experiment.run_experiment(fixtures.transactions(spark, small_dir), cfg)
    left = set(os.listdir(base)) - before
    assert len(left) == 1 and left.pop().startswith("reports-")
    assert rep["confusion"].count() == 2 and rep["nodes"].count() > 0


def test_discard_deletes_scratch_tables_only(spark, tmp_path):
    a = materialise(spark.range(3))
    b = materialise(spark.range(3), path=str(tmp_path / "mine"))
    discard(a)
    discard(b)
    assert not os.path.exists(a._scratch) and b.count() == 3


def test_no_local_scratch_folder_off_a_local_master():
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801
            @staticmethod
            def get(name, default=None):
                return default
    with pytest.raises(ValueError, match="shared folder"):
        ensure_checkpoint_dir(Session())
