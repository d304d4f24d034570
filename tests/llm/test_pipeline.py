"""corpus_pipeline.run against plain Python, stage by stage decisions included."""

from collections import Counter

import corpus_pipeline
from rarefy.llm import pii, quality_rules

from . import brute
from .test_operators import check_packing


def by_hand(docs):
    """(doc_id, text, source) rows through the first four stages."""
    stop = set(quality_rules.STOP_WORDS)
    docs = [d for d in docs if brute.kept(d[1], quality_rules.RULES, stop)]
    roots = brute.components([brute.simhash(t) for _, t, _ in docs])
    docs = [d for k, d in enumerate(docs) if roots[k] == k]
    docs = [(i, pii.redact(t, pii.find_spans(t)), s) for i, t, s in docs]
    return [d for d, (_, _, _, copies) in zip(docs, brute.mixture(docs)) for _ in range(copies)]


def test_run_equals_brute_force(spark, small_dir):
    rows = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text", "source").collect()
    mixed = by_hand(sorted((r.doc_id, r.text, r.source) for r in rows))
    packed = corpus_pipeline.run(spark, small_dir).collect()
    n, total = check_packing(packed, [(i, t) for i, t, _ in mixed])
    assert n <= -(-total // 1024) + 2


def test_stages_keep_the_columns_of_documents(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    columns, ids = docs.dtypes, Counter(r.doc_id for r in docs.select("doc_id").collect())
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "simhash near-dedup", "pii", "mixing", "best-fit packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small_dir)
        assert docs.dtypes == columns
        assert set(r.doc_id for r in docs.select("doc_id").collect()) <= set(ids)


def test_stages_take_odd_rows(spark, small_dir):
    from .test_operators import DOCS, odd_rows
    for rows in (odd_rows(), []):
        docs = spark.createDataFrame(rows, DOCS)
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, small_dir).collect()
