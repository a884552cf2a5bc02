from collections import Counter

import brute_force as brute
import numpy as np

import corpus_pipeline
from tidewatch.llm import decontamination, mil, mixing
from tidewatch.llm.passages import encode

ROOT = "/root/testdata/sf0.001"


def test_run_matches_plain_stages(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{ROOT}/benchmark.parquet").collect()]
    model = mil.fit(docs, spark.read.parquet(f"{ROOT}/labels.parquet"))
    kept = [r for r in docs.collect() if model.scores([encode((r.text or "").encode())])[0] >= 0.7]
    groups = brute.near_groups([(r.doc_id, r.text) for r in kept])
    kept = [r for r in kept if groups[r.doc_id] == r.doc_id]
    leaked = brute.traces([(r.doc_id, r.text) for r in kept], items, decontamination.UNITS, decontamination.SPELLED)
    kept = [r for r in kept if r.doc_id not in leaked]
    plan = {r.doc_id: r.copies for r in mixing.plan(spark.createDataFrame(kept, docs.schema)).collect()}
    want = Counter({r.doc_id: plan[r.doc_id] for r in kept if plan[r.doc_id]})
    rows = corpus_pipeline.run(spark, ROOT).collect()
    assert Counter(r.doc_id for r in rows) == want
    homes, slots = {}, {}
    for r in rows:
        assert homes.setdefault(r.text, r.shard) == r.shard
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert np.ptp([sum(r.size for r in rows if r.shard == s) for s in range(8)]) < 0.1 * sum(r.size for r in rows)


def test_stages_take_odd_and_empty_tables(spark):
    for docs in (brute.dirty(spark), brute.empty(spark)):
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, ROOT)
            assert docs.columns == columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, ROOT).count() == docs.count()
