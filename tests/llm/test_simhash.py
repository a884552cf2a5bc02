import random

import numpy as np
import pyarrow as pa
import pytest

import brute_force as brute
from tidewatch.llm import simhash
from tidewatch.llm.components import components

ROOT = "/root/testdata/sf0.001"


def check(frame, **options):
    got = sorted(repr((r.doc_id, r.fingerprint, r.component_id)) for r in simhash.classes(frame, **options).collect())
    assert got == sorted(map(repr, brute.simhash_classes([(r.doc_id, r.text) for r in frame.collect()])))


def test_classes_match_all_pairs(spark):
    check(spark.read.parquet(f"{ROOT}/documents.parquet"))


def test_odd_rows(spark):
    check(brute.dirty(spark))
    assert simhash.classes(brute.empty(spark)).count() == 0 and simhash.one_of_each(brute.empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_links_connect_what_all_pairs_connect(spark, seed):
    """Chains, dense groups and differences in one or both halves, the highest bit among them."""
    rng = random.Random(seed)
    fps = {0, (1 << 64) - 1}
    for _ in range(6):
        base = rng.getrandbits(64)
        loose = rng.sample(range(64), 9)
        for _ in range(60):
            fps.add(base ^ sum(1 << b for b in loose if rng.random() < 0.5))
        for _ in range(10):
            base ^= sum(1 << b for b in rng.sample(range(64), rng.choice([3, 3, 4])))
            fps.add(base)
    long = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(long(f),) for f in fps], "fp bigint")
    want = brute.components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    roots = {r.node: r.root for r in components(simhash.links(nodes)).collect()}
    for f in fps:
        assert roots.get(long(f), long(f)) == min(map(long, want[f]))


@pytest.mark.parametrize("cut", [1, 3, 1000])
def test_buckets_may_span_batches(cut):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**62, 5)
    rows = sorted((int(k), int(b ^ (1 << int(i))), bool(i % 3 == 0)) for k, b in enumerate(base) for i in rng.integers(0, 20, 9))
    batches = [pa.RecordBatch.from_pylist([dict(zip(("key", "fp", "own"), r, strict=True)) for r in rows[i : i + cut]],
                                          schema=pa.schema([("key", pa.int64()), ("fp", pa.int64()), ("own", pa.bool_())])) for i in range(0, len(rows), cut)]
    got = {(r["a"], r["b"]) for b in simhash._links(3)(iter(batches)) for r in b.to_pylist()}
    whole = {(r["a"], r["b"]) for b in simhash._links(3)(iter([pa.Table.from_batches(batches).combine_chunks().to_batches()[0]])) for r in b.to_pylist()}
    assert got == whole and got


def test_one_of_each_keeps_the_smallest_id(spark):
    for frame in (spark.read.parquet(f"{ROOT}/documents.parquet"), brute.dirty(spark)):
        kept = simhash.one_of_each(frame)
        assert kept.columns == frame.columns
        fps = [(r.doc_id, brute.fingerprint(r.text)) for r in frame.collect()]
        groups = brute.components({f for _, f in fps}, lambda a, b: (a ^ b).bit_count() <= 3)
        least = {min(g): min((i for i, f in fps if f in g and i is not None), default=None) for g in groups.values()}
        assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(map(repr, least.values()))


def test_components_of_a_path_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (3, None), (200, 200)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert roots == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
