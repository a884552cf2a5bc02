from collections import Counter

import pytest

import brute_force as brute
from tidewatch.llm import mixing

ROOT = "/root/testdata/sf0.001"


def check(frame):
    docs = [r for r in frame.collect()]
    sizes = Counter()
    for r in docs:
        sizes[r.source] += len(brute.words(r.text))
    want = brute.targets(dict(sizes)) if docs else {}
    got = mixing.plan(frame).collect()
    assert Counter((r.doc_id, r.size, r.source_size) for r in got) == Counter((r.doc_id, len(brute.words(r.text)), sizes[r.source]) for r in docs)
    for r in got:
        assert r.target == pytest.approx(want[r.source])
        rate = r.target / r.source_size if r.source_size else 0
        assert r.taken == r.copies * r.size <= 3 * r.size and int(rate) <= r.copies <= int(rate) + 1
    return got


def test_targets_and_copies_match_redealing(spark):
    got = check(spark.read.parquet(f"{ROOT}/documents.parquet"))
    taken, target = sum(r.taken for r in got), sum({r.source: r.target for r in got}.values())
    assert 0.8 < taken / target < 1.2


def test_odd_rows(spark):
    check(brute.dirty(spark))
    assert mixing.plan(brute.empty(spark)).count() == 0 and mixing.mix(brute.empty(spark)).count() == 0


def test_limits_are_dealt_again(spark):
    rows = [(i, "w " * n, "en", s) for i, (s, n) in enumerate([("a", 1), ("b", 100), ("c", 1000), ("d", 2), ("e", 50)])]
    check(brute.dirty(spark, rows))


def test_mix_emits_the_planned_copies_with_all_columns(spark):
    docs = brute.dirty(spark)
    plan = Counter()
    for r in mixing.plan(docs).collect():
        plan[r.doc_id] += r.copies
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({k: v for k, v in plan.items() if v})
    assert sorted(map(repr, mixed.collect())) == sorted(map(repr, mixing.mix(docs).collect()))
