import zlib
from collections import Counter, defaultdict

import brute_force as brute
from tidewatch.llm import queries, sharding

ROOT = "/root/testdata/sf0.001"


def check(frame, shards=8, **options):
    docs = frame.collect()
    got = sharding.shard(frame, shards, **options).collect()
    assert Counter((r.doc_id, r.text, r.size) for r in got) == Counter((r.doc_id, r.text, len((r.text or "").encode()) + 1) for r in docs)
    slots, homes, loads = defaultdict(list), defaultdict(set), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        homes[r.text or ""].add(r.shard)
        loads[r.shard] += r.size
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(len(v) == 1 for v in homes.values())
    return got, loads


def test_every_row_once_slots_without_gaps_and_groups_together(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    got, loads = check(docs)
    groups = Counter()
    for r in got:
        groups[r.text] += r.size
    mean = sum(loads.values()) / 8
    assert max(loads.values()) - min(loads.values()) <= max(groups.values()) and max(loads.values()) < 1.1 * mean
    assert sorted(map(repr, got)) == sorted(map(repr, sharding.shard(docs).collect()))


def test_small_blocks_and_bundles(spark):
    check(spark.read.parquet(f"{ROOT}/documents.parquet"), shards=3, bundles=16, block_rows=4)


def test_odd_rows(spark):
    got, _ = check(brute.dirty(spark))
    assert sharding.shard(brute.empty(spark)).count() == 0
    assert set(sharding.shard(brute.dirty(spark)).columns) == {*brute.dirty(spark).columns, "slot"}


def test_heap_takes_the_least_loaded_shard():
    items = [(f"i{k}", (k * 7919) % 101 + 1) for k in range(300)]
    loads, want = [0] * 5, {}
    for name, size in sorted(items, key=lambda x: (-x[1], x[0])):
        s = loads.index(min(loads))
        want[name] = s
        loads[s] += size
    assert dict(sharding.longest_first(items, 5)) == want


def test_query_columns(spark):
    rows = queries.op4_sharding(spark, ROOT).join(spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "text"), "doc_id").collect()
    assert rows and all(r.text_crc32 == zlib.crc32(r.text.encode()) and r.law == "bytes" and r.grown_shard is None for r in rows)
