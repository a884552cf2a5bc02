import random

import brute_force as brute
import numpy as np
import pyarrow as pa
import pytest

from tidewatch.llm import simhash


def edited(words, rnd, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"x{rnd.randrange(10**6)}"
    return words


def planted(seed):
    rnd = random.Random(seed)
    rows = []
    for _ in range(60):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.choice([60, 150, 400]))]
        rows.append(words)
        rows += [edited(words, rnd, rnd.randrange(1, max(2, len(words) // 50))) for _ in range(rnd.randrange(4))]
        rows.append(edited(words, rnd, len(words) // 8))
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("seed", range(2))
def test_nine_in_ten_near_copies_go_and_nothing_else(spark, seed):
    rows = planted(seed)
    want = brute.near_groups(rows)
    docs = brute.dirty(spark, [(i, t, "en", "s") for i, t in rows])
    kept = {r.doc_id for r in simhash.without_near_copies(docs).collect()}
    first = {i for i, least in want.items() if i == least}
    copies = set(want) - first
    assert first <= kept and len(copies) > 50 and len(copies & kept) <= 0.1 * len(copies)


def test_documents_of_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute.near_groups([(r.doc_id, r.text) for r in docs.collect()])
    kept = {r.doc_id for r in simhash.without_near_copies(docs).collect()}
    first = {i for i, least in want.items() if i == least}
    assert first <= kept and len(kept - first) <= 0.1 * len(set(want) - first)


def test_odd_rows_and_clashing_columns(spark):
    docs = brute.dirty(spark).selectExpr("*", "1 AS __k0", "2 AS __k1", "3 AS __n", "4 AS root", "5 AS a", "6 AS b")
    kept = simhash.without_near_copies(docs)
    assert kept.columns == docs.columns
    # Blank texts are one group, equal texts are one, repeated rows are one.
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 3, 6, 6, 8, 9, 10, 11, 12] and kept.where("doc_id IS NULL").count() == 1
    assert simhash.without_near_copies(brute.empty(spark)).count() == 0


def all_pairs(keys, fps, own, bits):
    """Groups of each bucket's fingerprints, joined by every entry with every probe."""
    out = set()
    for key in set(keys):
        here = [(f, o) for k, f, o in zip(keys, fps, own, strict=True) if k == key]
        links = {frozenset((f, g)) for f, o in here if o for g, _ in here if f != g and (int.from_bytes(f) ^ int.from_bytes(g)).bit_count() <= bits}
        out |= {(key, frozenset(g)) for g in brute.components({f for f, _ in here}, lambda a, b, links=links: frozenset((a, b)) in links).values() if len(g) > 1}
    return out


@pytest.mark.parametrize("cut, small", [(7, 64), (1000, 64), (7, 3), (1000, 3)])
def test_buckets_of_any_size_and_cut_yield_spanning_links(cut, small):
    rng = np.random.default_rng(2)
    rows = []
    for key in range(8):
        base = rng.integers(0, 256, 32, dtype=np.uint8)
        for k in range(rng.integers(1, 14)):
            f = base.copy()
            for bit in rng.choice(256, rng.integers(0, 12), replace=False):
                f[bit // 8] ^= 1 << (bit % 8)
            rows.append((key, f.tobytes(), True if small == 3 else bool(k % 2)))
    keys, fps, own = (list(x) for x in zip(*rows, strict=True))
    schema = pa.schema([("key", pa.int64()), ("fp", pa.binary()), ("own", pa.bool_())])
    table = pa.table({"key": keys, "fp": fps, "own": own}, schema=schema)
    found = [(a, b) for out in simhash._wide_links(10, small)(iter(table.to_batches(max_chunksize=cut))) for a, b in zip(out.column("a").to_pylist(), out.column("b").to_pylist(), strict=True)]
    assert all((int.from_bytes(a) ^ int.from_bytes(b)).bit_count() <= 10 for a, b in found)
    got = set()
    for key in set(keys):
        mine = {f for k, f, _ in rows if k == key}
        links = {frozenset(p) for p in found if set(p) <= mine}
        got |= {(key, frozenset(g)) for g in brute.components(mine, lambda a, b, links=links: frozenset((a, b)) in links).values() if len(g) > 1}
    assert got == all_pairs(keys, fps, own, 10) and got


def test_probes_meet_fingerprints_that_differ_in_one_bit_of_a_segment():
    rng = random.Random(4)
    for _ in range(50):
        a = rng.getrandbits(256).to_bytes(32, "big")
        part, bit = rng.randrange(12), rng.randrange(16)
        b = bytearray(rng.getrandbits(256).to_bytes(32, "big"))
        b[2 * part : 2 * part + 2] = (int.from_bytes(a[2 * part : 2 * part + 2], "big") ^ (1 << bit)).to_bytes(2, "big")
        (batch,) = pa.table({"fp": pa.array([a, bytes(b)], pa.binary())}).to_batches()
        keys = {a: {}, bytes(b): {}}
        for out in simhash._wide_probes(12)(iter([batch])):
            for r in out.to_pylist():
                keys[r["fp"]][r["key"]] = r["own"] or keys[r["fp"]].get(r["key"], False)
        assert any(k in keys[bytes(b)] and (own or keys[bytes(b)][k]) for k, own in keys[a].items())
