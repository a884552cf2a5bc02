import hashlib
import random
import zlib

import brute_force as brute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import periodic_runs, queries


def runs(words, least=6, times=4):
    """Every maximal stretch that repeats q words on, less those with a smaller period."""
    found = []
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, times * q):
                if not any(all(words[i + k] == words[i + k + d] for k in range(length - d)) for d in range(1, q)):
                    found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def rows(found):
    return [tuple(map(int, r)) for r in found]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 70), st.integers(1, 5))
def test_runs_match_all_stretches(seed, n, letters):
    rnd = random.Random(seed)
    words = [rnd.randint(1, letters) for _ in range(n)]
    for _ in range(rnd.randint(0, 2) if n else 0):
        a, p = rnd.randrange(n), rnd.randint(1, 9)
        words[a:] = [words[a + (i - a) % min(p, n - a)] for i in range(a, n)]
    assert rows(periodic_runs.find_runs(words)) == runs(words)
    if n:  # on the whole sequence too, uncut, and by other limits
        assert rows(periodic_runs.runs_of(words)) == runs(words)
        assert rows(periodic_runs.find_runs(words, 4, 2)) == runs(words, 4, 2)


@pytest.mark.parametrize("text", ["", "x", "banana", "abracadabra", "aaaa", "mississippi"])
def test_tree_orders_suffixes_and_extends(text):
    symbols = [ord(c) - 96 for c in text]
    tree = periodic_runs.SuffixTree(symbols)
    places = range(len(symbols) + 1)
    rank, turns = tree.tour()
    assert sorted(places, key=lambda i: symbols[i:]) == sorted(places, key=lambda i: rank[i])
    back = tree.tour(reverse=True)[0]
    assert sorted(places, key=lambda i: [-s for s in symbols[i:]]) == sorted(places, key=lambda i: back[i])
    extend = periodic_runs.Extensions(rank, turns)
    for i in places:
        for j in places:
            if i != j:
                want = next((k for k in range(len(text)) if symbols[i + k : i + k + 1] != symbols[j + k : j + k + 1] or not symbols[i + k : i + k + 1]), len(text))
                assert extend(periodic_runs.np.array([i]), periodic_runs.np.array([j]))[0] == want


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = runs(words) if n < 5000 else rows(periodic_runs.runs_of([hash(w) % 10**9 + 1 for w in words]))
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(found), *(best or (None, None, None)), best and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def key(row):
    return tuple((v is None, v if v is not None else 0) for v in row)


def test_query_matches_plain_version(spark):
    root = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((expected(*r) for r in docs if len((r.text or "").split()) < 1500), key=key)
    kept = {r[0] for r in want}
    got = sorted((tuple(r) for r in queries.op11_periodic_runs(spark, root).collect() if r.doc_id in kept), key=key)
    assert got == want
    assert any(r[1] for r in got)


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    texts = [(i, t, "en", "a") for i, t in enumerate([None, "", " \t\n ", "a " * 6, "a " * 5, "x y z w " * 4, "a b " * 3 + "a", "b a a a a a a c c c c c c d", "  " * 7, "tie q q q q q q r s s s s s s"])]
    texts += [(31, "one two", "en", "a")] * 2 + [(None, "x y " * 9, "en", "a")] * 2 + [(99, "k l m " * 9000 + "end", "en", "a")]
    docs = brute.dirty(spark, texts).selectExpr("*", "1 AS runs", "2 AS collapsed", "3 AS start", "4 AS words")
    out = periodic_runs.with_runs(docs)
    assert sorted(out.columns) == sorted(docs.columns)
    for r in out.collect():
        words = (r.text or "").split(" ") if r.text and " " in r.text else (r.text or "").split()
        words = [w for w in words if w]
        assert [tuple(x) for x in r.runs] == (runs(words) if len(words) < 5000 else [(0, 27000, 3)])
        dropped = {i for s, length, q in r.runs for i in range(s + q, s + length)} if len(words) < 5000 else set(range(3, 27000))
        assert r.collapsed == " ".join(w for i, w in enumerate(words) if i not in dropped)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()), key=key)
    assert got == sorted((expected(i, t) for i, t, _, _ in texts), key=key)


def test_empty_table(spark, tmp_path):
    brute.empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op11_periodic_runs(spark, str(tmp_path)).count() == 0
