import random
import re
from collections import Counter, defaultdict

import brute_force as brute

from tidewatch.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def audit(rows, least=10, top=10):
    """(lang, source, text) rows to the whole report."""
    terms = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for lang, source, text in rows]
    docs, counts, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, found in terms:
        docs[lang].update(set(found))
        sources[lang].add(source)
        counts[lang, source].update(found)
    out = []
    for lang, its in sources.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)

        def chance(count, total, v=v):
            return 1 + 1000000000 * (count + 2) // (total + 2 * v)

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        total = {s: sum(counts[lang, s][t] for t in kept) for s in its}
        p = {s: {t: chance(counts[lang, s][t], total[s]) for t in kept} for s in its}
        q = {t: chance(sum(counts[lang, s][t] for s in its), sum(total.values())) for t in kept}
        for s in its:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in its - {s}]
            words = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(words)[:top])):
                out += [(lang, s, part, item, -value, rank) for rank, (value, _, item) in enumerate(found, 1)]
    return sorted(out)


def docs_of(spark, rows):
    made = brute.dirty(spark, [(i, t, lang, s) for i, (lang, s, t) in enumerate(rows)])
    return made.selectExpr("*", "1 AS term", "2 AS n", "3 AS value", "4 AS rank", "5 AS part", "6 AS n_docs", "7 AS total", "8 AS terms", "9 AS p")


def got(spark, rows, **options):
    return sorted(tuple(r) for r in divergence.audit(docs_of(spark, rows), **options).collect())


def test_matches_plain_version(spark):
    rnd = random.Random(7)
    vocabulary = ["a", "an", "ant", "antelope", "Antelopes", "antelopes-herd", "é", "éclair", "éclairs", "日本", "日本語", "x" * 40, "x" * 41, "y" * 300, "1", "mid9dle", "ÀB", " ", "of", "the", "q"]
    rows = [(rnd.choice(["en", "fr", None, ""]), rnd.choice(["s1", "s2", "ß", None]), " ".join(rnd.choices(vocabulary, k=rnd.randint(0, 25)))) for _ in range(220)]
    rows += [("rare", "a", "only here"), ("rare", "b", None), ("rare", "b", "1 2 3"), ("alone", "a", "alone " * 3)] + [("same", "a", "copy of one text")] * 12
    assert got(spark, rows) == audit(rows)
    assert got(spark, rows, least=3, top=2) == audit(rows, 3, 2)


def test_thresholds_count_documents_not_occurrences(spark):
    rows = [("en", "a", "often " * 50 + "prefix" + "abcdefghijk"[i]) for i in range(9)] + [("en", "b", "common")] * 10
    rows += [("en", "b", "prefixes prefix prefix prefixes")] * 10
    kept = divergence.kept_terms(docs_of(spark, rows).select("lang", "source", "text"))
    assert {bytes(r.term).decode(): r.n_docs for r in kept.collect()} == {"common": 10, "prefix": 10, "prefixes": 10}
    assert got(spark, rows) == audit(rows)


def test_many_blocks_and_small_holds(spark, monkeypatch):
    rnd = random.Random(3)
    rows = [("en", f"s{rnd.randrange(6)}", " ".join(f"w{chr(97 + rnd.randrange(20))}{chr(97 + rnd.randrange(6))}" for _ in range(30))) for _ in range(150)]
    monkeypatch.setattr(divergence, "_CELLS", 40)
    assert got(spark, rows) == audit(rows)


def test_full_bit_table_only_lets_more_through(spark, monkeypatch):
    monkeypatch.setattr(divergence, "_bit_table", lambda left: divergence.np.full(divergence.BITS // 8, 255, dtype=divergence.np.uint8))
    rows = [("en", "ab"[i % 2], f"shared longprefixed{'xyz'[i % 3]} longprefixedword{i}") for i in range(40)]
    assert got(spark, rows) == audit(rows)


def test_empty_table(spark):
    assert divergence.audit(brute.empty(spark)).count() == 0


def test_exact_beyond_64_bits(spark):
    row = spark.range(1).selectExpr("20000000000000 AS n", "70000000000001 AS total", "3 AS v").select(divergence._p("n", "total", "v").alias("p")).first()
    assert row.p == 1 + 1000000000 * (20000000000000 + 2) // (70000000000001 + 6)
