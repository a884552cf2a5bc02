from pyspark.sql import functions as F

import brute_force as brute
from tidewatch.llm import quality_rules, queries
from tidewatch.llm.common import text_of

ROOT = "/root/testdata/sf0.001"
COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def check(frame):
    got = quality_rules.with_measures(frame.withColumnRenamed("n_words", "was")).collect()
    want = sorted(repr((r.doc_id, brute.measures(r.text))) for r in frame.collect())
    assert sorted(repr((r.doc_id, tuple(r[c] for c in COLUMNS))) for r in got) == want
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in got)


def test_measures_match_plain_counts(spark):
    check(spark.read.parquet(f"{ROOT}/documents.parquet"))


def test_odd_rows(spark):
    check(brute.dirty(spark))
    check(brute.empty(spark))
    texts = ["a b c d e a b c d e", "a a a a a a a", "a b c d e f g a b c d e f g h", "x\ny\nx\n\n \n", "a b c d", "p q r s t u p q r s t v p q r s t"]
    check(brute.dirty(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]))


def test_order_changes_the_cost_not_the_verdict(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    fitted = quality_rules.fit_order(docs, least_seconds=0.02)
    assert {r.name for r, _, _ in fitted} == {r.name for r in quality_rules.RULES} and all(cost > 0 for *_, cost in fitted)
    alone = {r.name: {x.doc_id for x in docs.where(F.coalesce(r.rejects(quality_rules.Facts(text_of("text"))), F.lit(False))).collect()} for r in quality_rules.RULES}
    # Each rule's share is of the rows that those before it leave, and no later rule has more merit there.
    costs, left = {r.name: cost for r, _, cost in fitted}, {x.doc_id for x in docs.collect()}
    for k, (r, share, _) in enumerate(fitted):
        merits = {x.name: len(alone[x.name] & left) / len(left) / costs[x.name] for x, _, _ in fitted[k:]}
        assert share == len(alone[r.name] & left) / len(left) and merits[r.name] == max(merits.values())
        left -= alone[r.name]
    orders = [[r for r, _, _ in fitted], list(reversed(quality_rules.RULES))]
    for order in orders:
        for r in quality_rules.cascade(docs, order).collect():
            hit = [x.name for x in order if r.doc_id in alone[x.name]]
            assert r.rejected_by == (hit[0] if hit else None)
    assert [r.name for r, _, _ in quality_rules.fit_order(brute.empty(spark))] == [r.name for r in quality_rules.RULES]


def test_a_dear_rule_costs_more_than_a_cheap_one(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    cheap = quality_rules.Rule("cheap", lambda f: F.length(f.text) < 5)
    dear = quality_rules.Rule("dear", lambda f: F.length(F.sha2(F.repeat(f.text, 3), 512)) < 5)
    for _ in range(2):
        costs = {r.name: c for r, _, c in quality_rules.fit_order(docs, (dear, cheap))}
        assert costs["dear"] > 3 * costs["cheap"]


def test_clean_documents_stay_and_junk_goes(spark):
    root = ROOT.replace("0.001", "0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{root}/labels.parquet").collect()}
    rows = queries.op3_quality_rules(spark, root).collect()
    good = [r for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r for r in rows if labels.get(r.doc_id) == 0]
    assert all(r.kept for r in good) and sum(not r.kept for r in bad) > 0.9 * len(bad)
