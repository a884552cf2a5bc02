import hashlib

import brute_force as brute
from tidewatch.llm import queries, secret_ledger
from tidewatch.llm.secret_ledger import RULES, Rule

ROOT = "/root/testdata/sf0.01"


def spans(text):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in brute.secrets(text))


def check(frame):
    _, found = secret_ledger.scan(frame)
    got = secret_ledger.digest(secret_ledger.by_path(frame, found), "doc_id").collect()
    want = sorted((repr(r.doc_id), spans(r.text)) for r in frame.collect())
    assert sorted((repr(r.doc_id), r.spans) for r in got) == want
    for r in got:
        assert r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [r.spans.count(f"{k}:") for k in ("assign", "access", "hex")]
    return got


def test_spans_match_a_plain_scan(spark):
    got = check(spark.read.parquet(f"{ROOT}/documents.parquet"))
    assert sum(r.n_assign for r in got) and len(got) == queries.op2_secret_scan(spark, ROOT).count()


def test_odd_rows(spark):
    texts = ["secret: token: abcdef", "Token='abcdefgh' API_KEY=x apikey  :  \"a.b/c+d=\"", "AKIAAKIA" + "Q" * 12, "AKIA" + "Z" * 15, "f" * 24 + "g" + "0" * 23, "é" * 9 + "passwd:=======",
             "\U0001f511" * 3 + "api_key = abc-def_ghi" + "\U0001f511" + "a1" * 12, "password=abcde", "secret=abcdef" * 500]
    check(brute.dirty(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]))
    check(brute.dirty(spark))
    check(brute.empty(spark))


def test_only_unseen_pairs_are_scanned(spark):
    first = brute.dirty(spark, [(1, "token=abcdef", "en", "s"), (2, "token=abcdef", "en", "s"), (3, "nothing", "en", "s")])
    pairs, found = secret_ledger.scan(first)
    assert pairs.count() == 2 * len(RULES) and found.count() == 1
    ledger = spark.createDataFrame(pairs.collect(), pairs.schema)
    again, none = secret_ledger.scan(first, ledger=ledger)
    assert again.count() == 0 and none.count() == 0
    # A new version of one rule, and a new blob beside an old one.
    rules = (Rule("assign", r"(?i)token=([a-z]+)", 1, 3, version=2), *RULES[1:])
    both = first.union(brute.dirty(spark, [(4, "token=xyz AKIA" + "7" * 16, "en", "s")]))
    more, new = secret_ledger.scan(both, rules=rules, ledger=ledger)
    blobs = {r.text: r.blob for r in both.select("text", secret_ledger.blob_of("text").alias("blob")).collect()}
    assert {(r.blob, r.rule, r.version) for r in more.collect()} == {(blobs["token=abcdef"], "assign", 2), (blobs["nothing"], "assign", 2)} | {
        (b, r.name, r.version) for r in rules for t, b in blobs.items() if t.startswith("token=xyz")}
    paths = secret_ledger.by_path(both, new, rules=rules).collect()
    assert {r.doc_id: [s.rule for s in r.spans] for r in paths} == {1: ["assign"], 2: ["assign"], 3: [], 4: ["assign", "access"]}


def test_a_stored_ledger_does_no_work_twice_and_loses_nothing(spark, tmp_path):
    ledger = secret_ledger.Ledger(spark, str(tmp_path / "ledger"))
    first = brute.dirty(spark, [(1, "token=abcdef", "en", "s"), (2, "token=abcdef", "en", "s"), (3, None, None, None)])
    second = first.union(brute.dirty(spark, [(4, "AKIA" + "7" * 16 + " token=abcdef", "en", "t"), (1, "nothing now", "en", "s")]))
    assert ledger.findings().count() == 0 and ledger.pairs.count() == 0

    def reported(docs, rules=RULES):
        return sorted((r.doc_id, [s.rule for s in r.spans]) for r in secret_ledger.by_path(docs, ledger.findings(rules), rules=rules).collect())

    assert ledger.scan(first) == 2 * len(RULES)
    assert reported(first) == [(1, ["assign"]), (2, ["assign"]), (3, [])]
    assert ledger.scan(second) == 2 * len(RULES)  # the two new blobs
    want = [(1, []), (1, ["assign"]), (2, ["assign"]), (3, []), (4, ["access", "assign"])]
    assert reported(second) == want
    assert ledger.scan(second) == 0 and reported(second) == want
    # Of a rule's new version every blob is unseen, and what the old one found is no longer reported.
    rules = (Rule("assign", r"(?i)token=([a-z]+)$", 1, 6, version=2), *RULES[1:])
    assert ledger.scan(second, rules=rules) == 4
    assert reported(second, rules) == want and reported(second) == want


def test_a_lost_scan_is_done_again(spark, tmp_path):
    """Findings without their pairs, as a scan leaves them that ends in between."""
    docs = brute.dirty(spark, [(1, "token=abcdef", "en", "s")])
    ledger = secret_ledger.Ledger(spark, str(tmp_path / "ledger"))
    secret_ledger.scan(docs)[1].write.parquet(f"{ledger.path}/findings/lost")
    assert ledger.scan(docs) == len(RULES)
    assert [len(r.spans) for r in secret_ledger.by_path(docs, ledger.findings()).collect()] == [1]
