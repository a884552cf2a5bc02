import brute_force as brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import langid, queries

ROOT = "/root/testdata/sf0.001"


def test_documents_and_pages_get_their_language(spark):
    rows = queries.op1_language_id(spark, ROOT).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()}
    pages = {r.page_id: r for r in spark.read.parquet(f"{ROOT}/pages.parquet").collect()}
    assert len(rows) == len(docs) + len(pages)
    assert np.mean([r.lang == docs[r.doc_id].lang for r in rows if r.doc_id is not None]) > 0.98
    assert np.mean([f'lang="{r.lang}"' in pages[r.page_id].html for r in rows if r.page_id is not None]) > 0.95
    assert all(0 < r.posterior <= 1 + 1e-12 for r in rows)


RECORDS = "rid bigint, text string, declared string, host string, suffix string, ll string, post string"


def plain(records, langs, log_p):
    """The fusion record by record, on whole tables of posteriors."""
    n = len(langs)
    ll = np.zeros((len(records), n))
    for i, r in enumerate(records):
        x = langid.triples((r.text or "").encode()) @ log_p.T
        ll[i] = langid.TEMPER * (x - x.max())
    post = np.exp(ll) / np.exp(ll).sum(axis=1, keepdims=True)
    trust = np.ones((n, n))
    for i, r in enumerate(records):
        if r.declared in langs:
            trust[post[i].argmax(), langs.index(r.declared)] += 1
    trust /= trust.sum(axis=1, keepdims=True)
    out = []
    for i, r in enumerate(records):
        def others(same):
            return np.maximum(sum(post[j] for j, x in enumerate(records) if same(x)) - post[i], 0)

        prior = others(lambda x: True) + 1
        prior = prior / prior.sum()
        for same in (lambda x: x.suffix == r.suffix, lambda x: (x.suffix, x.host) == (r.suffix, r.host)):
            c = others(same)
            prior = (c + langid.LEAN * prior) / (c.sum() + langid.LEAN)
        logs = ll[i] + np.log(prior) + (np.log(trust[:, langs.index(r.declared)]) if r.declared in langs else 0)
        p = np.exp(logs - logs.max())
        out.append(p / p.sum())
    return np.array(out)


def test_fusion_matches_a_plain_version_on_odd_records(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    langs, log_p = langid.train(docs)
    texts = [r.text for r in docs.limit(8).collect()]
    rows = [(i, [t[:40], t[:7], "", None, " \n"][i % 5], ["en", "fr", None, "xx", "de"][i % 5], ["a.fr", "b.fr", None, "c.de", ""][i % 5 if i % 3 else 0], ["fr", "fr", None, "de", ""][i % 5 if i % 3 else 0], "x", "y") for i, t in enumerate(texts * 4)]
    records = spark.createDataFrame(rows + rows[:3], RECORDS)
    got = {r.rid: r for r in langid.identify(records, langs, log_p, ["rid"]).collect()}
    local = records.collect()
    for r, p in zip(local, plain(local, langs, log_p), strict=True):
        assert got[r.rid].posterior == pytest.approx(p.max(), rel=1e-9) and got[r.rid].lang == langs[int(p.argmax())]


def test_evidence_decides_where_the_text_cannot(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    langs, log_p = langid.train(docs)
    french = [r.text for r in docs.where("lang = 'fr'").limit(12).collect()]
    rows = [(i, t, "fr", "h.example", "example", "", "") for i, t in enumerate(french)] + [(100, "", None, "h.example", "example", "", ""), (101, "", "de", None, None, "", ""), (102, "", None, "other.example", "example", "", "")]
    got = {r.rid: r for r in langid.identify(spark.createDataFrame(rows, RECORDS), langs, log_p, ["rid"]).collect()}
    assert got[100].lang == "fr" and got[102].lang == "fr" and got[100].posterior > got[102].posterior


def test_odd_tables(spark):
    assert langid.train(brute.empty(spark))[0] == []
    langs, log_p = langid.train(brute.dirty(spark))
    assert langs == sorted({"en", "fr", "de", "xx"})
    records = brute.dirty(spark).select("doc_id", "text", F.col("lang").alias("declared"), F.col("source").alias("host"), F.lit(None).cast("string").alias("suffix"))
    assert langid.identify(records, langs, log_p, ["doc_id"]).count() == records.count()
    assert langid.identify(records, [], np.zeros((0, langid.BUCKETS)), ["doc_id"]).where("lang IS NULL").count() == records.count()
    assert langid.identify(records.limit(0), langs, log_p, ["doc_id"]).count() == 0


def test_markup_and_addresses(spark):
    rows = [("<!doctype html><HTML class=x lang='De-AT'><body>a<script>b</script>c&amp;<!-- d --></body>", "https://u@WWW.Example.co.UK:80/p?q#f"), ("<html><p lang=fr>x", "no address"), (None, None)]
    got = spark.createDataFrame(rows, "html string, url string").select(langid.markup_language(F.col("html")), F.trim(langid.visible_text(F.col("html"))), langid.host_of(F.col("url")), langid.suffix_of(langid.host_of(F.col("url")))).collect()
    assert [g[0] for g in got] == ["de", None, None] and got[0][1].split() == ["a", "c"] and [tuple(g)[2:] for g in got] == [("www.example.co.uk", "uk"), (None, None), (None, None)]


def test_broken_pages_take_linear_time():
    import time

    for page in ("<script x " * 500_000, "<" * 5_000_000, "<!-- " * 1_000_000, "<style>" * 700_000 + "</style>", "&" * 5_000_000, "<html " * 900_000, "<nav></nav " * 400_000):
        began = time.perf_counter()
        langid.shown(page)
        assert time.perf_counter() - began < 5


def test_text_of_a_page():
    page = "<html><head><title>no</title></head><body>one<SCRIPT>if (a<b) {}</script >two<!-- x <b> -->three<script src=x>four<p class='>'>five&amp;six < seven<br"
    assert langid.shown(page).split() == ["one", "two", "three", "four", "'>five", "six", "<", "seven<br"]
    assert langid.shown("") == "" and langid.shown("<nav>a<nav>b</nav>c</nav>d").split() == ["c", "d"]
