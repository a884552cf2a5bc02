"""Registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import chat, decontamination, divergence, langid, mil, mixing, periodic_runs, quality_rules, secret_ledger, sharding, simhash, token_counts, warc
from tidewatch.llm.common import text_of, words_of
from tidewatch.llm.oracles import SQL
from tidewatch.session import scratch_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_language_id(spark: SparkSession, root: str) -> DataFrame:
    """Documents (declared language, source as host) and pages (markup, address) as one set of records."""
    docs = table(spark, root, "documents")
    langs, log_p = langid.train(docs)
    none = F.lit(None)
    of_docs = docs.select("doc_id", none.cast("bigint").alias("page_id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"), none.cast("string").alias("suffix"))
    host = langid.host_of(F.col("url"))
    of_pages = table(spark, root, "pages").select(none.cast("bigint").alias("doc_id"), "page_id", langid.visible_text(F.col("html")).alias("text"),
                                                  langid.markup_language(F.col("html")).alias("declared"), host.alias("host"), langid.suffix_of(host).alias("suffix"))
    return langid.identify(of_docs.unionByName(of_pages), langs, log_p, ["doc_id", "page_id"])


@query
def op2_secret_scan(spark: SparkSession, root: str) -> DataFrame:
    """The sources come in two increments, each scanned against the ledger of what came before; all paths get the findings of their blobs."""
    docs = table(spark, root, "documents")
    ledger = secret_ledger.Ledger(spark, scratch_path(spark, "secret-ledger"))
    second = F.pmod(F.xxhash64("source"), F.lit(2)) == 1
    ledger.scan(docs.where(~second))
    ledger.scan(docs.where(second))
    return secret_ledger.digest(secret_ledger.by_path(docs, ledger.findings()), "doc_id")


@query
def op3_quality_rules(spark: SparkSession, root: str) -> DataFrame:
    """The base measures are asked for on every row, so the base test comes first; the other rules run in fitted order on what is left."""
    docs = table(spark, root, "documents")
    order = [r for r, _, _ in quality_rules.fit_order(docs)]
    measured = quality_rules.with_measures(docs.select("doc_id", "text"))
    judged = quality_rules.cascade(measured, order, first=[("base", F.col("base_failed"))], known=("n_words", "word_chars", "n_symbols"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rejected_by").isNull().alias("kept"))


@query
def op4_sharding(spark: SparkSession, root: str) -> DataFrame:
    """One row per document with its shard; equal texts share one, a null text has size 1."""
    docs = table(spark, root, "documents").select("doc_id", F.crc32(text_of("text")).alias("text_crc32"), "text")
    sharded = sharding.shard(docs)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op5_decontamination(spark: SparkSession, root: str) -> DataFrame:
    """One row per document with a trace of a benchmark item, with the items."""
    found = decontamination.traces(table(spark, root, "documents"), table(spark, root, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.array_join("item_ids", ",").alias("item_ids"), F.col("n_items").cast("bigint").alias("n_items"), "coverage", "verbatim")


@query
def op6_simhash(spark: SparkSession, root: str) -> DataFrame:
    """One row per document with its fingerprint and the least id it reaches."""
    return simhash.classes(table(spark, root, "documents"))


@query
def op7_arc_to_warc(spark: SparkSession, root: str) -> DataFrame:
    """Pages go out as ARC files, are converted to WARC files, and the rows come from reading those."""
    arc, out = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    warc.write_arc(table(spark, root, "pages"), arc)
    warc.convert(spark, arc, out)
    rows = warc.read_warc(spark, out)
    return rows.select(F.col("key").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to").cast("bigint").alias("refers_to"))


@query
def op8_quality_classifier(spark: SparkSession, root: str) -> DataFrame:
    """One row per document with its score; the fit sees no row that is held out."""
    docs = table(spark, root, "documents")
    model = mil.fit(docs, table(spark, root, "labels"))
    return mil.with_scores(docs.select("doc_id", "text", mil.held_out("doc_id").alias("held_out")), model).select("doc_id", "held_out", "score", "predicted")


@query
def op9_mixing(spark: SparkSession, root: str) -> DataFrame:
    """One row per document with the words that the mix takes of it."""
    return mixing.plan(table(spark, root, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


@query
def op10_token_counts(spark: SparkSession, root: str) -> DataFrame:
    """One row per document with its words and pieces; blank texts have none."""
    return token_counts.with_counts(table(spark, root, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_tokens")


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the words of a tenth of the documents, chosen by id, repeat from some word on; all other texts, and those without id, stay."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("int")
    words, n, a, p = (F.col(c) for c in ("words", "n", "a", "p"))
    cut = docs.select("doc_id", text_of("text").alias("text"), F.when(h % 10 == 0, words_of(text_of("text"))).alias("words"), g.alias("g"))
    sized = cut.select("*", F.size("words").alias("n")).select("*", F.expr("g % n").alias("a"))
    timed = sized.select("*", F.floor((n - a) / (3 + F.col("g") % 8)).cast("int").alias("whole")).select("*", (F.col("whole") + 1).alias("p"))
    repeats = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    repeated = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(repeats, F.lit(1), n - a)), " ")
    return timed.select("doc_id", F.when(n > 0, repeated).otherwise(F.col("text")).alias("text"))


@query
def op11_periodic_runs(spark: SparkSession, root: str) -> DataFrame:
    """One row per document; null and blank texts have no runs, a null id has no planted repeat."""
    docs = table(spark, root, "documents")
    found = periodic_runs.with_runs(planted(docs))
    best = found.select("doc_id", "runs", "collapsed", periodic_runs.longest(F.col("runs")).alias("best"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return best.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query
def op12_chat_formatting(spark: SparkSession, root: str) -> DataFrame:
    """One row per conversation, and one for a conversation -1 whose texts look like control strings; all figures come from the rendered text."""
    rows = table(spark, root, "conversations").select("conv_id", "turn", "role", "text")
    odd = [(-1, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))]
    rendered = chat.formatted(rows.unionByName(spark.createDataFrame(odd, "conv_id bigint, turn bigint, role string, text string")))
    read = chat.read_back(rendered)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("bigint").alias("formatted_chars"))


@query
def op13_source_divergence(spark: SparkSession, root: str) -> DataFrame:
    """Each (lang, source) against the other sources of its language, and the terms that stand out in it."""
    return divergence.audit(table(spark, root, "documents"))


def load() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in QUERIES}
