"""Language identification by Bayesian evidence fusion.

Text likelihoods come from hashed byte-triple counts per language over all labelled documents.  They are tempered by
``TEMPER``, as the triples of a text are far from independent.  Three kinds of evidence that a text does not hold join them:

* the declared markup language, with reliabilities counted over all records (declared against text language),
* the address suffix and the host, as priors smoothed level by level: all records, then the suffix, then the host; each level's
  counts of text posteriors are one grouped aggregation, and a level with few records leans on the one above.  A record's own
  share is taken out of the counts before it is judged by them.

Records without a text, a declaration or an address are judged by the evidence there is.

Defined cases: null or blank texts have flat likelihoods; rows without a language train nothing; an unknown declaration counts
as none; null hosts and suffixes form levels of their own; equal posteriors go to the first language by name; without any
training language the result is null; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import text_of
from tidewatch.session import materialize

BUCKETS = 4096
TEMPER = 0.05
#: Pseudo-records by which a level leans on the level above.
LEAN = 5.0


def triples(data: bytes) -> np.ndarray:
    """Counts of hashed byte triples of the lower-cased text, blanks included."""
    raw = np.frombuffer(b" " + data.lower() + b" ", dtype=np.uint8).astype(np.uint32)
    hashed = (raw[:-2] * np.uint32(506832829) ^ raw[1:-1] * np.uint32(2654435761) ^ raw[2:] * np.uint32(805459861)) >> np.uint32(20)
    return np.bincount(hashed, minlength=BUCKETS) if data.strip() else np.zeros(BUCKETS, dtype=np.int64)


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order and log probabilities (languages x buckets), from all labelled rows.

    Tasks add up counts before anything moves; the result is as large as the number of languages says.
    """
    def count(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, name in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True):
                held[name] = held.get(name, 0) + triples(t.as_buffer().to_pybytes())
        for name, counts in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * BUCKETS), pa.array(np.arange(BUCKETS, dtype=np.int32)), pa.array(counts.astype(np.int64))], names=["lang", "bucket", "n"])

    rows = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), text_of(text).alias("text"))
    counts = rows.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("c")).orderBy("lang").collect()
    if not found:
        return [], np.zeros((0, BUCKETS))
    table = np.zeros((len(found), BUCKETS))
    for i, r in enumerate(found):
        table[i, [c.bucket for c in r.c]] = [c.n for c in r.c]
    table += 0.5
    return [r.lang for r in found], np.log(table / table.sum(axis=1, keepdims=True))


def likelihoods(log_p: np.ndarray, temper: float = TEMPER):
    """Column function: text to tempered log likelihoods, the best at zero."""
    turned = np.ascontiguousarray(log_p.T)

    @F.arrow_udf("array<double>")
    def of(texts: pa.Array) -> pa.Array:
        out = np.zeros((len(texts), turned.shape[1]))
        for i, t in enumerate(texts):
            ll = triples(t.as_buffer().to_pybytes()) @ turned
            out[i] = temper * (ll - ll.max())
        flat = pa.array(out.reshape(-1))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, turned.shape[1], dtype=np.int32)), flat)

    return of


def markup_language(html: Column) -> Column:
    """The language a page declares for itself, two or three lower-case letters, else null."""
    return F.lower(F.nullif(F.regexp_extract(html, r"""(?is)<html\b[^<>]*?\blang\s*=\s*["']?([a-z]{2,3})\b""", 1), F.lit("")))


_OPENS = re.compile(r"<(script|style|nav|head)\b|<!--", re.I)
_CLOSES = re.compile(r"</(script|style|nav|head)\s*>|-->", re.I)
_ENTITY = re.compile(r"&[a-zA-Z]{1,8};|&#[0-9]{1,7};")


def shown(html: str) -> str:
    """The text of a page: hidden elements and comments that are closed, tags and entities give way to blanks.

    The places of all closings are listed once, so a page with many unclosed tags takes no longer than another of its size;
    an unclosed tag hides nothing but itself.
    """
    closings: dict[str, list[tuple[int, int]]] = {}
    for m in _CLOSES.finditer(html):
        closings.setdefault((m[1] or "").lower(), []).append((m.start(), m.end()))
    kept, at = [], 0
    next_of = dict.fromkeys(closings, 0)
    for m in _OPENS.finditer(html):
        if m.start() < at:
            continue
        name = (m[1] or "").lower()
        ends = closings.get(name, [])
        i = next_of.get(name, 0)
        while i < len(ends) and ends[i][0] < m.end():
            i += 1
        next_of[name] = i
        if i < len(ends):
            kept.append(html[at : m.start()])
            at = ends[i][1]
    kept.append(html[at:])
    text, out, at = " ".join(kept), [], 0
    while (start := text.find("<", at)) >= 0 and (end := text.find(">", start)) >= 0:
        out.append(text[at:start])
        at = end + 1
    out.append(text[at:])
    return _ENTITY.sub(" ", " ".join(out))


def visible_text(html: Column) -> Column:
    """``shown`` as a column; null pages are empty."""

    @F.arrow_udf("string")
    def text(pages: pa.Array) -> pa.Array:
        return pa.array([shown(p) for p in pages.to_pylist()], pa.string())

    return text(F.coalesce(html, F.lit("")))


def host_of(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1), F.lit("")))


def suffix_of(host: Column) -> Column:
    return F.nullif(F.regexp_extract(host, r"([^.]+)$", 1), F.lit(""))


def _normal(logs: Column) -> Column:
    """Probabilities of an array of logs."""
    top = F.array_max(logs)
    return F.transform(F.array(F.struct(F.transform(logs, lambda x: F.exp(x - top)).alias("e"))),
                       lambda s: F.transform(s["e"], lambda x: x / F.aggregate(s["e"], F.lit(0.0), lambda a, b: a + b)))[0]


def _sums(rows: DataFrame, keys: list[str], n: int, name: str) -> DataFrame:
    summed = rows.groupBy(*keys).agg(F.array(*[F.sum(F.col("post")[i]) for i in range(n)]).alias(name))
    return summed


def identify(records: DataFrame, langs: list[str], log_p: np.ndarray, keep: list[str], lean: float = LEAN, temper: float = TEMPER) -> DataFrame:
    """``keep`` columns plus lang, posterior, text_lang and declared for records (text, declared, host, suffix)."""
    result = [*keep, "lang", "posterior", "text_lang", "declared"]
    if not langs:
        none = {"lang": "string", "posterior": "double", "text_lang": "string"}
        return records.withColumns({k: F.lit(None).cast(v) for k, v in none.items()}).select(*result)
    n = len(langs)
    known = F.array(*[F.lit(x) for x in langs])
    ll = likelihoods(log_p, temper)(text_of("text"))
    rows = records.select(*keep, F.when(F.col("declared").isin(*langs), F.col("declared")).alias("declared"), "host", "suffix", ll.alias("ll"))
    rows = materialize(rows.withColumn("post", _normal(F.col("ll"))), "language-evidence")
    best = lambda p: F.element_at(known, F.array_position(p, F.array_max(p)).cast("int"))

    # How far a declaration can be trusted: languages x languages counts at most.
    counted = rows.where("declared IS NOT NULL").groupBy("declared", best(F.col("post")).alias("t")).count().collect()
    trust = np.full((n, n), 1.0)
    for r in counted:
        trust[langs.index(r["t"]), langs.index(r["declared"])] += r["count"]
    trust = np.log(trust / trust.sum(axis=1, keepdims=True))
    declared = F.lit(None).cast("array<double>")
    for j, name in enumerate(langs):
        declared = F.when(F.col("declared") == name, F.array(*[F.lit(float(x)) for x in trust[:, j]])).otherwise(declared)

    whole = rows.agg(F.array(*[F.sum(F.col("post")[i]) for i in range(n)]).alias("s")).first()["s"]
    suffixes = _sums(rows, ["suffix"], n, "by_suffix").withColumnRenamed("suffix", "__suffix")
    hosts = _sums(rows, ["suffix", "host"], n, "by_host").withColumnsRenamed({"suffix": "__h_suffix", "host": "__host"})
    levels = hosts.join(suffixes, F.col("__h_suffix").eqNullSafe(F.col("__suffix"))).drop("__suffix")
    joined = rows.join(levels, F.col("suffix").eqNullSafe(F.col("__h_suffix")) & F.col("host").eqNullSafe(F.col("__host")), "left")

    def smoothed(counts: Column, above: Column) -> Column:
        others = F.zip_with(counts, F.col("post"), lambda c, own: F.greatest(c - own, F.lit(0.0)))
        total = F.aggregate(others, F.lit(0.0), lambda a, b: a + b)
        return F.zip_with(others, above, lambda c, up: (c + lean * up) / (total + lean))

    grand = F.zip_with(F.array(*[F.lit(float(x or 0.0)) for x in whole]), F.col("post"), lambda c, own: F.greatest(c - own, F.lit(0.0)) + 1.0)
    joined = joined.withColumn("__g", grand)
    joined = joined.withColumn("__p0", F.transform("__g", lambda x: x / F.aggregate(F.col("__g"), F.lit(0.0), lambda a, b: a + b)))
    joined = joined.withColumn("__p1", smoothed(F.col("by_suffix"), F.col("__p0")))
    joined = joined.withColumn("__p2", smoothed(F.col("by_host"), F.col("__p1")))
    evidence = F.zip_with(F.col("ll"), F.col("__p2"), lambda a, p: a + F.log(p))
    evidence = F.zip_with(evidence, F.coalesce(declared, F.array(*[F.lit(0.0)] * n)), lambda a, b: a + b)
    fused = joined.withColumn("__f", evidence).withColumn("__f", _normal(F.col("__f")))
    return fused.select(*keep, best(F.col("__f")).alias("lang"), F.array_max("__f").alias("posterior"), best(F.col("post")).alias("text_lang"), "declared")
