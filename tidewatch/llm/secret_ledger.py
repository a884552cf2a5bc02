"""Secret scans over an incremental blob ledger.

Every historical version of a path is a blob, named by the SHA-256 of its content.  The ledger lists the (blob, rule, rule
version) pairs that have been scanned; a scan takes each blob that lacks a pair once, however many paths and versions hold
it, and runs only the rules it lacks.  Findings belong to blobs and are joined back to all paths.

``Ledger`` keeps both on disk.  A scan appends the findings first and the pairs after them, so a scan that is lost in between is
done again and loses nothing (equal findings count once).  A new version of a rule is a pair that no blob has; findings of
versions that are no longer in force stay on disk and are not reported.

Positions are code points, ends exclusive.  They come from two built-ins over the same matches: the pieces between matches
and the matches themselves, whose lengths add up to the positions.

Defined cases: null content is the empty blob, null paths are paths, repeated rows and equal contents share one scan, an
empty table scans nothing, extra columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import let, text_of

PAIRS = "blob string, rule string, version int"
FINDINGS = "blob string, rule string, version int, start bigint, end bigint"


@dataclass(frozen=True)
class Rule:
    """``pattern``'s leftmost non-overlapping matches whose ``group`` has ``least`` code points or more."""

    name: str
    pattern: str
    group: int
    least: int
    version: int = 1


#: Fixed values of the base rules, in the order in which findings at one start are listed.  For the last two a
#: counted repeat finds the same matches as "+" with a length test, as a match is a whole run of its class.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)


def blob_of(content: str) -> Column:
    return F.sha2(text_of(content), 256)


def _matches(text: Column, rule: Rule) -> Column:
    """Array of (gap before the match, its length, length of the tested group)."""
    def all_of(group: int) -> Column:
        return F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(group))

    shape = "array<struct<gap:int,len:int,tested:int>>"
    found = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"),
        F.transform(all_of(0), F.length).alias("len"),
        F.transform(all_of(rule.group), F.length).alias("tested"),
    )
    # The piece after the last match has no match of its own.
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), F.filter(found, lambda x: x["len"].isNotNull())).otherwise(F.array()).cast(shape)


def unseen_pairs(blobs: DataFrame, rules: tuple[Rule, ...], ledger: DataFrame | None) -> DataFrame:
    """(blob, lacking: names of the rules to run)."""
    every = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    pairs = blobs.select("blob", F.explode(every).alias("pair")).select("blob", "pair.rule", "pair.version")
    fresh = pairs.join(ledger.select("blob", "rule", "version"), ["blob", "rule", "version"], "left_anti")
    return fresh.groupBy("blob").agg(F.collect_set("rule").alias("lacking"))


def scan(versions: DataFrame, content: str = "text", rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(new ledger pairs, new findings) for the contents in ``versions``, given what ``ledger`` has scanned."""
    blobs = versions.select(blob_of(content).alias("blob"), text_of(content).alias("__text"))
    blobs = blobs.groupBy("blob").agg(F.first("__text").alias("__text"))
    names = F.array(*[F.lit(r.name) for r in rules])
    if ledger is None:
        open_blobs = blobs.withColumn("lacking", names)
    else:
        # The pairs are settled on digests alone; texts of blobs without an open pair drop out before they are scanned.
        digests = versions.select(blob_of(content).alias("blob")).distinct()
        open_blobs = blobs.join(unseen_pairs(digests, rules, ledger), "blob")
    per_rule = []
    for r in rules:
        wanted = F.array_contains("lacking", r.name)
        per_rule.append(F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), wanted.alias("wanted"),
                                 F.when(wanted, _matches(F.col("__text"), r)).alias("matches")))
    scanned = open_blobs.select("blob", F.explode(F.array(*per_rule)).alias("s")).where("s.wanted")
    pairs = open_blobs.select("blob", F.explode("lacking").alias("rule"))
    version = F.create_map(*[x for r in rules for x in (F.lit(r.name), F.lit(r.version))])
    pairs = pairs.withColumn("version", version[F.col("rule")])
    spots = scanned.select("blob", "s.rule", "s.version", F.posexplode("s.matches").alias("pos", "m"))
    up_to = Window.partitionBy("blob", "rule").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.col("m.len")).over(up_to)
    spots = spots.withColumn("end", end).withColumn("start", F.col("end") - F.col("m.len"))
    least = F.create_map(*[x for r in rules for x in (F.lit(r.name), F.lit(r.least))])
    found = spots.where(F.col("m.tested") >= least[F.col("rule")])
    return pairs, found.select("blob", "rule", "version", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


@dataclass(frozen=True)
class Ledger:
    """Scanned pairs and their findings as Parquet below ``path``, a folder of its own per scan."""

    spark: SparkSession
    path: str

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/*")
        except AnalysisException as fault:
            if fault.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    @property
    def pairs(self) -> DataFrame:
        return self._table("pairs", PAIRS)

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """What all scans so far have found by the rules in their present versions."""
        return self._table("findings", FINDINGS).where(F.concat_ws(":", "version", "rule").isin(*[f"{r.version}:{r.name}" for r in rules])).distinct()

    def scan(self, versions: DataFrame, content: str = "text", rules: tuple[Rule, ...] = RULES) -> int:
        """Scan what the ledger lacks of the contents in ``versions``; returns the number of new pairs."""
        name = uuid.uuid4().hex
        pairs, found = scan(versions, content, rules, self.pairs)
        # The findings are computed from the ledger as it is before its pairs grow.
        found.write.parquet(f"{self.path}/findings/{name}")
        pairs.write.parquet(f"{self.path}/pairs/{name}")
        return self.spark.read.schema(PAIRS).parquet(f"{self.path}/pairs/{name}").count()


def by_path(versions: DataFrame, findings: DataFrame, path: str = "doc_id", content: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every path with its blob's findings: (path, blob, spans array ordered by start, then by rule as listed)."""
    place = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))])
    span = F.struct(F.col("start"), place[F.col("rule")].alias("place"), F.col("end"), F.col("rule"))
    per_blob = findings.groupBy("blob").agg(F.sort_array(F.collect_set(span)).alias("spans"))
    paths = versions.select(F.col(path).alias(path), blob_of(content).alias("blob"))
    joined = paths.join(per_blob, "blob", "left")
    none = F.array().cast("array<struct<start:bigint,place:int,end:bigint,rule:string>>")
    return joined.select(path, "blob", F.coalesce("spans", none).alias("spans"))


def digest(paths: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts per rule and the joined spans of ``by_path``."""
    joined = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["rule"], s["start"], s["end"])), ",")

    def count(rule: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["rule"] == rule)).cast("bigint").alias(f"n_{rule}")

    counts = [count(r.name) for r in rules]
    return paths.select(path, *counts, let(joined, lambda j: F.struct(F.sha2(j, 256).alias("sha"), j.alias("spans"))).alias("x")).select(
        path, *[f"n_{r.name}" for r in rules], F.col("x.sha").alias("base_sha256"), F.col("x.spans").alias("spans"))
