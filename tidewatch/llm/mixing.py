"""Mixing sources to target weights by repetition rates.

Tokens (words) are summed per source, every source gets a target, and a document is emitted ``floor(rate)`` times plus one
more time with probability ``rate - floor(rate)``, decided by a hash of its id, so that a rerun or a retried task draws alike.

Targets: all sources together get ``share`` of all words.  Sources in code-point order (null last) weigh ``weights`` in
turn.  No source is repeated more than ``max_repeat`` times: what it cannot take is dealt to the others by weight until none
is above its limit.

Defined cases: null text has no words and is emitted like any other document; a null source is a source of its own; a
source without words has target and rate 0; repeated rows draw alike, each for itself; an empty table gives no rows.  Extra
columns pass through ``mix`` untouched; result columns of ``plan`` come from the listed inputs only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import WORD, text_of
from tidewatch.session import materialize

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEAT = 3
SEED = "mix-1"
#: Sources whose rates are broadcast at most (about 100 bytes each); beyond that the rates join by shuffle.
BROADCAST_SOURCES = 200_000
_HEX = 13  # 52 bits of the digest, exact in a double


def word_count(text: str) -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("bigint")


def source_targets(sized: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, share: float = 1.0) -> DataFrame:
    """(source, source_size, target, rate) from rows of (source, size).

    Works on one row per source.  With sources in order of ``limit / weight`` the limited ones come first, so the common
    level (target per unit of weight) is the largest of ``(total - limits before) / weights not before``.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    per = per.withColumn("turn", turn).withColumn("weight", weight).withColumn("limit", F.col("source_size") * max_repeat)
    all_rows = Window.partitionBy()
    before = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("turn").asc()).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(all_rows) * F.lit(float(share))
    left = total - F.coalesce(F.sum("limit").over(before), F.lit(0))
    open_weight = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("reach", left / open_weight)
    per = per.withColumn("level", F.max("reach").over(all_rows))
    target = F.least(F.col("limit").cast("double"), F.col("level") * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return per.withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "target", "rate")


def draw(id_col: Column, seed: str = SEED) -> Column:
    """Uniform in [0, 1) from a digest of the id; null ids share one draw."""
    key = F.concat(F.lit(seed + "|"), F.coalesce(id_col.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, _HEX), 16, 10).cast("double") / F.lit(float(16**_HEX))


def copies(rate: Column, id_col: Column, seed: str = SEED) -> Column:
    whole = F.floor(rate)
    return (whole + F.when(draw(id_col, seed) < rate - whole, 1).otherwise(0)).cast("bigint")


def _rates(sized: DataFrame, **options) -> DataFrame:
    """(__of, source_size, target, rate) as a written table, to be broadcast where its counted rows are few."""
    rates = materialize(source_targets(sized, **options).withColumnRenamed("source", "__of"), "rates")
    return F.broadcast(rates) if rates.count() <= BROADCAST_SOURCES else rates


def plan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies, taken (words the mix takes)."""
    sized = docs.select(F.col(id_col).alias(id_col), F.col(source).alias("source"), word_count(text).alias("size"))
    joined = sized.join(_rates(sized, **options), F.col("source").eqNullSafe(F.col("__of")), "left").withColumn("copies", copies(F.col("rate"), F.col(id_col)))
    return joined.select(id_col, "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The documents as often as the mix takes them, with all their columns."""
    sized = docs.select(F.col(source).alias("source"), word_count(text).alias("size"))
    rates = _rates(sized, **options).select("__of", F.col("rate").alias("__rate"))
    joined = docs.join(rates, F.col(source).eqNullSafe(F.col("__of")), "left")
    times = copies(F.col("__rate"), F.col(id_col))
    taken = joined.where(times > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), times)))
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns])
