"""Sharding by longest processing time: groups that must stay together, sorted by size, go to the least-loaded shard.

Groups are equal texts (by SHA-256).  A group with at least ``1 / bundles`` of all bytes is an item of its own, so there are
at most ``bundles`` of those; smaller groups are bundled by a hash of their digest into at most ``bundles`` items.  A bundle
stays together too, so every group does.  The driver's heap sees at most ``2 * bundles`` (item, bytes) rows, whatever
the number of documents; the assignment travels back as a table of the same bounded size.

Slots number the rows of a shard without gaps.  Rows are cut into blocks of about ``block_rows`` by a hash, block sizes give
each block its first slot, and rows are numbered inside their block, so no shard or group passes through one task.

Defined cases: null text counts as empty (size 1), null ids sort first, repeated rows of a shard take neighbouring slots in
either order, equally large items go by name, an empty table gives no rows, input columns named like a result column are
replaced in ``shard``.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import text_of

SHARDS = 8
BUNDLES = 4096
BLOCK_ROWS = 2_000


def size_of(text: str) -> Column:
    return (F.octet_length(text_of(text)) + 1).cast("bigint")


def longest_first(items: list[tuple[str, int]], shards: int) -> list[tuple[str, int]]:
    """(item, shard): the largest open item goes to the shard with the least load, lowest number first on ties."""
    loads = [(0, s) for s in range(shards)]
    placed = []
    for name, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(loads)
        placed.append((name, shard))
        heapq.heappush(loads, (load + size, shard))
    return placed


def _items(rows: DataFrame, bundles: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their item, and the items' bytes and rows (at most ``2 * bundles`` of them)."""
    total = rows.agg(F.sum("__size")).first()[0] or 0
    bundle = F.concat(F.lit("b"), F.pmod(F.xxhash64("__digest"), F.lit(bundles)).cast("string"))
    groups = rows.groupBy("__digest").agg(F.sum("__size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    heavy = F.col("bytes") * bundles >= F.lit(total)
    alone = F.concat(F.lit("g"), F.hex("__digest"))
    items = groups.groupBy(F.when(heavy, alone).otherwise(bundle).alias("item")).agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    found = items.collect()
    own = rows.sparkSession.createDataFrame([(r.item[1:],) for r in found if r.item[0] == "g"], "__heavy string")
    tagged = rows.join(F.broadcast(own), F.hex("__digest") == F.col("__heavy"), "left")
    return tagged.withColumn("__item", F.when(F.col("__heavy").isNotNull(), alone).otherwise(bundle)).drop("__heavy"), found


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text: str = "text", bundles: int = BUNDLES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All rows and columns, plus size (bytes + 1), shard and slot."""
    kept = [c for c in docs.columns if c.lower() not in {"size", "shard", "slot"}]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], size_of(text).alias("__size"), F.unhex(F.sha2(text_of(text), 256)).alias("__digest"))
    tagged, found = _items(rows, bundles)
    placed = dict(longest_first([(r.item, r.bytes) for r in found], shards))
    blocks = [(r.item, placed[r.item], -(-r.rows // block_rows)) for r in found]
    where = docs.sparkSession.createDataFrame(blocks, "__item string, __shard int, __blocks bigint")
    tagged = tagged.join(F.broadcast(where), "__item")
    tagged = tagged.withColumn("__block", F.pmod(F.xxhash64(F.col(id_col), "__digest"), F.col("__blocks")))
    counts = tagged.groupBy("__shard", "__item", "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__shard").orderBy("__item", "__block").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("__shard", "__item", "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    rank = F.row_number().over(Window.partitionBy("__item", "__block").orderBy(F.col(id_col).asc_nulls_first(), "__digest"))
    numbered = tagged.withColumn("__rank", rank).join(first.drop("__shard"), ["__item", "__block"])
    slot = (F.col("__first") + F.col("__rank") - 1).cast("bigint")
    return numbered.select(*[F.col(f"`{c}`") for c in kept], F.col("__size").alias("size"), F.col("__shard").alias("shard"), slot.alias("slot"))
