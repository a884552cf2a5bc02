"""Entity-cluster resampling from per-entity sufficient sums.

Rows are reduced to one line of sums per entity once.  A replicate draws n
entity ranks with replacement from a reproducible hash.  An entity carries the
vector of its counts over all replicates, so totals of all replicates are
products of sums and counts, blocks of entities at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewatch.operators import metrics, scan
from tidewatch.session import materialize


def hash_int(*parts: Column | str) -> Column:
    """60-bit integer from the md5 of the parts' text."""
    text = F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def ranked_entities(sums: DataFrame, entity: str = "entity") -> DataFrame:
    """Entities with their position 1..n in key order and n, without one global sort."""
    ranks = scan.running_totals(sums.select(entity).distinct(), entity, {"k": F.lit(1)})
    return sums.join(ranks.select(entity, F.col("k_cum").alias("rank"), F.col("k_total").alias("entities")), entity)


#: Entities of a block of counts; draws of all replicates that a task holds at once, 16 bits each.
ENTITY_BLOCK = 2048
HELD_COUNTS = 1 << 25


def block_counts(spark: SparkSession, n: int, replicates: int, salt: str) -> DataFrame:
    """(block, first, counts): how often each entity of a block is drawn in the replicates from ``first`` on, 16 bits each, replicates side by side.

    A replicate draws n ranks of n with replacement, each from a hash of (salt, replicate, draw).  Tasks draw groups of whole
    replicates and cut their counts into blocks of entities: n x replicates small numbers move, not rows.
    """
    per_task = max(1, min(64, HELD_COUNTS // max(n, 1), -(-replicates // 64) * 8))
    tasks = -(-replicates // per_task)
    lead, width = f"{salt}|", ENTITY_BLOCK

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        md5, wide = hashlib.md5, int.from_bytes
        for batch in batches:
            for first in batch.column("first").to_pylist():
                group = range(first, min(first + per_task, replicates))
                counts = np.empty((n, len(group)), dtype=np.uint16)
                for k, r in enumerate(group):
                    stem = md5(f"{lead}{r}|".encode())
                    found = np.empty(n, dtype=np.int64)
                    for j in range(n):
                        h = stem.copy()
                        h.update(b"%d" % j)
                        found[j] = wide(h.digest()[:8], "big") >> 4  # 60 bits, as hash_int
                    counts[:, k] = np.bincount(found % n, minlength=n)
                starts = range(0, n, width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s // width for s in starts], pa.int64()), pa.array([first] * len(starts), pa.int64()), pa.array([counts[s : s + width].tobytes() for s in starts], pa.binary())],
                    names=["block", "first", "counts"])

    starts = spark.range(0, tasks, 1, tasks).selectExpr(f"id * {per_task} AS first")
    return starts.mapInArrow(draw, "block bigint, first bigint, counts binary")


def _entities(ranked: DataFrame) -> int:
    return ranked.agg(F.max("entities")).first()[0] or 0


def entity_counts(entities: DataFrame, replicates: int, salt: str) -> DataFrame:
    """(rank, counts): how often each entity is drawn in each replicate, as one vector of 16-bit numbers."""
    n, width = _entities(entities), ENTITY_BLOCK

    def beside(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("first")
        size = min(width, n - key[0].as_py() * width)
        whole = np.hstack([np.frombuffer(c, dtype=np.uint16).reshape(size, -1) for c in table.column("counts").to_pylist()])
        ranks = key[0].as_py() * width + 1 + np.arange(size)
        return pa.table({"rank": pa.array(ranks, pa.int64()), "counts": pa.array([row.tobytes() for row in whole], pa.binary())})

    return block_counts(entities.sparkSession, n, replicates, salt).groupBy("block").applyInArrow(beside, "rank bigint, counts binary")


def replicate_totals(sums: DataFrame, columns: list[str], replicates: int, salt: str, maxima: tuple[str, ...] = (),
                     by: tuple[str, ...] = ()) -> DataFrame:
    """Resampled totals (and maxima over the drawn entities) per replicate.

    The sums of a block of entities meet the block's counts once, in pieces of a few replicates: no vector is copied to a row.
    """
    ranked = materialize(ranked_entities(sums), "ranked")
    n, width = _entities(ranked), ENTITY_BLOCK
    kinds = ", ".join(f"`{c}` {dict(ranked.dtypes)[c]}" for c in by)
    numbers = ", ".join(f"`{c}` double" for c in (*columns, *maxima))
    key_types = [to_arrow_type(ranked.schema[c].dataType) for c in by]
    names = [*by, "replicate", *columns, *maxima]
    types = [*key_types, pa.int64(), *[pa.float64()] * (len(columns) + len(maxima))]

    def multiply(rows: pa.Table, drawn: pa.Table) -> pa.Table:
        if not rows.num_rows or not drawn.num_rows:
            return pa.table({c: pa.array([], t) for c, t in zip(names, types, strict=True)})
        block = drawn.column("block")[0].as_py()
        size = min(width, n - block * width)
        place = rows.column("rank").to_numpy() - 1 - block * width
        values = np.nan_to_num(np.array([rows.column(c).cast(pa.float64()).to_numpy() for c in (*columns, *maxima)]), nan=0.0)
        members: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(*[rows.column(c).to_pylist() for c in by], strict=True) if by else [()] * rows.num_rows):
            members.setdefault(key, []).append(i)
        held = {key: (np.zeros((len(columns), replicates)), np.full((len(maxima), replicates), -np.inf)) for key in members}
        for first, counts in zip(drawn.column("first").to_pylist(), drawn.column("counts"), strict=True):
            times = np.frombuffer(counts.as_buffer(), dtype=np.uint16).reshape(size, -1)
            some = slice(first, first + times.shape[1])
            for key, at in members.items():
                total, most = held[key]
                for start in range(0, len(at), width):
                    part = at[start : start + width]
                    mine = times[place[part]].astype(np.float64)
                    total[:, some] += values[: len(columns), part] @ mine
                    for k in range(len(maxima)):
                        most[k, some] = np.maximum(most[k, some], np.where(mine > 0, values[len(columns) + k, part][:, None], -np.inf).max(axis=0))
        out = []
        for key, (total, most) in held.items():
            arrays = [pa.array([v] * replicates, key_types[i]) for i, v in enumerate(key)]
            out.append(pa.table([*arrays, pa.array(np.arange(replicates), pa.int64()), *[pa.array(x) for x in total], *[pa.array(x) for x in most]], names=names))
        return pa.concat_tables(out)

    schema = ", ".join(x for x in (kinds, "replicate bigint", numbers) if x)
    blocks = ranked.select(F.floor((F.col("rank") - 1) / width).alias("block"), "rank", *by, *columns, *maxima).groupBy("block")
    parts = blocks.cogroup(block_counts(ranked.sparkSession, n, replicates, salt).groupBy("block")).applyInArrow(multiply, schema)
    return parts.groupBy(*by, "replicate").agg(*[F.sum(c).alias(c) for c in columns], *[F.max(c).alias(c) for c in maxima])


def intervals(draws: DataFrame, by: tuple[str, ...] = ("metric",), value: str = "value") -> DataFrame:
    """2.5 / 50 / 97.5 % points; a group holds one value per replicate."""
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    below, above = F.avg((F.col(value) <= 0).cast("int")), F.avg((F.col(value) >= 0).cast("int"))
    out = draws.filter(F.col(value).isNotNull()).groupBy(*by).agg(
        q.alias("_q"), F.count(F.lit(1)).alias("replicates"), F.least(F.lit(1.0), 2 * F.least(below, above)).alias("p_value"))
    return out.select(*by, F.col("_q")[0].alias("low"), F.col("_q")[1].alias("middle"), F.col("_q")[2].alias("high"), "replicates", "p_value")


def ratio_draws(totals: DataFrame, ratios: dict[str, str], by: tuple[str, ...] = ()) -> DataFrame:
    """Long (metric, replicate, value) from SQL expressions over the totals."""
    return totals.selectExpr(*by, "replicate", f"stack({len(ratios)}, " + ", ".join(f"'{n}', CAST({e} AS DOUBLE)" for n, e in ratios.items()) + ") AS (metric, value)")


def point(sums: DataFrame, columns: list[str], ratios: dict[str, str], by: tuple[str, ...] = ()) -> DataFrame:
    whole = sums.groupBy(*by).agg(*[F.sum(c).alias(c) for c in columns]).withColumn("replicate", F.lit(-1))
    return ratio_draws(whole, ratios, by).select(*by, "metric", F.col("value").alias("estimate"))


def cluster_bootstrap(sums: DataFrame, columns: list[str], ratios: dict[str, str], replicates: int, salt: str,
                      maxima: tuple[str, ...] = ()) -> DataFrame:
    """Point estimate and interval of each ratio metric."""
    draws = ratio_draws(replicate_totals(sums, columns, replicates, salt, maxima), ratios)
    return intervals(draws).join(point(sums, [*columns, *maxima], ratios), "metric")


#: Cells of a slice of the score ladder, and replicates that are summed side by side.
LADDER_SLICE = 50_000
SIDE_BY_SIDE = 64
#: Cells of a slice that are multiplied by their counts at once.
CELLS_AT_ONCE = 16_384


def average_precision_draws(df: DataFrame, scores: list[str], y: str, w: str, replicates: int, salt: str, slice_values: int = LADDER_SLICE) -> DataFrame:
    """(model, replicate, value): average precision of each score in every replicate, entities resampled together.

    Each score has one ladder of cells (score value, entity), cut into slices of values.  A slice is summed once per entity, and
    those sums times the counts give what each replicate carries into the next slice.  Then every slice, with the vectors of
    counts of its entities, runs all replicates side by side down its cells; no cell is copied.
    """
    long = df.selectExpr("entity", f"{y} AS y", f"CAST({w} AS DOUBLE) AS w", f"stack({len(scores)}, " + ", ".join(f"'{s}', CAST({s} AS DOUBLE)" for s in scores) + ") AS (model, p)")
    cells = long.where("p IS NOT NULL AND w > 0").groupBy("entity", "model", "p").agg(F.expr("sum(w * y) AS wp"), F.expr("sum(w * (1 - y)) AS wn"))
    bounds = scan._bounds(cells.select("model", "p").distinct(), "p", ("model",), max(1, slice_values // 8))
    ranked = ranked_entities(cells).join(bounds, F.col("model") == F.col("_by_model"))
    ranked = materialize(ranked.select("rank", "entities", "entity", "model", "p", "wp", "wn", F.expr("coalesce(-size(filter(_bounds, b -> b < p)), 0) AS slice")), "ladder")
    counts = materialize(entity_counts(ranked, replicates, salt), "counts")
    sums = ranked.groupBy("entity", "rank", "entities", "model", "slice").agg(F.sum("wp").alias("wp"), F.sum("wn").alias("wn"))

    def slice_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for model, number, wp, wn, c in zip(*[batch.column(k).to_pylist() for k in ("model", "slice", "wp", "wn", "counts")], strict=True):
                times = np.frombuffer(c, dtype=np.uint16)
                total = held.setdefault((model, number), np.zeros((2, replicates)))
                total[0] += wp * times
                total[1] += wn * times
        keys = list(held)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([held[k].tobytes() for k in keys], pa.binary())],
                                         names=["model", "slice", "sums"])

    def carry(key: tuple, table: pa.Table) -> pa.Table:
        """Sums of the slices before each slice of a model: as many rows as slices and tasks."""
        per: dict[int, np.ndarray] = {}
        for number, data in zip(table.column("slice").to_pylist(), table.column("sums").to_pylist(), strict=True):
            per[number] = per.get(number, 0) + np.frombuffer(data).reshape(2, replicates)
        before, out = np.zeros((2, replicates)), []
        for number in sorted(per):
            out.append((key[0].as_py(), number, before.tobytes()))
            before = before + per[number]
        out = [(m, n, c, before[0].tobytes()) for m, n, c in out]
        kinds = (("model", pa.string()), ("slice", pa.int64()), ("carried", pa.binary()), ("total", pa.binary()))
        return pa.table({name: pa.array([r[i] for r in out], kind) for i, (name, kind) in enumerate(kinds)})

    totals = sums.join(counts, "rank").select("model", "slice", "wp", "wn", "counts").mapInArrow(slice_totals, "model string, slice bigint, sums binary")
    carried = materialize(totals.groupBy("model").applyInArrow(carry, "model string, slice bigint, carried binary, total binary"), "carried")
    present = sums.join(counts, "rank").select("model", "slice", "rank", "counts")
    beside = materialize(present.unionByName(carried.select("model", "slice", F.lit(0).cast("bigint").alias("rank"), F.concat("carried", "total").alias("counts"))), "vectors")

    def descend(key: tuple, ladder: pa.Table, vectors: pa.Table) -> pa.Table:
        ranks, data = vectors.column("rank").to_numpy(), vectors.column("counts").to_pylist()
        before = np.frombuffer(data[int(np.flatnonzero(ranks == 0)[0])]).reshape(3, replicates)
        order = np.argsort(ranks, kind="stable")
        times = np.stack([np.frombuffer(data[i], dtype=np.uint16) for i in order if ranks[i] > 0])
        p = ladder.column("p").to_numpy()
        down = np.argsort(-p, kind="stable")
        p, wp, wn = p[down], ladder.column("wp").to_numpy()[down].astype(float), ladder.column("wn").to_numpy()[down].astype(float)
        at = np.searchsorted(ranks[order][ranks[order] > 0], ladder.column("rank").to_numpy()[down])
        steps = np.concatenate([[0], np.flatnonzero(p[1:] != p[:-1]) + 1])
        value = np.empty(replicates)
        # Cells are summed a bounded number at a time: a score with few values has long steps.
        step_of = np.repeat(np.arange(len(steps)), np.diff([*steps, len(p)]))
        for start in range(0, replicates, SIDE_BY_SIDE):
            some = slice(start, start + SIDE_BY_SIDE)
            held = times[:, some].astype(np.float64)
            hits, others = np.zeros((len(steps), held.shape[1])), np.zeros((len(steps), held.shape[1]))
            for low in range(0, len(p), CELLS_AT_ONCE):
                cells_ = slice(low, low + CELLS_AT_ONCE)
                drawn, mine = held[at[cells_]], step_of[cells_]
                starts = np.concatenate([[0], np.flatnonzero(mine[1:] != mine[:-1]) + 1])
                hits[mine[starts]] += np.add.reduceat(drawn * wp[cells_, None], starts, axis=0)
                others[mine[starts]] += np.add.reduceat(drawn * wn[cells_, None], starts, axis=0)
            above, below = before[0, some] + np.cumsum(hits, axis=0), before[1, some] + np.cumsum(others, axis=0)
            with np.errstate(invalid="ignore"):
                value[some] = np.where(hits > 0, hits * above / (above + below), 0.0).sum(axis=0)
        with np.errstate(invalid="ignore", divide="ignore"):
            share = np.where(before[2] > 0, value / before[2], np.nan)
        return pa.table({"model": pa.array([key[0].as_py()] * replicates, pa.string()), "replicate": pa.array(np.arange(replicates), pa.int64()), "value": pa.array(share)})

    parts = ranked.select("model", "slice", "rank", "p", "wp", "wn").groupBy("model", F.col("slice").cast("bigint").alias("slice")).cogroup(beside.groupBy("model", "slice"))
    drawn = parts.applyInArrow(descend, "model string, replicate bigint, value double").groupBy("model", "replicate").agg(F.sum("value").alias("value"))
    return drawn.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def calibration_error_draws(df: DataFrame, scores: list[str], y: str, w: str, replicates: int, salt: str) -> DataFrame:
    """(model, replicate, value): expected calibration error over the fixed bins in every replicate."""
    long = df.selectExpr("entity", f"CAST({y} AS INT) AS y", f"CAST({w} AS DOUBLE) AS w", f"stack({len(scores)}, " + ", ".join(f"'{s}', CAST({s} AS DOUBLE)" for s in scores) + ") AS (model, p)")
    clean = long.where("p IS NOT NULL AND w > 0").withColumn("p", F.greatest(F.least("p", F.lit(1 - 1e-12)), F.lit(1e-12))).withColumn("bin", metrics.calibration_bin("p"))
    sums = clean.groupBy("entity", "model", "bin").agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("y")).alias("sy"), F.sum(F.col("w") * F.col("p")).alias("sp"))
    totals = replicate_totals(materialize(sums, "calibration-sums"), ["sw", "sy", "sp"], replicates, salt, by=("model", "bin"))
    return totals.groupBy("model", "replicate").agg(F.expr("try_divide(sum(abs(sy - sp)), sum(sw)) AS value"))


def holm(df: DataFrame, p: str, by: tuple[str, ...] = (), out: str = "p_holm") -> DataFrame:
    """Step-down adjusted p-values within a family of tests (a handful of rows)."""
    family = Window.partitionBy(*by)
    order = family.orderBy(p)
    live = df.filter(F.col(p).isNotNull())
    raw = (F.count(F.lit(1)).over(family) - F.row_number().over(order) + 1) * F.col(p)
    adjusted = live.withColumn("_raw", raw).withColumn(
        out, F.least(F.lit(1.0), F.max("_raw").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("_raw")
    return adjusted.unionByName(df.filter(F.col(p).isNull()), allowMissingColumns=True)


def block_subsample(blocks: DataFrame, fraction: float, salt: str, key: str = "block") -> DataFrame:
    """ceil(f n) blocks per entity without replacement, in hashed order."""
    w = Window.partitionBy("entity").orderBy(hash_int(F.lit(salt), "entity", key), key)
    n = F.count(F.lit(1)).over(Window.partitionBy("entity"))
    sized = blocks.withColumns({"_r": F.row_number().over(w), "_take": F.greatest(F.lit(1), F.ceil(n * fraction))})
    return sized.filter(F.col("_r") <= F.col("_take")).drop("_r", "_take")


def subsample_members(blocks: DataFrame, fraction: float, replicates: int, salt: str, key: str = "block") -> DataFrame:
    """(entity, block, replicates): the replicates whose subsample of ceil(f n) blocks per entity holds the block."""
    spread = blocks.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    drawn = F.concat(F.lit(f"{salt}-"), F.col("replicate").cast("string"))
    w = Window.partitionBy("entity", "replicate").orderBy(hash_int(drawn, "entity", key), key)
    n = F.count(F.lit(1)).over(Window.partitionBy("entity", "replicate"))
    kept = spread.withColumns({"_r": F.row_number().over(w), "_take": F.greatest(F.lit(1), F.ceil(n * fraction))}).filter(F.col("_r") <= F.col("_take"))
    return kept.groupBy("entity", key).agg(F.sort_array(F.collect_list("replicate")).alias("replicates"))
