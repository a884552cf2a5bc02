"""Validated joins, nearest neighbours, lagged neighbour signals, purges and reshapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.scalar import haversine_km
from tidewatch.operators import scan
from tidewatch.session import materialize

KM_PER_DEGREE = 111.19


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def validated_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", one_to_one: bool = False) -> DataFrame:
    """Join whose right keys (and left keys for one-to-one) must be unique.

    The check rides in the plan: a duplicated key raises while the join runs,
    so no separate pass over the data is needed.
    """
    def unique(df: DataFrame, label: str) -> DataFrame:
        copies = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        checked = F.when(copies > 1, F.raise_error(F.lit(f"duplicate {label} join key"))).otherwise(F.lit(True))
        return df.withColumn("_ok", checked.cast("boolean")).filter("_ok").drop("_ok")

    return (unique(left, "left") if one_to_one else left).join(unique(right, "right"), keys, how)


def complete_lookup(rows: DataFrame, attributes: DataFrame, keys: list[str]) -> DataFrame:
    """Attribute lookup that fails when a row has no partner."""
    joined = validated_join(rows, attributes.withColumn("_hit", F.lit(True)), keys, "left")
    found = F.when(F.col("_hit").isNull(), F.raise_error(F.lit("row without a matching key"))).otherwise(F.lit(True))
    return joined.withColumn("_hit", found.cast("boolean")).filter("_hit").drop("_hit")


def _lon_cells(row: Column, size: float) -> Column:
    """Cells of a latitude row: as many as keep a cell at least ``size`` degrees of arc wide at the row's pole-ward edge."""
    edge = F.greatest(F.abs(row * size - 90.0), F.abs((row + 1) * size - 90.0))
    return F.greatest(F.lit(1), F.floor(360.0 * F.cos(F.radians(F.least(edge, F.lit(90.0)))) / size).cast("int"))


#: The smallest cell in degrees.
SMALLEST_CELL = 1e-6


def _first_cell(sources: DataFrame, k: int, size: float, growth: float) -> float:
    """``size``, made smaller until a source's cell holds about k + 1 of them on average."""
    while size > SMALLEST_CELL:
        y = F.floor((F.col("lat") + 90.0) / size)
        x = F.floor(F.pmod(F.col("lon") + 180.0, F.lit(360.0)) / (360.0 / _lon_cells(y, size)))
        held = sources.groupBy(y.alias("y"), x.alias("x")).agg(F.count(F.lit(1)).alias("n"))
        crowding = held.agg(F.expr("try_divide(sum(n * n), sum(n))")).first()[0]
        if crowding is None or crowding <= 2 * (k + 1):
            break
        size *= max(((k + 1) / crowding) ** 0.5, 1 / growth)
    return size


def nearest_neighbours(points: DataFrame, key: str, k: int, first_cell: float = 0.1, growth: float = 4.0) -> DataFrame:
    """The k nearest other points of every point, exact, without an all-pairs join.

    Points meet only inside a block of grid cells around the target: three latitude rows, and in each the three cells around the
    target's longitude, which wrap at 180 degrees.  Rows have fewer cells towards the poles, so a cell is never narrower than its
    size.  A point is settled once its k-th neighbour lies inside the radius that its block is sure to cover; the rest try cells
    ``growth`` times as large, until the block is the globe.  The first cells are ``first_cell`` degrees, or smaller where points lie so
    close that cells would be crowded, so pairs grow with the points and not with their square.  Points sharing one coordinate are represented as sources by their
    first k+1 keys, which is all a ranking by (distance, key) can use, so a crowd at one place adds no quadratic work.
    """
    located = points.filter("lat IS NOT NULL AND lon IS NOT NULL")
    crowd = Window.partitionBy("lat", "lon").orderBy(key)
    sources = materialize(located.withColumn("_c", F.row_number().over(crowd)).filter(F.col("_c") <= k + 1).drop("_c"), "sources")
    src = sources.select(*[F.col(c).alias(f"source_{c}") for c in sources.columns])
    best = Window.partitionBy(f"target_{key}").orderBy("distance_km", f"source_{key}")
    todo = located.select(*[F.col(c).alias(f"target_{c}") for c in located.columns])
    done: list[DataFrame] = []
    size = _first_cell(sources, k, first_cell, growth)
    while True:
        whole = size >= 360.0

        def row(prefix: str) -> Column:
            return F.floor((F.col(f"{prefix}_lat") + 90.0) / size)

        def column(prefix: str, at: Column) -> Column:
            return F.floor(F.pmod(F.col(f"{prefix}_lon") + 180.0, F.lit(360.0)) / (360.0 / _lon_cells(at, size)))

        rows = [row("target") + i for i in (-1, 0, 1)]
        around = F.array_distinct(F.array(*[F.struct(y.alias("y"), F.pmod(column("target", y) + j, _lon_cells(y, size)).alias("x")) for y in rows for j in (-1, 0, 1)]))
        left = todo.select("*", F.explode(around).alias("_cell"))
        right = src.withColumn("_cell", F.struct(row("source").alias("y"), column("source", row("source")).alias("x")))
        pairs = left.join(right, "_cell").drop("_cell")

        def sideways(y: Column) -> Column:
            # Beyond the three cells of a row lies at least one cell of longitude, unless they are all there are.
            edge = F.greatest(F.abs(y * size - 90.0), F.abs((y + 1) * size - 90.0))
            cosines = F.cos(F.radians("target_lat")) * F.cos(F.radians(F.least(edge, F.lit(90.0))))
            return F.when(_lon_cells(y, size) <= 3, F.lit(float("inf"))).otherwise(
                2 * 6371.0 * F.asin(F.sqrt(F.greatest(cosines, F.lit(0.0))) * F.sin(F.radians(180.0 / _lon_cells(y, size)))))

        reach = F.least(F.lit(size * KM_PER_DEGREE), *[sideways(y) for y in rows])
        ranked = (pairs.filter(F.col(f"source_{key}") != F.col(f"target_{key}"))
                  .withColumn("distance_km", F.round(haversine_km("source_lon", "source_lat", "target_lon", "target_lat"), 4))
                  .withColumn("distance_rank", F.row_number().over(best)).filter(F.col("distance_rank") <= k))
        if whole:
            done.append(ranked)
            break
        ranked = ranked.withColumn("_sure", (F.count(F.lit(1)).over(Window.partitionBy(f"target_{key}")) == k)
                                   & (F.max("distance_km").over(Window.partitionBy(f"target_{key}")) < reach))
        settled = materialize(ranked.filter("_sure").drop("_sure"), "neighbours")
        done.append(settled)
        todo = materialize(todo.join(settled.select(f"target_{key}").distinct(), f"target_{key}", "left_anti"), "unsettled")
        if todo.isEmpty():
            break
        size *= growth
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def lag_features(edges: DataFrame, catalog: DataFrame, key: str, lags: list[int], max_rank: int, max_km: float) -> DataFrame:
    """Edges between seen stations, near enough, expanded by lag (minutes)."""
    seen = catalog.filter("seen = 1").select(F.col(key))
    kept = (edges.filter((F.col("distance_rank") <= max_rank) & (F.col("distance_km") <= max_km))
            .join(seen.withColumnRenamed(key, f"source_{key}"), f"source_{key}", "left_semi")
            .join(seen.withColumnRenamed(key, f"target_{key}"), f"target_{key}", "left_semi"))
    expanded = kept.withColumn("lag_minutes", F.explode(F.array(*[F.lit(v) for v in sorted(set(lags))])))
    return expanded.withColumn("feature", F.format_string("graph::%s->%s::lag%dm", F.col(f"source_{key}").cast("string"),
                                                          F.col(f"target_{key}").cast("string"), "lag_minutes"))


def neighbour_signals(signals: DataFrame, rows: DataFrame, edges: DataFrame, window_bins: int, step: int) -> DataFrame:
    """Long (entity, t, feature, value): rolling max of the source signal, shifted by the edge's lag.

    Only positive signals travel, and the source rows are multiplied by their
    out-edges, so the join is a plain equi-join on (entity, t).
    """
    rolled = signals.selectExpr("entity AS source_entity", "t AS source_t", f"""max(coalesce(signal, 0)) OVER (PARTITION BY entity ORDER BY t
        ROWS BETWEEN {window_bins - 1} PRECEDING AND CURRENT ROW) AS value""").filter("value > 0")
    bins = F.col("lag_minutes") * 60 / step
    sent = rolled.join(edges.select("source_entity", F.col("target_entity").alias("entity"), "feature", "lag_minutes"), "source_entity")
    arriving = sent.select("entity", (F.col("source_t") + (bins * step).cast("bigint")).alias("t"), "feature", "value")
    return rows.select("entity", "t").join(arriving, ["entity", "t"])


def shifted_lookup(rows: DataFrame, value: str, shift: int, out: str, mapping: DataFrame | None = None, source: DataFrame | None = None) -> DataFrame:
    """Value at exactly ``t + shift`` of the same (or mapped) entity; 0 when absent.  ``source`` has the values, where it is not ``rows`` itself."""
    source = (rows if source is None else source).select(F.col("entity").alias("_from"), (F.col("t") - shift).alias("t"), F.col(value).alias(out))
    base = rows.withColumn("_from", F.col("entity")) if mapping is None else rows.join(
        mapping.withColumnRenamed("partner", "_from"), "entity", "left")
    return base.join(source, ["_from", "t"], "left").withColumn(out, F.coalesce(F.col(out), F.lit(0.0))).drop("_from")


def cyclic_partners(entities: DataFrame) -> DataFrame:
    """Fixed cyclic permutation of the sorted entities: i -> i+1, last -> first."""
    ranked = scan.running_totals(entities.select("entity").distinct(), "entity", {"n": F.lit(1)})
    here = ranked.select("entity", F.col("n_cum").alias("rank"), "n_total")
    there = here.select(F.col("entity").alias("partner"), F.col("rank").alias("next_rank"))
    return here.withColumn("next_rank", F.col("rank") % F.col("n_total") + 1).join(there, "next_rank").select("entity", "partner")


def purge(rows: DataFrame, blocks: DataFrame, pad: int, cell: int) -> DataFrame:
    """Drop rows within ``[start - pad, end + pad)`` of any block.

    Blocks are spread over time cells of ``cell`` seconds, which turns the range
    anti-join into an equi-join on the cell with a residual range test.
    """
    lo, hi = F.col("block_start") - pad, F.col("block_end") + pad
    spread = blocks.select(lo.alias("_lo"), hi.alias("_hi"), F.explode(
        F.sequence(F.floor(lo / cell), F.floor((hi - 1) / cell))).alias("_cell"))
    return rows.withColumn("_cell", F.floor(F.col("t") / cell)).join(
        spread.withColumnRenamed("_cell", "_bcell"),
        (F.col("_cell") == F.col("_bcell")) & (F.col("t") >= F.col("_lo")) & (F.col("t") < F.col("_hi")), "left_anti").drop("_cell")


def seed_mean(scores: DataFrame, keys: list[str], score: str, seeds: int) -> DataFrame:
    """Mean over seeds; a key that is not present for every seed raises."""
    grouped = scores.groupBy(*keys).agg(F.avg(score).alias(score), F.count_distinct("seed").alias("_k"))
    checked = F.when(F.col("_k") != seeds, F.raise_error(F.lit("seeds cover different keys"))).otherwise(F.lit(True))
    return grouped.withColumn("_k", checked.cast("boolean")).filter("_k").drop("_k")


def intervals_wide(long: DataFrame, keys: list[str], metric: str, names: list[str], values: list[str]) -> DataFrame:
    """One row per key with ``<metric>_<value>`` columns."""
    return long.groupBy(*keys).pivot(metric, names).agg(*[F.first(v).alias(v) for v in values])
