"""Readers and writers for observation logs and timelines.

CSV logs are read as text with a declared schema and cast later by the cleaning
operators, so a bad field never loses a row.  Splits are Spark's own file
splits; column pruning and partition pruning come from the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.scalar import nullify_markers


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_text_log(spark: SparkSession, path: str, columns: list[str], encoding: str = "UTF-8",
                  recursive: bool = True, position: bool = False) -> DataFrame:
    """Header CSV files below ``path`` with every field as text and the file path attached; ``position`` adds each row's place in its file."""
    frame = (spark.read.schema(text_schema(columns)).option("header", True).option("encoding", encoding)
             .option("recursiveFileLookup", recursive).option("mode", "PERMISSIVE").csv(path))
    place = [F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("source_row")] if position else []
    return frame.select("*", F.col("_metadata.file_path").alias("source_file"), *place)


def read_mixed_log(spark: SparkSession, path: str, columns: list[str], first: str = "UTF-8", other: str = "GB18030") -> DataFrame:
    """Like :func:`read_text_log`, with each file in the encoding that all of its bytes show: UTF-8 where they are valid, else ``other``.

    The bytes are read as single-byte text, which every byte sequence is and whose separators are those of both encodings.  Whether
    a file is valid is one aggregate over all its fields, so a byte at its very end counts; the fields are then decoded from
    the same text.  Files are rows of a table throughout; nothing about them comes to the driver.
    """
    raw = (spark.read.schema(text_schema(columns)).option("header", True).option("encoding", "ISO-8859-1").option("escape", '"')
           .option("recursiveFileLookup", True).option("mode", "PERMISSIVE").csv(path)).select("*", F.col("_metadata.file_path").alias("source_file"))
    in_bytes = {c: F.encode(F.col(c), "ISO-8859-1") for c in columns}
    valid = [F.coalesce(F.is_valid_utf8(b.cast("string")), F.lit(True)) for b in in_bytes.values()]
    whole = raw.groupBy("source_file").agg(F.bool_and(reduce(lambda a, b: a & b, valid)).alias("_valid"))
    joined = raw.join(whole, "source_file")
    return joined.select(*[F.when(F.col("_valid"), F.decode(b, first)).otherwise(F.decode(b, other)).alias(c) for c, b in in_bytes.items()], "source_file",
                         F.when(F.col("_valid"), first).otherwise(other).alias("source_encoding"))


def station_from_path(path: Column | str) -> Column:
    """Station name in a file's stem: the name before the from-to dates of its records."""
    col = F.col(path) if isinstance(path, str) else path
    stem = F.regexp_extract(col, r"([^/]+?)(?:\.[^./]*)?$", 1)
    return F.regexp_replace(stem, r"20\d{6}_20\d{6}$", "")


def path_year(path: Column | str, pattern: str = r"(20\d{2})") -> Column:
    """Year of the directory that holds the file."""
    col = F.col(path) if isinstance(path, str) else path
    found = F.regexp_extract(col, rf"(?:^|[/=]){pattern}/[^/]*$", 1)
    return F.when(found != "", found.cast("int"))


def source_catalog(log: DataFrame, fields: list[str]) -> DataFrame:
    """One row per source file: rows and the first usable value of each id field."""
    def first_usable(c: str) -> Column:
        value = nullify_markers(c)
        return F.min_by(value, F.when(value.isNotNull(), F.col("source_row"))).alias(c)

    return log.groupBy("source_file").agg(F.count(F.lit(1)).alias("rows"), *[first_usable(c) for c in fields])


def read_declared_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Declared types; short rows are padded with NULL, bad fields become NULL."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_inferred_csv(spark: SparkSession, path: str, sampling: float = 1.0) -> DataFrame:
    return (spark.read.option("header", True).option("inferSchema", True)
            .option("samplingRatio", sampling).csv(path))


def read_timeline(spark: SparkSession, path: str, columns: list[str] | None = None,
                  years: list[int] | None = None) -> DataFrame:
    """Parquet timeline; years prune partitions, columns prune the scan."""
    frame = spark.read.parquet(path)
    if years is not None:
        frame = frame.filter(F.col("year").isin(*years))
    return frame if columns is None else frame.select(*columns)


def write_timeline(frame: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ("year",),
                   overwrite: bool = False, compression: str | None = None) -> None:
    """Partitioned sink; an existing target is refused unless ``overwrite``."""
    if fmt not in {"parquet", "csv", "csv.gz"}:
        raise ValueError(f"unsupported timeline format {fmt}")
    writer = frame.write.mode("overwrite" if overwrite else "errorifexists").partitionBy(*partition_by)
    if fmt == "parquet":
        writer.option("compression", compression or "zstd").parquet(path)
    else:
        writer.option("header", True).option("compression", "gzip" if fmt == "csv.gz" else "none").csv(path)


def canonical_values(frame: DataFrame, renames: dict[str, str], values: dict[str, dict[str, str]]) -> DataFrame:
    """Rename legacy columns and map legacy values of identifier columns; unknown values pass through."""
    out = frame.withColumnsRenamed(renames)
    for column, mapping in values.items():
        lookup = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
        out = out.withColumn(column, F.coalesce(F.try_element_at(lookup, F.col(column)), F.col(column)))
    return out


def table_report(frame: DataFrame, entity: str, count_col: str) -> DataFrame:
    return frame.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(entity).alias("entities"),
                     F.sum(count_col).alias("events"))
