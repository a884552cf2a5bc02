"""Column helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of characters other than space and the ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def text_of(name: str) -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def row_key(id_col: str, text_col: str) -> list[Column]:
    """128 bits that tell rows apart by id and text; repeated rows share them, a null id has its own."""
    return [F.xxhash64(F.col(id_col)).alias("__k0"), F.xxhash64(F.col(id_col).isNull(), text_of(text_col)).alias("__k1")]


def with_keys(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    a, b = row_key(id_col, text_col)
    return df.withColumns({"__k0": a, "__k1": b})


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
