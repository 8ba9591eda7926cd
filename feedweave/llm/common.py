"""Shared helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweave.sources.shared import new_table

#: White space of every word definition here: space and 0x09-0x0D.
WS_CLASS = r"\x20\x09-\x0D"
WS_CHARS = " \t\n\x0b\f\r"
#: Drops a query's shuffle files when it ends: what it wrote is a table, and nobody reads its shuffles again.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(col: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the maximal runs outside the white-space class, in order."""
    return F.filter(F.split(text, f"[{WS_CLASS}]+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a one-element array binds it to a lambda variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def plain_names(names: list[str], keep: tuple[str, ...] = ()) -> list[str]:
    """Inner names for a caller's columns, so that they cannot meet an operator's own; those in keep stay."""
    return [x if x in keep else f"_in{i}" for i, x in enumerate(names)]


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def materialize(df: DataFrame, name: str = "step", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Cut the lineage: write df as a table to the shared folder and return its reader."""
    spark = df.sparkSession
    path = new_table(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.partitionBy(*partition_by).parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        p, fs = _path(t.sparkSession, t._table_path)
        fs.delete(p, True)


def discard_part(table: DataFrame, *parts: str) -> None:
    """Delete partitions (name=value) of a written table that nothing reads any more."""
    for part in parts:
        p, fs = _path(table.sparkSession, f"{table._table_path}/{part}")
        fs.delete(p, True)


def crc32_sql(text: str) -> str:
    """DuckDB's missing crc32 of a text's UTF-8, as an expression: reflected polynomial, bit by bit."""
    code = f"hex(encode({text}))"
    octets = f"list_transform(range(1, length({code}), 2), lambda i: ('0x' || substr({code}, i::INT, 2))::BIGINT)"
    eight = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, z: xor(d // 2, 3988292384 * (d % 2)))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {octets}), lambda c, b: {eight}), 4294967295)"
