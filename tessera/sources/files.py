"""Reading and writing records, pairs, lists and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

RECORD = ["entity_id", "business_name", "business_address", "country"]
TRUTH = ["source1_entity_id", "matched_entity_ids"]


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """The frame, or an error that names the columns it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_tsv(spark: SparkSession, path: str, columns: list[str] | None = None, quoted: bool = True) -> DataFrame:
    """Tab-separated text with a header, all strings; short rows are filled with nulls. Types are never inferred."""
    reader = spark.read.options(sep="\t", header=True, inferSchema=False, mode="PERMISSIVE", encoding="UTF-8")
    if not quoted:
        reader = reader.option("quote", "")
    df = reader.csv(path)
    return require(df, columns) if columns else df


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, RECORD).select(*RECORD)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Lists of matched ids; a null list is empty."""
    df = read_tsv(spark, path, TRUTH)
    return df.select("source1_entity_id", F.coalesce("matched_entity_ids", F.lit("")).alias("matched_entity_ids"))


def write_tsv(
    df: DataFrame, path: str, one_file: bool = True, crlf: bool = False, order: list[str] | None = None
) -> None:
    """Tab-separated text without quotes; empty strings stay empty. One file only where its reader asks for that; with
    ``order`` the files, taken by their names, are sorted: by ranges, or within the one file."""
    if order:
        out = df.repartition(1).sortWithinPartitions(*order) if one_file else df.orderBy(*order)
    else:
        out = df.coalesce(1) if one_file else df
    writer = out.write.options(sep="\t", header=True, quote="", emptyValue="", nullValue="")
    (writer.option("lineSep", "\r\n") if crlf else writer).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return require(df, columns).select(*columns) if columns else df


def rows_in(spark: SparkSession, path: str, columns: list[str] | None = None) -> int:
    """Rows of a table just written: of Parquet from its footers, of tab-separated text where its columns are given."""
    return (read_tsv(spark, path, columns, quoted=False) if columns else spark.read.parquet(path)).count()


TEXT_RULES = ["separator", "header", "malformed_row"]


def text_faults(spark: SparkSession, path: str, columns: list[str] = TRUTH) -> DataFrame:
    """(rule, findings) of a list as text, before it is read as a table: commas for tabs in the header, a header other than
    ``columns``, rows without a tab. Blank rows count for nothing."""
    lines = spark.read.text(path)
    first = lines.first()
    head = first.value if first else ""
    commas = "\t" not in head and "," in head
    names = [c.strip().lower() for c in head.split("\t")]
    bare = (F.trim("value") != "") & ~F.col("value").contains("\t") & (F.col("value") != F.lit(head))
    found = lines.agg(F.count(F.when(bare, 1)).alias("n")).select(
        F.explode(
            F.array(
                F.struct(F.lit("separator").alias("rule"), F.lit(int(commas)).cast("long").alias("findings")),
                F.struct(F.lit("header").alias("rule"), F.lit(int(names != columns)).cast("long").alias("findings")),
                F.struct(F.lit("malformed_row").alias("rule"), F.col("n").alias("findings")),
            )
        ).alias("x")
    )
    return found.select("x.*")


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def read_json(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.schema(StructType([StructField(c, StringType()) for c in columns])).json(path)
