"""Records over the test tables: the same views as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import classes

REC = """rec AS (
  SELECT CASE doc_id % 3 WHEN 0 THEN 'S1-' WHEN 1 THEN 'S2-' ELSE 'S3-' END || doc_id AS entity_id,
    split_part(text, chr(10), 1) AS business_name, split_part(text, chr(10), 2) AS business_address,
    lang AS country, text FROM documents)"""
REC_PART = """rec AS (
  SELECT CASE p_partkey % 3 WHEN 0 THEN 'S1-' WHEN 1 THEN 'S2-' ELSE 'S3-' END || p_partkey AS entity_id,
    p_name || ' & ' || p_type || CASE p_size % 5 WHEN 0 THEN ' Ltd' WHEN 1 THEN ' Pvt. Ltd.'
      WHEN 2 THEN ', Inc.' WHEN 3 THEN ' Corp' ELSE ' Co' END AS business_name,
    CAST(p_size AS VARCHAR) || ' ' || p_name || ' St, #' || CAST(p_size AS VARCHAR) || ' ' ||
      CASE WHEN p_size % 2 = 0 THEN CAST(100000 + p_size AS VARCHAR)
        ELSE CAST(10000 + p_size AS VARCHAR) END AS business_address,
    p_type AS country, p_name || '|' || p_size AS text FROM part)"""


def _source(key: str) -> Column:
    k = F.col(key) % 3
    return F.concat(F.when(k == 0, "S1-").when(k == 1, "S2-").otherwise("S3-"), F.col(key).cast("string"))


def rec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(
        _source("doc_id").alias("entity_id"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("business_name"),
        F.split_part("text", F.lit("\n"), F.lit(2)).alias("business_address"),
        F.col("lang").alias("country"),
        "text",
    )


def rec_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_size") % 5, F.col("p_size").cast("string")
    legal = F.when(k == 0, " Ltd").when(k == 1, " Pvt. Ltd.").when(k == 2, ", Inc.").when(k == 3, " Corp")
    code = F.when(F.col("p_size") % 2 == 0, 100000 + F.col("p_size")).otherwise(10000 + F.col("p_size")).cast("string")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        _source("p_partkey").alias("entity_id"),
        F.concat("p_name", F.lit(" & "), "p_type", legal.otherwise(" Co")).alias("business_name"),
        F.concat(size, F.lit(" "), "p_name", F.lit(" St, #"), size, F.lit(" "), code).alias("business_address"),
        F.col("p_type").alias("country"),
        F.concat("p_name", F.lit("|"), size).alias("text"),
    )


def _sql_chain(column: str, words: dict[str, str]) -> str:
    for short, full in words.items():
        column = rf"regexp_replace({column}, '\b{short}\b', '{full}', 'g')"
    return column


def _sql_lowered(column: str) -> str:
    return rf"regexp_replace(lower(trim(coalesce({column}, ''))), '\s*&\s*', ' and ', 'g')"


def _sql_squeeze(column: str) -> str:
    return rf"trim(regexp_replace({column}, '\s+', ' ', 'g'))"


SQL_NAME = _sql_squeeze(rf"regexp_replace({_sql_lowered('business_name')}, '[^\p{{L}}\p{{M}}\p{{N}}\s]', ' ', 'g')")
SQL_ADDRESS = _sql_squeeze(
    _sql_chain(rf"regexp_replace({_sql_lowered('business_address')}, '[^\p{{L}}\p{{M}}\p{{N}}\s\-/,#]', ' ', 'g')", T.STREETS)
)
SQL_POSTAL = r"""coalesce(nullif(regexp_extract(business_address, '\b(\d{6})\b', 1), ''),
    nullif(regexp_extract(business_address, '\b(\d{5})(?:-\d{4})?\b', 1), ''))"""


def norm_sql(view: str) -> str:
    """CTEs ``rec`` and ``norm``: the ten columns of a normalized record and the text."""
    suffixes = _sql_squeeze(rf"regexp_replace(name_legal, '\b({'|'.join(T.SUFFIXES)})\b', '', 'g')")
    return f"""{view}, norm0 AS (
  SELECT entity_id, business_name AS raw_name, business_address AS raw_address, country AS raw_country,
    lower(trim(coalesce(country, ''))) AS country_clean, {SQL_NAME} AS name_clean, {SQL_ADDRESS} AS addr_clean,
    {SQL_POSTAL} AS postal_code, text FROM rec
), norm1 AS (SELECT *, {_sql_chain('name_clean', T.LEGAL)} AS name_legal FROM norm0),
norm AS (SELECT *, {suffixes} AS name_no_suffix FROM norm1),
s1 AS (SELECT * FROM norm WHERE entity_id LIKE 'S1-%'), s2 AS (SELECT * FROM norm WHERE entity_id LIKE 'S2-%'),
s3 AS (SELECT * FROM norm WHERE entity_id LIKE 'S3-%')"""


def sources(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Normalized records of the three sources. Ten key columns are made of them, so they are kept, on disk where memory
    does not hold them; a run over files reads them from the table that ``ingest`` has written."""
    return by_source(T.normalized(records).persist())


def by_source(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(records.where(F.col("entity_id").startswith(f"S{k}-")) for k in (1, 2, 3))


def class_sources(records: DataFrame, sources: tuple[str, ...] = ("S1", "S2", "S3")) -> dict[str, tuple[DataFrame, DataFrame]]:
    """For each source the class frame, normalized and with the text, and the members; only contents are normalized that
    differ. Both are kept, since ten key columns and several joins are made of them."""
    found = {}
    for k, own in zip(("S1", "S2", "S3"), by_source(records)):
        if k not in sources:
            continue
        members = classes.kept(classes.members(own, k))
        raw = classes.representatives(own, members)
        found[k] = (classes.kept(T.normalized(raw, keep=("n", "least", "text"))), members)
    return found
