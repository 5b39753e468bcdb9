"""Candidate pairs by equi-joins on keys of normalized records, always within a country.

Keys are computed once per record before the join, so a join compares columns. Rare-token views count tokens on the
target side first and join the few that stay; the count is an aggregate that combines on the map side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

# Words that make no key.
NAME_STOP = ["the", "and", "for", "inc", "llc", "ltd", "pvt", "corp", "all", "any", "one", "new"]
ADDRESS_STOP = [
    "street", "avenue", "road", "suite", "floor", "building", "highway", "parkway", "india", "delhi", "mumbai",
    "bangalore", "chennai", "hyderabad", "texas", "california", "florida", "north", "south", "nagar", "colony",
    "block", "sector", "village", "pradesh", "karnataka", "maharashtra", "tamil", "district", "county",
]
STREET_STOP = ["", "po", "box", "suite", "floor", "pvt", "ltd", "road", "street", "avenue", "lane"]
HEAD_STOP = ["the", "and", "company", "enterprises", "group", "services"]
WORD_STOP = ["street", "avenue", "nagar", "floor", "suite", "india"]


def _join(s1: DataFrame, sx: DataFrame, keys: list[str]) -> DataFrame:
    left = s1.select(F.col("entity_id").alias("s1_id"), "country_clean", *keys)
    right = sx.select(F.col("entity_id").alias("sx_id"), "country_clean", *keys)
    return left.join(right, ["country_clean", *keys]).select("s1_id", "sx_id")


def exact_name(s1: DataFrame, sx: DataFrame) -> DataFrame:
    """Equal compact names; one row for each pair of rows."""
    key = T.compact_key(F.col("name_no_suffix"))
    named = s1.where(F.length("name_no_suffix") > 2)
    return _join(named.withColumn("key", key), sx.withColumn("key", key), ["key"])


def _rare_token(s1: DataFrame, sx: DataFrame, text: Column, present: Column, least: int, stop: list[str], most: int) -> DataFrame:
    long = (F.length("token") >= least) & ~F.col("token").isin(stop)
    split = [
        d.where(present).select("entity_id", "country_clean", F.explode(F.split(text, " ")).alias("token"), n.alias("n")).where(long)
        for d, n in ((s1, F.lit(1)), (sx, F.col("n") if "n" in sx.columns else F.lit(1)))
    ]
    rare = split[1].groupBy("token").agg(F.sum("n").alias("count")).where(F.col("count") <= most).select("token")
    left, right = (d.drop("n").distinct() for d in split)
    return _join(left, right.join(rare, "token"), ["token"]).distinct()


def rare_name_token(s1: DataFrame, sx: DataFrame, most: int = 150) -> DataFrame:
    """A shared word that few target rows have; repeats and all countries count. Of classes, all their records count (n)."""
    name = F.col("name_no_suffix")
    return _rare_token(s1, sx, T.strip_accents(name), name != "", 3, NAME_STOP, most)


def exact_address(s1: DataFrame, sx: DataFrame) -> DataFrame:
    return _join(s1.where(F.length("addr_clean") > 8), sx, ["addr_clean"])


def street(s1: DataFrame, sx: DataFrame) -> DataFrame:
    """Equal first number and equal word after a number."""
    keys = {"number": T.first_number(F.col("addr_clean")), "word": T.street_word(F.col("addr_clean"))}
    kept = (F.col("number") != "") & ~F.col("word").isin(STREET_STOP) & (F.length("word") >= 4)
    return _join(s1.withColumns(keys).where(kept), sx.withColumns(keys).where(kept), ["number", "word"])


def rare_address_token(s1: DataFrame, sx: DataFrame, most: int = 40) -> DataFrame:
    address = F.col("addr_clean")
    return _rare_token(s1, sx, address, address != "", 5, ADDRESS_STOP, most)


PASSES = {
    "exact_name": exact_name,
    "rare_name_token": rare_name_token,
    "exact_address": exact_address,
    "street": street,
    "rare_address_token": rare_address_token,
}


def block_union(s1: DataFrame, sx: DataFrame) -> DataFrame:
    """Distinct pairs of all five views."""
    return reduce(DataFrame.unionByName, (f(s1, sx) for f in PASSES.values())).distinct()


def postal_house(s1: DataFrame, sx: DataFrame) -> DataFrame:
    """Equal postal code and first number of the address."""
    keyed = [
        d.withColumn("number", T.first_number(F.col("addr_clean"))).where((F.col("number") != "") & (F.col("postal_code") != ""))
        for d in (s1, sx)
    ]
    return _join(*keyed, ["postal_code", "number"])


def capped(pairs: DataFrame, most: int = 5) -> DataFrame:
    """The first partners of each record, by their ids."""
    place = F.row_number().over(Window.partitionBy("s1_id").orderBy("sx_id"))
    return pairs.withColumn("place", place).where(F.col("place") <= most).drop("place")


def _head_view(s1: DataFrame, sx: DataFrame, view: Column, most: int) -> DataFrame:
    """Equal first two words of a view of the name."""
    pattern = r"^([a-z0-9]+)\s+([a-z0-9]+)"
    keyed = [
        d.withColumn("view", view)
        .where(F.length("view") >= 5)
        .withColumns({"t1": F.regexp_extract("view", pattern, 1), "t2": F.regexp_extract("view", pattern, 2)})
        .where((F.col("t1") != "") & ~F.col("t1").isin(HEAD_STOP))
        for d in (s1, sx)
    ]
    return capped(_join(*keyed, ["t1", "t2"]).distinct(), most)


def view_ocr(s1: DataFrame, sx: DataFrame, most: int = 5) -> DataFrame:
    return _head_view(s1, sx, T.ocr_view(F.col("raw_name")), most)


def view_translit(s1: DataFrame, sx: DataFrame, mapping: Column, most: int = 5) -> DataFrame:
    return _head_view(s1, sx, T.words_clean(T.transliterated(F.col("raw_name"), mapping)), most)


def view_address(s1: DataFrame, sx: DataFrame, most: int = 5) -> DataFrame:
    """Equal first number, with a letter or not, and first word of five letters or more."""
    address = T.words_clean(F.col("addr_clean"))
    keys = {
        "number": F.regexp_extract(address, f"({T.START}\\d+[a-z]?{T.END})", 1),
        "word": F.regexp_extract(address, f"({T.START}[a-z]{{5,}}{T.END})", 1),
    }
    kept = (F.col("number") != "") & (F.col("word") != "") & ~F.col("word").isin(WORD_STOP)
    keyed = [d.withColumns(keys).where(kept) for d in (s1, sx)]
    return capped(_join(*keyed, ["number", "word"]).distinct(), most)


def retrieval_views(s1: DataFrame, sx: DataFrame, mapping: Column) -> DataFrame:
    """Distinct pairs of the three capped views."""
    views = (view_ocr(s1, sx), view_translit(s1, sx, mapping), view_address(s1, sx))
    return reduce(DataFrame.unionByName, views).distinct()


def diagnostics(pairs: DataFrame, name: str) -> DataFrame:
    """Pairs, records with pairs, and pairs per record: mean, 95th percentile and most."""
    each = pairs.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n"))
    return each.agg(
        F.lit(name).alias("pass_name"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("candidate_count"),
        F.count(F.lit(1)).alias("s1_entities_with_candidates"),
        F.coalesce(F.round(F.avg("n"), 6), F.lit(0.0)).alias("avg_candidates_per_s1"),
        F.coalesce(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY n)").cast("long"), F.lit(0)).alias("p95_candidates_per_s1"),
        F.coalesce(F.max("n"), F.lit(0)).alias("max_candidates_per_s1"),
    )
