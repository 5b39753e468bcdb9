"""Normalization of names and addresses as column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Abbreviations and legal words of the record format.
LEGAL = {"pvt": "private", "ltd": "limited", "corp": "corporation", "inc": "incorporated", "co": "company"}
SUFFIXES = [
    "private", "limited", "corporation", "incorporated", "company", "llc", "llp", "plc", "gmbh", "sarl", "sa", "sas",
]
STREETS = {
    "rd": "road", "st": "street", "ave": "avenue", "blvd": "boulevard", "dr": "drive", "ln": "lane", "ct": "court",
    "pl": "place", "ste": "suite", "apt": "apartment", "hwy": "highway", "pkwy": "parkway", "cir": "circle",
    "sq": "square", "fl": "floor", "bldg": "building",
}
DOMAINS = ["com", "org", "net", "in", "co"]

#: ASCII word boundaries, as in SQL engines whose ``\b`` knows ASCII only; Java's also looks at other letters.
START, END = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"


def whole(pattern: str) -> str:
    """The pattern between ASCII word boundaries."""
    return f"{START}(?:{pattern}){END}"


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _lowered(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"\s*&\s*", " and ")


def expand(text: Column, words: dict[str, str]) -> Column:
    """Whole words replaced one after the other."""
    return reduce(lambda c, kv: F.regexp_replace(c, whole(kv[0]), kv[1]), words.items(), text)


def name_clean(name: Column) -> Column:
    """Lower case, ``&`` as a word, letters, marks, digits and single spaces only."""
    return squeeze(F.regexp_replace(_lowered(name), r"[^\p{L}\p{M}\p{N}\s]", " "))


def name_legal(clean: Column) -> Column:
    return expand(clean, LEGAL)


def name_no_suffix(legal: Column) -> Column:
    """Without legal words, wherever they stand."""
    return squeeze(F.regexp_replace(legal, whole("|".join(SUFFIXES)), ""))


def addr_clean(address: Column) -> Column:
    """As a name, but with ``- / , #``, and with street words in full."""
    return squeeze(expand(F.regexp_replace(_lowered(address), r"[^\p{L}\p{M}\p{N}\s\-/,#]", " "), STREETS))


def postal_code(address: Column, strict: bool = False) -> Column:
    """Six digits, or else five with an optional extension. ``strict``: six digits or an empty string, as engines give
    whose failed match is not null."""
    six = F.regexp_extract(address, f"{START}(\\d{{6}}){END}", 1)
    if strict:
        return six
    five = F.regexp_extract(address, f"{START}(\\d{{5}})(?:-\\d{{4}})?{END}", 1)
    return F.coalesce(F.nullif(six, F.lit("")), F.nullif(five, F.lit("")))


def country_clean(country: Column) -> Column:
    return F.lower(F.trim(F.coalesce(country, F.lit(""))))


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Every letter below U+3000 whose canonical decomposition is one base with marks, and its base."""
    found = []
    for point in range(0xC0, 0x3000):
        parts = unicodedata.normalize("NFD", chr(point))
        if len(parts) > 1 and all(unicodedata.category(p)[0] == "M" for p in parts[1:]):
            found.append((chr(point), parts[0]))
    return "".join(a for a, _ in found), "".join(b for _, b in found)


def strip_accents(text: Column) -> Column:
    """Base letters without marks; marks of all scripts go."""
    accented, plain = _accents()
    return F.regexp_replace(F.translate(text, accented, plain), r"\p{M}+", "")


def compact_key(no_suffix: Column) -> Column:
    """Without domain words, accents and spaces."""
    return F.replace(strip_accents(F.regexp_replace(no_suffix, whole("|".join(DOMAINS)), "")), F.lit(" "), F.lit(""))


def words_clean(text: Column) -> Column:
    """Lower case, letters with their marks, digits and underscores."""
    return squeeze(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}_\s]", " "))


def ocr_view(text: Column) -> Column:
    """Digits as the letters that scanners take for them."""
    return F.translate(words_clean(text), "01358", "olesb")


def tokenize(text: Column) -> Column:
    """Words between white space; none in an empty text."""
    return F.array_remove(F.split(F.trim(text), r"\s+"), "")


def numeric_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"{START}(\\d+){END}"), 1)


def first_number(text: Column) -> Column:
    return F.regexp_extract(text, f"{START}(\\d+){END}", 1)


def street_word(address: Column) -> Column:
    """The word after a number."""
    return F.regexp_extract(address, f"{START}(\\d+){END}\\s+([a-z]+)", 2)


def char_grams(text: Column, n: int = 3) -> Column:
    """Distinct runs of n characters; a shorter text is its own only one."""
    runs = F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.length(text) < n, F.array(text)).otherwise(F.array_distinct(runs))


def search_text(name: Column, address: Column) -> Column:
    return F.trim(F.concat(F.coalesce(name, F.lit("")), F.lit(" "), F.coalesce(address, F.lit(""))))


def transliterated(text: Column, mapping: Column) -> Column:
    """Each word replaced by its entry in a map column, if it has one."""
    return F.array_join(
        F.transform(F.split(words_clean(text), " "), lambda t: F.coalesce(F.try_element_at(mapping, t), t)), " "
    )


def ascii_only(text: Column) -> Column:
    return F.regexp_replace(strip_accents(text), r"[^\x00-\x7F]", "")


def normalized(records: DataFrame, strict_postal: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """entity_id, business_name, business_address, country to the ten columns of a normalized record, and those to keep."""
    clean = records.select(
        "entity_id",
        F.col("business_name").alias("raw_name"),
        F.col("business_address").alias("raw_address"),
        F.col("country").alias("raw_country"),
        country_clean(F.col("country")).alias("country_clean"),
        name_clean(F.col("business_name")).alias("name_clean"),
        addr_clean(F.col("business_address")).alias("addr_clean"),
        postal_code(F.col("business_address"), strict_postal).alias("postal_code"),
        *keep,
    )
    legal = clean.withColumn("name_legal", name_legal(F.col("name_clean")))
    return legal.withColumn("name_no_suffix", name_no_suffix(F.col("name_legal"))).select(
        "entity_id",
        "raw_name",
        "raw_address",
        "raw_country",
        "country_clean",
        "name_clean",
        "name_legal",
        "name_no_suffix",
        "addr_clean",
        "postal_code",
        *keep,
    )


def bucket(identity: Column, salt: str, buckets: int = 1000) -> Column:
    """A bucket of an id that every engine with md5 computes alike."""
    return (F.conv(F.substring(F.md5(F.concat(identity, F.lit(salt))), 1, 8), 16, 10).cast("long") % buckets).cast("long")
