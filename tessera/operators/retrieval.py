"""Lexical retrieval: TF-IDF cosine top-k within a country, and a dictionary of transliterated words.

The vocabulary is fitted on the targets. Words outside ``min_df`` and ``max_df`` never reach the join, so no word joins
more than a fixed share of the targets."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

# The English stop words that are left out.
STOP_WORDS = (
    "a about above across after again against all also am an and any are as at be because been before being below "
    "between both but by can could did do does doing down during each few for from further had has have having he her "
    "here hers him his how i if in into is it its just me more most my no nor not of off on once only or other our out "
    "over own same she should so some such than that the their them then there these they this those through to too "
    "under until up very was we were what when where which while who whom why will with would you your"
).split()


def words(records: DataFrame) -> DataFrame:
    """(entity_id, country_clean, token, tf) of words of two letters or more."""
    text = T.search_text(F.col("name_clean"), F.col("addr_clean"))
    token = F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), 0))
    split = records.select("entity_id", "country_clean", token.alias("token")).where(~F.col("token").isin(STOP_WORDS))
    return split.groupBy("entity_id", "country_clean", "token").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(targets: DataFrame, min_df: int = 2, max_df: float = 0.005) -> DataFrame:
    """(token, df, idf) of the words of the targets; the number of targets is one row, joined to all."""
    df = words(targets).groupBy("token").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    total = targets.agg(F.count(F.lit(1)).alias("n"))
    counted = df.join(F.broadcast(total), F.col("df") <= F.col("n") * max_df)
    return counted.select("token", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def weights(records: DataFrame, vocab: DataFrame) -> DataFrame:
    """(entity_id, country_clean, token, w): sublinear counts times idf, of length 1 per record."""
    raw = words(records).join(vocab, "token").withColumn("raw", (1 + F.log("tf")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("entity_id")))
    return raw.select("entity_id", "country_clean", "token", (F.col("raw") / norm).alias("w"))


#: Records of a country in one block, about; each task compares a block of records with a block of targets.
BLOCK = 32768


def _packed(weighted: DataFrame) -> DataFrame:
    """A row for each record with its words and weights. Kept, on disk: its blocks are counted before they are dealt out."""
    words = F.collect_list(F.struct(F.xxhash64("token").alias("token"), "w"))
    return weighted.groupBy("entity_id", "country_clean").agg(words.alias("x")).persist(StorageLevel.DISK_ONLY)


def _blocked(packed: DataFrame, name: str, blocks: DataFrame, own: str, other: str) -> DataFrame:
    """A row for each record and each block of the other side in its country, with both blocks."""
    return packed.join(F.broadcast(blocks), "country_clean").select(
        F.col("country_clean").alias("country"),
        F.pmod(F.xxhash64("entity_id"), F.col(own)).alias(own),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(other),
        F.col("entity_id").alias(f"{name}_id"),
        F.col("x.token").alias("token"),
        F.col("x.w").alias("w"),
    )


def _six_digits(values: np.ndarray) -> np.ndarray:
    """Rounded as the engine rounds: half up, by the shortest decimal of each number."""
    distinct, at = np.unique(values, return_inverse=True)
    return np.array([float(Decimal(repr(float(x))).quantize(Decimal("0.000001"), ROUND_HALF_UP)) for x in distinct])[at]


FOUND = pa.schema({"s1_id": pa.string(), "sx_id": pa.string(), "tfidf_score": pa.float64()})


def _flat(table: pa.Table, column: str) -> np.ndarray:
    return table[column].combine_chunks().flatten().to_numpy(zero_copy_only=False)


def best_of_blocks(queries: pa.Table, targets: pa.Table, k: int) -> pa.Table:
    """The k best targets of a block for each record of a block. A record's scores are summed over the lists of its words,
    in an array with a place for each target of the block."""
    if not targets.num_rows or not queries.num_rows:
        return FOUND.empty_table()
    targets = targets.sort_by("sx_id")
    sizes = pa.compute.list_value_length(targets["token"]).to_numpy(zero_copy_only=False)
    row, token, w = np.repeat(np.arange(len(sizes)), sizes), _flat(targets, "token"), _flat(targets, "w")
    order = np.argsort(token, kind="stable")
    row, w = row[order].astype(np.int64), w[order]
    vocab, first = np.unique(token[order], return_index=True)
    ends = np.append(first[1:], len(order))

    asked, weight = _flat(queries, "token"), _flat(queries, "w")
    place = np.minimum(np.searchsorted(vocab, asked), len(vocab) - 1)
    known = vocab[place] == asked
    starts = np.append(0, np.cumsum(pa.compute.list_value_length(queries["token"]).to_numpy(zero_copy_only=False)))
    begin, end = first[place], ends[place]
    who, which, scores = [], [], []
    total = np.zeros(targets.num_rows)
    for i in range(queries.num_rows):
        mine = np.flatnonzero(known[starts[i] : starts[i + 1]]) + starts[i]
        if not len(mine):
            continue
        total.fill(0.0)
        for a, b, x in zip(begin[mine].tolist(), end[mine].tolist(), weight[mine].tolist()):
            total[row[a:b]] += x * w[a:b]
        found = np.flatnonzero(total)
        values = total[found]
        if len(found) > k:
            # whatever may be among the k best once scores are rounded
            kept = values >= np.partition(values, len(values) - k)[len(values) - k] - 2e-6
            found, values = found[kept], values[kept]
        values = _six_digits(values)
        best = np.lexsort((found, -values))[:k]
        who.append(np.full(len(best), i))
        which.append(found[best])
        scores.append(values[best])
    if not who:
        return FOUND.empty_table()
    ids = queries["s1_id"].take(pa.array(np.concatenate(who))), targets["sx_id"].take(pa.array(np.concatenate(which)))
    return pa.table([*ids, pa.array(np.concatenate(scores))], schema=FOUND)


def top_k(s1: DataFrame, sx: DataFrame, k: int = 20, min_df: int = 2, max_df: float = 0.005, block: int = BLOCK) -> DataFrame:
    """(s1_id, sx_id, tfidf_score): the k best targets of each record in its country, ties by id.

    Blocks of records meet blocks of targets, and a block's pairs are summed inside one task: what is shuffled are the
    records' words, once for each block of the other side, and k pairs of each record and block. Words are compared by
    64-bit hashes."""
    vocab = vocabulary(sx, min_df, max_df)
    query, target = _packed(weights(s1, vocab)), _packed(weights(sx, vocab))
    counts = [d.groupBy("country_clean").agg(F.ceil(F.count(F.lit(1)) / block).alias(n)) for d, n in ((query, "q"), (target, "t"))]
    blocks, keys = counts[0].join(counts[1], "country_clean"), ["country", "q", "t"]
    pairs = (
        _blocked(query, "s1", blocks, "q", "t")
        .groupBy(*keys)
        .cogroup(_blocked(target, "sx", blocks, "t", "q").groupBy(*keys))
        .applyInArrow(lambda queries, targets: best_of_blocks(queries, targets, k), "s1_id string, sx_id string, tfidf_score double")
    )
    place = F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc("tfidf_score"), "sx_id"))
    return pairs.withColumn("_p", place).where(F.col("_p") <= k).drop("_p")


def transliterations(pairs: DataFrame, least: int = 2) -> DataFrame:
    """(native, latin): for words of target names with other than ASCII characters, the word at the same place in the
    record's name that stands there most often, ``least`` times or more; ties to the first in the alphabet.

    pairs: s1_name (clean), sx_name (raw), of true pairs."""
    other = r"[^\x00-\x7F]"
    split = pairs.select(T.tokenize(F.lower("s1_name")).alias("a"), T.tokenize(F.lower("sx_name")).alias("b"))
    aligned = split.where((F.size("a") == F.size("b")) & F.exists("b", lambda t: t.rlike(other)))
    zipped = aligned.select(F.explode(F.arrays_zip("a", "b")).alias("x")).select(
        F.col("x.b").alias("native"), F.col("x.a").alias("latin")
    )
    counted = zipped.where(F.col("native").rlike(other) & ~F.col("latin").rlike(other)).groupBy("native", "latin").count()
    place = F.row_number().over(Window.partitionBy("native").orderBy(F.desc("count"), "latin"))
    return counted.withColumn("_p", place).where((F.col("_p") == 1) & (F.col("count") >= least)).select("native", "latin")
