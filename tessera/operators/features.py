"""Features of candidate pairs.

A pair frame has s1_id, sx_id and for each side k in (s1, sx): k_name, k_no_suf, k_addr, k_post. Nulls are empty
strings; evidence that one side lacks is -1. All but the string scores are expressions inside one stage; the scores of
names, addresses and both together come from one Arrow pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.strings import string_ratio, string_scores

PAIRWISE_V1 = [
    "name_exact", "name_no_suf_exact", "name_ratio", "name_wratio", "name_token_set", "name_len_diff", "name_len_ratio",
    "name_jaccard", "addr_exact", "addr_ratio", "addr_token_set", "addr_jaccard", "number_exact", "postal_exact",
    "name_addr_mean",
]


def attach_text(edges: DataFrame, s1: DataFrame, sx: DataFrame) -> DataFrame:
    """Texts of both sides by two key joins; ids without a record get empty strings.

    Pairs of ids are few bytes but much work, so they are dealt out by number, not by size, for both joins, which reuse that.
    Of pairs of lists of records (``classes.parted``) the lists come too, as s1_ids and sx_ids."""
    lists = "ids" in s1.columns
    keys = {k: [f"{k}_id", f"{k}_part"] if lists else [f"{k}_id"] for k in ("s1", "sx")}
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for name, side in (("s1", s1), ("sx", sx)):
        texts = side.select(
            F.col("entity_id").alias(f"{name}_id"),
            F.col("name_clean").alias(f"{name}_name"),
            F.col("name_no_suffix").alias(f"{name}_no_suf"),
            F.col("addr_clean").alias(f"{name}_addr"),
            F.col("postal_code").alias(f"{name}_post"),
            *([F.col("part").alias(f"{name}_part"), F.col("ids").alias(f"{name}_ids")] if lists else []),
        )
        edges = edges.repartition(tasks, *keys[name]).join(texts, keys[name], "left").drop(f"{name}_part")
    return edges.fillna("", [f"{k}_{c}" for k in ("s1", "sx") for c in ("name", "no_suf", "addr", "post")])


def _real(value: Column) -> Column:
    return value.cast("double")


def equal(a: Column, b: Column) -> Column:
    return _real((a == b) & (a != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays; 0 where both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def tri_state(a: Column, b: Column) -> Column:
    """1 or 0 where both sides have a value, else -1."""
    return F.when((a == "") | (b == ""), F.lit(-1.0)).otherwise(_real(a == b))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def native_features(pairs: DataFrame) -> DataFrame:
    """All features that are expressions."""
    n1, n2, a1, a2 = (F.col(c) for c in ("s1_name", "sx_name", "s1_addr", "sx_addr"))
    t1, t2, u1, u2 = (T.tokenize(c) for c in (n1, n2, a1, a2))
    d1, d2 = T.numeric_tokens(a1), T.numeric_tokens(a2)
    h1, h2 = T.first_number(a1), T.first_number(a2)
    l1, l2, m1, m2 = (F.length(c) for c in (n1, n2, a1, a2))
    p1, p2 = F.col("s1_post"), F.col("sx_post")
    first1, first2 = (F.coalesce(F.get(t, F.lit(0)), F.lit("")) for t in (t1, t2))
    house = tri_state(h1, h2)
    found = {
        "name_exact": equal(n1, n2),
        "name_no_suf_exact": equal(F.col("s1_no_suf"), F.col("sx_no_suf")),
        "addr_exact": equal(a1, a2),
        "name_levenshtein": levenshtein_similarity(n1, n2),
        "addr_levenshtein": F.when((a1 == "") | (a2 == ""), F.lit(0.0)).otherwise(levenshtein_similarity(a1, a2)),
        "name_jaccard": jaccard(t1, t2),
        "addr_jaccard": jaccard(u1, u2),
        "name_trigram_jaccard": jaccard(T.char_grams(n1), T.char_grams(n2)),
        "name_len_diff": _real(F.abs(l1 - l2)),
        "name_len_ratio": F.least(l1, l2) / F.greatest(l1, l2, F.lit(1)),
        "addr_len_diff": _real(F.abs(m1 - m2)),
        "addr_len_ratio": F.least(m1, m2) / F.greatest(m1, m2, F.lit(1)),
        "first_token_match": equal(first1, first2),
        "first_token_conflict": _real((first1 != "") & (first2 != "") & (first1 != first2)),
        "number_exact": house,
        "number_conflict": _real(house == 0),
        "addr_num_shared": _real(F.size(F.array_intersect(d1, d2))),
        "num_toks_diff": _real(F.size(F.array_except(d1, d2)) + F.size(F.array_except(d2, d1))),
        "postal_exact": tri_state(p1, p2),
        "postal_prefix_match": tri_state(F.substring(p1, 1, 3), F.substring(p2, 1, 3)),
        "addr_present_both": _real((a1 != "") & (a2 != "")),
        "name_exact_addr_missing": _real((n1 == n2) & (n1 != "") & ((a1 == "") | (a2 == ""))),
        "name_only_s1": _real(F.size(F.array_except(t1, t2))),
        "name_only_sx": _real(F.size(F.array_except(t2, t1))),
        "addr_only_s1": _real(F.size(F.array_except(u1, u2))),
        "addr_only_sx": _real(F.size(F.array_except(u2, u1))),
        "name_tok_count_diff": _real(F.abs(F.size(t1) - F.size(t2))),
        "addr_tok_count_diff": _real(F.abs(F.size(u1) - F.size(u2))),
    }
    return pairs.withColumns(found)


NAME_SCORES = ["ratio", "token_sort", "token_set", "wratio", "jaro_winkler", "partial"]
ADDRESS_SCORES = ["ratio", "token_sort", "token_set", "jaro_winkler"]


def string_features(pairs: DataFrame, name_scores: list[str] = NAME_SCORES, addr_scores: list[str] = ADDRESS_SCORES, combined: bool = True) -> DataFrame:
    """The scores that need Arrow, and what is computed from them."""
    passes = {
        "_n": string_scores(F.col("s1_name"), F.col("sx_name"), name_scores),
        "_a": string_scores(F.col("s1_addr"), F.col("sx_addr"), addr_scores),
    }
    if combined:
        passes["name_addr_combined_sim"] = string_ratio(
            F.concat_ws(" ", "s1_name", "s1_addr"), F.concat_ws(" ", "sx_name", "sx_addr")
        )
    scored = pairs.withColumns(passes)
    present = (F.col("s1_addr") != "") & (F.col("sx_addr") != "")
    found = {"name_translit_sim" if k == "partial" else f"name_{k}": F.col(f"_n.{k}") for k in name_scores}
    found |= {f"addr_{k}": F.when(present, F.col(f"_a.{k}")).otherwise(F.lit(0.0)) for k in addr_scores}
    scored = scored.withColumns(found)
    if "wratio" in name_scores and "ratio" in addr_scores:
        n, a = F.col("name_wratio"), F.col("addr_ratio")
        scored = scored.withColumns(
            {
                "name_addr_mean": (n + a) / 2,
                "name_addr_prod": n * a,
                "name_addr_sum": n + a,
                "name_addr_max": F.greatest(n, a),
                "name_addr_min": F.least(n, a),
            }
        )
    return scored.drop("_n", "_a")


def first_stage_features(pairs: DataFrame) -> DataFrame:
    """The fifteen features of the first stage."""
    scored = string_features(native_features(pairs), ["ratio", "token_set", "wratio"], ["ratio", "token_set"], False)
    return scored.select("s1_id", "sx_id", *[c for c in ("s1_ids", "sx_ids") if c in pairs.columns], *PAIRWISE_V1)


def all_features(pairs: DataFrame) -> DataFrame:
    return string_features(native_features(pairs))


def proxy_score(pairs: DataFrame) -> DataFrame:
    """A score without a model: the mean of the two token Jaccards, to six digits."""
    name = jaccard(T.tokenize(F.col("s1_name")), T.tokenize(F.col("sx_name")))
    address = jaccard(T.tokenize(F.col("s1_addr")), T.tokenize(F.col("sx_addr")))
    return pairs.withColumn("score", F.round((name + address) / 2, 6))
