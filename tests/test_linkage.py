"""The record-linkage operators: every query against its SQL, units, brute force and round trips."""

from __future__ import annotations

import ast
import math
import os
import random
import subprocess
import sys

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import strings as S
from tessera.functions import text as T
from tessera.operators import assign, blocking, boosting, classes, export, features, metrics, models, ranking, retrieval
from tessera.plans import fixtures, pipeline, registry
from tessera.sources import files
from tessera.streaming import incremental

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "part", "customer", "supplier"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)].astype(object)
    plain = lambda x: None if x is None or x is pd.NA or isinstance(x, float) and math.isnan(x) else round(x, 9) + 0.0 if isinstance(x, float) else x
    return sorted(repr(tuple(plain(x) for x in r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_is_its_sql(spark, duck, name):
    got, expected = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("function", "given", "expected"),
    [
        (T.name_clean, "A_b प्रा! C", "a b प्रा c"),
        (T.name_clean, None, ""),
        (T.name_clean, "R&D  Ltd.", "r and d ltd"),
        (T.name_legal, "caféco éco co", "cafécompany écompany company"),
        (T.name_no_suffix, "the company limited group", "the group"),
        (T.addr_clean, "12 Main St., #4 & Co/Rd", "12 main street , #4 and co/road"),
        (T.postal_code, "12 Main St 90210", "90210"),
        (T.postal_code, "x 560001-1234 12345", "560001"),
        (T.postal_code, "nothing", None),
        (T.strip_accents, "cóálition Łódź प्रा", "coalition Łodz पर"),
        (T.ocr_view, "5h0p 1", "shop l"),
        (T.compact_key, "ab com é c", "abec"),
        (T.first_number, "no 12b 34 5", "34"),
        (T.street_word, "12 main 3 x", "main"),
    ],
)
def test_text(spark, function, given, expected):
    assert value(spark, function(F.lit(given).cast("string"))) == expected


def test_text_arrays(spark):
    assert value(spark, T.char_grams(F.lit("ab"))) == ["ab"]
    assert value(spark, T.char_grams(F.lit("abab"))) == ["aba", "bab"]
    assert value(spark, T.tokenize(F.lit("  a  b "))) == ["a", "b"]
    assert value(spark, T.tokenize(F.lit(""))) == []
    mapping = F.create_map(F.lit("प्रा"), F.lit("private"))
    assert value(spark, T.transliterated(F.lit("प्रा, x"), mapping)) == "private x"


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def ratio(a, b):
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcé日") for _ in range(rng.randrange(1, 6)))
    text = lambda n: " ".join(word() for _ in range(rng.randrange(n)))
    out = [(text(5), text(5)) for _ in range(300)] + [(text(30), text(30)) for _ in range(20)] + [(text(2), text(12)) for _ in range(40)]
    return out + [("", ""), ("", "a"), ("a b", "b a"), ("a b", "a b c"), ("x" * 64, "x" * 65), ("kitten", "sitting"), ("😀a", "a😀")]


def test_ratios_are_brute_force(pairs):
    a, b = zip(*pairs)
    for got, (x, y) in zip(S.ratio(list(a), list(b)), pairs):
        assert got == pytest.approx(ratio(x, y))
    for got, (x, y) in zip(S.partial(list(a), list(b)), pairs):
        x, y = sorted((x, y), key=len)
        orders = [(x, y), (y, x)] if len(x) == len(y) else [(x, y)]
        best = max((ratio(p, q[max(0, i) : i + len(p)]) for p, q in orders for i in range(1 - len(p), len(q))), default=0.0) if x else float(not y)
        assert got == pytest.approx(best)
    for got, (x, y) in zip(S.token_set(list(a), list(b)), pairs):
        p, q = set(x.split()), set(y.split())
        c, d, e = (" ".join(sorted(s)) for s in (p & q, p - q, q - p))
        left, right = f"{c} {d}".strip(), f"{c} {e}".strip()
        best = max(ratio(left, right), *([ratio(c, left), ratio(c, right)] if c else [0]))
        assert got == pytest.approx(0 if not p or not q else 1 if c and (not d or not e) else best)


def test_scores_have_range_and_symmetry(pairs):
    a, b = (list(x) for x in zip(*pairs))
    for f in (S.ratio, S.token_sort, S.token_set, S.wratio, S.partial):
        one, other = f(a, b), f(b, a)
        assert one == pytest.approx(other)
        assert ((one >= 0) & (one <= 1 + 1e-9)).all()
        same = f(a, a)
        assert all(v == pytest.approx(1) for v, x in zip(same, a) if x.strip())


def test_jaro_winkler_is_the_engine(duck, pairs):
    # the engine compares bytes, so characters beyond ASCII are left out
    plain = {ord("é"): "e", ord("日"): "n"}
    for x, y in ((a.translate(plain), b.translate(plain)) for a, b in pairs):
        if not (x + y).isascii():
            continue
        [(expected,)] = duck.execute("SELECT jaro_winkler_similarity(?, ?)", [x, y]).fetchall()
        assert S.jaro_winkler(x, y) == pytest.approx(expected if x or y else 1.0), (x, y)


def test_blocking_is_the_predicate(spark):
    s1, s2, _ = fixtures.sources(fixtures.rec_part(spark, SF))
    left, right = ([r for r in d.collect()] for d in (s1, s2))
    brute = {(a.entity_id, b.entity_id) for a in left for b in right if a.country_clean == b.country_clean and a.addr_clean == b.addr_clean and len(a.addr_clean) > 8}
    assert {tuple(r) for r in blocking.exact_address(s1, s2).collect()} == brute


def frame(spark, data, schema="s1_id string, sx_id string, score double"):
    return spark.createDataFrame(data, schema)


def test_f05(spark):
    universe = frame(spark, [("a",), ("b",), ("c",), ("d",)], "s1_id string")
    gold = frame(spark, [("a", "x"), ("a", "y"), ("b", "z")], "s1_id string, sx_id string")
    predicted = frame(spark, [("a", "x"), ("c", "q"), ("a", "x")], "s1_id string, sx_id string")
    got = {r.s1_id: r.f for r in metrics.per_entity(predicted, gold, universe).collect()}
    assert got == {"a": pytest.approx(0.833333, abs=1e-6), "b": 0.0, "c": 0.0, "d": 1.0}
    [r] = metrics.macro_f(predicted, gold, universe).collect()
    assert (r.total_singletons, r.singletons_correct, r.singleton_accuracy, r.predicted_matches) == (2, 1, 0.5, 2)


def test_exclusivity_ties_and_margin(spark):
    pairs = frame(spark, [("b", "x", 0.9), ("a", "x", 0.9), ("c", "y", 0.8), ("a", "z", 0.9), ("b", "z", 0.7)])
    assert sorted(r[:2] for r in map(tuple, assign.exclusive(pairs).collect())) == [("a", "x"), ("a", "z"), ("c", "y")]
    assert sorted(r[:2] for r in map(tuple, assign.exclusive(pairs, margin=0.1).collect())) == [("a", "z"), ("c", "y")]


def test_recovery(spark):
    pairs = frame(spark, [("a", "x", 0.9), ("a", "y", 0.7), ("b", "x", 0.9), ("b", "y", 0.8), ("c", "z", 0.95), ("d", "z", 0.8)])
    got = assign.recovered(pairs, frame(spark, [("c", "z", 0.95)])).collect()
    assert [tuple(r) for r in got] == [("a", "x", 0.9)]


def test_percentile_of_one(spark):
    [r] = ranking.competition(frame(spark, [("a", "x", 0.5)])).collect()
    assert (r.score_percentile, r.target_second_best_base_score, r.cand_rank) == (1.0, 0.0, 1)


def test_both_targets_are_exported(spark):
    found = registry.QUERIES["submission_summary_both"](spark, SF).first()
    assert found.s2_links > 0 and found.s3_links > 0 and found.links == found.s2_links + found.s3_links
    lists = [registry.QUERIES[f"export_{k}_both"](spark, SF).toPandas() for k in ("matches", "candidates")]
    assert all(x.iloc[:, 1].str.contains("S3-").any() for x in lists)


def test_validation(spark):
    s1 = frame(spark, [("S1-1",), ("S1-2",)], "entity_id string")
    lists = frame(spark, [("S1-1", "S2-1,S2-1"), ("S1-1", ""), ("S1-9", "S1-9,X")], "source1_entity_id string, matched_entity_ids string")
    known = frame(spark, [("S2-1",)], "entity_id string")
    found = {r.rule: r.findings for r in export.validate(lists, s1, known=known).collect()}
    assert found == {"duplicate_s1": 1, "duplicate_id": 1, "self_match": 1, "wrong_prefix": 2, "missing_s1": 1, "extra_s1": 1, "unknown_id": 2}
    assert set(found) == set(export.RULES)


def test_files(spark, tmp_path):
    path = tmp_path / "r.tsv"
    path.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\textra\nS1-1\t"A"\t1 Main St\tIN\tq\nS1-2\tB\n', encoding="utf-8")
    got = files.read_records(spark, str(path)).collect()
    assert [r.country for r in got] == ["IN", None] and got[0].business_name == "A"
    assert files.read_tsv(spark, str(path), quoted=False).first().business_name == '"A"'
    with pytest.raises(ValueError, match="missing columns: nope"):
        files.read_tsv(spark, str(path), ["nope"])
    lists = frame(spark, [("S1-1", "S2-1"), ("S1-2", "")], "source1_entity_id string, matched_entity_ids string")
    files.write_tsv(lists, str(tmp_path / "out"), crlf=True)
    [part] = (tmp_path / "out").glob("part-*")
    assert part.read_bytes() == b"source1_entity_id\tmatched_entity_ids\r\nS1-1\tS2-1\r\nS1-2\t\r\n"
    assert sorted(map(tuple, files.read_truth(spark, str(tmp_path / "out")).collect()))[0][0] == "S1-1"
    pipeline.ingest(spark, str(path), str(tmp_path / "norm"))
    assert files.read_parquet(spark, str(tmp_path / "norm"), ["entity_id", "name_clean"]).count() == 2
    files.write_json(lists, str(tmp_path / "j"))
    assert files.read_json(spark, str(tmp_path / "j"), ["source1_entity_id"]).count() == 2


def test_text_faults_order_and_counts(spark, tmp_path):
    faults = lambda p: {r.rule: r.findings for r in files.text_faults(spark, str(p)).collect()}
    good, commas, odd = (tmp_path / n for n in ("good", "commas", "odd"))
    good.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S2-2\n\nS1-2\t\n")
    commas.write_text("source1_entity_id,matched_entity_ids\nS1-1,S2-1\n")
    odd.write_text("id\tmatched_entity_ids\nS1-1 S2-1\nS1-2\t\nS1-3\n")
    assert faults(good) == {"separator": 0, "header": 0, "malformed_row": 0}
    assert faults(commas) == {"separator": 1, "header": 1, "malformed_row": 1}
    assert faults(odd) == {"separator": 0, "header": 1, "malformed_row": 2}
    lists = spark.range(500).select(F.concat(F.lit("S1-"), 1000 + (F.col("id") * 7) % 500).alias("source1_entity_id"), F.lit("").alias("matched_entity_ids"))
    for name, one in (("one", True), ("many", False)):
        files.write_tsv(lists.repartition(3), str(tmp_path / name), one, order=["source1_entity_id"])
        parts = sorted((tmp_path / name).glob("part-*"))
        written = [x.split("\t")[0] for p in parts for x in p.read_text().split("\n")[1:-1]]
        assert written == [f"S1-{k}" for k in range(1000, 1500)] and (len(parts) == 1 or not one)
        assert files.rows_in(spark, str(tmp_path / name), files.TRUTH) == 500


def test_shuffled(spark):
    rows = frame(spark, [(f"S1-{k}", "x") for k in range(60)], "s1_id string, sx_id string")
    got = [r.s1_id for r in ranking.shuffled(rows.repartition(5), ["s1_id", "sx_id"]).collect()]
    assert got == [r.s1_id for r in ranking.shuffled(rows, ["s1_id", "sx_id"]).collect()] != [f"S1-{k}" for k in range(60)]
    assert got != [r.s1_id for r in ranking.shuffled(rows, ["s1_id", "sx_id"], 7).collect()]


def test_model_is_saved_loaded_and_applied(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    s1, s2, _ = fixtures.sources(fixtures.rec_part(spark, sf))
    edges = blocking.street(s1, s2).unionByName(blocking.exact_name(s1, s2)).distinct()
    gold, universe = registry._gold(spark, sf)
    pairs = metrics.labelled(features.native_features(features.attach_text(edges, s1, s2)), gold)
    pairs = pairs.withColumns({"tfidf_score": F.lit(0.0), "held": T.bucket(F.col("s1_id"), "v", 4) == 0}).cache()
    columns = [*registry.MODEL_COLUMNS, "tfidf_score"]
    model = models.train(pairs, columns, rounds=12, depth=3, validation="held")
    assert 1 <= model.getNumTrees <= 12
    models.save(model, str(tmp_path / "m"))
    new = pairs.where("held").drop("tfidf_score")
    scored = models.rescore(models.load(str(tmp_path / "m")), new, columns, "score").cache()
    own = {(r.s1_id, r.sx_id): r.score for r in models.predict(model, pairs.where("held"), columns, "score").collect()}
    assert own == {(r.s1_id, r.sx_id): r.score for r in scored.collect()} and own
    held = universe.where(T.bucket(F.col("s1_id"), "v", 4) == 0)
    inside = gold.join(held, "s1_id", "left_semi")
    best = models.choose_threshold(scored, inside, held, "score")
    metric = lambda t: metrics.macro_f(assign.above(scored, t), inside, held).first().macro_f05
    assert metric(best) >= max(metric(0.05), metric(0.5), metric(0.95))


def test_transliterations(spark):
    pairs = frame(spark, [("abc private", "xyz प्रा"), ("def private", "q प्रा"), ("one two", "ज x"), ("a", "b c")], "s1_name string, sx_name string")
    assert [tuple(r) for r in retrieval.transliterations(pairs).collect()] == [("प्रा", "private")]


def test_model_separates(spark):
    s1, s2, _ = fixtures.sources(fixtures.rec_part(spark, "/root/testdata/sf0.01"))
    edges = blocking.street(s1, s2).unionByName(blocking.exact_name(s1, s2)).distinct()
    gold, _ = registry._gold(spark, "/root/testdata/sf0.01")
    found = metrics.labelled(features.native_features(features.attach_text(edges, s1, s2)), gold).cache()
    scored = models.out_of_fold(found, registry.MODEL_COLUMNS, rounds=2, depth=3)
    assert scored.count() == found.count()
    mean = {r.label: r.m for r in scored.groupBy("label").agg(F.avg("stage1_score").alias("m")).collect()}
    assert mean[1] > mean[0] + 0.2
    assert models.better((0.5, "a"), (0.5, "b")) == "a"


def test_boosting_grows_the_trees_of_spark(spark):
    """The same scores as GBTClassifier's, in two tasks, with repeated rows, weights, a constant and a repeated column."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rng = random.Random(5)
    rows = [(k, *(rng.randrange(n) / 8 for n in (30, 20, 12, 3)), 1.0) for k in range(3000)]
    rows = [(*r, r[1], int(r[1] + r[2] * r[3] + rng.gauss(0, 0.6) > 3)) for r in rows]
    columns = ["a", "b", "c", "d", "same", "again"]
    pairs = spark.createDataFrame([*rows, *rows[:500]], ", ".join(f"{c} double" if c in columns else f"{c} int" for c in ["k", *columns, "label"]))
    pairs = pairs.withColumn("_w", F.when(F.col("label") == 1, 3.0).otherwise(1.0)).cache()
    vectors = VectorAssembler(inputCols=columns, outputCol="_v").transform(pairs)
    theirs = GBTClassifier(featuresCol="_v", labelCol="label", weightCol="_w", maxIter=8, maxDepth=4, stepSize=0.1).fit(vectors)
    expected = {r.k: r.p for r in theirs.transform(vectors).select("k", vector_to_array("probability")[1].alias("p")).collect()}
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(boosting, "TASK_ROWS", 1000)
        own = models.train(pairs, columns, rounds=8, depth=4, rate=0.1)
    got = {r.k: r.p for r in models.predict(own, pairs, columns, "p").select("k", "p").collect()}
    assert own.getNumTrees == 8 and got == pytest.approx(expected, abs=1e-9)


def test_models_are_registered_whole(spark, monkeypatch):
    train, asked = models.train, []

    def short(pairs, columns, **options):
        asked.append((options["rounds"], set(columns)))
        return train(pairs, columns, **options | {"rounds": 1, "depth": 2})

    monkeypatch.setattr(models, "train", short)
    for name in ("gbt_stage1", "gbt_stage2"):
        assert registry.QUERIES[name](spark, SF).count() > 0
    assert [n for n, _ in asked] == [200, 250, 250, 250, 250]
    whole = {*registry.MODEL_COLUMNS, "name_wratio", "name_token_set", "addr_token_sort", "name_jaro_winkler", "name_translit_sim", "cand_rank", "target_margin"}
    assert all(whole <= columns and "label" not in columns for _, columns in asked)
    assert {"stage1_score", "best_sibling_score"} <= asked[-1][1]


def test_stream_finds_what_a_batch_finds(spark, tmp_path):
    records = fixtures.rec_part(spark, SF).drop("text").withColumn("arrived", F.lit("2024-01-01").cast("timestamp"))
    new = records.where(F.col("entity_id").startswith("S1-"))
    standing = records.where(F.col("entity_id").startswith("S2-")).drop("arrived")
    new.union(new).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(new.schema).parquet(str(tmp_path / "in"))
    incremental.start(stream, standing, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("s1_id", "sx_id").collect()}
    s1, s2 = T.normalized(new), T.normalized(standing)
    expected = blocking.exact_name(s1, s2).union(blocking.exact_address(s1, s2)).union(blocking.street(s1, s2))
    assert got == {tuple(r) for r in expected.distinct().collect()} and got


def test_empty_sources(spark):
    s1, s2, _ = fixtures.sources(fixtures.rec_part(spark, SF))
    none = s1.limit(0)
    assert blocking.block_union(none, s2).count() == 0 and blocking.block_union(s1, none).count() == 0
    assert retrieval.top_k(none, s2).count() == 0


def test_optional_parts_stay_apart():
    for folder, _, names in os.walk(ROOT):
        if any(x in folder for x in (".git", "/llm", "__pycache__")):
            continue
        for name in names:
            if name.endswith(".py") and name not in ("__spark_entry__.py", "corpus_pipeline.py"):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    tree = ast.parse(f.read())
                for node in ast.walk(tree):
                    modules = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                    assert not any("llm" in m or m == "corpus_pipeline" for m in modules), (folder, name)


def test_command_line(spark, tmp_path, capsys):
    from tessera.__main__ import main

    records = fixtures.rec_part(spark, SF).drop("text")
    for k in (1, 2, 3):
        files.write_tsv(records.where(F.col("entity_id").startswith(f"S{k}-")), str(tmp_path / f"raw{k}"))
        assert main(["ingest", "--records", str(tmp_path / f"raw{k}"), "--out", str(tmp_path / f"s{k}")]) == 0
    s = {k: str(tmp_path / f"s{k}") for k in (1, 2, 3)}
    assert main(["block", "--s1", s[1], "--sx", s[2], "--out", str(tmp_path / "block")]) == 0
    assert spark.read.json(str(tmp_path / "block/diagnostics")).count() == 6
    assert main(["retrieve", "--s1", s[1], "--sx", s[2], "--k", "3", "--out", str(tmp_path / "top")]) == 0
    assert main(["match", "--s1", s[1], "--s2", s[2], "--s3", s[3], "--out", str(tmp_path / "links")]) == 0
    assert main(["export", "--links", str(tmp_path / "links"), "--s1", s[1], "--out", str(tmp_path / "lists")]) == 0
    assert main(["validate", "--lists", str(tmp_path / "lists"), "--s1", s[1]]) == 0
    truth = tmp_path / "truth.tsv"
    truth.write_text("source1_entity_id\tmatched_entity_ids\nS1-3\tS2-1\n")
    assert main(["evaluate", "--links", str(tmp_path / "links"), "--s1", s[1], "--truth", str(truth)]) == 0
    assert "macro_f05" in capsys.readouterr().out
    assert main(["validate", "--lists", str(truth), "--s1", s[1]]) == 1


@pytest.mark.parametrize("missing", ["xxhash", "zstandard"])
def test_entry_works_without_a_library_of_the_optional_part(missing):
    code = f"import sys, warnings; sys.modules[{missing!r}] = None; warnings.simplefilter('ignore'); import __spark_entry__ as e; q = e.queries(); print(len(q), set(e.oracle_sql()) <= set(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == [str(len(registry.QUERIES)), "True"], done.stderr


def _copies(spark, tmp_path, twice=True, times=12):
    """Every part several times with shifted keys; some ids twice, with other contents."""
    part = spark.read.parquet(f"{SF}/part.parquet").where("p_partkey < 60")
    some = part.where("p_partkey % 7 = 0").withColumn("p_name", F.lit("red gear"))
    copies = part.crossJoin(spark.range(times)).withColumn("p_partkey", F.col("p_partkey") + 200 * F.col("id")).drop("id")
    (copies.unionByName(some) if twice else copies).write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["best_threshold", "threshold_sweep", "match_run", "prediction_diff", "validate_rules", "exclusivity_margin", "candidate_recall", "containment", "feat_postal"])
def test_copies_are_as_in_sql(spark, tmp_path, name):
    # of an id with two rows these two count pairs, their SQL rows
    sf, con = _copies(spark, tmp_path, name not in ("prediction_diff", "validate_rules")), duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{sf}/part.parquet/*.parquet'")
    assert rows(registry.QUERIES[name](spark, sf).toPandas()) == rows(con.sql(registry.ORACLES[name]).df())


def test_copies_are_scored_once(spark, tmp_path):
    sources = fixtures.class_sources(fixtures.rec_part(spark, _copies(spark, tmp_path)), ("S1", "S2"))
    scored = pipeline.score_classes(sources, "S2").agg(F.count("score").alias("n"), F.sum(F.col("s1_n") * F.col("sx_n")).alias("all")).first()
    assert scored.n < scored["all"] / 5


def test_retrieval_shuffles_records_not_pairs(spark):
    """Blocks of any size give the pairs of SQL, and no exchange carries a pair of a record and a target."""
    s1, s2, _ = fixtures.by_source(T.normalized(fixtures.rec(spark, SF)))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    expected = rows(con.sql(registry.ORACLES["tfidf_topk"]).df())
    for block in (3, 17, 1000):
        found = retrieval.top_k(s1, s2, 20, 2, 0.05, block)
        assert rows(found.toPandas()) == expected
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "sum((w1" not in plan and "FlatMapCoGroupsInArrow" in plan


def test_retrieval_ties_of_copies(spark):
    """Of many targets of equal words the first ids are kept, whatever block they are in."""
    names = [("S1-1", "red iron gear"), *((f"S2-{k}", "red iron gear") for k in range(50)), *((f"S2-x{k}", f"blue salt {k}{k}") for k in range(99))]
    records = T.normalized(spark.createDataFrame([(i, n, "", "us") for i, n in names], "entity_id string, business_name string, business_address string, country string"))
    s1, s2, _ = fixtures.by_source(records)
    for block in (7, 1000):
        got = [r.sx_id for r in retrieval.top_k(s1, s2, 20, 2, 0.5, block).orderBy("sx_id").collect()]
        assert got == sorted(f"S2-{k}" for k in range(50))[:20]


@pytest.mark.parametrize("name", ["exclusivity", "export_matches", "export_matches_both", "delta_apply_both", "delta_faults", "feat_jaccard", "feat_exact_len", "blend_scores"])
def test_copies_of_links_and_features_are_as_in_sql(spark, tmp_path, name):
    # of an id with two rows the SQL of exports lists each target twice
    sf, con = _copies(spark, tmp_path, not name.startswith(("export", "delta_apply"))), duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{sf}/part.parquet/*.parquet'")
    assert rows(registry.QUERIES[name](spark, sf).toPandas()) == rows(con.sql(registry.ORACLES[name]).df())


def test_pairs_are_dealt_out_for_both_joins(spark):
    """By number, so that small rows with much work are not put together into few tasks."""
    s1, s2, _ = fixtures.sources(fixtures.rec_part(spark, SF))
    plan = features.attach_text(blocking.street(s1, s2), s1, s2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [s1_id") == 1 and plan.count("RepartitionByExpression [sx_id") == 1


def test_all_features_once_for_copies(spark, tmp_path):
    """A row for each pair of classes, whose lists give every pair of records with the features of its own texts."""
    sf = _copies(spark, tmp_path)
    found = registry.QUERIES["feat_all"](spark, sf).toPandas()
    s1, s2, _ = fixtures.sources(fixtures.rec_part(spark, sf))
    plain = features.all_features(features.attach_text(blocking.block_union(s1, s2), s1, s2))
    columns = [c for c in found.columns if c not in ("s1_id", "sx_id", "s1_ids", "sx_ids")]
    expected = plain.select("s1_id", "sx_id", *[F.round(c, 6).alias(c) for c in columns]).toPandas()
    assert rows(classes.unlisted(spark.createDataFrame(found)).toPandas()) == rows(expected)
    assert {"name_wratio", "addr_jaccard", "name_addr_combined_sim"} <= set(columns) and len(columns) > 40
    assert len(found) < len(expected) / 5 and (found.s1_id == found.s1_ids.map(min)).all()
