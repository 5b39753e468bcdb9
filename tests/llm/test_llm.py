"""The ten operators against brute-force versions, exact round trips and held-out accuracy, on small hard cases."""

from __future__ import annotations

import base64
import collections
import hashlib
import html
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import (
    chat,
    common,
    components,
    decontaminate,
    extract,
    jaccard,
    packing,
    quality,
    sharding,
    tokenfile,
    tokens,
    urls,
    warc,
)
from tessera.llm.common import scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
HARD = [None, "", " ", "\n\n", "one", "a b", "a b c", "\x00 \x1f", "é ü 中文 🇫🇷 <|endoftext|> x", "x  y\t z\r\n", "'ll don't 12 3.4"]


def words_of(rng, n, vocabulary=40):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    out = list(HARD)
    for n in (12, 30, 60, 200, 200, 900):
        base = words_of(rng, n, 4000)
        out += [base, base, base.replace(" w1", " W1"), base + " tail", base.replace(" ", "\n", 3)]
        ws = base.split()
        for share in (0.01, 0.02, 0.04):
            out.append(" ".join(w if rng.random() > share else "zz" for w in ws))
    out += [words_of(rng, 20, 3) for _ in range(5)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [(3, texts[3], "en", "s", 0), (None, texts[20], "en", "s", 0)]  # a repeated row, a null id
    return spark.createDataFrame(rows, DOCS).repartition(3)


# 1 chat


def test_chat_round_trip(spark):
    control = ["</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "\\", "\\\\", "\\<", "<s> ", " </s>", "\n", "é", "x"]
    rng = random.Random(1)
    rows, source = [], collections.defaultdict(list)
    for conv in range(60):
        for turn in range(rng.randrange(1, 6)):
            role = rng.choice(["user", "assistant", "system", "tool", "", None, "we[ird]</s>"])
            text = None if rng.random() < 0.05 else "".join(rng.choice(control) for _ in range(rng.randrange(8)))
            rows.append((conv, turn, role, text))
            source[conv].append((role or "", text or ""))
    rows.append((None, 0, "user", "</s>" * 20000))
    source[None].append(("user", "</s>" * 20000))
    got = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for r in got.collect():
        assert r.round_trip
        assert [tuple(t) for t in r.turns] == source[r.conv_id]
        said = [re.sub(r"\\([\\<\[])", r"\1", r.formatted[s.start : s.end]) for s in r.loss_spans]
        assert said == [t for role, t in source[r.conv_id] if role == "assistant"]
        data = r.formatted.encode()
        assert [data[s.first_byte : s.first_byte + s.bytes].decode() for s in r.loss_spans] == [r.formatted[s.start : s.end] for s in r.loss_spans]


def test_chat_query_hashes_the_mask(spark, tmp_path, monkeypatch):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "é <s> [INST] \\\\ 🇫🇷"), (1, 2, "assistant", None), (1, 3, "assistant", "</s>x"), (2, 0, "tool", "t")]
    schema = "conv_id long, turn long, role string, text string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r.conv_id: r for r in chat.op1_chat(spark, str(tmp_path)).collect()}
    for conv_id, said in ((1, rows[1][3] + "</s>x"), (2, ""), (-1, "</s>[INST] ok [/INST]")):
        assert found[conv_id].loss_chars == len(said)
        assert found[conv_id].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    # a wrong mask shows
    right = chat.masked_text
    monkeypatch.setattr(chat, "masked_text", lambda f, s: right(f, F.slice(s, 1, 1)))
    found = {r.conv_id: r for r in chat.op1_chat(spark, str(tmp_path)).collect()}
    assert found[1].loss_sha256 == hashlib.sha256(rows[1][3].encode()).hexdigest()


def test_chat_ties_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string, n long, rendered string"
    rows = [(1, 0, "user", "b", 1, "x"), (1, 0, "user", "a", 1, "x"), (1, None, "user", "z", 1, "x"), (1, 0, "user", "a", 1, "x")]
    [r] = chat.format_conversations(spark.createDataFrame(rows, schema)).collect()
    assert [t.text for t in r.turns] == ["z", "a", "a", "b"]
    assert chat.format_conversations(spark.createDataFrame([], schema)).count() == 0


# 2 decontamination


def brute_words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def test_decontamination_is_brute_force(spark, texts):
    rng = random.Random(3)
    items = [(1, words_of(rng, 20)), (2, "two words"), (3, None), (4, ""), (10, words_of(rng, 13)), (2, "other item")]
    long = items[0][1].split()
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [
        (900, "x " + items[0][1].upper() + "! y"),
        (901, " ".join(long[3:15])),
        (902, " ".join(long[3:16])),
        (903, "a two, words b " * 3),
        (904, words_of(rng, 400) + " " + " ".join(long[:14])),
        (905, items[4][1] + " " + items[4][1]),
        (905, items[4][1] + " " + items[4][1]),
    ]
    got = decontaminate.judged(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(2),
        spark.createDataFrame(items, "item_id long, text string"),
        shard_words=60,
        block_bytes=40,
    ).collect()
    expected = []
    for doc_id, text in rows:
        ws, hit, names = brute_words(text), set(), set()
        for name, item in items:
            iw = brute_words(item)
            n = min(13, len(iw))
            for i in range(len(iw) - n + 1 if n else 0):
                for j in range(len(ws) - n + 1):
                    if ws[j : j + n] == iw[i : i + n]:
                        hit |= set(range(j, j + n))
                        names.add(str(name))
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        expected.append((doc_id, len(ws), len(hit), len(names), digest, len(hit) > 0 and 20 * len(hit) >= len(ws)))
    assert sorted(r[:6] for r in map(tuple, got)) == sorted(expected)
    longest = {r.doc_id: (r.longest_match, r.longest_at) for r in got}
    assert longest[900] == (20, 1) and longest[904] == (14, 400) and longest[901] == (12, 0)


def test_longest_matches_of_documents_that_share_items():
    rng = random.Random(8)
    items = [("a", words_of(rng, 20)), ("b", words_of(rng, 30)), ("c", "two words"), ("d", "x " * 16), ("e", "one")]
    items.append(("f", items[1][1]))
    whole, other = items[0][1], items[1][1].split()
    texts = [whole, "p " + whole, f"q r {whole} s", f"{whole} {' '.join(other[2:25])} z", " ".join(other), "two words two words", "x " * 40]
    texts += [" ".join(other[5:18]) + " y " + " ".join(other[3:16]), "one two", "nothing", "", "a one", whole.rsplit(" ", 8)[0], *(" ".join(other[k : k + 15]) for k in range(9))]
    expected = []
    for text in texts:
        ws, best = brute_words(text), (0, 0, "")
        for name, item in items:
            iw = brute_words(item)
            for i in range(len(iw)):
                for j in range(len(ws)):
                    n = 0
                    while i + n < len(iw) and j + n < len(ws) and iw[i + n] == ws[j + n]:
                        n += 1
                    if n:
                        best = min(best, (-n, j, name))
        expected.append((-best[0], best[1], best[2]) if best[0] else (0, None, None))
    blocks = [[(n, t.encode()) for n, t in part] for part in (items[:2], items[2:])]
    assert {n for n, _, _ in expected} >= {0, 1, 2, 12, 20}
    for parts in (blocks, [sum(blocks, [])]):
        known = decontaminate.Vocabulary()
        tests = [lambda t=decontaminate.Tests(p, 13, known): t for p in parts]
        assert [r[5:] for r in decontaminate.search([t.encode() for t in texts], known, tests)] == expected
        assert [r[5:] for t in texts for r in decontaminate.search([t.encode()], known, tests)] == expected


def test_suffix_array_order():
    rng = np.random.default_rng(5)
    for n, v in ((0, 1), (1, 1), (300, 1), (500, 2), (700, 40)):
        words = rng.integers(0, v, n)
        listed = words.tolist()
        order = sorted(range(n), key=lambda i: listed[i:])
        assert decontaminate.suffix_array(words).tolist() == order
        if n:
            assert decontaminate._suffix_array_wide(words).tolist() == order


def test_decontamination_keeps_rows_and_columns(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    clash = docs.withColumn("n_hit", F.lit("mine"))
    kept = decontaminate.judged(clash, none, keep=True)
    assert kept.columns == clash.columns and kept.count() == docs.count()
    assert decontaminate.judged(docs.limit(0), none).count() == 0


# 3 and 7 tokens


@pytest.fixture(scope="module")
def library():
    return tokens.encoder(tokens.default_path())


def test_encoder_is_the_library(library, texts):
    for t in [*texts, "a.\nB x\ny\nz q\n r\n s", "x\n\ny", " lead", "trail ", "<|endoftext|>", "a\u00a0b c\u2028d"]:
        t = t or ""
        assert library(t.encode()).tolist() == library.tokenizer.encode(t, add_special_tokens=False).ids


def test_token_files(spark, docs, library):
    found = tokenfile.write(docs, scratch(spark, "t"), tokens.default_path(), rows_per_file=7)
    assert len(found) > 3
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    expected, start = [], 0
    for r in rows:
        ids = library.tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]
        expected.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = tokenfile.read(spark, found).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected
    reader = tokenfile.Reader(found[-1][0])
    k = len(reader) - 1
    assert reader.find(int(reader.doc_ids[k])) == range(k, k + 1)
    assert zlib.crc32(reader.ids(k).astype("<u4").tobytes()) == expected[-1][3]
    damaged = tokenfile.Reader(found[-1][0])
    damaged.checksums = damaged.checksums ^ 1
    with pytest.raises(ValueError):
        damaged.ids(k)
    empty = tokenfile.write(docs.limit(0), scratch(spark, "t"), tokens.default_path())
    assert empty == [] and tokenfile.read(spark, empty).count() == 0


def check_packing(rows, source, library):
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc_id, text in source.items():
        ids, at = library.tokenizer.encode(text or "", add_special_tokens=False).ids + [1], 0
        for r in sorted(by_doc.pop(doc_id), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert not by_doc
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048
    return sum(r.length for r in rows) / (2048 * len(by_sequence))


def test_packing(spark, texts, library):
    source = dict(enumerate(texts)) | {1000: "word " * 9000}
    data = spark.createDataFrame(list(source.items()), "doc_id long, text string").repartition(1)
    rows = packing.packed(data, tokens.default_path(), block_tokens=1 << 15).collect()
    assert check_packing(rows, source, library) > 0.9
    assert packing.packed(data.limit(0), tokens.default_path()).count() == 0


def test_packing_balances_cost():
    rng = random.Random(2)
    sizes = [rng.randrange(1, 5000) for _ in range(400)]
    pieces, count = packing.pack(sizes, 2048, 1 / 4096)
    assert count == -(-sum(sizes) // 2048)
    assert sum(n for _, _, n, _, _ in pieces) == sum(sizes)
    # each whole rest went, by descending cost, to the sequence of lowest cost among those with room for it
    rests = sorted(((-(n % 2048), k) for k, n in enumerate(sizes) if n % 2048))
    first = min(p[3] for p in pieces if p[2] < 2048)
    count = -(-sum(-n for n, _ in rests) // 2048)
    used, cost = [0] * count, [0.0] * count
    by_doc = collections.defaultdict(list)
    for k, start, n, sequence, _ in pieces:
        if sequence >= first:
            by_doc[k].append((start, n, sequence - first))
    for size, k in rests:
        for start, n, s in sorted(by_doc[k]):
            left = -size - (start - sizes[k] // 2048 * 2048)
            fits = [i for i in range(count) if 2048 - used[i] >= left] or [i for i in range(count) if used[i] < 2048]
            assert s == min(fits, key=lambda i: (cost[i], i)) and n == min(left, 2048 - used[s])
            used[s] += n
            cost[s] += n + n * n / 4096
    # against the first sequence with room, in the same order, costs differ less
    room, other = [2048] * count, [0.0] * count
    for size, _ in rests:
        left = -size
        while left:
            s = next((i for i in range(count) if room[i] >= left), None)
            s = next(i for i in range(count) if room[i]) if s is None else s
            n = min(left, room[s])
            room[s], other[s], left = room[s] - n, other[s] + n + n * n / 4096, left - n
    assert np.std(cost) < np.std(other)


def test_packing_keeps_null_ids_repeats_and_clashes(spark, library):
    rows = [(None, "a b"), (7, "x y z"), (7, "x y z"), (8, None)]
    data = spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, text string, length string").repartition(1)
    got = collections.Counter((r.doc_id, r.length, r.doc_tokens) for r in packing.packed(data, tokens.default_path()).collect())
    size = lambda t: len(library.tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    assert got == collections.Counter((d, size(t), size(t)) for d, t in rows)


# 4 Jaccard join


def brute_sets(texts):
    out = []
    for t in texts:
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))} if ws else set())
    return out


def brute_components(rows):
    sets = brute_sets([t for _, t in rows])
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def near(rng, base, edits):
    ws = base.split()
    for _ in range(edits):
        k = rng.randrange(len(ws))
        ws[k : k + 1] = rng.choice([[], ["new"], [ws[k], "more"]])
    return " ".join(ws)


@pytest.mark.parametrize("block", [1 << 22, 400])
def test_jaccard_components(spark, texts, block):
    rng = random.Random(11)
    rows = list(enumerate(texts))
    passage = words_of(rng, 40, 5000)
    for size in (9, 10, 12, 16, 25, 40, 80, 150, 400):
        base = words_of(rng, size, 3000)
        for k in range(12):
            rows.append((len(rows), near(rng, base, rng.randrange(0, max(2, size // 16)))))
        rows.append((len(rows), base + " " + passage))
    rows.append((3, texts[3]))
    rng.shuffle(rows)
    data = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, h1 int, component int")
    got = jaccard.link_components(data.repartition(3), block_shingles=block)
    assert sorted(map(tuple, got.collect())) == brute_components(rows)


def test_jaccard_shared_passages_make_no_large_group(spark):
    """Texts that share a passage only are one group by the parts; none is left when it is narrowed but those that link."""
    passage = " ".join(f"p{k}" for k in range(24))
    rest = [" ".join(f"w{i}x{k}" for k in range(40)) for i in range(40)]
    texts = [f"{passage} {r}" for r in rest] + [f"{passage} {rest[7]} more", f"{passage} {rest[3]} other words"]
    data = spark.createDataFrame([*enumerate(texts), (5, "another text"), (6, texts[6])], "doc_id long, text string").repartition(3)
    join = jaccard._Join(data, 85, 4, 600, every=True)
    assert join.large.isEmpty()
    assert {(r.doc_a, r.doc_b) for r in join.found.collect()} == {(7, 40), (3, 41)}
    got = jaccard.link_components(data, block_shingles=600).where("component_id <> doc_id").collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(40, 7), (41, 3)}


def test_jaccard_search_is_brute_force():
    rng = np.random.default_rng(3)
    pool = jaccard.mixed(np.arange(1, 400, dtype=np.uint64))
    for _ in range(40):
        sets = []
        for _ in range(25):
            base = sets[rng.integers(len(sets))] if sets and rng.random() < 0.7 else rng.choice(pool, rng.integers(1, 120), False)
            keep = base[rng.random(len(base)) > 0.06]
            x = np.unique(np.concatenate([keep, rng.choice(pool, rng.integers(1, 5))]))
            sets.append(x)
        roots = jaccard.linked(sets, 85)
        expected = list(range(len(sets)))

        def find(x, expected=expected):
            while expected[x] != x:
                x = expected[x]
            return x

        for i, a in enumerate(sets):
            for j in range(i):
                both = len(np.intersect1d(a, sets[j]))
                if 100 * both >= 85 * (len(a) + len(sets[j]) - both):
                    expected[find(i)] = find(j)
        groups = lambda r: sorted(sorted(i for i in range(len(sets)) if r[i] == k) for k in set(r))
        assert groups(roots) == groups([find(i) for i in range(len(sets))])


def brute_links(rows):
    """Links between classes of equal sets as (least ids, intersection, union), and (doc_id, class id, links) of each row."""
    sets = brute_sets([t for _, t in rows])
    least, size = {}, collections.Counter()
    for (d, _), s in zip(rows, sets, strict=True):
        if s and d is not None:
            key = frozenset(s)
            least[key] = min(d, least.get(key, d))
            size[key] += 1
    classes = sorted(least, key=least.get)
    found, far = [], collections.Counter()
    for i, a in enumerate(classes):
        for b in classes[i + 1 :]:
            if 100 * len(a & b) >= 85 * len(a | b):
                found.append((least[a], least[b], len(a & b), len(a | b)))
                far[a] += size[b]
                far[b] += size[a]
    each = []
    for (d, _), s in zip(rows, sets, strict=True):
        key = frozenset(s)
        n = size[key] - 1 + far[key] if s and d is not None else 0
        each.append((-1 if d is None else d, len(s), None if d is None else least[key] if s else d, n))
    return sorted(found), sorted(each)


@pytest.mark.parametrize("block", [1 << 22, 400])
def test_jaccard_links(spark, texts, block):
    rng = random.Random(13)
    rows = list(enumerate(texts))
    for size in (8, 25, 60, 120, 400):
        base = words_of(rng, size, 3000)
        for _ in range(40):
            rows.append((len(rows), near(rng, base, rng.randrange(0, max(2, size // 30)))))
    rows += [(len(rows), rows[-1][1]), (3, texts[3]), (None, rows[-1][1])]
    rng.shuffle(rows)
    data = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in rows], "doc_id long, text string, key_a int, copies int, n int")
    pairs, each = brute_links(rows)
    assert len(pairs) > 100
    got = jaccard.links(data.repartition(3), block_shingles=block)
    assert sorted(tuple(r[:4]) for r in got.collect()) == pairs
    got = jaccard.link_counts(data.repartition(3), block_shingles=block)
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got.collect()) == each
    assert jaccard.links(data.limit(0)).count() == 0
    assert jaccard.link_counts(data.limit(0)).count() == 0


def test_every_linking_pair_shares_a_signature():
    rng = np.random.default_rng(9)
    scheme = jaccard.Scheme(85)
    for n in [*range(6, 60), 100, 333, 1000, 5000]:
        common = jaccard.mixed(rng.integers(1, 1 << 60, n).astype(np.uint64))
        least = -(-85 * n // 100)
        for kept, own in ((least, 0), (n - (n - least) // 2, (n - least) // 2 - (n < 20))):
            x = np.sort(common)
            y = np.sort(np.concatenate([common[:kept], jaccard.mixed(rng.integers(1, 1 << 60, max(0, own)).astype(np.uint64))]))
            both = len(np.intersect1d(x, y))
            if 100 * both >= 85 * (len(x) + len(y) - both):
                sig, owner = scheme.signatures([x, y])
                assert set(sig[owner == 0]) & set(sig[owner == 1]), (n, kept, own)


def test_jaccard_nulls_and_stage(spark, docs):
    got = jaccard.link_components(docs).collect()
    assert len(got) == docs.count()
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    kept = jaccard.jaccard_stage(spark, docs, "")
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({r.component_id for r in got if r.doc_id is not None})
    assert jaccard.link_components(docs.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 102), (101, 102), (7, 7), (300, 200), (200, 300)]
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    expected = {i: 0 for i in range(51)} | {100: 100, 101: 100, 102: 100, 200: 200, 300: 200}
    assert {r.node: r.component for r in got} == expected and len(got) == len(expected)


def test_components_in_one_task_and_in_rounds(spark):
    """Few edges take a handful of jobs, however long their chains; more than the limit are joined by rounds, alike."""
    rng = random.Random(8)
    nodes = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(900)]
    edges = [(nodes[i], nodes[i + 1]) for i in range(899) if i % 90] + rng.choices([(nodes[5], nodes[7]), (nodes[1], nodes[1])], k=9)
    rng.shuffle(edges)
    table = spark.createDataFrame(edges, "a long, b long").repartition(5)
    expected = {}
    for i in range(0, 900, 90):
        chain = nodes[i + 1 : i + 91]
        expected |= {n: min(chain) for n in chain}
    spark.sparkContext.setJobGroup("few edges", "")
    try:
        found = components.components(table)
    finally:
        spark.sparkContext.setJobGroup("", "")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few edges")) <= 6
    for got in (found.collect(), components.components(table, task_edges=10).collect()):
        assert {r.node: r.component for r in got} == expected and len(got) == len(expected)
    assert components.components(table.limit(0)).count() == 0


@pytest.mark.parametrize("most", [0, 1000])
def test_jaccard_shuffles_texts_of_groups_only(spark, monkeypatch, most):
    """The texts searched are chosen by their ids before they are shuffled; where the ids are too many the result is the same."""
    rng = random.Random(4)
    rows = [(k, words_of(rng, 60, 5000)) for k in range(30)]
    rows += [(30 + k, near(rng, rows[k][1], 1)) for k in range(6)]
    rows.append((31, rows[12][1]))
    plans, searched = [], jaccard._searched
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", most)
    monkeypatch.setattr(jaccard, "_searched", lambda members, *a: plans.append(members._jdf.queryExecution().toString()) or searched(members, *a))
    got = jaccard.link_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), block_shingles=100)
    assert sorted(map(tuple, got.collect())) == brute_components(rows)
    assert len(plans) == 1 and ("LeftSemi, BuildRight" in plans[0]) == (most > 0)


# 5 WARC


def test_warc(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i % 5}</p>é") for i in range(40)]
    rows += [(50, None, None), (51, "http://x/\r\n y", ""), (3, "http://h/3", "<p>3</p>é"), (60, "u", "WARC/1.1\r\n\r\n\r\n"), (None, "u", "<p>2</p>é")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    index = warc.write(pages.repartition(3), scratch(spark, "warc"), rows_per_file=9)
    got = warc.read(index, gap=10, most=500).collect()
    first = {}
    for i, _, text in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    assert len(got) == len(rows)
    sha = {t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode() for t in first}
    seen = collections.Counter()
    for r in got:
        [text] = {t or "" for i, _, t in rows if i == r.page_id}
        assert r.payload_digest == sha[text] and r.payload_bytes == len(text.encode())
        if r.record_type == "response":
            seen[text] += 1
            assert r.page_id == first[text] and r.refers_to is None and r.payload == text
        else:
            assert r.refers_to == first[text] and r.payload is None
    assert all(seen[t] == 1 for t in first)
    some = warc.read(index.where("page_id % 7 = 1")).collect()
    assert sorted(r.page_id for r in some) == [1, 8, 15, 22, 29, 36, 50]
    kept = warc.read(warc.write(pages, scratch(spark, "warc"), least=9)).collect()
    assert {r.record_type for r in kept if r.payload_bytes < 9} <= {"response"}
    assert warc.read(warc.write(pages.limit(0), scratch(spark, "warc"))).count() == 0


# 6 sharding


def test_sharding(spark, docs):
    more = docs.unionByName(spark.range(100, 3100).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")), True)
    rows = sharding.with_shards(more, sharding.Tree.even(8), sharding.Tree.even(9), buckets=5).collect()
    assert len(rows) == more.count()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert set(by) == set(range(8))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) < 1.3 * len(rows) / 8
    moved = sum(r.grown_shard == 8 for r in rows)
    assert 0.6 < moved / (len(rows) / 9) < 1.4
    size = {r.doc_id: (r.size, r.text_crc32) for r in rows}
    for r in docs.where("doc_id IS NOT NULL").collect():
        assert size[r.doc_id] == (len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()))


def test_sharding_moves_only_in_changed_subtrees(spark):
    tree = sharding.Tree.even(8)
    heavy = sharding.Tree({**tree.regions, "region1": {**tree.regions["region1"], "rack0": {4: 3.0, 5: 1.0}}})
    ids = spark.range(4000).select(
        sharding.shard_of(tree, F.col("id")).alias("a"), sharding.shard_of(heavy, F.col("id")).alias("b")
    )
    moved = [(r.a, r.b) for r in ids.where("a <> b").collect()]
    assert moved and all(b >= 4 for _, b in moved)
    # between racks of the region only the rack with the new weight gains
    assert all(b in (4, 5) for a, b in moved if a >= 4)


def test_one_more_shard_takes_rows_only_into_itself(spark):
    counts = list(range(1, 22))
    placed = spark.range(20_000).select(*[sharding.shard_of(sharding.Tree.even(n), F.col("id")).alias(f"n{n}") for n in counts])
    rows = placed.collect()
    for n in counts:
        share = collections.Counter(r[f"n{n}"] for r in rows)
        assert set(share) == set(range(n))
        assert all(abs(c - 20_000 / n) < 6 * (20_000 / n) ** 0.5 for c in share.values()), (n, share)
    for n in counts[:-1]:
        moved = [r[f"n{n + 1}"] for r in rows if r[f"n{n}"] != r[f"n{n + 1}"]]
        assert moved and set(moved) == {n}


def test_sharding_edges(spark, docs):
    clash = docs.withColumns({c: F.lit("mine") for c in ("shard", "slot", "size", "bucket", "row", "first", "n")})
    tree = sharding.Tree.even(3)
    assert sharding.with_shards(clash, tree, tree).count() == docs.count()
    assert sharding.with_shards(docs.limit(0), tree, tree).count() == 0
    long = spark.createDataFrame([(1, "é" * 3_000_000)], "doc_id long, text string")
    assert sharding.with_shards(long, tree, tree).first().size == 6_000_001
    light = sharding.Tree({"a": {"r": {0: 0.0}}, "b": {"r": {1: 0.0, 2: 1.0}, "q": {3: 3.0}}})
    got = collections.Counter(r[0] for r in spark.range(4000).select(sharding.shard_of(light, F.col("id"))).collect())
    assert set(got) == {2, 3} and 2.6 < got[3] / got[2] < 3.4
    with pytest.raises(ValueError):
        sharding.shard_of(sharding.Tree({"a": {"r": {0: 0.0}}}), F.col("id"))


# 8 extraction


def test_extraction_of_pages(spark):
    import duckdb

    for path in ("sf0.001", "sf0.01"):
        for (page,) in duckdb.sql(f"SELECT html FROM '/root/testdata/{path}/pages.parquet'").fetchall():
            inside = page[page.index("<article>") + 9 : page.index("</article>")]
            parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inside)]
            assert extract.main_text(page) == "\n".join(p for p in parts if p)


def test_extraction_cases(spark):
    long = "A sentence of the story that is long enough to weigh something by itself, as sentences go. "
    page = f"""<html><head><title>T</title></head><body><div id="top-menu"><a href=x>Home</a><a href=y>More</a></div>
      <div>{long * 2}</div><div>Short &lt;b&gt; line.</div><div>{long}</div>
      <div class="cookie-notice">{long * 3}</div><form>{long}<input></form><aside>{long}</aside>
      <ul class=comments><li>{long * 3}</ul><script>var a = "<p>{long}</p>";</script><footer>{long}</footer></body></html>"""
    assert extract.main_text(page).split("\n") == [(long * 2).strip(), "Short <b> line.", long.strip()]
    article = "<main><h1>T</h1>x<div class=ad>buy</div><p>y<section id=comments><article>hi</article></section><p>la&amp;st</main>tail"
    assert extract.main_text(article) == "T\nx\ny\nla&st"
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>a < b</p>" * 3000), (3, "u", "<"), (4, "u", "<!-- open")]
    got = extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.n_chars) for r in got) == [(1, 0), (2, 0), (3, 1), (3, 17999), (4, 0)]


def test_extraction_judges_text_outside_articles():
    long = "A sentence of the story that is long enough to weigh something by itself, as sentences go. "
    story = [f"{k} {long * 3}".strip() for k in range(4)]
    cards = "".join(f"<article class=card><h3>Teaser {k}</h3></article>" for k in range(2))
    page = f"<body><nav>Menu</nav>{''.join(f'<div>{x}</div>' for x in story)}<div class=ad>Buy</div>{cards}<div>Page 1</div></body>"
    assert extract.main_text(page).split("\n") == [*story, "Teaser 0", "Teaser 1"]


STORY = [f"Paragraph {k} of the story says something in a sentence or two, as such paragraphs do; it goes on a while." for k in range(6)]


def test_windows_find_the_text_without_article_tags():
    link = "<li><a href=x>Another page of ours</a></li>"
    before = "<div>Site</div><div>Tuesday</div><div>en</div><div>de</div><div>fr</div><div>es</div>"
    body = f"<h2>Title</h2><p>{STORY[0]}</p><p>Short.</p><div class=ad>Buy now</div><p>{STORY[1]}</p><p>{STORY[2]}</p><p>The end.</p>"
    after = f"<ul>{link * 8}</ul><div>Imprint</div><div>Contact</div>"
    page = f"<body>{before}<div>{body}</div>{after}</body>"
    text = extract.main_text(page).split("\n")
    story = ["Title", STORY[0], "Short.", STORY[1], STORY[2], "The end."]
    assert [x for x in text if x in story] == story and len(text) <= len(story) + 2
    # the windows decide: without them the lines around would stay
    found = extract.lines(page)
    assert len([x for x in found if not x.gone]) > len(text) + 10
    # a sum over one line only would drop the title, over none everything
    assert "Title" not in extract.between(found, window=1)
    # an unmarked list of links between two parts is a dive, one line of them is not
    page = f"<div>{STORY[0]}</div><div>{STORY[1]}</div>{{}}<div>{STORY[2]}</div>"
    assert extract.main_text(page.format(f"<ul>{link * 4}</ul>")).split("\n") == STORY[:3]
    assert len(extract.main_text(page.format(f"<p>{link}</p>")).split("\n")) == 4


def test_no_block_of_an_article_is_lost_by_its_name():
    parts = [f"<div class='{c}'>{t}</div>" for c, t in zip(("social-history", "search", "comment-policy", "related work", "notice", "x"), STORY)]
    for open_, close in (("<article>", "</article>"), ("<main>", "</main>"), ("<div class='ad-free'>", "</div>"), ("<div class=sidebar>", "</div>")):
        page = f"<body><nav>Menu</nav>{open_}<h1>T</h1>{''.join(parts)}<div class='x ads'>Buy</div><p>Bye.</p>{close}<footer>F</footer></body>"
        assert extract.main_text(page).split("\n") == ["T", *STORY, "Bye."], open_
    page = f"<article><h1>T</h1><p>a</p><p>{STORY[0]}</p><button>Go</button><p>b <span class=ad>Buy</span> c</p></article><div role=search>Find</div>"
    assert extract.main_text(page).split("\n") == ["T", "a", STORY[0], "b", "c"]
    # more text of readers than of the article
    page = f"<article><h1>T</h1><p>{STORY[0]}</p></article><section id=comments>{''.join(f'<p>{x}</p>' for x in STORY * 3)}</section>"
    assert extract.main_text(page).split("\n") == ["T", STORY[0]]


def test_between_is_brute_force():
    rng = random.Random(6)
    for _ in range(400):
        found, section, at = [], 0, 0
        for k in range(rng.randrange(1, 30)):
            if rng.random() < 0.15:
                at, section = (at + 1, at + 1) if section == 0 and rng.random() < 0.6 else (at, 0)
            size = rng.choice([0, 5, 20, 40, 100, 300])
            found.append(extract.Line(f"{k}", size, section, False, rng.random() < 0.1))
        seen = [x for x in found if not x.gone]
        runs = []
        for k, x in enumerate(seen):
            if k and seen[k - 1].section == x.section:
                runs[-1].append(x)
            else:
                runs.append([x])
        sums = [[sum(x.weight for x in run[i : i + 3]) for i in range(len(run))] for run in runs]
        articles = [t for run, total in zip(runs, sums) for t in total if run[0].section]
        peak = max(articles, default=0)
        expected = []
        for run, total in zip(runs, sums):
            limit = min(86, peak / 2) if run[0].section else 86 if peak else min(86, max(t for s in sums for t in s) / 2)
            high = [i for i, t in enumerate(total) if t > 0 and t >= limit]
            if high and run[0].section:
                expected += [x.text for x in run]
            elif high:
                near = range(high[0], min(len(run), high[-1] + 3))
                heavy = [i for i in near if run[i].weight]
                for i in range(heavy[0], heavy[-1] + 1):
                    alone = run[i - 1].weight and run[i + 1].weight if heavy[0] < i < heavy[-1] else True
                    if run[i].weight or alone:
                        expected.append(run[i].text)
        assert extract.between(found) == expected


def test_op8_query(spark, tmp_path):
    page = f"<body><nav>M</nav><h1>T</h1><p>{STORY[0]}</p>&eacute;</body>"
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (2, None, None, "x"), (None, "", "", "x"), (3, "v", f"<p>{'y z ' * 200_000}</p>", "x")]
    schema = "page_id long, url string, html string, text string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/pages.parquet")
    text = f"T\n{STORY[0]}\né"
    got = sorted((str(r.page_id), r.url, r.text, r.n_chars) for r in extract.op8_extract(spark, str(tmp_path)).collect())
    long = ("y z " * 200_000).strip()
    assert got == sorted([("1", "u", text, len(text))] * 2 + [("2", None, "", 0), ("None", "", "", 0), ("3", "v", long, len(long))], key=str)
    assert extract.extracted(spark.createDataFrame([], schema)).count() == 0


def test_extraction_goes_on_after_raw_elements_without_an_end():
    for tag in ("<svg/>", '<svg class="i" />', "<svg width=9 hidden/>", "<math />", "<canvas>", "<object data=/x/>", "<template>"):
        page = f"<main><p>one</p>{tag}<p>two</p><svg><text>no</text></svg><p>three</p></main>"
        assert extract.main_text(page) == "one\ntwo\nthree", tag
    assert extract.main_text("<main><p>one</p><object data=/x/>no</object><p>two</p><script src=a/>no<p>no</p></main>") == "one\ntwo"


# 9 URLs


def brute_rule(url, rules):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host = re.sub("[A-Z]", lambda m: m[0].lower(), rest[:cut])
    path = re.split("[?#]", rest[cut:])[0]
    best = None
    for rule, _ in rules:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and len(rule) > len(best or ""):
            best = rule
    return host, path, best


def test_url_rules(spark):
    cases = [None, "", "no scheme", "http://", "HTTP://A.Org/x", "http://a.org", "http://example.org/es/1", "http://x.example.org/en/12?a",
             "http://badexample.org/en/1", "http://b.com/fr/x", "http://b.com/de/#x", "a://b://c.com/fr/", "http://İ.com/de/"]
    rows = list(enumerate(cases))
    got = urls.filtered(spark.createDataFrame(rows, "page_id long, url string"), urls.RULES, urls.train(urls.url_table())).collect()
    actions = dict(urls.RULES)
    for r in got:
        host, path, rule = brute_rule(cases[r.page_id], urls.RULES)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        if rule:
            assert r.verdict == actions[rule]
        if not host:
            assert r.verdict == "allow"


def url_parts(url):
    host, _, path = url.split("://")[1].partition("/")
    return host, "/" + path


def test_url_model_on_hosts_never_seen():
    table = urls.url_table()
    site = lambda url: ".".join(url_parts(url)[0].split(".")[-2:])
    sites = sorted({site(u) for u, _ in table})
    random.Random(1).shuffle(sites)
    fold = {x: i % 10 for i, x in enumerate(sites)}
    right = collections.Counter()
    for k in range(10):
        weights = urls.train([r for r in table if fold[site(r[0])] != k])
        for url, label in table:
            if fold[site(url)] == k:
                right[label] += (urls.score(weights, *([x] for x in url_parts(url)))[0] > 0) == bool(label)
    assert sum(right.values()) >= 0.9 * len(table)
    assert right[0] >= 0.95 * len(urls.ALLOWED) and right[1] >= 0.8 * len(urls.BLOCKED)
    assert np.array_equal(weights, urls.train([r for r in table if fold[site(r[0])] != 9]))


def test_ordinary_hosts_are_allowed():
    ordinary = """https://github.com/ https://en.wikipedia.org/wiki/Cat https://docs.python.org/3/ https://www.nytimes.com/section/world
        https://www.zeit.de/kultur https://www.winnipeg.ca/ https://www.windows.com/ http://a.b/c https://www.ft.com/markets
        https://www.lego.com/en-us https://www.cern.ch/about https://www.harvard.edu/ https://www.bahn.de/reise https://www.sncf.com/fr
        https://www.rae.es/diccionario https://www.apple.com/support https://www.cnn.com/travel https://news.ycombinator.com/item
        https://www.ucl.ac.uk/study https://www.louvre.fr/en https://www.nps.gov/yell https://www.duolingo.com/learn""".split()
    table = urls.url_table()
    seen = {url_parts(u)[0] for u, _ in table}
    assert not seen & {url_parts(u)[0] for u in ordinary}
    scores = urls.score(urls.train(table), *map(list, zip(*map(url_parts, ordinary))))
    assert all(scores < 0), [u for u, x in zip(ordinary, scores) if x >= 0]


def test_op9_query(spark, tmp_path):
    long = "https://www.spiegel.de/" + "kultur/" * 100_000
    rows = [(1, "http://www.pokercasino.com/casino/poker", "a", "b"), (1, "http://www.pokercasino.com/casino/poker", "a", "b"), (2, long, "a", "b"),
            (3, "http://casino.example.org/x", "a", "b"), (None, None, "a", "b"), (4, "http://casino.com/de/1", "a", "b"), (5, "http:///casino", "a", "b")]
    schema = "page_id long, url string, host string, verdict string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/pages.parquet")
    got = collections.Counter((r.page_id, r.rule, r.verdict) for r in urls.op9_urls(spark, str(tmp_path)).collect())
    assert got == {(1, None, "block"): 2, (2, None, "allow"): 1, (3, "org/", "allow"): 1, (None, None, "allow"): 1, (4, "com/de/", "block"): 1, (5, None, "allow"): 1}
    weights = urls.train(urls.url_table())
    assert urls.filtered(spark.createDataFrame([], schema), urls.RULES, weights).count() == 0


# 10 quality


def brute_quality(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    counts = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)}
    failed = len(ws) < 10 or 100 * len(covered) > 20 * len(ws)
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)


def test_quality_counts(spark, docs):
    rng = random.Random(4)
    extra = [words_of(rng, n, v) for n, v in ((40, 2), (60, 6), (300, 12), (5, 2), (6, 1), (4, 1))]
    extra += ["same line\n" * 9, "a\n\x0b\n a\na", "# x | y | z\n" * 4, ("word " * 5 + "\n") * 2000]
    rows = [(i, t) for i, t in enumerate([*HARD, *extra])]
    data = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_words string")
    got = {r.doc_id: r for r in quality.with_quality(data).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(t), t
        assert not (r.kept and r.base_failed)
    assert quality.with_quality(docs.limit(0)).count() == 0
    assert quality.quality_stage(spark, docs, "").columns == docs.columns


def test_quality_lines(spark):
    good = "\n".join(" ".join(f"word{i}x{k}" for k in range(12)) + "." for i in range(6))
    cases = {
        "clean": good,
        "licence": good + "\nLicensed under the Apache License, Version 2.0.",
        "symbols": "\n".join(" ".join(f"word{i}{k}###" for i in range(12)) for k in range(5)),
        "shout": "\n".join(" ".join(f"WORD{i}{k}!!" for i in range(12)) for k in range(5)),
        "menu": "\n".join(f"Home{k} | About{k} | Contact{k} | Blog{k} | More{k} |" for k in range(5)),
    }
    data = spark.createDataFrame(list(cases.items()), "doc_id string, text string")
    got = {r.doc_id: r for r in quality.with_quality(data, clean=True).collect()}
    assert {k for k, r in got.items() if r.kept} == {"clean", "licence"}
    assert got["licence"].clean_text == good


def test_quality_rejects_mostly_boilerplate(spark):
    short = "Wind over the harbour, and a light."
    licence = "This work is licensed under the GNU General Public License, version 3."
    prose = " ".join(f"word{k}" for k in range(20))
    cases = {
        "notices": "\n".join(f"Subscribe to list {k} now, see the cookie policy of site {k}." for k in range(40)) + "\nword",
        "rights": "\n".join(f"Part {k} is licensed under terms {k} of the house." for k in range(40)) + "\nword",
        "one word": "Licensed under terms that are long and go on until there are thirty words or nearly so\na",
        "German": f"Datenschutzerklärung der Seite\nNutzungsbedingungen {prose}\nDiese Seite VERWENDET Cookies, {prose}\n{prose[:60]}",
        "below": f"{short}\n{licence}",
        "above": f"{licence}\n{short}",
        "Spanish": f"{prose}\nTodos los derechos reservados.",
    }
    data = spark.createDataFrame(list(cases.items()), "doc_id string, text string")
    kept = {"below", "above", "Spanish"}
    assert {r.doc_id for r in quality.with_quality(data).where("kept").collect()} == kept
    got = {r.doc_id: r.text for r in quality.quality_stage(spark, data, "").collect()}
    assert got == {"below": short, "above": short, "Spanish": prose}


def test_quality_stems_cover_the_phrases():
    assert all(any(s in p for s in quality.STEMS) for p in [*quality.PHRASES, *quality.RIGHTS])


def brute_lines(text):
    """(cleaned text, word characters that stay, those of the spared line)"""
    stay, excused, kept, lines = [], 0, 0, (text or "").split("\n")
    for line in lines:
        ws = re.findall(r"[^\x20\x09-\x0D]+", line)
        c, low = sum(map(len, ws)), line.lower()
        separators = sum(w in ("|", "›", "»", "•", "·", "/", ">") for w in ws)
        fails = 10 * len(re.findall(r"[#*$%&|<>!?]", line)) > 3 * len(ws) or separators >= 2 and 4 * separators >= len(ws)
        notice = len(ws) <= 30 and any(p in low for p in quality.PHRASES + quality.RIGHTS)
        if ws and not fails and notice and any(p in low for p in quality.RIGHTS):
            excused = max(excused, c)
        if not ws or not fails and not notice:
            stay.append(line)
            kept += c
    return "\n".join(stay) if len(stay) < len(lines) else text or "", kept, excused


def test_quality_stage_is_brute_force_and_keeps_clashing_columns(spark, docs):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = ["a | b | c | d\n" + "x y z w v " * 4, "# ! ?\n\n" + " ".join(f"q{k}" for k in range(30)), "word " * 30, "x\ty\x0bz " * 9 + "\nall rights RESERVED"]
    rows = [(r.doc_id, r.text, "a", "b", 0) for r in real.collect()] + [(10_000 + k, t, "a", "b", 0) for k, t in enumerate([*HARD, *odd])]
    data = spark.createDataFrame(rows, DOCS).withColumns(
        {c: F.lit(c) for c in ("_w", "_l", "n_words", "kept", "base_failed", "t", "w", "marked", "result_kept")}
    )
    got = quality.quality_stage(spark, data, "")
    assert got.columns == data.columns and dict(got.dtypes) == dict(data.dtypes)
    found = {r.doc_id: r for r in got.collect()}
    expected = {}
    for doc_id, text, *_ in rows:
        clean, kept, excused = brute_lines(text)
        chars = brute_quality(text)[1]
        left = kept + (excused if 100 * excused <= 90 * chars else 0)
        if not brute_quality(text)[-1] and kept and 100 * left >= 50 * chars:
            expected[doc_id] = clean
    assert {d: r.text for d, r in found.items()} == expected
    assert all(r.n_chars == len(r.text) and r.kept == "kept" and r._w == "_w" for r in found.values())
    assert quality.quality_stage(spark, docs.limit(0), "").count() == 0


def test_quality_agrees_with_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(
        spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id"
    )
    judged = quality.with_quality(docs).groupBy("quality", "base_failed", "kept").count().collect()
    count = {(r.quality, r.base_failed, r.kept): r["count"] for r in judged}
    assert count.get((1, False, False), 0) == 0
    rejected = sum(n for (q, _, kept), n in count.items() if q == 0 and not kept)
    assert rejected >= 0.9 * sum(n for (q, _, _), n in count.items() if q == 0)


# shared folder


def test_scratch_is_cleaned_and_a_cluster_needs_a_folder(spark, monkeypatch):
    import types

    path = common.scratch(spark, "x").removeprefix("file:")
    spark.range(3).write.parquet(path)
    assert os.path.exists(path)
    common.delete(spark, "file:" + path)
    assert not os.path.exists(path)
    conf = types.SimpleNamespace(get=lambda key: None)
    context = types.SimpleNamespace(master="spark://host:7077", applicationId="a", getConf=lambda: conf, getCheckpointDir=lambda: None)
    with pytest.raises(ValueError):
        common.shared_dir(types.SimpleNamespace(sparkContext=context))


def test_pipeline_handles_odd_tables(spark, tmp_path):
    import corpus_pipeline

    benchmark = "item_id long, text string"
    spark.createDataFrame([(1, " ".join(f"b{k}" for k in range(20)))], benchmark).write.parquet(f"{tmp_path}/benchmark.parquet")
    good = " ".join(f"word{k}" for k in range(40))
    rows = [(1, good), (1, good), (2, good + " end"), (3, None), (4, ""), (None, " ".join(f"other{k}" for k in range(30))), (5, " ".join(f"b{k}" for k in range(20)))]
    schema = "doc_id long, text string, kept string, start string, _w string, h1 string, n_chars long"
    spark.createDataFrame([(*r, "a", "b", "c", "d", 1) for r in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id for r in got), key=str) == [1, None]
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/empty/documents.parquet")
    spark.createDataFrame([], benchmark).write.parquet(f"{tmp_path}/empty/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


# pipeline


def test_pipeline_is_brute_force(spark, library):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    good = {}
    for d, t in docs.items():
        clean, kept_chars, excused = brute_lines(t)
        chars = brute_quality(t)[1]
        left = kept_chars + (excused if 100 * excused <= 90 * chars else 0)
        if not brute_quality(t)[-1] and kept_chars and 100 * left >= 50 * chars:
            good[d] = clean
    rows = sorted(good.items())
    docs = good | {d: t for d, t in docs.items() if d not in good}
    rows = [(d, docs[d]) for d, _, c in brute_components(rows) if d == c]
    items = [brute_words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + min(13, len(w))]) for w in items for i in range(max(1, len(w) - 12)) if w}
    kept = {}
    for d, t in rows:
        ws = brute_words(t)
        hit = {i + k for n in {len(w) for w in windows} for i in range(len(ws) - n + 1) if tuple(ws[i : i + n]) in windows for k in range(n)}
        if not (hit and 20 * len(hit) >= len(ws)):
            kept[d] = t
    assert 0 < len(kept) < len(rows) < len(good) < len(docs)
    assert check_packing(corpus_pipeline.run(spark, sf).collect(), kept, library) > 0.97
