"""Line-first quality rules, in DataFrame functions only.

Each line is judged by three rules; lines that fail are removed; a document that loses too much text is rejected.

* punctuation: marks ``# * $ % & | < > ! ?`` for more than 3 in 10 of the line's words;
* navigation: two or more separators (``| › » • · / >`` standing alone) for at least 1 in 4 words;
* boilerplate: a fixed phrase (cookie notices, rights, subscriptions, scripts; English, German, French, Spanish) in a line
  of 30 words or fewer.

A document is rejected where no line stays, or where the lines that stay hold less than ``least_kept`` percent of its word
characters. One rights line (a licence or a copyright) is removed like any notice but is not held against the text: the
longest one, where it has at most ``spared`` percent of the word characters. The base rules come before: fewer than
``least_words`` words, or more than ``most_repeated`` percent of the words in repeated windows.

The pipeline's stage passes the cleaned text on: the lines that stay, or the text as it was where no line fails.

Nulls and empty texts have no words, all counts 0, and are rejected. Rows are judged one by one, so ties and repeated
rows get equal results; an empty table gives an empty result. Of columns named like a result, ``with_quality`` replaces
those of the caller; ``quality_stage`` keeps them and changes nothing but ``text`` and, where there is one, ``n_chars``.
Lines that hold no mark, separator or phrase cannot fail, so only the others are looked at one by one. Work is linear in a
text's length, but for the sort of the windows of a text that repeats one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\f\r"
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MARKS = r"[#*$%&|<>!?]"
SEPARATORS = "[|›»•·/>]"
SUSPECT = "[#*$%&|<>!?›»•·/]"
SEPARATOR = r"(?:^|[\x20\x09-\x0D])[|›»•·/>](?=$|[\x20\x09-\x0D])"
#: Phrases of notices and controls that belong to a site, not to a text, in lower case.
PHRASES = [
    "cookie policy", "use of cookies", "uses cookies", "accept cookies", "privacy policy", "terms of use", "terms of service",
    "sign in now", "sign in here", "sign up now", "sign up here", "subscribe to", "newsletter", "click here",
    "enable javascript", "lorem ipsum",
    "datenschutzerklärung", "verwendet cookies", "cookies akzeptieren", "nutzungsbedingungen", "hier klicken", "jetzt anmelden",
    "javascript aktivieren",
    "politique de confidentialité", "utilise des cookies", "accepter les cookies", "conditions d'utilisation", "cliquez ici",
    "abonnez-vous", "activer javascript",
    "política de privacidad", "utiliza cookies", "aceptar cookies", "condiciones de uso", "haga clic aquí", "suscríbete",
    "activar javascript",
]
#: The notices that also stand with clean texts.
RIGHTS = [
    "all rights reserved", "licensed under", "alle rechte vorbehalten", "lizenziert unter", "tous droits réservés",
    "sous licence", "todos los derechos reservados", "bajo licencia",
]
#: Each phrase holds one of these; a text without any needs no look at its phrases.
STEMS = [
    "cookie", "licen", "lizen", "javascript", "reserv", "vorbehalten", "privacy", "terms of", "sign ", "subscribe to", "newsletter",
    "click here", "lorem", "datenschutz", "nutzungsb", "klicken", "anmelden", "confidential", "utilisation", "cliquez", "abonnez",
    "privacidad", "condiciones", "haga clic", "suscr", "réserv",
]
NOTICE_WORDS = 30
WINDOW = 5
#: What becomes of a line.
STAYS, FAILS, NOTICE, RIGHTS_LINE = range(4)


def _any(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | text.contains(part)
    return out


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def free(docs: DataFrame, *names: str) -> list[str]:
    """Names that no column of the table has."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def flat(text: Column) -> Column:
    """The text with every white space character as a space, trimmed."""
    return F.btrim(F.regexp_replace(text, r"[\x09-\x0D]", " "), F.lit(" "))


def words(text: Column) -> Column:
    """Words of a flat text; a split at single spaces needs no pattern."""
    split = F.when(text.contains("  "), F.split(text, " +", -1)).otherwise(F.split(text, " ", -1))
    return F.when(F.length(text) > 0, split).otherwise(F.array().cast("array<string>"))


def windows(h: Column) -> Column:
    """Hashes of the windows of five, from the words' hashes."""
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])
    )
    return F.when(F.size(h) > WINDOW, hashes).otherwise(F.array().cast("array<bigint>"))


def covered(window: Column) -> Column:
    """Words inside a window that occurs twice or more."""

    def let(value: Column, body: Callable[[Column], Column]) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def twice(s: Column) -> Column:
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        return F.transform(F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1))), lambda x: x["i"])

    def total(starts: Column) -> Column:
        each = F.transform(starts, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(each, F.lit(0), lambda a, x: a + x)

    ordered = F.sort_array(F.transform(window, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return let(ordered, lambda s: let(F.sort_array(twice(s)), total))


def line_code(line: Column, marked: Column, noticed: Column) -> Column:
    """STAYS, FAILS (punctuation or navigation), NOTICE or RIGHTS_LINE; ``marked`` and ``noticed``: whether the text has
    any mark or separator, and any stem of a phrase."""
    trimmed, low = flat(line), F.lower(line)
    n = F.size(words(trimmed))
    separators = _count(line, SEPARATOR)
    fails = (_count(line, MARKS) * 10 > n * 3) | (line.rlike(SEPARATORS) & (separators >= 2) & (separators * 4 >= n))
    return (
        F.when(F.length(trimmed) == 0, F.lit(STAYS))
        .when(marked & line.rlike(SUSPECT) & fails, F.lit(FAILS))
        .when(~noticed, F.lit(STAYS))
        .when(_any(low, RIGHTS) & (n <= NOTICE_WORDS), F.lit(RIGHTS_LINE))
        .when(_any(low, PHRASES) & (n <= NOTICE_WORDS), F.lit(NOTICE))
        .otherwise(F.lit(STAYS))
    )


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "kept_chars", "base_failed", "kept", "clean_text"]


def _judged(
    docs: DataFrame, names: list[str], least_words: int, most_repeated: int, least_kept: int, spared: int
) -> DataFrame:
    """The table with the results (COUNTS) under ``names``."""
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat, kept_chars, base_failed, kept, clean = names
    t, f, low, w, g, marked, noticed, judged = free(docs, "t", "f", "low", "w", "g", "marked", "noticed", "judged")
    out = docs.withColumns({t: F.coalesce(F.col("text"), F.lit(""))})
    c = F.col
    out = out.withColumns({f: flat(c(t)), low: F.lower(t), n_symbols: _count(c(t), SYMBOLS).cast("long")})
    # no project may be merged into the next: each value is used more than once there
    out = out.withColumns({w: words(c(f))})
    lines = F.split(c(t), "\n", -1)
    out = out.withColumns(
        {
            n_words: F.size(w).cast("long"),
            # words with one space between them need no count of the spaces
            word_chars: F.when(c(f).contains("  "), F.length(F.replace(c(f), F.lit(" "), F.lit(""))))
            .otherwise(F.length(f) - F.greatest(F.size(w) - 1, F.lit(0)))
            .cast("long"),
            w: F.transform(w, lambda x: F.xxhash64(x)),
            g: F.filter(lines, lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0),
            marked: c(t).rlike(SUSPECT),
            noticed: _any(c(low), STEMS),
        }
    )
    out = out.withColumns({w: windows(c(w)), n_dup_lines: (F.size(g) - F.size(F.array_distinct(g))).cast("long")})
    line = lambda x: F.struct(
        x.alias("x"), line_code(x, c(marked), c(noticed)).alias("k"), F.length(F.regexp_replace(x, GAP, "")).cast("long").alias("c")
    )
    out = out.withColumns(
        {
            n_repeat: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(c(w))).cast("long"),
            judged: F.when(c(marked) | c(noticed), F.transform(lines, line)),
        }
    )
    zero = F.lit(0).cast("long")
    removed = F.aggregate(judged, zero, lambda a, x: a + F.when(x["k"] == STAYS, zero).otherwise(x["c"]))
    excused = F.aggregate(judged, zero, lambda a, x: F.greatest(a, F.when(x["k"] == RIGHTS_LINE, x["c"]).otherwise(zero)))
    good = F.transform(F.filter(judged, lambda x: x["k"] == STAYS), lambda x: x["x"])
    out = out.withColumns(
        {
            kept_chars: c(word_chars) - F.coalesce(removed, zero),
            marked: F.coalesce(excused, zero),
            clean: F.when(F.size(good) == F.size(judged), c(t)).otherwise(F.coalesce(F.array_join(good, "\n"), c(t))),
        }
    )
    excuse = F.when(100 * c(marked) <= spared * c(word_chars), c(marked)).otherwise(zero)
    enough = (c(kept_chars) > 0) & (100 * (c(kept_chars) + excuse) >= least_kept * c(word_chars))
    bad = (c(n_words) < least_words) | (100 * c(n_repeat) > most_repeated * c(n_words))
    # always true, but not deterministic: a filter on ``kept`` is not pushed down, which would compute all of this twice
    last = F.monotonically_increasing_id() >= 0
    return out.withColumns({base_failed: bad, kept: ~bad & enough & last}).drop(t, f, low, w, g, marked, noticed, judged)


def with_quality(
    docs: DataFrame, least_words: int = 10, most_repeated: int = 20, least_kept: int = 50, spared: int = 90, clean: bool = False
) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, kept_chars, base_failed and kept, and with
    ``clean`` clean_text; ``most_repeated``, ``least_kept`` and ``spared`` are percentages."""
    names = [f"result_{name}" for name in COUNTS]
    names = free(docs, *names)
    judged = _judged(docs, names, least_words, most_repeated, least_kept, spared)
    wanted = dict(zip(COUNTS if clean else COUNTS[:-1], names, strict=False))
    rest = [c for c in docs.columns if c.lower() not in wanted]
    return judged.select(*rest, *(F.col(x).alias(name) for name, x in wanted.items()))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_quality(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass, with their own columns and the text without the lines that fail."""
    names = free(docs, *(f"result_{name}" for name in COUNTS))
    judged = _judged(docs, names, 10, 20, 50, 90).where(F.col(names[-2]))
    text = F.col(names[-1])
    kinds = dict(docs.dtypes)
    changed = {"text": F.when(F.col("text").isNotNull(), text)}
    if "n_chars" in kinds:
        changed["n_chars"] = F.length(text).cast(kinds["n_chars"])
    return judged.select(*(changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns))


OP10_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), win AS (
  SELECT r, i, list_slice(ws, i, i + 4) AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)
), rep AS (
  SELECT r, count(DISTINCT p) AS n FROM (
    SELECT r, unnest(range(i, i + 5)) AS p FROM win
    QUALIFY count(*) OVER (PARTITION BY r, g) > 1) GROUP BY r
), line AS (
  SELECT r, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n,
    length(l) - length(translate(l, '#*$%&|<>!?', '')) AS marks,
    list_filter(regexp_extract_all(l, '[^\x20\x09-\x0D]+'), lambda x: x IN ('|', '›', '»', '•', '·', '/', '>')) AS sep,
    length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g')) AS c, lower(l) AS low
  FROM (SELECT r, unnest(ls) AS l FROM w)
), coded AS (
  SELECT r, c, CASE WHEN marks * 10 > n * 3 OR len(sep) >= 2 AND len(sep) * 4 >= n THEN 1 WHEN n > 30 THEN 0
    WHEN regexp_matches(low, '@RIGHTS@') THEN 3
    WHEN regexp_matches(low, '@PHRASES@') THEN 2
    ELSE 0 END AS k FROM line
), stay AS (
  SELECT r, coalesce(sum(c) FILTER (k = 0), 0) AS c, coalesce(max(c) FILTER (k = 3), 0) AS excused FROM coded GROUP BY r
), base AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(stay.c, 0) AS c, coalesce(excused, 0) AS excused
  FROM w LEFT JOIN rep USING (r) LEFT JOIN stay USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND c > 0
    AND 100 * (c + CASE WHEN 100 * excused <= 90 * word_chars THEN excused ELSE 0 END) >= 50 * word_chars AS kept
FROM base
""".replace("@RIGHTS@", "|".join(RIGHTS).replace("'", "''")).replace("@PHRASES@", "|".join(PHRASES).replace("'", "''"))
