"""Line-first quality rules, in DataFrame functions only.

Each line that holds a word is judged by three rules; lines that fail are removed, and a document that loses
too much of its text goes.

* punctuation: over 5 % of the line's characters are symbols, or it has over 3 exclamation marks for 10 words;
* navigation: three or more bars or arrows that stand as words, or at most two words without closing punctuation;
* boilerplate: it holds a phrase of notices, consent banners or site furniture, in any of four languages (a parameter).

Words in repeated 3-word windows are sought only in texts where two windows have the same hash (64 bits; equal windows always have),
and told by the words themselves.

Null text counts as no words: zero counts, ``base_failed``. Empty tables give empty results, repeated rows are
judged one by one, columns of the input whose names clash with results are replaced, all others are kept whatever their names. Texts of any
length are judged whole, row by row.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.llm.session import table, without

QUERY = "op1_quality_rules"

PHRASES = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "accept cookies", "accept all cookies",
    "uses cookies", "enable javascript", "javascript is disabled", "lorem ipsum", "subscribe to our newsletter",
    "sign up for our newsletter", "click here to", "share on facebook", "follow us on", "back to top", "skip to content",
    "licensed under the", "spdx-license-identifier",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "verwendet cookies", "cookies akzeptieren", "newsletter abonnieren",
    "javascript aktivieren", "zum seitenanfang", "zum inhalt springen",
    "tous droits réservés", "conditions d'utilisation", "politique de confidentialité", "utilise des cookies", "accepter les cookies", "abonnez-vous à notre newsletter",
    "activer javascript", "haut de page", "aller au contenu",
    "todos los derechos reservados", "condiciones de uso", "política de privacidad", "utiliza cookies", "aceptar las cookies", "suscríbete a nuestro boletín",
    "habilitar javascript", "volver arriba", "saltar al contenido",
)
MAX_LOST_PERCENT = 30
OUTPUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bad_lines", "lost_chars", "base_failed", "kept", "clean_text")
SYMBOLS, SPACES = "#*$%&|<>", r"\t\n\u000b\u000c\r"

_BLANK, _INK = r"[ \\t-\\r]", r"[^ \\t-\\r]"


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _words(text: str) -> str:
    """The words of a text; one without any gives an empty array."""
    bare = f"trim(BOTH ' {SPACES}' FROM {text})"
    return f"CASE WHEN {bare} = '' THEN CAST(array() AS ARRAY<STRING>) ELSE split({bare}, '{_BLANK}+') END"


def _count(text: str, marks: str) -> str:
    """How many of some ASCII characters a text has: the bytes that it loses without them."""
    left = text
    for m in marks:
        left = f"replace({left}, '{m}', '')"
    return f"(octet_length({text}) - octet_length({left}))"


def _triggers(phrases: Sequence[str]) -> list[str]:
    """Words of which every phrase holds one: those that most phrases share first, long before short ones."""
    left, found = set(phrases), []
    while left:
        words = sorted({x for p in left for x in p.split()})
        best = max(words, key=lambda x: (sum(x in p for p in left), len(x)) if len(x) > 5 else (0, len(x)))
        found.append(best)
        left = {p for p in left if best not in p}
    return found


def _line(x: str) -> str:
    """Struct of a line's text, length, symbols and verdict but for phrases; each costly test comes after one that most lines settle."""
    three = f"{x} RLIKE '^{_BLANK}*{_INK}+{_BLANK}+{_INK}+{_BLANK}+{_INK}'"
    bangs = f"(contains({x}, '!') AND 10 * {_count(x, '!')} > 3 * regexp_count({x}, '{_INK}+'))"
    marked = " OR ".join(f"contains({x}, '{m}')" for m in "|>»→")
    marks = f"(({marked}) AND size(filter(split({x}, '{_BLANK}+'), y -> y IN ('|', '>', '>>', '»', '→'))) >= 3)"
    return (
        f"named_struct('t', {x}, 'c', char_length({x}), 'symbols', {_count(x, SYMBOLS)}, 'bad', 20 * {_count(x, SYMBOLS)} > char_length({x}) OR {bangs} OR {marks}"
        f" OR (NOT {three} AND NOT {x} RLIKE '[.!?:;][\"\\')\\\\]]*{_BLANK}*$'))"
    )


def quality_rules(docs: DataFrame, text: str = "text", max_lost_percent: int = MAX_LOST_PERCENT, phrases: Sequence[str] = PHRASES) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``kept`` and ``clean_text`` (lines that passed); ``phrases`` are lower-case."""
    own = "__"
    while any(c.startswith(own) for c in docs.columns):
        own += "_"
    t, w, hashes, repeated, suspect, lines, judged, dup, every = (own + x for x in ("t", "w", "hashes", "repeated", "suspect", "lines", "judged", "dup", "every"))
    d = docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    d = without(d, *OUTPUT)
    has_trigger = " OR ".join(f"contains({suspect}, {_quoted(p)})" for p in _triggers(phrases)) or "false"
    phrase = _quoted("|".join(map(re.escape, phrases)) or "$.")
    d = d.withColumns({
        w: F.expr(_words(t)),
        lines: F.expr(f"filter(split({t}, '\\n'), l -> l RLIKE '{_INK}')"),
        suspect: F.expr(f"lower({t})"),
    })
    d = d.withColumns({
        suspect: F.expr(has_trigger),
        hashes: F.expr(f"CASE WHEN size({w}) >= 3 THEN transform(sequence(0, size({w}) - 3), i -> xxhash64({w}[i], {w}[i + 1], {w}[i + 2])) END"),
    })
    d = d.withColumns({
        repeated: F.expr(f"size(array_distinct({hashes})) < size({hashes})"),
        judged: F.expr(f"transform({lines}, l -> {_line('l')})"),
    })
    d = d.withColumn(judged, F.expr(f"CASE WHEN {suspect} THEN transform({judged}, j -> named_struct('t', j.t, 'c', j.c, 'symbols', j.symbols, 'bad', j.bad OR lower(j.t) RLIKE {phrase})) ELSE {judged} END"))
    d = d.withColumn(dup, F.expr(f"CASE WHEN {repeated} THEN sort_array(transform({hashes}, (h, i) -> named_struct('h', h, 'a', {w}[i], 'b', {w}[i + 1], 'c', {w}[i + 2], 'i', i))) END"))

    def same(k: str) -> str:
        return " AND ".join(f"x.{f} = {dup}[{k}].{f}" for f in "habc")

    d = d.withColumn(dup, F.expr(f"filter({dup}, (x, k) -> (k > 0 AND {same('k - 1')}) OR (k < size({dup}) - 1 AND {same('k + 1')}))"))
    d = d.withColumns({
        "n_words": F.expr(f"CAST(size({w}) AS BIGINT)"),
        "word_chars": F.expr(f"CAST(char_length(array_join({w}, '')) AS BIGINT)"),
        "n_symbols": F.expr(f"aggregate({judged}, 0L, (a, j) -> a + j.symbols)"),
        "n_dup_lines": F.expr(f"CAST(size({lines}) - size(array_distinct({lines})) AS BIGINT)"),
        "n_repeat_words": F.expr(f"coalesce(CAST(size(array_distinct(flatten(transform({dup}, x -> array(x.i, x.i + 1, x.i + 2))))) AS BIGINT), 0L)"),
        "n_lines": F.expr(f"CAST(size({lines}) AS BIGINT)"),
        "n_bad_lines": F.expr(f"CAST(size(filter({judged}, j -> j.bad)) AS BIGINT)"),
        "lost_chars": F.expr(f"aggregate({judged}, 0L, (a, j) -> a + CASE WHEN j.bad THEN j.c ELSE 0 END)"),
        every: F.expr(f"aggregate({judged}, 0L, (a, j) -> a + j.c)"),
        "clean_text": F.expr(f"array_join(transform(filter({judged}, j -> NOT j.bad), j -> j.t), '\\n')"),
    })
    d = d.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))
    d = d.withColumn("kept", F.expr(f"NOT base_failed AND 100 * lost_chars <= {int(max_lost_percent)} * {every}"))
    return d.drop(t, w, hashes, repeated, suspect, lines, judged, dup, every)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *[c for c in OUTPUT if c != "clean_text"])


_W = r"'[^\x20\x09-\x0D]+'"
ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), {_W}) AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, {_W})) AS ls
  FROM documents),
tri AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM tri) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY rid),
ln AS (SELECT rid, unnest(ls) AS l FROM d),
judged AS (
  SELECT rid, length(l) AS c,
    20 * len(regexp_extract_all(l, '[#*$%&|<>]')) > length(l)
    OR 10 * len(regexp_extract_all(l, '!')) > 3 * len(regexp_extract_all(l, {_W}))
    OR len(list_filter(regexp_extract_all(l, {_W}), lambda y: y IN ('|', '>', '>>', '»', '→'))) >= 3
    OR (len(regexp_extract_all(l, {_W})) <= 2 AND NOT regexp_matches(l, '[.!?:;]["'')\]]*[ \t-\r]*$'))
    OR regexp_matches(lower(l), '{"|".join(PHRASES).replace("'", "''")}') AS bad
  FROM ln),
agg AS (SELECT rid, count_if(bad) AS n_bad, coalesce(sum(c) FILTER (bad), 0) AS lost, sum(c) AS every FROM judged GROUP BY rid),
base AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    len(ls)::BIGINT AS n_lines, coalesce(n_bad, 0)::BIGINT AS n_bad_lines, coalesce(lost, 0)::BIGINT AS lost_chars,
    coalesce(every, 0) AS every
  FROM d LEFT JOIN rep USING (rid) LEFT JOIN agg USING (rid)),
failed AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_bad_lines, lost_chars, base_failed,
  (NOT base_failed AND 100 * lost_chars <= {MAX_LOST_PERCENT} * every) AS kept
FROM failed
"""
