"""Line-first cleaning with DataFrame functions only.

Every line of a whole text is judged on its own by punctuation, navigation, boilerplate and repetition
rules; failing lines are removed; a document that loses too much of its text is rejected. No shuffle, no
Python: one pass of array functions over each row.

Defined cases: a null text counts as empty; empty or blank text has no words and is rejected by the base rule; blank
lines never fail, so a text without failing lines stays as it is; repeated rows are each judged alike; extra columns,
whatever their names, pass through `stage`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import text_of

#: Fixed values of the contract: what separates words, and which characters are symbols.
SPACE = "[\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"
#: Phrases that mark a line of a site's own, not of its article, in lower case.
BOILERPLATE = (
    "all rights reserved", "terms of service", "terms of use", "privacy policy", "cookie policy", "accept cookies",
    "uses cookies", "sign up for", "subscribe to our", "click here", "skip to content", "share this", "log in",
    "back to top", "powered by", "enable javascript", "read more", "next page", "previous page",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "cookies akzeptieren", "verwendet cookies", "weiterlesen", "nach oben",
    "tous droits réservés", "conditions d'utilisation", "politique de confidentialité", "accepter les cookies", "utilise des cookies", "lire la suite", "haut de page",
    "todos los derechos reservados", "términos de uso", "política de privacidad", "aceptar cookies", "utiliza cookies", "leer más", "volver arriba",
)
#: What ends a sentence, a title of one, or a list's head; white space may follow.
END = "[.!?:;\"')\\]}\u201d\u2019\u3002\uff01\uff1f][\\x20\\x09-\\x0D]*$"
#: Without such an end a line fails if it has few words and characters, or some more words that all begin like names.
OPEN_WORDS, OPEN_CHARS, MENU_WORDS = 4, 40, 10
_NAME = "[\\p{Lu}\\p{Nd}\u00ab\u00bb\u2039\u203a\u2190\u2192][^\\x20\\x09-\\x0D]*"
NAMES = f"^[\\x20\\x09-\\x0D]*(?:{_NAME}[\\x20\\x09-\\x0D]+)*{_NAME}[\\x20\\x09-\\x0D]*$"
#: Or if it has at least this share of bare numbers, and PAGES of them: links to pages.
BARE, PAGES, PAGE_SHARE = "(?:^|[\\x20\\x09-\\x0D])[0-9]{1,4}\\b", 3, 0.5
#: A line fails when this share of its words end in symbols, shout, or separate menu entries.
SYMBOL_SHARE, SHOUT_SHARE, MENU_SHARE = 0.5, 0.8, 0.25
#: A line fails when, with at least REPEAT_WORDS words, this share of them or less is distinct.
REPEAT_WORDS, REPEAT_SHARE = 12, 0.25
#: A document is rejected when less than this share of its word characters is left.
KEEP_SHARE = 0.5


def words_in(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def base_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long) and its `_lines`."""
    t = text_of(text)
    df = df.withColumn("_words", words_in(t)).withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    df = df.withColumn("n_words", F.size("_words").cast("long"))
    # A window's hash is 64 bits; two different windows of one text share it less than once in 10**10 texts.
    window = F.when(F.col("n_words") >= 3, F.expr("transform(sequence(0, cast(n_words as int) - 3), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2]))")).otherwise(F.expr("cast(array() as array<bigint>)"))
    df = df.withColumn("_windows", window)
    df = df.withColumn("_sorted", F.expr("if(size(array_distinct(_windows)) < size(_windows), sort_array(transform(_windows, (h, i) -> struct(h, i))), null)"))
    df = df.withColumn(
        "_places",
        F.expr(
            """sort_array(transform(
                filter(_sorted, (x, j) -> (j > 0 and _sorted[greatest(j - 1, 0)].h = x.h)
                                       or (j + 1 < size(_sorted) and _sorted[least(j + 1, size(_sorted) - 1)].h = x.h)),
                x -> x.i))"""
        ),
    )
    # Windows that repeat start at _places: each covers three words, less what the next one covers.
    covered = F.expr(
        """coalesce(aggregate(_places, named_struct('n', 0L, 'end', 0), (a, p) -> named_struct(
            'n', a.n + (p + 3 - greatest(p, a.end)), 'end', p + 3), a -> a.n), 0L)"""
    )
    return df.select(
        *[c for c in df.columns if c not in ("_words", "_windows", "_sorted", "_places", "n_words")],
        "n_words",
        (F.length(t) - _count(t, SPACE)).cast("long").alias("word_chars"),
        _count(t, SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )


def measured(line: Column, boilerplate: bool) -> Column:
    """A line with what the rules look at; boilerplate: whether the text has any of the phrases at all."""
    return F.struct(
        line.alias("line"),
        _count(line, "[^\\x20\\x09-\\x0D]+").alias("n"),
        _count(line, "[#*$%&<>]").alias("symbols"),
        _count(line, "\\|").alias("bars"),
        F.when(line.contains("!") & ~line.rlike("\\p{Ll}"), _count(line, "!")).otherwise(0).alias("shouts"),
        F.size(F.array_distinct(F.split(line, " "))).alias("distinct"),
        (F.lower(line).rlike("|".join(BOILERPLATE)) if boilerplate else F.lit(False)).alias("phrase"),
    )


def line_fails(x: Column) -> Column:
    """True for a measured() line of symbols, shouting, menu entries, boilerplate or one word over and over; blank lines pass."""
    n = x["n"]
    few = (n <= OPEN_WORDS) & (F.length(x["line"]) <= OPEN_CHARS)
    return (n > 0) & (
        (x["symbols"] >= SYMBOL_SHARE * n)
        | (x["bars"] >= MENU_SHARE * n)
        | (x["shouts"] >= SHOUT_SHARE * n)
        | (x["phrase"] & (n <= 30))
        | ((n >= REPEAT_WORDS) & (x["distinct"] <= REPEAT_SHARE * n))
        | ((n <= MENU_WORDS) & ~x["line"].rlike(END) & (few | ((n >= 2) & x["line"].rlike(NAMES))))
        | ((n <= 3 * MENU_WORDS) & ~x["line"].rlike(END) & (_count(x["line"], BARE) >= F.greatest(F.lit(PAGES), PAGE_SHARE * n)))
    )


def judged(df: DataFrame, text: str = "text") -> DataFrame:
    """base_counts() with clean_text, n_lines_removed, kept_chars, base_failed and kept."""
    out = base_counts(df, text)
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    low = F.lower(text_of(text))
    some = F.lit(False)
    for phrase in BOILERPLATE:
        some = some | F.col("_low").contains(phrase)
    out = out.withColumn("_low", low)
    # The test of the whole text stands outside the lambda, or Spark would repeat it for every line.
    out = out.withColumn("_all", F.split(text_of(text), "\n"))
    with_phrases = F.transform("_all", lambda x: measured(x, True))
    without = F.transform("_all", lambda x: measured(x, False))
    out = out.withColumn("_good", F.filter(F.when(some, with_phrases).otherwise(without), lambda x: ~line_fails(x))["line"])
    out = out.withColumn("clean_text", F.array_join("_good", "\n")).withColumn("n_lines_removed", (F.size("_all") - F.size("_good")).cast("long"))
    out = out.withColumn("kept_chars", (F.length("clean_text") - _count(F.col("clean_text"), SPACE)).cast("long"))
    out = out.withColumn("base_failed", base_failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("kept_chars") >= KEEP_SHARE * F.col("word_chars"))).drop("_lines", "_all", "_good", "_low")


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = judged(docs).withColumn("clean_sha256", F.sha2("clean_text", 256))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "kept_chars", "clean_sha256")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep, without their failing lines; n_chars, where there is one, follows the text."""
    rows = judged(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("text")))
    changed = F.col("n_lines_removed") > 0
    now = {"text": F.col("clean_text"), "n_chars": F.length("clean_text")}
    field = lambda c: F.col("_row").getField(c)
    made = [F.when(changed, now[c].cast(docs.schema[c].dataType)).otherwise(field(c)).alias(c) if c in now else field(c).alias(c) for c in docs.columns]
    # A generator in place of a filter: a filter would be moved below the rules and repeat their expressions without end.
    kept = F.when(F.col("kept"), F.array(F.struct(*made)))
    return rows.select(F.explode(kept).alias("_row")).select("_row.*")


_WORD = r"[^\x20\x09-\x0D]+"
_END, _PHRASES = END.replace("'", "''"), "|".join(BOILERPLATE).replace("'", "''")
ORACLE_SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines,
         string_split(coalesce(text, ''), chr(10)) AS all_lines
  FROM documents),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n
      FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g), (VALUES (0), (1), (2)) AS v(k)
      WHERE c > 1 GROUP BY doc_id),
good AS (
  SELECT doc_id, list_filter(all_lines, lambda x: NOT (regexp_matches(x, '{_WORD}') AND (
      len(regexp_extract_all(x, '[#*$%&<>]')) >= {SYMBOL_SHARE} * len(regexp_extract_all(x, '{_WORD}'))
      OR len(regexp_extract_all(x, '\|')) >= {MENU_SHARE} * len(regexp_extract_all(x, '{_WORD}'))
      OR CASE WHEN NOT regexp_matches(x, '\p{{Ll}}') THEN len(regexp_extract_all(x, '!')) ELSE 0 END
         >= {SHOUT_SHARE} * len(regexp_extract_all(x, '{_WORD}'))
      OR (regexp_matches(lower(x), '{_PHRASES}') AND len(regexp_extract_all(x, '{_WORD}')) <= 30)
      OR (len(regexp_extract_all(x, '{_WORD}')) >= {REPEAT_WORDS}
          AND len(list_distinct(string_split(x, ' '))) <= {REPEAT_SHARE} * len(regexp_extract_all(x, '{_WORD}')))
      OR (len(regexp_extract_all(x, '{_WORD}')) <= {MENU_WORDS} AND NOT regexp_matches(x, '{_END}')
          AND ((len(regexp_extract_all(x, '{_WORD}')) <= {OPEN_WORDS} AND length(x) <= {OPEN_CHARS})
               OR (len(regexp_extract_all(x, '{_WORD}')) >= 2 AND regexp_matches(x, '{NAMES}'))))
      OR (len(regexp_extract_all(x, '{_WORD}')) <= {3 * MENU_WORDS} AND NOT regexp_matches(x, '{_END}')
          AND len(regexp_extract_all(x, '{BARE}')) >= greatest({PAGES}, {PAGE_SHARE} * len(regexp_extract_all(x, '{_WORD}'))))))) AS l
  FROM w),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(all_lines) - len(good.l) AS BIGINT) AS n_lines_removed,
         sha256(array_to_string(good.l, chr(10))) AS clean_sha256,
         CAST(length(regexp_replace(array_to_string(good.l, ''), '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS kept_chars
  FROM w JOIN good USING (doc_id) LEFT JOIN r ON r.doc_id = w.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND kept_chars >= {KEEP_SHARE} * word_chars AS kept
FROM m"""
