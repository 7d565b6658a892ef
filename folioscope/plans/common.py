"""SQL that the oracles share: the revision lines, and the cleaning of lines."""

from __future__ import annotations

import unicodedata
from string import ascii_lowercase, ascii_uppercase

from folioscope.functions import fixed as X

#: The letters of Latin-1 and what they decompose to; DuckDB has no function for that.
DECOMPOSED = {c: d for c in map(chr, range(0xC0, 0x100)) if (d := unicodedata.normalize("NFKD", c)) != c}
#: What is left of those letters beyond ASCII; DuckDB's levenshtein counts bytes, so each becomes a control character.
BEYOND = sorted({d for c in map(chr, range(0xC0, 0x100)) for d in unicodedata.normalize("NFKD", c.lower()) if ord(d) > 127 and unicodedata.category(d)[0] in "LM"})
#: The same rows as sources.revisions.revision_lines.
REVISION = rf"""
src AS (SELECT doc_id AS pair_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
raw AS (SELECT pair_id, i - 1 AS n, ls[i] AS line, (pair_id * 31 + i - 1) % 11 AS k
        FROM (SELECT pair_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM src)),
rev AS (
  SELECT pair_id, 1 AS side, n * 2 AS ord, CAST(n // 10 AS INTEGER) AS page_no, line FROM raw
  UNION ALL
  SELECT pair_id, 2, n * 2, CAST(n // 10 AS INTEGER),
         CASE k WHEN 1 THEN translate(line, '{ascii_lowercase}', '{ascii_uppercase}') WHEN 2 THEN line || ' amended' WHEN 3 THEN replace(line, 'the', 'that')
                WHEN 5 THEN translate(line, '0123456789', '1234567890') ELSE line END FROM raw WHERE k <> 0
  UNION ALL
  SELECT pair_id, 2, n * 2 + 1, CAST(n // 10 AS INTEGER), 'Inserted note ' || pair_id || ' balance ' || (n * 1000 + 345) FROM raw WHERE k = 4)"""
STAMP = f"(?:{X.STAMP}|{X.PAGE_STAMP})"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def noise(x: str) -> str:
    """x comes stripped."""
    return rf"(length({x}) < {X.LEAST_CHARS} OR regexp_full_match({x}, '{X.SEPARATORS}') OR regexp_full_match(lower({x}), '{STAMP}'))"


def clean_lines(x: str) -> str:
    return f"list_filter(list_transform(string_split(coalesce({x}, ''), chr(10)), lambda q: {strip('q')}), lambda q: NOT {noise('q')})"


def numbers(x: str) -> str:
    """Distinct numbers in order of appearance."""
    cleaned = f"regexp_replace(coalesce({x}, ''), '(?m)^{X.STAMP}$', '', 'g')"
    return distinct(rf"list_filter(list_transform(regexp_extract_all({cleaned}, '{X.NUMBER}'), lambda q: regexp_replace(q, '[\s,]', '', 'g')), lambda q: regexp_full_match(q, '{X.PLAIN_NUMBER}'))")


def numbers_by_line(x: str) -> str:
    cleaned = f"array_to_string(list_filter(string_split(coalesce({x}, ''), chr(10)), lambda q: NOT regexp_full_match(lower({strip('q')}), '{STAMP}')), chr(10))"
    return distinct(rf"list_filter(list_transform(regexp_extract_all({cleaned}, '{X.NUMBER}'), lambda q: regexp_replace(q, '[\s,]', '', 'g')), lambda q: regexp_full_match(q, '{X.PLAIN_NUMBER}'))")


def distinct(x: str) -> str:
    """A list without later repeats; list_distinct alone keeps no order."""
    return f"list_transform(list_sort(list_transform(list_distinct({x}), lambda q: struct_pack(p := list_position({x}, q), v := q))), lambda q: q.v)"


def decomposed(x: str) -> str:
    """For text of Latin-1."""
    letters = ", ".join(f"'{a}': '{b}'" for a, b in DECOMPOSED.items())
    return f"CASE WHEN regexp_full_match({x}, '[\\x00-\\x7f]*') THEN {x} ELSE array_to_string(list_transform(regexp_extract_all({x}, '(?s).'), lambda q: coalesce(map_extract(MAP {{{letters}}}, q)[1], q)), '') END"


def normalise(x: str, bare_stamps: bool = True) -> str:
    invisible = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in X.INVISIBLE)
    t = rf"regexp_replace(lower({strip(decomposed(f"coalesce({x}, '')"))}), '[\pC{invisible}]', '', 'g')"
    t = rf"trim(regexp_replace({t}, '\s+', ' ', 'g'))"
    return f"trim(regexp_replace({t}, '^{X.BARE_STAMP}$', ''))" if bare_stamps else t


def canonical(normalised: str) -> str:
    """RE2 has no look-around: digits that a space parts are joined in two passes, thousands commas by their right."""
    t = rf"regexp_replace(regexp_replace({normalised}, '(\d)\s+(\d)', '\1\2', 'g'), '(\d)\s+(\d)', '\1\2', 'g')"
    return rf"trim(regexp_replace({t}, '[^\pL\pM\p{{Nd}}\p{{Pc}}\s]', '', 'g'))"


def rounded(x: str, digits: int) -> str:
    return f"round_even(({x}) * {10**digits}, 0) / {10**digits}"


def levenshtein(a: str, b: str) -> str:
    """Of lines without control characters."""
    marks, controls = "".join(BEYOND), " || ".join(f"chr({k + 1})" for k in range(len(BEYOND)))
    one = lambda x: f"translate({x}, '{marks}', {controls})"
    return f"levenshtein({one(a)}, {one(b)})"
