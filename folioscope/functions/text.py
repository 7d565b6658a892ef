"""Column builders for cleaning, splitting and reading text. All of them stay in the JVM but `nfkd`."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioscope.functions import fixed as X

SEPARATORS = f"^{X.SEPARATORS}$"
STAMP = f"^(?:{X.STAMP}|{X.PAGE_STAMP})$"
#: The first character of rules and page stamps.
NOISE_BEGINS = r"(?U)^[\s\-_=|.–—(\dpP]"
STAMP_LINES = f"(?md)^{X.STAMP}$"
BARE_STAMP = f"^{X.BARE_STAMP}$"
INVISIBLE = r"[\p{C}" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in X.INVISIBLE) + "]"
#: White space and what is invisible, of ASCII.
SPACES = " \t\n\x0b\f\r"
CONTROLS = r"[\x00-\x1f\x7f]+"


@F.pandas_udf(StringType())
def nfkd(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility decomposition, for which Spark has no function."""
    for s in texts:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x))


def decomposed(text: Column) -> Column:
    """nfkd, for which only text that has anything but ASCII is sent to Python."""
    return F.coalesce(nfkd(F.when(~is_ascii(text), text)), text)


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.when(is_ascii(text), F.btrim(text, F.lit(SPACES))).otherwise(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))


def is_noise(line: Column) -> Column:
    """True for lines under four characters, rules of separators, and page stamps. The line comes stripped.

    Few lines begin as rules and stamps do; the others are not read to their ends.
    """
    begins = F.substring(line, 1, 1).rlike(NOISE_BEGINS)
    return (F.length(line) < X.LEAST_CHARS) | (begins & (line.rlike("(?U)" + SEPARATORS) | F.lower(line).rlike("(?U)" + STAMP)))


def lines_of(text: Column) -> Column:
    """The stripped lines of a text, without noise, in order."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip), lambda x: ~is_noise(x))


def normalise(text: Column, bare_stamps: bool = True) -> Column:
    """Case, invisible characters and runs of white space evened out; a bare page stamp becomes empty if `bare_stamps`.

    Takes text after `decomposed`. Invisible characters go before white space is
    collapsed, so a tab is deleted, not made a space.
    """
    text = F.coalesce(text, F.lit(""))
    t = F.lower(strip(text))
    # Patterns for ASCII alone are much faster, and most lines need no more.
    plain = F.regexp_replace(F.regexp_replace(t, CONTROLS, ""), " {2,}", " ")
    t = F.trim(F.when(is_ascii(text), plain).otherwise(F.regexp_replace(F.regexp_replace(t, INVISIBLE, ""), r"(?U)\s+", " ")))
    return without_stamp(t) if bare_stamps else t


def without_stamp(normalised: Column) -> Column:
    """Empty if a normalised line is a bare page stamp."""
    return F.trim(F.regexp_replace(normalised, BARE_STAMP, ""))


def canonical(normalised: Column) -> Column:
    """What is left when spacing within numbers, thousands commas and punctuation do not count."""

    def made(flag: str) -> Column:
        t = F.regexp_replace(normalised, flag + r"\s+", " ")
        t = F.regexp_replace(F.regexp_replace(t, flag + X.DIGIT_GAP, ""), flag + X.THOUSANDS, "")
        return F.regexp_replace(t, flag + r"[^\w\s]", "")

    return strip(F.when(is_ascii(normalised), made("")).otherwise(made("(?U)")))


def numbers(text: Column, stamps: str = "block") -> Column:
    """The distinct numbers of a text as strings in order of appearance, without page stamps.

    stamps: "block" removes stamps that may span blank lines; "line" drops single lines, "page n of m" too.
    """
    text = F.coalesce(text, F.lit(""))
    if stamps == "block":
        text = F.regexp_replace(text, STAMP_LINES, "")
    else:
        text = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.lower(strip(x)).rlike(STAMP)), "\n")
    # Each number begins with a digit: asked first, most places need no more.
    found = F.transform(F.regexp_extract_all(text, F.lit(rf"(?=\d)(?:{X.NUMBER})"), F.lit(0)), lambda x: F.regexp_replace(x, r"[\s,]", ""))
    return F.array_distinct(F.filter(found, lambda x: x.rlike(f"^{X.PLAIN_NUMBER}$")))


def by_value(found: Column) -> Column:
    """Numbers ordered by value; equal values keep their order."""
    pairs = F.transform(found, lambda x, i: F.struct(x.cast("double").alias("v"), i.alias("i"), x.alias("s")))
    return F.transform(F.array_sort(pairs), lambda x: x["s"])


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda x: x != "")


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda x: x != "")


def index_keys(t: Column) -> Column:
    """The first of a line's tokens, and every two neighbours written as one. The tokens come as a column of their own:
    an expression would be evaluated for each use."""
    rest = F.greatest(F.size(t) - 1, F.lit(0))
    # zip_with, not an index into t: Spark would split the line again for every token.
    pairs = F.zip_with(F.slice(t, F.lit(1), rest), F.slice(t, F.lit(2), rest), lambda x, y: F.concat(x, y))
    return F.array_distinct(F.concat(F.slice(t, 1, 1), pairs))


def anchor(text: Column) -> Column:
    """The head of a page: its first lines that are not short, lower-cased, some characters at most."""
    return F.substring(F.lower(F.array_join(F.slice(F.filter(lines_of(text), lambda x: F.length(x) > X.ANCHOR_LEAST), 1, X.ANCHOR_LINES), " ")), 1, X.ANCHOR_CHARS)


def vocabulary(text: Column) -> Column:
    """The distinct words of at least four letters a-z."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(X.WORD), F.lit(0)))


def years(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(X.YEAR), F.lit(0)), lambda x: x.cast("int"))))


def shortened(text: Column, n: int) -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n), F.lit("…")))


def file_safe(name: Column) -> Column:
    """A name without characters that file systems forbid; a blank one becomes AFS."""
    clean = strip(F.regexp_replace(F.coalesce(name, F.lit("")), r'[\\/*?:"<>|]', "_"))
    return F.when(clean == "", "AFS").otherwise(clean)


def html_escaped(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def rounded(x: Column, digits: int) -> Column:
    """Rounded half to even, on the binary value."""
    return F.rint(x * 10**digits) / 10**digits


#: Items that a fold takes at a time.
BLOCK = 256


def folded(items: Column, start: Column, step, grows: str, kind: str) -> Column:
    """aggregate(items, start, step) of a struct whose array `grows`, of type `kind`, is only ever added to.

    An array is copied for each item that is added. Items are folded in blocks that each begin with that array empty, and
    the blocks' arrays are put together at the end: the time is linear in the items, not quadratic.
    """
    empty = F.array().cast(kind)
    blocks = lambda held: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(held) - 1, F.lit(0)) / BLOCK).cast("int")), lambda k: F.slice(held, k * BLOCK + 1, BLOCK))
    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)

    def block(state: Column, part: Column) -> Column:
        ended = F.aggregate(part, state["rest"].withField(grows, empty), step)
        return once(ended, lambda t: F.struct(F.concat(state["full"], F.array(t[grows])).alias("full"), t.alias("rest")))

    first = F.struct(F.array().cast(f"array<{kind}>").alias("full"), start.alias("rest"))
    return once(items, lambda held: F.aggregate(blocks(held), first, block, lambda s: s["rest"].withField(grows, F.flatten(s["full"]))))
