"""Similarity of lines and pages, and the gates that decide whether a matched line changed."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from os.path import commonprefix

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from folioscope.functions import text as T
from folioscope.functions.fixed import BONUS, EXACT, LEAST_WORDS, LENGTH_RATIO, NUMBERS_EQUAL, OVERLAP, PENALTY, PREFIX_CHARS, RELATED, SENTENCE_END  # noqa: F401


def gestalt(a: str, b: str) -> float:
    """Ratcliff/Obershelp similarity; not symmetric. Two empty strings are equal."""
    if not a or not b:
        return 1.0 if not a and not b else 0.0
    if a == b:
        return 1.0
    return 2.0 * in_blocks(a, b) / (len(a) + len(b))


def length_bound(a: str, b: str) -> float:
    """What gestalt is not above, by lengths alone."""
    return 2.0 * min(len(a), len(b)) / (len(a) + len(b)) if a or b else 1.0


#: Characters of the least pieces that runs are found by; cells up to which two texts are searched size by size, or letter by letter.
PIECE, FEW, SOME = 8, 64, 40_000
#: Runs from which those of a range are looked for in arrays; finds of pieces, beyond which text that repeats is searched by ranks.
MANY, FINDS = 24, 4_096
#: Sizes of substrings whose ranks are kept.
SIZES = 32


def in_blocks(a: str, b: str) -> int:
    """How many characters stand in the blocks of Ratcliff/Obershelp: the longest common run, the first one of a, then of b,
    and what lies before it on both sides and after it likewise.

    A run of 2 * piece - 1 characters holds a whole piece of a, so pieces find all of them, and each part of a run between
    two blocks is a run there: texts are searched once, not for every block. What is left between the blocks is searched by smaller pieces.
    Text that repeats has more runs than memory, so it is searched by ranks of its substrings.
    """
    found, open_ = 0, [(a, b, 0)]
    while open_:
        a, b, piece = open_.pop()
        if a in b or b in a:
            found += min(len(a), len(b))
        elif len(a) * len(b) <= FEW:
            found += _in_few(a, b)
        elif piece == 1 or len(a) * len(b) <= SOME and (piece or min(len(a), len(b)) < 4 * PIECE):
            found += sum(x.size for x in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        else:
            piece = max(1, piece // 2) if piece else max(PIECE, min(len(a), len(b)) // 64)
            runs = _runs(a, b, piece)
            blocks, rest = _ranked(a, b) if runs is None else _split(a, b, piece, runs)
            found += blocks
            open_ += [(x, y, 1 if runs is None else piece) for x, y in rest]
    return found


def _in_few(a: str, b: str) -> int:
    for size in range(min(len(a), len(b)), 0, -1):
        for i in range(len(a) - size + 1):
            j = b.find(a[i : i + size])
            if j >= 0:
                return size + _in_few(a[:i], b[:j]) + _in_few(a[i + size :], b[j + size :])
    return 0


def _split(a: str, b: str, piece: int, runs: list[tuple[int, int, int]]) -> tuple[int, list[tuple[str, str]]]:
    """Characters in blocks of 2 * piece - 1 or more, and the texts on both sides that lie between those."""
    least = 2 * piece - 1
    found, rest = 0, []
    open_ = [(0, len(a), 0, len(b), runs)]
    while open_:
        alo, ahi, blo, bhi, runs = open_.pop()
        if len(runs) > MANY:
            inside, best = _longest(np.asarray(runs), alo, ahi, blo, bhi, least)
        else:
            inside, best = [], (0, 0, 0)
        for run in runs if len(runs) <= MANY else ():
            i, j, size = run
            begin, end = max(0, alo - i, blo - j), min(size, ahi - i, bhi - j)
            if end - begin >= least:
                inside.append(run)
                best = max(best, (end - begin, -i - begin, -j - begin))
        if not len(inside):
            rest.append((a[alo:ahi], b[blo:bhi]))
            continue
        size, i, j = best[0], -best[1], -best[2]
        found += size
        for part in ((alo, i, blo, j), (i + size, ahi, j + size, bhi)):
            if part[0] < part[1] and part[2] < part[3]:
                open_.append((*part, inside))
    return found, rest


def _longest(runs: np.ndarray, alo: int, ahi: int, blo: int, bhi: int, least: int) -> tuple[np.ndarray, tuple[int, int, int]]:
    """The runs with enough characters in a range, and the size and negative places of the block there: text that repeats has many."""
    i, j, size = runs.T
    begin, end = np.maximum(np.maximum(alo - i, blo - j), 0), np.minimum(np.minimum(ahi - i, bhi - j), size)
    enough = end - begin >= least
    runs, begin, end = runs[enough], begin[enough], end[enough]
    if not len(runs):
        return runs, (0, 0, 0)
    top = np.flatnonzero(end - begin == (end - begin).max())
    i, j = runs[top, 0] + begin[top], runs[top, 1] + begin[top]
    best = np.lexsort((j, i))[0]
    return runs, (int((end - begin)[top[best]]), -int(i[best]), -int(j[best]))


def _ranked(a: str, b: str) -> tuple[int, list[tuple[str, str]]]:
    """Characters in blocks, and the texts on both sides of what was too small to look for here.

    Substrings of 2 ** k characters of both texts have a rank each, equal ones the same, and two of those tell
    substrings of any size apart. A range's block is no longer than that of the range around it, whose size is tried first.
    Memory grows with the texts, not with their common runs.
    """
    n = len(a)
    ranks = [np.unique(np.frombuffer((a + b).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)[1]]
    ids: dict[int, np.ndarray] = {}

    def of(size: int) -> np.ndarray:
        """The rank of the substring from each place on; those that go from one text into the other are never asked for."""
        if size not in ids:
            k = size.bit_length() - 1
            while len(ranks) <= k:
                half = ranks[-1]
                step = 1 << len(ranks) - 1
                ranks.append(np.unique(half[:-step] * len(half) + half[step:], return_inverse=True)[1])
            if len(ids) == SIZES:
                del ids[next(iter(ids))]
            rest = size - (1 << k)
            ids[size] = np.unique(ranks[k][: len(ranks[k]) - rest] * (len(a) + len(b)) + ranks[k][rest:], return_inverse=True)[1].astype(np.int32) if rest else ranks[k]
        return ids[size]

    def places(alo: int, ahi: int, blo: int, bhi: int, size: int) -> tuple[int, int] | None:
        """The first place in a, then in b, of a common substring of a size."""
        rank = of(size)
        x, y = rank[alo : ahi - size + 1], rank[n + blo : n + bhi - size + 1]
        there = np.zeros(len(rank), bool)
        there[y] = True
        hit = there[x]
        i = int(hit.argmax())
        return (alo + i, blo + int((y == x[i]).argmax())) if hit[i] else None

    found, rest, open_ = 0, [], [(0, n, 0, len(b), min(n, len(b)))]
    while open_:
        alo, ahi, blo, bhi, top = open_.pop()
        if (ahi - alo) * (bhi - blo) <= SOME:
            rest.append((a[alo:ahi], b[blo:bhi]))
            continue
        top = min(top, ahi - alo, bhi - blo)
        at, size = places(alo, ahi, blo, bhi, top), top
        if at is None:
            size, over = 0, top
            while over - size > 1:
                middle = (size + over) // 2
                met = places(alo, ahi, blo, bhi, middle)
                at, size, over = (met, middle, over) if met else (at, size, middle)
        if at is None:
            continue
        found += size
        i, j = at
        for part in ((alo, i, blo, j), (i + size, ahi, j + size, bhi)):
            if part[0] < part[1] and part[2] < part[3]:
                open_.append((*part, size))
    return found, rest


def _runs(a: str, b: str, piece: int) -> list[tuple[int, int, int]] | None:
    """(place in a, place in b, size) of the common runs that no equal character borders, as far as they hold a piece of a.

    None if pieces are found too often: FINDS, and once for every two characters of a text.
    """
    out, ends, left = [], {}, FINDS + (len(a) + len(b)) // 4
    for i in range(0, len(a) - piece + 1, piece):
        one = a[i : i + piece]
        j = b.find(one)
        while j >= 0:
            left -= 1
            if left < 0:
                return None
            if ends.get(j - i, 0) <= i:
                back = _equal(a, b, i - 1, j - 1, -1)
                size = back + piece + _equal(a, b, i + piece, j + piece, 1)
                out.append((i - back, j - back, size))
                ends[j - i] = i - back + size
            j = b.find(one, j + 1)
    return out


def _equal(a: str, b: str, i: int, j: int, way: int) -> int:
    """Equal characters from two places on, forwards or (way -1) backwards, up to the first that differ."""
    most = min(len(a) - i, len(b) - j) if way > 0 else min(i, j) + 1
    n, step = 0, 16
    while n < most:
        step = min(step, most - n)
        x, y = (i + n, j + n) if way > 0 else (i - n - step + 1, j - n - step + 1)
        if a[x : x + step] == b[y : y + step]:
            n, step = n + step, 2 * step
        elif step == 1:
            break
        else:
            step //= 2
    return n


@F.pandas_udf(DoubleType())
def gestalt_of(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([gestalt(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance with bit-parallel columns (Myers)."""
    head = len(commonprefix([a, b]))
    a, b = a[head:], b[head:]
    tail = len(commonprefix([a[::-1], b[::-1]]))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not a or not b:
        return len(a) or len(b)
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for c in b:
        eq = masks.get(c, 0)
        x = eq | down
        diagonal = (((eq & up) + up) ^ up) | eq
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal
        if plus & last:
            score += 1
        elif minus & last:
            score -= 1
        plus = (plus << 1) | 1
        minus <<= 1
        up, down = (minus | (full & ~(x | plus))) & full, plus & x & full
    return score


@F.pandas_udf(IntegerType())
def edit_distance_of(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([None if x is None or y is None else edit_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


#: Cells of a distance's table from which a pair of lines goes to the bit-parallel form.
CELLS = 1 << 12


def levenshtein(a: Column, b: Column) -> Column:
    # Equal lines, which most are, need no distance; the JVM takes a step for each cell of the table.
    n, m = F.length(a), F.length(b)
    long = (n.cast("long") * m > CELLS) & (a != b)
    distance = F.coalesce(edit_distance_of(F.when(long, a), F.when(long, b)), F.levenshtein(a, b))
    return F.when(a == b, 1.0).otherwise(1.0 - distance / F.greatest(n, m))


def jaccard(a: Column, b: Column, empty: float) -> Column:
    """Share of two distinct arrays' union that both have; `empty` where the union is."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(empty))


def dice(a: Column, b: Column) -> Column:
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise(2 * F.size(F.array_intersect(a, b)) / both)


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def with_numbers(similarity: Column, numbers1: Column, numbers2: Column, floor: bool) -> Column:
    """A bonus if both lines have the same numbers, a penalty if both have numbers that differ; 1 at most."""
    change = F.when((F.size(numbers1) > 0) & (F.size(numbers2) > 0), F.when(same_set(numbers1, numbers2), BONUS).otherwise(-PENALTY)).otherwise(0.0)
    score = F.least(F.lit(1.0), similarity + change)
    return F.greatest(F.lit(0.0), score) if floor else score


def status(norm1: Column, norm2: Column, canon1: Column, canon2: Column, numbers1: Column, numbers2: Column, score: Column) -> Column:
    """"same" if any gate opens, else "changed"."""
    w1, w2 = F.array_distinct(T.tokens(norm1)), F.array_distinct(T.tokens(norm2))
    numbers_agree = same_set(numbers1, numbers2)
    wrapped = numbers_agree & (F.size(w1) >= LEAST_WORDS) & (F.size(w2) >= F.size(w1)) & (F.size(F.array_intersect(w1, w2)) / F.size(w1) >= OVERLAP) & (F.size(w1) / F.size(w2) >= LENGTH_RATIO)
    shorter = F.when(F.length(norm1) <= F.length(norm2), norm1).otherwise(norm2)
    longer = F.when(F.length(norm1) <= F.length(norm2), norm2).otherwise(norm1)
    prefix = (F.length(shorter) >= PREFIX_CHARS) & ~shorter.rlike(f"[{SENTENCE_END}]$") & longer.startswith(shorter)
    return (
        F.when(norm1 == norm2, "same")
        .when(canon1 == canon2, "same")
        .when(score >= EXACT, "same")
        .when(numbers_agree & (score >= NUMBERS_EQUAL), "same")
        .when(wrapped, "same")
        .when(prefix, "same")
        .otherwise("changed")
    )
