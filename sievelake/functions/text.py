"""Words, trigrams and their similarity."""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

PAD = "  "


def words(text: Column) -> Column:
    """The lower-cased runs of ASCII letters and digits."""
    return F.transform(F.regexp_extract_all(text, F.lit("([a-zA-Z0-9]+)"), F.lit(1)), F.lower)


def has_word(text: Column, word: str) -> Column:
    """Whether a text has the word, in any case. What isn't one run of letters and digits is no word."""
    low = word.lower()
    if not re.fullmatch("[a-z0-9]+", low):
        return F.lit(False)
    return text.rlike(f"(?<![a-zA-Z0-9])(?i:{low})(?![a-zA-Z0-9])")


def trigrams(text: Column) -> Column:
    """The distinct three-character windows of the lower-cased text with two spaces on either side."""
    padded = F.concat(F.lit(PAD), F.lower(text), F.lit(PAD))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def trigrams_of(text: str) -> list[str]:
    """The same for a literal."""
    padded = PAD + text.lower() + PAD
    return list(dict.fromkeys(padded[i : i + 3] for i in range(len(padded) - 2)))


def trigram_similarity(text: Column, target: str) -> Column:
    mine, theirs = trigrams(text), F.array(*[F.lit(g) for g in trigrams_of(target)])
    shared = F.size(F.array_intersect(mine, theirs))
    return shared / (F.size(mine) + F.size(theirs) - shared)


def resembles(text: Column, target: str, threshold: float) -> Column:
    """Similar by the threshold, and with a trigram in common even if the threshold is 0 or less.

    A text that is similar enough has so many of the target's trigrams that it must have one of any few of them:
    that is looked for first, by one pattern, and only what passes is cut into trigrams.
    """
    if threshold != threshold:
        return F.lit(False)
    theirs = trigrams_of(target)
    needed = max(1, math.ceil(threshold * len(theirs) - 1e-9))
    if needed > len(theirs):
        return F.lit(False)
    telling = sorted(theirs, key=lambda g: g.count(" "))[: len(theirs) - needed + 1]
    padded = F.concat(F.lit(PAD), F.lower(text), F.lit(PAD))
    some = padded.rlike("|".join(f"\\Q{g}\\E" for g in telling))
    if threshold <= 0:
        return some
    shared = reduce(add, [F.contains(padded, F.lit(g)).cast("int") for g in theirs])
    similar = shared / (F.size(trigrams(text)) + len(theirs) - shared) >= F.lit(float(threshold))
    return some & (shared >= needed) & similar


def has_substring(text: Column, part: str) -> Column:
    return F.contains(F.lower(text), F.lit(part.lower()))
