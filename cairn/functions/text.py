"""The tokenizer, as a column expression and for one string."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are not indexed.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in",
    "is", "it", "its", "of", "on", "or", "that", "the", "to", "was", "were", "will", "with",
)
LEAST, MOST = 2, 64


def folded(text: Column) -> Column:
    """Lower case as tokens have it: the dotted capital I is the one letter that lower() turns into a letter and a mark."""
    return F.lower(F.translate(text, "\u0130", "i"))


def tokenize(text: Column) -> Column:
    """Array of a text's tokens, each once.

    Runs of letters, decimal digits, ``_`` and ``-``; stripped of ``_`` and ``-`` at both ends; lower-cased; of 2 to
    64 bytes; no stop words. Built-in functions only, so it stays in the JVM.
    """
    # one pass each over the whole text, not one per word; the separators take the _ and - beside them along
    words = F.split(F.regexp_replace(folded(text), "^[_-]++|(?<![_-])[_-]++$", ""), r"(?<![_-])[_-]*+(?:[^\p{L}\p{Nd}_-]++[_-]*+)+")
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_distinct(F.filter(words, lambda w: F.octet_length(w).between(LEAST, MOST) & ~F.array_contains(stop, w)))


def tokens_of(text: str) -> list[str]:
    """The same for a query string on the driver."""
    text = text.replace("\u0130", "i")
    inside = "".join(c if c in "_-" or unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd" else " " for c in text)
    words = (re.sub("^[_-]+|[_-]+$", "", w).lower() for w in inside.split(" "))
    return list(dict.fromkeys(w for w in words if LEAST <= len(w.encode()) <= MOST and w not in STOP_WORDS))


def trim_upper(text: Column) -> Column:
    """Upper case without Unicode blanks at both ends."""
    return F.upper(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))


def hex_id() -> Column:
    """A random id of 32 hex digits; write the rows down before using them twice."""
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))
