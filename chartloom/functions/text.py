"""Text normalisation: line text, look-up keys and entity keys."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What is folded.
DEVANAGARI = "०१२३४५६७८९"
DASHES = "‐‑‒–—―−"
MARKUP = "`*"
HALVES = {"½": "1/2", "¼": "1/4", "¾": "3/4"}


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def normalize_text(text: Column, compose: bool = True) -> Column:
    """Compatibility-composed text with ASCII digits and hyphens, no backticks or asterisks, single spaces, trimmed lines.

    Vulgar halves and quarters become n/d first, since composition would split them with another slash. Without
    `compose` no Python runs: text of ASCII and the folded characters comes out the same.
    """
    for glyph, plain in HALVES.items():
        text = F.replace(text, F.lit(glyph), F.lit(plain))
    if compose:
        # Python gets only the texts that it may change
        text = F.coalesce(nfkc(F.when(text.rlike(r"[^\x00-\x7f]"), text)), text)
    text = F.translate(text, DEVANAGARI + DASHES + MARKUP, "0123456789" + "-" * len(DASHES))
    text = F.regexp_replace(text, "\r\n|[\r\x0b\x0c\x1c-\x1e\x85  ]", "\n")
    text = F.regexp_replace(text, "[ \t ]+", " ")
    return F.regexp_replace(F.regexp_replace(text, "(?m)^ | $", ""), "\n$", "")


def lookup_key(x: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def alnum_key(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]", "")


def entity_chars(x: Column) -> Column:
    """Lower case; only a-z, 0-9 and Devanagari stay."""
    return F.regexp_replace(F.lower(x), "[^a-z0-9ऀ-ॿ]+", "")
