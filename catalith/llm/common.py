"""Shared pieces of the training-data operators."""

from __future__ import annotations

import re

import regex
from pyspark.sql import DataFrame

from ..session import cores

#: Invisible characters: format controls (soft hyphen, zero-width, joiners, bidi marks), variation selectors, grapheme joiner.
INVISIBLE = regex.compile("[\\p{Cf}͏ᅟᅠ឴឵᠋-᠏︀-️\U000e0100-\U000e01ef]+")
WORD = regex.compile(r"[\p{L}\p{N}]+")
ASCII_WORD = re.compile(r"[a-z0-9]+")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, without regard to case, invisible characters and compatibility forms; null has none."""
    import unicodedata

    if not text:
        return []
    if text.isascii():  # its only odd characters are no letters, and it has no other forms
        return ASCII_WORD.findall(text.lower())
    clean = unicodedata.normalize("NFKC", INVISIBLE.sub("", text)).casefold()
    return WORD.findall(unicodedata.normalize("NFKC", clean))


def fan_out(df: DataFrame) -> DataFrame:
    """Enough partitions for a Python stage; a scan of few small files is spread over all cores, a large one stays as it is."""
    n = cores(df.sparkSession)
    return df.repartition(n * 3) if df.rdd.getNumPartitions() < n * 2 else df
