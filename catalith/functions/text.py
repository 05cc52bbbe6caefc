"""Text and path expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Names that Windows reserves for devices.
RESERVED = ["con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10))]


#: Words of a search text and what the encoder is asked instead, in the order in which they are replaced.
QUERY_WORDS = [
    ("人像", "portrait photo of a person"), ("人物", "photo of a person"), ("风景", "landscape scenery"), ("建筑", "architecture building"), ("动物", "animal"), ("食物", "food"),
    ("文档", "document page"), ("截图", "screenshot"), ("夜景", "night scene"), ("花", "flower"), ("产品", "product photo"),
]


def query_words(text: Column) -> Column:
    for word, instead in QUERY_WORDS:
        text = F.replace(text, F.lit(word), F.lit(instead))
    return text


def ascii_lower(c: Column | str) -> Column:
    """Fold A-Z only, as a NOCASE collation does; É stays É."""
    return F.translate(c, _UPPER, _LOWER)


def contains_nocase(c: Column | str, needle: str) -> Column:
    """Substring test without regard to ASCII case; wildcards in the needle are ordinary characters, blanks around it are dropped."""
    return F.instr(ascii_lower(c), ascii_lower(F.lit(needle.strip()))) > 0


def parent_path(c: Column | str) -> Column:
    """Directory of a slash-separated path, empty at the root."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract(c, r"^(.*)/[^/]*$", 1)


def ancestors(c: Column | str) -> Column:
    """All directories above a slash-separated path, nearest last, the root left out."""
    parts = F.split(parent_path(c), "/")
    upto = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.filter(upto, lambda p: p != "")


def stem(c: Column | str) -> Column:
    """File name without its last extension; a name that only starts with a dot is whole."""
    return F.regexp_replace(c, r"(?<=.)\.[^.]*$", "")


def path_depth(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c == "", 0).otherwise(F.size(F.split(c, "/")))


def inside(path: Column, root: Column) -> Column:
    """Component-wise containment: c:/photos holds c:/photos/x and itself, not c:/photos-other."""
    return (path == root) | path.startswith(F.concat(root, F.lit("/")))


def csv_field(c: Column | str) -> Column:
    """Minimal quoting; null is empty."""
    v = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.when(v.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def utf16_length(c: Column | str) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def bad_segment(c: Column | str) -> Column:
    """Why a path segment is not allowed on Windows: reserved_name, invalid_segment, segment_too_long, or null."""
    c = F.col(c) if isinstance(c, str) else c
    base = ascii_lower(F.split_part(c, F.lit("."), F.lit(1)))
    return F.when(c.rlike(r'[<>:"/\\|?*\x00-\x1f]') | c.rlike(r"[ .]$") | (c == ""), "invalid_segment").when(base.isin(RESERVED), "reserved_name").when(utf16_length(c) > 255, "segment_too_long")


@F.pandas_udf(StringType())
def _normal_form(paths: pd.Series) -> pd.Series:
    out = paths.copy()
    given = paths.notna()
    out[given] = [unicodedata.normalize("NFC", p).lower() for p in paths[given]]
    return out


def comparison_key(path: Column | str) -> Column:
    """NFC, lower case, forward slashes, no slash at the end. Normal forms are not among the built-in functions: only texts beyond ASCII go to Python."""
    c = F.col(path) if isinstance(path, str) else path
    beyond = c.rlike(r"[^\x00-\x7f]")
    folded = F.coalesce(_normal_form(F.when(beyond, c)), F.lower(c))
    return F.regexp_replace(F.replace(folded, F.lit("\\"), F.lit("/")), "/+$", "")


def zero_padded(n: Column, pattern: str) -> Column:
    """A number as wide as the zeros of a pattern, at least one, never cut."""
    text = n.cast("string")
    return F.when(F.length(text) >= max(1, pattern.count("0")), text).otherwise(F.lpad(text, max(1, pattern.count("0")), "0"))
