"""EXIF fields out of JPEG or TIFF bytes."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

FIELDS = StructType(
    [
        StructField("orientation", IntegerType()), StructField("capture_time", StringType()), StructField("camera_make", StringType()), StructField("camera_model", StringType()), StructField("lens_model", StringType()),
        StructField("exposure_time", StringType()), StructField("aperture", DoubleType()), StructField("iso", LongType()), StructField("focal_length", DoubleType()),
    ]
)
#: Fixed values of the EXIF standard: tag numbers and the sizes of its types.
TAGS = {0x010F: "make", 0x0110: "model", 0x0112: "orientation", 0x0132: "changed", 0x829A: "exposure", 0x829D: "aperture", 0x8827: "iso", 0x9003: "taken", 0x920A: "focal", 0xA434: "lens", 0x8769: "more"}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def _tiff(data: bytes) -> bytes | None:
    """The TIFF block: the data itself, or the Exif segment of a JPEG."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    at = 2 if data[:2] == b"\xff\xd8" else len(data)
    while at + 4 <= len(data) and data[at] == 0xFF:
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return data[at + 10 : at + 2 + size]
        if data[at + 1] == 0xDA:
            break
        at += 2 + size
    return None


def parse(data: bytes | None) -> dict:
    """Fields of one file; unreadable, truncated or missing blocks give no fields rather than an error."""
    out: dict = dict.fromkeys(FIELDS.fieldNames())
    t = _tiff(data or b"")
    if not t or len(t) < 8:
        return out
    e = "<" if t[:2] == b"II" else ">"
    found: dict = {}
    todo, seen = [struct.unpack(e + "I", t[4:8])[0]], set()
    while todo:
        at = todo.pop()
        if at in seen or at + 2 > len(t):
            continue
        seen.add(at)
        for k in range(struct.unpack(e + "H", t[at : at + 2])[0]):
            entry = t[at + 2 + 12 * k : at + 14 + 12 * k]
            if len(entry) < 12:
                break
            tag, kind, count = struct.unpack(e + "HHI", entry[:8])
            size = SIZES.get(kind, 0) * count
            if tag not in TAGS or not size:
                continue
            start = struct.unpack(e + "I", entry[8:])[0]
            raw = entry[8 : 8 + size] if size <= 4 else t[start : start + size]
            if len(raw) < size:
                continue
            if kind == 2:
                value = raw.split(b"\0")[0].decode("utf-8", "replace").strip() or None
            elif kind in (5, 10):
                a, b = struct.unpack(e + ("II" if kind == 5 else "ii"), raw[:8])
                value = (a, b) if b else None
            else:
                value = struct.unpack(e + {1: "B", 3: "H", 4: "I", 7: "B", 9: "i"}[kind], raw[: SIZES[kind]])[0]
            if TAGS[tag] == "more":
                todo.append(value)
            else:
                found.setdefault(TAGS[tag], value)
    ratio = lambda v: v[0] / v[1] if isinstance(v, tuple) else None
    when = found.get("taken") or found.get("changed")
    if when and len(when) == 19 and when[4] == when[7] == ":":
        when = f"{when[:4]}-{when[5:7]}-{when[8:10]}T{when[11:]}"
    exposure = found.get("exposure")
    if isinstance(exposure, tuple):
        a, b = exposure
        exposure = f"1/{round(b / a)}" if 0 < a < b else f"{a / b:g}"
    out.update(orientation=found.get("orientation"), capture_time=when, camera_make=found.get("make"), camera_model=found.get("model"), lens_model=found.get("lens"), exposure_time=exposure, aperture=ratio(found.get("aperture")), iso=found.get("iso"), focal_length=ratio(found.get("focal")))
    return out


@F.pandas_udf(FIELDS)
def exif(content: pd.Series) -> pd.DataFrame:
    """Struct of EXIF fields for a column of file bytes."""
    return pd.DataFrame([parse(c) for c in content], columns=FIELDS.fieldNames()).astype({"orientation": "Int32", "iso": "Int64"})
