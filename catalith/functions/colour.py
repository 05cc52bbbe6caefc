"""Colour and tone expressions; channels are 0..1 unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def channels(rgb: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue of '#rrggbb'; null for other texts."""
    ok = F.when(rgb.rlike("^#[0-9a-fA-F]{6}$"), rgb)
    return tuple(F.conv(F.substring(ok, i, 2), 16, 10).cast("double") / 255 for i in (2, 4, 6))


def linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def oklab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Published sRGB to OKLab matrices."""
    r, g, b = linear(r), linear(g), linear(b)
    l_ = F.cbrt(0.4122214708 * r + 0.5363325363 * g + 0.0514459929 * b)
    m_ = F.cbrt(0.2119034982 * r + 0.6806995451 * g + 0.1073969566 * b)
    s_ = F.cbrt(0.0883024619 * r + 0.2817188376 * g + 0.6299787005 * b)
    return (
        0.2104542553 * l_ + 0.7936177850 * m_ - 0.0040720468 * s_,
        1.9779984951 * l_ - 2.4285922050 * m_ + 0.4505937099 * s_,
        0.0259040371 * l_ + 0.7827717662 * m_ - 0.8086757660 * s_,
    )


def chroma(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


def hsv_saturation(r: Column, g: Column, b: Column) -> Column:
    top = F.greatest(r, g, b)
    return F.when(top == 0, 0.0).otherwise((top - F.least(r, g, b)) / top)


def hue(r: Column, g: Column, b: Column) -> Column:
    """Degrees in [0, 360); grey has 0."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    h = F.when(d == 0, 0.0).when(top == r, 60 * F.pmod((g - b) / d, F.lit(6.0))).when(top == g, 60 * ((b - r) / d + 2)).otherwise(60 * ((r - g) / d + 4))
    return F.pmod(h, F.lit(360.0))


def accent(lightness: Column, c: Column) -> Column:
    """Whether a colour is more than grey: the chroma it needs depends on shadow and highlight."""
    return c >= F.when(lightness < 0.12, 0.025).when(lightness > 0.96, 0.012).otherwise(0.0085)


def category(h: Column, is_accent: Column) -> Column:
    bands = F.when(h < 15, "red").when(h < 45, "orange").when(h < 70, "yellow").when(h < 165, "green").when(h < 195, "cyan").when(h < 255, "blue").when(h < 315, "purple").otherwise("red")
    bands = F.when(h >= 345, "red").otherwise(bands)
    return F.when(is_accent, bands).otherwise("neutral")


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def tone_label(mean: Column) -> Column:
    return F.when(mean < 0.36, "low_key").when(mean > 0.68, "high_key").otherwise("mid_tone")


def exposure_label(mean: Column) -> Column:
    return F.when(mean < 0.30, "underexposed").when(mean > 0.74, "overexposed").otherwise("balanced")


def contrast_label(c: Column) -> Column:
    return F.when(c < 0.11, "low").when(c > 0.24, "high").otherwise("medium")


def saturation_label(s: Column) -> Column:
    return F.when(s < 0.16, "low").when(s > 0.52, "high").otherwise("medium")


def hue_bins(centre: float, width: float) -> list[int]:
    """The 30-degree bins (centres 15, 45, ...) that a hue range of this width touches; width is held to 15..330."""
    centre, width = centre % 360, min(330.0, max(15.0, width))

    def apart(x: float) -> float:
        d = abs(x - centre) % 360
        return min(d, 360 - d)

    return [i for i in range(12) if apart(15 + 30 * i) <= width / 2 + 15]


def strictness_threshold(strictness: float | None) -> float:
    return 0.08 + 0.67 * min(1.0, max(0.0, 0.5 if strictness is None else strictness))
