"""Dominant colours of images given as arrays of pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Clusters, rounds, least area of an entry, least distance of two seeds.
CLUSTERS, ROUNDS, LEAST_AREA, LEAST_DISTANCE = 8, 8, 0.012, 0.045
ENTRIES = "id BIGINT, rank INT, rgb STRING, area DOUBLE, chroma DOUBLE"


def oklab(rgb: np.ndarray) -> np.ndarray:
    """(n, 3) OKLab of (n, 3) sRGB in 0..1, by the published matrices."""
    x = np.where(rgb <= 0.04045, rgb / 12.92, ((rgb + 0.055) / 1.055) ** 2.4)
    lms = np.cbrt(x @ np.array([[0.4122214708, 0.2119034982, 0.0883024619], [0.5363325363, 0.6806995451, 0.2817188376], [0.0514459929, 0.1073969566, 0.6299787005]]))
    return lms @ np.array([[0.2104542553, 1.9779984951, 0.0259040371], [0.7936177850, -2.4285922050, 0.7827717662], [-0.0040720468, 0.4505937099, -0.8086757660]])


def extract(pixels: np.ndarray) -> list[tuple[str, float, float]]:
    """(#rgb, share of the area, chroma) by falling area.

    Pixels (packed 0xRRGGBB) are counted in bins of four bits a channel; seeds are the fullest bin and then the bins
    farthest from all seeds, while they are far enough; weighted k-means in OKLab moves them.
    """
    if not len(pixels):
        return []
    rgb = np.column_stack([pixels >> 16 & 255, pixels >> 8 & 255, pixels & 255]).astype(np.float64)
    key = (rgb.astype(np.int64) >> 4) @ np.array([256, 16, 1])
    _, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
    mean = np.column_stack([np.bincount(inverse, rgb[:, i]) / n for i in range(3)])
    lab = oklab(mean / 255)
    seeds = [int(np.argmax(n))]
    far = np.linalg.norm(lab - lab[seeds[0]], axis=1)
    while len(seeds) < CLUSTERS and far.max() >= LEAST_DISTANCE:
        seeds.append(int(np.argmax(far)))
        far = np.minimum(far, np.linalg.norm(lab - lab[seeds[-1]], axis=1))
    centres = lab[seeds].copy()
    label = np.zeros(len(lab), np.int64)
    for _ in range(ROUNDS):
        label = np.argmin(((lab[:, None] - centres[None]) ** 2).sum(2), axis=1)
        for k in range(len(centres)):
            if (label == k).any():
                centres[k] = np.average(lab[label == k], axis=0, weights=n[label == k])
    out = []
    for k in range(len(centres)):
        m = label == k
        area = n[m].sum() / n.sum()
        if area >= LEAST_AREA:
            colour = np.round(np.average(mean[m], axis=0, weights=n[m])).astype(int)
            out.append(("#%02x%02x%02x" % tuple(colour), float(area), float(np.hypot(*centres[k][1:]))))
    return sorted(out, key=lambda x: (-x[1], x[0]))


def palettes(images: DataFrame) -> DataFrame:
    """(id, rank, rgb, area, chroma) of images (id, pixels ARRAY<INT> of 0xRRGGBB). Null and empty images have no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, k, *entry) for i, p in zip(pdf["id"], pdf["pixels"]) if p is not None for k, entry in enumerate(extract(np.asarray(p, np.int64)))]
            yield pd.DataFrame(rows, columns=["id", "rank", "rgb", "area", "chroma"])

    return images.select("id", "pixels").mapInPandas(run, ENTRIES)
