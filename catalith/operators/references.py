"""References to records that are missing or came later, found with compressed bitmaps per key range and period."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cores

PAGE = 1 << 16  #: codes of one container
SPARSE = 4096  #: members up to which a container is a sorted array of 16-bit numbers, not a bitmap of 8 KB
RANGE_ROWS = 200_000  #: distinct (key, period) pairs and parents that one task encodes


def _period(time: Column) -> Column:
    month = F.substring(time, 1, 7)
    return F.when(month.rlike(r"^\d{4}-\d{2}$"), month).otherwise("")


class Bitmap:
    """A set of small integers in compressed containers: per 65 536 codes a sorted array while few are set, else a bitmap."""

    def __init__(self, codes: np.ndarray | None = None):
        self.pages: dict[int, np.ndarray] = {}
        if codes is not None and len(codes):
            codes = np.unique(codes)
            high, first = np.unique(codes >> 16, return_index=True)
            for page, part in zip(high, np.split(codes & (PAGE - 1), first[1:])):
                self.pages[int(page)] = self._packed(part.astype(np.uint16))

    @staticmethod
    def _packed(low: np.ndarray) -> np.ndarray:
        if len(low) <= SPARSE:
            return low
        bits = np.zeros(PAGE // 8, np.uint8)
        np.bitwise_or.at(bits, low >> 3, (1 << (low & 7)).astype(np.uint8))
        return bits

    @staticmethod
    def _low(box: np.ndarray) -> np.ndarray:
        return box if box.dtype == np.uint16 else np.flatnonzero(np.unpackbits(box, bitorder="little")).astype(np.uint16)

    def add(self, other: Bitmap) -> None:
        for page, box in other.pages.items():
            mine = self.pages.get(page)
            if mine is None:
                self.pages[page] = box
            elif mine.dtype == np.uint8 and box.dtype == np.uint8:
                self.pages[page] = mine | box
            else:
                self.pages[page] = self._packed(np.union1d(self._low(mine), self._low(box)))

    def minus(self, other: Bitmap) -> np.ndarray:
        """The codes of this set AND NOT the other, decoded."""
        out = []
        for page, box in self.pages.items():
            theirs = other.pages.get(page)
            if theirs is None:
                left = self._low(box)
            elif theirs.dtype == np.uint8:
                if box.dtype == np.uint8:
                    left = self._low(box & ~theirs)
                else:
                    left = box[(theirs[box >> 3] >> (box & 7) & 1) == 0]
            else:
                left = np.setdiff1d(self._low(box), theirs)
            out.append(left.astype(np.int64) + (page << 16))
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def nbytes(self) -> int:
        return sum(box.nbytes for box in self.pages.values())


def _and_not(refs: pd.DataFrame, parents: pd.DataFrame) -> pd.DataFrame:
    """One range of keys: encoded by a dense dictionary, then per period references AND NOT the parents of earlier periods, decoded."""
    held = parents.drop_duplicates("key")
    words = np.unique(np.concatenate([refs["key"].to_numpy(), held["key"].to_numpy()]))
    code = lambda x: np.searchsorted(words, x.to_numpy())
    every = Bitmap(code(held["key"]))
    arrivals = [(p, Bitmap(code(g["key"]))) for p, g in held.groupby("period", sort=True)]
    out, before, at = [], Bitmap(), 0
    for period, mine in refs.groupby("period", sort=True):
        while at < len(arrivals) and arrivals[at][0] < period:
            before.add(arrivals[at][1])
            at += 1
        asked = Bitmap(code(mine["key"]))
        left = asked.minus(before)
        if len(left):
            gone = np.isin(left, asked.minus(every), assume_unique=True)
            out.append(pd.DataFrame({"key": words[left], "period": period, "absent": gone}))
    return pd.concat(out) if out else pd.DataFrame({"key": words[:0], "period": pd.Series(dtype="object"), "absent": pd.Series(dtype="bool")})


def orphan_references(refs: DataFrame, parents: DataFrame, owner: str, key: str, time: str, parent_key: str, parent_time: str, rows: int | None = None) -> DataFrame:
    """(owner_id, missing_id, ref_month, ref_kind), distinct: references whose parent is 'absent' or came 'later'.

    Keys of any ordered type. Both sides are first reduced to their distinct keys per month, on the map side, so a hot
    key is one row per task however many rows refer to it. The keys are parted by a hash into ranges of about
    RANGE_ROWS (from `rows`, the number of rows of both tables, counted when not given); in its task each range gets a
    dense dictionary of integer codes and, per month, a compressed bitmap. References AND NOT the parents of earlier
    months leaves the absent ones and those whose parent came in the same month or later. Only those few are decoded
    and joined back to their rows, and only for them are the exact times compared, as ISO text.

    A null key is no reference. A null or unreadable reference time gives a null month and is never 'later'; a parent
    without a time counts as always there. Repeated rows count once; a repeated parent with different times counts
    with the earliest. Empty tables give the expected empty or all-absent result. A hot key in the join back is split
    by AQE.
    """
    r = refs.where(F.col(key).isNotNull()).select(F.col(owner).alias("owner_id"), F.col(key).alias("key"), F.col(time).alias("time"))
    p = parents.where(F.col(parent_key).isNotNull()).groupBy(F.col(parent_key).alias("key")).agg(F.min(F.coalesce(F.col(parent_time), F.lit(""))).alias("parent_time"))
    kind = dict(r.dtypes)["key"]
    rows = refs.count() + parents.count() if rows is None else rows
    ranges = max(cores(refs.sparkSession) * 2, -(-rows // RANGE_ROWS))
    range_ = F.pmod(F.xxhash64("key"), F.lit(ranges)).alias("range")
    asked = r.select("key", _period(F.col("time")).alias("period")).distinct().select(range_, "key", "period")
    there = p.select(range_, "key", _period(F.col("parent_time")).alias("period"))
    decoded = asked.groupBy("range").cogroup(there.groupBy("range")).applyInPandas(_and_not, f"key {kind}, period STRING, absent BOOLEAN")
    suspects = r.withColumn("period", _period(F.col("time"))).distinct().join(decoded, ["key", "period"])
    # Of one parent row per key, the left side of an absent key is null: one join serves both kinds.
    told = suspects.join(p, "key", "left").where(F.col("absent") | (F.col("parent_time") > F.col("time")))
    both = told.select("owner_id", "key", "period", F.when(F.col("absent"), "absent").otherwise("later").alias("ref_kind")).distinct()
    return both.select("owner_id", F.col("key").alias("missing_id"), F.when(F.col("period") != "", F.col("period")).alias("ref_month"), "ref_kind")
