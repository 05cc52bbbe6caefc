"""Evaluation passages inside training texts: MinHash of equal-sized windows, verified by exact shingle containment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import fan_out, words

SHINGLE = 5  #: words per hashed shingle
#: Documents longer than this many words are hashed in overlapping segments, so that no array grows with a text.
SEGMENT = 1 << 16


_KNOWN: dict[str, int] = {}  #: hashes of words that this process has met, emptied when it holds MOST_WORDS
MOST_WORDS = 1 << 20


def _word_hashes(tokens: list[str]) -> np.ndarray:
    if len(_KNOWN) > MOST_WORDS:
        _KNOWN.clear()
    for t in set(tokens).difference(_KNOWN):
        _KNOWN[t] = xxhash.xxh64_intdigest(t)
    return np.fromiter(map(_KNOWN.__getitem__, tokens), np.uint64, len(tokens))


def shingle_hashes(tokens: list[str], k: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of all runs of k words, uniform enough to be compared as a random order."""
    if len(tokens) < k:
        return np.zeros(0, np.uint64)
    h = _word_hashes(tokens)
    n = len(tokens) - k + 1
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def window_minima(tokens: list[str], window: int) -> np.ndarray:
    """MinHash of every window of `window` words (the least of its shingle hashes), each once.

    Two texts that share `window` consecutive words share the shingles of that window and so its MinHash: the
    candidates miss nothing. About a quarter of all positions is kept.
    """
    size = window - SHINGLE + 1
    found: list[np.ndarray] = []
    for start in range(0, max(1, len(tokens) - window + 1), SEGMENT):
        h = shingle_hashes(tokens[start : start + SEGMENT + window - 1])
        if len(h) >= size:
            low = h[: len(h) - size + 1].copy()
            for k in range(1, size):
                np.minimum(low, h[k : len(h) - size + 1 + k], out=low)
            found.append(low[np.r_[True, low[1:] != low[:-1]]])
    return np.unique(np.concatenate(found)).view(np.int64) if found else np.zeros(0, np.int64)


def _signatures(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tokens = [words(t) for t in pdf["text"]]
            yield pd.DataFrame({"key": pdf["key"], "n_words": [len(t) for t in tokens], "minima": [window_minima(t, window) for t in tokens]})

    return run


def _verify(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items: dict[str, frozenset] = {}
        for pdf in batches:
            out = []
            pdf = pdf.sort_values("doc_id")
            doc, mine = (None, None), frozenset()
            for d, i, estimate, text, item_text in zip(pdf["doc_id"], pdf["item_id"], pdf["estimate"], pdf["text"], pdf["item_text"]):
                if item_text not in items:
                    if len(items) > 10_000:
                        items.clear()
                    w = words(item_text)
                    items[item_text] = frozenset(tuple(w[j : j + window]) for j in range(len(w) - window + 1))
                if (d, text) != doc:
                    w = words(text)
                    doc, mine = (d, text), frozenset(tuple(w[j : j + window]) for j in range(len(w) - window + 1))
                shared = len(mine & items[item_text])
                if shared:
                    out.append((d, i, estimate, shared, shared / len(items[item_text])))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "estimate", "shared_shingles", "containment"])

    return run


def leaked_items(documents: DataFrame, items: DataFrame, window: int = 12, broadcast_rows: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, shared_shingles, containment, estimate): documents sharing `window` consecutive words with an item.

    documents (doc_id, text), items (item_id, item_text). Both sides are cut into windows of `window` words, which makes
    all sizes equal: MinHash containment of a short item in a long document becomes equality of window MinHashes, and
    no size classes are needed. Items of under `window` words can hold no passage and are left out. `estimate` is the
    share of the item's MinHashes that the document has, `containment` the exact share of its `window`-word shingles,
    on which the result rests.

    The items' MinHashes are made once and broadcast while there are at most `broadcast_rows` of them (counted, 16
    bytes each), else joined by shuffle; the candidate pairs are written once, and only documents that have some meet
    their text again. Null, empty and short texts give no row; repeated rows count once; very long texts are hashed in
    segments; a passage in a third of all documents is a third of all rows of the result, spread by document.
    """
    docs = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    short = items.select("item_id", "item_text").where("item_id is not null and item_text is not null").dropDuplicates()
    schema = "key BIGINT, n_words INT, minima ARRAY<BIGINT>"
    item_rows = short.select(F.col("item_id").alias("key"), F.col("item_text").alias("text"))
    item_signs = item_rows.mapInPandas(_signatures(window), schema).where(F.col("n_words") >= window)
    item_signs = item_signs.select(F.col("key").alias("item_id"), F.size("minima").alias("item_minima"), F.explode("minima").alias("minimum"))
    item_signs = materialise(item_signs.groupBy("item_id", "minimum").agg(F.max("item_minima").alias("item_minima")), "item_signs", n=F.count(F.lit(1)))
    if item_signs.measured["n"] <= broadcast_rows:
        item_signs = F.broadcast(item_signs)
    doc_signs = fan_out(docs.select(F.col("doc_id").alias("key"), "text")).mapInPandas(_signatures(window), schema).where(F.col("n_words") >= window).select(F.col("key").alias("doc_id"), F.explode("minima").alias("minimum"))
    pairs = materialise(doc_signs.join(item_signs, "minimum").groupBy("doc_id", "item_id").agg((F.count_distinct("minimum") / F.max("item_minima")).alias("estimate")), "pairs")
    found = pairs.join(docs, "doc_id").join(short, "item_id")
    exact = found.select("doc_id", "item_id", "estimate", "text", "item_text").mapInPandas(_verify(window), "doc_id BIGINT, item_id BIGINT, estimate DOUBLE, shared_shingles BIGINT, containment DOUBLE")
    # A document or item that comes in several rows with different texts counts with the best of them.
    return exact.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("shared_shingles", "containment", "estimate")])
