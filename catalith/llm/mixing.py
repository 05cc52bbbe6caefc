"""Mixing sources to target shares of tokens by pivotal dependent rounding."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialise
from .common import fan_out
from .kmeans import unit_random

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"  #: used where neither a call nor spark.catalith.tokenizer names one
MOST_SOURCES = 10_000  #: rows of targets, which are planned on the driver
CHUNK = 20_000  #: documents that one task rounds together
FAN_IN = 64  #: residuals that one node of the reduction tree combines
_OUT = "source STRING, node BIGINT, doc_id BIGINT, tokens BIGINT, mass DOUBLE, final BOOLEAN"


def count_tokens(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """`documents` (doc_id, source, text) with `tokens` of the whole text instead of the text; null and empty texts have none.

    tokenizer: path of a tokenizer file that all executors see. It is loaded once a task; texts are encoded in batches.
    """

    tokenizer = tokenizer or documents.sparkSession.conf.get("spark.catalith.tokenizer", TOKENIZER)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        coder = Tokenizer.from_file(tokenizer)
        coder.encode_special_tokens = True
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            n: list[int] = []
            for at in range(0, len(texts), 256):
                n += [len(e) for e in coder.encode_batch_fast(texts[at : at + 256], add_special_tokens=False)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": n})

    return fan_out(documents.select("doc_id", "source", "text")).mapInPandas(run, "doc_id BIGINT, source STRING, tokens BIGINT")


def pivotal(mass: np.ndarray, tokens: np.ndarray, ids: np.ndarray, seed: int) -> np.ndarray:
    """Pair fractional probabilities and move token mass between the two until one is 0 or 1; at most one stays fractional.

    A pair moves along the line that keeps tokens * probability constant, to one end or the other with the chances
    that keep both expectations. The order and the chances come from ids; all tokens are positive.
    """
    p = mass.copy()
    u = unit_random(ids, seed)
    held = -1
    for i in np.argsort(unit_random(ids, seed + 1), kind="stable"):
        if not 0 < p[i] < 1:
            continue
        if held < 0:
            held = i
            continue
        a, b, ta, tb = p[held], p[i], tokens[held], tokens[i]
        up = min((1 - a) * ta, b * tb)  # tokens that may move from i to held
        down = min(a * ta, (1 - b) * tb)
        moved = up if u[i] * (up + down) < down else -down
        p[held], p[i] = a + moved / ta, b - moved / tb
        for x in (held, i):
            if p[x] < 1e-12:
                p[x] = 0.0
            elif p[x] > 1 - 1e-12:
                p[x] = 1.0
        held = held if 0 < p[held] < 1 else i if 0 < p[i] < 1 else -1
    return p


def _node(seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        out = pdf[["source", "node", "doc_id", "tokens"]].copy()
        out["mass"] = pivotal(pdf["mass"].to_numpy(float), pdf["tokens"].to_numpy(float), pdf["doc_id"].to_numpy(), seed)
        out["final"] = out["mass"].isin([0.0, 1.0])
        return out

    return run


def plan(sizes: list[tuple[str, int]], targets: list[tuple[str, float, int]], total: int | None = None) -> list[dict]:
    """Per source its wanted tokens and copies per document.

    Targets are at most a few hundred rows. Sources with a share but without tokens cannot take part: their share goes
    to the others in proportion. Without `total` the mix is the largest in which every source keeps its share within
    its cap; with a larger `total` capped sources fall short, and the report says so.
    """
    have = dict(sizes)
    rows = [(s, share, cap) for s, share, cap in targets if s is not None and share and share > 0 and cap and cap > 0 and have.get(s, 0) > 0]
    whole = sum(share for _, share, _ in rows)
    if not rows:
        return []
    most = min(have[s] * cap / (share / whole) for s, share, cap in rows)
    total = most if total is None else total
    return [{"source": s, "share": share / whole, "cap": int(cap), "copies": min(float(cap), share / whole * total / have[s])} for s, share, cap in rows]


def _settled(chosen: DataFrame, short: DataFrame) -> DataFrame:
    """(doc_id, extra) changed for at most one document a source: the copy whose tokens come nearest to what the source is short of, or over by.

    chosen (source, doc_id, tokens, extra 0 or 1), short (source, short: tokens, negative where there are too many).
    """
    x = chosen.join(F.broadcast(short), "source").where(F.col("extra") == F.when(F.col("short") > 0, 0).otherwise(1))
    rest = F.abs(F.col("short")) - F.col("tokens")
    best = x.groupBy("source").agg(F.min(F.struct(F.abs(rest).alias("left"), "doc_id", "extra")).alias("b"), F.first("short").alias("short"))
    best = best.where(F.col("b.left") < F.abs(F.col("short"))).select(F.col("b.doc_id").alias("doc_id"), (1 - F.col("b.extra")).alias("change"))
    return chosen.join(F.broadcast(best), "doc_id", "left").select("doc_id", F.coalesce("change", "extra").alias("extra"))


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, tokenizer: str | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The mix (doc_id, source, tokens, copies) and its report (source, target_share, reached_share, tokens, documents, copies, max_copies).

    documents (doc_id unique, source, text), targets (source, target_share, max_repeats; at most MOST_SOURCES rows, else
    ValueError; a repeated source counts with its greatest share). Every document of a source gets floor(c) or
    floor(c) + 1 copies, c the copies its source needs; which one is decided by pivotal rounding of the fractions, in
    chunks of CHUNK documents, whose single residuals are combined FAN_IN at a time up a tree. The one that is left is
    rounded, and one copy of the source is added or dropped where that brings its tokens nearer to the target: a source
    is off by no more than half a document of its own, and by far less where it has many. No document is repeated above
    its cap, and the outcome depends on ids and `seed` only. Sources without target, null sources and documents without
    tokens are left out; targets without documents are reported with share 0; empty tables give an empty mix.
    """
    spark = documents.sparkSession
    docs = documents.where("doc_id is not null and source is not null").select("doc_id", "source", "text")
    wanted = targets.where("source is not null").groupBy("source").agg(F.max(F.struct(F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("cap"))).alias("w")).select("source", "w.share", "w.cap")
    goal = sorted(tuple(r) for r in wanted.limit(MOST_SOURCES + 1).collect())
    if len(goal) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    goal_df = F.broadcast(spark.createDataFrame(goal, "source STRING, target_share DOUBLE, max_repeats INT"))
    sized = materialise(count_tokens(docs.join(goal_df.select("source"), "source", "left_semi"), tokenizer).where("tokens > 0"), "tokens")
    sums = sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).collect()  # one row per target source
    steps = plan([(r["source"], r["tokens"]) for r in sums], goal, total)
    steps_df = spark.createDataFrame([(p["source"], p["share"], p["cap"], p["copies"]) for p in steps], "source STRING, share DOUBLE, cap INT, copies DOUBLE")
    rows = sized.join(F.broadcast(steps_df), "source").withColumns({"base": F.floor(F.col("copies") + 1e-12).cast("int")})
    rows = rows.withColumn("mass", F.greatest(F.lit(0.0), F.col("copies") - F.col("base")))
    chunks = {r["source"]: -(-r["n"] // CHUNK) for r in sums}
    n_chunks = F.coalesce(F.create_map(*[F.lit(v) for kv in chunks.items() for v in kv])[F.col("source")], F.lit(1)) if chunks else F.lit(1)
    level = rows.where("mass > 0").select("source", F.pmod(F.xxhash64("doc_id"), n_chunks).alias("node"), "doc_id", "tokens", "mass")
    decided: list[DataFrame] = []
    width, depth = max([1, *chunks.values()]), 0
    while True:
        done = materialise(level.groupBy("source", "node").applyInPandas(_node(seed + 10 * depth), _OUT), "rounded", open=F.count_if(~F.col("final")))
        take = F.round("mass").cast("int").alias("extra")
        decided.append(done.where("final").select("source", "doc_id", "tokens", take))
        rest = done.where("not final")
        if width == 1 or not done.measured["open"]:
            decided.append(rest.select("source", "doc_id", "tokens", take))  # at most one residual a source
            break
        width, depth = -(-width // FAN_IN), depth + 1
        level = rest.select("source", F.floor(F.col("node") / FAN_IN).alias("node"), "doc_id", "tokens", "mass")
    chosen = decided[0]
    for x in decided[1:]:
        chosen = chosen.unionByName(x)
    mass = {p["source"]: p["copies"] - math.floor(p["copies"] + 1e-12) for p in steps}
    got = {r["source"]: r["t"] for r in chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("extra")).alias("t")).collect()}  # one row per target source
    short = [(r["source"], mass[r["source"]] * r["tokens"] - got[r["source"]]) for r in sums if r["source"] in got]
    extra = _settled(chosen, spark.createDataFrame(short, "source STRING, short DOUBLE"))
    mixed = rows.join(extra, "doc_id", "left").select("doc_id", "source", "tokens", (F.col("base") + F.coalesce("extra", F.lit(0))).alias("copies"))
    mixed = materialise(mixed.where("copies > 0"), "mixed", all=F.sum(F.col("tokens") * F.col("copies")))
    discard(sized)
    whole = mixed.measured["all"] or 1
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.sum("copies").alias("copies"), F.max("copies").alias("max_copies"))
    zero = F.lit(0).cast("bigint")
    report = spark.createDataFrame(goal, "source STRING, target_share DOUBLE, cap INT").join(got, "source", "left")
    report = report.select("source", "target_share", (F.coalesce("tokens", zero) / F.lit(float(whole))).alias("reached_share"), *[F.coalesce(c, zero).cast("bigint").alias(c) for c in ("tokens", "documents", "copies", "max_copies")], F.col("cap").alias("max_repeats"))
    return mixed, report
