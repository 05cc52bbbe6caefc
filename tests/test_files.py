"""File scans, EXIF, palettes, manifests, streams, edit logs and grouping on hand-made inputs."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalith.operators import state
from catalith.operators.grouping import complete_link
from catalith.operators.palette import extract, palettes
from catalith.sources.exif import exif, parse
from catalith.sources.files import data_url, scan, write_manifest
from catalith.streaming.ingest import apply_batches, reject_stale, snapshots


def jpeg(order="<"):
    entries, extra = [], b""

    def add(tag, kind, count, raw):
        nonlocal extra
        if len(raw) > 4:
            at = 8 + 2 + 12 * 7 + 4 + len(extra)
            extra += raw
            raw = struct.pack(order + "I", at)
        entries.append(struct.pack(order + "HHI", tag, kind, count) + raw.ljust(4, b"\0"))

    add(0x010F, 2, 7, b"Velmar\0")
    add(0x0110, 2, 3, b"Q7\0")
    add(0x0112, 3, 1, struct.pack(order + "H", 6))
    add(0x0132, 2, 20, b"2013:10:09 07:29:20\0")
    add(0x829A, 5, 1, struct.pack(order + "II", 1, 250))
    add(0x829D, 5, 1, struct.pack(order + "II", 28, 10))
    add(0x8827, 3, 1, struct.pack(order + "H", 400))
    tiff = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + struct.pack(order + "H", 7) + b"".join(entries) + b"\0" * 4 + extra
    body = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda"


def test_exif(spark):
    for order in "<>":
        x = parse(jpeg(order))
        assert (x["camera_make"], x["camera_model"], x["orientation"], x["capture_time"], x["exposure_time"], x["aperture"], x["iso"]) == ("Velmar", "Q7", 6, "2013-10-09T07:29:20", "1/250", 2.8, 400)
    for bad in (None, b"", b"junk", jpeg()[:40], b"II*\0" + b"\xff" * 20):
        assert parse(bad)["camera_make"] is None
    rows = spark.createDataFrame([(bytearray(jpeg()),), (None,)], "content BINARY").select(exif("content").alias("x")).collect()
    assert {r.x.iso for r in rows} == {400, None}


def test_scan_and_manifest(spark, tmp_path):
    for name, body in (("a.JPG", jpeg()), ("notes.txt", b"x"), ("中文/b.png", b"y"), ("nested/c.webp", b"z"), ("broken.jpeg", b"?"), ("empty.jpg", b"")):
        (tmp_path / "photos" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "photos" / name).write_bytes(body)
    root = str(tmp_path / "photos")
    found = {r.relative_path: r for r in scan(spark, root, nested=[root + "/nested"]).collect()}
    assert set(found) == {"a.JPG", "中文/b.png", "broken.jpeg"} and found["a.JPG"].extension == "jpg" and found["中文/b.png"].file_size == 1
    assert len(found["a.JPG"].fingerprint) == 64
    plan = spark.createDataFrame([(1, "a")], "id INT, path STRING")
    with pytest.raises(ValueError):
        write_manifest(plan, root + "/out", [root])
    write_manifest(plan, str(tmp_path / "out"), [root])
    with pytest.raises(Exception, match="exists"):
        write_manifest(plan, str(tmp_path / "out"), [root])
    long = spark.range(1).select(data_url(F.lit(b"x" * 100)).alias("u")).first().u
    assert "\n" not in long and spark.range(1).select(data_url(F.lit(b"xx"), most=1).alias("u")).first().u is None


def test_palettes(spark):
    red, blue = 0xFF0000, 0x0000FF
    got = extract(np.array([red] * 70 + [blue] * 30))
    assert [(c, round(a, 2)) for c, a, _ in got] == [("#ff0000", 0.7), ("#0000ff", 0.3)]
    rows = palettes(spark.createDataFrame([(1, [red, red, blue]), (2, []), (3, None)], "id BIGINT, pixels ARRAY<INT>")).collect()
    assert [(r.id, r.rank, r.rgb) for r in sorted(rows, key=lambda r: r.rank)] == [(1, 0, "#ff0000"), (1, 1, "#0000ff")]


def test_complete_link_splits_a_bridge(spark):
    at = lambda d: [float(np.cos(np.radians(d))), float(np.sin(np.radians(d)))]
    rows = spark.createDataFrame([(1, 1, at(0)), (1, 2, at(20)), (1, 3, at(40))], "component BIGINT, id BIGINT, vector ARRAY<DOUBLE>")
    assert {(r.id, r.grp, r.size) for r in complete_link(rows, 0.9).collect()} == {(1, 1, 2), (2, 1, 2)}


def test_edit_log_and_upsert(spark):
    log = spark.createDataFrame([(1, "tone", "low", "1"), (1, "tone", None, "2"), (2, "tone", "low", "1"), (2, "tone", "high", "3")], "asset_id INT, field STRING, value STRING, at STRING")
    assert [(r.asset_id, r.value) for r in state.fold_log(log, ["asset_id", "field"], "at", "value").collect()] == [(2, "high")]
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "id INT, v STRING"), spark.createDataFrame([(2, "c"), (3, "d")], "id INT, v STRING")
    assert sorted(map(tuple, state.upsert(old, new, "id").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    got = spark.createDataFrame([("running",), ("completed",)], "s STRING").select(state.recovered(F.col("s")).alias("s")).collect()
    assert [r.s for r in got] == ["interrupted", "completed"]


def test_stream_resumes_and_rejects_stale(spark, tmp_path):
    inbox, seen = str(tmp_path / "inbox"), []
    rows = spark.createDataFrame([(1, "f1"), (2, "old")], "asset_id BIGINT, source_fingerprint STRING")
    rows.write.parquet(inbox)
    now = spark.createDataFrame([(1, "f1"), (2, "f2")], "id BIGINT, fingerprint STRING")

    def apply(batch, number):
        seen.extend(r.asset_id for r in reject_stale(batch, now).collect())

    for _ in range(2):  # the second run finds nothing new
        apply_batches(snapshots(spark, inbox, rows.schema), apply, str(tmp_path / "progress")).awaitTermination()
    assert seen == [1]
