"""Frames of TIFF files as pages, and stages of runs as a table."""

import struct
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from quire.operators import events
from quire.params import Documents
from quire.sources import documents, tiff


def tiff_file(frames, order="<"):
    """A TIFF file of (pixels, compression, meaning, bits) frames, one strip each."""
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 0))
    link = 4
    for pixels, packing, meaning, bits in frames:
        h, w, s = pixels.shape
        raw = (np.packbits(pixels[:, :, 0], axis=1) if bits == 1 else pixels).tobytes()
        data = zlib.compress(raw) if packing == 8 else b"".join(bytes([len(raw[i : i + 128]) - 1]) + raw[i : i + 128] for i in range(0, len(raw), 128)) if packing == 32773 else raw
        at = len(out)
        out += data
        wide = len(out)
        out += struct.pack(order + f"{s}H", *[bits] * s) if s > 2 else b""
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        short = lambda t, v: struct.pack(order + "HHIHH", t, 3, 1, v, 0)
        long = lambda t, v: struct.pack(order + "HHII", t, 4, 1, v)
        entries = [long(256, w), long(257, h), struct.pack(order + "HHII", 258, 3, s, wide) if s > 2 else short(258, bits), short(259, packing), short(262, meaning), long(273, at), short(277, s), long(278, h), long(279, len(data))]
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


def grey(value, h=20, w=30):
    return np.full((h, w, 1), value, np.uint8)


def test_every_frame_is_a_page(spark, tmp_path):
    colour = np.zeros((10, 12, 3), np.uint8) + np.array([10, 200, 30], np.uint8)
    half = grey(1)
    half[:, :15] = 0
    for name, order in (("a.tif", "<"), ("B.TIFF", ">")):
        (tmp_path / name).write_bytes(tiff_file([(grey(255), 1, 1, 8), (grey(0), 8, 1, 8), (colour, 32773, 2, 8), (half, 1, 1, 1), (half, 1, 0, 1), (grey(7), 5, 1, 8)], order))
    (tmp_path / "one.tif").write_bytes(tiff_file([(grey(255), 1, 1, 8)]))
    (tmp_path / "broken.tif").write_bytes(tiff_file([(grey(255), 1, 1, 8), (grey(9), 1, 1, 8)])[:-6])
    (tmp_path / "not.tif").write_bytes(b"II*")
    rows = documents.image_pages(spark, str(tmp_path), Documents(max_dimension=25)).collect()
    got = {(r["doc"].rsplit("/", 1)[-1], r["page_number"]): r for r in rows}
    assert len(got) == len(rows) == 6 + 6 + 1 + 2 + 1
    assert len({r["doc"] for r in rows}) == 5
    for name in ("a.tif", "B.TIFF"):
        assert [got[name, n]["ink"] for n in (1, 2, 3)] == [0.0, 1.0, 1.0]
        assert (got[name, 2]["width"], got[name, 3]["width"]) == (25, 12) and got[name, 4]["ink"] == pytest.approx(0.5, abs=0.03) and got[name, 5]["ink"] == pytest.approx(0.5, abs=0.03)
        assert "compression 5" in got[name, 6]["error"] and got[name, 6]["image"] is None
    assert got["broken.tif", 2]["error"] and got["not.tif", 1]["error"]


def test_colours_and_differences():
    colour = np.zeros((2, 3, 3), np.uint8) + np.array([1, 2, 3], np.uint8)
    (tags,) = tiff.frames(tiff_file([(colour, 1, 2, 8)]))
    assert tiff.pixels(tags, [colour.tobytes()])[0, 0].tolist() == [3, 2, 1]
    step = np.array([[[5], [1], [255]]], np.uint8)
    assert tiff.pixels({256: [3], 257: [1], 258: [8], 262: [1], 317: [2]}, [step.tobytes()])[0, :, 0].tolist() == [5, 6, 5]
    palette = {256: [2], 257: [1], 258: [8], 262: [3], 320: [257 * i for i in range(3 * 256)]}
    palette[320] = [257 * v for v in (*range(256), *([9] * 256), *([4] * 256))]
    assert tiff.pixels(palette, [bytes([7, 0])])[0].tolist() == [[4, 9, 7], [4, 9, 0]]
    with pytest.raises(ValueError):
        tiff.pixels({256: [30], 257: [20], 258: [8]}, [b"short"])


def test_stages_are_appended_as_they_happen(spark, tmp_path):
    table = events.StageTable(spark, f"{tmp_path}/stages", "r1")
    with table.stage("read") as watch:
        watch(spark.range(1000)).write.parquet(f"{tmp_path}/out")
    with pytest.raises(ZeroDivisionError), table.stage("fuse"):
        1 / 0
    table.skip("model", "no server")
    with table.stage("fuse") as watch:
        watch(spark.range(10))  # never read
    got = {r["stage"]: r for r in events.stage_timings(table.events()).collect()}
    assert (got["read"]["status"], got["read"]["rows"], got["read"]["attempts"]) == ("completed", 1000, 1) and got["read"]["seconds"] > 0
    assert (got["fuse"]["status"], got["fuse"]["attempts"], got["fuse"]["rows"]) == ("completed", 2, None)
    assert (got["model"]["status"], got["model"]["seconds"], got["model"]["attempts"]) == ("skipped", None, 0)
    assert table.events().filter(F.col("detail").contains("division")).count() == 1
    assert events.stage_timings(table.events().limit(0)).count() == 0
