"""Images in pieces, read back."""

import re
import xml.etree.ElementTree as ET

import numpy as np

from gridloom.sources import cells as source
from gridloom.sources import pieces, sinks
from gridloom.spec import GridSpec


def test_pieces_hold_the_field(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pieces, "CHUNK", 12)
    monkeypatch.setattr(sinks, "CHUNK", 12)
    grid = GridSpec(5, 7, 11, (0.5, 1.0, 2.0), (1.0, 0.0, -3.0))
    field = source.dense(spark, grid).withColumn("v", source.linear(grid, 0, 1)).filter("z <> 4 AND (x + y) % 3 <> 0").selectExpr("*", "v * 0.25 AS w")
    for _ in range(2):
        assert pieces.write_pieces(f"file://{tmp_path}/out", field, grid, {"a": ["v"], "b": ["v", "w", "x"]}, 3, -1.0) == 4
    assert sorted(f.name for f in (tmp_path / "out").iterdir() if not f.name.startswith(".")) == ["image.pvti", *[f"piece-{k}.vti" for k in range(4)]]
    top = ET.parse(tmp_path / "out" / "image.pvti").getroot()
    assert top.attrib["type"] == "PImageData" and [p.attrib["Source"] for p in top.iter("Piece")] == [f"piece-{k}.vti" for k in range(4)]
    a, b, at = [], [], 0
    for p in top.iter("Piece"):
        own = ET.parse(tmp_path / "out" / p.attrib["Source"]).getroot()
        piece = next(own.iter("Piece"))
        assert piece.attrib["Extent"] == p.attrib["Extent"] and next(own.iter("ImageData")).attrib["WholeExtent"] == "0 5 0 7 0 11"
        low, high = map(int, p.attrib["Extent"].split()[4:])
        assert low == at
        at = high
        arrays = {d.attrib["Name"]: np.array(d.text.split(), float) for d in own.iter("DataArray")}
        a.append(arrays["a"].reshape(-1, 7, 5))
        b.append(arrays["b"].reshape(-1, 7, 5, 3))
        assert (high - low) == len(a[-1]) == len(b[-1])
    want = source.to_dense(spark, grid, field, ["v", "w"])
    rows = {(r.x, r.y, r.z) for r in field.collect()}
    there = np.array([[[(x, y, z) in rows for x in range(5)] for y in range(7)] for z in range(11)])
    a, b = np.concatenate(a), np.concatenate(b)
    assert (a == np.where(there, want[0], -1)).all() and (b[..., 1] == np.where(there, want[1], -1)).all()
    assert re.search(r'Origin="1 0 -3" Spacing="0.5 1 2"', (tmp_path / "out" / "piece-2.vti").read_text())
