"""Image regions: operators on pixel arrays, applied to PNG and TIFF bytes in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..errors import REDACTION, VeilError
from ..plans.policy import Redaction
from ..sources.files import picture_bytes, picture_pages


def _color(text: str) -> tuple[int, int, int]:
    h = text.lstrip("#")
    return tuple(int(h[i : i + 2], 16) for i in (0, 2, 4))


def _blurred(region: np.ndarray, sigma: float) -> np.ndarray:
    reach = max(1, int(np.ceil(3 * sigma)))
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    k /= k.sum()
    out = region.astype(np.float64)
    for axis in (0, 1):
        pad = [(reach, reach) if a == axis else (0, 0) for a in range(3)]
        wide = np.pad(out, pad, mode="edge")
        out = sum(w * np.take(wide, range(i, i + out.shape[axis]), axis=axis) for i, w in enumerate(k))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def apply(pixels: np.ndarray, box: tuple[int, int, int, int], r: Redaction) -> np.ndarray:
    """``pixels`` (height x width x channels) with operator ``r`` on the region (x, y, w, h), cut to the picture."""
    x, y, w, h = box
    x0, y0, x1, y1 = max(0, x), max(0, y), min(pixels.shape[1], x + w), min(pixels.shape[0], y + h)
    out = pixels.copy()
    if x0 >= x1 or y0 >= y1 or r.kind == "keep":
        return out
    region = out[y0:y1, x0:x1]
    color = out.shape[2] - (out.shape[2] in (2, 4))  # without alpha
    if r.kind == "erase":
        region[...] = 255
    elif r.kind == "blackbox":
        red, green, blue = _color(r["color"])
        region[..., :color] = (red, green, blue) if color == 3 else (red * 299 + green * 587 + blue * 114) // 1000
        if color < out.shape[2]:
            region[..., color] = 255
    elif r.kind == "blur":
        region[...] = _blurred(region, float(r["sigma"]))
    elif r.kind == "pixelate":
        n = int(r["block_size"])
        for j in range(0, region.shape[0], n):
            for i in range(0, region.shape[1], n):
                block = region[j : j + n, i : i + n]
                block[...] = np.rint(block.reshape(-1, block.shape[2]).mean(0)).astype(np.uint8)
    else:
        raise VeilError(REDACTION, f"no image operator {r.kind!r}")
    return out


def redact_images(df: DataFrame, r: Redaction, content_col: str = "content", regions_col: str = "regions") -> DataFrame:
    """``df`` with operator ``r`` on each of a picture's regions (array<struct<x,y,w,h>>, with page for TIFF pages after the first); without regions the bytes stay as they are."""
    at, boxes = df.columns.index(content_col), df.columns.index(regions_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data, regions in zip(b.column(at).to_pylist(), b.column(boxes).to_pylist()):
                if data is not None and regions and r.kind != "keep":
                    pages = picture_pages(data)
                    for g in regions:
                        k = g.get("page") or 0
                        if k < len(pages):
                            pages[k] = apply(pages[k], (g["x"], g["y"], g["w"], g["h"]), r)
                    data = picture_bytes(pages, data)
                out.append(data)
            columns = list(b.columns)
            columns[at] = pa.array(out, pa.binary())
            yield pa.record_batch(columns, b.schema.names)

    return df.mapInArrow(run, df.schema)
