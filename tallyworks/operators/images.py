"""Operators on page images: ink projections, bands, regions, dominant colours.

Pixels of an image are one row's array; the work is numpy inside a vectorised function,
and images are dealt out by row, so nothing is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

INK, BACKGROUND = 150, 245


def runs(counts: np.ndarray, least: int, gap: int, size: int) -> list[tuple[int, int]]:
    """[start, end) of places with ``least`` counts or more; gaps of up to ``gap`` are closed; runs below ``size`` are dropped."""
    at = np.nonzero(counts >= least)[0]
    if not len(at):
        return []
    cut = np.nonzero(np.diff(at) > gap + 1)[0]
    ends = zip(at[np.concatenate(([0], cut + 1))].tolist(), (at[np.concatenate((cut, [len(at) - 1]))] + 1).tolist(), strict=True)
    return [(a, b) for a, b in ends if b - a >= size]


def ink(image: np.ndarray) -> np.ndarray:
    return image.astype(np.float64) @ np.array([0.299, 0.587, 0.114]) < INK


def regions(image: np.ndarray, least: int = 2, gap: int = 6, size: int = 12, filled: int = 24) -> list[tuple[int, int, int, int]]:
    """Boxes (x0, y0, x1, y1) where a band of rows and a band of columns with ink meet and have ink themselves."""
    dark = ink(image)
    boxes = [(x0, y0, x1, y1) for y0, y1 in runs(dark.sum(1), least, gap, size) for x0, x1 in runs(dark.sum(0), least, gap, size)]
    total = np.pad(dark.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return [b for b in boxes if total[b[3], b[2]] - total[b[1], b[2]] - total[b[3], b[0]] + total[b[1], b[0]] >= filled]


def dominant(image: np.ndarray, levels: int = 16, least: int = 8) -> str | None:
    """The mean colour, as hex, of the heaviest bucket of quantised colours; buckets near white weigh nothing."""
    p = image.reshape(-1, 3).astype(np.int64)
    p = p[(p < BACKGROUND).any(1)]
    if len(p) < least:
        return None
    q = p * levels // 256
    bucket = (q[:, 0] * levels + q[:, 1]) * levels + q[:, 2]
    spread = p.max(1) - p.min(1)
    weight = np.bincount(bucket, 1 + spread / 255, levels**3)
    best = int(weight.argmax())
    if (bucket == best).sum() < least:
        return None
    return "".join(f"{int(v):02x}" for v in np.floor(p[bucket == best].mean(0) + 0.5))


def descriptor(image: np.ndarray, bins: int = 8, least: int = 18) -> dict | None:
    """Aspect and fill of what stands out from the background, and its shares in ``bins`` columns and rows."""
    part = (image < BACKGROUND).any(2)
    y, x = np.nonzero(part)
    if len(x) < least:
        return None
    w, h = x.max() - x.min() + 1, y.max() - y.min() + 1
    share = lambda v, lo, n: (np.bincount(np.minimum((v - lo) * bins // n, bins - 1), minlength=bins) / len(v)).tolist()
    return {"aspect_ratio": float(w / h), "fill_ratio": float(len(x) / (w * h)), "rgb": dominant(image, 18), "x_hist": share(x, x.min(), w), "y_hist": share(y, y.min(), h)}


def cards(pages: DataFrame) -> DataFrame:
    """(manual_id, page_number, card_index, x0, y0, x1, y1, rgb) of pages(manual_id, page_number, width, height, pixels); pixels are RGB bytes."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                image = np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, 3)
                for i, (x0, y0, x1, y1) in enumerate(regions(image)):
                    out.append((r.manual_id, r.page_number, i, x0, y0, x1, y1, dominant(image[y0:y1, x0:x1])))
            yield pd.DataFrame({c: pd.Series([o[k] for o in out], dtype=object if c in ("manual_id", "rgb") else "int32") for k, c in enumerate(("manual_id", "page_number", "card_index", "x0", "y0", "x1", "y1", "rgb"))})

    return pages.select("manual_id", "page_number", "width", "height", "pixels").mapInPandas(find, "manual_id string, page_number int, card_index int, x0 int, y0 int, x1 int, y1 int, rgb string")
