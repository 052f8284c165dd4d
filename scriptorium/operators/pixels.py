"""Image leaf operators on arrays: small numpy helpers, applied to rows (stem, h, w, data binary of grey bytes) in Arrow batches.

An image is one row; nothing here decodes files. Resizing, blurring and edges follow the textbook
definitions, so results are close to, not bit-identical with, those of image libraries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from scriptorium.sources.shared import cut

FEATURES = [
    "pixel_density", "foreground_fraction", "noise_coefficient", "mean_stroke_width", "aspect_ratio", "horizontal_projection_variance",
    "vertical_projection_variance", "edge_density", "local_contrast", "n_components", "mean_gap_px", "std_gap_px", "image_height_px", "image_width_px",
]


def as_image(h: int, w: int, data: bytes | None) -> np.ndarray | None:
    """The grey image, or None where the bytes don't make one."""
    if data is None or h is None or w is None or h <= 0 or w <= 0 or len(data) != h * w:
        return None
    return np.frombuffer(data, np.uint8).reshape(int(h), int(w))


def otsu(grey: np.ndarray) -> int:
    """The threshold with the greatest variance between the two classes; the first of equal ones."""
    n = np.bincount(grey.ravel(), minlength=256).astype(float)
    below, total = np.cumsum(n), n.sum()
    mean_below, mean = np.cumsum(n * np.arange(256)), (n * np.arange(256)).sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mean * below - total * mean_below) ** 2 / (below * (total - below))
    return int(np.argmax(np.nan_to_num(between, nan=-1.0, posinf=-1.0)))


def blur(grey: np.ndarray, k: int) -> np.ndarray:
    """Gaussian blur with an odd kernel of k, reflected at the edges."""
    if k <= 1:
        return grey
    sigma, r = 0.3 * ((k - 1) * 0.5 - 1) + 0.8, k // 2
    kernel = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    kernel /= kernel.sum()
    out = grey.astype(float)
    for axis in (0, 1):
        pad = [(r, r) if a == axis else (0, 0) for a in (0, 1)]
        wide = np.pad(out, pad, mode="reflect" if out.shape[axis] > r else "edge")
        n = out.shape[axis]
        out = sum(v * (wide[i : i + n] if axis == 0 else wide[:, i : i + n]) for i, v in enumerate(kernel))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def resize(grey: np.ndarray, h: int, w: int) -> np.ndarray:
    """Area means when shrinking, and linear interpolation otherwise, along each axis."""
    out = grey.astype(float)
    for axis, size in ((0, h), (1, w)):
        n = out.shape[axis]
        if size < n:
            edges = np.linspace(0, n, size + 1)
            sums = np.concatenate([np.zeros_like(np.take(out, [0], axis)), np.cumsum(out, axis)], axis)
            low = np.minimum(edges.astype(int), n - 1)
            part = (edges - low).reshape([-1, 1] if axis == 0 else [1, -1])
            upto = np.take(sums, low, axis) + part * np.take(out, low, axis)
            out = np.diff(upto, axis=axis) / (n / size)
        elif size > n:
            at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
            low = at.astype(int)
            part = (at - low).reshape([-1, 1] if axis == 0 else [1, -1])
            out = np.take(out, low, axis) * (1 - part) + np.take(out, np.minimum(low + 1, n - 1), axis) * part
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def ellipse(k: int) -> np.ndarray:
    r = (k - 1) / 2
    y, x = np.ogrid[:k, :k]
    return ((y - r) ** 2 + (x - r) ** 2 <= (r + 0.25) ** 2) if k > 1 else np.ones((1, 1), bool)


def dilate(mask: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    kh, kw = kernel.shape
    wide = np.pad(mask, ((kh // 2, kh - 1 - kh // 2), (kw // 2, kw - 1 - kw // 2)))
    out = np.zeros_like(mask)
    for y, x in zip(*np.nonzero(kernel[::-1, ::-1]), strict=True):
        out |= wide[y : y + mask.shape[0], x : x + mask.shape[1]]
    return out


def erode(mask: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    return ~dilate(~np.pad(mask, kernel.shape, constant_values=True), kernel[::-1, ::-1])[
        kernel.shape[0] : kernel.shape[0] + mask.shape[0], kernel.shape[1] : kernel.shape[1] + mask.shape[1]
    ]


def close(mask: np.ndarray, k: int) -> np.ndarray:
    kernel = ellipse(k)
    return erode(dilate(mask, kernel), kernel) | mask


def thin(mask: np.ndarray) -> np.ndarray:
    """Zhang-Suen thinning: border pixels go, in two half-steps, until none can."""
    out = np.pad(mask, 1).astype(np.uint8)
    while True:
        gone = 0
        for half in (0, 1):
            c = out[1:-1, 1:-1]
            p = [out[:-2, 1:-1], out[:-2, 2:], out[1:-1, 2:], out[2:, 2:], out[2:, 1:-1], out[2:, :-2], out[1:-1, :-2], out[:-2, :-2]]
            around = sum(x.astype(int) for x in p)
            turns = sum(((p[i] == 0) & (p[(i + 1) % 8] == 1)).astype(int) for i in range(8))
            n, e, s, w = p[0], p[2], p[4], p[6]
            sides = (n & e & s) | (e & s & w) if half == 0 else (n & e & w) | (n & s & w)
            drop = (c == 1) & (around >= 2) & (around <= 6) & (turns == 1) & (sides == 0)
            gone += int(drop.sum())
            c[drop] = 0
        if not gone:
            return out[1:-1, 1:-1].astype(bool)


def components(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(x1, y1, x2, y2, area) of the 8-connected components, ends exclusive: runs of rows joined by union-find."""
    parent: list[int] = []
    boxes: list[list[int]] = []

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    above: list[tuple[int, int, int]] = []
    for y in range(mask.shape[0]):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask[y].astype(np.int8), [0]])))
        row = []
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            own = len(parent)
            parent.append(own)
            boxes.append([a, y, b, y + 1, b - a])
            for c, d, other in above:
                if c <= b and d >= a:
                    p, q = find(own), find(other)
                    if p != q:
                        p, q = min(p, q), max(p, q)
                        parent[q] = p
            row.append((a, b, own))
        above = row
    out: dict[int, list[int]] = {}
    for k, (a, y, b, z, n) in enumerate(boxes):
        box = out.setdefault(find(k), [a, y, b, z, 0])
        box[:] = [min(box[0], a), min(box[1], y), max(box[2], b), max(box[3], z), box[4] + n]
    return [tuple(x) for x in out.values()]


def binarise(grey: np.ndarray, height: int, smoothing: int) -> np.ndarray:
    """Ink of a line scaled to `height`: blurred, below Otsu's threshold, and turned round if ink were the larger part."""
    scaled = resize(grey, height, max(1, int(grey.shape[1] * height / grey.shape[0])))
    smooth = blur(scaled, smoothing if smoothing % 2 else smoothing + 1)
    ink = smooth <= otsu(smooth)
    return ~ink if ink.mean() * 255 > 127 else ink


def skeleton(ink: np.ndarray, close_k: int, dilations: int) -> np.ndarray:
    out = thin(close(ink, close_k))
    for _ in range(dilations):
        out = dilate(out, np.ones((3, 3), bool))
    return out


def rough_skeleton(ink: np.ndarray, close_k: int, dilations: int, least: int = 30) -> np.ndarray:
    """Each component's box by itself; boxes under `least` square pixels are left out."""
    out = np.zeros_like(ink)
    for x1, y1, x2, y2, _ in components(ink):
        if (x2 - x1) * (y2 - y1) >= least:
            out[y1:y2, x1:x2] |= skeleton(ink[y1:y2, x1:x2], close_k, dilations)
    return out


def dark_background(grey: np.ndarray, share: float = 0.05) -> bool:
    """Two of three votes: mean of the corners, mean of the border, and the smoothed histogram's darker half."""
    h, w = grey.shape
    p = max(5, int(min(h, w) * share))
    corners = np.mean([grey[:p, :p].mean(), grey[:p, w - p :].mean(), grey[h - p :, :p].mean(), grey[h - p :, w - p :].mean()])
    border = np.concatenate([grey[:p].ravel(), grey[-p:].ravel(), grey[:, :p].ravel(), grey[:, -p:].ravel()]).mean()
    smooth = np.convolve(np.bincount(grey.ravel(), minlength=256), np.ones(15) / 15, "same")
    return int(corners < 128) + int(border < 128) + int(smooth[:128].sum() > smooth[128:].sum()) >= 2


def glyph_skeleton(grey: np.ndarray, close_k: int = 3, dilate_k: int = 3, least: int = 50) -> np.ndarray | None:
    """A glyph's skeleton, or None with fewer than `least` ink pixels."""
    norm = 255 - grey if dark_background(grey) else grey
    ink = norm <= otsu(norm)
    if ink.sum() < least:
        return None
    return thin(dilate(close(ink, close_k), ellipse(dilate_k)))


def crop(lines: np.ndarray, x1: int, x2: int, pad: int, size: int) -> np.ndarray | None:
    """The columns [x1 - pad, x2 + pad) on a square canvas, shrunk by the nearest pixel if they don't fit, centred and inverted."""
    part = lines[:, max(0, x1 - pad) : min(lines.shape[1], x2 + pad)]
    h, w = part.shape
    if not h or not w:
        return None
    if h > size or w > size:
        scale = min(size / w, size / h) * 0.9
        nh, nw = max(1, int(h * scale)), max(1, int(w * scale))
        part = part[(np.arange(nh) * h // nh)][:, (np.arange(nw) * w // nw)]
        h, w = part.shape
    canvas = np.zeros((size, size), np.uint8)
    y, x = (size - h) // 2, (size - w) // 2
    canvas[y : y + h, x : x + w] = part.astype(np.uint8) * (255 if part.dtype == bool else 1)
    return 255 - canvas


def distance(mask: np.ndarray) -> np.ndarray:
    """Each ink pixel's chessboard-and-diagonal distance to the background, by two sweeps of a 3-4 chamfer."""
    far = 10**6
    d = np.pad(np.where(mask, far, 0), 1, constant_values=far).astype(np.int64)
    h, w = d.shape
    steps = np.arange(w) * 3
    for order, side in ((range(1, h), -1), (range(h - 2, -1, -1), 1)):
        for y in order:
            up = d[y + side]
            row = np.minimum(d[y], up + 3)
            row[1:] = np.minimum(row[1:], up[:-1] + 4)
            row[:-1] = np.minimum(row[:-1], up[1:] + 4)
            row = np.minimum.accumulate(row - steps) + steps
            d[y] = (np.minimum.accumulate((row + steps)[::-1])[::-1]) - steps
    return np.where(mask, np.minimum(d[1:-1, 1:-1], far) / 3.0, 0.0)


def statistics(grey: np.ndarray) -> dict[str, float]:
    """The 14 image statistics in FEATURES."""
    h, w = grey.shape
    smooth = blur(grey, 3)
    ink = smooth <= otsu(smooth)
    if ink.mean() * 255 > 127:
        ink = ~ink
    paper, stroke = grey[~ink], distance(ink)[ink]
    across, down = ink.sum(0), ink.sum(1)
    gy, gx = np.gradient(grey.astype(float))
    edges = np.hypot(gx, gy) > 50
    change = np.flatnonzero(np.diff((across > 0).astype(np.int8)))
    bounds = np.concatenate([[0], change + 1, [w]])
    gaps = [b - a for a, b in zip(bounds, bounds[1:]) if across[a] == 0 and b < w]
    return {
        "pixel_density": round(float(ink.mean()), 6), "foreground_fraction": round(float((grey < 128).mean()), 6),
        "noise_coefficient": round(float(paper.std()) if len(paper) else 0.0, 4), "mean_stroke_width": round(float(stroke.mean() * 2) if len(stroke) else 1.0, 4),
        "aspect_ratio": round(w / h, 4), "horizontal_projection_variance": round(float(across.var()), 4),
        "vertical_projection_variance": round(float(down.var()), 4), "edge_density": round(float(edges.mean()), 6),
        "local_contrast": round(float(resize(grey, 32, 32).astype(float).std()), 4), "n_components": float(len(components(ink))),
        "mean_gap_px": round(float(np.mean(gaps)) if gaps else 0.0, 4), "std_gap_px": round(float(np.std(gaps)) if gaps else 0.0, 4),
        "image_height_px": float(h), "image_width_px": float(w),
    }


def per_image(images: DataFrame, make: Callable[[np.ndarray], dict | None], schema: str, key: str = "stem") -> DataFrame:
    """(key, fields of `schema`, status) of each image: what `make` returns. status is 'ok', or 'undecodable' or 'rejected' with nulls."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            out = []
            for k, h, w, data in zip(rows[key], rows["h"], rows["w"], rows["data"], strict=True):
                image = as_image(None if pd.isna(h) else int(h), None if pd.isna(w) else int(w), data)
                found = None if image is None else make(image)
                status = "undecodable" if image is None else "rejected" if found is None else "ok"
                out.append([k, *((found or {}).get(n) for n in names), status])
            yield pd.DataFrame(out, columns=[key, *names, "status"])

    kind = images.schema[key].dataType.simpleString()
    return images.select(key, "h", "w", "data").mapInPandas(run, f"`{key}` {kind}, {schema}, status string")


def image_statistics(images: DataFrame) -> DataFrame:
    return per_image(images, statistics, ", ".join(f"{f} double" for f in FEATURES))


def preprocess(images: DataFrame, height: int = 384, smoothing: int = 3, close_k: int = 3, dilations: int = 1) -> DataFrame:
    """(stem, h, w, ink, skeleton, profile, status): binary rasters as bytes of 0 and 1, and the skeleton's ink per column."""

    def make(image: np.ndarray) -> dict:
        ink = binarise(image, height, smoothing)
        lines = skeleton(ink, close_k, dilations)
        return {"h": ink.shape[0], "w": ink.shape[1], "ink": ink.astype(np.uint8).tobytes(), "skeleton": lines.astype(np.uint8).tobytes(), "profile": lines.sum(0).tolist()}

    return per_image(images, make, "h int, w int, ink binary, skeleton binary, profile array<int>")


def glyph_skeletons(glyphs: DataFrame, key: str = "stem") -> tuple[DataFrame, DataFrame]:
    """(manifest, rejects) of a batch of glyphs: (key, h, w, skeleton, n_pixels, status) with status 'ok', and (key, status) of those that can't be
    read ('undecodable') or have too little ink ('rejected'). Computed once and kept in the shared folder, as both read it."""

    def make(image: np.ndarray) -> dict | None:
        lines = glyph_skeleton(image)
        if lines is None:
            return None
        return {"h": lines.shape[0], "w": lines.shape[1], "skeleton": lines.astype(np.uint8).tobytes(), "n_pixels": int(lines.sum())}

    done = cut(per_image(glyphs, make, "h int, w int, skeleton binary, n_pixels long", key))
    return done.filter("status = 'ok'"), done.filter("status <> 'ok'").select(key, "status")


def blobs(images: DataFrame, least_area: int = 15) -> DataFrame:
    """(stem, x_start, x_end, y_start, y_end, area) of each component of images of 0 and 1 with at least `least_area` pixels."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            out = []
            for stem, h, w, data in zip(rows["stem"], rows["h"], rows["w"], rows["data"], strict=True):
                image = as_image(int(h), int(w), data)
                out += [(stem, x1, x2, y1, y2, n) for x1, y1, x2, y2, n in (components(image > 0) if image is not None else []) if n >= least_area]
            yield pd.DataFrame(out, columns=["stem", "x_start", "x_end", "y_start", "y_end", "area"])

    return images.select("stem", "h", "w", "data").mapInPandas(run, "stem string, x_start int, x_end int, y_start int, y_end int, area int")
