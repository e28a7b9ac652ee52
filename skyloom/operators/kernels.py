"""Array kernels whose reach depends on the data, run on one tile's rows at a time by Arrow-batched functions.

A tile is a bounded raster (512 x 512 in production), so a task holds one tile, never a mosaic.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def per_tile(df: DataFrame, key: str, kernel: Callable[[np.ndarray], np.ndarray | float], kind: str = "double", value: str = "v") -> DataFrame:
    """(key, y, x, out): the kernel of each tile's raster; missing pixels are 0."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((int(p["y"].max()) + 1, int(p["x"].max()) + 1))
        a[p["y"], p["x"]] = p[value]
        out = kernel(a)
        return pd.DataFrame({key: p[key], "y": p["y"], "x": p["x"], "out": out[p["y"], p["x"]]})

    return df.select(key, "y", "x", value).groupBy(key).applyInPandas(run, f"{key} long, y int, x int, out {kind}")


def per_tile_value(df: DataFrame, key: str, kernel: Callable[[np.ndarray], float], value: str = "v") -> DataFrame:
    def run(p: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((int(p["y"].max()) + 1, int(p["x"].max()) + 1))
        a[p["y"], p["x"]] = p[value]
        return pd.DataFrame({key: p[key].iloc[:1], "out": [float(kernel(a))]})

    return df.select(key, "y", "x", value).groupBy(key).applyInPandas(run, f"{key} long, out double")


def high_frequency_share(a: np.ndarray, box: int = 16) -> float:
    """Share of log spectral magnitude outside a low-frequency box about the centre."""
    m = np.log1p(np.abs(np.fft.fftshift(np.fft.fft2(a))))
    r, c = (n // 2 for n in a.shape)
    h = min(box // 2, r // 2, c // 2)
    low = m[r - h : r + h, c - h : c + h].sum()
    return (m.sum() - low) / (m.sum() + 1e-6)


def distance_transform(inside: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance to the nearest pixel that is not inside; infinite if there is none.

    The nearest one in the row by two scans, then row by row the least over the column; no more than the raster is held.
    """
    h, w = inside.shape
    x = np.arange(w)
    before = np.maximum.accumulate(np.where(inside, -np.inf, x), axis=1)
    after = np.minimum.accumulate(np.where(inside, np.inf, x)[:, ::-1], axis=1)[:, ::-1]
    row = np.minimum(x - before, after - x) ** 2
    rows = np.arange(h)
    return np.sqrt(np.stack([(row + ((rows - y) ** 2)[:, None]).min(axis=0) for y in range(h)])) if h else row


def connected(mask: np.ndarray) -> np.ndarray:
    """8-connected component labels, each its smallest pixel index plus 1; 0 outside."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    big = mask.size + 2
    while True:
        p = np.pad(np.where(mask, label, big), 1, constant_values=big)
        low = np.min([p[dy : dy + mask.shape[0], dx : dx + mask.shape[1]] for dy in range(3) for dx in range(3)], axis=0)
        new = np.where(mask, low, 0)
        # a pixel also takes what its label's pixel has, so chains shorten by halves
        flat = np.concatenate(([0], new.ravel()))
        new = np.where(mask, flat[new], 0)
        if (new == label).all():
            return label
        label = new


def clahe(a: np.ndarray, clip: float = 2.0, grid: int = 8) -> np.ndarray:
    """Contrast-limited adaptive equalisation of 0..255 values: clipped tile histograms, bilinear between their maps."""
    h, w = a.shape
    ys, xs = (np.linspace(0, n, min(grid, n) + 1).astype(int) for n in (h, w))
    maps = np.zeros((len(ys) - 1, len(xs) - 1, 256))
    q = np.clip(a, 0, 255).astype(int)
    for i in range(len(ys) - 1):
        for j in range(len(xs) - 1):
            hist = np.bincount(q[ys[i] : ys[i + 1], xs[j] : xs[j + 1]].ravel(), minlength=256).astype(float)
            area = hist.sum()
            limit = max(1.0, clip * area / 256)
            over = np.maximum(hist - limit, 0).sum()
            maps[i, j] = np.cumsum(np.minimum(hist, limit) + over / 256) * 255 / max(area, 1)
    cy, cx = ((e[1:] + e[:-1] - 1) / 2 for e in (ys, xs))
    fy, fx = np.interp(np.arange(h), cy, np.arange(len(cy))), np.interp(np.arange(w), cx, np.arange(len(cx)))
    y0, x0 = np.floor(fy).astype(int), np.floor(fx).astype(int)
    y1, x1 = np.minimum(y0 + 1, len(cy) - 1), np.minimum(x0 + 1, len(cx) - 1)
    ty, tx = (fy - y0)[:, None], (fx - x0)[None]
    pick = lambda i, j: maps[i[:, None], j[None], q]
    return (1 - ty) * ((1 - tx) * pick(y0, x0) + tx * pick(y0, x1)) + ty * ((1 - tx) * pick(y1, x0) + tx * pick(y1, x1))


def canny(a: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Edges (255) by Sobel, thinning along four directions, and hysteresis through 8-connected weak pixels."""
    p = np.pad(a.astype(float), 1, mode="reflect")
    s = lambda dy, dx: p[1 + dy : p.shape[0] - 1 + dy, 1 + dx : p.shape[1] - 1 + dx]
    gx = s(-1, 1) + 2 * s(0, 1) + s(1, 1) - s(-1, -1) - 2 * s(0, -1) - s(1, -1)
    gy = s(1, -1) + 2 * s(1, 0) + s(1, 1) - s(-1, -1) - 2 * s(-1, 0) - s(-1, 1)
    m = np.abs(gx) + np.abs(gy)
    turn = np.round(np.arctan2(gy, gx) / (np.pi / 4)).astype(int) % 4
    q = np.pad(m, 1)
    near = lambda dy, dx: q[1 + dy : q.shape[0] - 1 + dy, 1 + dx : q.shape[1] - 1 + dx]
    steps = {0: (0, 1), 1: (1, 1), 2: (1, 0), 3: (1, -1)}
    thin = np.zeros(m.shape, dtype=bool)
    for k, (dy, dx) in steps.items():
        thin |= (turn == k) & (m > near(-dy, -dx)) & (m >= near(dy, dx))
    weak = thin & (m > low)
    labels = connected(weak)
    kept = np.unique(labels[weak & (m > high)])
    return np.where(weak & np.isin(labels, kept), 255.0, 0.0)


def bicubic(a: np.ndarray, height: int, width: int, k: float = -0.75) -> np.ndarray:
    """Resize by 16 taps of the cubic kernel, pixel centres aligned, edges repeated."""

    def weights(t: np.ndarray) -> np.ndarray:
        t = np.abs(t)
        return np.where(t <= 1, (k + 2) * t**3 - (k + 3) * t**2 + 1, np.where(t < 2, k * t**3 - 5 * k * t**2 + 8 * k * t - 4 * k, 0))

    def axis(n: int, m: int) -> np.ndarray:
        at = (np.arange(m) + 0.5) * n / m - 0.5
        first = np.floor(at).astype(int) - 1
        out = np.zeros((m, n))
        for i in range(4):
            np.add.at(out, (np.arange(m), np.clip(first + i, 0, n - 1)), weights(at - first - i))
        return out

    return axis(a.shape[0], height) @ a @ axis(a.shape[1], width).T


# fixed values: component types and their bytes, element shapes and their lengths, of the glTF 2.0 specification
COMPONENTS = {5120: "i1", 5121: "u1", 5122: "<i2", 5123: "<u2", 5124: "<i4", 5125: "<u4", 5126: "<f4"}
SHAPES = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4, "MAT2": 4, "MAT3": 9, "MAT4": 16}


def accessor(buffer: bytes, offset: int, count: int, component: int, shape: str, stride: int = 0) -> np.ndarray:
    """(count, length) elements of an accessor; a stride other than 0 steps over interleaved data."""
    kind, n = np.dtype(COMPONENTS[component]), SHAPES[shape]
    step = stride or kind.itemsize * n
    return np.ndarray((count, n), kind, buffer, offset, (step, kind.itemsize)).copy()


def raw_rgba(data: bytes, size: int) -> np.ndarray:
    """A square RGBA face; the length must fit."""
    if len(data) != size * size * 4:
        raise ValueError(f"{len(data)} bytes are not {size} x {size} x 4")
    return np.frombuffer(data, dtype=np.uint8).reshape(size, size, 4)


def lut(data: bytes, *shape: int) -> np.ndarray:
    out = np.frombuffer(data, dtype="<f4")
    return out.reshape(*shape)


def ktx_payload(data: bytes) -> tuple[int, int, int, bytes]:
    """Width, height, GL internal format and first mip level of a KTX 1 file."""
    if data[:12] != b"\xabKTX 11\xbb\r\n\x1a\n":
        raise ValueError("not a KTX 1 file")
    order = "<" if data[12:16] == b"\x01\x02\x03\x04" else ">"
    words = struct.unpack(f"{order}12I", data[16:64])
    start = 64 + words[11]
    (size,) = struct.unpack(f"{order}I", data[start : start + 4])
    return words[5], words[6], words[3], data[start + 4 : start + 4 + size]
