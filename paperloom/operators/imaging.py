"""Pixel stages on RGB arrays with numpy, and their batch form over Spark's image source.

No image library is needed; results follow the stages' definitions but are not equal to any library's to the last bit.  Each task holds
one image at a time.  Rows of the result hold raw RGB bytes with width and height; ``to_png`` encodes them.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .segments import MAX_SIDE, MAX_ZOOM, MIN_SIDE, TALL, WIDE

CONTRAST = 1.6


def _weights(old: int, new: int, reach: int = 3) -> np.ndarray:
    """The new-by-old matrix of a Lanczos resampling."""
    scale = max(old / new, 1.0)
    centre = (np.arange(new) + 0.5) * old / new - 0.5
    x = (np.arange(old)[None, :] - centre[:, None]) / scale
    w = np.where(np.abs(x) < reach, np.sinc(x) * np.sinc(x / reach), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resize(img: np.ndarray, width: int, height: int) -> np.ndarray:
    out = np.tensordot(_weights(img.shape[0], height), img.astype(np.float64), axes=(1, 0))
    out = np.tensordot(_weights(img.shape[1], width), out, axes=(1, 1)).transpose(1, 0, 2)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def safe_size(img: np.ndarray) -> np.ndarray:
    """Up to 800 on the short side, by twice at most, then down to 2000 on the long side."""
    h, w = img.shape[:2]
    if min(h, w) < MIN_SIDE:
        zoom = min(MAX_ZOOM, MIN_SIDE / min(h, w))
        img = resize(img, int(w * zoom), int(h * zoom))
    h, w = img.shape[:2]
    if max(h, w) > MAX_SIDE:
        img = resize(img, int(w * MAX_SIDE / max(h, w)), int(h * MAX_SIDE / max(h, w)))
    return img


def luma(img: np.ndarray) -> np.ndarray:
    return np.rint(img @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def equalise(img: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited adaptive equalisation of the lightness: clipped histograms of 8 x 8 tiles, blended between tile centres."""
    light = luma(img)
    h, w = light.shape
    ys, xs = np.linspace(0, h, tiles + 1).astype(int), np.linspace(0, w, tiles + 1).astype(int)
    maps = np.tile(np.arange(256.0), (tiles, tiles, 1))
    for i in range(tiles):
        for j in range(tiles):
            part = light[ys[i] : ys[i + 1], xs[j] : xs[j + 1]]
            if part.size:
                hist = np.bincount(part.ravel(), minlength=256).astype(np.float64)
                limit = max(1.0, clip * part.size / 256)
                over = np.maximum(hist - limit, 0).sum()
                maps[i, j] = np.cumsum(np.minimum(hist, limit) + over / 256) * 255 / part.size
    fy = np.clip((np.arange(h) + 0.5) * tiles / h - 0.5, 0, tiles - 1)
    fx = np.clip((np.arange(w) + 0.5) * tiles / w - 0.5, 0, tiles - 1)
    y0, x0 = np.floor(fy).astype(int), np.floor(fx).astype(int)
    y1, x1 = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1)
    ay, ax = (fy - y0)[:, None], (fx - x0)[None, :]
    at = lambda a, b: maps[a[:, None], b[None, :], light]
    even = (at(y0, x0) * (1 - ax) + at(y0, x1) * ax) * (1 - ay) + (at(y1, x0) * (1 - ax) + at(y1, x1) * ax) * ay
    gain = (even + 1) / (light.astype(np.float64) + 1)
    return np.clip(np.rint(img * gain[:, :, None]), 0, 255).astype(np.uint8)


def invert_bands(img: np.ndarray) -> np.ndarray:
    """Invert strips of a twentieth of the height whose mean saturation is over 60 and mean value under 160."""
    out, height = img.copy(), max(10, img.shape[0] // 20)
    for y in range(0, img.shape[0], height):
        band = img[y : y + height].astype(np.float64)
        value, low = band.max(axis=2), band.min(axis=2)
        saturation = np.where(value > 0, (value - low) * 255 / np.maximum(value, 1), 0)
        if saturation.mean() > 60 and value.mean() < 160:
            out[y : y + height] = 255 - img[y : y + height]
    return out


def contrast(img: np.ndarray, factor: float = CONTRAST) -> np.ndarray:
    mean = np.rint(luma(img).mean())
    return np.clip(np.rint(mean + (img - mean) * factor), 0, 255).astype(np.uint8)


def _convolve(channel: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    r = len(kernel) // 2
    padded = np.pad(channel.astype(np.float64), ((r, r), (r, r)), mode="edge")
    rows = sum(k * padded[i : i + channel.shape[0]] for i, k in enumerate(kernel))
    return sum(k * rows[:, i : i + channel.shape[1]] for i, k in enumerate(kernel))


def _gaussian(sigma: float, radius: int) -> np.ndarray:
    k = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma**2))
    return k / k.sum()


def sharpen(img: np.ndarray, radius: float = 1.5, percent: float = 150, threshold: int = 3) -> np.ndarray:
    """Unsharp mask."""
    blurred = np.stack([_convolve(img[:, :, c], _gaussian(radius, 4)) for c in range(3)], axis=2)
    change = img - blurred
    out = np.where(np.abs(change) >= threshold, img + change * percent / 100, img)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def threshold_bw(img: np.ndarray) -> np.ndarray:
    """Black and white by two local Gaussian thresholds, white only where both say so."""
    gray = luma(img).astype(np.float64)
    out = np.ones(gray.shape, bool)
    for block, offset in ((31, 10), (11, 2)):
        sigma = 0.3 * ((block - 1) * 0.5 - 1) + 0.8
        out &= gray > _convolve(gray, _gaussian(sigma, block // 2)) - offset
    return np.repeat((out * 255).astype(np.uint8)[:, :, None], 3, axis=2)


def thin(img: np.ndarray) -> np.ndarray:
    """Erosion of the dark strokes by two pixels."""
    inverse = 255 - luma(img)
    padded = np.pad(inverse, ((1, 0), (1, 0)), mode="edge")
    least = np.minimum.reduce([padded[1:, 1:], padded[:-1, 1:], padded[1:, :-1], padded[:-1, :-1]])
    return np.repeat((255 - least)[:, :, None], 3, axis=2)


def denoise(img: np.ndarray, strength: float = 8.0, patch: int = 3, reach: int = 10) -> np.ndarray:
    """Non-local means: each pixel is the mean of those within reach, weighted by how alike their surroundings are."""
    x = img.astype(np.float64)
    total, weight = np.zeros_like(x), np.zeros(x.shape[:2])
    padded = np.pad(x, ((reach, reach), (reach, reach), (0, 0)), mode="reflect" if min(x.shape[:2]) > reach else "edge")
    kernel = np.ones(2 * patch + 1) / (2 * patch + 1)
    for dy in range(-reach, reach + 1, 2):
        for dx in range(-reach, reach + 1, 2):
            other = padded[reach + dy : reach + dy + x.shape[0], reach + dx : reach + dx + x.shape[1]]
            far = _convolve(((x - other) ** 2).mean(axis=2), kernel)
            w = np.exp(-np.maximum(far - 2 * strength, 0) / strength**2)
            total += other * w[:, :, None]
            weight += w
    return np.clip(np.rint(total / weight[:, :, None]), 0, 255).astype(np.uint8)


def skew_angle(img: np.ndarray, limit: float = 15.0, step: float = 0.5) -> float:
    """The tilt within +-15 degrees that makes the rows' ink profile most uneven; 0 under half a degree or without ink."""
    ink = luma(img) < 128
    y, x = np.nonzero(ink)
    if len(y) < 5:
        return 0.0
    best, best_angle = -1.0, 0.0
    for angle in np.arange(-limit, limit + step, step):
        row = np.rint(y - x * np.tan(np.radians(angle))).astype(int)
        score = float((np.bincount(row - row.min()).astype(float) ** 2).sum())
        if score > best:
            best, best_angle = score, float(angle)
    return best_angle if abs(best_angle) > 0.5 else 0.0


def deskew(img: np.ndarray) -> np.ndarray:
    """Shear the rows back by the tilt; what comes in from outside is white."""
    angle = skew_angle(img)
    if not angle:
        return img
    out = np.full_like(img, 255)
    shift = np.rint(np.arange(img.shape[1]) * np.tan(np.radians(angle))).astype(int)
    for x, s in enumerate(shift.tolist()):
        column = img[max(0, s) : img.shape[0] + min(0, s), x]
        out[max(0, -s) : max(0, -s) + len(column), x] = column
    return out


def for_model(img: np.ndarray) -> np.ndarray:
    return sharpen(contrast(invert_bands(equalise(safe_size(img)))))


def for_ocr(img: np.ndarray) -> np.ndarray:
    return sharpen(thin(threshold_bw(equalise(denoise(safe_size(img))))))


def thumbnail(img: np.ndarray, most: int = 512) -> np.ndarray:
    h, w = img.shape[:2]
    scale = min(1.0, most / max(h, w))
    return img if scale == 1.0 else resize(img, max(1, int(w * scale)), max(1, int(h * scale)))


def composite(img: np.ndarray, box: tuple[int, int, int, int] | None) -> np.ndarray:
    """The page at width 640 above the table region, padded by 5 % and at most 800 wide, with a gap of 20."""
    if not box:
        return for_model(img)
    h, w = img.shape[:2]
    x0, y0, x1, y1 = box
    px, py = int((x1 - x0) * 0.05), int((y1 - y0) * 0.05)
    crop = img[max(0, y0 - py) : min(h, y1 + py), max(0, x0 - px) : min(w, x1 + px)]
    page, table = equalise(safe_size(img)), equalise(safe_size(crop))
    page = resize(page, 640, int(640 * (h / w)))
    if table.shape[1] > 800:
        table = resize(table, 800, int(table.shape[0] * 800 / table.shape[1]))
    out = np.full((page.shape[0] + 20 + table.shape[0], max(page.shape[1], table.shape[1]), 3), 255, np.uint8)
    out[: page.shape[0], : page.shape[1]] = page
    out[page.shape[0] + 20 :, : table.shape[1]] = table
    return out


def segments(img: np.ndarray) -> list[np.ndarray]:
    h, w = img.shape[:2]
    if w > h * WIDE:
        return [img[:, : w // 2], img[:, w // 2 :]]
    if h > w * TALL:
        return [img[: int(h * 0.55)], img[int(h * 0.45) :]]
    return [img]


def to_png(img: np.ndarray) -> bytes:
    """An RGB array as a PNG file."""
    h, w = img.shape[:2]
    raw = np.zeros((h, 1 + 3 * w), np.uint8)
    raw[:, 1:] = img.reshape(h, 3 * w)

    def part(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw.tobytes(), 6)) + part(b"IEND", b"")


RECIPES = {"model": for_model, "ocr": for_ocr, "thumbnail": thumbnail, "deskew": deskew, "none": lambda img: img}


def enhance(images: DataFrame, recipe: str = "model", split: bool = True) -> DataFrame:
    """origin, seg_idx, width, height, png for each segment of the rows of Spark's image source; undecodable images give no row."""
    stage = RECIPES[recipe]

    def run(batches):
        for pdf in batches:
            for origin, h, w, channels, data in pdf.itertuples(index=False):
                if h <= 0 or channels not in (1, 3, 4):
                    continue
                pixels = np.frombuffer(data, np.uint8).reshape(h, w, channels)
                rgb = np.repeat(pixels, 3, axis=2) if channels == 1 else pixels[:, :, 2::-1]
                for i, part in enumerate(segments(rgb) if split else [rgb], 1):
                    done = stage(np.ascontiguousarray(part))
                    yield pd.DataFrame({"origin": [origin], "seg_idx": [i], "width": [done.shape[1]], "height": [done.shape[0]], "png": [to_png(done)]})

    flat = images.selectExpr("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    return flat.mapInPandas(run, "origin string, seg_idx int, width int, height int, png binary")
