"""Image measures and labels."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline import vocab


def quality_score(sharpness: Column, brightness: Column, width: Column, height: Column) -> Column:
    """From the Laplacian's variance, the mean brightness (0 to 1) and the size."""
    size = F.when((width >= 300) & (height >= 300), 1.0).otherwise(0.5)
    score = 0.3 * F.least(F.lit(1.0), sharpness / 1000) + 0.2 * (1 - 2 * F.abs(brightness - 0.5)) + 0.3 * F.least(F.lit(1.0), width * height / (640 * 480)) + 0.2 * size
    return F.least(F.lit(1.0), score)


def room_type(url: Column, red: Column, green: Column, blue: Column) -> Column:
    """By words of the url, else by the leading mean colour."""
    t, out = F.lower(url), F.when(F.lit(False), F.lit(None).cast("string"))
    for name, words in vocab.ROOM_WORDS:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(t, F.lit(w))
        out = out.when(hit, name)
    return out.when((green > red) & (green > blue), "garden").when((blue > red) & (blue > green), "bathroom").otherwise("unknown")


def is_exterior(url: Column, green: Column, blue: Column) -> Column:
    """By words of the url, else by much blue or green (means from 0 to 1)."""
    t = F.lower(url)
    has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(t, w))
    return F.when(has(vocab.EXTERIOR_WORDS), True).when(has(vocab.INTERIOR_WORDS), False).otherwise((blue > 0.6) | (green > 0.5))


def measure(pixels: np.ndarray) -> tuple[float, ...]:
    """Sharpness, brightness, mean red, green, blue, contrast, edge density and mean gradient of an RGB array."""
    x = pixels.astype(np.float64)
    gray = x @ np.array([0.299, 0.587, 0.114])
    padded = np.pad(gray, 1, mode="reflect") if min(gray.shape) > 1 else np.pad(gray, 1, mode="edge")
    laplace = padded[:-2, 1:-1] + padded[2:, 1:-1] + padded[1:-1, :-2] + padded[1:-1, 2:] - 4 * gray
    down, across = padded[2:] - padded[:-2], padded[:, 2:] - padded[:, :-2]
    sy, sx = down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:], across[:-2] + 2 * across[1:-1] + across[2:]
    gradient = np.hypot(sx, sy)
    red, green, blue = x.mean((0, 1)) / 255
    return float(laplace.var()), float(gray.mean() / 255), float(red), float(green), float(blue), float(gray.std() / 255), float((gradient > 100).mean()), float(gradient.mean())


def color_histogram(pixels: np.ndarray, bins: int = 50) -> list[float]:
    """``3 * bins`` values: histograms of hue, saturation and value of an RGB array, each of unit length.

    Hue is halved to 0 to 180, saturation and value run to 256, as 8-bit images have them.
    """
    x = pixels.reshape(-1, 3).astype(np.float64)
    top, low = x.max(1), x.min(1)
    spread = np.where(top > low, top - low, 1.0)
    red, green, blue = x.T
    sixth = np.select([top == low, top == red, top == green], [np.zeros(len(x)), (green - blue) / spread, 2 + (blue - red) / spread], 4 + (red - green) / spread)
    hue = np.rint(np.mod(sixth * 60, 360) / 2) % 180
    saturation = np.rint(np.where(top > 0, 255 * (top - low) / np.where(top > 0, top, 1), 0))
    out = []
    for channel, end in ((hue, 180), (saturation, 256), (top, 256)):
        n = np.histogram(channel, bins, (0, end))[0].astype(np.float64)
        out += (n / max(1e-12, float(np.sqrt((n * n).sum())))).tolist()
    return out


def decode(raw: bytes | None) -> np.ndarray | None:
    """An image's RGB array; None for what cannot be read. Formats other than plain PNG need an imaging library."""
    if not raw:
        return None
    if raw[:8] == b"\x89PNG\r\n\x1a\n" and (pixels := _png(raw)) is not None:
        return pixels
    try:
        from PIL import Image
    except ImportError:
        return None
    try:
        return np.asarray(Image.open(io.BytesIO(raw)).convert("RGB"))
    except (OSError, ValueError):
        return None


def _png(raw: bytes) -> np.ndarray | None:
    """Pixels of a PNG of 8 bits a channel without interlacing; None for other or broken ones."""
    at, data, head = 8, [], None
    while at + 12 <= len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(head[3]) if head else None
    if head is None or channels is None or head[2] != 8 or head[6]:
        return None
    width, height = head[:2]
    try:
        lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, 1 + width * channels)
    except (zlib.error, ValueError):
        return None
    out = np.zeros((height, width, channels), np.int64)
    above = np.zeros((width, channels), np.int64)
    for y in range(height):
        kind, line = lines[y, 0], lines[y, 1:].reshape(width, channels).astype(np.int64)
        if kind in (0, 2):
            row = line + above * (kind == 2)
        elif kind == 1:
            row = np.cumsum(line, 0)
        elif kind in (3, 4):
            row, left, corner = np.zeros_like(line), np.zeros(channels, np.int64), np.zeros(channels, np.int64)
            for x in range(width):
                if kind == 3:
                    guess = (left + above[x]) // 2
                else:
                    p = left + above[x] - corner
                    far = np.stack([np.abs(p - left), np.abs(p - above[x]), np.abs(p - corner)])
                    guess = np.choose(far.argmin(0), [left, above[x], corner])
                row[x] = left = (line[x] + guess) & 255
                corner = above[x]
        else:
            return None
        above = out[y] = row & 255
    return (out[:, :, :3] if channels >= 3 else np.repeat(out[:, :, :1], 3, 2)).astype(np.uint8)


def decode_images(images: DataFrame) -> DataFrame:
    """``listing_id, original_url, width, height, file_size_bytes, pixels`` of fetched images; unreadable ones have NULL sizes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [decode(raw) for raw in batch["content"]]
            sizes = [(None, None) if x is None else (x.shape[1], x.shape[0]) for x in found]
            yield pd.DataFrame({
                "listing_id": batch["listing_id"], "original_url": batch["original_url"], "width": pd.array([s[0] for s in sizes], "Int32"), "height": pd.array([s[1] for s in sizes], "Int32"),
                "file_size_bytes": pd.array([None if raw is None else len(raw) for raw in batch["content"]], "Int32"), "pixels": [None if x is None else x.tobytes() for x in found],
            })

    return images.select("listing_id", "original_url", "content").mapInPandas(run, "listing_id long, original_url string, width int, height int, file_size_bytes int, pixels binary")


def measure_images(images: DataFrame) -> DataFrame:
    """``url, width, height`` and raw RGB bytes (``pixels``) to measures, score and labels; bad sizes give NULL measures."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["sharpness", "brightness", "red", "green", "blue", "contrast", "edges", "gradient"]
        for batch in batches:
            out = []
            for w, h, raw in zip(batch["width"], batch["height"], batch["pixels"], strict=True):
                ok = raw is not None and w and h and len(raw) == 3 * w * h
                out.append(measure(np.frombuffer(raw, np.uint8).reshape(int(h), int(w), 3)) if ok else (None,) * 8)
            yield pd.concat([batch[["url", "width", "height"]].reset_index(drop=True), pd.DataFrame(out, columns=names, dtype=float)], axis=1)

    measured = images.select("url", "width", "height", "pixels").mapInPandas(run, "url string, width int, height int, sharpness double, brightness double, red double, green double, blue double, contrast double, edges double, gradient double")
    return measured.withColumns({
        "quality_score": quality_score(F.col("sharpness"), F.col("brightness"), F.col("width"), F.col("height")),
        "room_type": room_type(F.col("url"), F.col("red"), F.col("green"), F.col("blue")),
        "is_exterior": is_exterior(F.col("url"), F.col("green"), F.col("blue")),
    })


def feature_vectors(images: DataFrame) -> DataFrame:
    """``url, features``: the colour histograms of raw RGB images (``url, width, height, pixels``); bad sizes give NULL."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for w, h, raw in zip(batch["width"], batch["height"], batch["pixels"], strict=True):
                ok = raw is not None and w and h and len(raw) == 3 * w * h
                out.append(color_histogram(np.frombuffer(raw, np.uint8).reshape(int(h), int(w), 3)) if ok else None)
            yield pd.DataFrame({"url": batch["url"], "features": out})

    return images.select("url", "width", "height", "pixels").mapInPandas(run, "url string, features array<double>")
